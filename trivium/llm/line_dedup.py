"""Operator 12: line deduplication over levelled sorted runs of line hashes.

A line's key is the line without the ASCII white space at both ends, A-Z
lower-cased; its hash is a pair of 64-bit hashes.  :class:`LineRuns` keeps what
is known of the lines seen so far in runs: tables bucketed and sorted by hash,
one row a key with the number of documents that brought it.  A new batch

1. counts, for each of its keys, the documents that hold it (partial counts
   before the shuffle, so a line that every document has is one row a task),
2. is anti-joined by merging with each run's settled keys, those that already
   have the wanted number of documents, as nothing about them can change,
3. adds the rest as a run of its own at level 0.

When a level has ``fan`` runs they are compacted into one of the next level,
where a key's counts are summed and may settle.  Runs share the bucketing of
the batch, so a merge shuffles neither them nor the batch again, and there are
at most ``fan`` runs for each of log(batches) levels.

:func:`drop_repeated_lines` deals the documents' hashes out in batches, adds
them one after the other, and then reads the keys found in at least
``documents`` documents.  Only hashes and the positions of lines that go are
shuffled by key; each text meets its positions in one join on a hash of
``(doc_id, text)`` and is cut there into the stretches between them.

All of it is DataFrame functions.  A key common to a third of all rows is
split by the adaptive skew join; counts are combined before they are shuffled.

Edge cases: a null or empty text is one empty line; a key shorter than
``least`` code points never goes; every row is a document, also where doc_ids
repeat or are null; rows alike in doc_id and text lose the same lines.  A text
that loses all its lines becomes empty.  An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_folder

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ("a", "b")
#: While runs are read.  One file a bucket, written sorted: a merge need not sort it again.  A union of bucketed tables says that
#: equal keys meet in a partition, but where it passes columnar batches on it puts partitions one after the other (Spark 4.1).
READING = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}


def lines_of(text: Column) -> Column:
    """The lines of a text; null is empty, and an empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    # lower() changes nothing but A-Z in a string of ASCII alone, and does so faster.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(text: Column, least: int = 1) -> Column:
    """For each line, in order, the hash of its key; null for keys of fewer than ``least`` code points."""

    def of(line: Column) -> Column:
        key = line_key(line)
        pair = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(12), key).alias("b"))
        return F.when(F.length(key) >= least, pair)

    return F.transform(lines_of(text), of)


def distinct_hashes(hashes: Column) -> Column:
    """The distinct hashes of a text, by sorting: array_distinct compares every two structs."""
    kept = F.transform(F.array(F.sort_array(hashes)), lambda s: F.filter(s, lambda x, i: x.isNotNull() & ((i == 0) | (F.get(s, i - 1).isNull()) | (x != F.get(s, i - 1)))))
    return F.element_at(kept, 1)


class LineRuns:
    """Levelled runs of (hash, documents) in bucketed tables: a context that drops them at its end; what it returns is to be written before."""

    def __init__(self, spark: SparkSession, documents: int, fan: int = 4, buckets: int | None = None):
        if fan < 2 or documents < 1:
            raise ValueError("fan must be 2 at least, documents 1 at least")
        self.spark, self.documents, self.fan = spark, documents, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._folder = f"{shared_folder(spark)}/trivium-{uuid.uuid4().hex}"
        self._tables = 0

    def __enter__(self) -> LineRuns:
        self._before = {k: self.spark.conf.get(k, None) for k in READING}
        for k, v in READING.items():
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *failure) -> None:
        for k, v in self._before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        for name in [t for level in self.levels for t in level]:
            self._drop(name)
        self.levels = []

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _write(self, run: DataFrame, level: int) -> None:
        self._tables += 1
        name = f"line_run_{self._folder[-32:]}_{self._tables}"
        run = run.repartition(self.buckets, *HASH)
        run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self._folder}/{name}").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _summed(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out.groupBy(*HASH).agg(F.sum("documents").alias("documents"))

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows ``a, b, documents`` of a batch whose keys no run has settled."""
        for run in self.runs():
            batch = batch.join(run.where(F.col("documents") >= self.documents).hint("merge"), list(HASH), "left_anti")
        return batch

    def add(self, hashes: DataFrame) -> None:
        """Add a batch of ``a, b`` rows, one for each document and key of it."""
        counts = hashes.groupBy(*HASH).agg(F.count("*").alias("documents"))
        self._write(self.unsettled(counts), 0)
        level = 0
        while len(self.levels[level]) == self.fan:
            full = self.levels[level]
            self.levels[level] = []
            self._write(self._summed(full), level + 1)
            for name in full:
                self._drop(name)
            level += 1

    def settled(self) -> DataFrame:
        """``a, b`` of the keys that at least ``documents`` documents hold."""
        names = [t for level in self.levels for t in level]
        if not names:
            return self.spark.createDataFrame([], "a long, b long")
        return self._summed(names).where(F.col("documents") >= self.documents).select(*HASH)


def _text_key(docs: DataFrame) -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("d"), F.xxhash64(F.lit(12), "doc_id", "text").alias("e")]


def repeated_positions(docs: DataFrame, documents: int = 10, least: int = 1, batches: int = 8, fan: int = 4) -> DataFrame:
    """``d, e, gone``: for each hash of (doc_id, text) the ascending positions, from 0, of the lines that go, if any."""
    spark = docs.sparkSession
    hashed = docs.select(*_text_key(docs), line_hashes(F.col("text"), least).alias("hashes"), F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"))
    table = materialise(hashed, "lines", by="batch")
    with LineRuns(spark, documents, fan) as runs:
        for batch in sorted(r.batch for r in table.select("batch").distinct().collect()):
            keys = table.where(F.col("batch") == batch).select(F.explode(distinct_hashes(F.col("hashes"))).alias("h"))
            runs.add(keys.select("h.a", "h.b"))
        often = materialise(runs.settled(), "often")
    each = table.select("d", "e", F.posexplode("hashes").alias("at", "h")).where(F.col("h").isNotNull()).select("d", "e", "at", "h.a", "h.b")
    return each.join(often, list(HASH), "left_semi").groupBy("d", "e").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def drop_repeated_lines(docs: DataFrame, documents: int = 10, least: int = 1, batches: int = 8, fan: int = 4) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every row; ``kept`` is the text without lines that ``documents`` rows hold."""
    docs = docs.select("doc_id", "text")
    gone = repeated_positions(docs, documents, least, batches, fan)
    met = docs.withColumns({"d": _text_key(docs)[0], "e": _text_key(docs)[1]}).join(gone, ["d", "e"], "left")
    lines = lines_of(F.col("text"))

    def without(lines: Column, gone: Column) -> Column:
        """The stretches between the positions, each a slice of the lines."""
        ends = F.concat(gone, F.array(F.size(lines)))
        stretch = lambda end, i: F.slice(lines, F.when(i == 0, F.lit(1)).otherwise(F.get(gone, i - 1) + 2), end - F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1))
        return F.flatten(F.transform(ends, stretch))

    # The lines are bound once by a lambda: a plain expression would be split again for each stretch.
    kept = F.element_at(F.transform(F.array(lines), lambda x: F.array_join(without(x, F.col("gone")), "\n")), 1)
    return met.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"),
    )
