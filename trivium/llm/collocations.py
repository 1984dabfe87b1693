"""Operator 13: phrase collocation mining by pivot partitioning.

Words are counted first, per language.  Every frequent word gets a number:
frequent words small ones, rare words large ones.  The pivot of a phrase is
its rarest word, the one with the largest number (the leftmost, should it be
there twice), so each occurrence of a phrase has one pivot occurrence.

The texts are then rewritten to fragments, one for each pivot occurrence: the
words around it, up to the longest phrase, as long as they are more frequent
than the pivot; everything from the first rarer or infrequent word on is
blank, as no phrase of this pivot reaches beyond.  Fragments are counted where
they arise (equal ones become one with a weight), packed and routed to the
partition of their pivot.  There phrases are grown from the pivot, word by
word, and a phrase is dropped as soon as its count, which is complete there,
falls short; only phrases of the partition's own pivots come out, so nothing
is counted twice and no infrequent phrase is ever shuffled.

A pivot with more occurrences than a quarter of a partition's quota is divided
further: what reaches to its left goes by its left neighbour, the rest by its
right one, which again brings each phrase to one place.  A pair of words that
fills a third of all texts is one weighted fragment for each context and task.

Words are numbered in a table of at most ``max_words`` words of at most
``LONGEST`` bytes, the most frequent ones, which the tasks get by broadcast
(``max_words * LONGEST`` bytes bound it).  Frequent words that do not fit are
numbered by 62 bits of hash, above all numbers of the table; a bitmap of
2**``FILTER_BITS`` bits tells them from infrequent words (an infrequent word
that it lets pass costs room but changes no count).

Counts of parts, scores and containment are joins over the frequent phrases
alone; scores are exact in decimals of 38 digits for counts below 10**15.

Edge cases: a null text is empty, a null language is ``und`` and one with a
language of that name; every row counts, also where doc_ids repeat or are
null; a very long word is a word like any other.  Empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, materialise, mix64, power_of_two_at_least, release_memory, small_batches

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
BREAKS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"  # no byte of UTF-8
NORMAL = bytes.maketrans(UPPER + BREAKS + b"\t", LOWER + BREAK * len(BREAKS) + b" ")
LONGEST = 48
FILTER_BITS = 27
HASHED = 1 << 62
FLUSH_WORDS = 1_000_000
FLUSH_DISTINCT = 500_000
FRAGMENTS_A_BUCKET = 1_500_000
FRAGMENTS = "bucket long, rows long, wide boolean, packed binary"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, with ``BREAK`` between pieces."""
    return text.translate(NORMAL).replace(BREAK, b" " + BREAK + b" ").split()


def _texts(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield from zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist())


def _source(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` of all words; in the row of a null word f is the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def emit():
            for lang, c in counts.items():
                c.pop(BREAK, None)
                words = pa.array([*c, None], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array([*c.values(), c.total()], pa.int64())], names=["lang", "word", "f"])
            counts.clear()

        for lang, text in _texts(batches):
            counts.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, counts.values())) > FLUSH_DISTINCT:
                yield from emit()
        yield from emit()
        release_memory()

    return _source(docs).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def hashed_number(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word).bitwiseAND(F.lit(HASHED - 1)).bitwiseOR(F.lit(HASHED))


def hash_of(lang: bytes, word: bytes) -> int:
    """The number of a word outside the table; what :func:`hashed_number` gives."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, 42)) & (HASHED - 1) | HASHED


class Numbers:
    """Numbers of the words of one language: those of the table, hashes of others that the bitmap knows, -1 for the rest."""

    class _OfLang(dict):
        def __init__(self, lang: str, bitmap: np.ndarray | None):
            self.lang, self.bitmap = lang.encode(), bitmap
            self[BREAK] = -1

        def __missing__(self, word: bytes) -> int:
            if self.bitmap is None:
                return -1
            number = hash_of(self.lang, word)
            bit = number & ((1 << FILTER_BITS) - 1)
            return number if self.bitmap[bit >> 3] >> (bit & 7) & 1 else -1

    def __init__(self, langs: list[str], words: list[bytes], bitmap: bytes | None):
        self.bitmap = None if bitmap is None else np.frombuffer(bitmap, np.uint8)
        self.of: dict[str, Numbers._OfLang] = {}
        for i, (lang, word) in enumerate(zip(langs, words)):
            self.lang(lang)[word] = i

    def lang(self, lang: str) -> Numbers._OfLang:
        if lang not in self.of:
            self.of[lang] = self._OfLang(lang, self.bitmap)
        return self.of[lang]


class Vocabulary:
    """The words that can be part of a frequent phrase, numbered; see the module's docstring."""

    def __init__(self, spark: SparkSession, frequent: DataFrame, max_words: int):
        step = F.floor(F.log2(F.col("f").cast("double")) * 8)
        ladder = sorted(((r["step"], r["n"]) for r in frequent.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
        least, held = None, 0
        for at, n in ladder:
            held += n
            if held > max_words:
                break
            least = at
        fits = (step >= least) & (F.octet_length("word") <= LONGEST) if least is not None else F.lit(False)
        table = frequent.where(fits).toArrow().sort_by([("f", "descending"), ("lang", "ascending"), ("word", "ascending")])
        self.counts = table.column("f").to_numpy()
        self.others = frequent.where(~fits)
        bitmap = None
        if self.others.limit(1).count():
            bit = hashed_number(F.col("lang"), F.col("word")).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
            # Spark numbers bits from 1 on: bit 1 is the first of bucket 1.
            parts = self.others.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
            out = bytearray(1 << (FILTER_BITS - 3))
            for r in parts.toLocalIterator():
                at = (r["part"] - 1) * 4096
                out[at : at + 4096] = r["bits"]
            bitmap = bytes(out)
        self.sent = spark.sparkContext.broadcast((table.column("lang").combine_chunks(), table.column("word").combine_chunks().cast(pa.binary()), table.column("f").combine_chunks(), bitmap))
        self.spark = spark

    def numbers(self):
        """A function that gives the Numbers on an executor, made once for each worker."""
        sent, name = self.sent, uuid.uuid4().hex
        return lambda: _numbers(name, sent)

    def dictionary(self) -> DataFrame:
        """``id, lang, word, f`` of every frequent word."""
        sent, parts = self.sent, max(1, len(self.counts) // 50_000)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, words, f, _ = sent.value
            for batch in batches:
                for part in batch.column("id").to_pylist():
                    a, b = len(f) * part // parts, len(f) * (part + 1) // parts
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b), pa.int64()), langs.slice(a, b - a), words.slice(a, b - a).cast(pa.string()), f.slice(a, b - a)], names=["id", "lang", "word", "f"])

        table = self.spark.range(0, parts, 1, parts).mapInArrow(run, "id long, lang string, word string, f long")
        return table.union(self.others.select(hashed_number(F.col("lang"), F.col("word")), "lang", "word", "f"))


_made: dict[str, Numbers] = {}


def _numbers(name: str, sent) -> Numbers:
    """The Numbers of a broadcast, made once for each worker process, which holds one of them."""
    if name not in _made:
        _made.clear()
        langs, words, _, bitmap = sent.value
        _made[name] = Numbers(langs.to_pylist(), words.to_pylist(), bitmap)
    return _made[name]


def fragments(x: np.ndarray, context: int) -> np.ndarray:
    """One row for each pivot occurrence in ``x`` (numbers, -1 is blank) that has a usable neighbour: the pivot in the middle."""
    at = np.flatnonzero(x >= 0)
    pivot = x[at]
    blank = np.full(context, -1, x.dtype)
    padded = np.concatenate([blank, x, blank])
    out = np.full((len(at), 2 * context + 1), -1, np.int64)
    out[:, context] = pivot
    for side in (-1, 1):
        open_ = np.ones(len(at), bool)
        for j in range(1, context + 1):
            word = padded[at + context + side * j]
            # The pivot is the leftmost of equal rarest words.
            open_ &= (word >= 0) & ((word < pivot) if side < 0 else (word <= pivot))
            out[open_, context + side * j] = word[open_]
    return out[(out[:, context - 1] >= 0) | (out[:, context + 1] >= 0)]


def routed(rows: np.ndarray, hot: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, whether a row counts only phrases that begin before the pivot, and buckets; pivots below ``hot`` go by their neighbours too."""
    context = rows.shape[1] // 2
    pivot = rows[:, context]
    many = pivot < hot
    left, right = rows[many & (rows[:, context - 1] >= 0)], rows[many & (rows[:, context + 1] >= 0)].copy()
    right[:, :context] = -1
    rest = rows[~many]
    near = np.concatenate([np.zeros(len(rest), np.int64), 2 * left[:, context - 1] + 2, 2 * right[:, context + 1] + 3])
    out = np.concatenate([rest, left, right])
    before = np.zeros(len(out), bool)
    before[len(rest) : len(rest) + len(left)] = True
    spread = mix64(out[:, context].astype(U64) * U64(0x9E3779B97F4A7C15) + mix64(near.astype(U64)))
    return out, before, (spread & U64(buckets - 1)).astype(np.int64)


def packed_rows(rows: np.ndarray, before: np.ndarray, weights: np.ndarray) -> tuple[bool, bytes]:
    wide = bool(len(rows)) and int(rows.max()) >= (1 << 32) - 1
    kind = np.uint64 if wide else np.uint32
    columns = [(rows[:, j] + 1).astype(kind) for j in range(rows.shape[1])] + [weights.astype(kind)]
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return wide, pa.Codec("zstd", compression_level=1).compress(b"".join(planes) + before.astype(np.uint8).tobytes(), asbytes=True)


def unpacked_rows(n: int, wide: bool, blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = 8 if wide else 4
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, n * ((width + 1) * size + 1), asbytes=True), np.uint8)
    planes = raw[: n * (width + 1) * size].reshape(width + 1, size, n)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64 if wide else np.uint32)[..., 0].astype(np.int64)
    return columns[:width].T - 1, raw[n * (width + 1) * size :].astype(bool), columns[width]


def packed_fragments(x: np.ndarray, context: int, hot: int, buckets: int) -> Iterator[tuple[int, int, bool, bytes]]:
    """``bucket, rows, wide, packed`` of the fragments in ``x``, equal ones counted."""
    rows, before, bucket = routed(fragments(x, context), hot, buckets)
    if not len(rows):
        return
    bits = buckets.bit_length() - 1
    h = before.astype(U64)
    for j in range(rows.shape[1]):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + rows[:, j].astype(U64))
    # One key: bucket, pivot, and what is left of the hash; rows that meet by chance stay apart below.
    pivot = rows[:, context].astype(U64) & U64((1 << 30) - 1)
    key = (bucket.astype(U64) << U64(64 - bits) if bits else U64(0)) | pivot << U64(34 - bits) | h >> U64(30 + bits)
    order = np.argsort(key)
    rows, before, bucket = rows[order], before[order], bucket[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(1) | (before[1:] != before[:-1]) | (bucket[1:] != bucket[:-1]))
    first = np.flatnonzero(new)
    weights = np.diff(np.append(first, len(rows)))
    rows, before, bucket = rows[first], before[first], bucket[first]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        yield int(bucket[a]), int(b - a), *packed_rows(rows[a:b], before[a:b], weights[a:b])


def route(docs: DataFrame, vocabulary: Vocabulary, max_words: int, buckets: int, quota: int) -> DataFrame:
    """The fragments of all texts, packed by bucket."""
    numbers = vocabulary.numbers()
    hot = int((vocabulary.counts > quota).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = numbers()
        held: list[np.ndarray] = []
        size = 0
        end = np.array([-1])

        def emit():
            rows = list(packed_fragments(np.concatenate(held), max_words - 1, hot, buckets))
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "rows", "wide", "packed"])

        for lang, text in _texts(batches):
            words = tokens(text)
            held += [np.fromiter(map(of.lang(lang).__getitem__, words), np.int64, len(words)), end]
            size += len(words) + 1
            if size >= FLUSH_WORDS:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()
        held.clear()
        release_memory()

    return _source(docs).mapInArrow(run, FRAGMENTS)


def mined(rows: np.ndarray, before: np.ndarray, weights: np.ndarray, max_words: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases, as rows of numbers, and their counts, for each length and place of the pivot.

    A phrase of n words with its pivot at place s grows from one of n - 1
    words that holds the pivot: by its last word, or by its first where the
    pivot is the last.
    """
    context = rows.shape[1] // 2
    dense, inverse = np.unique(rows, return_inverse=True) if len(rows) and rows.max() >= 1 << 32 else (None, rows)
    inverse = inverse.reshape(rows.shape)
    start = inverse[:, context]
    if dense is None and len(rows) and start.max() >= 1 << 31:
        start = np.unique(start, return_inverse=True)[1]
    grown = {0: start}
    for n in range(2, max_words + 1):
        longer: dict[int, np.ndarray] = {}
        for s in range(n):
            base = grown.get(s if s < n - 1 else n - 2)
            column = context - s + n - 1 if s < n - 1 else context - s
            if base is None:
                continue
            live = (base >= 0) & (rows[:, column] >= 0)
            if not s:
                live &= ~before
            at = np.flatnonzero(live)
            if not len(at):
                continue
            key = base[at].astype(U64) << U64(32) | inverse[at, column].astype(U64)
            order = np.argsort(key)
            key, at = key[order], at[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.add.reduceat(weights[at], first)
            kept = count >= least
            if not kept.any():
                continue
            name = np.where(kept, np.cumsum(kept) - 1, -1)
            out = np.full(len(rows), -1, np.int64)
            out[at] = np.repeat(name, np.diff(np.append(first, len(at))))
            longer[s] = out
            yield rows[at[first[kept]], context - s : context - s + n], count[kept]
        grown = longer


def phrases(routed_rows: DataFrame, max_words: int, least: int) -> DataFrame:
    """``ids, f`` of the phrases of 2 to ``max_words`` words that occur at least ``least`` times."""
    width = 2 * max_words - 1

    def run(table: pa.Table) -> pa.Table:
        got = [unpacked_rows(*x, width) for x in zip(*(table.column(c).to_pylist() for c in ("rows", "wide", "packed")))]
        rows, before, weights = (np.concatenate(x) for x in zip(*got))
        del got
        ids, f = [], []
        for found, count in mined(rows, before, weights, max_words, least):
            offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
            ids.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(found).ravel(), pa.int64())))
            f.append(pa.array(count, pa.int64()))
        kind = pa.list_(pa.int64())
        out = pa.table({"ids": pa.chunked_array(ids, kind), "f": pa.chunked_array(f, pa.int64())})
        release_memory()
        return out

    return routed_rows.groupBy("bucket").applyInArrow(run, "ids array<long>, f long")


def scored(grams: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``ids, a, l, r, score`` of every phrase, for its lowest-scoring cut."""
    counts = grams.select("ids", "f").union(dictionary.select(F.array("id"), "f"))
    cuts = grams.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    best = cuts.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("ids", "a", "cut.l", "cut.r", "cut.score")


def within(grams: DataFrame) -> DataFrame:
    """``ids, most`` of the phrases inside longer ones: the largest count of a longer one."""
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda i: F.slice("ids", i, n))))
    return grams.where(F.size("ids") > 2).select(F.explode(parts).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, percent: int = 50, top: int = 2000, table_words: int = 1 << 20) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language by score."""
    if max_words < 2 or least < 1:
        raise ValueError("phrases have two words at least and are wanted once at least")
    spark = docs.sparkSession
    counts = materialise(word_counts(docs).where((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = counts.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    words = int(totals.agg(F.sum("n")).first()[0] or 0)
    vocabulary = Vocabulary(spark, counts.where(F.col("word").isNotNull()), table_words)
    buckets = power_of_two_at_least(max(64, words / FRAGMENTS_A_BUCKET))
    fragments_ = route(docs, vocabulary, max_words, buckets, FRAGMENTS_A_BUCKET // 4)
    grams = materialise(phrases(fragments_, max_words, least), "phrases")
    dictionary = materialise(vocabulary.dictionary(), "dictionary")
    kept = scored(grams, dictionary).join(within(grams), "ids", "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    # Ties of the last place are resolved by the words, which only those that may be listed look up.
    lang = dictionary.select(F.col("id").alias("_first"), "lang")
    placed = kept.drop("most").withColumn("_first", F.get("ids", F.lit(0))).join(lang, "_first").drop("_first")
    order = [F.col("score").desc(), F.col("a").desc()]
    listed = placed.withColumn("_place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_place") <= top).drop("_place")
    spelt = listed.select("ids", F.posexplode("ids").alias("pos", "id")).join(dictionary.select("id", "word"), "id").groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    final = listed.join(spelt, "ids").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return final.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
