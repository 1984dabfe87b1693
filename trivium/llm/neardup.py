"""Operator 9: near-duplicate detection with MinHash, banding and star components.

One pass over the texts computes, for each document, the set of distinct
``k``-word shingles as 64-bit hashes, ``bands * rows`` universal hash minima
over it, one key a band and a one-bit signature (a bit of each minimum).
Documents with the same word sequence form a class; only its smallest
identifier takes part further on, so copies never meet in a bucket.

Candidates come from band buckets, without ever listing the pairs of a bucket:

1. Each document is paired with one centre, the bucket mate of the highest
   degree that shares most buckets with it.  The pairs are verified on the full
   shingle sets and joined to components.
2. Buckets that still hold several components are not done.  For their
   documents, shingles are ordered by how many of these documents have them; a
   pair at the threshold must share one of the rarest shingles of each, where
   ``n - ceil(n * threshold) + 1`` of n count as rarest.  Documents meet again
   by these shingles.  Those outside the main component of such a meeting are
   compared with the members of other components in blocks within a task, by
   signature (six standard deviations below the threshold pass) and by a bitmap
   that bounds the intersection, and the best partners are verified on the full sets.  First each document
   looks in its largest meeting alone, then in all; while some document had more
   partners than were taken, the search is repeated with eight times as many.
   It ends when every pair of different components that could be linked has been
   tested.  Pairs within one component need no test, so no link between
   components is lost.

With the default 32 bands of 4 rows, a pair at similarity 0.8 misses all
bands with probability 5e-8.  Components are found by alternating large-star
and small-star until nothing changes.

The nodes are rows, told apart by a number, so that what repeats a doc_id is
compared with its own text.  :func:`near_groups` then joins the classes that
share a doc_id, which makes such rows one node.  :func:`drop_near_copies`
decides rows by their texts alone and keeps one row of each component.

Edge cases: documents without words have no shingle, are linked with nothing
and are their own component; with fewer than ``k`` words the whole sequence is
the one shingle; in :func:`near_groups` a null doc_id is linked with nothing,
its component is null and it is kept, in :func:`drop_near_copies` it is kept
where its component has no other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, materialise, mix64, numbered, release_memory, rows_of, words

SKETCH_SCHEMA = "id long, doc_id long, key binary, n_shingles long, bits0 long, bits1 long, bands array<long>"
PRIME = U64(0x9E3779B97F4A7C15)
PART = 1024  # members of a bucket that one block of a task holds
PARTNERS = 8
BITMAP = 4096
DEVIATIONS = 6  # standard deviations by which a signature may understate the similarity


class WordHashes(dict):
    """64-bit hashes of words, computed once a task for most words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


def shingle_set(tokens: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles."""
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    width = min(k, len(tokens))
    out = np.full(len(tokens) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix64(out * PRIME + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash function over the set, in blocks of bounded size."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        block = a[:, None] * shingles[None, at : at + 2048]
        block += b[:, None]
        np.minimum(best, block.min(axis=1), out=best)
    return best


def sketches(docs: DataFrame, row: str, k: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """``id`` (the number of the row, named ``row`` in ``docs``), ``doc_id``, ``key`` of the word sequence, ``n_shingles``, signature and band keys."""
    if bands * rows != 128:
        raise ValueError("bands * rows must be 128, the length of the signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**63, 128, dtype=np.uint64) * U64(2) + U64(1)
        b = rng.integers(0, 2**63, 128, dtype=np.uint64)
        number = np.arange(bands, dtype=np.uint64)
        hashes = WordHashes()
        for batch in batches:
            keys, sizes, bits, found = [], [], [], []
            for (text,) in rows_of([batch], ("text",)):
                tokens = words(text)
                s = shingle_set(tokens, k, hashes)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    bits.append((0, 0))
                    found.append([])
                    continue
                keys.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                low = minima(s, a, b)
                bits.append(np.packbits((low >> U64(40) & U64(1)).astype(np.uint8)).view(np.int64).tolist())
                band = number + U64(1)
                for column in low.reshape(bands, rows).T:
                    band = mix64(band * PRIME + column)
                found.append(band.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(row),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array([x[0] for x in bits], pa.int64()),
                    pa.array([x[1] for x in bits], pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                names=["id", "doc_id", "key", "n_shingles", "bits0", "bits1", "bands"],
            )
        release_memory()

    return docs.select(row, "doc_id", "text").mapInArrow(run, SKETCH_SCHEMA)


def shingle_sets(docs: DataFrame, row: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                blobs = [shingle_set(words(t), k, hashes).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(row), pa.array(blobs, pa.binary())], names=["id", "shingles"])
        release_memory()

    return docs.select(row, "text").mapInArrow(run, "id long, shingles binary")


def shingle_rows(sets: DataFrame) -> DataFrame:
    """One row (s, id) for each shingle of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                blobs = part.column("shingles").to_pylist()
                ids = np.repeat(part.column("id").to_numpy(), [len(x) // 8 for x in blobs])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs), np.int64)), pa.array(ids)], names=["s", "id"])

    return sets.mapInArrow(run, "s long, id long")


def bitmaps(sets: DataFrame) -> DataFrame:
    """``id, bitmap``: which of BITMAP parts of the hash space a set touches.

    Sets x and y have at most popcount(X & Y) + min(n - popcount) shingles in
    common, which comes close to their intersection unless they are large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column("shingles").to_pylist():
                bits = np.zeros(BITMAP, np.uint8)
                bits[(np.frombuffer(blob, np.uint64) % U64(BITMAP)).astype(np.int64)] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "bitmap"])

    return sets.mapInArrow(run, "id long, bitmap binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) for which 100 * intersection >= percent * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links (a, b): component is the smallest node reachable.

    Alternates large-star and small-star; each operation moves links to the
    smallest neighbour.  A round is one of each, written once, so that its plan
    stays small; the loop ends when a round changes nothing.
    """

    def pairs(e: DataFrame, *ends: tuple[str, str]) -> DataFrame:
        return e.select(F.explode(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends))).alias("e")).select("e.*")

    def large(e: DataFrame) -> DataFrame:
        both = pairs(e, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        return pairs(down.join(low, "u"), ("v", "m"), ("u", "m")).filter("u <> v").distinct()

    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", rows=edges.count(), least=1)
    before = _fingerprint(now)
    while before[0]:
        last, now = now, materialise(small(large(now)), "edges", rows=before[0], least=1)
        discard(last)
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()


def open_rows(member: DataFrame, component: DataFrame, bits: DataFrame, everywhere: bool) -> DataFrame:
    """Rows of buckets that hold several components: ``bucket, part, outside, id, c, bits0, bits1``.

    Members of a bucket are dealt to parts of about PART rows; documents
    outside its main component are ``outside`` and go to all parts.  Unless
    ``everywhere``, a document appears in its largest open bucket only.
    """
    signature = [c for c in bits.columns if c != "id"]
    of = member.join(component.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    sizes = of.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_c"), F.sum("n").alias("g"), F.max(F.struct("n", "c"))["c"].alias("main")).filter("n_c > 1").drop("n_c")
    rows = of.join(main, "bucket")
    if not everywhere:
        rows = rows.groupBy("id", "c").agg(F.max(F.struct("g", "bucket", "main")).alias("top")).select("id", "c", "top.*")
    rows = rows.join(bits, "id").withColumn("parts", F.ceil(F.col("g") / PART).cast("int"))
    members = rows.select("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("outside"), "id", "c", *signature)
    outside = rows.filter("c <> main").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("outside"), "id", "c", *signature)
    return members.unionByName(outside)


def partners(rows: DataFrame, percent: int, take: int) -> DataFrame:
    """Pairs (a, b) to verify: for each outside document its ``take`` best by signature in each part.

    A row with null a says that some document had more.
    """
    agree = 64 * (1 + percent / 100)
    most = 128 - (agree - DEVIATIONS * (agree * (128 - agree) / 128) ** 0.5)
    spread = F.pmod(F.xxhash64("bucket", "part"), F.lit(1 << 20))

    def run(table: pa.Table) -> pa.Table:
        names = ("bucket", "part", "outside", "id", "c", "bits0", "bits1", "n_shingles", "shared")
        columns = [table.column(x).to_numpy() for x in names]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        bucket, part, outside, ids, c, bits0, bits1, size, shared = (x[order] for x in columns)
        bitmap = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITMAP // 64)[order]
        extra = size - np.bitwise_count(bitmap).sum(axis=1)
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
        pairs, cut = set(), False
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
            mid = lo + int(np.searchsorted(outside[lo:hi], True))
            for at in range(mid, hi, 256):
                x = slice(at, min(at + 256, hi))
                differ = (np.bitwise_count(bits0[x, None] ^ bits0[None, lo:mid]) + np.bitwise_count(bits1[x, None] ^ bits1[None, lo:mid])).astype(np.int16)
                differ[c[x, None] == c[None, lo:mid]] = 999
                both = np.minimum(shared[x, None], shared[None, lo:mid])
                good = (differ <= most) & ((100 + percent) * both >= percent * (size[x, None] + size[None, lo:mid]))
                n = good.sum(axis=1)
                for i in np.flatnonzero(n):
                    j = np.flatnonzero(good[i])
                    both = np.bitwise_count(bitmap[lo:mid][j] & bitmap[at + i]).sum(axis=1) + np.minimum(extra[lo:mid][j], extra[at + i])
                    hit = (100 + percent) * both >= percent * (size[lo:mid][j] + size[at + i])
                    j, both = j[hit], both[hit]
                    if len(j) > take:
                        cut = True
                        j = j[np.argsort(-both, kind="stable")[:take]]
                    a = int(ids[at + i])
                    pairs.update((min(a, b), max(a, b)) for b in ids[lo:mid][j].tolist())
        return pa.table({"a": pa.array([x for x, _ in pairs] + [None] * cut, pa.int64()), "b": pa.array([y for _, y in pairs] + [None] * cut, pa.int64())})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_g", spread).withColumn("_g", F.pmod("_g", F.lit(4 * n))).groupBy("_g").applyInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, row: str, k: int, percent: int, bands: int, rows: int, unnamed: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sketches of all rows; ``key, rep`` of each class of equal word sequences; the links (a, b) between representatives and their components.

    ``row`` names the column of ``docs`` that numbers its rows; those without
    a doc_id take part only if ``unnamed``.
    """
    sketch = materialise(sketches(docs, row, k, bands, rows), "sketches")
    named = sketch.filter("n_shingles > 0" if unnamed else "n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("key").agg(F.min("id").alias("rep"))
    reps = materialise(named.drop("doc_id", "key").join(classes.select(F.col("rep").alias("id")), "id", "left_semi"), "representatives", rows=sketch.count())
    n = reps.count()

    member = reps.select("id", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("g"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("bucket", "g")
    member = materialise(member.join(shared, "bucket"), "buckets", rows=n)
    sets = materialise(shingle_sets(docs.join(member.select(F.col("id").alias(row)).distinct(), row, "left_semi"), row, k), "sets", rows=16 * n)

    # First: one centre a document.
    degree = member.groupBy("id").agg(F.sum("g").alias("degree"))
    centre = member.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("low"))).alias("top")).select("bucket", (-F.col("top.low")).alias("a"))
    shares = member.join(centre, "bucket").filter("id <> a").groupBy("id", "a").agg(F.count(F.lit(1)).alias("shared"))
    pairs = shares.groupBy("id").agg(F.max(F.struct("shared", (-F.col("a")).alias("low"))).alias("top")).select((-F.col("top.low")).alias("a"), F.col("id").alias("b"))
    links = materialise(verified(pairs, sets, percent), "links", rows=4 * n)
    component = connected_components(links)

    # Then: what separates the components that still share a bucket.
    open_ids = open_rows(member, component, reps.select("id", "bits0", "bits1"), True).select("id").distinct()
    tokens = shingle_rows(sets.join(open_ids, "id", "left_semi"))
    common = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = tokens.join(common, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("order"))
    ranked = reps.select("id", "n_shingles", "bits0", "bits1").join(ranked, "id").withColumn("shared", F.size("order"))
    prefix = F.col("shared") - F.floor((percent * F.col("n_shingles") + 99) / 100) + 1
    ranked = materialise(ranked.withColumn("prefix", prefix.cast("int")).filter("prefix > 0").withColumn("order", F.expr("slice(order, 1, prefix)")), "ranked", rows=4 * n)
    bits = materialise(bitmaps(sets.join(ranked.select("id"), "id", "left_semi")).join(ranked.drop("order", "prefix"), "id"), "bits", rows=n)
    member = ranked.select("id", F.explode("order.s").alias("bucket"))
    take, everywhere = PARTNERS, False
    while True:
        open_ = open_rows(member, component, bits, everywhere)
        found = materialise(partners(open_, percent, take), "partners", rows=take * n)
        more = materialise(verified(found.filter("a is not null").select("a", "b").distinct(), sets, percent), "links", rows=4 * found.count())
        if more.limit(1).count():
            links = links.unionByName(more)
            component = connected_components(links)
        if everywhere:
            if not found.filter("a is null").limit(1).count():
                break
            take *= 8
        everywhere = True
    return sketch, classes, links, component


def class_components(classes: DataFrame, component: DataFrame) -> DataFrame:
    """``classes`` with ``c``, the least representative that links reach."""
    return classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")


def same_documents(sketch: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes that rows of one doc_id belong to; None if no doc_id has several."""
    named = sketch.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "key")
    mark = F.xxhash64("key")
    several = named.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo < hi").select("doc_id")
    if several.isEmpty():
        return None
    of = named.join(several, "doc_id", "left_semi").join(classes.select("key", "rep"), "key").select("doc_id", "rep").distinct()
    return of.join(of.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").filter("rep > a").select("a", F.col("rep").alias("b"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``."""
    docs, row = numbered(docs.select("doc_id", "text"))
    sketch, classes, links, component = near_classes(docs, row, k, percent, bands, rows, unnamed=False)
    same = same_documents(sketch, classes)
    if same is not None:
        component = connected_components(links.unionByName(same))
    least = sketch.filter("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.min("doc_id").alias("least"))
    of_class = class_components(least, component)
    of_class = of_class.join(of_class.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("key", "component_id")
    out = sketch.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(of_class, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """The rows of ``docs`` with their columns, one of each component: that of the smallest doc_id, the first of several such."""
    docs, row = numbered(docs)
    sketch, _, _, component = near_classes(docs, row, k, percent, bands, rows, unnamed=True)
    named = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "id")
    best = sketch.filter("n_shingles > 0").groupBy("key").agg(F.min("id").alias("rep"), F.min(named).alias("best"))
    keep = class_components(best, component).groupBy("c").agg(F.min("best").alias("best")).select(F.col("best.id").alias(row))
    keep = keep.unionByName(sketch.filter("n_shingles = 0").select(F.col("id").alias(row)))
    return docs.join(keep, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns if c != row))
