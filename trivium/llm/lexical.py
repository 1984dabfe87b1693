"""Operator 11: ranked lexical search with variable-block-max WAND.

The documents are indexed in shards of neighbouring documents, each built by
one task from about ``SHARD_TERMS`` terms: for each term the documents that
hold it and their part of a score, which depends on the term's frequency, the
document's length and two totals alone, so that it is an integer to be
multiplied by the weight of the term in a query.

Posting lists are cut into blocks of variable length by dynamic programming:
a block costs a fixed amount and, for each posting, what the block's maximum
exceeds its part by; the cheapest cut of each prefix follows from those of
shorter prefixes, for blocks of 1, 2, 4 ... ``LONGEST_BLOCK`` postings.  Lists
of about one length are cut together.

A search goes through each shard from left to right.  Between two ends of any
of the query's blocks the sum of the block maxima is constant: it bounds every
document there.  The pivot is the next such interval whose bound reaches the
score of the k-th best document found so far, everything before it is skipped,
and the documents of the following intervals that reach it are scored from
those blocks alone that meet them.  The threshold is carried from shard to
shard within a task.  Bounds equal to the threshold are not skipped, so ties
are decided by doc_id and the result is exact.

A shard is one row of some 10 MB.  Parquet's writer looks at its size first after
a hundred rows and its reader takes a row group at once, so shards of one file
would be held together, by tasks of large splits all of them: each has its own file.

Queries are taken in blocks of at most ``QUERY_BYTES``, which go to the tasks
with what the index says about their terms; there are as many passes over the
index as there are such blocks.  Each task gives its k best a query; they meet
in two steps, the first dealt by query and task.

Edge cases: a null text has no terms; a query without terms, or whose terms no
document holds, has no rows; rows with one item_id are one item with all their
terms; a null item_id is an item.  Each row of the documents is a document,
also where doc_ids repeat; null doc_ids come last among equal scores.  Empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release_memory, small_batches, text_bytes

LONGEST_BLOCK = 256
BLOCK_COST = 1_500_000
SHARD_TERMS = 1_000_000
SHARDS_A_FILE = 1
QUERY_BYTES = 4 << 20
WINDOW = 512  # documents scored between two looks at the threshold
CUT_TOGETHER = 1 << 19
ARRAYS = {"doc_ids": np.int64, "nulls": np.uint8, "starts": np.int64, "docs": np.int32, "parts": np.int32, "blocks": np.int64, "ends": np.int64}
SHARD = "shard long, documents long, terms binary, " + ", ".join(f"{a} binary" for a in ARRAYS)
RESULT = "item long, doc_id long, score long"
_TERM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all code points above U+007F; A-Z lower-cased."""
    return text.translate(_TERM).split()


def choose_blocks(parts: np.ndarray, starts: np.ndarray, cost: int = BLOCK_COST, longest: int = LONGEST_BLOCK) -> np.ndarray:
    """Ends (exclusive) of the blocks of all posting lists; list i is parts[starts[i]:starts[i + 1]]."""
    lengths = np.diff(starts)
    ends = [starts[1:][lengths == 1]]
    sizes = 1 << np.arange(longest.bit_length())
    sizes = sizes[sizes <= longest]
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 1]
    at = 0
    while at < len(order):
        # Lists up to twice as long as the shortest of them, so that half of the matrix is used.
        top = np.searchsorted(lengths[order], 2 * lengths[order[at]], "right")
        top = min(top, at + max(1, CUT_TOGETHER // int(lengths[order[top - 1]])))
        ends.append(_cut_lists(parts, starts[order[at:top]], lengths[order[at:top]], sizes, cost))
        at = top
    return np.sort(np.concatenate(ends))


def _cut_lists(parts: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, cost: int) -> np.ndarray:
    n, lists = int(lengths.max()), len(starts)
    inside = np.arange(n)[:, None] < lengths
    held = np.where(inside, parts[np.minimum(starts + np.arange(n)[:, None], len(parts) - 1)], 0).astype(np.int64)
    total = np.concatenate([np.zeros((1, lists), np.int64), np.cumsum(held, 0)])
    sizes = sizes[sizes <= n]
    far = np.iinfo(np.int64).max // 2
    # price[j, i]: of a block of sizes[j] postings that ends before posting i.
    price = np.full((len(sizes), n + 1, lists), far, np.int64)
    most = held
    for j, size in enumerate(sizes):
        if j:
            half = size // 2
            most = np.maximum(most[:-half], most[half:])
        price[j, size:] = most * size - (total[size:] - total[:-size]) + cost
    best = np.full((n + 1, lists), far, np.int64)
    best[0] = 0
    taken = np.zeros((n + 1, lists), np.int8)
    for i in range(1, n + 1):
        m = i.bit_length() if i < sizes[-1] else len(sizes)
        m = min(m, len(sizes))
        found = best[i - sizes[:m]] + price[:m, i]
        taken[i] = found.argmin(0)
        best[i] = found.min(0)
    out = []
    place, which = lengths.copy(), np.arange(lists)
    while len(which):
        out.append(starts[which] + place[which])
        place[which] -= sizes[taken[place[which], which]]
        which = which[place[which] > 0]
    return np.concatenate(out)


def part_of_score(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds to a score, for weight 1; ``n`` are the lengths of the documents."""
    m = 10 + 90 * n.astype(np.int64) * documents // max(1, length)
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m)


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for text in _texts(batches):
            k = len(terms_of(text))
            n, length = n + (k > 0), length + k
        yield pa.RecordBatch.from_pydict({"n": [n], "length": [length]})

    small_batches(docs.sparkSession)
    row = docs.select("text").mapInArrow(run, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _texts(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[bytes]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            for text in batch.column("text").slice(at, size).cast(pa.binary()).to_pylist():
                yield b"" if text is None else text


class Shard:
    """The index of some documents: sorted terms, their postings (document, part) and the blocks of these."""

    def __init__(self, terms: list[bytes], **arrays: np.ndarray):
        self.terms = terms
        for name in ARRAYS:
            setattr(self, name, arrays[name])
        # The first block of each term; block b holds postings edges[b]..edges[b + 1].
        self.edges = np.concatenate([[0], self.ends])
        self.first_block = np.searchsorted(self.edges, self.starts)

    @classmethod
    def build(cls, doc_ids: list[int | None], texts: list[list[bytes]], documents: int, length: int, cost: int = BLOCK_COST, longest: int = LONGEST_BLOCK) -> Shard:
        number: dict[bytes, int] = {}
        flat = []
        for words in texts:
            for w in words:
                number.setdefault(w, len(number))
            flat.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        terms = sorted(number)
        rank = np.empty(len(terms), np.int64)
        rank[[number[t] for t in terms]] = np.arange(len(terms))
        lengths = np.array([len(x) for x in flat], np.int64)
        words = rank[np.concatenate(flat)] if terms else np.zeros(0, np.int64)
        pairs, tf = np.unique(words * len(texts) + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
        term, doc = pairs // max(1, len(texts)), pairs % max(1, len(texts))
        starts = np.searchsorted(term, np.arange(len(terms) + 1))
        parts = part_of_score(tf, lengths[doc], documents, length).astype(np.int32)
        ends = choose_blocks(parts, starts, cost, longest)
        blocks = np.maximum.reduceat(parts, np.concatenate([[0], ends[:-1]])).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        ids = np.array([0 if i is None else i for i in doc_ids], np.int64)
        return cls(terms, doc_ids=ids, nulls=np.array([i is None for i in doc_ids], np.uint8), starts=starts, docs=doc.astype(np.int32), parts=parts, blocks=blocks, ends=ends)

    def row(self, number: int) -> tuple:
        return (number, len(self.doc_ids), b"\n".join(self.terms), *(np.ascontiguousarray(getattr(self, a), kind).tobytes() for a, kind in ARRAYS.items()))

    @classmethod
    def of_row(cls, terms: bytes, **arrays: bytes) -> Shard:
        return cls(terms.split(b"\n") if terms else [], **{a: np.frombuffer(arrays[a], kind) for a, kind in ARRAYS.items()})

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of at most k documents with the highest scores from ``floor`` on, and of more that tie with the last."""
        a, b = self.first_block[lists], self.first_block[lists + 1]
        block = _ranges(a, b)
        weight = np.repeat(weights, b - a)
        bound = self.blocks[block] * weight
        last = self.docs[self.edges[block + 1] - 1].astype(np.int64)
        # A block reaches from behind the one before it, or from its first posting.
        begin = self.docs[self.edges[block]].astype(np.int64)
        edge = np.concatenate([begin, last + 1])
        order = np.argsort(edge, kind="stable")
        edge = edge[order]
        sums = np.cumsum(np.concatenate([bound, -bound])[order])
        final = np.flatnonzero(np.append(edge[1:] != edge[:-1], True))
        left, bounds = edge[final][:-1], sums[final][:-1]
        size = np.diff(edge[final])
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = max(1, floor)
        at = 0
        while True:
            # The pivot: the next interval that may hold a document for the k best.
            ahead = np.flatnonzero(bounds[at:] >= floor) + at
            if not len(ahead):
                return docs, scores
            ahead = ahead[: max(1, int(np.searchsorted(np.cumsum(size[ahead]), WINDOW, "right")))]
            at = int(ahead[-1]) + 1
            alive = np.zeros(len(self.doc_ids) + 1, np.int64)
            alive[_ranges(left[ahead], left[ahead] + size[ahead])] = 1
            before = np.concatenate([[0], np.cumsum(alive)])
            met = before[last + 1] > before[begin]
            posting = _ranges(self.edges[block[met]], self.edges[block[met] + 1])
            w = np.repeat(weight[met], self.edges[block[met] + 1] - self.edges[block[met]])
            doc = self.docs[posting]
            here = alive[doc] > 0
            doc = doc[here]
            lo = int(left[ahead[0]])
            score = np.zeros(int(left[ahead[-1]] + size[ahead[-1]]) - lo, np.int64)
            np.add.at(score, doc - lo, self.parts[posting[here]] * w[here])
            new = np.flatnonzero(score >= floor)
            docs, scores = np.concatenate([docs, new + lo]), np.concatenate([scores, score[new]])
            if len(scores) > k:
                floor = max(floor, int(np.partition(scores, -k)[-k]))
                docs, scores = docs[scores >= floor], scores[scores >= floor]


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All integers from a[i] to b[i], one range after the other."""
    n = b - a
    return np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def build_index(docs: DataFrame, cost: int = BLOCK_COST, longest: int = LONGEST_BLOCK) -> tuple[DataFrame, int, int]:
    """The shards of all documents as a written table, with the number of documents that have terms and of all terms."""
    documents, length = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[list[bytes]] = []
        held = 0

        def emit():
            row = Shard.build(ids, texts, documents, length, cost, longest).row((task << 32) + made)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if i < 2 else pa.binary()) for i, x in enumerate(row)], names=["shard", "documents", "terms", *ARRAYS])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts([batch])):
                words = terms_of(text)
                if not words:
                    continue
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
                if held >= SHARD_TERMS:
                    yield emit()
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield emit()
        texts = []
        release_memory()

    return materialise(docs.select("doc_id", "text").mapInArrow(run, SHARD), "index", most=SHARDS_A_FILE), documents, length


def document_frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the wanted terms is; the terms are those of one block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist()):
                n = np.diff(np.frombuffer(starts, np.int64)).tolist()
                for term, count in zip(terms.split(b"\n"), n):
                    if term in wanted:
                        found[term] = found.get(term, 0) + count
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(found.values(), pa.int64())], names=["term", "df"])

    sums = index.select("terms", "starts").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in sums.collect()}


def _better(k: int, ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the k best: highest score, then smallest doc_id, nulls last."""
    return np.lexsort((ids, nulls, -scores))[:k]


def search_block(index: DataFrame, queries: list[set[bytes]], documents: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the k best of each task for each of the queries, ``item`` being the query's place."""
    df = document_frequencies(index, set().union(*queries))
    weighed = [{t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in q if t in df} for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64))
        best = [none] * len(weighed)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("terms", *ARRAYS))):
                shard = Shard.of_row(row[0], **dict(zip(ARRAYS, row[1:])))
                place = {t: i for i, t in enumerate(shard.terms) if t in df}
                for i, query in enumerate(weighed):
                    lists = [(place[t], w) for t, w in query.items() if w and t in place]
                    if not lists:
                        continue
                    ids, nulls, scores = best[i]
                    at, w = np.array(lists, np.int64).T
                    doc, score = shard.best(at, w, k, int(scores[-1]) if len(scores) == k else 0)
                    new = [np.concatenate(x) for x in ((ids, shard.doc_ids[doc]), (nulls, shard.nulls[doc]), (scores, score))]
                    kept = _better(k, *new)
                    best[i] = tuple(x[kept] for x in new)
        items = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        ids, nulls, scores = (np.concatenate([none[j], *(b[j] for b in best)]) for j in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids, mask=nulls > 0), pa.array(scores)], names=["item", "doc_id", "score"])
        release_memory()

    return index.select("terms", *ARRAYS).mapInArrow(run, RESULT)


def _query_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """The items in blocks of bounded size, rows of one item together."""
    block: list[tuple[int | None, set[bytes]]] = []
    size = 0
    for r in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        words = set(terms_of(text_bytes(r["text"])))
        if block and block[-1][0] == r["item_id"]:
            block[-1][1].update(words)
        else:
            if size >= QUERY_BYTES:
                yield block
                block, size = [], 0
            block.append((r["item_id"], words))
        size += 16 + sum(map(len, words))
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, cost: int = BLOCK_COST, longest: int = LONGEST_BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    index, documents, _ = build_index(docs, cost, longest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts: list[DataFrame] = []
    for block in _query_blocks(items):
        found = search_block(index, [words for _, words in block], documents, k)
        first = Window.partitionBy("item", "task").orderBy(*order)
        found = found.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(32))).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
        parts.append(materialise(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return spark.read.parquet(*(p._trivium_folder + "/ranked" for p in parts)) if len(parts) > 1 else parts[0]
