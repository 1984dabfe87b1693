"""Operator 4: language-model scoring by a weighted backoff automaton.

The model is an interpolated bigram model over words and the end of a text:

    P(w | h) = BIGRAM * c(h w) / c(h) + (1 - BIGRAM) * P(w),
    P(w)     = (1 - u) * c(w) / N,   P(unknown) = u = (n1 + 1) / (N + n1 + 2),

with counts over all training texts (n1: words seen once), so each
distribution adds up to 1.  As an automaton: a state for each word that has
followers in training and a root; an arc for each training bigram, with the
logarithm of P(w | h); a failure arc to the root, with the logarithm of
1 - BIGRAM; at the root, an arc for each word and one for unknown words.  One
left-to-right walk over a text carries the state and adds up the weights.

Counting is exact and distributed.  Documents are dealt to chunks by hash.
Tasks send the distinct words and bigrams of each chunk, as sorted hashes with
training counts, to buckets of the hash space; a bucket adds them up and
answers each chunk with what the others have on top of its own counts.  A
chunk thus gets exactly the part of the automaton that its texts can visit:
nothing grows with the vocabulary on the driver or in a broadcast.  Words are
told apart by 64 bits of hash, bigrams by 20 bits more than it takes to number
the bytes of the corpus (64 at most): one in a million meets another one.

Edge cases: a null or empty text is the end token alone; without training
texts every token is unknown; repeated rows count and are scored each; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, fold_of, mix64, pack_sorted, total_text_bytes, unpack_sorted, words
from .neardup import WordHashes

BIGRAM = 0.4
CHUNK_BYTES = 3 << 20
BUCKET_BYTES = 8 << 20
FLUSH_TOKENS = 2_000_000
END = b""  # no word is empty
PRIME = U64(0xD1342543DE82EF95)
COUNTS_SCHEMA = "bucket long, chunk long, keys binary, counts binary"
SCORES_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def bigram_keys(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of the bigrams of a token sequence; the end token also stands before the first word."""
    before = np.concatenate([h[-1:], h[:-1]])
    return mix64(before * PRIME + h) >> U64(64 - bits)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype("<u4").tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), "<u4").astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, inverse = np.unique(keys, return_inverse=True)
    return known, np.bincount(inverse, counts, len(known)).astype(np.int64)


def word_totals(docs: DataFrame, buckets: int, modulus: int, left_out: int) -> tuple[int, int, int]:
    """Training tokens, distinct ones and those seen once, over all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), {}

        def flush():
            known = np.fromiter(map(hashes.__getitem__, held), np.uint64, len(held))
            order = np.argsort(known)
            known, counts = known[order], np.fromiter(held.values(), np.int64, len(held))[order]
            held.clear()
            bucket = bucket_of(known, 64, buckets)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            at = bucket[np.concatenate([[0], cuts])]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([pack_sorted(k) for k in np.split(known, cuts)], pa.binary()), pa.array([pack_counts(c) for c in np.split(counts, cuts)], pa.binary())], names=["bucket", "keys", "counts"])

        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                if fold_of(doc_id, modulus) != left_out:
                    for w in words(text):
                        held[w] = held.get(w, 0) + 1
                    held[END] = held.get(END, 0) + 1
                    if len(held) > FLUSH_TOKENS // 4:
                        yield flush()
        if held:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        _, counts = summed(np.concatenate([unpack_sorted(x) for x in table.column("keys").to_pylist()]), np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()]))
        return pa.table({"n": [int(counts.sum())], "v": [len(counts)], "once": [int(np.count_nonzero(counts == 1))]})

    parts = docs.select("doc_id", "text").mapInArrow(count, "bucket long, keys binary, counts binary")
    row = parts.groupBy("bucket").applyInArrow(total, "n long, v long, once long").agg(F.sum("n"), F.sum("v"), F.sum("once")).first()
    return tuple(int(x or 0) for x in row)


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return ((keys >> U64(bits - 32)) * U64(buckets) >> U64(32)).astype(np.int64)


def chunk_counts(dealt: DataFrame, buckets: int, bits: int, modulus: int, left_out: int) -> DataFrame:
    """Distinct words (buckets 0 to buckets-1) and bigrams (the next ``buckets``) of each chunk with training counts."""
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(table: pa.Table) -> pa.Table:
        hashes, rows, held, weight = WordHashes(), [], [], []
        end = U64(hashes[END])
        for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()):
            tokens = words(text)
            held.append(np.append(np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens)), end))
            weight.append(np.full(len(tokens) + 1, float(fold_of(doc_id, modulus) != left_out)))
        weight, chunk = np.concatenate(weight), table.column("chunk")[0].as_py()
        for kind, width, keys in (0, 64, held), (1, bits, [bigram_keys(h, bits) for h in held]):
            known, counts = summed(np.concatenate(keys), weight)
            bucket = bucket_of(known, width, buckets)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for k, c, b in zip(np.split(known, cuts), np.split(counts, cuts), bucket[np.concatenate([[0], cuts])]):
                rows.append((int(b) + kind * buckets, chunk, pack_sorted(k), pack_counts(c)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["bucket", "chunk", "keys", "counts"])

    return dealt.groupBy("chunk").applyInArrow(run, COUNTS_SCHEMA)


def answers(counts: DataFrame) -> DataFrame:
    """For each chunk what other chunks have of its words and bigrams."""
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(table: pa.Table) -> pa.Table:
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        own = [unpack_counts(x) for x in table.column("counts").to_pylist()]
        known, total = summed(np.concatenate(keys), np.concatenate(own))
        rows = []
        for chunk, k, c in zip(chunks, keys, own):
            more = total[np.searchsorted(known, k)] - c
            hit = more > 0
            if hit.any():
                rows.append((bucket, chunk, pack_sorted(k[hit]), pack_counts(more[hit])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["bucket", "chunk", "keys", "counts"])

    return counts.groupBy("bucket").applyInArrow(run, COUNTS_SCHEMA)


class BackoffAutomaton:
    """States, weighted arcs and failure arcs over symbols 0..n-1; symbol ``end`` is also the start context.

    ``root[w]`` is the weight of w at the root; ``arcs`` maps
    state * n + w to the weight of an arc (whose target is the state of w);
    ``failure[s]`` is the weight of leaving state s for the root.
    """

    def __init__(self, root: list[float], arcs: dict[int, float], failure: list[float], end: int):
        self.root, self.arcs, self.failure, self.end, self.n = root, arcs, failure, end, len(root)

    def walk(self, symbols: list[int]) -> float:
        arc, root, failure, n = self.arcs.get, self.root, self.failure, self.n
        state, total = self.end, 0.0
        for w in symbols:
            weight = arc(state * n + w)
            if weight is None:
                weight = failure[state] + root[w]
            total += weight
            state = w
        return total


def build(symbols: np.ndarray, word_counts: np.ndarray, tokens: int, once: int, end: int, pairs: np.ndarray, pair_counts: np.ndarray, bigram: float = BIGRAM) -> BackoffAutomaton:
    """Automaton for ``symbols`` words with counts; ``pairs`` are h * n + w of bigrams with their counts."""
    n = len(symbols)
    unknown = (once + 1) / (tokens + once + 2) if tokens else 1.0
    p = np.where(word_counts > 0, (1 - unknown) * word_counts / max(1, tokens), unknown)
    root = np.log10(p)
    real = pair_counts > 0
    pairs, pair_counts = pairs[real], pair_counts[real]
    before, after = pairs // n, pairs % n
    weight = np.log10(bigram * pair_counts / np.maximum(1, word_counts[before]) + (1 - bigram) * p[after])
    failure = np.where(word_counts > 0, math.log10(1 - bigram), 0.0)
    return BackoffAutomaton(root.tolist(), dict(zip(pairs.tolist(), weight.tolist())), failure.tolist(), end)


def score(docs: DataFrame, modulus: int = 7, left_out: int = 2, bigram: float = BIGRAM) -> DataFrame:
    """One row a document; texts whose crc32 of doc_id modulo ``modulus`` is ``left_out`` are not learned from."""
    size = total_text_bytes(docs)
    chunks, buckets = max(24, -(-size // CHUNK_BYTES)), max(24, -(-size // BUCKET_BYTES))
    bits = min(64, max(32, size.bit_length() + 20))
    n_train, v_train, once = word_totals(docs, buckets, modulus, left_out)
    placed = docs.select("doc_id", "text").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    dealt = placed.repartition(chunks, "chunk")  # used twice, shuffled once
    reply = answers(chunk_counts(dealt, buckets, bits, modulus, left_out))

    def run(texts: pa.Table, reply: pa.Table) -> pa.Table:
        ids = texts.column("doc_id").to_pylist()
        if not ids:
            return pa.table({f.name: pa.array([], f.type) for f in RESULT})
        number: dict[bytes, int] = {END: 0}
        rows = []
        for text in texts.column("text").to_pylist():
            tokens = words(text)
            for w in tokens:
                number.setdefault(w, len(number))
            rows.append(np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens)))
        n = len(number)
        hashes = WordHashes()
        h = np.fromiter(map(hashes.__getitem__, number), np.uint64, n)
        rows = [np.append(r, 0) for r in rows]
        held = [fold_of(i, modulus) == left_out for i in ids]
        lengths = [len(r) for r in rows]
        flat = np.concatenate([np.zeros(0, np.int64), *rows])
        train = np.repeat([float(not x) for x in held], lengths)
        counts = np.bincount(flat, train, n).astype(np.int64)
        pair = np.concatenate([np.zeros(0, np.int64), *(np.concatenate([r[-1:], r[:-1]]) * n + r for r in rows)])
        pairs, pair_counts = summed(pair, train)
        pair_keys = mix64(h[pairs // n] * PRIME + h[pairs % n]) >> U64(64 - bits) if n else np.zeros(0, np.uint64)
        for wide, own, keys in (False, counts, h), (True, pair_counts, pair_keys):
            order = np.argsort(keys)
            ordered = keys[order]
            for bucket, k, c in zip(*(reply.column(x).to_pylist() for x in ("bucket", "keys", "counts"))):
                if (bucket >= buckets) == wide:
                    k = unpack_sorted(k)
                    at = np.searchsorted(ordered, k)
                    own[order[at]] += unpack_counts(c)
        automaton = build(h, counts, n_train, once, 0, pairs, pair_counts, bigram)
        base = np.log10((counts + 1) / (n_train + v_train + 1))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array([int(np.count_nonzero(counts[r])) for r in rows], pa.int64()),
                "train_tokens": pa.array([n_train] * len(ids), pa.int64()),
                "base_score": pa.array([math.fsum(base[r]) for r in rows], pa.float64()),
                "score": pa.array([automaton.walk(r.tolist()) for r in rows], pa.float64()),
            }
        )

    return dealt.groupBy("chunk").cogroup(reply.groupBy("chunk")).applyInArrow(run, SCORES_SCHEMA)
