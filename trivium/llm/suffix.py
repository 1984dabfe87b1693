"""Operator 6: removal of byte passages that repeat across documents, by suffix sorting in shards.

A byte is removed if a 50-byte string that covers it also starts in a document
with a smaller identifier.  Only strings that can repeat are sorted:

1. Every window of ``length`` bytes has an anchor, the least hash among its
   ``gram``-byte substrings.  Equal windows have equal anchors, so a window
   whose anchor lies in one document alone repeats nowhere.  Tasks send
   distinct anchors; buckets of the hash space answer which are shared.
2. Runs of windows with the same shared anchor are cut out as contexts and
   dealt to shards by anchor; all equal windows meet in one shard.  Of equal
   contexts of a chunk only those of the smallest document are sent, the
   others are covered at once.
3. A shard concatenates its distinct contexts, sorts the suffixes by external
   induced sorting (:mod:`suffix_sort`) and reads off the groups of suffixes
   with a common prefix of ``length`` bytes.  Windows of a group whose smallest
   document is smaller than their own are covered.
4. Covered windows go back to their documents, where they are merged to spans.

Hashes only choose what is compared; equality is decided by suffix order and
common prefixes.  All of it is one plan in which the texts are shuffled once.

Edge cases: null texts are empty; texts shorter than ``length`` lose nothing;
rows with a null doc_id neither remove nor lose anything; rows that repeat a
doc_id are not smaller than one another; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, pack_sorted, release_memory, rows_of, text_bytes, total_text_bytes, unpack_sorted
from .suffix_sort import common_prefixes, suffix_array

LENGTH = 50
GRAM = 24
# A chunk sends each bucket and each shard a row: these are so large that a row holds hundreds of anchors or contexts at tens of GB.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
SHARD_BYTES = 6 << 20
RUN = 128  # windows of a context at most
FLUSH_ANCHORS = 2_000_000
BASE = 0xD6E8FEB86659FD93
SPREAD = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all ``gram``-byte substrings, by doubling the width of polynomial hashes."""
    power, width = SPREAD[data], 1
    out, done = None, 0
    rest = gram
    while rest:
        if rest & 1:
            if out is None:
                out, done = power, width
            else:
                n = len(data) - done - width + 1
                out = out[:n] * U64(pow(BASE, width, 1 << 64)) + power[done : done + n]
                done += width
        rest >>= 1
        if rest:
            n = len(power) - width
            power = power[:n] * U64(pow(BASE, width, 1 << 64)) + power[width : width + n]
            width *= 2
    return mix64(out) >> U64(8)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling; the last step joins two overlapping halves."""
    n, done = len(values) - width + 1, 1
    while 2 * done <= width:
        values = np.minimum(values[: len(values) - done], values[done:])
        done *= 2
    return np.minimum(values[:n], values[width - done : width - done + n])


def anchor_runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and end of each run of windows with one anchor."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = window_minima(gram_hashes(np.frombuffer(data, np.uint8), gram), length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    end = np.append(first[1:], len(low))
    if (end - first > RUN).any():
        cuts = np.concatenate([np.arange(a, b, RUN) for a, b in zip(first, end)])
        first, end = cuts, np.append(cuts[1:], len(low))
    return low[first], first, end


def bucket_starts(n: int, grams: int) -> np.ndarray:
    """Least anchors of all buckets but the first, so that each gets as many anchors.

    Anchors are minima over ``grams`` hashes, so small ones are frequent.  A hash at the share u of the hash space, with q = 1 - u, is one
    if at least grams - 1 hashes around it are larger: the chance is q ** (grams - 1) * (1 + (grams - 1) * u), whose integral is inverted here.
    """
    u = np.linspace(0, 1, (1 << 16) + 1)
    below = 1 - (1 - u) ** grams - (grams - 1) / (grams + 1) * (1 - (1 - u) ** (grams + 1))
    return (np.interp(np.arange(1, n) / n, below / below[-1], u) * 2.0**56).astype(np.uint64)


def _bucket(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, keys, side="right")


def sent_anchors(dealt: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Distinct anchors of each chunk, by bucket; ``several`` marks those in more than one document of it.

    The texts have to be dealt by chunk: a chunk that is spread over tasks sends each bucket a row from each of them.
    """
    schema = "bucket long, chunk long, keys binary, several binary"
    starts = bucket_starts(buckets, length - gram + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        n = 0

        def flush():
            rows = []
            for chunk, parts in held.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                bucket = _bucket(keys, starts)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for k, s, b in zip(np.split(keys, cuts), np.split(counts > 1, cuts), bucket[np.concatenate([[0], cuts])]):
                    rows.append((int(b), chunk, pack_sorted(k), np.packbits(s).tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "keys", "several"])

        for doc_id, text, chunk in rows_of(batches, ("doc_id", "text", "chunk")):
            if doc_id is None:
                continue
            anchors = np.unique(anchor_runs(text_bytes(text), length, gram)[0])
            if len(anchors):
                held[chunk].append(anchors)
                n += len(anchors)
            if n >= FLUSH_ANCHORS:
                yield flush()
                n = 0
        if held:
            yield flush()
        release_memory()

    return dealt.mapInArrow(run, schema)


def shared_anchors(sent: DataFrame) -> DataFrame:
    """For each chunk those of its anchors that lie in several documents."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)) for s, k in zip(table.column("several").to_pylist(), keys)])
        known, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = (counts > 1) | (np.bincount(inverse, several, len(known)) > 0)
        chunks = table.column("chunk").to_pylist()
        out = [pack_sorted(k[s]) for k, s in zip(keys, np.split(shared[inverse], np.cumsum([len(k) for k in keys])[:-1]))]
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "keys": pa.array(out, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "chunk long, keys binary")


CONTEXTS = "shard long, chunk long, anchors binary, docs binary, rows binary, firsts binary, lengths binary, data binary"


def contexts(placed: DataFrame, shared: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """Contexts of shared anchors, packed by chunk and shard; shard -1 holds windows that the chunk itself covers."""
    starts = bucket_starts(shards, length - gram + 1)

    def run(texts: pa.Table, reply: pa.Table) -> pa.Table:
        names = ("shard", "chunk", "anchors", "docs", "rows", "firsts", "lengths", "data")
        types = (pa.int64(), pa.int64(), *[pa.binary()] * 6)
        keys = [unpack_sorted(x) for x in reply.column("keys").to_pylist()]
        if not texts.num_rows or not keys:
            return pa.table([pa.array([], t) for t in types], names=names)
        chunk = texts.column("chunk")[0].as_py()
        keys = np.unique(np.concatenate(keys))
        best: dict[bytes, int] = {}
        held = []  # of each text its document, row, bytes and the anchor, first window, end and digest of its contexts
        for doc, text in rows_of([texts], ("doc_id", "text")):
            if doc is None or not len(keys):
                continue
            data = text_bytes(text)
            anchors, first, end = anchor_runs(data, length, gram)
            at = np.minimum(np.searchsorted(keys, anchors), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == anchors)
            if not len(hit):
                continue
            anchors, first, end = anchors[hit], first[hit], end[hit]
            digests = [xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(first.tolist(), (end + length - 1).tolist())]
            for digest in digests:
                if best.setdefault(digest, doc) > doc:
                    best[digest] = doc
            held.append((doc, xxhash.xxh3_64_intdigest(data), data, anchors, first, end, digests))
        if not held:
            return pa.table([pa.array([], t) for t in types], names=names)
        least = np.fromiter((best[digest] for x in held for digest in x[6]), np.int64)
        del best
        counts = [len(x[3]) for x in held]
        of = np.repeat(np.arange(len(held)), counts)
        docs, rows = (np.repeat(np.array([x[i] for x in held], t), counts) for i, t in ((0, np.int64), (1, np.uint64)))
        anchors, first, end = (np.concatenate([x[i] for x in held]) for i in (3, 4, 5))
        data = [x[2] for x in held]
        del held
        shard = np.where(least == docs, _bucket(anchors, starts), -1)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        out = []
        for at in np.split(order, cuts):
            to = int(shard[at[0]])
            ranges = zip(of[at].tolist(), first[at].tolist(), (end[at] + length - 1).tolist())
            pieces = b"" if to < 0 else zstandard.compress(b"".join([data[t][i:j] for t, i, j in ranges]), 3)
            columns = (anchors[at], docs[at], rows[at], first[at].astype(np.int64), (end[at] - first[at]).astype(np.int32))
            out.append((to, chunk, *(c.tobytes() for c in columns), pieces))
        release_memory()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return placed.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(run, CONTEXTS)


def smallest_documents(pieces: list[bytes], docs: np.ndarray, length: int, budget: int = 64 << 20) -> list[np.ndarray]:
    """For each window of each piece the smallest document among the pieces that hold the same window."""
    sizes = np.array([len(p) for p in pieces])
    joined = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8).astype(np.int16) + 2
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    joined[ends] = 1
    text = np.append(joined, np.int16(0))
    order = suffix_array(text, budget)
    owner = np.zeros(len(text), np.int64)
    owner[:-1] = np.repeat(np.arange(len(pieces)), sizes + 1)
    # What stands between equal windows in suffix order begins with the same window, so that the others can go first.
    order = order[order + length <= np.append(ends, 0)[owner[order]]]
    group = np.cumsum(common_prefixes(text, order, length) < length)
    owners = docs[owner[order]]
    out = np.zeros(len(text), np.int64)
    if len(order):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[order] = np.repeat(np.minimum.reduceat(owners, first), np.diff(np.append(first, len(order))))
    return [out[s : s + n - length + 1] for s, n in zip(starts, sizes)]


def covered_windows(sent: DataFrame, length: int) -> DataFrame:
    """``chunk, rows, docs, firsts, ends``: windows whose string starts in a smaller document."""
    schema = "chunk long, docs binary, rows binary, firsts binary, ends binary"

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        take = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        anchors, docs, rows, firsts, lengths = take("anchors", np.uint64), take("docs", np.int64), take("rows", np.uint64), take("firsts", np.int64), take("lengths", np.int32)
        part = np.repeat(np.arange(len(chunks)), [len(x) for x in anchors])
        a, d, r, f, n = (np.concatenate(x) for x in (anchors, docs, rows, firsts, lengths))
        if table.column("shard")[0].as_py() < 0:
            hits = (part, d, r, f, f + n)
        else:
            number: dict[bytes, int] = {}
            piece = np.zeros(len(a), np.int64)
            at = 0
            for data, sizes in zip(table.column("data").to_pylist(), lengths):
                data, place = zstandard.decompress(data), 0
                for size in sizes.tolist():
                    size += length - 1
                    piece[at] = number.setdefault(data[place : place + size], len(number))
                    place += size
                    at += 1
            pieces = list(number)
            low = np.full(len(pieces), np.iinfo(np.int64).max)
            np.minimum.at(low, piece, d)
            anchor = np.zeros(len(pieces), np.uint64)
            anchor[piece] = a
            by_anchor = np.unique(anchor, return_inverse=True, return_counts=True)
            sort = np.flatnonzero(by_anchor[2][by_anchor[1]] > 1)  # other pieces hold windows that no other piece holds
            least_of, most_of, windows = low.copy(), low.copy(), {}
            if len(sort):
                found = smallest_documents([pieces[i] for i in sort], low[sort], length)
                windows = dict(zip(sort.tolist(), found))
                first = np.concatenate([[0], np.cumsum([len(x) for x in found])[:-1]])
                found = np.concatenate(found)
                least_of[sort], most_of[sort] = np.minimum.reduceat(found, first), np.maximum.reduceat(found, first)
            whole = np.flatnonzero(most_of[piece] < d)
            out = []
            for i in np.flatnonzero((least_of[piece] < d) & (most_of[piece] >= d)).tolist():
                hit = np.concatenate([[0], (windows[int(piece[i])] < d[i]).view(np.int8), [0]])
                step = np.flatnonzero(np.diff(hit))
                for x, y in zip(step[::2].tolist(), step[1::2].tolist()):
                    out.append((i, x, y))
            i, x, y = (np.array([z[j] for z in out], np.int64) for j in range(3))
            at = np.concatenate([whole, i])
            hits = (part[at], d[at], r[at], f[at] + np.concatenate([np.zeros(len(whole), np.int64), x]), f[at] + np.concatenate([n[whole], y]))
        result = defaultdict(list)
        release_memory()
        order = np.argsort(hits[0], kind="stable")
        hits = [h[order] for h in hits]
        cuts = np.flatnonzero(np.diff(hits[0])) + 1
        for p, hd, hr, hf, he in zip(*(np.split(h, cuts) for h in hits)):
            if len(p):
                result["chunk"].append(chunks[int(p[0])])
                for name, x in ("docs", hd), ("rows", hr), ("firsts", hf), ("ends", he):
                    result[name].append(np.ascontiguousarray(x).tobytes())
        return pa.table({"chunk": pa.array(result["chunk"], pa.int64()), **{name: pa.array(result[name], pa.binary()) for name in ("docs", "rows", "firsts", "ends")}})

    return sent.groupBy("shard", F.when(F.col("shard") < 0, F.col("chunk")).alias("_own")).applyInArrow(run, schema)


def spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the given half-open ranges."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return list(zip(starts[first].tolist(), ends[np.append(first[1:], len(starts)) - 1].tolist()))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` (the spans) and, if asked for, ``kept_text``.

    Spans are byte ranges and may cut a character; ``kept_text`` replaces what is left of one.
    """
    size = total_text_bytes(docs)
    chunks, buckets, shards = (max(24, -(-size // n)) for n in (CHUNK_BYTES, BUCKET_BYTES, SHARD_BYTES))
    placed = docs.select("doc_id", "text").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    dealt = placed.repartition(chunks, "chunk")
    shared = shared_anchors(sent_anchors(dealt, buckets, length, gram))
    covered = covered_windows(contexts(dealt, shared, shards, length, gram), length)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>" + ", kept_text string" * with_text

    def run(texts: pa.Table, hits: pa.Table) -> pa.Table:
        take = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in hits.column(name).to_pylist())])
        d, r, f, e = take("docs", np.int64), take("rows", np.uint64), take("firsts", np.int64), take("ends", np.int64)
        order = np.lexsort((r, d))
        d, r, f, e = d[order], r[order], f[order], e[order]
        cuts = np.flatnonzero((d[1:] != d[:-1]) | (r[1:] != r[:-1])) + 1
        of = {(int(x[0]), int(y[0])): (z, w) for x, y, z, w in zip(*(np.split(v, cuts) for v in (d, r, f, e))) if len(x)}
        out = defaultdict(list)
        for doc, text in rows_of([texts], ("doc_id", "text")):
            data = text_bytes(text)
            found = of.get((doc, xxhash.xxh3_64_intdigest(data))) if doc is not None else None
            cut = spans(found[0], found[1] + length - 1) if found else []
            kept, at = [], 0
            for a, b in cut:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            for name, x in (("doc_id", doc), ("n_bytes", len(data)), ("n_removed", len(data) - len(kept)), ("n_spans", len(cut)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("removed", [{"start": a, "end": b} for a, b in cut])):
                out[name].append(x)
            if with_text:
                out["kept_text"].append(kept.decode("utf-8", "replace"))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "removed": span} | ({"kept_text": pa.string()} if with_text else {})
        return pa.table({name: pa.array(out[name], t) for name, t in types.items()})

    return dealt.groupBy("chunk").cogroup(covered.groupBy("chunk")).applyInArrow(run, schema)
