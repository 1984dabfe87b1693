"""Operator 8: exact deduplication by a tree merge of sorted digest runs.

Every task digests its texts (SHA-256 of the text after lower-casing A-Z),
cuts the digests by their leading bits into slices and writes each slice as a
run: records sorted by digest, one for each distinct text, with the retained
row and the number of rows.  Runs then meet in binomial rounds: in a round,
the runs of 2**fan_bits neighbouring partitions are exchanged and merged in a
tournament of two-way merges, which never sort again; where two runs hold the
same text, its record with the retained identifier stays, at every level.
Verification compares byte length and a second, independent 64-bit hash
besides the digest.  After the last round each slice has one run; its entries
are joined to the documents on the digest.

A text that makes up a third of all rows is one record a run, so no task sees
its copies; in the last join Spark splits such a digest (adaptive skew join).
The number of slices follows the number of rows, so a run stays small.

Edge cases: null texts are empty texts and equal to them; a null doc_id is
retained only where a group has no other; rows that repeat a doc_id count as
members of their group.  :func:`exact_groups` marks every row of a group that
carries the retained doc_id as kept; :func:`drop_exact_copies` goes by rows
and keeps exactly one of each group, whatever repeats its doc_id.  An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_A_FILE, numbered, power_of_two_at_least, release_memory, rows_of, text_bytes

KEY = 32 + 8 + 8  # digest, size and check, compared as bytes
RECORD = np.dtype([("key", f"S{KEY}"), ("id", "<i8"), ("has_id", "<i1"), ("row", "<i8"), ("rows", "<i8")])
RECORDS_A_RUN = 500_000


def _better(a: np.ndarray, b: np.ndarray, largest: bool) -> np.ndarray:
    """Where the row of ``b`` is retained rather than that of ``a``: by identifier, then by the place of the row."""
    nearer = b["id"] > a["id"] if largest else b["id"] < a["id"]
    same = (a["has_id"] == b["has_id"]) & (a["id"] == b["id"])
    return (b["has_id"] > a["has_id"]) | ((a["has_id"] == b["has_id"]) & nearer) | (same & (b["row"] < a["row"]))


def merge_two(a: np.ndarray, b: np.ndarray, largest: bool) -> np.ndarray:
    """Merge two sorted runs of distinct texts into one; of a text that both hold one record stays, with all rows."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return a
    at = np.searchsorted(a["key"], b["key"])
    both = a["key"][np.minimum(at, len(a) - 1)] == b["key"]
    if both.any():
        a = a.copy()
        held, come = a[at[both]], b[both]
        rows = held["rows"] + come["rows"]
        taken = _better(held, come, largest)
        held[taken] = come[taken]
        held["rows"] = rows
        a[at[both]] = held
    # Each run's records go, in their order, to the places that the other leaves.
    new = b[~both]
    places = at[~both] + np.arange(len(new))
    out = np.empty(len(a) + len(new), RECORD)
    old = np.ones(len(out), bool)
    old[places] = False
    out[places], out[old] = new, a
    return out


def merge_runs(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """Merge sorted runs multiway: in each round of the tournament neighbours merge."""
    while len(runs) > 1:
        runs = [merge_two(*runs[i : i + 2], largest) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0] if runs else np.zeros(0, RECORD)


def sorted_run(records: np.ndarray, largest: bool) -> np.ndarray:
    """The run of unordered records: sorted, one record for each text."""
    ids = records["id"] if not largest else -1 - records["id"]
    rows = records[np.lexsort((records["row"], ids, 1 - records["has_id"], records["key"]))]
    if not len(rows):
        return rows
    first = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
    out = rows[first].copy()
    out["rows"] = np.add.reduceat(rows["rows"], first)
    return out


def digest_rows(docs: DataFrame, row: str) -> DataFrame:
    """``doc_id, row, digest, size, check`` of every row; ``row`` names the column that numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, sizes, checks = [], [], [], []
            for doc_id, text in rows_of([batch], ("doc_id", "text")):
                normal = text_bytes(text).lower()
                ids.append(doc_id)
                digests.append(hashlib.sha256(normal).digest())
                sizes.append(len(normal))
                checks.append(xxhash.xxh3_64_intdigest(normal))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(row), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(checks, pa.uint64()).view(pa.int64())], names=["doc_id", "row", "digest", "size", "check"])
        release_memory()

    return docs.select("doc_id", "text", row).mapInArrow(run, "doc_id long, row long, digest binary, size long, check long")


def _to_records(batch) -> np.ndarray:
    out = np.zeros(batch.num_rows, RECORD)
    numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(">i8").tobytes() for c in ("size", "check")]
    size, check = ([x[i : i + 8] for i in range(0, len(x), 8)] for x in numbers)
    out["key"] = [d + n + c for d, n, c in zip(batch.column("digest").to_pylist(), size, check)]
    ids = batch.column("doc_id")
    out["has_id"] = ids.is_valid().to_numpy(zero_copy_only=False)
    out["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out["row"] = batch.column("row").to_numpy(zero_copy_only=False)
    out["rows"] = 1
    return out


def _key_parts(run: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = np.ascontiguousarray(run["key"]).tobytes()
    numbers = np.frombuffer(raw, np.uint8).reshape(-1, KEY)[:, 32:].copy().view(">i8").astype(np.int64).reshape(-1, 2)
    return [raw[i : i + 32] for i in range(0, len(raw), KEY)], numbers[:, 0], numbers[:, 1]


def merged_texts(digests: DataFrame, slices: int, largest: bool = True, fan_bits: int = 4, levels: int = 12) -> DataFrame:
    """One row for each distinct text: ``digest, size, check, keep_id, keep_row, group_size``.

    ``levels`` is the number of binomial levels (2**levels partitions can be
    told apart; further ones share a slot), ``fan_bits`` how many of them a
    round takes.
    """

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() % (1 << levels)
        held, n = [], 0

        def emit():
            run = sorted_run(np.concatenate(held), largest)
            at = np.ascontiguousarray(run["key"]).view(np.uint8).reshape(-1, KEY)[:, :4].copy().view(">u4").astype(np.int64).ravel() * slices >> 32
            cuts = np.flatnonzero(np.diff(at)) + 1
            parts = np.split(run, cuts)
            parts = [p for p in parts if len(p)]
            keys = [int(at[i]) for i in ([0, *cuts] if len(at) else [])]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([slot] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "slot", "run"])

        for batch in batches:
            if batch.num_rows:
                held.append(_to_records(batch))
                n += batch.num_rows
            if n >= RECORDS_A_RUN:
                yield emit()
                held, n = [], 0
        if n:
            yield emit()
        held.clear()
        release_memory()

    def merge(table: pa.Table) -> pa.Table:
        runs = [np.frombuffer(b, RECORD) for b in table.column("run").to_pylist()]
        merged = merge_runs(runs, largest)
        return pa.table({"slice": table.column("slice").slice(0, 1), "slot": table.column("slot").slice(0, 1), "run": pa.array([merged.tobytes()], pa.binary())})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("run").to_pylist():
                run = np.frombuffer(blob, RECORD)
                digests, sizes, checks = _key_parts(run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(sizes), pa.array(checks), pa.array(run["id"].copy(), pa.int64(), mask=run["has_id"] == 0), pa.array(run["row"].copy()), pa.array(run["rows"].copy())],
                    names=["digest", "size", "check", "keep_id", "keep_row", "group_size"],
                )

    schema = "slice long, slot long, run binary"
    runs = digests.mapInArrow(leaf, schema)
    for _ in range(-(-levels // fan_bits)):
        runs = runs.withColumn("slot", F.shiftright("slot", fan_bits)).groupBy("slice", "slot").applyInArrow(merge, schema)
    return runs.mapInArrow(spread, "digest binary, size long, check long, keep_id long, keep_row long, group_size long")


def _slices(rows: int) -> int:
    return power_of_two_at_least(max(64, rows / RECORDS_A_RUN))


def exact_groups(docs: DataFrame, largest: bool = True, fan_bits: int = 4) -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    digests = digest_rows(*numbered(docs.select("doc_id", "text")))
    n = docs.count()
    texts = merged_texts(digests, _slices(n), largest, fan_bits)
    joined = digests.drop("row").alias("d").join(texts.alias("t"), ["digest", "size", "check"])
    out = joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    # Few rows make few files: an executor forks for each that it writes.
    return out.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_FILE)))


def drop_exact_copies(docs: DataFrame, largest: bool = True, fan_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` with their columns, one of each group of equal texts: that of the retained doc_id, the first of several such."""
    rows, row = numbered(docs)
    texts = merged_texts(digest_rows(rows, row), _slices(docs.count()), largest, fan_bits)
    return rows.join(texts.select(F.col("keep_row").alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
