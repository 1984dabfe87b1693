"""Operator 2: approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the Euclidean distance orders like the
cosine.  A table hashes a vector to ``M`` cells floor((a.v + b) / width) with
Gaussian (2-stable) directions a.  A query visits, in each table, its own
bucket and the ``PROBES`` buckets most likely to hold a near vector: sets of
cell perturbations in order of their estimated success (the sum of squared
distances to the cell borders that they cross), made with a heap of shifts and
expansions.  Candidates of all tables are merged and ranked by the cosine of
the original vectors in double precision.

Identical vectors are one class with its k + 1 smallest identifiers, on the
index side and the query side, so copies meet neither in a bucket nor in a
query.  Index rows and probes meet in groups of buckets of bounded size; a
bucket with more vectors than a group may hold is split, and its probes go to
all parts.  In a group only the best k + 1 classes of each query leave it.
Queries for which fewer than k neighbours are found are compared with all
rows, in blocks of queries.

Edge cases: vectors that are null, empty, zero, of another dimension than the
first usable one by vec_id, or that hold null or non-finite components take no part; a null
vec_id neither; rows that repeat a vec_id count as one for each vector; ties
go to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, materialise, mix64

TABLES, M, WIDTH, PROBES = 24, 16, 3.0, 100
GROUP_ROWS = 4096
BLOCK = 1024


def perturbations(distances: np.ndarray, most: int) -> list[list[int]]:
    """The ``most`` valid sets of border crossings with the least sum of squared distances, in that order.

    ``distances``: 2 * m distances; entries i and i + m cross the lower and
    the upper border of cell i, and a set may not hold both.
    """
    m = len(distances) // 2
    order = np.argsort(distances, kind="stable")
    cost = distances[order] ** 2
    out: list[list[int]] = []
    heap = [(float(cost[0]), (0,))]
    while heap and len(out) < most:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - float(cost[last]) + float(cost[last + 1]), (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + float(cost[last + 1]), (*chosen, last + 1)))
        cells = [int(order[i]) % m for i in chosen]
        if len(set(cells)) == len(cells):
            out.append([int(order[i]) for i in chosen])
    return out


class Hashing:
    """The hash functions of all tables for one dimension, the same on every executor."""

    def __init__(self, dimension: int, tables: int, m: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.tables, self.m, self.width = tables, m, width
        self.directions = rng.normal(size=(dimension, tables * m))
        self.shift = rng.uniform(0, width, tables * m)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and places within the cells (0 to width), as (rows, tables, m)."""
        at = unit @ self.directions + self.shift
        cell = np.floor(at / self.width)
        shape = (len(unit), self.tables, self.m)
        return cell.astype(np.int64).reshape(shape), (at - cell * self.width).reshape(shape)

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """64-bit codes of buckets from (..., tables, m) cells; the table is part of the code."""
        code = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64), cells.shape[:-1]).copy()
        for j in range(self.m):
            code = mix64(code * U64(0x9E3779B97F4A7C15) + cells[..., j].astype(np.uint64))
        return code.view(np.int64)

    def probes(self, unit: np.ndarray, most: int) -> np.ndarray:
        """Codes of the own bucket and ``most`` perturbed ones, (rows, tables * (most + 1))."""
        cells, place = self.cells(unit)
        out = np.repeat(cells[:, :, None, :], most + 1, axis=2)
        for i in range(len(unit)):
            for t in range(self.tables):
                near = np.concatenate([place[i, t], self.width - place[i, t]])
                for p, crossed in enumerate(perturbations(near, most), 1):
                    for x in crossed:
                        out[i, t, p, x % self.m] += -1 if x < self.m else 1
        return self.codes(out.transpose(0, 2, 1, 3)).reshape(len(unit), -1)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector`` of rows that take part; the vector as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector")):
                if i is None or not v.is_valid or not len(v) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    blobs.append((x + 0.0).tobytes())  # + 0.0: one zero
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["vec_id", "vector"])

    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector")).mapInArrow(run, "vec_id long, vector binary")


def classes_of(rows: DataFrame, least: int) -> DataFrame:
    """``vector, ids``: distinct vectors with their ``least`` smallest identifiers; at most one row a task and vector is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, set] = defaultdict(set)
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist()):
                held[v].add(i)
                if len(held[v]) > 4 * least:
                    held[v] = set(sorted(held[v])[:least])
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(x)[:least] for x in held.values()], pa.list_(pa.int64()))], names=["vector", "ids"])

    parts = rows.mapInArrow(run, "vector binary, ids array<long>")
    return parts.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, least).alias("ids"))


def unit_rows(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, their lengths and the vectors scaled to length 1, safe against overflow."""
    x = np.frombuffer(b"".join(blobs)).reshape(len(blobs), -1)
    top = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / top
    return x, np.linalg.norm(scaled, axis=1), scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def best(scores: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k best (score, id), ties to the smaller id, of classes with their identifiers."""
    take = np.argpartition(-scores, k - 1)[:k] if len(scores) > k else np.arange(len(scores))
    if len(scores) > k:
        take = np.flatnonzero(scores >= scores[take].min())
    flat = sorted(((-float(scores[i]), v) for i in take for v in ids[i]))[:k]
    return [(-s, v) for s, v in flat]


def cosines(unit: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Summed row by row, so that a pair has the same score wherever it is computed."""
    return (unit * query).sum(axis=1)


RESULT = "query binary, ids array<long>, scores array<double>"


def _results(rows) -> pa.Table:
    return pa.table({"query": pa.array([q for q, _ in rows], pa.binary()), "ids": pa.array([[v for _, v in b] for _, b in rows], pa.list_(pa.int64())), "scores": pa.array([[s for s, _ in b] for _, b in rows], pa.list_(pa.float64()))})


def meet(base: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best of each query among the vectors of its cells in a group; a vector that several tables put there counts once."""
    if not base.num_rows or not asked.num_rows:
        return _results([])
    ids = base.column("ids").to_pylist()
    vectors = base.column("vector").to_pylist()
    unit = unit_rows(vectors)[2]
    numbers: dict[bytes, int] = {}
    same = np.array([numbers.setdefault(v, len(numbers)) for v in vectors])
    key = np.rec.fromarrays([base.column("code").to_numpy(), base.column("part").to_numpy()])
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    wanted = np.rec.fromarrays([asked.column("code").to_numpy(), asked.column("part").to_numpy()])
    low, high = np.searchsorted(sorted_key, wanted), np.searchsorted(sorted_key, wanted, side="right")
    places = defaultdict(list)
    for q, a, b in zip(asked.column("query").to_pylist(), low, high):
        if b > a:
            places[q].append(order[a:b])
    rows = []
    for q, found in places.items():
        found = np.concatenate(found)
        found = found[np.unique(same[found], return_index=True)[1]]
        rows.append((q, best(cosines(unit[found], unit_rows([q])[2]), [ids[i] for i in found], k)))
    return _results(rows)


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, every: int = 50, tables: int = TABLES, m: int = M, width: float = WIDTH, probes: int = PROBES, seed: int = 1) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose id is divisible by ``every``."""
    rows = materialise(usable(vectors, id_column, vector_column), "usable")
    first = rows.agg(F.min(F.struct("vec_id", F.octet_length("vector").alias("n")))["n"]).first()[0]
    dimension = (first or 8) // 8
    rows = rows.filter(F.octet_length("vector") == 8 * dimension)
    classes = materialise(classes_of(rows, k + 1), "classes")
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "vector").distinct()
    asked = materialise(queries.select("vector").distinct(), "queries")

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(dimension, tables, m, width, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit = unit_rows(part.column("vector").to_pylist())[2]
                yield pa.RecordBatch.from_arrays([part.column("vector"), part.column("ids"), pa.array(hashing.codes(hashing.cells(unit)[0]).tolist(), pa.list_(pa.int64()))], names=["vector", "ids", "codes"])

    def probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(dimension, tables, m, width, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("vector"), pa.array(hashing.probes(unit_rows(part.column("vector").to_pylist())[2], probes).tolist(), pa.list_(pa.int64()))], names=["query", "codes"])

    index = classes.mapInArrow(index_rows, "vector binary, ids array<long>, codes array<long>").select("vector", "ids", F.explode("codes").alias("code"))
    probed = asked.repartition(spark_partitions(asked), "vector").mapInArrow(probe_rows, "query binary, codes array<long>").select("query", F.explode("codes").alias("code"))
    n_groups = max(64, -(-classes.count() * tables // GROUP_ROWS))
    large = index.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_ROWS).select("code", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("parts"))
    large = materialise(large, "large")  # few: at most rows * tables / GROUP_ROWS
    index = index.join(large, "code", "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int"))).drop("parts")
    probed = probed.join(large, "code", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    group = F.pmod(F.xxhash64("code", "part"), F.lit(n_groups)).alias("g")
    index, probed = index.select("*", group), probed.select("*", group)

    found = probed.groupBy("g").cogroup(index.groupBy("g")).applyInArrow(lambda p, i: meet(i, p, k + 1), RESULT)
    found = materialise(merged(found, k + 1), "found")
    short = asked.withColumnRenamed("vector", "query").join(found.filter(F.size("ids") > k), "query", "left_anti")
    rest = _exact(classes, short, k + 1)
    if rest is not None:
        found = found.join(rest.select("query"), "query", "left_anti").unionByName(rest)
    pairs = queries.join(found.withColumnRenamed("query", "vector"), "vector").select(F.col("vec_id").alias("query_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("_i", "_p"))
    pairs = pairs.select("query_id", F.col("_p.ids").alias("vec_id"), F.col("_p.scores").alias("score")).filter("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def spark_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def merged(results: DataFrame, k: int) -> DataFrame:
    """One row a query: its k best over all groups; a query has at most k entries from each group that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = [], []
            for lists in batch.column("parts").to_pylist():
                of = {v: s for part in lists for v, s in zip(part["ids"], part["scores"])}
                flat = sorted((-s, v) for v, s in of.items())[:k]
                ids.append([v for _, v in flat])
                scores.append([-s for s, _ in flat])
            yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["query", "ids", "scores"])

    return results.groupBy("query").agg(F.collect_list(F.struct("ids", "scores")).alias("parts")).mapInArrow(run, RESULT)


def _exact(classes: DataFrame, short: DataFrame, k: int) -> DataFrame | None:
    """All-rows search for the queries ``short``, in blocks of BLOCK; None if there are none."""
    out, block = None, []

    def search(blobs: list[bytes]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = unit_rows(blobs)[2]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, unit = batch.column("ids").to_pylist(), unit_rows(batch.column("vector").to_pylist())[2]
                for q, one in zip(blobs, wanted):
                    yield _results([(q, best(cosines(unit, one[None]), ids, k))]).to_batches()[0]

        return merged(classes.mapInArrow(run, RESULT), k)

    for row in short.toLocalIterator():
        block.append(bytes(row["query"]))
        if len(block) == BLOCK:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    return None if out is None else materialise(out, "exact")
