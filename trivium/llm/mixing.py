"""Operator 10: mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  A flow network carries token capacity from patterns to sources: a
pattern offers its size once for each allowed repetition, at convex cost (the
first use is free, the next costs 1, the one after that 2), and a source
takes its target.  The cheapest full flow says how many tokens each pattern
gives; the network has one node a pattern and source, not a document.
Patterns whose sources are not connected are solved apart.

A pattern that gives q times its size plus a remainder takes every document
q times and, once more, a seeded choice of documents that adds up to the
remainder.  The choice is a prefix in the order of a seeded hash, cut by
histograms of hash digits (two levels of 1024 bins) and by a window over the
documents of the one bin that holds the cut, so no task sorts a source.

Edge cases: null texts have size 0; a null source is a source of its own, the
last one; sources without words have target 0; repeated rows are chosen one by
one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, rows_of, small_batches, text_bytes

WEIGHTS = (5, 2, 1)
MAX_PATTERNS = 200_000  # patterns and sources are metadata; beyond this the call fails rather than flooding the driver


def word_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``size``, the number of words of each text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.array([len(text_bytes(t).split()) for (t,) in rows_of([batch], ("text",))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), size], names=[*keep, "size"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def targets(sizes: dict, weights=WEIGHTS, most: float = 3.0) -> dict:
    """Target of each source: shares by weight, none above ``most`` times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    out: dict = {}
    free = list(order)
    while free:
        left = total - sum(out.values())
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in free}
        for s in over:
            out[s] = most * sizes[s]
        free = [s for s in free if s not in out]
    return out


def cheapest_flow(arcs: list[tuple], source, sink) -> dict:
    """Minimum-cost maximum flow by successive shortest paths; arcs are (from, to, capacity, cost)."""
    graph = defaultdict(list)
    edges: list[list] = []
    for u, v, capacity, cost in arcs:
        graph[u].append(len(edges))
        edges.append([v, capacity, cost])
        graph[v].append(len(edges))
        edges.append([u, 0, -cost])
    potential: dict = defaultdict(int)
    while True:
        distance, into, heap, tie = {source: 0}, {}, [(0, 0, source)], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            for e in graph[u]:
                v, capacity, cost = edges[e]
                if capacity > 0:
                    reach = d + cost + potential[u] - potential[v]
                    if reach < distance.get(v, float("inf")):
                        distance[v], into[v] = reach, e
                        tie += 1
                        heapq.heappush(heap, (reach, tie, v))
        if sink not in distance:
            break
        for v, d in distance.items():
            potential[v] += d
        path, v = [], sink
        while v != source:
            path.append(into[v])
            v = edges[into[v] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    return {i: edges[2 * i + 1][1] for i in range(len(arcs))}


def route(patterns: dict[tuple, int], quota: dict, repeats: int) -> dict[tuple, int]:
    """Tokens that each pattern gives so that the sources get their quotas at the least cost of repetition."""
    parent: dict = {}

    def root(s):
        while parent.setdefault(s, s) != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for members in patterns:
        for s in members[1:]:
            parent[root(s)] = root(members[0])
    parts = defaultdict(list)
    for members in patterns:
        parts[root(members[0])].append(members)
    given: dict[tuple, int] = {}
    for group in parts.values():
        arcs, first = [], {}
        for p in group:
            first[p] = len(arcs)
            arcs += [("from", ("pattern", p), patterns[p], cost) for cost in range(repeats)]
            arcs += [(("pattern", p), ("source", s), repeats * patterns[p], 0) for s in p]
        arcs += [(("source", s), "to", round(quota[s]), 0) for s in {s for p in group for s in p}]
        flow = cheapest_flow(arcs, "from", "to")
        given |= {p: sum(flow[first[p] + i] for i in range(repeats)) for p in group}
    return given


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = 3, seed: int = 11, members: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, copies, taken`` and the columns ``keep``.

    ``members`` names an array column of sources for documents that belong to
    several; by default a document belongs to its ``source``.  For overlapping
    sources, source_size and target are those of the first source of the pattern.
    """
    small_batches(docs.sparkSession)
    belongs = F.array(F.col("source")) if members is None else F.array_sort(F.array_distinct(members))
    rows = docs.withColumn("_members", belongs).withColumn("_hash", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source")))
    sized = materialise(word_counts(rows, ["doc_id", "_members", "_hash", *keep]), "sizes")
    found = sized.groupBy("_members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["_members"]): int(r["size"] or 0) for r in found if r["_members"]}
    size_of: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            size_of[s] += n
    quota = targets(dict(size_of), weights, repeats)
    given = route(patterns, quota, repeats)
    plan = [(list(p), size_of[p[0]], float(quota[p[0]]), given[p] // n if n else 0, given[p] % n if n else 0) for p, n in patterns.items()]
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "_members array<string>, source_size long, target double, q long, need long")

    # _members holds nulls, which equal nothing: join on a text form in which they do.
    key = F.to_json(F.struct("_members"))
    sized = sized.withColumn("_key", F.xxhash64("_members", F.size("_members"), key))
    plan = plan.withColumn("_key", F.xxhash64("_members", F.size("_members"), key)).drop("_members")
    digit = lambda level: F.shiftrightunsigned(F.col("_hash"), 64 - 10 * level).bitwiseAND(1023)
    sized = sized.withColumn("_d1", digit(1)).withColumn("_d2", digit(2))

    def cut(rows: DataFrame, needs: DataFrame, bin_: str) -> DataFrame:
        """For each pattern the bin that holds the cut, and what is needed of it."""
        upto = Window.partitionBy("_key").orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)
        bins = rows.groupBy("_key", bin_).agg(F.sum("size").alias("n")).withColumn("sum", F.sum("n").over(upto))
        held = bins.join(needs, "_key").filter("sum > need").groupBy("_key").agg(F.min(F.struct(bin_, "sum", "n", "need")).alias("c"))
        return held.select("_key", F.col("c")[bin_].alias(f"_cut{bin_}"), (F.col("c.need") - (F.col("c.sum") - F.col("c.n"))).alias("need"))

    first = cut(sized, plan.select("_key", "need"), "_d1")
    inside = sized.join(first, "_key").filter("_d1 = _cut_d1")
    second = cut(inside.drop("need"), first.select("_key", "need"), "_d2")
    marks = first.select("_key", "_cut_d1").join(second.select("_key", "_cut_d2", F.col("need").alias("_need")), "_key", "left")
    small = F.broadcast if keep else lambda rows: rows  # a row a pattern: rather sent than the texts shuffled
    marked = sized.join(small(plan.drop("need")), "_key", "left").join(small(marks), "_key", "left")
    at_cut = (F.col("_d1") == F.col("_cut_d1")) & (F.col("_d2") == F.col("_cut_d2"))
    whole = (F.col("_d1") < F.col("_cut_d1")) | ((F.col("_d1") == F.col("_cut_d1")) & (F.col("_d2") < F.col("_cut_d2")))
    # Rows that share doc_id and source share the hash: what is kept of them tells them apart, so that reruns agree.
    last = Window.partitionBy("_key").orderBy("_hash", "doc_id", "size", *([F.xxhash64(*keep)] if keep else [])).rowsBetween(Window.unboundedPreceding, 0)
    edge = marked.filter(at_cut).withColumn("_more", (F.sum("size").over(last) - F.col("size") / 2 <= F.col("_need")))
    rest = marked.filter(~F.coalesce(at_cut, F.lit(False))).withColumn("_more", F.coalesce(whole, F.lit(False)))
    chosen = rest.unionByName(edge).withColumn("copies", F.coalesce("q", F.lit(0)) + F.col("_more").cast("long"))
    return chosen.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def apply_mix(docs: DataFrame, weights=WEIGHTS, repeats: int = 3, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` with their columns, each as often as the mix takes it; rows are decided one by one, whatever their doc_id."""
    row = docs.select("doc_id", "source", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))
    taken = mix(row, weights, repeats, seed, keep=("text", "_row")).filter("copies > 0")
    copied = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
