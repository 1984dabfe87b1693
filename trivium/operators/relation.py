"""Relations with certainty: DataFrames ``src, dst, truth`` (1 or 2); an absent pair is a no."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.functions.truth import UNKNOWN, YES, truth

PAIR = ("src", "dst")


def strongest(rows: DataFrame) -> DataFrame:
    """One row a pair, with its strongest truth; pairs that are a no are left out."""
    return rows.filter(F.col("truth") > 0).groupBy(*PAIR).agg(F.max("truth").alias("truth"))


def union(*relations: DataFrame) -> DataFrame:
    out = relations[0]
    for r in relations[1:]:
        out = out.unionByName(r)
    return strongest(out)


def image(relation: DataFrame, source: Column) -> DataFrame:
    return relation.filter(F.col("src") == source).select("dst", "truth")


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """Along a path the weakest truth, over paths the strongest."""
    l, r = left.alias("l"), met(right).alias("r")
    rows = l.join(r, F.col("l.dst") == F.col("r.src")).select(F.col("l.src").alias("src"), F.col("r.dst").alias("dst"), F.least("l.truth", "r.truth").alias("truth"))
    return strongest(rows)


#: Rounds after which the found pairs are written together.
COMPACT = 8


def met(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is shuffled to its partners.

    Sizes of what is checkpointed or made by ``explode`` are guessed from the
    files it comes from, far too low: such tables would go through the driver
    to every executor, in each round.
    """
    return rows.hint("merge")


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` after a checkpoint, without Spark's guess of their size.

    The guess goes through checkpoints and is multiplied at each join: where
    rounds join what the last one left with itself, its digits double each
    round, and some twenty rounds fill the driver's memory with one number.
    """
    rows, spark = rows.checkpoint(), rows.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows._jdf.queryExecution().toRdd(), rows._jdf.schema(), False), spark)


def _extend(frontier: DataFrame, step, keys: list[str], steps: int | None, known: bool = False) -> DataFrame:
    """Everything that ``step`` reaches from ``frontier`` in rounds, semi-naive: a round extends new rows only and writes them only.

    What a round reaches is told from what is known in one grouping of both.
    Lineage is cut by a reliable checkpoint each round; the parts found so far
    are put together every ``COMPACT`` rounds.  The loop ends when a round finds nothing new.
    With ``known``, ``step`` also gets all that is known so far, new rows included.
    """
    cut = kept if known else lambda rows: rows.checkpoint()
    frontier = cut(frontier.select(*keys).distinct())
    parts, done = [frontier], 0
    while steps is None or done < steps:
        every = reduce(DataFrame.unionByName, parts)
        rows = (step(frontier, every) if known else step(frontier)).select(*keys).withColumn("_known", F.lit(0)).unionByName(every.withColumn("_known", F.lit(1)))
        frontier = cut(rows.groupBy(*keys).agg(F.max("_known").alias("_known")).filter("_known = 0").select(*keys))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        done += 1
        if len(parts) > COMPACT:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def _pairs(edges: DataFrame, steps: int | None) -> DataFrame:
    """Pairs joined by a path of one to ``steps`` edges."""
    edges = edges.select(*PAIR).distinct().checkpoint()
    e = met(edges).alias("e")
    step = lambda rows: rows.alias("f").join(e, F.col("f.dst") == F.col("e.src")).select(F.col("f.src").alias("src"), F.col("e.dst").alias("dst"))
    return _extend(edges, step, list(PAIR), None if steps is None else steps - 1)


def reach_pairs(seeds: DataFrame, edges: DataFrame, steps: int | None = None) -> DataFrame:
    """``seed, node`` that the edges reach from the given ones, these included."""
    e = met(edges.select(*PAIR).distinct().checkpoint()).alias("e")
    step = lambda rows: rows.alias("f").join(e, F.col("f.node") == F.col("e.src")).select("seed", F.col("e.dst").alias("node"))
    return _extend(seeds, step, ["seed", "node"], steps)


def reaches(relation: DataFrame, steps: int | None = None) -> DataFrame:
    """Transitive closure (``steps`` None) or reach within ``steps``: yes if some path is all yes, else unknown."""
    if steps is not None and not 1 <= steps <= 1024:
        raise ValueError("steps must be between 1 and 1024")
    certain = _pairs(relation.filter(F.col("truth") == YES), steps).withColumn("truth", truth(YES))
    possible = _pairs(relation.filter(F.col("truth") > 0), steps).withColumn("truth", truth(UNKNOWN))
    return union(certain, possible)


def _pure_rings(chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes with one edge out (``node, to``): ``node, ring`` of the rings they make alone, and ``node, stop`` of the others, whose chain ends at another node.

    Each round doubles how far every node looks.  Where a round leaves as many
    different ends as the one before, these are the stops and the rings' nodes.
    """
    hops, ends = chain, None
    while True:
        after = hops.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        hops = kept(hops.join(met(after), "to", "left").select("node", F.coalesce("_next", "to").alias("to")))
        before, ends = ends, hops.select("to").distinct().count()
        if ends == before:
            break
    own = hops.select(F.col("to").alias("node")).distinct()
    colour = chain.join(met(own), "node", "left_semi").withColumn("ring", F.col("node")).checkpoint()
    while True:  # each looks twice as far round its ring, until none sees a greater node
        after = colour.select(F.col("node").alias("to"), F.col("to").alias("_next"), F.col("ring").alias("_come"))
        looked = kept(colour.join(met(after), "to").select("node", F.col("_next").alias("to"), F.greatest("ring", "_come").alias("ring"), (F.col("_come") > F.col("ring")).alias("_moved")))
        colour = looked.drop("_moved")
        if looked.filter("_moved").isEmpty():
            break
    ring = colour.select("node", "ring")
    stops = hops.join(met(ring.select(F.col("node").alias("to"))), "to", "left_anti").select("node", F.col("to").alias("stop"))
    return ring, stops.checkpoint()


def _along(seeds: DataFrame, chain: DataFrame) -> DataFrame:
    """The seeds (``node, ring``) and the nodes that follow them on chains (``node, to``), in rounds that double the distance."""
    found, hops, n = seeds.checkpoint(), chain, -1
    while True:
        ahead = found.join(met(hops), "node").select(F.col("to").alias("node"), "ring")
        found = kept(found.unionByName(ahead).distinct())
        before, n = n, found.count()
        if n == before:
            return found
        after = hops.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        hops = kept(hops.join(met(after), "to", "left").select("node", F.coalesce("_next", "to").alias("to")))


def on_cycles(edges: DataFrame) -> DataFrame:
    """``node, ring`` of nodes on a cycle; a ring is the strongly connected part, named by its greatest node.

    No pairs are built.  Nodes without an edge in and an edge out are trimmed.
    Nodes with one edge out make chains, which are followed by doubling; those
    that run into themselves are rings, the others stand for an edge to the
    node at their end.  Of the nodes with several edges out, each is coloured
    with the greatest one that reaches it; what walks back to a colour's own
    node within the colour is its ring.  Rings leave and the rest begins anew,
    until nothing is left.  A chain between two nodes of a ring is of it.

    Rounds are many jobs, so tasks settle first what they can: where there are
    more than ``ONE_TASK`` edges and nodes are numbers, each task takes a range
    of nodes and contracts the rings within it (``_shrunk``).  ``ONE_TASK``
    edges or fewer that are left, at any point, are finished in one task.
    """
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    several = _found(edges.select(*PAIR).filter("src <> dst").distinct().checkpoint())
    if several is None:
        return loops.withColumn("ring", F.col("node"))
    return several.unionByName(loops.join(met(several), "node", "left_anti").withColumn("ring", F.col("node")))


#: So many edges are searched in one task; ranges of nodes are cut so that a task has about as many.
ONE_TASK = 200_000
NUMBERS = ("tinyint", "smallint", "int", "bigint")


def _strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The strongly connected part of each of the nodes 0 to ``n`` - 1 (Tarjan, without recursion); an edge between parts leads to the smaller number."""
    order = np.argsort(src, kind="stable")
    ends, to = np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()
    at, seen, low, part, stack, clock, parts = ends[:-1], [0] * n, [0] * n, [-1] * n, [], 0, 0
    for first in range(n):
        path = [] if seen[first] else [first]
        while path:
            v = path[-1]
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                stack.append(v)
            if at[v] < ends[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                while part[v] < 0:
                    part[stack.pop()] = parts
                parts += 1
    return np.array(part, dtype=np.int64)


def _placed(src: pa.Array, dst: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes in order, and the places of the edges' ends among them."""
    nodes = pc.unique(pa.concat_arrays([src, dst]))
    nodes = nodes.take(pc.sort_indices(nodes))
    return nodes, *(pc.index_in(x, value_set=nodes).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))


def _in_one_task(left: DataFrame) -> DataFrame:
    """``node, ring`` of rings of two nodes or more, for at most ``ONE_TASK`` edges."""
    kind = left.schema["src"].dataType.simpleString()

    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := [x for x in batches if x.num_rows]) else None
        if table is None:
            return
        nodes, src, dst = _placed(*(table[x].combine_chunks() for x in PAIR))
        part = _strong(len(nodes), src, dst)
        greatest = np.zeros(part.max() + 1, dtype=np.int64)
        greatest[part] = np.arange(len(nodes))  # the last to be put is the greatest
        on = np.flatnonzero(np.bincount(part)[part] > 1)
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(on)), nodes.take(pa.array(greatest[part[on]]))], ["node", "ring"])

    return left.select(*PAIR).repartition(1).mapInArrow(run, f"node {kind}, ring {kind}").checkpoint()


def _shrunk(left: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``node, ring`` of the rings within ranges of nodes, and the edges that may make more, between the nodes that name these rings.

    A task has all edges of the nodes of its range.  It contracts what is
    strongly connected within it, which is so in the whole, and leaves out the
    nodes that no path between two edges across its bounds passes.  An edge
    across stays if both sides keep it.  A node with more edges than a range
    should have is in no range, and is kept by the other side alone.
    """
    parts = -(-2 * n // ONE_TASK)
    cuts = left.select(F.explode(F.array(*(F.col(x).cast("double") for x in PAIR))).alias("node")).approxQuantile("node", [i / parts for i in range(1, parts)], 0.1 / parts)
    cuts = [max(-(2**62), min(2**62, int(x))) for x in cuts]
    bounds = np.unique(np.array(cuts, dtype=np.int64))
    crowded = np.array([x for x in bounds if cuts.count(x) > 1], dtype=np.int64)

    def owner(nodes: np.ndarray) -> np.ndarray:
        return np.where(np.isin(nodes, crowded), -1, np.searchsorted(bounds, nodes, side="right"))

    def deal(batches):
        for x in batches:
            src, dst = (x.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            a, b = owner(src), owner(dst)
            for part, on in ((a, (a >= 0) | (b < 0)), (b, (b >= 0) & (a != b))):
                yield pa.RecordBatch.from_arrays([pa.array(y[on].astype(np.int64)) for y in (part, src, dst)], ["part", *PAIR])

    def settle(key, table):
        at, (src, dst) = key[0].as_py(), (table[x].combine_chunks() for x in PAIR)
        nodes, s, d = _placed(src, dst)
        value = nodes.to_numpy(zero_copy_only=False)
        of = owner(value)
        own = of == at
        inner = own[s] & own[d]
        part = _strong(len(value), s[inner], d[inner])
        greatest = np.zeros(part.max() + 1, dtype=np.int64)
        greatest[part] = value
        out = [np.stack([np.zeros(x.sum(), dtype=np.int64), value[x], greatest[part[x]], value[x]]) for x in [np.bincount(part)[part] > 1]]
        a, b = part[s], part[d]
        leaves, comes = np.zeros((2, len(greatest)), dtype=bool)
        leaves[a[~inner & own[s]]] = True
        comes[b[~inner & own[d]]] = True
        pairs = np.unique(np.stack([a, b])[:, inner & (a != b)], axis=1)
        leaves, comes = leaves.tolist(), comes.tolist()
        for x, y in pairs.T.tolist():  # the end of every edge has the smaller number, and is known first
            leaves[x] |= leaves[y]
        for x, y in pairs.T[::-1].tolist():
            comes[y] |= comes[x]
        live = np.array(leaves) & np.array(comes)
        kept = pairs[:, live[pairs[0]] & live[pairs[1]]]
        rows = lambda kind, x, y, z: np.stack([np.full(len(x), kind, dtype=np.int64), x, y, z])
        out.append(rows(1, greatest[kept[0]], greatest[kept[1]], greatest[kept[1]]))
        for kind, mine, other, me in ((2, s, d, a), (3, d, s, b)):
            on = ~inner & own[mine] & live[me]
            for alone in (False, True):
                x = np.flatnonzero(on & ((of[other] < 0) == alone))
                name = greatest[me[x]]
                ends = (value[s[x]], value[d[x]]) if not alone else (name, value[d[x]]) if kind == 2 else (value[s[x]], name)
                out.append(rows(1 if alone else kind, *ends, name))
        if at < 0:
            out.append(rows(1, value[s], value[d], value[d]))
        return pa.table(dict(zip(("kind", "a", "b", "c"), map(pa.array, np.concatenate(out, axis=1)), strict=True)))

    dealt = left.select(*PAIR).mapInArrow(deal, "part long, src long, dst long")
    out = dealt.groupBy("part").applyInArrow(settle, "kind long, a long, b long, c long").checkpoint()
    to = left.schema["src"].dataType
    both = out.filter("kind > 1").groupBy("a", "b").agg(F.max(F.expr("CASE kind WHEN 2 THEN c END")).alias("src"), F.max(F.expr("CASE kind WHEN 3 THEN c END")).alias("dst"))
    rest = out.filter("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(both.select(*PAIR)).filter("src <> dst").distinct()
    inside = out.filter("kind = 0").select(F.col("a").cast(to).alias("node"), F.col("b").cast(to).alias("ring"))
    return inside, rest.select(*(F.col(x).cast(to).alias(x) for x in PAIR)).checkpoint()


def _found(left: DataFrame) -> DataFrame | None:
    """As ``_rings``, after what tasks settle for themselves."""
    n = left.count()
    if n <= ONE_TASK or any(kind not in NUMBERS for _, kind in left.dtypes):
        return _rings(left)
    inside, rest = _shrunk(left, n)
    rings = _rings(rest)
    if rings is None:
        return inside
    wider = rings.select(F.col("node").alias("ring"), F.col("ring").alias("_wider"))
    several = inside.join(met(wider), "ring", "left").select("node", F.coalesce("_wider", "ring").alias("ring"))
    return several.unionByName(rings.join(met(inside), "node", "left_anti"))


def _trimmed(left: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``left`` without nodes that lack an edge in or out, as long as that takes off much: the rest is coloured away."""
    while n:
        before = n
        ends = lambda of, to: met(left.select(F.col(of).alias(to)).distinct())
        left = left.join(ends("dst", "src"), "src", "left_semi").join(ends("src", "dst"), "dst", "left_semi").select(*PAIR).checkpoint()
        n = left.count()
        if n > 0.9 * before:
            break
    return left, n


def _rings(left: DataFrame) -> DataFrame | None:
    """``node, ring`` of rings of two nodes or more; null if there is none.  Edges are no loops and none repeats."""
    n = left.count()
    if n > ONE_TASK:
        left, n = _trimmed(left, n)
    if not n:
        return None
    if n <= ONE_TASK:
        return _in_one_task(left)
    degree = left.groupBy("src").agg(F.count(F.lit(1)).alias("_n"), F.min("dst").alias("to"))
    chain = degree.filter("_n = 1").select(F.col("src").alias("node"), "to").checkpoint()
    if chain.isEmpty():
        return _coloured(left, n)
    pure, stops = _pure_rings(chain)
    found = [pure]
    # Edges of the other nodes, led on to where their chain stops; what runs into a pure ring never returns.
    wide = left.join(met(chain.select(F.col("node").alias("src"))), "src", "left_anti").select(*PAIR).checkpoint()
    if not wide.isEmpty():
        on = stops.select(F.col("node").alias("dst"), "stop")
        led = wide.join(met(on), "dst", "left").join(met(pure.select(F.col("node").alias("dst"))), "dst", "left_anti").select("src", "dst", F.coalesce("stop", "dst").alias("stop")).checkpoint()
        core = led.filter("src <> stop").select("src", F.col("stop").alias("dst")).distinct().checkpoint()
        inner = _rings(core)
        back = led.filter("src = stop").select(F.col("src").alias("node")).distinct().withColumn("ring", F.col("node"))
        ring = back if inner is None else inner.unionByName(back.join(met(inner), "node", "left_anti"))
        ring = ring.checkpoint()
        at = lambda end, name: met(ring.select(F.col("node").alias(end), F.col("ring").alias(name)))
        begun = led.filter("dst <> stop").join(at("src", "ring"), "src").join(at("stop", "_ring"), "stop").filter("ring = _ring").select(F.col("dst").alias("node"), "ring").distinct()
        inside = chain.join(met(stops.select("node")), "node", "left_semi")
        on_chains = _along(begun, inside).join(met(chain.select("node")), "node", "left_semi")
        found += [ring, on_chains]
    # Nodes on chains may be greater than those that named the ring.
    rings = reduce(DataFrame.unionByName, found).distinct()
    name = rings.groupBy("ring").agg(F.max("node").alias("_name"))
    return rings.join(met(name), "ring").select("node", F.col("_name").alias("ring")).checkpoint()


def _coloured(left: DataFrame, n: int) -> DataFrame | None:
    """``node, ring`` by colours, without chains."""
    found: list[DataFrame] = []
    while n > ONE_TASK:
        colour = left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")).checkpoint()
        while True:
            best = left.join(met(colour), F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("come"))
            new = kept(colour.join(met(best), F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", "come").alias("colour"), F.coalesce(F.col("come") > F.col("colour"), F.lit(False)).alias("moved")))
            colour = new.select("node", "colour")
            if new.filter("moved").isEmpty():
                break
        of = lambda end: met(colour.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}")))
        within = kept(left.join(of("src"), "src").join(of("dst"), "dst").filter("_src = _dst").select(*PAIR))
        roots = colour.filter("node = colour").select("node")
        back = reach_from(roots, within.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        ring = colour.join(met(back), "node", "left_semi").select("node", F.col("colour").alias("ring")).checkpoint()
        found.append(ring)
        # No ring spans two colours, so only edges within one go on.
        rest = lambda end: met(ring.select(F.col("node").alias(end)))
        left = within.join(rest("src"), "src", "left_anti").join(rest("dst"), "dst", "left_anti").select(*PAIR).checkpoint()
        left, n = _trimmed(left, left.count())
    if n:
        found.append(_in_one_task(left))
    if not found:
        return None
    rings = reduce(DataFrame.unionByName, found)
    size = rings.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ring")
    return rings.join(met(size), "ring", "left_semi").select("node", "ring")


def cycles(relation: DataFrame) -> DataFrame:
    """Nodes on a cycle with the truth of being on one: certain if certain edges alone make one."""
    certain = on_cycles(relation.filter(F.col("truth") == YES)).select("node", truth(YES).alias("truth"))
    possible = on_cycles(relation.filter(F.col("truth") > 0)).select("node", truth(UNKNOWN).alias("truth"))
    return certain.unionByName(possible.join(met(certain), "node", "left_anti"))


def reach_from(seeds: DataFrame, edges: DataFrame, steps: int | None = None, node: str = "node") -> DataFrame:
    """Nodes that the seeds reach, themselves included: only nodes are carried, never pairs."""
    edges = edges.select(*PAIR).distinct().checkpoint()
    step = lambda rows: edges.join(met(rows.select(F.col(node).alias("_at"))), F.col("src") == F.col("_at"), "left_semi").select(F.col("dst").alias(node))
    return _extend(seeds, step, [node], steps)


def covered_by(subjects: DataFrame, seeds: DataFrame, relation: DataFrame, steps: int | None = None, node: str = "node") -> DataFrame:
    """``subjects`` with ``lo, hi`` (0 or 1): do the seeds reach them by certain edges, do they by any?"""
    sure = reach_from(seeds, relation.filter(F.col("truth") == YES), steps, node).withColumn("lo", F.lit(1).cast("long"))
    maybe = reach_from(seeds, relation.filter(F.col("truth") > 0), steps, node).withColumn("hi", F.lit(1).cast("long"))
    return subjects.join(met(sure), node, "left").join(met(maybe), node, "left").fillna(0, ["lo", "hi"])


def first_doubt(sure: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, site``: nodes that only a possible edge opens, with the edge that did, handed on along all edges after it.

    ``sure`` are the nodes reached for certain; edges are ``src, dst, truth,
    site`` with sites in order.  A node opened in several ways in one round takes the least site.
    """
    from pyspark.sql.functions import min as least

    edges = edges.checkpoint()
    known = sure.select("node")
    opened = edges.filter(F.col("truth") == UNKNOWN).join(met(known), edges["src"] == known["node"], "left_semi").select(F.col("dst").alias("node"), "site")
    front = opened.join(met(known), "node", "left_anti").groupBy("node").agg(least("site").alias("site")).checkpoint()
    parts = [front]
    while not front.isEmpty():
        after = edges.select("src", "dst").join(met(front.withColumnRenamed("node", "_at")), F.col("src") == F.col("_at")).select(F.col("dst").alias("node"), "site")
        for part in (known, *(p.select("node") for p in parts)):
            after = after.join(met(part), "node", "left_anti")
        front = after.groupBy("node").agg(least("site").alias("site")).checkpoint()
        parts.append(front)
        if len(parts) > COMPACT:
            parts = [reduce(DataFrame.unionByName, parts).checkpoint()]
    return reduce(DataFrame.unionByName, parts)


def poisoned(reached: DataFrame, calls: DataFrame, named: DataFrame) -> DataFrame:
    """``node, pinned``: what an unresolved call (``src, name, qualifier``) from a reached node may mean.

    Nodes of that ``name`` are meant if the call has no qualifier or theirs is
    the call's; the one node that a qualified call can mean is ``pinned``.
    """
    open_ = calls.join(reached.select(F.col("node").alias("src")), "src", "left_semi").select("name", "qualifier").distinct()
    rows = open_.join(named.select("node", "name", F.col("qualifier").alias("_own")), "name").filter(F.col("qualifier").isNull() | (F.col("qualifier") == F.col("_own")))
    one = rows.filter("qualifier is not null").groupBy("name", "qualifier").agg(F.min("node").alias("node"), F.max("node").alias("_last")).filter("node = _last")
    pinned = one.select("node").distinct().withColumn("pinned", F.lit(True))
    return rows.select("node").distinct().join(pinned, "node", "left").fillna(False, ["pinned"])


def strata(derive: list, base: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Relations derived one after another: ``derive`` lists names and functions of the relations before; each is checkpointed for those after."""
    known = dict(base)
    for name, f in derive:
        if name in known:
            raise ValueError(f"the relation {name} is there already")
        known[name] = strongest(f(dict(known))).checkpoint()
    return known
