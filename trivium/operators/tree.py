"""Trees of nodes: navigation, nearest units, binders, facets.

Nodes are rows ``artifact, node_id, parent_id, op, name, start, end, depth``;
a node's range (ends included) lies in its parent's.  Ancestors and
descendants are found by range joins on bins (:mod:`spans`), never by
walking up level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.functions.truth import NO, UNKNOWN, YES, truth
from trivium.operators import spans

#: Operators that nothing can see into.
UNSEEN = ("opaque", "hole")


def op_is(op: Column, holds: Column) -> Column:
    """Truth of a test of a node's operator: unknown on opaque nodes and holes."""
    return F.when(op.isin(*UNSEEN), truth(UNKNOWN)).when(holds, truth(YES)).otherwise(truth(NO))


def in_order(nodes: DataFrame) -> DataFrame:
    """Nodes by location, the outer first, then by id."""
    return nodes.orderBy("artifact", "start", F.desc("end"), "depth", "node_id")


def children(nodes: DataFrame) -> DataFrame:
    """The relation from parents to children, all certain."""
    return nodes.filter("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), truth(YES).alias("truth"))


def siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the nodes ``before`` and ``after`` them under the same parent."""
    w = Window.partitionBy("artifact", "parent_id").orderBy("start", "node_id")
    shared = F.col("parent_id").isNotNull()
    return nodes.withColumn("before", F.when(shared, F.lag("node_id").over(w))).withColumn("after", F.when(shared, F.lead("node_id").over(w)))


def ancestry(inner: DataFrame, outer: DataFrame, itself: bool = False) -> DataFrame:
    """Pairs ``node_id`` (of ``inner``) and ``above`` (of ``outer``) with the columns of ``inner``, ``above_op, above_name, above_depth``.

    With ``itself`` a node stands above itself too.
    """
    up = outer.select("artifact", F.col("start").alias("from"), F.col("end").alias("to"), F.col("node_id").alias("above"), F.col("op").alias("above_op"), F.col("name").alias("above_name"), F.col("depth").alias("above_depth"))
    below = F.col("above_depth") < F.col("depth")
    if itself:
        below = below | (F.col("above") == F.col("node_id"))
    return spans.covers(inner, up, ["artifact"]).filter(below).drop("from", "to")


def is_ancestor(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``asked`` (``above, node_id``) with ``holds``: does the one stand above the other?"""
    place = lambda key, mark: nodes.select(F.col("node_id").alias(key), F.struct("artifact", "start", "end", "depth").alias(mark))
    both = asked.join(place("above", "_a"), "above", "left").join(place("node_id", "_n"), "node_id", "left")
    holds = (F.col("_a.artifact") == F.col("_n.artifact")) & (F.col("_a.start") <= F.col("_n.start")) & (F.col("_n.end") <= F.col("_a.end")) & (F.col("_a.depth") < F.col("_n.depth"))
    return both.select(*asked.columns, F.coalesce(holds, F.lit(False)).alias("holds"))


def enclosing(inner: DataFrame, outer: DataFrame, name: str = "unit") -> DataFrame:
    """``inner`` with the deepest node of ``outer`` above it, null if there is none: all nodes in one pass."""
    best = ancestry(inner.select("artifact", "node_id", "start", "end", "depth"), outer).groupBy("node_id").agg(F.max_by("above", F.struct("above_depth", "above")).alias(name))
    return inner.join(best, "node_id", "left")


def node_at(points: DataFrame, nodes: DataFrame, key: str, position: str) -> DataFrame:
    """``points`` (``artifact, key, position``) with the deepest ``node_id`` that contains each."""
    asked = points.select("artifact", key, F.col(position).alias("start"), F.col(position).alias("end"))
    outer = nodes.select("artifact", F.col("start").alias("from"), F.col("end").alias("to"), "node_id", "depth")
    best = spans.covers(asked, outer, ["artifact"]).groupBy(key).agg(F.max_by("node_id", F.struct("depth", "node_id")).alias("node_id"))
    return points.join(best, key, "left")


def binders_in_scope(inner: DataFrame, binders: DataFrame) -> DataFrame:
    """``node_id, binders``: names that the binders above a node bind, the innermost first."""
    rows = ancestry(inner.select("artifact", "node_id", "start", "end", "depth"), binders).groupBy("node_id").agg(F.collect_list(F.struct((-F.col("above_depth")).alias("d"), "above", "above_name")).alias("b"))
    return inner.select("node_id").join(rows, "node_id", "left").select("node_id", F.coalesce(F.transform(F.array_sort("b"), lambda x: x["above_name"]), F.expr("cast(array() as array<string>)")).alias("binders"))


def free_variables(units: DataFrame, refs: DataFrame, binders: DataFrame) -> DataFrame:
    """``unit, name``: names that references under a unit use and no binder between them and the unit binds.

    A reference is free in every unit that stands above its nearest binder of
    the same name, so its binder is found once, not once a unit.
    """
    asked = refs.select("artifact", "node_id", "start", "end", "depth", "name")
    bound = ancestry(asked, binders).filter("above_name = name").groupBy("node_id").agg(F.max("above_depth").alias("_bound"))
    rows = ancestry(asked, units).join(bound, "node_id", "left")
    return rows.filter(F.col("_bound").isNull() | (F.col("_bound") < F.col("above_depth"))).select(F.col("above").alias("unit"), "name").distinct()


def chain_status(nodes: DataFrame, status: str = "status") -> DataFrame:
    """``node_id, status``: the weakest status of a node and all that contain it."""
    rows = ancestry(nodes, nodes.withColumn("name", F.col(status).cast("string")), itself=True)
    return rows.groupBy("node_id").agg(F.min(F.col("above_name").cast("tinyint")).alias(status))


def contents(roots: DataFrame, nodes: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """``roots`` with the number of nodes of each kind (a condition on ``nodes``) under them."""
    marked = nodes.select("artifact", "node_id", "start", "end", "depth", *(c.alias(f"_{k}") for k, c in kinds.items()))
    found = ancestry(marked, roots).groupBy("above").agg(*(F.count_if(f"_{k}").alias(k) for k in kinds))
    return roots.join(found.withColumnRenamed("above", "node_id").hint("merge"), "node_id", "left").fillna(0, list(kinds))


def unseen_reasons(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, reasons``: why parts of a root could not be seen, each reason once."""
    rows = ancestry(nodes.filter(F.col("op").isin(*UNSEEN)), roots)
    return rows.groupBy(F.col("above").alias("node_id")).agg(F.array_sort(F.collect_set(F.when(F.col("op") == "hole", "hole").otherwise(F.col("name")))).alias("reasons"))


def subtree_digests(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, digest`` of what stands under each root, in preorder: operator, depth below the root and name.

    A name that a binder under the root binds counts by that binder's place,
    so renaming it changes nothing.  A subtree is put together in one row.
    """
    rows = ancestry(nodes, roots, itself=True).withColumn("rel", F.col("depth") - F.col("above_depth"))
    packed = rows.groupBy("above").agg(F.array_sort(F.collect_list(F.struct("start", "depth", "node_id", "rel", "op", F.coalesce("name", F.lit("")).alias("name")))).alias("l"))
    bound = F.array_distinct(F.transform(F.filter("l", lambda x: x["op"] == "bind"), lambda x: x["name"]))
    packed = packed.withColumn("b", bound)
    token = lambda x: F.concat_ws(":", x["op"], x["rel"].cast("string"), F.when(F.array_contains("b", x["name"]), F.concat(F.lit("#"), F.array_position("b", x["name"]).cast("string"))).otherwise(x["name"]))
    return packed.select(F.col("above").alias("node_id"), F.sha2(F.array_join(F.transform("l", token), "\n"), 256).alias("digest"))


def identities(parts: DataFrame, asked: DataFrame, symref: str = "symref") -> DataFrame:
    """``symref, kind, digest, parts``: the parts of one identity as one, in their order.

    Parts are ``symref, place, node_id, digest``.  Digests of several parts are
    joined and hashed, that of a single part stays; a null one makes the whole
    Unknown; an identity without parts is Absent.
    """
    whole = parts.groupBy(symref).agg(F.array_sort(F.collect_list(F.struct("place", "node_id", "digest"))).alias("p"), F.count_if(F.col("digest").isNull()).alias("holes"))
    rows = asked.select(symref).distinct().join(whole, symref, "left")
    kind = F.when(F.col("p").isNull(), "Absent").when(F.col("holes") > 0, "Unknown").otherwise("Known")
    joined = F.when(F.size("p") == 1, F.col("p")[0]["digest"]).otherwise(F.sha2(F.array_join(F.transform("p", lambda x: x["digest"]), ""), 256))
    return rows.select(symref, kind.alias("kind"), F.when(kind == "Known", joined).alias("digest"), F.coalesce(F.size("p"), F.lit(0)).alias("parts"))


def resolves(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The relation of references to declarations and the poisoned references.

    ``resolved`` holds ``src, status, decls``: one certain declaration is a yes,
    each of several possible ones unknown; an unknown resolution has no pair and poisons its reference.
    """
    pairs = resolved.filter("status <> 'Unknown'").select("src", F.explode("decls").alias("dst"), F.when(F.col("status") == "Must", truth(YES)).otherwise(truth(UNKNOWN)).alias("truth"))
    return pairs, resolved.filter("status = 'Unknown'").select(F.col("src").alias("node"))


def resolves_to(asked: DataFrame, resolved: DataFrame) -> DataFrame:
    """``asked`` (``src, dst``) with the truth that the reference means the declaration; one that nothing resolved is unknown."""
    rows = asked.join(resolved.select("src", "status", "decls"), "src", "left")
    member = F.array_contains("decls", F.col("dst"))
    state = F.when(F.coalesce("status", F.lit("Unknown")) == "Unknown", truth(UNKNOWN)).when(~member, truth(NO)).when(F.col("status") == "Must", truth(YES)).otherwise(truth(UNKNOWN))
    return rows.select("src", "dst", state.alias("truth"))


def calls(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """The relation of units to the units they call: ``apply`` nodes whose first child is a reference to one, strongest truth a pair."""
    units = nodes.filter("op = 'unit'")
    heads = nodes.filter("parent_id is not null").groupBy("parent_id").agg(F.min_by(F.struct("node_id", "op"), F.struct("start", "node_id")).alias("head"))
    applied = enclosing(nodes.filter("op = 'apply'"), units, "src").filter("src is not null").select(F.col("node_id").alias("parent_id"), "src")
    heads = applied.join(heads.filter("head.op = 'ref'").select("parent_id", F.col("head.node_id").alias("ref")), "parent_id")
    pairs, _ = resolves(resolved)
    aimed = heads.join(pairs.select(F.col("src").alias("ref"), "dst", "truth"), "ref")
    return aimed.join(units.select(F.col("node_id").alias("dst")), "dst", "left_semi").groupBy("src", "dst").agg(F.max("truth").alias("truth"))
