"""Imports and re-exports: what a path means from a module, and what a root module makes public.

Entries are rows ``module, name, kind, target, start, path, public, status``.
Kind ``decl`` and ``module`` give a name to ``target`` (a symbol, a module);
``alias`` gives it to whatever ``path`` (an array of names) means from the
module ``start``; ``glob`` has no name and brings in every name of what its
path means.  ``status`` is 2 for certain entries and 1 for possible ones.

A path is followed name by name.  An alias rewrites what is left of it, a glob
puts its own path before it, so the state of a search is a module and a path,
and all searches go on together, a round a step; a state that a search has had
is not followed again, which ends cycles of re-exports.  A glob is asked only
where no entry of the module has the name.  Entries that are not public are
seen from their module and those inside it alone (``a::b`` is inside ``a``).
In ``follow`` a path that aliases make longer than ``most`` names (``MOST_NAMES``)
means nothing; ``meant``, and with it the public names, has no such bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.operators import relation

MOST_NAMES = 12
INFERRED = "spark.sql.constraintPropagation.enabled"
STATE = ["ask", "writer", "module", "path", "truth"]


def _visible(entry: str, writer: Column) -> Column:
    module = F.col(f"{entry}.module")
    return F.col(f"{entry}.public") | (writer == module) | writer.startswith(F.concat(module, F.lit("::")))


def _rest(path: Column) -> Column:
    return F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))


def _named(states: DataFrame, entries: DataFrame) -> DataFrame:
    """States with the entry ``e`` of their first name."""
    on = (F.col("s.module") == F.col("e.module")) & (F.get("s.path", F.lit(0)) == F.col("e.name"))
    return states.alias("s").join(relation.met(entries.filter("kind <> 'glob'")).alias("e"), on).filter(_visible("e", F.col("s.writer")))


def _start(asks: DataFrame) -> DataFrame:
    writer = F.col("writer") if "writer" in asks.columns else F.col("module")
    return asks.select("ask", writer.alias("writer"), "module", "path", F.lit(2).cast("tinyint").alias("truth"))


def follow(asks: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """``ask, target, is_module, truth``: all that the paths (``ask, module, path``, and ``writer`` if another module asks) mean."""
    entries = entries.checkpoint()
    named, globs = (relation.met(entries.filter(f"kind {x} 'glob'")).alias("e") for x in ("<>", "="))
    least = F.least(F.col("s.truth"), F.col("e.status")).cast("tinyint").alias("truth")
    own = (F.col("s.module") == F.col("e.module")) & (F.get("s.path", F.lit(0)) == F.col("e.name"))

    def step(states: DataFrame) -> DataFrame:
        live = states.filter(F.size("path") > 0).alias("s")
        rows = live.join(named, own, "left")
        alias = F.col("e.kind") == "alias"
        onward = rows.filter(_visible("e", F.col("s.writer")) & (alias | (F.col("e.kind") == "module") & (F.size("s.path") > 1)))
        rest = _rest(F.col("s.path"))
        onward = onward.select("s.ask", F.when(alias, F.col("e.module")).otherwise(F.col("s.writer")).alias("writer"), F.when(alias, F.col("e.start")).otherwise(F.col("e.target")).alias("module"), F.when(alias, F.concat("e.path", rest)).otherwise(rest).alias("path"), least)
        unknown = rows.filter(F.col("e.module").isNull()).select("s.*").alias("s")
        brought = unknown.join(globs, F.col("s.module") == F.col("e.module")).filter(_visible("e", F.col("s.writer")))
        brought = brought.select("s.ask", F.col("e.module").alias("writer"), F.col("e.start").alias("module"), F.concat("e.path", "s.path").alias("path"), least)
        return onward.unionByName(brought).filter(F.size("path") <= (most or MOST_NAMES))

    spark = asks.sparkSession
    # Spark 4.1 fails to rename what it infers about a checkpointed frontier (a missing key) when that is joined to itself.
    before = spark.conf.get(INFERRED)
    spark.conf.set(INFERRED, "false")
    try:
        states = relation._extend(_start(asks), step, STATE, None)
    finally:
        spark.conf.set(INFERRED, before)
    ends = _named(states.filter(F.size("path") == 1), entries.filter("kind in ('decl', 'module')"))
    return ends.groupBy("s.ask", "e.target").agg(F.max(F.col("e.kind") == "module").alias("is_module"), F.max(F.least("s.truth", "e.status")).cast("tinyint").alias("truth"))


#: What is known of searches whose paths have no greatest length (see ``meant``).
FACT = ["kind", "state", "writer", "module", "name", "next", "truth"]


def _put(rows: DataFrame) -> DataFrame:
    """Facts of rows ``writer, module, path, state, truth``: a path that is to be followed, and then the stack of names that ``state`` stands for."""
    rest = lambda i: f"concat_ws('\\0', 'S', writer, module, array_join(path, '\\u0001'), CAST({i} AS STRING))"
    fact = lambda kind, **x: "named_struct(" + ", ".join([f"'kind', '{kind}'", *(f"'{c}', {x.get(c, 'CAST(NULL AS STRING)')}" for c in FACT[1:-1]), f"'truth', CAST({x['truth']} AS TINYINT)"]) + ")"
    begun = fact("name", state=f"if(size(path) > 1, {rest(1)}, state)", writer="writer", module="module", name="path[0]", truth="if(size(path) > 1, 2, truth)")
    later = fact("stack", state=rest("i"), name="path[i]", next=f"if(i + 1 < size(path), {rest('i + 1')}, state)", truth="if(i + 1 < size(path), 2, truth)")
    ended = fact("end", state="state", writer="writer", module="module", truth="truth")
    facts = f"CASE size(path) WHEN 0 THEN array({ended}) WHEN 1 THEN array({begun}) ELSE concat(array({begun}), transform(sequence(1, greatest(size(path) - 1, 1)), i -> {later})) END"
    return rows.filter("path is not null").selectExpr(f"inline({facts})")


def meant(asks: DataFrame, entries: DataFrame) -> DataFrame:
    """As ``follow``, for paths of any length; ``ask`` is a string.

    Renamings may make paths longer without end, so states hold their first
    name only, and ``state`` for the names below it.  Facts are: from ``writer``
    in ``module`` the ``name`` is asked above ``state``; below ``state`` the
    stack goes on with ``name`` and ``next``; the names above ``state`` lead to
    a module (``end``).  Names below a path are shared by all that ask it, so
    there are finitely many facts.
    """
    entries = entries.checkpoint()
    named, globs = (relation.met(entries.filter(f"kind {x} 'glob'")).alias("e") for x in ("<>", "="))
    least = F.least(F.col("s.truth"), F.col("e.status")).cast("tinyint").alias("truth")
    own = (F.col("s.module") == F.col("e.module")) & (F.col("s.name") == F.col("e.name"))
    last = F.col("s.state").startswith("F")

    def step(facts: DataFrame, known: DataFrame) -> DataFrame:
        rows = facts.filter("kind = 'name'").alias("s").join(named, own, "left")
        alias = F.col("e.kind") == "alias"
        onward = rows.filter(_visible("e", F.col("s.writer")) & (alias | (F.col("e.kind") == "module") & ~last))
        onward = onward.select(F.when(alias, F.col("e.module")).otherwise(F.col("s.writer")).alias("writer"), F.when(alias, F.col("e.start")).otherwise(F.col("e.target")).alias("module"), F.when(alias, F.col("e.path")).otherwise(F.array().cast("array<string>")).alias("path"), "s.state", least)
        brought = rows.filter(F.col("e.module").isNull()).select("s.*").alias("s").join(globs, F.col("s.module") == F.col("e.module")).filter(_visible("e", F.col("s.writer")))
        brought = brought.select(F.col("e.module").alias("writer"), F.col("e.start").alias("module"), F.concat("e.path", F.array("s.name")).alias("path"), "s.state", least)
        # Where names end, the stack below goes on; either side may be the new one.
        meets = [a.filter("kind = 'end'").select("state", "writer", "module", F.col("truth").alias("_t")).join(relation.met(b.filter("kind = 'stack'").select("state", "name", "next", "truth")), "state") for a, b in ((facts, known), (known, facts))]
        popped = meets[0].unionByName(meets[1]).select(F.lit("name").alias("kind"), F.col("next").alias("state"), "writer", "module", "name", F.lit(None).cast("string").alias("next"), F.least("truth", "_t").alias("truth"))
        return _put(onward.unionByName(brought)).unionByName(popped)

    start = asks.select("writer", "module", "path", F.concat(F.lit("F"), "ask").alias("state"), F.lit(2).alias("truth"))
    spark = asks.sparkSession
    before = spark.conf.get(INFERRED)
    spark.conf.set(INFERRED, "false")
    try:
        facts = relation._extend(_put(start), step, FACT, None, known=True)
    finally:
        spark.conf.set(INFERRED, before)
    found = facts.filter("kind = 'name'").alias("s").filter(last).join(relation.met(entries.filter("kind in ('decl', 'module')")).alias("e"), own).filter(_visible("e", F.col("s.writer")))
    return found.groupBy(F.expr("substr(s.state, 2)").alias("ask"), "e.target").agg(F.max(F.col("e.kind") == "module").alias("is_module"), F.max(least).cast("tinyint").alias("truth"))


def resolve_imports(asks: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """``ask, status, targets``: Must for the one thing that a path certainly means, May for all that it may, Unknown for none."""
    found = follow(asks, entries, most).groupBy("ask").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.min("truth").alias("_t"))
    status = F.when(F.col("targets").isNull(), "Unknown").when((F.size("targets") == 1) & (F.col("_t") == 2), "Must").otherwise("May")
    return asks.select("ask").distinct().join(relation.met(found), "ask", "left").select("ask", status.alias("status"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def public_names(entries: DataFrame, most: int | None = None) -> DataFrame:
    """``module, name, target, is_module, truth``: every public name of every module, its own and those it re-exports; paths have any length unless ``most`` is given."""
    marked = entries.filter("public").withColumn("ask", F.concat_ws("\x00", "module", "kind", F.coalesce("name", F.lit("")), "start", F.array_join("path", "\x01"), "status"))
    asks = marked.filter("kind in ('alias', 'glob')").select("ask", "module", "start", "path").distinct()
    # An alias is written in its own module: what it may see is decided there, wherever its path starts.
    states = asks.select("ask", F.col("module").alias("writer"), F.col("start").alias("module"), "path")
    found = meant(states, entries) if most is None else follow(states, entries, most)
    found = found.select("ask", F.col("target").alias("meant"), "is_module", "truth").checkpoint()
    own = marked.filter("kind in ('decl', 'module')").select("module", "name", "target", (F.col("kind") == "module").alias("is_module"), F.col("status").cast("tinyint").alias("truth"))
    least = F.least("truth", "status").cast("tinyint").alias("truth")
    aliased = marked.filter("kind = 'alias'").join(relation.met(found), "ask").select("module", "name", F.col("meant").alias("target"), "is_module", least)
    # A glob brings in the public names of the modules that its path means; an empty path is its start.
    flows = marked.filter("kind = 'glob'").join(relation.met(found.filter("is_module")), "ask").select(F.col("module").alias("into"), F.col("meant").alias("module"), least)
    plain = marked.filter("kind = 'glob' and size(path) = 0").select(F.col("module").alias("into"), F.col("start").alias("module"), F.col("status").cast("tinyint").alias("truth"))
    flows = flows.unionByName(plain).groupBy("into", "module").agg(F.max("truth").alias("along")).checkpoint()
    held = entries.filter("kind <> 'glob'").select("module", "name").distinct()

    def step(names: DataFrame) -> DataFrame:
        moved = names.join(relation.met(flows), "module").select(F.col("into").alias("module"), "name", "target", "is_module", F.least("truth", "along").cast("tinyint").alias("truth"))
        return moved.join(relation.met(held), ["module", "name"], "left_anti")

    every = relation._extend(own.unionByName(aliased), step, ["module", "name", "target", "is_module", "truth"], None)
    return every.groupBy("module", "name", "target").agg(F.max("is_module").alias("is_module"), F.max("truth").alias("truth"))


def public_api(entries: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """``root, target, truth``: all that a root module makes public, directly or through public modules, by its own names and re-exports."""
    names = public_names(entries, most).checkpoint()
    inner = names.filter("is_module").select("module", F.col("target").alias("below"), F.col("truth").alias("along"))
    step = lambda rows: rows.join(relation.met(inner), "module").select("root", F.col("below").alias("module"), F.least("truth", "along").cast("tinyint").alias("truth"))
    reached = relation._extend(roots.select("root", F.col("root").alias("module"), F.lit(2).cast("tinyint").alias("truth")), step, ["root", "module", "truth"], None)
    out = reached.withColumnRenamed("truth", "along").join(relation.met(names), "module")
    return out.groupBy("root", "target").agg(F.max(F.least("truth", "along")).cast("tinyint").alias("truth"))
