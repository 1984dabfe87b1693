"""Analytics over folded tickets and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.functions.truth import YES, truth
from trivium.operators import relation


def blockers(links: DataFrame) -> DataFrame:
    """``ticket, blocker`` of links ``src, kind, dst``, whichever way round they are written; each once."""
    turned = F.when(F.col("kind") == "blocks", F.struct(F.col("dst").alias("ticket"), F.col("src").alias("blocker"))).when(F.col("kind") == "blocked-by", F.struct(F.col("src").alias("ticket"), F.col("dst").alias("blocker")))
    return links.select(turned.alias("b")).filter("b is not null").select("b.*").distinct()


def with_blocked(tickets: DataFrame, links: DataFrame, key: str = "id", category: str = "category") -> DataFrame:
    """``tickets`` with ``blocked``: some blocker exists and is not done.  Done tickets are not blocked, dangling blockers do not block."""
    open_ = tickets.filter(F.col(category) != "done").select(F.col(key).alias("blocker")).distinct()
    held = blockers(links).join(open_, "blocker", "left_semi").select(F.col("ticket").alias(key)).distinct().withColumn("_held", F.lit(True))
    blocked = F.col("_held").isNotNull() & (F.col(category) != "done")
    return tickets.join(held, key, "left").withColumn("blocked", F.coalesce(blocked, F.lit(False))).drop("_held")


def dangling(links: DataFrame, tickets: DataFrame, key: str = "id") -> DataFrame:
    """Links whose target is no ticket; a null target is no link."""
    return links.filter("dst is not null").join(tickets.select(F.col(key).alias("dst")).distinct(), "dst", "left_anti")


def dangling_ends(links: DataFrame, tickets: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """``src, kind, dst`` of links and, of the kind ``parent``, of parents whose target is no ticket."""
    parents = tickets.filter(F.col(parent).isNotNull()).select(F.col(key).alias("src"), F.lit("parent").alias("kind"), F.col(parent).alias("dst"))
    return dangling(links.select("src", "kind", "dst").unionByName(parents), tickets, key).select("src", "kind", "dst")


def topology(links: DataFrame) -> DataFrame:
    """``problem, kind, node``: links to oneself, and targets of any kind that several origins claim; :func:`faults` judges what each kind allows."""
    real = links.filter("src is not null and dst is not null").select("src", "kind", "dst").distinct()
    own = real.filter("src = dst").select(F.lit("self").alias("problem"), "kind", F.col("src").alias("node"))
    several = real.groupBy("kind", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("origins").alias("problem"), "kind", F.col("dst").alias("node"))
    return own.unionByName(several)


# The backward spelling of each kind, and the kinds that allow no cycle.
INVERSE = {"blocked-by": "blocks", "duplicated-by": "duplicates", "caused-by": "causes", "split-from": "splits", "spawned": "discovered-from", "enabled-by": "enabler-for", "superseded-by": "supersedes"}
ACYCLIC = ("blocks", "causes", "discovered-from", "supersedes")


def forward(links: DataFrame) -> DataFrame:
    """Links ``src, kind, dst`` in the forward spelling of their kind, ``relates`` with the smaller end first; each once."""
    real = links.filter("src is not null and dst is not null and kind is not null")
    kind = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in INVERSE.items()), F.col("kind"))
    turned = F.col("kind").isin(*INVERSE) | ((F.col("kind") == "relates") & (F.col("dst") < F.col("src")))
    return real.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), kind.alias("kind"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct()


def faults(links: DataFrame, tickets: DataFrame) -> DataFrame:
    """``problem, kind, node`` of links ``src, kind, dst`` and of tickets ``id, type, parent``; parents have the kind ``parent``.

    ``self``: a link to oneself; ``cycle``: on a cycle of an acyclic kind or of
    parents, by :func:`relation.cycles`; ``origins``: split from several;
    ``duplicate``: a duplicate that has duplicates; ``target``: enabled, but no story.
    """
    found = forward(links)
    parents = tickets.filter("parent is not null").select(F.col("id").alias("src"), F.lit("parent").alias("kind"), F.col("parent").alias("dst"))
    edges = found.unionByName(parents).distinct().checkpoint()  # read by every check
    problem = lambda rows, name, node: rows.select(F.lit(name).alias("problem"), "kind", F.col(node).alias("node")).distinct()
    proper = edges.filter("src <> dst")
    # One closure for all kinds: an end is the kind and the node as one text.
    end = lambda node: F.concat("kind", F.lit(":"), F.col(node).cast("string"))
    bound = proper.filter(F.col("kind").isin(*ACYCLIC, "parent")).select("kind", F.col("src").alias("at"), end("src").alias("src"), end("dst").alias("dst"), truth(YES).alias("truth"))
    rings = relation.cycles(bound.select("src", "dst", "truth")).select(F.col("node").alias("src"))
    ringed = bound.select("kind", "at", "src").join(relation.met(rings), "src", "left_semi")
    splits = proper.filter("kind = 'splits'").groupBy("kind", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = proper.filter("kind = 'duplicates'")
    chained = copies.join(relation.met(copies.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
    stories = tickets.filter("type = 'story'").select(F.col("id").alias("dst"))
    aimless = proper.filter("kind = 'enabler-for'").join(relation.met(stories), "dst", "left_anti")
    out = problem(edges.filter("src = dst"), "self", "src")
    for rows in (problem(ringed, "cycle", "at"), problem(splits, "origins", "dst"), problem(chained, "duplicate", "src"), problem(aimless, "target", "dst")):
        out = out.unionByName(rows)
    return out


def inbox(tickets: DataFrame, triage: DataFrame, key: str, order: list[str], at: Column) -> DataFrame:
    """Tickets whose latest triage event is not a snooze (``until``) beyond ``at``."""
    last = triage.groupBy(key).agg(F.max_by("until", F.struct(*order)).alias("_until"))
    return tickets.join(last, key, "left").filter(F.col("_until").isNull() | (F.col("_until") <= at)).drop("_until")


def latest_evidence(evidence: DataFrame, keys: list[str], order: list[str], passed: str) -> DataFrame:
    """What the latest evidence of each key says; earlier evidence does not count."""
    return evidence.groupBy(*keys).agg(F.max_by(passed, F.struct(*order)).alias(passed))


def handles(rows: DataFrame, key: str, least: int) -> DataFrame:
    """``rows`` with ``handle``: the shortest suffix of ``key`` that no other key has, ``least`` characters at least.

    Keys that differ in their last ``least`` characters cannot clash, so each
    such suffix is a partition; in it, only neighbours in the order of the
    reversed keys matter.
    """
    w = Window.partitionBy(F.expr(f"right({key}, {least})")).orderBy("_back")
    shared = lambda other: F.when(other.isNull(), F.lit(0)).otherwise(F.length(F.regexp_extract(F.concat("_back", F.lit("\x00"), other), "^(.*).*\x00\\1", 1)))
    rows = rows.withColumn("_back", F.reverse(key))
    rows = rows.withColumn("_before", F.lag("_back").over(w)).withColumn("_after", F.lead("_back").over(w))
    need = F.greatest(F.lit(least), shared(F.col("_before")) + 1, shared(F.col("_after")) + 1)
    return rows.withColumn("handle", F.reverse(F.substr("_back", F.lit(1), need))).drop("_back", "_before", "_after")


def holds(asked: DataFrame, relation: DataFrame, poisoned: DataFrame, node: str = "node") -> DataFrame:
    """``src, dst, truth``: the stored truth; of an absent pair unknown if an end is poisoned, else no."""
    bad = poisoned.select(F.col(node)).distinct()
    side = lambda end: bad.select(F.col(node).alias(end), F.lit(True).alias(f"_bad_{end}"))
    out = asked.join(relation.select("src", "dst", "truth"), ["src", "dst"], "left").join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    unsure = F.col("_bad_src").isNotNull() | F.col("_bad_dst").isNotNull()
    return out.select("src", "dst", F.coalesce("truth", F.when(unsure, 1).otherwise(0)).cast("tinyint").alias("truth"))
