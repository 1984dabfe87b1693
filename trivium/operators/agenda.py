"""Milestones, cycles and queues: who belongs to what, what comes next, how a cycle closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.operators import relation, workflow


def delivered(facts: DataFrame, cycles: DataFrame, counted: tuple[str, ...]) -> DataFrame:
    """``cycle, points`` of the counted facts (``type, points, on``) whose day a cycle holds, both ends and an early end included.

    Cycles are a calendar: few, non-null and sent to all facts only after they are counted.
    """
    if cycles.count() > 100_000:
        raise ValueError("a calendar has at most 100,000 cycles")
    spans = F.broadcast(cycles.select(F.col("id").alias("cycle"), "start", workflow.effective_end(F.col("end"), F.col("ended")).alias("_until")))
    rows = facts.filter(F.col("type").isin(*counted)).join(spans, (F.col("start") <= F.col("on")) & (F.col("on") <= F.col("_until")))
    points = rows.groupBy("cycle").agg(F.sum("points").alias("points"))
    return cycles.select(F.col("id").alias("cycle")).join(points, "cycle", "left").fillna(0, ["points"])


def committed(members: DataFrame, group: str, counted: tuple[str, ...]) -> DataFrame:
    """Points of the counted types of each group."""
    return members.groupBy(group).agg(F.sum(F.when(F.col("type").isin(*counted), F.coalesce("points", F.lit(0))).otherwise(0)).alias("committed"))


def under_epics(tickets: DataFrame, epics: DataFrame) -> DataFrame:
    """``epic, id``: tickets below each epic by their parents, the epic itself too; rings of parents end the walk."""
    parents = tickets.filter("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    reached = relation.reach_pairs(epics.select(F.col("epic").alias("seed"), F.col("epic").alias("node")), parents)
    return reached.select(F.col("seed").alias("epic"), F.col("node").alias("id"))


def milestone_members(milestones: DataFrame, tickets: DataFrame) -> DataFrame:
    """``version, id``: tickets below an epic of a milestone (``version, epics``) or that claim its version by a label ``milestone:<version>``."""
    below = under_epics(tickets, milestones.select(F.explode("epics").alias("epic")).distinct())
    by_epic = milestones.select("version", F.explode("epics").alias("epic")).join(relation.met(below), "epic").select("version", "id")
    return by_epic.unionByName(claims(tickets).join(milestones.select("version"), "version", "left_semi").select("version", "id")).distinct()


def claims(tickets: DataFrame) -> DataFrame:
    """``id, version`` of the labels by which tickets claim milestones."""
    label = tickets.select("id", F.explode("labels").alias("_label")).filter(F.col("_label").startswith("milestone:"))
    return label.select("id", F.expr("substring(_label, 11)").alias("version")).distinct()


def claims_outside(milestones: DataFrame, tickets: DataFrame) -> DataFrame:
    """``id, version``: claims on a milestone by a ticket that stands below none of its epics."""
    below = under_epics(tickets, milestones.select(F.explode("epics").alias("epic")).distinct())
    inside = milestones.select("version", F.explode("epics").alias("epic")).join(relation.met(below), "epic").select("version", "id")
    known = claims(tickets).join(milestones.select("version").distinct(), "version", "left_semi")
    return known.join(relation.met(inside), ["version", "id"], "left_anti").select("id", "version")


def without_goal(milestones: DataFrame) -> DataFrame:
    """Open milestones that say no goal."""
    return milestones.filter((F.col("state") == "open") & (F.trim(F.coalesce("goal", F.lit(""))) == ""))


def incomplete_epics(milestones: DataFrame, tickets: DataFrame) -> DataFrame:
    """``version, epics``: the closed milestones with epics that are not done (or not there), and how many."""
    rows = milestones.filter("state = 'closed'").select("version", F.explode("epics").alias("id"))
    rows = rows.join(tickets.select("id", "category"), "id", "left").filter("category is null or category <> 'done'")
    return rows.groupBy("version").agg(F.count(F.lit(1)).alias("epics"))


def next_milestone(milestones: DataFrame) -> DataFrame:
    """The open milestone with the earliest target, undated ones last, then by version: one row, or none."""
    order = F.struct(F.col("target").isNull().alias("undated"), "target", "version")
    return milestones.filter("state = 'open'").agg(F.min_by("id", order).alias("id")).filter("id is not null")


def plan_order(lane: Column, in_milestone: Column) -> list[Column]:
    """Keys of the order of a plan before rank: by lane; the next milestone's first in the plain lane alone."""
    return [lane.alias("lane"), ((lane == 2) & ~in_milestone).alias("later")]


def close_plan(cycle: DataFrame, members: DataFrame, others: DataFrame, today: Column, counted: tuple[str, ...]) -> DataFrame:
    """What closing a cycle comes to: one row ``state, ended, target, carried, committed, done``.

    ``state``: ``live lease`` if a member in progress is held, ``no next cycle``
    if something has to be carried and no later open cycle is there, else
    ``closes``.  ``cycle`` is one row; ``others`` the calendar.
    """
    one = cycle.select("id", "start", "end")
    ended = F.least(F.greatest(today, F.col("start")), F.col("end"))
    facts = members.agg(
        F.count_if((F.col("category") == "active") & F.col("live")).alias("blocking"),
        F.count_if(F.col("category") != "done").alias("carried"),
        F.coalesce(F.sum(F.when(F.col("type").isin(*counted), F.col("points"))), F.lit(0)).alias("committed"),
        F.coalesce(F.sum(F.when(F.col("type").isin(*counted) & (F.col("category") == "done"), F.col("points"))), F.lit(0)).alias("done"),
    )
    later = others.filter("state <> 'closed'").crossJoin(F.broadcast(one.select(F.col("id").alias("_id"), F.col("start").alias("_start")))).filter((F.col("start") > F.col("_start")) & (F.col("id") != F.col("_id")))
    target = later.agg(F.min_by("id", F.struct("start", "id")).alias("target"))
    state = F.when(F.col("blocking") > 0, "live lease").when((F.col("carried") > 0) & F.col("target").isNull(), "no next cycle").otherwise("closes")
    rows = one.crossJoin(F.broadcast(facts)).crossJoin(F.broadcast(target))  # one row each
    closes = F.col("state") == "closes"
    return rows.withColumn("state", state).select("state", F.when(closes & (ended < F.col("end")), ended).alias("ended"), F.when(closes & (F.col("carried") > 0), F.col("target")).alias("target"), "carried", "committed", "done")


def ready_queue_low(ready: DataFrame, least: int) -> DataFrame:
    """One row ``ready, least`` if fewer tickets are ready than ``least``; 0 asks for nothing."""
    return ready.agg(F.count(F.lit(1)).alias("ready")).withColumn("least", F.lit(least)).filter((F.col("least") > 0) & (F.col("ready") < F.col("least")))


def over_limit(wip: DataFrame, limit: int) -> DataFrame:
    """The row of :func:`workflow.in_progress` if its standard work exceeds ``limit``."""
    return wip.filter(F.col("standard") > limit)


def shown_on_board(type: Column, category: Column, done_on: Column, today: Column, days: int = 7) -> Column:
    """Epics are not shown, done tickets for ``days`` days."""
    return (type != "epic") & F.coalesce((category != "done") | (F.datediff(today, done_on) <= days), F.lit(False))


def card_since(moves: DataFrame, tickets: DataFrame, order: list[str]) -> DataFrame:
    """``id, since``: when a ticket last went into its category, when it was created if it never moved there."""
    rows = moves.join(tickets.select(F.col("id").alias("ticket"), "category"), "ticket").filter("to = category")
    last = rows.groupBy(F.col("ticket").alias("id")).agg(F.max_by("at", F.struct(*order)).alias("at"))
    return tickets.join(last, "id", "left").select("id", F.coalesce("at", "created").alias("since"))


def slowest(stages: DataFrame, group: str, name: str, took: str) -> DataFrame:
    """The slowest stage of each group; of equals the first by name."""
    return stages.groupBy(group).agg(F.max_by(name, F.struct(F.col(took), F.col(name))).alias(name), F.max(took).alias(took))
