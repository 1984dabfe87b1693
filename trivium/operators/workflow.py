"""Decisions over plans of work: cycles, assignment, work in progress, leases, locks, changelogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.operators import planning


def cycle_state(state: Column, start: Column, today: Column) -> Column:
    """Closed once folded so, planned before its start, else active; nothing is overdue."""
    return F.when(state == "closed", "closed").when(today < start, "planned").otherwise("active")


def effective_end(end: Column, ended: Column) -> Column:
    return F.coalesce(ended, end)


def default_cycle(cycles: DataFrame, today: Column) -> DataFrame:
    """The open cycle that holds today, else the open one with the earliest later start: one row, or none."""
    holds = (F.col("start") <= today) & (today <= effective_end(F.col("end"), F.col("ended")))
    open_ = cycles.filter(F.coalesce(F.col("state"), F.lit("")) != "closed").filter(holds | (F.col("start") > today))
    return open_.agg(F.min_by("id", F.struct((~holds).alias("h"), F.col("start"), F.col("id"))).alias("id")).filter("id is not null")


def commitment(members: DataFrame, cycle: str, points: str, finished: Column) -> DataFrame:
    """``committed, done, ratio`` of each cycle: all members' points, those of finished ones, null if nothing was committed."""
    p = F.coalesce(F.col(points), F.lit(0))
    out = members.groupBy(cycle).agg(F.sum(p).alias("committed"), F.sum(F.when(finished, p).otherwise(0)).alias("done"))
    return out.withColumn("ratio", F.when(F.col("committed") > 0, F.col("done") / F.col("committed")))


def assignment(member: Column, closed: Column, epic: Column, points: Column, counted: Column, committed: Column, limit: Column, over_commit: bool = False) -> Column:
    """What assigning a ticket to a cycle comes to; the first obstacle decides."""
    total = committed + F.when(counted, points).otherwise(0)
    over = F.lit(not over_commit) & F.coalesce(total > limit, F.lit(False))
    return F.when(member, "already").when(closed, "closed").when(epic, "epic").when(points.isNull(), "unsized").when(over, "over capacity").otherwise("add")


def in_progress(tickets: DataFrame, live: DataFrame, key: str, expedite: Column) -> DataFrame:
    """One row ``standard, expedite, stale``: a ticket whose lease has run out is stale and counts against no limit."""
    held = tickets.join(live.select(key).distinct().withColumn("_live", F.lit(True)), key, "left")
    is_live = F.coalesce(F.col("_live"), F.lit(False))
    return held.agg(F.count_if(is_live & ~expedite).alias("standard"), F.count_if(is_live & expedite).alias("expedite"), F.count_if(~is_live).alias("stale"))


def is_live(now: Column, renewed: Column, ttl_seconds: Column) -> Column:
    return now < F.timestamp_seconds(F.unix_micros(renewed) / 1_000_000 + ttl_seconds)


def contention(holdings: DataFrame, item: str, holder: str, shown: int = 5) -> DataFrame:
    """``item, holders, first``: what more than one holder holds; the most contended first when ordered by holders."""
    rows = holdings.select(item, holder).distinct()
    several = rows.groupBy(item).agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    return several.join(planning.first_names(rows, [item], holder, shown), item)


def outside(paths: DataFrame, path: str, allowed: Column) -> DataFrame:
    """Paths that nothing allows; a pattern that cannot be read matches nothing."""
    return paths.filter(~F.coalesce(allowed, F.lit(False)))


def ack_plan(current: DataFrame, lock: DataFrame, key: str, facets: list[str], stale_format: bool = False, every: bool = False, reason: str | None = None) -> DataFrame:
    """``key, step``: what acknowledging the current facets does to a lock.

    New and changed entries are acked, equal ones skipped (``same``).  A lock of
    a stale format is only written anew as a whole and with a reason: then
    present entries are ``reattested`` and vanished ones ``dropped``.
    """
    if stale_format and not (every and reason):
        raise ValueError("a lock of a stale format is acknowledged as a whole, with a reason")
    side = lambda df, mark: df.select(key, F.struct(*facets).alias(mark))
    both = side(current, "_c").join(side(lock, "_l"), key, "full")
    equal = F.col("_c").eqNullSafe(F.col("_l"))
    gone = F.col("_c").isNull()
    step = F.when(gone, "dropped" if stale_format else "kept").when(F.col("_l").isNull(), "acked").when(equal, "reattested" if stale_format else "same").otherwise("acked")
    return both.select(key, step.alias("step"))


def sections(fragments: DataFrame, products: list[str], kinds: list[str]) -> DataFrame:
    """``product, kind, place, entries`` of a changelog: products and kinds in the given order, entries by id, no empty group.

    The entries of a section are collected: a changelog is read by people.
    """
    spark = fragments.sparkSession
    order = lambda names, c: F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{c} string, _{c} int"))
    known = fragments.join(order(products, "product"), "product").join(order(kinds, "kind"), "kind")
    groups = known.groupBy("product", "kind", "_product", "_kind").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("e"))
    return groups.select("product", "kind", (F.col("_product") * len(kinds) + F.col("_kind")).alias("place"), F.transform("e", lambda x: x["text"]).alias("entries"))


def remap_positions(edits: DataFrame, asked: DataFrame, key: str, order: str) -> DataFrame:
    """``asked`` (``key, since, position``) with where each position is now, null once it was removed.

    ``edits`` hold ``key, order, moved``: element i of ``moved`` is the new position of i, 0 if it was
    removed; an edit without a map loses track.  Edits up to ``since`` do not count.  The edits of one
    key are folded in order (people made them, so they are few).
    """
    log = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("moved").alias("m")))).alias("_log"))
    later = F.filter(F.coalesce(F.col("_log"), F.array().cast(log.schema["_log"].dataType)), lambda e: e["o"] > F.col("since"))
    step = lambda at, e: F.when(at.isNull() | e["m"].isNull() | (at > F.size(e["m"])), F.lit(None).cast("int")).otherwise(F.nullif(F.get(e["m"], at - 1), F.lit(0)))
    return asked.join(log, key, "left").withColumn("now", F.aggregate(later, F.col("position").cast("int"), step)).drop("_log")


def assignment_plan(tickets: DataFrame, target: str, cycles: DataFrame, members: DataFrame, counted: tuple[str, ...], limit: Column, over_commit: bool = False) -> DataFrame:
    """``id, outcome, moved_from, committed, over_commit``: what assigning each ticket (``id, type, points``) alone to the cycle ``target`` comes to.

    ``cycles`` hold ``id, start, state``, ``members`` ``cycle, id, type, points``.  A ticket that is added leaves
    the first other cycle (by start) that is not closed and has it.
    """
    open_ = cycles.filter(~F.coalesce(F.col("state") == "closed", F.lit(False))).filter(F.col("id") != target).select(F.col("id").alias("cycle"), "start")
    left = members.join(open_, "cycle").groupBy("id").agg(F.min_by("cycle", F.struct("start", "cycle")).alias("_from"))
    own = members.filter(F.col("cycle") == target)
    here = own.select("id").distinct().withColumn("_member", F.lit(True))
    # One row: what the target is and has.
    state = cycles.filter(F.col("id") == target).agg(F.coalesce(F.bool_or(F.col("state") == "closed"), F.lit(False)).alias("_closed"))
    sums = own.agg(F.coalesce(F.sum(F.when(F.col("type").isin(*counted), F.col("points"))), F.lit(0)).alias("_held"))
    rows = tickets.join(here, "id", "left").join(left, "id", "left").crossJoin(F.broadcast(state)).crossJoin(F.broadcast(sums))
    counts = F.col("type").isin(*counted)
    outcome = assignment(F.coalesce("_member", F.lit(False)), F.col("_closed"), F.col("type") == "epic", F.col("points"), counts, F.col("_held"), limit, over_commit)
    total = F.col("_held") + F.when(counts, F.col("points")).otherwise(0)
    adds = F.col("outcome") == "add"
    return rows.withColumn("outcome", outcome).select("id", "outcome", F.when(adds, F.col("_from")).alias("moved_from"), F.when(adds, total).cast("long").alias("committed"), (adds & F.coalesce(total > limit, F.lit(False))).alias("over_commit"))


def fidelity(artifacts: DataFrame, by: str, examined: Column, partial: Column, level: str) -> DataFrame:
    """Files, examined files, partly parsed files and the best fidelity of each language."""
    return artifacts.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.count_if(examined).alias("examined"), F.count_if(partial).alias("partial"), F.max(level).alias("best"))


def close_guards(bound: Column, bypass: Column, needs_criteria: Column, open_children: Column, open_blockers: Column) -> Column:
    """What keeps a ticket from being closed: unbound criteria (unless bypassed), missing ones, open children, open blockers.

    ``bound`` is an array of booleans, one a criterion.
    """
    guards = F.array(
        F.when(~bypass & F.exists(bound, lambda b: ~F.coalesce(b, F.lit(False))), "unbound criteria"),
        F.when(~bypass & needs_criteria & (F.size(bound) <= 0), "no criteria"),
        F.when(open_children > 0, "open children"),
        F.when(open_blockers > 0, "open blockers"),
    )
    return F.filter(guards, lambda g: g.isNotNull())
