"""Planning analytics over folded state: velocity, capacity, greedy fill, boards, handles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capacity(cycles: DataFrame, points: str, window: int, k: float, min_history: int = 1, override: int | None = None) -> DataFrame:
    """``n, mean, deviation, capacity`` of the last ``window`` cycles; population deviation, capacity null (unenforced) below ``min_history``; ``override`` replaces it.

    ``cycles`` is a dimension of the calendar (a row a cycle), so one task orders it.
    """
    last = cycles.orderBy(F.desc("start"), F.desc("end")).limit(window)
    out = last.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(points), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(points), F.lit(0.0)).alias("deviation"))
    return out.withColumn("capacity", F.lit(override).cast("long") if override is not None else F.when(F.col("n") >= min_history, F.floor(F.greatest(F.lit(0.0), F.col("mean") - k * F.col("deviation")))))


def greedy_fill(items: DataFrame, group: str, order: list[str], size: str, limit: int) -> DataFrame:
    """Take items in order as long as they fit; one that does not is skipped and costs nothing.

    A skip depends on everything taken before, so it is a fold over the sorted
    items of a group, not a running sum.  Columns: ``group, item, picked``;
    a group must fit one row (a plan does).
    """
    packed = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(size).alias("_size"), F.col("item")))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.expr("cast(array() as array<boolean>)").alias("picks"))
    fits = lambda acc, x: acc["sum"] + x["_size"] <= limit
    step = lambda acc, x: F.struct((acc["sum"] + F.when(fits(acc, x), x["_size"]).otherwise(F.lit(0))).cast("long").alias("sum"), F.array_append(acc["picks"], fits(acc, x)).alias("picks"))
    done = packed.withColumn("p", F.aggregate("l", start, step)["picks"])
    return done.select(group, F.explode(F.arrays_zip("l", "p")).alias("r")).select(group, F.col("r.l.item").alias("item"), F.col("r.p").alias("picked"))


def columns_with_hidden(cards: DataFrame, column: str, order: list, most: int, whole: Column | None = None) -> DataFrame:
    """The first ``most`` cards of each column, with the number that is hidden; cards that are ``whole`` are never cut."""
    place = Window.partitionBy(column).orderBy(*order)
    if whole is None:
        counts = cards.groupBy(column).agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("hidden"))
        return cards.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most).join(counts, column)
    marked = cards.withColumn("_whole", F.coalesce(whole, F.lit(False))).withColumn("place", F.row_number().over(place))
    marked = marked.withColumn("_cut", (F.col("place") > most) & ~F.col("_whole"))
    return marked.withColumn("hidden", F.count_if("_cut").over(Window.partitionBy(column))).filter("not _cut").drop("_whole", "_cut")


def latest_into(events: DataFrame, key: str, state: str, order: list[str], at: str) -> DataFrame:
    """``key``, its current state and since when: the latest event that entered it."""
    position = F.struct(*order)
    w = Window.partitionBy(key).orderBy(*order)
    entered = events.withColumn("_before", F.lag(state).over(w)).filter(~F.col(state).eqNullSafe(F.col("_before")))
    return entered.groupBy(key).agg(F.max_by(state, position).alias(state), F.max_by(at, position).alias("since"))


def first_names(rows: DataFrame, group: list[str], name: str, most: int) -> DataFrame:
    """``group, first``: the least ``most`` names of each group; each task keeps no more of a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(name)
    few = rows.filter(F.col(name).isNotNull()).select(*group, name).distinct().withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= most)
    return few.groupBy(*group).agg(F.array_sort(F.collect_list(name)).alias("first"))
