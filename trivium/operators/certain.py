"""Joins that keep uncertainty: an absent or undecided partner is never a clean answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.functions import truth as T


def exists(outer: DataFrame, inner: DataFrame, on: list[str], holds: Column, name: str = "truth") -> DataFrame:
    """Semi join with certainty: ``outer`` with the strongest truth of its partners, no if it has none."""
    best = inner.select(*on, holds.alias("_t")).groupBy(*on).agg(F.max("_t").alias("_t"))
    return outer.join(best, on, "left").withColumn(name, F.coalesce("_t", T.truth(T.NO)).cast("tinyint")).drop("_t")


def absent(outer: DataFrame, inner: DataFrame, on: list[str], holds: Column, name: str = "truth") -> DataFrame:
    """Anti join with certainty: 2 minus :func:`exists`."""
    return exists(outer, inner, on, holds, name).withColumn(name, T.negate(F.col(name)))


def count_bounds(outer: DataFrame, inner: DataFrame, on: list[str], holds: Column) -> DataFrame:
    """``outer`` with ``lo`` (partners that hold) and ``hi`` (partners that may)."""
    n = inner.select(*on, holds.alias("_t")).groupBy(*on).agg(T.lower_count(F.col("_t")).alias("lo"), T.upper_count(F.col("_t")).alias("hi"))
    return outer.join(n, on, "left").fillna(0, ["lo", "hi"])


def keyed_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: Added, Deleted or Modified."""
    o, n = old.select(key, F.col(value).alias("_o"), F.lit(True).alias("_in_old")), new.select(key, F.col(value).alias("_n"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "Added").when(F.col("_in_new").isNull(), "Deleted").when(~F.col("_o").eqNullSafe(F.col("_n")), "Modified")
    return o.join(n, key, "full").select(key, change.alias("change")).filter("change is not null")


def last_write(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Fold of an event log: of each field the last value in ``order``, whatever the order of arrival."""
    position = F.struct(*order)
    return events.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), position)).alias(f) for f in fields))


def owners(candidates: DataFrame, item: str = "item", entity: str = "entity", specificity: str = "specificity", must: str = "must") -> DataFrame:
    """Who owns an item, over all possible worlds: ``item, status, owners``.

    Candidates are (item, entity, specificity, must).  At most one certain
    owner above all others: must.  Two certain owners tied at the top:
    unknown, with all that stand there.  Else: every candidate that no certain
    candidate of another entity dominates, as may.
    """
    top = candidates.groupBy(item).agg(F.max(F.when(F.col(must), F.col(specificity))).alias("m"), F.max(specificity).alias("high"))
    rows = candidates.join(top, item)
    at_top = F.col(must) & (F.col(specificity) == F.col("m"))
    per = rows.groupBy(item).agg(
        F.first("m").alias("m"),
        F.first("high").alias("high"),
        F.count_distinct(F.when(at_top, F.col(entity))).alias("n_top"),
        F.max(F.when(at_top, F.col(entity))).alias("x"),
    )
    rows = rows.join(per.select(item, "n_top", "x"), item)
    # The strongest certain candidate of another entity than x: what can dominate x itself.
    second = rows.filter(F.col(must) & (F.col(entity) != F.col("x"))).groupBy(item).agg(F.max(specificity).alias("m2"))
    rows = rows.join(second, item, "left")
    rival = F.max(F.when(F.col(entity) != F.col("x"), F.col(specificity))).alias("rival")
    dominated = F.col("m").isNotNull() & (
        ((F.col(entity) != F.col("x")) & (F.col("m") > F.col(specificity))) | ((F.col(entity) == F.col("x")) & F.when(F.col("n_top") > 1, F.col("m") > F.col(specificity)).otherwise(F.coalesce(F.col("m2") > F.col(specificity), F.lit(False))))
    )
    names = lambda condition: F.array_sort(F.collect_set(F.when(condition, F.col(entity))))
    out = rows.groupBy(item).agg(F.first("m").alias("m"), F.first("high").alias("high"), F.first("n_top").alias("n_top"), F.first("x").alias("x"), rival, names(F.lit(True)).alias("all"), names(F.col(specificity) == F.col("m")).alias("tied"), names(~dominated).alias("open"))
    must_x = (F.col("n_top") == 1) & (F.col("rival").isNull() | (F.col("rival") < F.col("m")))
    tie = (F.col("n_top") > 1) & (F.col("high") == F.col("m"))
    status = F.when(F.col("m").isNull(), "May").when(tie, "Unknown").when(must_x, "Must").otherwise("May")
    who = F.when(F.col("m").isNull(), F.col("all")).when(tie, F.col("tied")).when(must_x, F.array("x")).otherwise(F.col("open"))
    return out.select(item, status.alias("status"), who.alias("owners"))
