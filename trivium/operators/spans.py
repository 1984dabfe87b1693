"""Range joins within artifacts, as equi joins on bins: nothing is compared across a whole artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 4  # bins of one level are 2**STEP times as wide as those of the level below
LEVELS = 16


def _level(width: Column) -> Column:
    """The least level whose bins are at least as wide."""
    return F.least(F.lit(LEVELS - 1), F.ceil(F.log2(F.greatest(width, F.lit(1)).cast("double")) / STEP)).cast("int")


def _bin(position: Column, level: Column) -> Column:
    return F.floor(position / F.pow(F.lit(2.0), level * STEP)).cast("long")


def covers(inner: DataFrame, outer: DataFrame, on: list[str]) -> DataFrame:
    """Pairs ``inner, start, end`` x ``outer, from, to`` of one artifact (``on``) with from <= start and end <= to.

    An outer range lies in at most two bins of the level of its width; an inner
    one asks its start's bin on each level.  Ranges must be shorter than
    2**(STEP * (LEVELS - 1)).  Rows with a null bound cover and are covered by nothing.
    """
    wide = outer.withColumn("_level", _level(F.col("to") - F.col("from") + 1))
    wide = wide.withColumn("_bin", F.explode(F.array_distinct(F.array(_bin(F.col("from"), F.col("_level")), _bin(F.col("to"), F.col("_level"))))))
    asked = inner.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("_bin", _bin(F.col("start"), F.col("_level")))
    # Both sides hold several rows for each of theirs: neither goes whole to every executor.
    return asked.join(wide.hint("merge"), [*on, "_level", "_bin"]).filter((F.col("from") <= F.col("start")) & (F.col("end") <= F.col("to"))).drop("_level", "_bin")


def tightest(inner: DataFrame, outer: DataFrame, on: list[str], key: str, name: str) -> DataFrame:
    """``inner`` with the narrowest ``outer`` range around it (ties to the least ``name``), null if there is none."""
    best = covers(inner, outer, on).groupBy(key).agg(F.min_by(name, F.struct((F.col("to") - F.col("from")).alias("w"), F.col(name))).alias(name))
    return inner.join(best, key, "left")


def bind(directives: DataFrame, symbols: DataFrame, on: list[str], key: str, name: str, tolerance: int) -> DataFrame:
    """The symbol each directive (``key, line``) speaks of.

    The first symbol (``name, from, to``) that starts after it within
    ``tolerance`` lines, the outermost of those that start together; else the
    narrowest around it; else null.  The search ahead is an equi join on two
    bins as wide as the tolerance.
    """
    ahead = directives.withColumn("_bin", F.explode(F.array(*(F.floor(F.col("line") / tolerance) + i for i in (0, 1)))))
    near = ahead.join(symbols.withColumn("_bin", F.floor(F.col("from") / tolerance)), [*on, "_bin"])
    near = near.filter((F.col("from") > F.col("line")) & (F.col("from") <= F.col("line") + tolerance))
    order = F.struct(F.col("from"), (F.col("from") - F.col("to")).alias("w"), F.col(name))
    first = near.groupBy(key).agg(F.min_by(name, order).alias("_first"))
    point = directives.withColumn("start", F.col("line")).withColumn("end", F.col("line"))
    around = tightest(point, symbols, on, key, name)
    return around.join(first, key, "left").withColumn(name, F.coalesce("_first", name)).drop("_first", "start", "end")


def unadjoined(rows: DataFrame, owners: DataFrame, on: list[str], line: str, reach: int = 1) -> DataFrame:
    """Rows that no owner stands beside: on the same line or at most ``reach`` lines above."""
    lines = owners.select(*on, F.explode(F.sequence(F.col(line), F.col(line) + reach)).alias(line)).distinct()
    return rows.join(lines, [*on, line], "left_anti")
