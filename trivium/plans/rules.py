"""Verdicts by polarity: violation, clean or unresolved, and never clean by default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.operators import planning

SEVERITIES = ("error", "warn", "advisory", "unresolved")


def _list(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(v)) for c, v in pairs)), lambda x: x.isNotNull())


def verdicts(polarity: str, lo: Column, hi: Column, threshold: int | None = None) -> Column:
    """Verdicts of a subject from the certain (``lo``) and possible (``hi``) count of what the rule looks for.

    P+: any is a violation; what may be is unresolved besides.  P-: none is a
    violation.  Pn max / Pn min: the count against ``threshold``.  P0 and Pc
    look for one thing (a difference, a cycle): certain is a violation,
    possible unresolved.
    """
    if polarity in ("P0", "Pc"):
        return _list((lo > 0, "Violation"), (hi == 0, "Clean"), ((lo == 0) & (hi > 0), "Unresolved"))
    if polarity == "P+":
        return _list((lo > 0, "Violation"), ((lo == 0) & (hi == lo), "Clean"), (hi > lo, "Unresolved"))
    if polarity == "P-":
        return _list((hi == 0, "Violation"), (lo > 0, "Clean"), ((lo == 0) & (hi > 0), "Unresolved"))
    if threshold is None:
        raise ValueError(f"{polarity} needs a threshold")
    if polarity == "Pn max":
        return _list((lo > threshold, "Violation"), (hi <= threshold, "Clean"), ((lo <= threshold) & (hi > threshold), "Unresolved"))
    if polarity == "Pn min":
        return _list((hi < threshold, "Violation"), (lo >= threshold, "Clean"), ((hi >= threshold) & (lo < threshold), "Unresolved"))
    raise ValueError(polarity)


def judge(subjects: DataFrame, polarity: str, threshold: int | None = None) -> DataFrame:
    """Subjects with ``lo`` and ``hi``: one row a subject and verdict."""
    return subjects.withColumn("verdict", F.explode(verdicts(polarity, F.col("lo"), F.col("hi"), threshold)))


def equality(left: Column, right: Column) -> Column:
    """P0: do two values agree?  An unknown (null) side is unresolved."""
    return F.when(left.isNull() | right.isNull(), "Unresolved").when(left == right, "Clean").otherwise("Violation")


def account(judged: DataFrame, subject: list[str], must_measure: bool = False) -> DataFrame:
    """Totals of a rule; with no subject at all it is vacuous, which is unresolved and, with ``must_measure``, required."""
    each = judged.groupBy(*subject).agg(F.max(F.col("verdict") == "Violation").alias("v"), F.max(F.col("verdict") == "Unresolved").alias("u"))
    totals = each.agg(F.count(F.lit(1)).alias("subjects"), F.count_if("v").alias("violations"), F.count_if("u").alias("unresolved"))
    state = F.when(F.col("violations") > 0, F.lit(0)).when((F.col("unresolved") > 0) | (F.col("subjects") == 0), F.lit(1)).otherwise(F.lit(2))
    return totals.withColumn("truth", state.cast("tinyint")).withColumn("vacuous", F.col("subjects") == 0).withColumn("required", F.col("vacuous") & F.lit(must_measure))


def rollup(judged: DataFrame, group: list[str], name: str) -> DataFrame:
    """Unresolved subjects of each group: how many, and the first three names."""
    rows = judged.filter("verdict = 'Unresolved'")
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    first = planning.first_names(rows, group, name, 3).withColumnRenamed("first", "names")
    return counts.join(first, group).withColumn("names", F.array_join("names", ","))


def taint(kind: Column, poisoned: Column) -> Column:
    """The kind of an observation: what was computed exactly through something unresolved is unknown; bounds are trusted."""
    return F.when(poisoned & (kind == "Exact"), "Unknown").otherwise(kind)


def examine(subjects: DataFrame, polarity: str, threshold: int | None = None) -> DataFrame:
    """``subject, verdict, reason, examined`` of every subject of a rule.

    ``subjects``: ``subject, selected`` (2 certainly a subject, 1 perhaps),
    ``unseen`` (why nothing can look into it, or null), ``kind`` (Exact, Bounds,
    Unknown, NotApplicable), ``lo, hi, poisoned, reason``.  What is only perhaps
    a subject, or cannot be seen, is unresolved and not examined; an unknown
    observation is unresolved, though examined.
    """
    kind = taint(F.col("kind"), F.coalesce("poisoned", F.lit(False)))
    listed = (
        F.when(F.col("selected") < 2, F.array(F.lit("Unresolved")))
        .when(F.col("unseen").isNotNull(), F.array(F.lit("Unresolved")))
        .when(kind == "NotApplicable", F.array(F.lit("NotApplicable")))
        .when(kind == "Unknown", F.array(F.lit("Unresolved")))
        .otherwise(verdicts(polarity, F.col("lo"), F.col("hi"), threshold))
    )
    seen = (F.col("selected") == 2) & F.col("unseen").isNull() & (kind != "NotApplicable")
    rows = subjects.filter("selected > 0").select("subject", F.explode(listed).alias("verdict"), F.col("unseen"), F.col("selected"), F.col("reason").alias("_reason"), seen.alias("examined"))
    reason = F.when(F.col("selected") < 2, "unknown").when(F.col("unseen").isNotNull(), F.col("unseen")).otherwise(F.coalesce("_reason", F.lit("unknown")))
    return rows.select("subject", "verdict", F.when(F.col("verdict") == "Unresolved", reason).alias("reason"), "examined")


def conclude(examined: DataFrame, must_measure: bool = False) -> DataFrame:
    """One row of accounting: ``subjects, examined, violations, unresolved, vacuous, required, truth``.

    Subjects to which the rule does not apply do not count; if it applies to
    none of those there are, nothing is reported.  A rule that examined nothing
    and left nothing unresolved is vacuous; one that must measure and examined
    nothing is required.
    """
    each = examined.groupBy("subject").agg(F.max(F.col("verdict") == "Violation").alias("v"), F.max(F.col("verdict") == "Unresolved").alias("u"), F.max(F.col("verdict") == "NotApplicable").alias("na"), F.max("examined").alias("e"))
    out = each.agg(F.count_if(~F.col("na")).alias("subjects"), F.count_if("e").alias("examined"), F.count_if("v").alias("violations"), F.count_if("u").alias("unresolved"), F.count(F.lit(1)).alias("_all"))
    silent = (F.col("_all") > 0) & (F.col("subjects") == 0)
    vacuous = ~silent & (F.col("examined") == 0) & (F.col("unresolved") == 0)
    out = out.withColumn("vacuous", vacuous).withColumn("required", ~silent & (F.col("examined") == 0) & F.lit(must_measure))
    state = F.when(F.col("violations") > 0, 0).when((F.col("unresolved") > 0) | F.col("vacuous") | silent, 1).otherwise(2)
    return out.withColumn("truth", state.cast("tinyint")).drop("_all")


def tally(findings: DataFrame, *by: str) -> DataFrame:
    """Findings by severity."""
    return findings.groupBy(*by).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def gate(findings: DataFrame, fail_on: str, fail_on_unresolved: bool = False) -> DataFrame:
    """One row ``failed``: does a finding reach ``fail_on``, or a required one stay unresolved where that fails too?"""
    rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)))
    bad = (F.col("severity") != "unresolved") & (rank <= SEVERITIES.index(fail_on))
    if fail_on_unresolved:
        bad = bad | ((F.col("severity") == "unresolved") & F.col("required").isNotNull())
    return findings.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"))


def unmeasured(rules: DataFrame, verdicts: DataFrame, rule: str = "rule") -> DataFrame:
    """Rules that examined no subject at all."""
    return rules.join(verdicts.select(rule).distinct(), rule, "left_anti")
