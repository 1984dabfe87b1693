"""Incremental evaluation: what depends on nothing that changed is not computed again.

A memo is two tables: ``results`` (a key and what was found for it) and
``reads`` (``key, input, digest``: what the evaluation of a key looked at, with
its digest then, null for an input that was not there).  A key is stale when
any of its reads differs from the inputs now; then it is evaluated anew and its
reads with it.  Failed evaluations answer but are never stored.

For joins and sums there are deltas: rows with ``_n``, how often they came or,
negative, went.  The delta of a join comes from the deltas of its sides, that
of sums from the delta of their rows, so a view follows a change at the cost of
the change.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT = "_n"


def stale(reads: DataFrame, inputs: DataFrame, key: list[str]) -> DataFrame:
    """The keys (each once) of which an input changed, went or came: ``inputs`` holds ``input, digest`` as they are now."""
    now = inputs.select("input", F.col("digest").alias("_now"))
    return reads.join(now, "input", "left").filter(~F.col("digest").eqNullSafe(F.col("_now"))).select(*key).distinct()


def refresh(results: DataFrame, reads: DataFrame, inputs: DataFrame, wanted: DataFrame, evaluate: Callable[[DataFrame], tuple[DataFrame, DataFrame]], key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The memo after a change, and the answer: ``results, reads, answer``.

    ``evaluate`` takes the keys that are wanted and not known and gives their
    results, with a boolean ``failed``, and their reads.  The answer holds
    each wanted key with ``failed`` and ``evaluated``; keys that nobody wants
    any more leave the memo.
    """
    asked = wanted.select(*key).distinct()
    old = stale(reads, inputs, key)
    valid = results.join(asked, key, "left_semi").join(old, key, "left_anti")
    todo = asked.join(valid.select(*key), key, "left_anti")
    fresh, fresh_reads = evaluate(todo)
    good = fresh.filter(~F.coalesce("failed", F.lit(True)))
    kept = valid.unionByName(good.drop("failed").select(*results.columns))
    held = reads.join(valid.select(*key).distinct(), key, "left_semi").unionByName(fresh_reads.join(good.select(*key).distinct(), key, "left_semi").select(*reads.columns))
    told = lambda rows, failed, evaluated: rows.withColumns({"failed": failed, "evaluated": F.lit(evaluated)})
    answer = told(valid, F.lit(False), False).unionByName(told(fresh, F.coalesce("failed", F.lit(True)), True))
    return kept, held, answer


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that came (``_n`` 1 or more) and went (negative) between two states of a table; rows may repeat."""
    both = old.withColumn(COUNT, F.lit(-1)).unionByName(new.withColumn(COUNT, F.lit(1)))
    return both.groupBy(*old.columns).agg(F.sum(COUNT).alias(COUNT)).filter(F.col(COUNT) != 0)


def consolidated(delta: DataFrame) -> DataFrame:
    """A delta with each row once; what cancels out is gone."""
    return delta.groupBy(*(c for c in delta.columns if c != COUNT)).agg(F.sum(COUNT).alias(COUNT)).filter(F.col(COUNT) != 0)


def joined(left: DataFrame, left_delta: DataFrame, right: DataFrame, right_delta: DataFrame, on: list[str]) -> DataFrame:
    """The delta of an inner join, from both sides before the change and their deltas: no row that did not change is joined to another that did not."""
    counted = lambda rows, name: (rows if COUNT in rows.columns else rows.withColumn(COUNT, F.lit(1))).withColumnRenamed(COUNT, name)
    pairs = [(left_delta, right), (left, right_delta), (left_delta, right_delta)]
    parts = [counted(a, "_l").join(counted(b, "_r"), on).withColumn(COUNT, (F.col("_l") * F.col("_r")).cast("long")).drop("_l", "_r") for a, b in pairs]
    return consolidated(reduce(DataFrame.unionByName, parts))


def summed(view: DataFrame, delta: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums after a change: ``view`` holds ``by``, ``rows`` and the names of ``sums`` (expressions over the rows, integers or decimals).

    A group without rows leaves the view.
    """
    moved = delta.groupBy(*by).agg(F.sum(COUNT).alias("rows"), *(F.sum(e * F.col(COUNT)).alias(n) for n, e in sums.items()))
    both = view.unionByName(moved.select(*view.columns))
    return both.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("rows", *sums))).filter(F.col("rows") != 0).select(*view.columns)


def sums_of(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """The view of :func:`summed` from scratch."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *(F.sum(e).alias(n) for n, e in sums.items()))
