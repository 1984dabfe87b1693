"""Kleene truth as TINYINT: 0 no, 1 unknown, 2 yes; never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NO, UNKNOWN, YES = 0, 1, 2


def truth(value: int) -> Column:
    return F.lit(value).cast("tinyint")


def lift(condition: Column) -> Column:
    """A SQL condition as truth: null is unknown."""
    return F.when(condition.isNull(), truth(UNKNOWN)).when(condition, truth(YES)).otherwise(truth(NO))


def both(*terms: Column) -> Column:
    return F.least(*terms) if len(terms) > 1 else reduce(lambda a, _: a, terms) if terms else truth(YES)


def either(*terms: Column) -> Column:
    return F.greatest(*terms) if len(terms) > 1 else reduce(lambda a, _: a, terms) if terms else truth(NO)


def negate(term: Column) -> Column:
    return (F.lit(2) - term).cast("tinyint")


def some(term: Column) -> Column:
    """Aggregate: does any row hold?  No rows: no."""
    return F.coalesce(F.max(term), truth(NO)).cast("tinyint")


def none(term: Column) -> Column:
    return negate(some(term))


def every(term: Column) -> Column:
    """Aggregate: do all rows hold?  No rows: yes."""
    return F.coalesce(F.min(term), truth(YES)).cast("tinyint")


def lower_count(term: Column) -> Column:
    return F.count_if(term == YES)


def upper_count(term: Column) -> Column:
    return F.count_if(term >= UNKNOWN)
