"""Structured Streaming forms of the event fold."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_stream(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Last writer by ``order`` of each field, as a streaming aggregation (complete or update mode).

    Order is by key, not by arrival, so late events are folded wherever they
    belong and no lateness bound applies.
    """
    position = F.struct(*order)
    return events.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), position)).alias(f) for f in fields))
