"""Keyed differences between two states of the same facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.functions.truth import NO, UNKNOWN, YES, truth


def facet_changes(old: DataFrame, new: DataFrame, key: str, facets: list[str]) -> DataFrame:
    """``key, change, facets``: what was added, removed or changed, and in which facets; equal rows are left out."""
    side = lambda df, mark: df.select(key, F.struct(*facets).alias(mark))
    both = side(old, "_o").join(side(new, "_n"), key, "full")
    differ = F.filter(F.array(*(F.when(~F.col(f"_o.{f}").eqNullSafe(F.col(f"_n.{f}")), F.lit(f)) for f in facets)), lambda x: x.isNotNull())
    change = F.when(F.col("_o").isNull(), "Added").when(F.col("_n").isNull(), "Removed").when(F.size(differ) > 0, "Changed")
    return both.select(key, change.alias("change"), F.when(change == "Changed", differ).otherwise(F.array().cast("array<string>")).alias("facets")).filter("change is not null")


def lock_changes(old: DataFrame, new: DataFrame, key: str, facets: list[str], old_flows: DataFrame, new_flows: DataFrame, flow: str = "flow") -> DataFrame:
    """``what, key, change, facets``: entries of two lock files that differ, and flows, whose ends (``producer, consumer``) are their facets.

    Who acknowledged an entry, when and why is no difference.
    """
    entries = facet_changes(old, new, key, facets).select(F.lit("entry").alias("what"), F.col(key).cast("string").alias("key"), "change", "facets")
    flows = facet_changes(old_flows, new_flows, flow, ["producer", "consumer"])
    return entries.unionByName(flows.select(F.lit("flow").alias("what"), F.col(flow).cast("string").alias("key"), "change", F.array().cast("array<string>").alias("facets")))


def identity_delta(anchor_a: Column, content_a: Column, anchor_b: Column, content_b: Column) -> Column:
    """Unchanged, Modified, Renamed or Unrelated; unknown (null) content equals nothing."""
    same = F.coalesce(content_a == content_b, F.lit(False))
    return F.when((anchor_a == anchor_b) & same, "Unchanged").when(anchor_a == anchor_b, "Modified").when(same, "Renamed").otherwise("Unrelated")


def touched(base: DataFrame, now: DataFrame, key: str, digests: list[str], seen: Column) -> DataFrame:
    """``key, truth``: is a symbol new or one of its digests changed?  Unknown where nothing could read it (``seen`` false or null)."""
    old = base.select(key, F.struct(*(F.col(d) for d in digests)).alias("_o"))
    changed = F.lit(False)
    for d in digests:
        changed = changed | ~F.col(f"_o.{d}").eqNullSafe(F.col(d))
    state = F.when(~F.coalesce(seen, F.lit(False)), truth(UNKNOWN)).when(F.col("_o").isNull() | changed, truth(YES)).otherwise(truth(NO))
    return now.join(old, key, "left").select(key, state.alias("truth"))


def misses(inputs: DataFrame, memo: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs that no stored result answers."""
    return inputs.join(memo.select(*keys).distinct(), keys, "left_anti")


def merge_events(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Union of two logs by identifier; of an event that both hold, the first log's stays."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
