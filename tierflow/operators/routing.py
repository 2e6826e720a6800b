"""Which target a chunk goes to, and where it is read from again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import any_pii
from .catalog import latest


def pick(targets: Column, index: Column) -> Column:
    """Target at an index, or the first where there are not as many."""
    return F.coalesce(F.get(targets, index), F.get(targets, 0))


def route_pii(df: DataFrame, text: str, targets: Column) -> DataFrame:
    """Personal data to the first target, other chunks to the second."""
    return df.withColumn("target_id", pick(targets, F.when(any_pii(F.col(text)), 0).otherwise(1)))


def route_by_tag(df: DataFrame, count: Column, targets: Column) -> DataFrame:
    """A count tag of 0, or none, to the first target, others to the second."""
    return df.withColumn("target_id", pick(targets, F.when(F.coalesce(count.try_cast("int"), F.lit(0)) == 0, 0).otherwise(1)))


def update_locations(locations: DataFrame, routed: DataFrame) -> DataFrame:
    """``(uri, target_id, seq)``: the last target of each uri."""
    return latest(locations.select("uri", "target_id", "seq").unionByName(routed.select("uri", "target_id", "seq")), ["uri"], "seq")


def locate(requests: DataFrame, locations: DataFrame, default: str = "default") -> DataFrame:
    j = requests.join(locations.select("uri", "target_id"), "uri", "left")
    return j.withColumn("target_id", F.coalesce("target_id", F.lit(default)))


def resolve_read(requests: DataFrame, cache: DataFrame, locations: DataFrame, default: str = "default") -> DataFrame:
    """Adds what serves a read: the local copy, the routed target, or the default storage."""
    c = cache.select("uri").distinct().withColumn("_cached", F.lit(True))
    j = requests.join(c, "uri", "left").join(locations.select("uri", "target_id"), "uri", "left")
    source = F.when(F.col("_cached"), "cache").when(F.col("target_id").isNotNull(), "routed").otherwise("default")
    return j.select(*requests.columns, source.alias("source"), F.when(source == "routed", F.col("target_id")).when(source == "default", F.lit(default)).alias("served_by"))
