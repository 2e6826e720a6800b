"""Policies: which steps and targets apply to a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

STEP = "struct<pos:int,id:string,execute_on:string,hardware:string,local:boolean,transforms:boolean,routes:boolean,region:string,arguments:array<string>>"
POLICY = f"id string, system string, scope string, stream string, steps array<{STEP}>, storage array<string>"
#: Policies are configuration; more rows than this are joined without a broadcast.
BROADCAST_ROWS = 20_000
REGIONS = ["EDGE", "CLOUD"]


def policies(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, POLICY)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def resolve_policy(chunks: DataFrame, pol: DataFrame) -> DataFrame:
    """Adds ``policy_id``: exact scope and stream, else by pattern, else exact scope, else scope by pattern.

    ``*`` in a policy is any run and the rest a regular expression on the whole
    name. Of equals the least policy id wins. Each distinct stream is matched
    once against the policies, and chunks get the result by an equi-join.
    """
    streams = chunks.select("system", "scope", "stream").distinct()
    p = pol.select("id", F.lower("system").alias("p_system"), F.col("scope").alias("ps"), F.col("stream").alias("pt"))
    like = lambda a, b: F.expr(f"{b} rlike concat('^(?:', replace({a}, '*', '.*'), ')$')")
    no_stream = F.coalesce(F.col("pt"), F.lit("")) == ""
    tier = (
        F.when((F.col("ps") == F.col("scope")) & (F.col("pt") == F.col("stream")), 1)
        .when(~no_stream & like("ps", "scope") & like("pt", "stream"), 2)
        .when(no_stream & (F.col("ps") == F.col("scope")), 3)
        .when(no_stream & like("ps", "scope"), 4)
    )
    found = streams.join(_small(p), (F.lower("system") == F.col("p_system")) & tier.isNotNull()).withColumn("tier", tier)
    best = found.groupBy("system", "scope", "stream").agg(F.min(F.struct("tier", "id")).alias("b"))
    best = best.select(F.col("system").alias("_y"), F.col("scope").alias("_o"), F.col("stream").alias("_t"), F.col("b.id").alias("policy_id"), F.col("b.tier").alias("policy_tier"))
    on = F.col("system").eqNullSafe(F.col("_y")) & F.col("scope").eqNullSafe(F.col("_o")) & F.col("stream").eqNullSafe(F.col("_t"))
    return chunks.join(best, on, "left").drop("_y", "_o", "_t")


def steps(pol: DataFrame, region: str, op: str = "PUT") -> DataFrame:
    """Steps of a region in the order they run: backwards for GET."""
    s = pol.select(F.col("id").alias("policy_id"), F.explode("steps").alias("s")).select("policy_id", "s.*").where(F.col("region") == region)
    w = Window.partitionBy("policy_id").orderBy(F.col("pos") if op == "PUT" else F.desc("pos"))
    return s.withColumn("turn", F.row_number().over(w))


def applies(op: str) -> Column:
    """Whether a step runs for the operation; routing steps never run on GET."""
    ok = F.col("execute_on").isin("ALL", op)
    return ok & ~F.col("routes") if op == "GET" else ok


def policy_flags(pol: DataFrame, region: str, hardware: str, op: str) -> DataFrame:
    mine = F.filter("steps", lambda s: s.region == region)
    special = F.get(F.transform(F.filter(mine, lambda s: s.hardware != "NONE"), lambda s: s.hardware), 0)
    can = (F.size(mine) > 0) & (special.isNull() | (special == hardware))
    runs = F.exists(mine, lambda s: s.execute_on.isin("ALL", op) & (F.lit(op == "PUT") | ~s.routes))
    routers = F.filter("steps", lambda s: s.routes)
    return pol.select(
        F.col("id").alias("policy_id"), special.alias("special_hardware"), can.alias("can_execute"), (can & runs).alias("any_step"),
        (F.size(routers) > 0).alias("has_router"), F.get(F.transform(routers, lambda s: s.id), 0).alias("router_id"),
        F.exists(mine, lambda s: s.local).alias("has_local"), next_region(region).alias("next_region"))


def next_region(region: str) -> Column:
    later = REGIONS[REGIONS.index(region) + 1 :]
    return F.get(F.transform(F.filter("steps", lambda s: s.region.isin(later) if later else F.lit(False)), lambda s: s.region), 0)


def step_args(pol: DataFrame, name: str) -> DataFrame:
    return pol.select(F.col("id").alias("policy_id"), F.get(F.transform(F.filter("steps", lambda s: s.id.endswith(name)), lambda s: s.arguments), 0).alias("arguments"))


def policy_targets(pol: DataFrame, targets: DataFrame) -> DataFrame:
    t = pol.select(F.col("id").alias("policy_id"), F.posexplode("storage").alias("pos", "target_id"))
    return t.join(_small(targets.withColumnRenamed("id", "target_id")), "target_id").select("policy_id", "pos", "target_id", "path")


def _full(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.trim(c) != "", F.lit(False)) for c in columns])


def validate_functions(functions: DataFrame) -> DataFrame:
    """Adds ``valid`` to descriptors of functions: id, execute_on and hardware present."""
    return functions.withColumn("valid", _full("id", "execute_on", "hardware"))


def validate_workers(workers: DataFrame) -> DataFrame:
    """Adds ``valid`` to workers: endpoint, region and hardware present."""
    return workers.withColumn("valid", _full("endpoint", "region", "hardware"))


def validate(pol: DataFrame, reserved: str = "mock") -> DataFrame:
    """Adds ``valid``: system, scope, stream and steps present, id not reserved."""
    return pol.withColumn("valid", _full("id", "system", "scope", "stream") & (F.col("id") != reserved) & (F.size(F.coalesce("steps", F.array())) > 0))


def check_refs(pol: DataFrame, functions: DataFrame) -> DataFrame:
    """Steps whose function is not known."""
    s = pol.select(F.col("id").alias("policy_id"), F.explode("steps.id").alias("function"))
    return s.join(functions.select(F.col("id").alias("function")), "function", "left_anti").select("policy_id", "function")


def fallback_policy(df: DataFrame, tag: Column) -> DataFrame:
    """Objects without a policy but with a tag of applied transforms get one from the tag."""
    return df.withColumn("policy_source", F.when(F.col("policy_id").isNotNull(), "policy").when(F.coalesce(tag, F.lit("")) != "", "tag").otherwise("none"))


def with_fallback_policy(df: DataFrame, tag: Column) -> DataFrame:
    """Adds ``fallback``, the policy of an object that has none but a tag of applied steps: ``REGION:id`` by commas.

    Its steps are the tag's, in their order, for all operations, without hardware,
    routing or targets; its id is ``reserved`` of ``validate``. Null for other objects.
    """
    parts = F.transform(F.split(tag, ","), lambda x: F.trim(x))
    step = lambda x, i: F.struct(
        i.alias("pos"), F.substring_index(x, ":", -1).alias("id"), F.lit("ALL").alias("execute_on"), F.lit("NONE").alias("hardware"), F.lit(False).alias("local"),
        F.lit(True).alias("transforms"), F.lit(False).alias("routes"), F.upper(F.substring_index(x, ":", 1)).alias("region"), F.slice(F.array(x), 1, 0).alias("arguments"))
    made = F.struct(F.lit("mock").alias("id"), "system", "scope", "stream", F.transform(parts, step).alias("steps"))
    return df.withColumn("fallback", F.when(F.col("policy_id").isNull() & (F.coalesce(tag, F.lit("")) != ""), made))
