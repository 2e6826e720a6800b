"""Where a chunk is processed: ring owners, workers, routes, shards, liveness."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .policy import _small, policy_flags, REGIONS

_MAX = (1 << 63) - 1


def ring_points(nodes: list[str], virtual: int = 5) -> list[tuple[int, str]]:
    """Points of a hash ring, sorted; a taken point moves on by one."""
    ring: dict[int, str] = {}
    for node in nodes:
        for i in range(virtual):
            h = int.from_bytes(hashlib.md5(f"{node}:{i}".encode()).digest()[:8], "big") & _MAX
            while h in ring:
                h = (h + 1) & _MAX
            ring[h] = node
    return sorted(ring.items())


def ring_hash(key: Column) -> Column:
    """First 8 bytes of the MD5, sign bit cleared."""
    head = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return F.call_function("shiftleft", head % (1 << 31), F.lit(32)) + F.conv(F.substring(F.md5(key), 9, 8), 16, 10).cast("long")


def ring_owner(key: Column, nodes: list[str], virtual: int = 5) -> Column:
    """Node of the first point at or after the key's hash, else of the first point; the ring is a constant."""
    points = ring_points(nodes, virtual)
    hashes, owners = F.array(*[F.lit(p) for p, _ in points]), F.array(*[F.lit(n) for _, n in points])
    before = F.size(F.filter(hashes, lambda p: p < ring_hash(key)))
    return F.when(key.isNotNull(), F.get(owners, before % len(points)))


def ring_balance(df: DataFrame, key: str, nodes: list[str], virtual: int = 5) -> DataFrame:
    slots = {n: 0 for n in nodes} | {n: sum(o == n for _, o in ring_points(nodes, virtual)) for n in nodes}
    per = F.create_map(*[F.lit(x) for kv in slots.items() for x in kv])
    return df.groupBy(ring_owner(F.col(key), nodes, virtual).alias("node")).agg(F.count("*").alias("keys")).withColumn("slots", per[F.col("node")].cast("int"))


def find_worker(need: DataFrame, workers: DataFrame) -> DataFrame:
    """Adds ``endpoint``: the first worker by name in ``region`` with the ``required`` hardware (NONE: any), or null."""
    w = _small(workers.select(F.col("endpoint").alias("w_endpoint"), F.col("region").alias("w_region"), F.col("hardware").alias("w_hardware")))
    keys = need.select("region", "required").distinct()
    hit = keys.join(w, (F.col("w_region") == F.col("region")) & ((F.col("required") == "NONE") | (F.col("w_hardware") == F.col("required"))))
    best = hit.groupBy(F.col("region").alias("_r"), F.col("required").alias("_h")).agg(F.min("w_endpoint").alias("endpoint"))
    return need.join(best, need.region.eqNullSafe(best._r) & need.required.eqNullSafe(best._h), "left").drop("_r", "_h")


def _special(region: str) -> Column:
    return F.get(F.transform(F.filter("steps", lambda s: (s.region == region) & (s.hardware != "NONE")), lambda s: s.hardware), 0)


def route_plan(chunks: DataFrame, pol: DataFrame, workers: DataFrame, nodes: list[str], region: str, hardware: str, this_node: str) -> DataFrame:
    """Adds decision and endpoint for chunks ``(policy_id, partition_uri)``.

    REROUTE to the partition's owner where this region has a step bound to its
    partition and this worker could run it; else INTER_REGION or INTRA_REGION to a
    suitable worker, NO_SUITABLE_WORKER, or STORE. ``unprocessed`` marks a last
    region that lacks a step's hardware.
    """
    flags = policy_flags(pol, region, hardware, "PUT")
    mine = F.filter("steps", lambda s: s.region == region)
    lacking = pol.select(F.col("id").alias("policy_id"), (F.size(mine) == 0).alias("empty"),
                         F.get(F.transform(F.filter(mine, lambda s: (s.hardware != "NONE") & (s.hardware != hardware)), lambda s: s.hardware), 0).alias("lack"),
                         *[F.coalesce(_special(r), F.lit("NONE")).alias(f"need_{r}") for r in REGIONS])
    f = flags.join(lacking, "policy_id")
    kind = F.when(F.col("next_region").isNull(), "STORE").when(F.col("empty") | F.col("can_execute"), "INTER_REGION").otherwise("INTRA_REGION")
    next_need = F.coalesce(*[F.when(F.col("next_region") == r, F.col(f"need_{r}")) for r in REGIONS])
    f = f.withColumn("kind", kind).withColumn("region", F.when(F.col("kind") == "INTER_REGION", F.col("next_region")).when(F.col("kind") == "INTRA_REGION", region))
    f = f.withColumn("required", F.when(F.col("kind") == "INTER_REGION", next_need).when(F.col("kind") == "INTRA_REGION", F.col("lack")))
    f = find_worker(f, workers).select("policy_id", "kind", "endpoint", "has_local", "can_execute", "empty")
    owner = ring_owner(F.col("partition_uri"), nodes)
    out = chunks.join(_small(f), "policy_id", "left").withColumn("owner", owner)
    away = F.col("has_local") & (F.col("owner") != this_node) & F.col("kind").isin("INTER_REGION", "STORE")
    decision = F.when(F.col("kind").isNull(), "STORE").when(away, "REROUTE").when(F.col("kind") == "STORE", "STORE").when(F.col("endpoint").isNull(), "NO_SUITABLE_WORKER").otherwise(F.col("kind"))
    out = out.withColumn("decision", decision)
    to = F.when(F.col("decision") == "REROUTE", F.col("owner")).when(F.col("decision").isin("INTER_REGION", "INTRA_REGION"), F.col("endpoint"))
    out = out.withColumn("next", F.concat(F.regexp_replace(to, "/$", ""), F.lit("/"))).withColumn("unprocessed", F.coalesce((F.col("decision") == "STORE") & ~F.col("empty") & ~F.col("can_execute"), F.lit(False)))
    return out.select(*chunks.columns, "decision", "next", "unprocessed")


def assign_shard(df: DataFrame, key: str, n: int, prefix: str = "shard") -> DataFrame:
    """Rendezvous hashing: the shard with the highest hash of (key, shard); growing n moves only keys that go to new shards."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit("#"), i.cast("string"))).alias("h"), i.alias("i"))))
    return df.withColumn("shard", F.concat(F.lit(prefix + "-"), best.i.cast("string")))


def logical_buckets(buckets: DataFrame, prefixes: list[str]) -> DataFrame:
    """Physical shards ``prefix-i`` as one bucket with the first shard's creation time."""
    name, logical = F.col("name"), F.col("name")
    for p in prefixes:
        logical = F.when(name.rlike(f"^{p}-[0-9]+$"), F.lit(p)).otherwise(logical)
    number = F.coalesce(F.regexp_extract(name, r"-([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return buckets.groupBy(logical.alias("bucket")).agg(F.count("*").alias("shards"), F.min_by("created", number).alias("created"))


def live_members(beats: DataFrame, now: Column, timeout_s: int) -> DataFrame:
    """Nodes whose last heartbeat (epoch milliseconds as text) is recent; an unreadable one is expired."""
    last = beats.groupBy("node").agg(F.max(F.col("beat").try_cast("long")).alias("last_ms"))
    return last.where(F.col("last_ms") >= now - timeout_s * 1000)


def membership_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select(F.col("node").alias("a")).distinct(), after.select(F.col("node").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("node"), F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged").alias("change"))


def locate_store(requests: DataFrame, globs: DataFrame) -> DataFrame:
    """Adds ``store``: the last glob entry ``(pos, glob, identity, store)`` that fits the container and the identity."""
    g = _small(globs.withColumnsRenamed({"identity": "g_identity"}))
    keys = requests.select("container", "identity").distinct()
    rule = F.expr("container rlike concat('^', replace(replace(glob, '.', '[.]'), '*', '.*'), '$')")
    best = keys.join(g, rule & (F.col("g_identity") == F.col("identity"))).groupBy("container", "identity").agg(F.max_by("store", "pos").alias("store"))
    return requests.join(best, ["container", "identity"], "left")
