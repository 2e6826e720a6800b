"""Interleaving sources at target weights by Pfair scheduling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import cut, new_name, numbered, stored

MAX_SOURCES = 4096


def _shares(totals: DataFrame, weights: dict[str, float] | None, period: int) -> DataFrame:
    """Whole slots of each source in a period, at least one, by largest remainders."""
    if weights is not None:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        totals = totals.withColumn("w", F.coalesce(table[F.col("source")].cast("double"), F.lit(0.0)))
    else:
        totals = totals.withColumn("w", F.sqrt(F.col("bytes").cast("double")))
    n = Window.partitionBy(F.lit(0))
    t = totals.withColumn("m", F.count("*").over(n)).withColumn("all", F.sum("w").over(n.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    t = t.withColumn("d", F.greatest(F.lit(period), 4 * F.col("m")))
    exact = (F.col("d") - F.col("m")) * F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(1 / F.col("m"))
    t = t.withColumn("exact", exact).withColumn("low", F.floor("exact"))
    r = F.row_number().over(n.orderBy(F.desc(F.col("exact") - F.col("low")), "source"))
    t = t.withColumn("r", r).withColumn("left", F.col("d") - F.col("m") - F.sum("low").over(n))
    k = 1 + F.col("low") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)
    return t.select("source", k.cast("int").alias("k"), F.col("d").cast("int").alias("d"), (F.row_number().over(n.orderBy("source")) - 1).alias("i"))


def _slots(shares: DataFrame) -> DataFrame:
    """One period of the schedule: at each slot, of the blocks released, that with the earliest deadline.

    Block j of a source with k of d slots is released at floor(j d / k) and due
    at ceil((j + 1) d / k). As the shares add up to d, the schedule of later
    periods is the same, shifted; the fold below is as long as one period.
    """
    one = shares.agg(F.array_sort(F.collect_list(F.struct("i", "k", "d", "source"))).alias("s")).where(F.size("s") > 0)
    return one.select(F.col("s"), F.expr("""
        aggregate(sequence(0, get(s, 0).d - 1),
          named_struct('done', transform(s, x -> 0), 'plan', cast(array() as array<struct<slot:int,i:int,j:int>>)),
          (a, t) -> transform(array(array_min(transform(s, x ->
              if((a.done[x.i] * x.d) div x.k <= t, named_struct('due', ((a.done[x.i] + 1) * x.d + x.k - 1) div x.k, 'i', x.i), null)))),
            best -> named_struct(
              'done', transform(a.done, (v, i) -> v + if(i = best.i, 1, 0)),
              'plan', concat(a.plan, array(named_struct('slot', t, 'i', best.i, 'j', a.done[best.i])))))[0]).plan
    """).alias("plan")).select(F.explode("plan").alias("p"), "s").select(F.col("p.slot").alias("at"), F.col("p.j").alias("j"), F.expr("s[p.i].source").alias("source"), F.expr("s[p.i].k").alias("k"), F.expr("s[p.i].d").alias("d"))


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: Column | None = None,
    weights: dict[str, float] | None = None, block_bytes: int = 64 << 10, period: int = 1000,
) -> DataFrame:
    """``(id, source, block, slot, release, deadline, position)``, one row per distinct id.

    A source's rows, in the order of their ids' MD5, are cut into blocks of
    ``block_bytes`` by where each row starts. Blocks are interleaved so that
    after any number of slots every source that still has blocks is less than
    one block from its target weight. Slots of a source that has run out stay
    empty, so no row is dropped; ``position`` counts rows without gaps.

    ``weights`` are relative (a source without one gets the least share of one
    slot a period); by default they are the square roots of the sources' bytes.
    A null source is the source named ``''``; rows with one id stay together and
    count once. Null texts have no bytes. An empty table gives no rows.
    """
    size = F.octet_length(F.col("text")) if size_col is None else size_col
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("b"))
    rows = rows.groupBy("id").agg(F.min("source").alias("source"), F.sum("b").alias("b"))
    rows = rows.withColumn("mark", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("part", F.substring("mark", 1, 3))
    rows = stored(rows, "sizes")
    parts = cut(rows.groupBy("source", "part").agg(F.sum("b").alias("b")))
    totals = cut(parts.groupBy("source").agg(F.sum("b").alias("bytes")))
    if totals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    slots = cut(_slots(_shares(totals, weights, period)))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "part").orderBy("mark", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("run", F.coalesce(F.sum("b").over(within), F.lit(0))).join(starts, ["source", "part"])
    placed = placed.withColumn("block", F.expr(f"(base + run) div {block_bytes}"))
    share = slots.select("source", "k", "d").distinct()
    placed = placed.join(F.broadcast(share), "source").withColumn("j", F.expr("cast(block % k as int)"))  # at most MAX_SOURCES rows
    placed = placed.join(F.broadcast(slots.select("source", "j", "at")), ["source", "j"])  # a period's slots
    placed = stored(placed.select(
        "id", "source", "mark", "block", F.expr("(block div k) * d + at").alias("slot"),
        F.expr("(block * d) div k").alias("release"), F.expr("((block + 1) * d + k - 1) div k").alias("deadline"),
    ).withColumn("chunk", F.expr("slot div 64")), "blocks")
    chunks = placed.groupBy("chunk").count()
    group = Window.partitionBy("far").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = cut(chunks.withColumn("far", F.expr("chunk div 4096")).withColumn("in_far", F.coalesce(F.sum("count").over(group), F.lit(0))))
    far = chunks.groupBy("far").agg(F.sum("count").alias("n"))
    far = far.select("far", F.coalesce(F.sum("n").over(Window.orderBy("far").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("in_all"))
    chunks = chunks.join(far, "far").select("chunk", (F.col("in_far") + F.col("in_all")).alias("first"))
    order = F.row_number().over(Window.partitionBy("chunk").orderBy("slot", "mark", "id"))
    out = placed.withColumn("r", order).join(chunks, "chunk")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "block", "slot", "release", "deadline", (F.col("first") + F.col("r") - 1).alias("position"))


def mixed(df: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``df``, in the order of the mix: partitions and the rows in them are sorted by position.

    Rows of one id follow each other in the order of the files, and may be spread
    over several partitions. Null ids are one id, null texts and sources are kept.
    """
    of, place, row = (new_name(df, x) for x in ("of", "place", "row"))
    at = stored(mix_sources(df, id_col, **how).select(F.col(id_col).alias(of), F.col("position").alias(place)), "places")
    rows = numbered(df, row)
    both = rows.join(at, rows[id_col].eqNullSafe(F.col(of)))  # Spark may split a hot id
    return both.repartitionByRange(place, row).sortWithinPartitions(place, row).drop(of, place, row)


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id AS id, min(coalesce(source, '')) AS source,
         CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS b,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mark
  FROM documents GROUP BY doc_id),
t AS (SELECT source, sqrt(CAST(sum(b) AS DOUBLE)) AS w FROM d GROUP BY source),
u AS (SELECT source, w, count(*) OVER () AS m, (SELECT sum(w ORDER BY source) FROM t) AS total FROM t),
e AS (SELECT source, m, greatest(1000, 4 * m) AS d, (greatest(1000, 4 * m) - m) * (w / total) AS exact FROM u),
f AS (SELECT *, CAST(floor(exact) AS BIGINT) AS low, row_number() OVER (ORDER BY exact - floor(exact) DESC, source) AS r FROM e),
s AS (SELECT source, d, CAST(1 + low + CASE WHEN r <= d - m - (SELECT sum(low) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS k,
             row_number() OVER (ORDER BY source) AS i FROM f),
c AS (SELECT list(k ORDER BY i) AS ks, max(d) AS d FROM s),
step AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, list_transform(ks, lambda x: CAST(0 AS BIGINT)) AS done, ks, d FROM c
  UNION ALL
  SELECT t + 1, best, done[best], list_transform(done, lambda v, q: CASE WHEN q = best THEN v + 1 ELSE v END), ks, d
  FROM (SELECT step.*, list_min(list_filter(list_transform(ks, lambda x, q:
            CASE WHEN (done[q] * d) // x <= t + 1 THEN ((((done[q] + 1) * d + x - 1) // x) * 10000 + q) END), lambda z: z IS NOT NULL)) % 10000 AS best
        FROM step WHERE t + 1 < d)),
g AS (SELECT id, source, mark, (CAST(sum(b) OVER (PARTITION BY source ORDER BY mark, id) AS BIGINT) - b) // 65536 AS block FROM d),
p AS (SELECT g.id, g.source, g.mark, g.block, (g.block // s.k) * s.d + step.t AS slot,
             (g.block * s.d) // s.k AS release, ((g.block + 1) * s.d + s.k - 1) // s.k AS deadline
      FROM g JOIN s USING (source) JOIN step ON step.i = s.i AND step.j = g.block % s.k AND step.t >= 0)
SELECT id AS doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot, CAST(release AS BIGINT) AS release,
       CAST(deadline AS BIGINT) AS deadline, row_number() OVER (ORDER BY slot, mark, id) - 1 AS position
FROM p
"""
