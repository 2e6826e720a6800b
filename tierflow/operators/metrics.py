"""Counters, rates and latency figures over tables of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def word_count(df: DataFrame, by: list[str], text: str = "content") -> DataFrame:
    from ..functions.text import words

    return df.groupBy(*by).agg(F.sum(words(F.col(text))).alias("words"))


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, width: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group up to this one, in the order of ``order``.

    The first column of ``order`` is a whole number. Ranges of ``width`` of it are
    summed apart and then added up, so no task holds a whole group.
    """
    rows = df.withColumn("_r", F.floor(F.col(order[0]) / width)).withColumn("_v", value)
    sums = rows.groupBy(*by, "_r").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_r").alias("_of"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    same = F.col("_r").eqNullSafe(F.col("_of"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    within = Window.partitionBy(*by, "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_w", F.coalesce(F.sum("_v").over(within), F.lit(0))).join(base, same)
    return out.withColumn(name, F.col("_b") + F.col("_w")).drop("_r", "_v", "_of", "_b", "_w", *[f"_by_{c}" for c in by])


def running_word_count(df: DataFrame, by: list[str], order: str, text: str = "content") -> DataFrame:
    from ..functions.text import words

    return running_sum(df, by, [order], words(F.col(text)), "words_so_far")


def byte_count(df: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("chunks"), F.sum(length).alias("bytes"))


def op_metrics(ops: DataFrame) -> DataFrame:
    """Per operation: count, last size in MB, MiB/s, and cumulative latency buckets."""
    le = [F.count_if(F.col("latency_s") <= b).alias(f"le_{b}".replace(".", "_")) for b in BUCKETS]
    return ops.groupBy("op").agg(
        F.count("*").alias("n"), (F.max_by("size_bytes", F.struct("ts", "seq")) / 1e6).alias("last_mb"),
        (F.sum("size_bytes") / 1048576 / F.sum("latency_s")).alias("mib_s"), *le)


def approx_latency_summary(ops: DataFrame, by: list[str], value: str = "latency_s", accuracy: int = 10_000) -> DataFrame:
    """As ``latency_summary`` with percentiles whose rank is off by at most 1 / ``accuracy`` of the rows, in bounded memory."""
    p = F.percentile_approx(value, [0.5, 0.9, 0.95, 0.99], accuracy)
    out = ops.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), p.alias("_p"))
    return out.select("*", *[F.col("_p")[i].alias(n) for i, n in enumerate(["p50", "p90", "p95", "p99"])]).drop("_p")


def latency_sketch(ops: DataFrame, by: list[str], value: str = "latency_s", k: int = 800) -> DataFrame:
    """``(by, n, min, max, total, sketch)``: a quantile sketch (KLL) of each group, of a size that only ``k`` decides.

    Sketches of parts of the rows can be stored and added up (``merged_sketches``).
    The rank of a quantile is off by about 3 / ``k`` of the rows at most.
    """
    v = F.col(value).cast("double")
    return ops.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of batches added up by group; the same columns."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_summary(sketches: DataFrame, by: list[str]) -> DataFrame:
    """As ``latency_summary``, from sketches; groups without values have nulls."""
    q = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100).cast("double"))).alias(f"p{p}") for p in (50, 90, 95, 99)]
    return sketches.select(*by, "n", "min", "max", (F.col("total") / F.col("n")).alias("avg"), *q)


def latency_summary(ops: DataFrame, by: list[str], value: str = "latency_s") -> DataFrame:
    p = [F.percentile(F.col(value), q / 100).alias(f"p{q}") for q in (50, 90, 95, 99)]
    return ops.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), *p)


def ratio_report(runs: DataFrame) -> DataFrame:
    """Mean compression ratio and p95 latency by setting; original bytes are rate x (minutes + 1) x 60 x message size."""
    original = F.col("rate") * (F.col("minutes") + 1) * 60 * F.col("message_size")
    return runs.groupBy("batch", "location", "rate").agg(F.avg(original / F.col("stored")).alias("ratio"), F.avg("p95").alias("p95"))


def access_rate(log: DataFrame, every: str = "1 hour") -> DataFrame:
    g = log.groupBy(F.window("ts", every).alias("w"), "op").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "op", "n")


def count_hits(det: DataFrame, labels: list[str]) -> DataFrame:
    """Frames of each chunk with a detection in the label set."""
    frame = det.groupBy("chunk", "frame").agg(F.bool_or(F.col("class").isin(labels)).alias("hit"))
    return frame.groupBy("chunk").agg(F.count_if("hit").cast("string").alias("inference_result"))


#: Fixed value: the text of a frame's note.
NOTE = "timestamp=%d,objects=%d,humans=%d"


def detection_notes(det: DataFrame, labels: list[str]) -> DataFrame:
    g = det.groupBy("chunk", "frame").agg(F.count("*").alias("n"), F.count_if(F.col("class").isin(labels)).alias("h"))
    return g.select("chunk", F.concat(F.lit("detection_"), F.col("frame").cast("string")).alias("tag"), F.format_string(NOTE, "frame", "n", "h").alias("note"))


def previous_value(df: DataFrame, state: list[str], key: str, value: str, order: str) -> DataFrame:
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(*state, key).orderBy(order)))


def every_kth(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """Each k-th row of a group in the order of a whole number."""
    return running_sum(df, by, [order], F.lit(1), "_n").where(F.col("_n") % k == 0).drop("_n")


def screen(df: DataFrame, motif: str, by: list[str], order: str, text: str = "sequence") -> DataFrame:
    """Records without the motif, numbered from 0 within their chunk."""
    kept = df.where(~F.contains(text, F.lit(motif)))
    return running_sum(kept, by, [order], F.lit(1), "id").withColumn("id", F.col("id") - 1)


def backlog(pending: DataFrame, now: Column) -> DataFrame:
    """Retries with age and whether to warn: older than an hour, at every tenth attempt. Times are epoch seconds."""
    age = (now - F.col("first_try")).alias("age_s")
    return pending.select("uri", "attempts", age).withColumn("warn", (F.col("age_s") > 3600) & (F.col("attempts") % 10 == 0))
