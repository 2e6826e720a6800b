"""Gzip content with an index of members, so that ranges can be read alone."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import pandas_udf

from ..sources.files import kept, new_folder
from .metrics import running_sum
from .policy import _small


def _udf(f, most: int = 8 << 20):
    """``f`` of every value; results are given on after ``most`` bytes, so that a batch of any size takes little memory."""

    @pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            made, held = [], 0
            for b in s:
                made.append(None if b is None else f(bytes(b)))
                held += len(made[-1] or b"")
                if held > most:
                    yield pd.Series(made, dtype=object)
                    made, held = [], 0
            if made:
                yield pd.Series(made, dtype=object)
        pa.default_memory_pool().release_unused()

    return run


def gzip_chunks(df: DataFrame, content: str = "content", level: int = 6) -> DataFrame:
    return df.withColumn(content, _udf(lambda b: gzip.compress(b, level, mtime=0))(content))


def gunzip_chunks(df: DataFrame, content: str = "content") -> DataFrame:
    """Also of several members one after the other."""
    return df.withColumn(content, _udf(gzip.decompress)(content))


def index_gzip(records: DataFrame, n: int = 100_000, key: str = "key") -> DataFrame:
    """``(key, block, start, member)`` of records ``(key, pos, value)``: every n records one gzip member of level 1.

    Blocks are compressed apart; starts are running sums of the members' sizes.
    Values are joined as they are, so they carry their own line ends.
    """
    src = records.select(F.col(key).alias("key"), F.floor(F.col("pos") / n).cast("long").alias("block"), "pos", F.col("value").cast("binary").alias("value"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        last, pack, parts = None, None, []

        def row():
            k, b = last
            data = b"".join([*parts, pack.flush()])
            return pa.record_batch([pa.array([k], key_type), pa.array([b], pa.int64()), pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], names=["key", "block", "member", "size"])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("key").type
            for k, b, v in zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist()):
                if (k, b) != last:
                    if last is not None:
                        yield row()
                    last, pack, parts = (k, b), zlib.compressobj(1, zlib.DEFLATED, 31), []
                parts.append(pack.compress(v))
        if last is not None:
            yield row()

    members = src.repartition("key", "block").sortWithinPartitions("key", "block", "pos").select("key", "block", "value").mapInArrow(run, f"key {kind}, block bigint, member binary, size bigint")
    members = kept(members, new_folder(records.sparkSession, "members"))
    starts = running_sum(members.select("key", "block", "size"), ["key"], ["block"], F.col("size"), "end")  # sizes only: a key may have any number of members
    starts = starts.select(F.col("key").alias("_key"), F.col("block").alias("_block"), (F.col("end") - F.col("size")).alias("start"))
    out = members.join(starts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    return out.select(F.col("key").alias(key), "block", "start", "member")


def offsets(members: DataFrame, key: str = "key") -> DataFrame:
    return members.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("start")), lambda x: x.cast("string")), ",").alias("index"))


def plan_ranges(index: DataFrame, k: int, key: str = "key") -> DataFrame:
    """At most k contiguous ranges [start, end) of the members of ``index``; the last one is open."""
    o = index.select(key, F.posexplode(F.split("index", ",")).alias("pos", "start"), F.size(F.split("index", ",")).alias("n"))
    o = o.withColumn("range", F.floor(F.col("pos") / F.ceil(F.col("n") / k)))
    r = o.groupBy(key, "range").agg(F.min(F.col("start").cast("long")).alias("start"), F.count("*").alias("members"))
    return r.withColumn("end", F.lead("start").over(Window.partitionBy(key).orderBy("range")))


def count_records(spark: SparkSession, path: str, mode: str = "plain", ranges: DataFrame | None = None, lines: int = 4) -> DataFrame:
    """``(path, records)`` of files of records of ``lines`` lines: plain, gzip, or indexed gzip by ``ranges``.

    Plain files are split at lines by Spark, gzip files are read one a task.
    ``ranges`` are rows ``(key, range, start, end)`` with a file's path as key;
    every range is read and decoded on its own, without the rest of the file.
    """
    if mode not in ("plain", "gzip", "indexed"):
        raise ValueError(f"no such mode: {mode}")
    if mode != "indexed":
        rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"))
        return rows.groupBy("path").agg(F.floor(F.count("*") / lines).alias("records"))

    def run(batches):
        from pyarrow import fs

        for b in batches:
            found = []
            for key, start, end in zip(*(b.column(c).to_pylist() for c in ("key", "start", "end"))):
                where, name = fs.FileSystem.from_uri(key if "://" in key or key.startswith("/") else key.replace("file:", "file://", 1))
                with where.open_input_file(name) as f:
                    f.seek(start)
                    found.append(gzip.decompress(f.read(None if end is None else end - start)).count(b"\n"))
            yield pa.record_batch([b.column("key"), pa.array(found, pa.int64())], names=["path", "n"])

    part = ranges.repartition("key", "range").select("key", "start", "end")
    return part.mapInArrow(run, "path string, n bigint").groupBy("path").agg(F.floor(F.sum("n") / lines).alias("records"))


def count_lines(members: DataFrame, key: str = "key", lines: int = 4) -> DataFrame:
    """``(key, records)`` from members that are rows: each is decoded on its own."""
    n = F.length(F.regexp_replace(F.col("_t"), "[^\n]", ""))
    text = gunzip_chunks(members.select(key, "member"), "member").select(key, F.col("member").cast("string").alias("_t"))
    return text.groupBy(key).agg(F.floor(F.sum(n) / lines).alias("records"))


def scan_indexed_gzip(files: DataFrame, ranges: DataFrame, key: str = "key") -> DataFrame:
    """``(key, range, lines)``: each range of ``content`` decoded on its own, all members of it.

    Ranges are cut out before they are dealt to tasks, so no file goes whole to all of its ranges.
    Files in a store are better read by ``count_records``, range by range.
    """

    @pandas_udf("long")
    def lines(member):
        return member.map(lambda b: gzip.decompress(bytes(b)).count(b"\n"))

    end = F.coalesce("end", F.octet_length("content").cast("long"))
    j = files.join(_small(ranges), key)
    j = j.select(key, "range", F.substr("content", (F.col("start") + 1).cast("int"), (end - F.col("start")).cast("int")).alias("member"))
    return j.repartition(key, "range").select(key, "range", lines("member").alias("lines"))
