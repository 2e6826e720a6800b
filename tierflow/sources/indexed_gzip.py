"""Objects of gzip members with an index: written member by member in part files, read back by range as a data source.

A store is a folder ``data`` with a folder of part files for each object, each
beside a file of its members' places, a table ``parts`` and a table ``members``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..operators.metrics import running_sum
from .files import Whole, kept, locate, together
from .readers import json_spans

#: What a piece is of its object: bytes ahead of the first record, a record, bytes after the last.
AHEAD, RECORD, AFTER = 0, 1, 2
_LAST = 1 << 40  # the block of the bytes after the last record
INDEX_TAG = "gzip-index"


def _files(path: str, level: int):
    """Writes the part files; rows of one part come together, in the order of their places."""

    def run(batches):
        last, out, pack, state, rows, begun = None, None, None, None, [], 0
        names = ["key", "file", "part", "block", "at", "size", "records", "raw"]

        def end_member():
            nonlocal pack
            if pack is not None:
                state[4] += len(tail := pack.flush())
                out.write(tail)
                rows.append((last[0], *state))
                pack = None

        def end_part():
            end_member()
            if out is not None:
                out.close()
                mine = np.array([r[3:7] for r in rows[begun:]], "<i8")
                side = Whole(f"{path}/data/{state[0]}.idx")
                side.write(mine.tobytes())
                side.close()

        def given():
            cols = list(zip(*rows)) or [[]] * 8
            rows.clear()
            return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=names)

        for b in batches:
            for key, part, block, value, kind in zip(*(b.column(c).to_pylist() for c in ("key", "part", "block", "value", "kind"))):
                if last is None or (key, part) != last[:2]:
                    end_part()
                    if len(rows) > 4096:
                        yield given()
                    begun = len(rows)
                    file = f"{hashlib.md5(str(key).encode()).hexdigest()}/{part:015d}.gz"
                    out = Whole(f"{path}/data/{file}")
                if last is None or (key, part, block) != last:
                    end_member()
                    last = (key, part, block)
                    pack, state = zlib.compressobj(level, zlib.DEFLATED, 31), [file, part, block, out.size, 0, 0, 0]
                state[4] += len(data := pack.compress(value))
                out.write(data)
                state[5] += kind == RECORD
                state[6] += len(value)
        end_part()
        yield given()

    return run


def write_indexed(pieces: DataFrame, path: str, n: int = 100_000, per_part: int = 64, level: int = 1) -> DataFrame:
    """Write the objects of ``pieces`` (``key, kind, pos, value``) to ``path`` and return their members.

    Every ``n`` records of an object, counted by ``pos`` from 0, are one gzip member of ``level``;
    bytes ahead of the first record and after the last have members of their
    own, without records. ``per_part`` members make a part file, so a large object is
    written by many tasks, each of which holds a batch of rows and no member.
    The joined parts of an object are its gzip file. Values are joined as they are.

    ``(key, file, part, block, at, size, records, raw, start, first)``: ``at`` is
    the place in the part file, ``start`` that in the object, ``first`` the records before.
    """
    block = F.when(F.col("kind") == AHEAD, -1).when(F.col("kind") == AFTER, _LAST).otherwise(F.floor(F.col("pos") / n)).cast("long")
    rows = pieces.select(F.col("key").cast("string").alias("key"), "kind", "pos", F.col("value").cast("binary").alias("value"), block.alias("block"))
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.floor(F.col("block") / per_part)).cast("long"))
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "block", "pos").select("key", "part", "block", "value", "kind")
    out = kept(rows.mapInArrow(_files(path, level), "key string, file string, part long, block long, at long, size long, records long, raw long"), f"{path}/written")
    out = running_sum(out, ["key"], ["block"], F.col("size"), "start")
    out = running_sum(out, ["key"], ["block"], F.col("records"), "first")
    out = out.withColumn("start", F.col("start") - F.col("size")).withColumn("first", F.col("first") - F.col("records"))
    members = kept(out.select("key", "file", "part", "block", "at", "size", "records", "raw", "start", "first"), f"{path}/members")
    parts = members.groupBy("key", "file", "part").agg(F.min("first").alias("first"), *[F.sum(c).alias(c) for c in ("size", "records", "raw")])
    parts.repartitionByRange("key", "part").write.parquet(f"{path}/parts")
    return members


def index_tags(members: DataFrame) -> DataFrame:
    """``(key, tags)``: the starts of each object's indexed members, joined by commas, as a tag."""
    starts = F.array_sort(F.collect_list(F.when(F.col("records") > 0, F.col("start"))))
    return members.groupBy("key").agg(F.create_map(F.lit(INDEX_TAG), F.array_join(F.transform(starts, lambda x: x.cast("string")), ",")).alias("tags"))


def ranges_of(members: DataFrame, k: int) -> DataFrame:
    """``(key, range, start, end, members)``: at most k contiguous ranges of each object's indexed members; the last is open."""
    from pyspark.sql import Window

    found = members.where("records > 0").select("key", "block", "start")
    ranked = running_sum(found, ["key"], ["block"], F.lit(1), "rank").join(found.groupBy("key").agg(F.count("*").alias("n")), "key")
    ranked = ranked.withColumn("range", F.floor((F.col("rank") - 1) / F.ceil(F.col("n") / k)))
    out = ranked.groupBy("key", "range").agg(F.min("start").alias("start"), F.count("*").alias("members"))
    end = F.lead("start").over(Window.partitionBy("key").orderBy("range"))  # at most k rows a key
    return out.select("key", "range", "start", end.alias("end"), "members")


def _lines(data: bytes, lines: int) -> list[bytes]:
    parts = data.split(b"\n")
    rest, parts = parts[-1], [p + b"\n" for p in parts[:-1]]
    if rest:
        parts.append(rest)
    return [b"".join(parts[i : i + lines]) for i in range(0, len(parts), lines)]


def _objects(data: bytes) -> list[bytes]:
    """Prefixed JSON records, each with its prefix."""
    ends = [b for _, b in json_spans(data)]
    return [data[i:j] for i, j in zip([0, *ends], ends)]


SPLITS = {"member": lambda d: [d], "line": lambda d: _lines(d, 1), "fastq": lambda d: _lines(d, 4), "json": _objects}


@dataclass
class _Range:
    key: str
    file: str
    first: int
    number: int
    of: int


@dataclass
class _Ranges(InputPartition):
    ranges: list[_Range]


@dataclass
class _Reader(DataSourceReader):
    path: str
    split: str
    size: int
    keys: set | None = None
    low: int | None = None
    high: int | None = None
    taken: list = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over comparisons of ``key`` and ``pos`` with values; the rest stays with Spark."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("key",) and isinstance(f, (EqualTo, In)):
                some = {value} if isinstance(f, EqualTo) else set(value)
                self.keys = some if self.keys is None else self.keys & some
            elif name == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
                if isinstance(f, IsNotNull):
                    value = 0
                low = value + isinstance(f, GreaterThan) if not isinstance(f, (LessThan, LessThanOrEqual)) else 0
                self.low = low if self.low is None else max(self.low, low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, base = locate(f"{self.path}/parts")
        some = ds.field("size") >= 0
        if self.keys is not None:
            some &= ds.field("key").isin(sorted(k for k in self.keys if k is not None))
        if self.low is not None:
            some &= (ds.field("first") + ds.field("records") > self.low) & (ds.field("records") > 0)
        if self.high is not None:
            some &= ds.field("first") <= self.high
        out, sizes = [], []
        for r in ds.dataset(base, filesystem=where, format="parquet").to_table(filter=some, columns=["key", "file", "first", "size"]).to_pylist():
            n = max(1, -(-r["size"] // self.size))
            out += [_Range(r["key"], r["file"], r["first"], i, n) for i in range(n)]
            sizes += [-(-r["size"] // n)] * n
        return [_Ranges(rs) for rs in together(out, sizes, min(self.size, 1 << 20))] or [_Ranges([])]

    def read(self, part: _Ranges) -> Iterator[pa.RecordBatch]:
        where, base = locate(f"{self.path}/data")
        rows, held = [], 0
        for r in part.ranges:
            for key, file, block, pos, value in self.of_range(where, base, r):
                rows.append((key, file, block, pos, value))
                held += len(value)
                if len(rows) == 4096 or held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def of_range(self, where, base: str, part: _Range) -> Iterator[tuple]:
        with where.open_input_file(f"{base}/{part.file}.idx") as f:
            block, at, size, records = np.frombuffer(f.read(), "<i8").reshape(-1, 4).T
        first = part.first + np.cumsum(records) - records
        mine = np.arange(len(at)) * part.of // len(at) == part.number
        if self.low is not None:
            mine &= (records > 0) & (first + records > self.low)
        if self.high is not None:
            mine &= (records == 0) | (first <= self.high)
        with where.open_input_file(f"{base}/{part.file}") as f:
            for i in np.flatnonzero(mine).tolist():
                f.seek(int(at[i]))
                data = zlib.decompress(f.read(int(size[i])), 31)
                if self.split == "member":
                    values, pos = [data], [int(first[i]) if records[i] else None]
                elif records[i]:
                    values = SPLITS[self.split](data)
                    pos = range(int(first[i]), int(first[i]) + len(values))
                else:
                    continue
                for p, value in zip(pos, values):
                    if (self.low is None or p >= self.low) and (self.high is None or (p is not None and p <= self.high)):
                        yield part.key, part.file, int(block[i]), p, value


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.string(), "file": pa.string(), "block": pa.int64(), "pos": pa.int64(), "value": pa.binary()}
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


class IndexedGzip(DataSource):
    """``format("indexed_gzip")``: the records of a store, one input partition for each range of members.

    Options: ``path``; ``split``, what a row is (``member``, ``line``, ``fastq``, ``json``); ``rangebytes``,
    compressed bytes of a range; of very many small ranges neighbours share a task. Filters on ``key`` and ``pos`` decide which part
    files and members are read at all. Rows: ``key, file, block, pos, value``; ``pos`` counts an object's
    records, and is null for members without records, which only ``member`` gives.
    """

    @classmethod
    def name(cls) -> str:
        return "indexed_gzip"

    def schema(self) -> str:
        return "key string, file string, block long, pos long, value binary"

    def reader(self, schema) -> _Reader:
        split = self.options.get("split", "member")
        if split not in SPLITS:
            raise ValueError(f"no such split: {split}")
        return _Reader(self.options["path"], split, int(self.options.get("rangebytes", 8 << 20)))


def scan_indexed(spark: SparkSession, path: str, split: str = "member", range_bytes: int = 8 << 20) -> DataFrame:
    """A store's records by range (see ``IndexedGzip``); filters reach the source in this session from now on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedGzip)
    return spark.read.format("indexed_gzip").option("path", path).option("split", split).option("rangebytes", range_bytes).load()


def restored(spark: SparkSession, path: str) -> DataFrame:
    """``(key, part, block, content)``: the bytes of every member, which in the order of part and block are the object; none are joined."""
    part = F.regexp_extract("file", r"/(\d+)\.gz$", 1).cast("long")
    return scan_indexed(spark, path).select("key", part.alias("part"), "block", F.col("value").alias("content"))
