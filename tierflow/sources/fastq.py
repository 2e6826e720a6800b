"""FASTQ files as a data source: byte ranges that find their first record themselves."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import kept, locate, new_folder, together

_BATCH = 4096


@dataclass
class Range:
    """Bytes ``start`` to ``end`` - 1 of a file; ``lines``: ends of lines before them, beyond those ahead of the first record."""

    file: str
    start: int
    end: int
    lines: int | None = None


@dataclass
class _Ranges(InputPartition):
    ranges: list[Range]


def first_record(lines: list[bytes]) -> int | None:
    """Which of some consecutive lines is the first of a record: it begins with ``@``, and the second after it with ``+``.

    Sequences begin with neither, so of four lines one at most can be it, even
    where quality lines begin with ``@`` or ``+``.
    """
    return next((i for i in range(len(lines) - 2) if lines[i].startswith(b"@") and lines[i + 2].startswith(b"+") and not lines[i + 1].startswith((b"@", b"+"))), None)


def lines_ahead(lines: list[bytes]) -> int | None:
    """As ``first_record`` for the lines that begin a file, where a sequence may begin with any character."""
    found = first_record(lines)
    return next((i for i in range(len(lines) - 2) if lines[i].startswith(b"@") and lines[i + 2].startswith(b"+")), None) if found is None else found


def _some(stream, n: int) -> list[bytes]:
    return [line for _ in range(n) if (line := stream.readline())]


def records(stream, start: int, end: int, before: int | None = None) -> Iterator[tuple[bytes, ...]]:
    """The records of a file that begin at bytes ``start`` to ``end`` - 1, of four lines each.

    A record belongs to the range in which its first line begins. A cut-off
    record at the end of the file is left out. ``before``, the ends of lines between the first record's
    begin and ``start``, says which line is the first of a record; without it the lines
    themselves must (see ``first_record``).
    """
    stream.seek(max(0, start - 1))
    # the rest of a line that begins before the range, or the end of the line before it
    rest = stream.readline() if start else b"\n"
    at = stream.tell()
    if before is None:
        lines = _some(stream, 6)
        skip = first_record(lines) if start else lines_ahead(lines)
        if skip is None:
            return
    else:
        skip = -(before + (rest != b"\n"))
        skip = skip if skip > 0 else skip % 4
        lines = _some(stream, skip + 4)
    at, lines = at + sum(map(len, lines[:skip])), lines[skip:]
    while at < end:
        while len(lines) < 4 and (line := stream.readline()):
            lines.append(line)
        if len(lines) < 4 or not (lines[0].startswith(b"@") and lines[2].startswith(b"+")) or not lines[1].endswith(b"\n"):
            return
        back = b"\r" * lines[0].endswith(b"\r\n")  # else a carriage return is the text's own
        yield tuple(x.removesuffix(b"\n").removesuffix(back) for x in lines[:4])
        at, lines = at + sum(map(len, lines[:4])), lines[4:]


def ranges_of_files(path: str, size: int) -> list[Range]:
    where, base = locate(path)
    found = where.get_file_info(base)
    files = [found] if found.type == fs.FileType.File else where.get_file_info(fs.FileSelector(base, recursive=True))
    files = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    return [Range(p, i, min(n, i + size)) for p, n in files for i in range(0, n, size)]


@dataclass
class _Reader(DataSourceReader):
    path: str
    size: int
    lines: str | None = None

    def partitions(self) -> list[InputPartition]:
        out = ranges_of_files(self.path, self.size)
        if self.lines:
            where, base = locate(self.lines)
            t = ds.dataset(base, filesystem=where, format="parquet").to_table(columns=["file", "start", "before"])
            before = dict(zip(zip(t["file"].to_pylist(), t["start"].to_pylist()), t["before"].to_pylist()))
            for r in out:
                r.lines = before[r.file, r.start]
        return [_Ranges(rs) for rs in together(out, [r.end - r.start for r in out])] or [_Ranges([])]

    def read(self, part: _Ranges) -> Iterator[pa.RecordBatch]:
        where, _ = locate(self.path)
        for r in part.ranges:
            with where.open_input_file(r.file) as raw:
                yield from self.of_range(raw, r)

    def of_range(self, raw, part: Range) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "pos", "header", "sequence", "optional_header", "quality"]
        rows, pos = [], 0

        def batch():
            cols = zip(*rows)
            text = [pa.array([x.decode("utf-8", "replace") for x in c], pa.string()) for c in cols]
            n = len(rows)
            return pa.record_batch([pa.array([part.file] * n), pa.array([part.start] * n, pa.int64()), pa.array(range(pos, pos + n), pa.int64()), *text], names=names)

        for h, s, o, q in records(io.BufferedReader(raw, min(1 << 20, part.end - part.start + 1)), part.start, part.end, part.lines):
            rows.append((h[1:], s, o[1:], q))
            if len(rows) == _BATCH:
                yield batch()
                rows, pos = [], pos + _BATCH
        if rows:
            yield batch()


class _Counter(_Reader):
    """Instead of records the ends of lines in each range, and in a file's first range the lines ahead of its first record."""

    def of_range(self, raw, part):
        n, ahead = 0, None
        if not part.start:
            ahead = lines_ahead(_some(io.BufferedReader(raw, 1 << 16), 6))
            where, _ = locate(self.path)
            raw = where.open_input_file(part.file)
        with raw:
            raw.seek(part.start)
            for at in range(part.start, part.end, 1 << 20):
                n += raw.read(min(1 << 20, part.end - at)).count(b"\n")
        yield pa.record_batch([pa.array([part.file]), pa.array([part.start], pa.int64()), pa.array([n], pa.int64()), pa.array([ahead], pa.int64())], names=["file", "start", "breaks", "ahead"])


class Fastq(DataSource):
    """``format("fastq_ranges")``: records of plain files under ``path``, an input partition per ``rangebytes`` of a file.

    ``file, start, pos, header, sequence, optional_header, quality``; ``pos`` counts
    the records of the range that begins at ``start``. Many small ranges share a task.
    ``lines`` names a table of the lines before each range (see ``read_fastq_files``); without it a range
    finds its first record by itself, which needs sequences that begin with neither ``@`` nor ``+``.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq_ranges"

    def schema(self) -> str:
        return "file string, start long, pos long, header string, sequence string, optional_header string, quality string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("rangebytes", 64 << 20)), self.options.get("lines"))


class FastqLines(Fastq):
    """``format("fastq_lines")``: the ends of lines in each range of ``fastq_ranges``, and the lines ahead of a file's first record."""

    @classmethod
    def name(cls) -> str:
        return "fastq_lines"

    def schema(self) -> str:
        return "file string, start long, breaks long, ahead long"

    def reader(self, schema) -> _Counter:
        return _Counter(self.options["path"], int(self.options.get("rangebytes", 64 << 20)))


def read_fastq_files(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """``(id, file, header, sequence, optional_header, quality)``: every record once, numbered from 0 by file and place.

    Ends of lines are counted first, so that every range knows which of its lines begins a record,
    whatever the sequences begin with; a file whose first lines hold no record is read as by ``fastq_ranges``.
    Records are stored once, so that the numbers of the ranges (a running sum of
    one short row per range) meet the same records.
    """
    spark.dataSource.register(Fastq), spark.dataSource.register(FastqLines)
    path_of, folder = {"path": path, "rangebytes": range_bytes}, new_folder(spark, "records")
    whole = Window.partitionBy("file").orderBy("start")  # a short row a range
    lines = F.sum("breaks").over(whole.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.max("ahead").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept(spark.read.format("fastq_lines").options(**path_of).load().select("file", "start", (F.coalesce(lines, F.lit(0)) - ahead).alias("before")), f"{folder}/lines")
    rows = kept(spark.read.format("fastq_ranges").options(**path_of, lines=f"{folder}/lines").load(), f"{folder}/rows")
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    counts = counts.select("file", "start", F.coalesce(before, F.lit(0)).alias("before"))
    out = rows.join(counts, ["file", "start"])
    return out.select((F.col("before") + F.col("pos")).alias("id"), "file", "header", "sequence", "optional_header", "quality")
