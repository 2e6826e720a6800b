"""Multipart uploads as tables of parts."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.files import Whole, kept, locate
from .catalog import latest
from .metrics import running_sum

MIN_PART, MAX_PARTS = 5 << 20, 10_000


def assemble(parts: DataFrame, text: bool = False) -> DataFrame:
    """``(upload, parts, size, content)`` of ``(upload, part, seq, content)``: a part sent again replaces the first."""
    last = latest(parts, ["upload", "part"], "seq")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x.content)
    size = F.length("content") if text else F.octet_length("content")
    # bytes are joined as hex, once, for a fold would copy what it has for every part
    whole = F.array_join(ordered, "") if text else F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x)), ""))
    return last.groupBy("upload").agg(F.count("*").alias("parts"), F.sum(size).cast("long").alias("size"), whole.alias("content"))


_EXTENTS = "upload {kind}, part long, file string, at long, size long"


def assemble_files(parts: DataFrame, path: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Write the parts of uploads ``(upload, part, seq, content)`` in their order to files, and return the manifest.

    A part sent again replaces the first. Parts are dealt to tasks by ranges of upload and part, so a large
    upload is written by several tasks, each of which holds one part at a time and
    begins a new file after ``file_bytes``. A file appears whole or not at all; the
    manifest names the files of the tasks that counted.

    ``(upload, part, file, at, start, size)``: a part's place in its file, and where it begins in the upload.
    """
    last = latest(parts, ["upload", "part"], "seq").select("upload", F.col("part").cast("long").alias("part"), F.col("content").cast("binary").alias("content"))
    kind = last.schema["upload"].dataType.simpleString()

    def write(batches):
        out, name = None, ""
        for b in batches:
            at = []
            for content in b.column("content"):
                if out is not None and out.size >= file_bytes:
                    out.close()
                    out = None
                if out is None:
                    name = f"{uuid.uuid4().hex}.part"
                    out = Whole(f"{path}/{name}")
                data = content.as_py() or b""
                at.append((name, out.write(data), len(data)))
            files, places, sizes = zip(*at) if at else ((), (), ())
            yield pa.record_batch([b.column("upload"), b.column("part"), pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=["upload", "part", "file", "at", "size"])
        if out is not None:
            out.close()

    ranged = last.repartitionByRange("upload", "part").sortWithinPartitions("upload", "part")
    found = kept(ranged.mapInArrow(write, _EXTENTS.format(kind=kind)), f"{path}/written")
    placed = running_sum(found, ["upload"], ["part"], F.col("size"), "end")
    return kept(placed.select("upload", "part", "file", "at", (F.col("end") - F.col("size")).alias("start"), "size"), f"{path}/manifest")


def read_uploads(manifest: DataFrame, path: str) -> DataFrame:
    """``(upload, part, start, content)``: the parts of assembled uploads, each read from its place alone."""
    kind = manifest.schema["upload"].dataType.simpleString()

    def read(batches):
        for b in batches:
            for i in range(b.num_rows):
                file, at, size = (b.column(c)[i].as_py() for c in ("file", "at", "size"))
                where, base = locate(path)
                with where.open_input_file(f"{base}/{file}") as f:
                    f.seek(at)
                    data = f.read(size)
                yield pa.record_batch([b.column("upload").slice(i, 1), b.column("part").slice(i, 1), b.column("start").slice(i, 1), pa.array([data], pa.binary())], names=["upload", "part", "start", "content"])

    return manifest.mapInArrow(read, f"upload {kind}, part long, start long, content binary")


def upload_digests(manifest: DataFrame, path: str, piece: int = 4 << 20) -> DataFrame:
    """``(upload, parts, size, md5, sha256)`` of assembled uploads, from their files.

    A digest needs the bytes in order, so an upload is read by one task, ``piece``
    bytes at a time; only extents are shuffled.
    """
    kind = manifest.schema["upload"].dataType.simpleString()

    def run(batches):
        held, out, key_type = None, [], None

        def given():
            cols = list(zip(*out)) or [[]] * 5
            out.clear()
            return pa.record_batch([pa.array(cols[0], key_type), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.string(), pa.string()))]], names=["upload", "parts", "size", "md5", "sha256"])

        for b in batches:
            key_type = b.schema.field("upload").type
            for upload, file, at, size in zip(*(b.column(c).to_pylist() for c in ("upload", "file", "at", "size"))):
                if held is None or held[0] != upload:
                    if held:
                        out.append((*held[:3], held[3].hexdigest(), held[4].hexdigest()))
                    held = [upload, 0, 0, hashlib.md5(), hashlib.sha256()]
                held[1], held[2] = held[1] + 1, held[2] + size
                where, base = locate(path)
                with where.open_input_file(f"{base}/{file}") as f:
                    f.seek(at)
                    while size:
                        data = f.read(min(size, piece))
                        if not data:
                            raise OSError(f"{file} is cut off")
                        size -= len(data)
                        held[3].update(data), held[4].update(data)
            yield given()
        if held:
            out.append((*held[:3], held[3].hexdigest(), held[4].hexdigest()))
            yield given()

    rows = manifest.select("upload", "start", "part", "file", "at", "size").repartition("upload").sortWithinPartitions("upload", "start", "part")
    return rows.mapInArrow(run, f"upload {kind}, parts long, size long, md5 string, sha256 string")


def tasks_for(*tables: DataFrame, rows: int = 1_000_000) -> int:
    """In how many tasks rows are best dealt so that each holds about ``rows`` of the largest table, however large it is."""
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, *(-(-t.count() // rows) for t in tables))


def validate_parts(sent: DataFrame, wanted: DataFrame, least: int = MIN_PART, task_rows: int = 1_000_000) -> DataFrame:
    """Adds ``status`` to the parts of a completion: INVALID_PART, ENTITY_TOO_SMALL (any but the last) or OK.

    The number of tasks grows with the parts, ``task_rows`` for each.
    """
    n = tasks_for(sent, wanted, rows=task_rows)
    last = F.max("part").over(Window.partitionBy("upload"))
    want = wanted.repartition(n, "upload").withColumn("_last", last).repartition(n, "upload", "part")
    have = sent.select("upload", "part", F.col("etag").alias("have"), "size").repartition(n, "upload", "part")
    j = want.join(have, ["upload", "part"], "left")
    status = F.when(F.col("have").isNull() | (F.col("have") != F.col("etag")) | (F.col("part") > MAX_PARTS), "INVALID_PART").when((F.col("size") < least) & (F.col("part") < F.col("_last")), "ENTITY_TOO_SMALL").otherwise("OK")
    return j.select("upload", "part", status.alias("status"))


def uploads(events: DataFrame, task_rows: int = 1_000_000) -> DataFrame:
    """State of each upload from ``(upload, seq, op, part, size)``: ABORTED and OPEN ones emit no size.

    Events are dealt by upload to tasks of about ``task_rows``, whose number grows with them.
    """
    e = events.repartition(tasks_for(events, rows=task_rows), "upload").groupBy("upload").agg(
        F.bool_or(F.col("op") == "abort").alias("aborted"), F.bool_or(F.col("op") == "complete").alias("completed"),
        F.count_distinct(F.when(F.col("op") == "part", F.col("part"))).alias("parts"), F.sum(F.when(F.col("op") == "part", F.col("size"))).alias("bytes"))
    state = F.when(F.col("aborted"), "ABORTED").when(F.col("completed"), "COMPLETED").otherwise("OPEN")
    return e.select("upload", state.alias("state"), "parts", F.when(state == "COMPLETED", F.col("bytes")).alias("bytes"))
