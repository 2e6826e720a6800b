"""Readers of chunks: lines, blocks, frames, marked spans, JSON spans, FASTQ, log segments."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.checksums import crc32c


def scan_chunks(spark: SparkSession, root: str, glob: str = "*.log") -> DataFrame:
    """Files as rows; ``content`` is read only where a query uses it."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return raw.select(F.col("path").alias("key"), "length", F.col("modificationTime").alias("modified"), "content")


def read_lines(chunks: DataFrame, content: str = "content", keep_partial: bool = False) -> DataFrame:
    """Terminated lines without trailing white space; a tail without an end of line only if asked for."""
    parts = F.split(F.col(content).cast("string"), "\n")
    done = parts if keep_partial else F.slice(parts, F.lit(1), F.size(parts) - 1)
    rest = [c for c in chunks.columns if c != content]
    return chunks.select(*rest, F.posexplode(done).alias("pos", "value")).withColumn("value", F.regexp_replace("value", r"\s+$", ""))


def read_blocks(chunks: DataFrame, n: int, content: str = "content") -> DataFrame:
    """Whole blocks of n bytes; a short tail is left out."""
    count = F.floor(F.octet_length(content) / n).cast("int")
    rest = [c for c in chunks.columns if c != content]
    at = chunks.where(count > 0).select(*rest, F.col(content).alias("_c"), F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"))
    return at.withColumn("value", F.substr("_c", F.col("pos") * n + 1, F.lit(n))).drop("_c")


def reader(schema: str) -> Callable:
    """Makes ``f(bytes) -> rows`` a reader: ``f(chunks, key, content)`` gives key, pos and the row's fields."""

    def wrap(f: Callable[[bytes], Iterator[tuple]]):
        def read(chunks: DataFrame, key: str = "key", content: str = "content", **how) -> DataFrame:
            src = chunks.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"))
            kind = src.schema["key"].dataType.simpleString()
            out = f"key {kind}, pos int, {schema}"
            names = ["key", "pos"] + [x.strip().split(" ")[0] for x in schema.split(",")]
            types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
            kinds = [types[x.strip().split(" ")[1]] for x in schema.split(",")]

            def run(batches):
                for b in batches:
                    for k, c in zip(b.column("key"), b.column("content").to_pylist()):
                        rows = list(f(c or b"", **how))
                        cols = list(zip(*rows)) or [[] for _ in kinds]
                        yield pa.record_batch([pa.array([k.as_py()] * len(rows), b.schema.field("key").type), pa.array(range(len(rows)), pa.int32()), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

            return src.mapInArrow(run, out)

        read.__doc__, read.__wrapped__ = f.__doc__, f
        return read

    return wrap


@reader("ts_ns long, frame binary")
def read_frames(data: bytes) -> Iterator[tuple]:
    """Frames of little-endian size (int32), time (int64) and payload, up to the first that is negative or cut off."""
    at = 0
    while at + 12 <= len(data):
        size, ts = struct.unpack_from("<iq", data, at)
        if size < 0 or at + 12 + size > len(data):
            return
        yield ts, data[at + 12 : at + 12 + size]
        at += 12 + size


@reader("value binary")
def split_markers(data: bytes, start: bytes = b"\xff\xd8", end: bytes = b"\xff\xd9") -> Iterator[tuple]:
    """Spans from a start marker to the next end marker, in order; an open span at the end is left out."""
    at = 0
    while (i := data.find(start, at)) >= 0 and (j := data.find(end, i + len(start))) >= 0:
        at = j + len(end)
        yield (data[i:at],)


def json_spans(data: bytes, mark: bytes = b'{"id') -> Iterator[tuple[int, int]]:
    """Where the objects that begin with ``mark`` start and end in bytes; ends are found by the JSON grammar.

    An object that is broken or cut off is left out.
    """
    # a character a byte, so that places in the text are places in the bytes
    text, sign, at, decode = data.decode("latin-1"), mark.decode(), 0, json.JSONDecoder(strict=False)
    while (i := text.find(sign, at)) >= 0:
        try:
            at = decode.raw_decode(text, i)[1]
        except ValueError:
            at = i + len(sign)
        else:
            yield i, at


@reader("json string")
def read_prefixed_json(data: bytes, mark: bytes = b'{"id') -> Iterator[tuple]:
    """Objects that begin with ``mark``, each behind a prefix of any bytes (see ``json_spans``).

    Bytes that are no UTF-8 become U+FFFD.
    """
    for i, j in json_spans(data, mark):
        yield (data[i:j].decode("utf-8", "replace"),)


def fastq_pieces(data: bytes) -> Iterator[tuple]:
    """``(kind, pos, value)`` of all bytes of a chunk: those ahead of the first record, the records of four lines, the rest."""
    lines = data.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + [lines[-1]] * bool(lines[-1])
    i = 0
    while i + 3 < len(lines) and not (lines[i].startswith(b"@") and lines[i + 2].startswith(b"+")):
        i += 1
    i = i if i + 3 < len(lines) else len(lines)
    if i:
        yield 0, 0, b"".join(lines[:i])
    pos = 0
    while i + 3 < len(lines) and lines[i].startswith(b"@") and lines[i + 2].startswith(b"+"):
        yield 1, pos, b"".join(lines[i : i + 4])
        i, pos = i + 4, pos + 1
    if i < len(lines):
        yield 2, 0, b"".join(lines[i:])


def json_pieces(data: bytes, prefix: int = 8) -> Iterator[tuple]:
    """``(kind, pos, value)`` of all bytes of a chunk of JSON objects behind ``prefix`` bytes each.

    What precedes the first prefix, and what follows the last object, are pieces
    without a record; bytes between objects beyond a prefix go with the next record.
    """
    at = 0
    for pos, (i, j) in enumerate(json_spans(data)):
        if pos == 0:
            at = max(0, i - prefix)
            if at:
                yield 0, 0, data[:at]
        yield 1, pos, data[at:j]
        at = j
    if at < len(data):
        yield 2, 0, data[at:]


#: Whole chunks cut into pieces of which no byte is missing.
cut_fastq = reader("kind int, number long, value binary")(fastq_pieces)
cut_json = reader("kind int, number long, value binary")(json_pieces)


def _varint(b: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        x = b[at]
        value |= (x & 127) << shift
        at, shift = at + 1, shift + 7
        if x < 128:
            return (value >> 1) ^ -(value & 1), at


def _snappy(data: bytes) -> bytes:
    """One raw block, or the public framing of several with their sizes ahead."""
    def block(b: bytes) -> bytes:
        size = shift = at = 0
        while True:  # the size of the content comes first
            size |= (b[at] & 127) << shift
            if b[at] < 128:
                return pa.decompress(b, size, codec="snappy", asbytes=True)
            at, shift = at + 1, shift + 7

    if not data.startswith(b"\x82SNAPPY\0"):
        return block(data)
    out, at = [], 16
    while at < len(data):
        size = struct.unpack_from(">i", data, at)[0]
        out.append(block(data[at + 4 : at + 4 + size]))
        at += 4 + size
    return b"".join(out)


def _unpacked(codec: int, body: bytes) -> bytes:
    """The records of a batch by the codec's number in its attributes."""
    if codec == 1:
        return gzip.decompress(body)
    if codec == 2:
        return _snappy(body)
    if codec in (3, 4):
        return pa.input_stream(pa.py_buffer(body), compression={3: "lz4", 4: "zstd"}[codec]).read()
    if codec:
        raise ValueError(f"a batch has the unknown codec {codec}")
    return body


def _records(body: bytes, count: int, base: int, first: int) -> list[tuple]:
    """``(offset, time, key, value)`` of the records of a batch."""
    rows, i = [], 0
    for _ in range(count):
        _, i = _varint(body, i)
        i += 1
        dt, i = _varint(body, i)
        do, i = _varint(body, i)
        parts = []
        for _ in range(2):
            n, i = _varint(body, i)
            if i + max(n, 0) > len(body):
                raise IndexError("a record goes beyond its batch")
            parts.append(None if n < 0 else body[i : i + n])
            i += max(n, 0)
        headers, i = _varint(body, i)
        for _ in range(2 * headers):
            n, i = _varint(body, i)
            i += max(n, 0)
        rows.append((base + do, first + dt, *parts))
    return rows


#: Bits of a batch's attributes, and the type of an abort marker.
_TRANSACTIONAL, _CONTROL, _ABORT = 16, 32, b"\0\0"


@reader("offset long, ts long, key_bytes binary, value binary")
def read_kafka_log(data: bytes, values_only: bool = False, control: bool = False, committed_only: bool = False) -> Iterator[tuple]:
    """Records of a log segment's batches (public layout, version 2; plain, gzip, snappy, lz4 or zstd).

    A batch whose checksum (CRC-32C) or layout is wrong ends the chunk, and the rows before it
    stay; an unknown codec raises an error. The markers that end transactions are
    records only with ``control``. With ``committed_only`` the records of a transaction
    whose abort marker is in the chunk are left out.
    """
    at, held = 0, []  # (producer, rows): in the order of the batches
    markers: list[tuple[int, int, bool]] = []  # (producer, batches before, whether it aborts them)
    while at + 61 <= len(data):
        base, size = struct.unpack_from(">qi", data, at)
        end = at + 12 + size
        if size < 49 or end > len(data) or data[at + 16] != 2 or crc32c(data[at + 21 : end]) != struct.unpack_from(">I", data, at + 17)[0]:
            break
        attributes, _, first = struct.unpack_from(">hiq", data, at + 21)
        producer, count = struct.unpack_from(">q", data, at + 43)[0], struct.unpack_from(">i", data, at + 57)[0]
        try:
            rows = _records(_unpacked(attributes & 7, data[at + 61 : end]), count, base, first)
        except (IndexError, OSError, struct.error):
            break
        if attributes & _CONTROL:
            kind = rows[0][2] if rows else None  # version and type, two bytes each
            markers.append((producer, len(held), kind is not None and kind[2:4] == _ABORT))
            held.append((None, rows if control else []))
        else:
            held.append((producer if attributes & _TRANSACTIONAL else None, rows))
        at = end
    void, since = set(), {}
    for producer, before, aborts in markers if committed_only else ():
        if aborts:
            void |= {i for i in range(since.get(producer, 0), before) if held[i][0] == producer}
        since[producer] = before
    for i, (_, rows) in enumerate(held):
        if i not in void:
            yield from (r for r in rows if not values_only or r[3] is not None)


@reader("header string, sequence string, optional_header string, quality string")
def read_fastq(data: bytes) -> Iterator[tuple]:
    """Records of four lines; what precedes the first ``@`` line that starts one, and a cut-off tail, are left out."""
    lines = data.decode("utf-8", "replace").split("\n")
    i = 0
    while i + 3 < len(lines) and not (lines[i].startswith("@") and lines[i + 2].startswith("+")):
        i += 1
    while i + 3 < len(lines) and lines[i].startswith("@") and lines[i + 2].startswith("+"):
        yield lines[i][1:], lines[i + 1], lines[i + 2][1:], lines[i + 3]
        i += 4


def number_records(records: DataFrame, key: str = "key") -> DataFrame:
    """Ids over all records in the order of chunks: counts per chunk, running sums of those, places within."""
    n = records.groupBy(key).agg(F.count("*").alias("_n"))
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    return records.join(n.select(key, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_b")), key).withColumn("id", F.col("_b") + F.col("pos")).drop("_b")


def scan_ranges(spark: SparkSession, path: str, mb: int) -> DataFrame:
    """Lines of plain files, split into byte ranges of ``mb`` megabytes; lines at a cut are read once.

    The size of ranges is a setting of a session, so the scan has a session of its own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(mb << 20))
    return own.read.text(path)
