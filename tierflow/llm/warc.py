"""WARC archives: revisit records, segments and chunked framing, written and read back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import bounded, dealt, new_folder, new_name, numbered, stored
from ._files import Whole, open_fs

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL name space
_RECORD = "page_id bigint, kind string, refers bigint, digest string, origin string, segment int, total bigint, block binary"
_FIELDS = ["page_id", "kind", "refers", "digest", "origin", "segment", "total", "block"]
_READ = "page_id bigint, kind string, refers bigint, digest string, payload_bytes bigint, payload binary"
_PAGES = {"response", "resource", "revisit", "continuation"}  # the types of records that hold pages


def _name(page: int, digest: str) -> str:
    """Rows that share an id but not the payload have names of their own."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page}/{digest}')}>"


def chunked(data: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        if len(out[-1]) != size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def records(page: int | None, url: str | None, payload: bytes, refers: int | None, digest: str, segment: int, row: str | None = None) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a first segment and its continuations.

    A row without an id, or one that repeats another whole, is named by its place ``row``.
    """
    name = _name(page, digest) if row is None else f"<urn:uuid:{uuid.uuid5(_SPACE, row)}>"
    number = [] if page is None else [("Page-ID", str(page))]
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Record-ID", name), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", target), *number, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers, digest)), ("Refers-To-Page-ID", str(refers)), *common], head)
        return
    block = head + chunked(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(pieces) == 1:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    yield _record([("WARC-Type", "response"), ("WARC-Segment-Number", "1"), *common], pieces[0])
    for i, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(pieces) else []
        own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{name}/{i}')}>"
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i)), ("WARC-Date", "2020-01-01T00:00:00Z"), *last], piece)


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    unpack, parts, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(size):
        parts.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if parts and b"".join(parts):
        raise ValueError("an archive ends inside a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, body[: int(fields["content-length"])]


def find_revisits(pages: DataFrame, row_col: str, id_col: str = "page_id", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """``(row, refers_to, own)`` of the numbered pages that are revisits or need a name of their own.

    A revisit has a payload of at least ``least`` bytes that a page with a larger
    id has too. A name of its own needs a page without an id, and one of
    several with the same id and payload. Only digests are shuffled.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")
    narrow = stored(pages.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n")), "digests")
    first = narrow.where(F.col("n") >= least).groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    again = narrow.where("id is not null").groupBy("id", "sha").agg(F.count("*").alias("c")).where("c > 1")
    # stored, so that Spark may split a hot payload in the joins
    of = narrow.join(stored(first.select("sha", "first"), "first"), "sha", "left").join(stored(again.select("id", "sha", F.lit(True).alias("twice")), "again"), ["id", "sha"], "left")
    refers = F.when(F.col("id") < F.col("first"), F.col("first"))
    return of.select("row", refers.alias("refers_to"), (F.col("id").isNull() | F.col("twice").isNotNull()).alias("own")).where("refers_to is not null or own")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = 16 << 10, per_file: int = 4096) -> DataFrame:
    """Write one record (or its segments) per row and return ``(file, n)``.

    Equal payloads of at least 1000 bytes are stored with the largest id only.
    Rows are dealt to tasks as they come; a task run again writes the same names.
    Null payloads are empty, null urls too; a page without an id has records
    without Page-ID. Rows that repeat an id and a payload have records of their own.
    """
    from pyspark import TaskContext

    row = new_name(pages, "row")
    rows = numbered(pages, row)
    of = stored(find_revisits(rows, row, id_col, payload_col), "revisits")
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload")
    src = rows.select(F.col(row).alias("_row"), F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload)
    src = src.join(bounded(of), F.col("_row") == F.col("row"), "left").select("id", "url", "payload", "refers_to", F.coalesce("own", F.lit(False)).alias("own"))

    def run(batches):
        part, out, n, number, done = TaskContext.get().partitionId(), None, 0, 0, []
        run_id = uuid.uuid4().hex  # a task run again writes its files anew, so names of one file are of one run
        for b in batches:
            for page, url, payload, refers, own in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to", "own"))):
                out = out or Whole(path, f"pages-{part:06d}-{number:06d}.warc.gz")
                for r in records(page, url, payload, refers, hashlib.sha1(payload).hexdigest(), segment, f"row/{run_id}/{number}/{n}" if own else None):
                    out.write(r)
                n += 1
                if n == per_file:
                    out.close()
                    done.append((f"pages-{part:06d}-{number:06d}.warc.gz", n))
                    out, n, number = None, 0, number + 1
        if out is not None:
            out.close()
            done.append((f"pages-{part:06d}-{number:06d}.warc.gz", n))
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file", "n"])

    return src.mapInArrow(run, "file string, n bigint")


def _payload(block: bytes) -> bytes:
    """What follows the HTTP head; a block without one is all payload."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def hex_digest(label: str) -> str | None:
    """The SHA-1 of a digest header in hex; other writers give it in base32. Null for none and for other algorithms."""
    kind, _, value = label.partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def read_archives(spark: SparkSession, path: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """The pages of archives: ``(page_id, kind, refers, digest, payload_bytes, payload)``.

    A record in one piece is decoded where it is read. Segments, from whatever
    file, meet by their origin's identifier in the order of their numbers; gaps,
    repeats and a wrong total length raise an error, as does a payload whose
    SHA-1 is not the record's. ``payload`` is null if not asked for. Archives of
    other writers are read too: records that hold no page (information, requests,
    metadata) are left out, digests may be in base32 or missing, pages have no id.
    """
    def row(page, kind, refers, digest, block):
        if kind == "revisit":
            return page, kind, refers, digest, None, None
        data = _payload(block)
        found = hashlib.sha1(data).hexdigest()
        if digest is not None and found != digest:
            raise ValueError(f"page {page}: wrong digest")
        return page, kind, refers, found, len(data), data if payloads else None

    def scan(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                where, base = open_fs(path)
                with where.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows, size = [], 0
                    for m in members(stream):
                        f, block = parse(m)
                        if f["warc-type"] not in _PAGES:
                            continue
                        origin = f.get("warc-segment-origin-id") or (f["warc-record-id"] if "warc-segment-number" in f else None)
                        total = f.get("warc-segment-total-length")
                        refers, page = f.get("refers-to-page-id"), f.get("page-id")
                        rows.append((page and int(page), f["warc-type"], refers and int(refers), hex_digest(f.get("warc-payload-digest", "")), origin, int(f.get("warc-segment-number", 0)), total and int(total), block))
                        size += len(block)
                        if size > 4 << 20:
                            yield _batch(rows, _RECORD_SCHEMA)
                            rows, size = [], 0
                    yield _batch(rows, _RECORD_SCHEMA)

    def whole(batches):
        for b in batches:
            yield _batch([row(*r[:4], r[7]) for r in zip(*(b.column(c).to_pylist() for c in _FIELDS))], _READ_SCHEMA)

    def joined(batches):
        origin, first, parts, total = None, None, [], None

        def finish():
            if first is None or sum(map(len, parts)) != total:
                raise ValueError(f"{origin}: segments are missing")
            return row(*first[:4], b"".join(parts))

        for b in batches:
            out = []
            for r in zip(*(b.column(c).to_pylist() for c in _FIELDS)):
                if r[4] != origin:
                    if origin is not None:
                        out.append(finish())
                    origin, first, parts, total = r[4], None, [], None
                first = r if r[5] == 1 else first
                parts.append(r[7])
                total = r[6] if r[6] is not None else total
                if r[5] != len(parts):
                    raise ValueError(f"{origin}: segment {len(parts)} is missing")
            yield _batch(out, _READ_SCHEMA)
        if origin is not None:
            yield _batch([finish()], _READ_SCHEMA)

    found = dealt(files.select("file").distinct(), "file").mapInArrow(scan, _RECORD)
    one = found.where("origin is null").mapInArrow(whole, _READ)
    many = found.where("origin is not null").repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(joined, _READ)
    return one.unionByName(many)


_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("refers", pa.int64()), ("digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
_READ_SCHEMA = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("refers", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def archive_digest(pages: DataFrame, id_col: str = "page_id", **how) -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` of every row, from archives written and read back.

    A revisit's length is that of the record it refers to. Rows that repeat a
    page id and payload are responses alike if theirs is the largest id. Null
    payloads are empty, pages without an id are responses; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "archives")
    files = stored(write_archives(pages, path, id_col, **how), "files")
    back = stored(read_archives(spark, path, files, payloads=False).drop("payload"), "pages")
    size = back.where("kind = 'response'").groupBy(F.col("page_id").alias("refers"), F.col("digest")).agg(F.max("payload_bytes").alias("b"))
    again = back.where("kind = 'revisit'").drop("payload_bytes").join(stored(size, "lengths"), ["refers", "digest"], "left").withColumnRenamed("b", "payload_bytes")
    both = back.where("kind = 'response'").unionByName(again)
    return both.select(F.col("page_id").alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
