"""Readers of chunks that come in slices: records may begin in one slice and end in a later one.

``read_in_order`` carries what a reader has left over from slice to slice of a
chunk. ``read_apart`` decodes the slices of a chunk side by side.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators.metrics import running_sum
from .files import kept, new_folder

_HELD = 8 << 20  # bytes of rows that a task gathers before it gives them on

#: Of a slice: (bytes of a record in it, whether the record begins here, whether it ends here).
Fragment = tuple[bytes, bool, bool]


class Format:
    """How records lie in bytes. A state is a number that says all that a slice must know of those before it.

    ``exits`` gives the state after a slice for every state that may come before
    it, as rows (before, after); states without a row fall by the slice's length
    if they are ``beyond`` it, and else stop (-1). ``cut`` gives the fragments of a
    slice entered in a state. ``decode`` makes a record's row of its bytes.
    """

    schema = "value binary"
    start = 0
    ahead = 0  # bytes of the next slices that a slice has to see
    partial = False  # whether a record without its end counts at the end of the chunk

    def exits(self, data: bytes, ahead: bytes, left: int) -> list[tuple[int, int]]:
        raise NotImplementedError

    def beyond(self, state: int, size: int) -> bool:
        return False

    def cut(self, data: bytes, ahead: bytes, left: int, state: int) -> Iterator[Fragment]:
        raise NotImplementedError

    def decode(self, record: bytes) -> tuple | None:
        return (record,)


class Lines(Format):
    """Lines without their end and trailing white space; states: at the start of a line (0), amid one (1)."""

    schema = "value string"

    def __init__(self, partial: bool = False):
        self.partial = partial

    def exits(self, data, ahead, left):
        after = int(not data.endswith(b"\n"))
        return [(0, after), (1, after)]

    def cut(self, data, ahead, left, state):
        parts = data.split(b"\n")
        for i, p in enumerate(parts[:-1]):
            yield p + b"\n", not (i == 0 and state), True
        if parts[-1]:
            yield parts[-1], not (len(parts) == 1 and state), False

    def decode(self, record):
        return (record.decode("utf-8", "replace").rstrip(" \t\n\x0b\f\r"),)


class Marked(Format):
    """Spans from a start marker to the next end marker.

    States count the bytes seen of the start marker (outside), or, from the length
    of the start marker on, those of the end marker (inside).
    """

    def __init__(self, start: bytes = b"\xff\xd8", end: bytes = b"\xff\xd9"):
        self.first, self.last = start, end

    @staticmethod
    def _begun(data: bytes, mark: bytes) -> int:
        """How many bytes at the end of ``data`` may begin a marker."""
        return next((n for n in range(min(len(mark) - 1, len(data)), 0, -1) if data.endswith(mark[:n])), 0)

    def _walk(self, data: bytes, state: int) -> tuple[list[Fragment], int]:
        a, b, out = self.first, self.last, []
        inside = state >= len(a)
        text = (b[: state - len(a)] if inside else a[:state]) + data
        at = mine = len(text) - len(data)  # of an open span all up to here is in earlier slices
        begins, search = not inside, 0
        while True:
            if not inside:
                i = text.find(a, search)
                if i < 0:
                    return out, self._begun(text[search:], a)
                inside, begins, mine, search = True, True, i, i + len(a)
            j = text.find(b, search)
            if j < 0:
                out.append((text[mine:], begins, False))
                return out, len(a) + self._begun(text[search:], b)
            out.append((text[mine : j + len(b)], begins, True))
            inside, search = False, j + len(b)

    def exits(self, data, ahead, left):
        return [(s, self._walk(data, s)[1]) for s in range(len(self.first) + len(self.last))]

    def cut(self, data, ahead, left, state):
        yield from self._walk(data, state)[0]


class Frames(Format):
    """Frames of little-endian size (int32), time (int64) and payload, up to the first that is negative or cut off.

    The state is how many bytes on the next frame begins. As a slice does not
    know where that is, it says for each of its bytes where frames that begin
    there lead to; bytes that lead nowhere (no size that fits the chunk) are left out.
    """

    schema = "ts_ns long, frame binary"
    ahead = 11

    def _next(self, data: bytes, ahead: bytes, left: int) -> np.ndarray:
        """Where the next frame begins after one at each byte, or -1."""
        n = len(data)
        raw = np.frombuffer(data + ahead + bytes(12), np.uint8).astype(np.int64)
        size = (raw[:n] | raw[1 : n + 1] << 8 | raw[2 : n + 2] << 16 | raw[3 : n + 3] << 24).astype(np.uint32).view(np.int32).astype(np.int64)
        at = np.arange(n)
        return np.where((at + 12 <= n + len(ahead)) & (size >= 0) & (at + 12 + size <= left), at + 12 + size, -1)

    def exits(self, data, ahead, left):
        n, to = len(data), self._next(data, ahead, left)
        while True:  # by doubling
            inner = (to >= 0) & (to < n)
            if not inner.any():
                break
            to = np.where(inner, to[np.where(inner, to, 0)], to)
        alive = np.flatnonzero(to >= 0)
        return list(zip(alive.tolist(), (to[alive] - n).tolist()))

    def beyond(self, state, size):
        return state >= size

    def cut(self, data, ahead, left, state):
        n, at = len(data), state
        if state < 0:
            return
        if at:
            yield data[:at], False, at <= n
        while at < n:
            if at + 12 > n + len(ahead):
                return
            size = struct.unpack("<i", (data + ahead)[at : at + 4])[0]
            if size < 0 or at + 12 + size > left:
                return
            yield data[at : at + 12 + size], True, at + 12 + size <= n
            at += 12 + size

    def decode(self, record):
        return struct.unpack_from("<q", record, 4)[0], record[12:]


def _beside(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """``rows`` with the columns that ``narrow`` has for their slices."""
    of = narrow.withColumnsRenamed({"key": "_key", "slice": "_slice"})
    return rows.join(of, F.col("key").eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice"))).drop("_key", "_slice")


def read_apart(slices: DataFrame, form: Format) -> DataFrame:
    """``(key, pos, ...)``: the records of chunks in slices ``(key, slice, content)``, equal to those of the whole chunks.

    The state in which each slice begins is found from what all slices of the
    chunk do to a state, which is all that comes together by chunk. Then every
    slice is cut on its own; only records that cross a cut are gathered.
    """
    path = new_folder(slices.sparkSession, "slices")
    rows = slices.select("key", F.col("slice").cast("long").alias("slice"), F.col("content").cast("binary").alias("content")).where(F.octet_length("content") > 0)
    kind = rows.schema["key"].dataType.simpleString()
    if form.ahead:
        w = Window.partitionBy("key").orderBy("slice")  # a short row a slice
        rows = kept(rows, f"{path}/rows")
        head = F.array_join(F.collect_list(F.hex(F.substring("content", 1, form.ahead))).over(w.rowsBetween(1, form.ahead)), "")
        narrow = rows.select("key", "slice", F.unhex(F.substring(head, 1, 2 * form.ahead)).alias("ahead"), F.sum(F.octet_length("content")).over(w.rowsBetween(0, Window.unboundedFollowing)).cast("long").alias("left"))
        rows = _beside(rows, kept(narrow, f"{path}/narrow"))
    else:
        rows = rows.withColumn("ahead", F.lit(b"")).withColumn("left", F.lit(0).cast("long"))
    rows = kept(rows.select("key", "slice", "content", "ahead", "left"), f"{path}/seen")

    def moves(batches):
        for b in batches:
            at, size, did, held = 0, [], [], 0
            for i, (data, ahead, left) in enumerate(zip(*(b.column(c) for c in ("content", "ahead", "left")))):
                data = data.as_py()
                size.append(len(data))
                did.append(np.array(form.exits(data, ahead.as_py() or b"", left.as_py()), "<i8").tobytes())
                held += len(did[-1])
                if held > _HELD or i + 1 == b.num_rows:
                    n = len(size)
                    yield pa.record_batch([b.column("key").slice(at, n), b.column("slice").slice(at, n), pa.array(size, pa.int64()), pa.array(did, pa.binary())], names=["key", "slice", "size", "moves"])
                    at, size, did, held = at + n, [], [], 0

    def enter(batches):
        last, state = object(), form.start
        for b in batches:
            found = []
            for key, size, held in zip(b.column("key").to_pylist(), b.column("size").to_pylist(), b.column("moves")):
                if key != last:
                    last, state = key, form.start
                found.append(state)
                pairs = np.frombuffer(held.as_buffer(), "<i8").reshape(-1, 2)
                i = np.searchsorted(pairs[:, 0], state)
                if i < len(pairs) and pairs[i, 0] == state:
                    state = int(pairs[i, 1])
                else:
                    state = state - size if state >= 0 and form.beyond(state, size) else -1
            yield pa.record_batch([b.column("key"), b.column("slice"), pa.array(found, pa.int64())], names=["key", "slice", "state"])

    def fragments(batches):
        for b in batches:
            out, held = [], 0
            for i, (data, ahead, left, state) in enumerate(zip(*(b.column(c) for c in ("content", "ahead", "left", "state")))):
                n = 0
                for piece, begins, ends in form.cut(data.as_py(), ahead.as_py() or b"", left.as_py(), state.as_py()):
                    out.append((i, n, piece, begins, ends))
                    n, held = n + ends, held + len(piece) + 64
                if out and (held > _HELD or i + 1 == b.num_rows):
                    of, *cols = zip(*out)
                    some = b.select(["key", "slice"]).take(pa.array(of, pa.int64()))
                    yield pa.record_batch([*some.columns, *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.bool_(), pa.bool_()))]], names=["key", "slice", "n", "piece", "begins", "ends"])
                    out, held = [], 0

    did = rows.mapInArrow(moves, f"key {kind}, slice long, size long, moves binary")
    states = did.repartition("key").sortWithinPartitions("key", "slice").mapInArrow(enter, f"key {kind}, slice long, state long")
    entered = _beside(rows, kept(states, f"{path}/states")).select("key", "slice", "content", "ahead", "left", "state")
    found = kept(entered.mapInArrow(fragments, f"key {kind}, slice long, n long, piece binary, begins boolean, ends boolean"), f"{path}/fragments")
    ends = found.groupBy("key", "slice").agg(F.sum(F.col("ends").cast("long")).alias("ends"))
    before = running_sum(ends, ["key"], ["slice"], F.col("ends"), "upto").select("key", "slice", (F.col("upto") - F.col("ends")).alias("before"))
    placed = _beside(found, kept(before, f"{path}/before"))
    placed = placed.select("key", (F.col("before") + F.col("n")).alias("pos"), "slice", "piece", "begins", "ends")
    whole = placed.where("begins and ends").select("key", "pos", "piece")
    parts = placed.where("not (begins and ends)").groupBy("key", "pos").agg(
        F.array_sort(F.collect_list(F.struct("slice", F.hex("piece").alias("piece")))).alias("parts"), F.max("ends").alias("ends"), F.max("begins").alias("begins"))
    parts = parts.where(F.col("begins") & (F.col("ends") | F.lit(form.partial)))
    parts = parts.select("key", "pos", F.unhex(F.array_join(F.transform("parts", lambda x: x["piece"]), "")).alias("piece"))
    return decoded(whole.unionByName(parts), form.decode, form.schema)


def decoded(records: DataFrame, decode: Callable[[bytes], tuple | None], schema: str) -> DataFrame:
    """``(key, pos, ...)`` of records ``(key, pos, piece)``; what ``decode`` gives no row for is left out."""
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            made = [decode(p) for p in b.column("piece").to_pylist()]
            ok = [i for i, m in enumerate(made) if m is not None]
            cols = list(zip(*[made[i] for i in ok])) or [[]] * len(kinds)
            some = b.take(pa.array(ok, pa.int64()))
            yield pa.record_batch([some.column("key"), some.column("pos"), *[pa.array(c, f.type) for c, f in zip(cols, kinds)]], names=["key", "pos", *kinds.names])

    return records.mapInArrow(run, f"key {records.schema['key'].dataType.simpleString()}, pos long, {schema}")


def read_in_order(slices: DataFrame, decode: Callable[[bytes, bool], tuple[list[tuple], int]], schema: str) -> DataFrame:
    """``(key, pos, ...)`` by any reader: ``decode(data, last)`` gives rows and how many bytes it has used.

    The rest waits for the next slice of the chunk; ``last`` is true for the last
    call of a chunk. Slices of a chunk pass one task in order, which
    holds one slice and the rest of those before.
    """
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    rows = slices.select("key", "slice", F.col("content").cast("binary").alias("content"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        key, rest, pos, begun = None, b"", 0, False

        def given(made, key_type):
            nonlocal pos
            cols = list(zip(*made)) or [[]] * len(kinds)
            at = pa.array(range(pos, pos + len(made)), pa.int64())
            pos += len(made)
            return pa.record_batch([pa.array([key] * len(made), key_type), at, *[pa.array(c, f.type) for c, f in zip(cols, kinds)]], names=["key", "pos", *kinds.names])

        key_type = None
        for b in batches:
            key_type = b.schema.field("key").type
            for k, data in zip(b.column("key").to_pylist(), b.column("content")):
                if begun and k != key:
                    yield given(decode(rest, True)[0], key_type)
                    rest, pos = b"", 0
                key, begun = k, True
                rest += data.as_py() or b""
                made, used = decode(rest, False)
                rest = rest[used:]
                yield given(made, key_type)
        if begun:
            yield given(decode(rest, True)[0], key_type)

    return rows.repartition("key").sortWithinPartitions("key", "slice").select("key", "content").mapInArrow(run, f"key {kind}, pos long, {schema}")


def sliced(chunks: DataFrame, size: int, key: str = "key", content: str = "content") -> DataFrame:
    """Chunks as slices of ``size`` bytes, ``(key, slice, content)``."""
    c = chunks.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("_c"))
    last = F.ceil(F.octet_length("_c") / size).cast("int") - 1
    at = c.where(last >= 0).select("key", "_c", F.posexplode(F.sequence(F.lit(0), last)).alias("slice", "_i"))
    return at.select("key", F.col("slice").cast("long").alias("slice"), F.substr("_c", F.col("_i") * size + 1, F.lit(size)).alias("content"))
