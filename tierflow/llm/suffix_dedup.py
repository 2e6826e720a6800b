"""Repeated byte strings, found by bucket-pointer refinement over anchored suffixes, and their removal."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._common import mix, new_folder, numbered, pieces_of, stored
from ._files import open_fs

_CHUNK = 15  # rows of 2^15 places share a side file
_SEGMENT = 1 << 18  # window starts that are looked at together
_PLACE = np.uint64((1 << 20) - 1)
_LEVELS = (6, 4, 2, 0)  # widths of the offset ranges, as powers of two


class Rolling:
    """Hashes of any substring of a segment, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        r = int(rng.integers(1 << 62, dtype=np.int64)) * 8 + 5
        self.of_byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = self._powers(r, size), self._powers(pow(r, -1, 1 << 64), size)

    @staticmethod
    def _powers(r: int, n: int) -> np.ndarray:
        out, k = np.ones(n, np.uint64), 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(pow(r, k, 1 << 64))
            k += m
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (prefix[b] - prefix[a]) * self.down[a]


_rolling: dict[int, tuple[Rolling, Rolling]] = {}


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column, one after the other, and where each starts (and the last ends)."""
    col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    at = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.empty(0, np.uint8)), at - at[0]


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Arrays ``(text, start, count, offset, bucket, mark, mark2)`` of the anchors of some texts laid end to end.

    The anchor of a window of ``length`` bytes is the q-gram of least hash in it
    (the first of equal ones), so equal windows have it at the same offset. An
    anchor serves ``count`` windows in a row from byte ``start`` of its text, the
    first of which has it at ``offset``. ``bucket`` is the q-gram's hash,
    the marks are those of all bytes that its windows cover.
    """
    if length not in _rolling:
        _rolling[length] = (Rolling(7, _SEGMENT + length + 1), Rolling(8, _SEGMENT + length + 1))
    one, two = _rolling[length]
    wide, ends = length - gram + 1, bounds[1:]
    for s in range(0, len(data) - length + 1, _SEGMENT):
        part = data[s : s + _SEGMENT + length - 1]
        n = len(part) - length + 1
        fits = np.ones(n, bool)  # windows that end in their own text
        for e in ends[slice(*np.searchsorted(ends, [s + 1, s + n + length - 1]))] - s:
            fits[max(0, e - length + 1) : max(0, min(e, n))] = False
        i = np.flatnonzero(fits)
        if not len(i):
            continue
        with np.errstate(over="ignore"):
            p1, p2 = one.prefix(part), two.prefix(part)
            h = mix((p1[gram:] - p1[:-gram]) * one.down[: len(p1) - gram])
            # least hash of every window by running minima within blocks, from the left and from the right
            m, blocks = len(h), -(-len(h) // wide)
            key = np.full(blocks * wide, np.iinfo(np.uint64).max)
            key[:m] = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
            key = key.reshape(blocks, wide)
            right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
            left = np.minimum.accumulate(key, axis=1).ravel()
            at = (np.minimum(right[:n], left[wide - 1 : wide - 1 + n]) & _PLACE).astype(np.int64)[i]
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (i[1:] != i[:-1] + 1)])
            count, start, place = np.diff(np.r_[new, len(i)]), i[new], at[new]
            end = start + count - 1 + length
            shape = ((place - start) * 1000 + count).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
            mark, mark2 = mix(one.between(p1, start, end) + shape), mix(two.between(p2, start, end) + shape)
        text = np.searchsorted(ends, s + start, side="right")
        yield text, s + start - bounds[text], count, place - start, h[place], mark, mark2


def _find(length: int, gram: int):
    def run(batches):
        for b in pieces_of(batches):
            data, bounds = flat(b.column("text"))
            rid = b.column("rid").to_numpy()
            for text, start, count, offset, bucket, mark, mark2 in anchors(data, bounds, length, gram):
                at = (start << 16) | (offset << 8) | (count - 1)
                yield pa.record_batch([pa.array(rid[text]), pa.array(at), pa.array(bucket.view(np.int64)), pa.array(mark.view(np.int64)), pa.array(mark2.astype(np.uint32).view(np.int32))], names=["rid", "at", "g", "c1", "c2"])

    return run


class Side:
    """The rows of a chunk's side file, by row number; the last file read stays until the task ends."""

    _held: tuple[str, "Side"] | None = None

    def __init__(self, folder: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        where, base = open_fs(folder)
        found = [f.path for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet")]
        tables = [pq.read_table(f, filesystem=where, partitioning=None) for f in found]
        self.table = pa.concat_tables(tables).sort_by("rid").combine_chunks() if tables else None
        self.rid = self.table["rid"].to_numpy() if tables else np.empty(0, np.int64)

    @classmethod
    def rows(cls, folder: str, rids: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of the rows from the first to the last of the increasing ``rids``."""
        out = []
        for chunk in range(int(rids[0]) >> _CHUNK, (int(rids[-1]) >> _CHUNK) + 1):
            name = f"{folder}/chunk={chunk}"
            if cls._held is None or cls._held[0] != name:
                cls._held = None
                cls._held = (name, cls(name))
            side = cls._held[1]
            i, j = np.searchsorted(side.rid, rids[0]), np.searchsorted(side.rid, rids[-1], side="right")
            if j > i:
                out.append(side.table.slice(i, j - i))
        return {c: np.concatenate([t[c].to_numpy() for t in out]) for c in out[0].column_names} if out else {}


def _in_order(batches):
    """Record batches of rows that follow each other in their numbers; a task may read several files, in any order."""
    for b in pieces_of(batches):
        rids = b.column("rid").to_numpy()
        at = np.flatnonzero(np.r_[True, rids[1:] != rids[:-1] + 1]) if len(rids) else []
        for i, j in zip(at, [*at[1:], len(rids)]):
            yield b.slice(i, j - i)


def _beside(rows: DataFrame, tag: str) -> str:
    """A folder with a side file of ``rows`` (by ``rid``) for each chunk, which passes over the texts look up."""
    folder = new_folder(rows.sparkSession, tag)
    rows.withColumn("chunk", F.shiftright("rid", _CHUNK)).repartition("chunk").write.partitionBy("chunk").parquet(folder)
    return folder


def _names(folder: str, length: int, gram: int, level: int):
    """Names of the parts of each open range of offsets of an anchor.

    A row of the side files is an anchor at byte ``p`` with windows that have it
    at the offsets ``a`` to ``b``. They are parted where ``2^level`` divides the
    offset. ``name`` stands for the bytes that all windows with offsets of the
    part would share, ``u1`` and ``u2`` for all that the present ones cover.
    """

    def named(rows):
        rid, p, x, y, done, name, union = zip(*rows) if rows else ((),) * 7
        union = np.frombuffer(b"".join(union), "<i8").reshape(-1, 2)
        return pa.record_batch([
            pa.array(rid, pa.int64()), pa.array(p, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(done, pa.bool_()),
            pa.array(np.array(name, np.uint64).view(np.int64)), pa.array(union[:, 0].copy()), pa.array(union[:, 1].copy()),
        ], names=["rid", "p", "a", "b", "done", "name", "u1", "u2"])

    def run(batches):
        for batch in _in_order(batches):
            rids, text = batch.column("rid").to_numpy(), batch.column("text")
            side = Side.rows(folder, rids)
            if not side:
                continue
            at, out, held, data = np.searchsorted(rids, side["rid"]), [], -1, b""
            for k, rid, p, a, b, done in zip(at.tolist(), side["rid"].tolist(), side["p"].tolist(), side["a"].tolist(), side["b"].tolist(), side["done"].tolist()):
                if k != held:
                    held, data = k, text[k].as_py().encode("utf-8", "surrogatepass")
                for j in range(a >> level, (b >> level) + 1):
                    low, high = j << level, min(((j + 1) << level) - 1, length - gram)
                    x, y = max(a, low), min(b, high)
                    name = xxhash.xxh3_64_intdigest(data[p - low : p + length - high], (level << 16) + j)
                    union = xxhash.xxh3_128_digest(data[p - y : p + length - x], (x << 16) + y)
                    out.append((rid, p, x, y, done, name, union))
                if len(out) > 100_000:  # a very long text may have any number
                    yield named(out)
                    out = []
            yield named(out)
        Side._held = None

    return run


def repeated_spans(rows: DataFrame, length: int = 200, gram: int = 32) -> DataFrame:
    """``(rid, start, end)``: byte ranges of ``rows`` (``rid``, ``text``) covered by strings of ``length`` bytes that start twice or more.

    Suffixes are bucketed by the q-gram they start with. Only anchors are kept,
    as equal strings have equal anchors (see ``anchors``). A bucket whose
    suffixes all have the same surroundings is settled: its strings repeat if it
    holds two. The others are refined by names of the bytes at earlier and later
    offsets, range of offsets by range, each range parted into narrower ones
    that start from the buckets of the last round, until it is settled: its
    name is found once (no repeat), or all its rows cover equal bytes. Equal
    rows go on as one. The ranges of the last round are single strings.

    Texts are read once a round and never shuffled; what a round needs to know of
    a chunk of rows lies in a side file of that chunk.
    """
    if not gram <= length <= gram + 255:
        raise ValueError("a string may be up to 255 bytes longer than a q-gram")
    found = stored(rows.select("rid", "text").mapInArrow(_find(length, gram), "rid bigint, at bigint, g bigint, c1 bigint, c2 int"), "anchors")
    classes = found.groupBy("g", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("first"))
    classes = stored(classes.select("g", "c1", "c2", "n", "first.rid", "first.at"), "classes")
    start, offset, count = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255) + 1
    twice = stored(classes.where("n > 1").select("c1", "c2"), "twice")
    whole = found.select("rid", "at", "c1", "c2").join(twice, ["c1", "c2"])
    spans = [stored(whole.select("rid", start.alias("start"), (start + count - 1 + length).alias("end")), "whole")]
    many = stored(classes.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"), "many")
    state = classes.join(many, "g", "left_semi").select(
        "rid", (start + offset).alias("p"), (offset - count + 1).alias("a"), offset.alias("b"), (F.col("n") > 1).alias("done"))
    for level in _LEVELS:
        named = rows.select("rid", "text").mapInArrow(_names(_beside(state, "open"), length, gram, level), "rid bigint, p bigint, a bigint, b bigint, done boolean, name bigint, u1 bigint, u2 bigint")
        named = stored(named, "named")
        one = (F.min("u1") == F.max("u1")) & (F.min("u2") == F.max("u2"))
        groups = stored(named.groupBy("name").agg(F.count("*").alias("n"), one.alias("one")).where("n > 1").select("name", "one"), "groups")
        live = stored(named.join(groups, "name"), "live")
        span = lambda df: df.where("not done").select("rid", (F.col("p") - F.col("b")).alias("start"), (F.col("p") - F.col("a") + length).alias("end"))
        spans.append(span(live.where("one")))
        rest = live.where("not one")
        same = stored(rest.groupBy("name", "u1", "u2").agg(F.count("*").alias("m"), F.min(F.struct("rid", "p", "a")).alias("first")).where("m > 1"), "same")
        rest = rest.join(same, ["name", "u1", "u2"], "left")
        rest = stored(rest.select("rid", "p", "a", "b", "done", F.coalesce("m", F.lit(1)).alias("m"), (F.col("m").isNull() | (F.col("first") == F.struct("rid", "p", "a"))).alias("goes")), "rest")
        spans.append(span(rest.where("m > 1")))
        state = rest.where("goes").select("rid", "p", "a", "b", (F.col("done") | (F.col("m") > 1)).alias("done"))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes covered by some ranges."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[new[1:], True]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32, keep_bytes: bool = False) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``docs``; with ``keep_bytes`` also ``kept``.

    Removes every byte of the UTF-8 texts that is covered by a string of
    ``length`` bytes which also starts anywhere else, in the same text or
    another; a removed run may begin or end inside a character. Rows are
    compared by themselves, so the texts of rows repeated whole or of one id
    repeat each other. A null text counts as empty, texts shorter than
    ``length`` keep all bytes, a null id stays null. An empty table gives no rows.
    """
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rid")
    folder = _beside(repeated_spans(rows, length, gram), "spans")

    def run(batches):
        for batch in _in_order(batches):
            rids = batch.column("rid").to_numpy()
            side = Side.rows(folder, rids)
            data, bounds = flat(batch.column("text"))
            raw, out = memoryview(data), []
            lo = np.searchsorted(side["rid"], rids) if side else np.zeros(len(rids), int)
            hi = np.searchsorted(side["rid"], rids, side="right") if side else lo
            for k in range(len(rids)):
                text = raw[bounds[k] : bounds[k + 1]]
                start, end = _merged(side["start"][lo[k] : hi[k]], side["end"][lo[k] : hi[k]]) if hi[k] > lo[k] else (np.empty(0, int),) * 2
                kept, digest = [text[i:j] for i, j in zip([0, *end.tolist()], [*start.tolist(), len(text)])], hashlib.sha256()
                for x in kept:
                    digest.update(x)
                out.append((len(text), int((end - start).sum()), len(start), digest.hexdigest(), b"".join(kept) if keep_bytes else None))
            n, removed, spans, sha, kept = zip(*out) if out else ((),) * 5
            cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.record_batch(cols + ([pa.array(kept, pa.binary())] if keep_bytes else []), names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)
        Side._held = None

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "rid", "text").mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes)
    return out.withColumnRenamed("id", id_col)
