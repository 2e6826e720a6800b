"""Periodic runs of words, found by internal pattern matching, and their collapse."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: A run is at least so long, and at least two periods long.
LEAST = 12


class WaveletTree:
    """Ranks of values within ranges of a sequence of the numbers below its length, level by level of their bits."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.n_zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            one = (values >> level) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            self.n_zeros.append(int(before[-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many values at the places lo to hi - 1 are less than y."""
        count, all_ = np.zeros(len(y), np.int64), y >= 1 << self.bits
        size = hi - lo
        for level, (zeros, n) in enumerate(zip(self.zeros, self.n_zeros)):
            one = (y >> (self.bits - 1 - level)) & 1 == 1
            a, b = zeros[lo], zeros[hi]
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, n + lo - a, a), np.where(one, n + hi - b, b)
        return np.where(all_, size, count)

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value, from 0, at the places lo to hi - 1: the successor of y for k = below(lo, hi, y)."""
        out, k = np.zeros(len(k), np.int64), k.copy()
        for level, (zeros, n) in enumerate(zip(self.zeros, self.n_zeros)):
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            k -= np.where(one, b - a, 0)
            out += one.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(one, n + lo - a, a), np.where(one, n + hi - b, b)
        return out


def _blocks(x: np.ndarray, begin: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """A suffix array of ``x`` by doubling, and for every length 2, 4, 8, ...: (length, block starts, ranges of the array with that block).

    Only the blocks are given that start at a multiple of their length in their
    text, are found again, and leave room for two periods. ``begin`` is the
    start of the text of each place, ``left`` how many places the text has from there.
    """
    n, longest = len(x), int(left.max())
    sa = np.argsort(x, kind="stable")
    head = np.r_[True, x[sa][1:] != x[sa][:-1]]
    rank, slots = np.empty(n, np.int64), np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(head, slots, 0))
    out, size = [], 1
    many = ~(head & np.r_[head[1:], True])
    slots = slots[many]
    while len(slots) and (size < 2 or 2 * size <= (longest + 2) // 4):
        some = sa[slots]
        next_ = np.where(some + size < n, rank[np.minimum(some + size, n - 1)], -1)
        key = rank[some] * (n + 1) + next_ + 1
        order = np.argsort(key, kind="stable")
        some, key = some[order], key[order]
        sa[slots] = some
        head = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(head)
        width = np.diff(np.r_[first, len(key)])
        rank[some] = np.repeat(slots[first], width)
        width = np.repeat(width, width)
        many = width > 1
        slots, some, width, size = slots[many], some[many], width[many], 2 * size
        fit = ((some - begin[some]) % size == 0) & (left[some] >= (size + 1 if size == 2 else 3 * size - 1))
        at = some[fit]
        out.append((size, at, rank[at], rank[at] + width[fit]))
    return sa, out


class _Stretches:
    """Maximal ranges of places j with x[j] == x[j + q], found from a place in them and remembered."""

    def __init__(self, x: np.ndarray):
        self.x, self.held = x, {}

    def at(self, q: int, i: int) -> tuple[int, int] | None:
        starts, ends = self.held.setdefault(q, ([], []))
        k = bisect_right(starts, i)
        if k and ends[k - 1] > i:
            return starts[k - 1], ends[k - 1]
        x, n = self.x, len(self.x) - q
        if i >= n or x[i] != x[i + q]:
            return None
        b, step = i + 1, 8
        while b < n:
            same = x[b : min(n, b + step)] == x[b + q : min(n, b + step) + q]
            if not same.all():
                b += int(same.argmin())
                break
            b, step = b + len(same), 2 * step
        a, step = i, 8
        while a > 0:
            low = max(0, a - step)
            same = (x[low:a] == x[low + q : a + q])[::-1]
            if not same.all():
                a -= int(same.argmin())
                break
            a, step = low, 2 * step
        starts.insert(k, a), ends.insert(k, b)
        return a, b


def find_runs(x: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs in texts of numbered words laid end to end, sorted by start and period.

    Words of different texts have different numbers. A run of period q holds a
    block whose length is a power of two and divides its place, and the block q words
    further on (blocks of 2 words up to period 6, of L = 4, 8, ... for periods 2L - 1 to 4L - 2).
    So every such block asks a wavelet tree over the suffix array for its
    next occurrences in windows of L starts. One or two give their distances
    as candidate periods. Three or more are a progression whose difference d is
    the block's own period; then a run whose period is no multiple of d has
    both its copies of the maximal d-periodic range around the block start or end at its distance,
    or lies across two such ranges that touch. Candidates are proved by extension.
    """
    n = len(x)
    if n < least:
        return (np.empty(0, np.int64),) * 3
    size = np.diff(bounds)
    begin = np.repeat(bounds[:-1], size)
    sa, levels = _blocks(x, begin, np.repeat(bounds[1:], size) - np.arange(n))
    asked = []
    for length, at, lo, hi in levels:
        if len(at):
            edges = [1, 3, 5, 7] if length == 2 else [2 * length - 1, 3 * length - 1, 4 * length - 1]
            asked.append((at, lo, hi, np.full(len(at), length), np.stack([at + e for e in edges] + [at + edges[-1]] * (4 - len(edges)))))
    if not asked:
        return (np.empty(0, np.int64),) * 3
    at, lo, hi, length = (np.concatenate([a[k] for a in asked]) for k in range(4))
    edge = np.concatenate([a[4] for a in asked], axis=1)
    tree = WaveletTree(sa)
    rank = np.stack([tree.below(lo, hi, e) for e in edge])
    w, k = np.nonzero(np.diff(rank, axis=0) > 0)
    at, lo, hi, length, skip, count = at[k], lo[k], hi[k], length[k], rank[w, k], np.diff(rank, axis=0)[w, k]
    first = tree.nth(lo, hi, skip)
    more = count > 1
    second = tree.nth(lo[more], hi[more], skip[more] + 1)
    direct = count[more] == 2
    few = count < 3
    place = np.concatenate([at[few], at[more][direct]])
    period = np.concatenate([first[few] - at[few], second[direct] - at[more][direct]])
    known = _Stretches(x)
    place, period = _hopeful(x, place, period, least)
    candidates = list(zip(period.tolist(), place.tolist()))
    for i, j, d, m, span in zip(at[more][~direct].tolist(), first[more][~direct].tolist(), (second - first[more])[~direct].tolist(), count[more][~direct].tolist(), length[more][~direct].tolist()):
        here, there = known.at(d, i), known.at(d, j)
        if here == there or not here or not there:
            continue
        q = {there[0] - here[0], there[1] - here[1]}
        if here[1] + d >= there[0]:  # the two ranges touch
            q |= {j - i + t * d for t in range(m)}
        candidates += [(p, i) for p in q if 2 * span - 1 <= p <= 4 * span - 2]
    found: dict[tuple[int, int], int] = {}
    for q, i in sorted(set(candidates)):
        s = known.at(q, i)
        if s and s[1] - s[0] + q >= max(least, 2 * q):
            found.setdefault((s[0], s[1] - s[0] + q), q)  # of equal ranges the smallest period
    runs = sorted((s, q, m) for (s, m), q in found.items())
    s, q, m = (np.array([r[k] for r in runs], np.int64) for k in range(3))
    return s, m, q


def _hopeful(x: np.ndarray, i: np.ndarray, q: np.ndarray, least: int, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The candidates that a few words to either side don't rule out."""
    n = len(x)
    need = np.minimum(np.maximum(least - q, q), steps)
    have, right, left = np.ones(len(i), np.int64), np.ones(len(i), bool), np.ones(len(i), bool)
    for t in range(1, steps):
        j = np.minimum(i + t, n - 1 - q)
        right &= (i + t + q < n) & (x[j] == x[j + q])
        j = np.maximum(i - t, 0)
        left &= (i >= t) & (x[j] == x[j + q])
        have += right
        have += left
    ok = (have >= need) & (x[i] == x[i + q])
    return i[ok], q[ok]


def _pieces(batches, size: int):
    """Record batches in pieces with about ``size`` bytes of text."""
    for b in batches:
        held = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.r_[True, np.diff(np.cumsum(held) // size) > 0]) if b.num_rows else []
        for i, j in zip(at, [*at[1:], b.num_rows]):
            yield b.slice(i, j - i)
    pa.default_memory_pool().release_unused()


def periodic(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which word stands at each place of a text of ``n`` words whose end is rewritten as a period, if its id asks for it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def runs_of_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rewrite: bool = False, texts: bool = False) -> DataFrame:
    """``(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)``, one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of whole texts, numbered from 0. Of each run
    (see ``find_runs``) the words after its first period are dropped. ``start``,
    ``length``, ``period`` and the exponent are those of the longest run (then
    the first, then the smallest period), null without runs. With ``texts`` the
    columns ``runs`` (start, length, period) and ``collapsed`` follow.
    ``rewrite`` plants a period in the texts whose id asks for it (see ``periodic``).

    A null text has no words, no runs and an empty collapsed text. A row with a
    null id is never rewritten. Rows of one id are taken row by row; a very long
    text takes memory in proportion to its own length. An empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in _pieces(batches, 1 << 20):
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column("text").to_pylist()]
            ids = b.column("id").to_pylist()
            bounds = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
            flat = [x for w in words for x in w]
            code = pa.array(flat, pa.binary()).dictionary_encode() if flat else None
            x = code.indices.to_numpy().astype(np.int64) + np.repeat(np.arange(len(words)), np.diff(bounds)) * len(code.dictionary) if flat else np.empty(0, np.int64)
            if rewrite:
                for k, i in enumerate(ids):
                    if (at := periodic(len(words[k]), i)) is not None:
                        x[bounds[k] : bounds[k + 1]] = x[bounds[k] : bounds[k + 1]][at]
                        words[k] = [words[k][j] for j in at.tolist()]
            start, length, period = find_runs(x, bounds, least)
            lo = np.searchsorted(start, bounds)
            out = []
            for k, w in enumerate(words):
                s, m, q = (v[lo[k] : lo[k + 1]] for v in (start, length, period))
                s = s - bounds[k]
                best = (None,) * 4
                if len(s):
                    top = np.lexsort((q, s, -m))[0]
                    best = (int(s[top]), int(m[top]), int(q[top]), int(1000 * m[top] // q[top]))
                    gone = np.zeros(len(w) + 1, np.int64)
                    np.add.at(gone, s + q, 1), np.add.at(gone, s + m, -1)
                    w = [w[j] for j in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                rows, text = list(zip(s.tolist(), m.tolist(), q.tolist())), b" ".join(w)
                listed = "".join(f"{r[0]},{r[1]},{r[2]}\n" for r in rows)
                out.append((len(s), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), *([rows, text.decode("utf-8", "surrogatepass")] if texts else [])))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.string()] * 2 + _MORE)]
            yield pa.record_batch([b.column("id"), *cols], names=["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"][: 1 + len(cols)])

    kind = src.schema["id"].dataType.simpleString()
    more = ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" if texts else ""
    out = src.mapInArrow(run, f"id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string{more}")
    return out.withColumnRenamed("id", id_col)


_MORE = [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
