import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.llm.periodic_runs import WaveletTree, find_runs, runs_of_words


def _runs(x, least=12):
    """(start, period, length) of all runs, period by period."""
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        j = 0
        while j < n - q:
            k = j
            while k < n - q and x[k] == x[k + q]:
                k += 1
            if k > j and k - j + q >= max(least, 2 * q):
                out.setdefault((j, k - j + q), q)
            j = k + 1
    return sorted((s, q, m) for (s, m), q in out.items())


def _texts(rng):
    """Words over small alphabets: random, tiled, Fibonacci, tiled with an error, pieces of one period, touching ranges of one period."""
    for kind in range(6):
        for _ in range(40):
            n, v = int(rng.integers(0, 150)), int(rng.integers(1, 5))
            x = rng.integers(0, v, n)
            if kind == 1:
                x = np.tile(x[: max(1, n // int(rng.integers(1, 8)))], 9)[:n]
            elif kind == 2:
                a, b = [0], [0, 1]
                while len(b) < n:
                    a, b = b, b + a
                x = np.array(b[:n])
            elif kind == 3 and n:
                x = np.tile(x[: max(1, n // 4)], 4)
                x[rng.integers(0, len(x), 2)] = 7
            elif kind == 4:
                u = np.tile(rng.integers(0, v, int(rng.integers(1, 6))), 8)
                x = np.concatenate([u[: rng.integers(0, len(u) + 1)] for _ in range(8)])
            elif kind == 5:
                u = np.tile([0, 1, 2][: int(rng.integers(2, 4))], 12)
                x = np.r_[u[: rng.integers(4, len(u))], u[: rng.integers(4, len(u))]]
            yield x.tolist()


@pytest.mark.parametrize("seed", [0, 1])
def test_runs_match_brute_force(seed):
    texts = list(_texts(np.random.default_rng(seed)))
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    x = np.concatenate([np.array(t, np.int64) + 10 * k for k, t in enumerate(texts)])
    start, length, period = find_runs(x, bounds)
    want = [(s + bounds[k], q, m) for k, t in enumerate(texts) for s, q, m in _runs(t)]
    assert list(zip(start.tolist(), period.tolist(), length.tolist())) == want and len(want) > 400


def test_successors_in_a_wavelet_tree():
    rng = np.random.default_rng(3)
    v = rng.permutation(777)
    tree = WaveletTree(v)
    lo = rng.integers(0, 700, 300)
    hi, y = lo + rng.integers(1, 77, 300), rng.integers(0, 1100, 300)
    below = tree.below(lo, hi, y)
    assert below.tolist() == [int((v[a:b] < c).sum()) for a, b, c in zip(lo, hi, y)]
    some = below < hi - lo
    assert tree.nth(lo[some], hi[some], below[some]).tolist() == [min(z for z in v[a:b] if z >= c) for a, b, c in zip(lo[some], hi[some], y[some])]


def _want(doc_id, text, rewrite=True):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewrite and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = _runs(w)
    dropped = {j for s, q, m in runs for j in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, q, m in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in dropped)))


def test_runs_of_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000")
    rows = docs.select("doc_id", "text").collect()
    got = runs_of_words(docs, rewrite=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted((_want(*r) for r in rows), key=str)
    assert sum(r.n_runs for r in got) > 10


def test_odd_texts(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b " * 20), (None, None), (5, "a " * 40 + "\x1c b c" * 9), (5, "a " * 40 + "\x1c b c" * 9), (6, "x" * 3000), (7, "é y " * 12)]
    rows += [(i, " ".join(f"w{j % (7 + i)}" for j in range(30 * k))) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "start", "n_runs", "runs", "_metadata")])
    for df, rewrite in ((docs, True), (clash, False)):
        got = runs_of_words(df, rewrite=rewrite).collect()
        assert sorted(map(tuple, got), key=str) == sorted((_want(*r, rewrite) for r in rows), key=str)
    long = runs_of_words(spark.createDataFrame([(1, "b " + " ".join(f"w{j % 5000}" for j in range(60_000)))], "doc_id long, text string"), texts=True).first()
    assert [tuple(r) for r in long.runs] == [(1, 60_000, 5000)] and long.collapsed.split() == ["b", *(f"w{j}" for j in range(5000))]
    assert runs_of_words(docs.where("false")).count() == 0
