import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.llm.spelling_variants import group_variants


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _deletions(w):
    return {w[:k] + w[k + 1 :] for k in range(len(w))}


def _want(rows, shortest=7, least=2, ratio=10, planted=True):
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if planted and i is not None and h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= shortest and c >= least}
    met = defaultdict(set)  # words that share themselves or a deletion
    for w in n:
        for x in {w, *_deletions(w)}:
            met[x].add(w)
    near = {w: {v for x in {w, *_deletions(w)} for v in met[x] if _near(w, v)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def _same(docs, **how):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in group_variants(docs, planted=True, **how).collect()]
    want = _want(rows)
    assert len(got) == len(want) and set(got) == want
    return want


def test_variants_of_the_tables(spark, sf):
    want = _same(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sum(r[4] > 0 for r in want) > 50


@pytest.mark.parametrize("block", [256, 8])
def test_variants_match_brute_force(spark, block):
    rng = np.random.default_rng(block)
    stems = ["".join(rng.choice(list("abé"), rng.integers(7, 11))) for _ in range(30)]
    words = []
    for k, w in enumerate(stems):
        words += [w] * int(10 ** rng.integers(0, 4))
        for _ in range(12):
            x, p = list(w), int(rng.integers(len(w)))
            kind = rng.integers(3)
            x[p : p + 1] = [x[p], "a"] if kind == 0 else [] if kind == 1 else ["b"]
            words += ["".join(x)] * int(rng.integers(1, 12))
    words += ["prefix" + "".join(rng.choice(list("abcdefgh"), 3)) for _ in range(1500)] * 2  # one large group
    words += ["chainaaaa"] * 3 + ["chainaaab"] * 80 + ["chainaabb"] * 1500
    rng.shuffle(words)
    docs = [(None if i % 9 == 0 else i // 2, " ".join(words[i * 400 : (i + 1) * 400])) for i in range(len(words) // 400 + 1)]
    want = _same(spark.createDataFrame(docs, "doc_id long, text string"), block=block)
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms


def test_odd_words(spark):
    long = "y" * 30_000
    rows = [(1, None), (2, ""), (3, "1234 short words ab"), (None, f"{long} x{long} Straßenbahn STRASSENBAHN"), (5, f"{long} x{long} ÉTRANGES éTRANGES Étranges étrangers"), (5, "Straßenbahn Étranges étrangers 日本abcdefgh abcdefgh"), (5, "Straßenbahn Étranges étrangers 日本abcdefgh abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _same(docs.select("*", *[F.lit(1).alias(c) for c in ("id", "word", "n", "key", "_metadata")]))
    assert group_variants(docs.where("false")).count() == 0
