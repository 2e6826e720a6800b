import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.llm.suffix_dedup import anchors, remove_repeats


def _removed(texts, length):
    """(bytes, removed, runs, digest of the rest) of each text, by brute force."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


def _same(got, ids, want):
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(str((i, *w)) for i, w in zip(ids, want))


def _made(rng):
    """Texts that share passages around the length, cut, edited, periodic, in copies."""
    word = lambda: "".join(rng.choice(list("abcdeé "), rng.integers(2, 9)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.integers(0, 40)))]
        for _ in range(rng.integers(0, 3)):
            p = passage[rng.integers(6)]
            a = rng.integers(0, len(p) // 2)
            parts += [p[a : a + rng.integers(150, 300)], word()]
        texts.append("".join(parts))
    texts += texts[:5] + [None, "", "x" * 700, "x" * 199, "ab" * 300, ("q" * 90 + "r") * 9, passage[0][:200], passage[0][1:201]]
    edited = list(texts[3] + passage[2] * 4)
    for k in range(50, len(edited), 170):
        edited[k] = "#"
    return texts + ["".join(edited)]


def test_repeats_match_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = _made(rng)
    ids = [None if i % 17 == 0 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    want = _removed(texts, 200)
    assert sum(w[1] for w in want) > 20_000
    _same(remove_repeats(docs), ids, want)
    extra = docs.select("*", *[F.lit(1).alias(c) for c in ("rid", "id", "_metadata", "_rid", "chunk", "at", "start")])
    _same(remove_repeats(extra, length=64, gram=16), ids, _removed(texts, 64))
    kept = remove_repeats(docs, keep_bytes=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in kept)
    assert remove_repeats(docs.where("false")).count() == 0


def test_repeats_of_the_tables_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    _same(remove_repeats(docs), [r.doc_id for r in rows], _removed([r.text for r in rows], 200))


@pytest.mark.parametrize("size", [150, 5000, 700_000])
def test_equal_windows_have_equal_anchors(size):
    rng = np.random.default_rng(size)
    one = rng.integers(97, 100, size).astype(np.uint8)
    data, bounds = np.concatenate([one, one[: size // 2]]), np.array([0, size, size + size // 2])
    seen, windows = {}, 0
    for text, start, count, offset, bucket, *_ in anchors(data, bounds, 100, 20):
        for t, s, c, o, g in zip(text, start, count, offset, bucket):
            for k in range(c if size < 6000 else 1):
                seen.setdefault((s + k), set()).add((o - k, g))
                windows += 1
    assert all(len(x) == 1 for x in seen.values())
    assert size > 6000 or windows == sum(max(0, n - 99) for n in np.diff(bounds))


def test_several_files_in_one_task(spark, tmp_path):
    texts = _made(np.random.default_rng(4))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(30).write.parquet(f"{tmp_path}/docs")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        docs = spark.read.parquet(f"{tmp_path}/docs")
        assert docs.rdd.getNumPartitions() == 1
        _same(remove_repeats(docs), range(len(texts)), _removed(texts, 200))
    finally:
        for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.set(k, held[k]) if k in held else spark.conf.unset(k)
