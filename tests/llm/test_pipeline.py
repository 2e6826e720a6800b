import hashlib
import math

import corpus_pipeline


def test_stages_keep_columns_and_drop_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0 < len(rows) <= n
        docs, n = spark.createDataFrame(rows, docs.schema), len(rows)
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf).toPandas()
    assert len(last) == n and last.round_trip.all()


def _pfair(rows, block=64 << 10, period=1000):
    """Ids in the order of the mix, slot by slot."""
    total, n = {}, {}
    for r in rows:
        s = r.source or ""
        total[s] = total.get(s, 0) + len((r.text or "").encode())
    m = len(total)
    d, weight = max(period, 4 * m), {s: math.sqrt(b) for s, b in sorted(total.items())}
    exact = {s: (d - m) * w / sum(weight.values()) for s, w in weight.items()}
    left = d - m - sum(int(e) for e in exact.values())
    for i, s in enumerate(sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s))):
        n[s] = 1 + int(exact[s]) + (i < left)
    done, at = dict.fromkeys(sorted(total), 0), {}
    for t in range(d):
        s = min((-(-(done[s] + 1) * d // n[s]), s) for s in done if done[s] * d // n[s] <= t)[1]
        at[s, done[s]], done[s] = t, done[s] + 1
    run, order = {}, []
    for mark, r in sorted((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r) for r in rows):
        s = r.source or ""
        b = run.get(s, 0) // block
        run[s] = run.get(s, 0) + len((r.text or "").encode())
        order.append((b // n[s] * d + at[s, b % n[s]], mark, r.doc_id))
    return [i for _, _, i in sorted(order)]


def test_the_mix_reaches_the_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test")
    got = corpus_pipeline.run(spark, sf).select("doc_id", "position").collect()
    got.sort(key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(got)))
    assert [r.doc_id for r in got] == _pfair(docs.collect())


def test_rows_are_judged_by_themselves(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.rules(spark, corpus_pipeline.classify(spark, docs, sf), sf)
    good = [r.text for r in corpus_pipeline.dedup(spark, clean, sf).orderBy("doc_id").limit(6).collect()]
    ids = [None, None, 7, 7, 7, 8]
    rows = [(i, t, "en", "a", len(t)) for i, t in zip(ids, good)] + [(i, "bad bad", "en", "a", 7) for i in (None, 7)]
    rows += [(None, good[0], "en", "a", len(good[0])), (9, good[5], "en", "a", len(good[5]))]  # copies
    some = spark.createDataFrame(rows, docs.schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        some = corpus_pipeline.stored(stage(spark, some, sf), "test")
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in some.collect()), key=key) == sorted(zip(ids, good), key=key)
    empty = spark.createDataFrame([(1, None), (1, None), (None, " "), (None, " "), (None, "")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, corpus_pipeline.dedup(spark, empty, sf).collect()))) == ["(1, None)", "(None, ' ')", "(None, '')"]


def test_no_rows_and_odd_rows_go_through_all_stages(spark, sf, tmp_path):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").where("length(text) > 500").limit(8).collect()
    rows = [(None if i < 3 else 7, *r[1:], "m", i) for i, r in enumerate(good)] + [(None, None, None, None, None, "m", 99), (7, "", "en", None, 0, "m", 98)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, _metadata string, row int"
    (tmp_path / "odd").mkdir()
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/odd/documents.parquet")
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert 0 < len(got) <= 8 and all(r.round_trip for r in got) and {r.doc_id for r in got} <= {None, 7}
    assert sorted(r.position for r in got) == list(range(len(got)))
