import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.llm import mixing, quality_classifier, quality_rules, queries, sentencepiece_lattice, sharding, url_filter, warc
from tierflow.llm._common import shingles
from tierflow.llm._features import repeats
from tierflow.llm.embedding_dedup import near_vectors
from tierflow.llm.minhash_dedup import _shared, keep_one, near_documents
from tierflow.llm.quality_classifier import FactorisationMachine, keep_quality, score_quality
from tierflow.llm.quality_rules import judge_quality, keep_judged
from tierflow.llm.sentencepiece_lattice import encode_documents, fold_viterbi, lattice, merge_long, pieces
from tierflow.llm.token_files import CachedEncoder, token_digest

#: Names of columns that the operators use themselves.
HELPERS = (
    "_metadata", "_shard", "_cell", "_row", "_at", "_of", "_id", "_file", "_base", "_hash", "_shard_0", "_place", "_position", "_key", "_t", "_h", "_q", "_g", "_v",
    "component", "shard", "refers_to", "own", "place", "chunk", "unit", "ids", "row", "rid", "text_", "n", "sha", "payload", "position", "slot", "block", "word", "start", "score",
)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, id string"
MODEL, TOKENS = queries.tokenizer("piece_bpe_32k.model"), queries.tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two", "en", None, 7), (5, "ONE two", "en", "b", 7), (6, "one two", "en", "b", 7), (7, long, "en", "a", len(long)), (8, "x" * 3000, "en", "a", 3000), (9, "é 日本 \x1c <|endoftext|> it's", "fr", "c", 20), (6, "one two", "en", "b", 7)]
    return spark.createDataFrame([(*r, "n", "i") for r in rows], DOCS)


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    x = np.vstack([base[i % 12] + rng.normal(size=16) * s for i, s in enumerate(np.repeat([0.02, 0.15, 0.4], 200))])
    label = [i % 3 for i in range(600)]
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(600)] + [(600, [float(v) for v in x[0]], 0), (601, None, 0), (602, [0.0] * 16, 0), (603, [float("nan")] * 16, 0), (604, [1.0, None], 0), (605, [float(v) for v in x[0]], None)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), k=6).toPandas().set_index("vec_id").sort_index()
    v = np.vstack([x, x[:1]]).astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array(label + [0])
    link = (v @ v.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    want = components(range(606), zip(*np.nonzero(link)))
    assert list(got.n_links[:601]) == link.sum(1).tolist() and list(got.n_links[601:]) == [0] * 5
    assert got.component_id.to_dict() == want
    assert (got.kept == (got.component_id == got.index)).all()


def test_documents_match_brute_force(spark, sf, odd):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = docs.select("doc_id", "text").collect()
        sets = {r.doc_id: set(shingles(r.text).tolist()) for r in rows}
        links, seen = [], defaultdict(list)
        for i, s in sets.items():
            for j in {j for h in s for j in seen[h]}:
                if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                    links.append((i, j))
            for h in s:
                seen[h].append(i)
        got = near_documents(docs).toPandas()
        assert len(got) == len(rows)
        got = got.drop_duplicates().set_index("doc_id")
        assert got.component_id.to_dict() == components(sets, links)
        assert got.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
        assert (got.kept == (got.component_id == got.index)).all()
    assert near_documents(odd.where("false")).count() == 0


def test_a_chain_of_near_copies_stays_one_group(spark):
    words = [f"t{i}" for i in range(400)]
    docs = [(i, " ".join(words[: 200 + i])) for i in range(150)]
    got = near_documents(spark.createDataFrame(docs, "doc_id long, text string"), node_size=16, block=32).toPandas()
    assert set(got.component_id) == {0}


def test_intersections_of_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(300, rng.integers(1, 120))).astype(np.uint64) for _ in range(60)] + [np.arange(5, dtype=np.uint64) + 1000]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    got = _shared(sets)
    np.fill_diagonal(got, [len(x) for x in sets])
    assert got.tolist() == want


def test_shards_fit_and_only_large_buckets_split(spark, odd):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', int(id % 97))").alias("text"))
    got = sharding.assign_shards(docs, limit=4096).toPandas()
    assert len(got) == 3000 and (got.shard_bytes <= 4096).all()
    per = got.groupby("shard").n_bytes.sum()
    for s in per.index:
        parent = got[got.shard.str.startswith(s[:-1])].n_bytes.sum()
        assert s == "" or parent > 4096
    hot = spark.range(500).select(F.lit(7).alias("doc_id"), F.lit("y" * 100).alias("text"))
    got = sharding.assign_shards(hot, limit=4096).toPandas()
    assert len(got) == 500 and got.groupby("shard").n_bytes.sum().max() <= 4096
    assert sharding.assign_shards(odd).count() == 10


def test_mix_deviates_less_than_a_block(spark, odd):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'hot' else concat('s', id % 7) end").alias("source"), F.lit("z" * 100).alias("text"))
    got = mixing.mix_sources(docs, block_bytes=1000, weights={"hot": 5, "s1": 1, "s2": 2}).toPandas().sort_values("position")
    assert sorted(got.position) == list(range(4000)) and got.slot.is_monotonic_increasing
    assert ((got.slot >= got.release) & (got.slot < got.deadline)).all()
    odd_ = mixing.mix_sources(odd).toPandas()
    assert sorted(odd_.position) == list(range(9))


def test_encoder_and_files_round_trip(spark, sf, odd):
    from tokenizers import Tokenizer

    tok, fast = Tokenizer.from_file(TOKENS), CachedEncoder(TOKENS, most=2000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()] + [r.text or "" for r in odd.collect()]
    assert all(tok.encode(t, add_special_tokens=False).ids == fast.ids(t).tolist() for t in texts)
    got = token_digest(docs, TOKENS, per_file=16).toPandas().sort_values("doc_id")
    start = 0
    for r, t in zip(got.itertuples(), docs.orderBy("doc_id").collect()):
        ids = np.array(tok.encode(t.text, add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (t.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_digest(odd, TOKENS).count() == 10 and token_digest(odd.where("false"), TOKENS).count() == 0


def test_archives_round_trip(spark):
    rows = [(1, "http://a/", "q" * 5000), (2, None, "q" * 5000), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 40_000), (6, "u", "short"), (7, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_digest(pages, segment=4096).toPandas().set_index("page_id")
    import hashlib

    for i, _, html in rows:
        data = (html or "").encode()
        assert got.payload_bytes[i] == len(data) and got.payload_digest[i] == hashlib.sha1(data).hexdigest()
    assert got.record_type.to_dict() == {i: "revisit" if i == 1 else "response" for i in range(1, 8)} and got.refers_to[1] == 2
    assert warc.unchunked(warc.chunked(b"a" * 20_001)) == b"a" * 20_001
    assert warc.archive_digest(pages.where("false")).count() == 0


def test_lattice_equals_the_library(spark, sf, odd):
    import sentencepiece

    sp, p = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces(MODEL)
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        want = {r.doc_id: sp.encode(r.text or "") for r in docs.collect()}
        got = encode_documents(docs, MODEL, per_chunk=64).toPandas()
        assert all(list(r.ids) == want[r.doc_id] for r in got.itertuples()) and got.round_trip.all()
    rank = {a: (r, i) for a, i, r in p.rows}
    for word in (" " + "abcde" * 30, " " + "x" * 999):
        assert merge_long(word, rank, p.byte0) == sp.encode(word[1:])
    table = spark.createDataFrame([("a", 0, 0, False), ("b", 1, 1, False), ("ab", 2, 2, False), ("ba", 3, 3, False)], "piece string, id int, rank int, late boolean")
    edges = lattice(spark.createDataFrame([("abab",), ("bab",)], "unit string").repartition(2, "unit"), table)
    ids = {r.unit: r.ids for r in fold_viterbi(edges, {0: -2.0, 1: -3.0, 2: -1.0, 3: -4.0}).collect()}
    assert ids == {"abab": [2, 2], "bab": [1, 2]}


def test_memory_of_a_task_that_encodes(spark, tmp_path, monkeypatch):
    """words are looked up and texts encoded in small steps, beside the words of a chunk that a task keeps."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    known = [f" w{i}" for i in range(300_000)]
    texts = ["".join(known[i] for i in rng.integers(len(known), size=400))[1:] for _ in range(1500)]
    (tmp_path / "chunk=0").mkdir()
    p = pieces(MODEL)
    unit = p.units(texts)[0].unique()
    unit = pa.concat_arrays([unit, pa.array([f" v{i}" for i in range(300_000)])])
    pq.write_table(pa.table({"unit": unit, "ids": pa.array([[i % 5, 7] for i in range(len(unit))], pa.list_(pa.int32()))}), tmp_path / "chunk=0" / "a.parquet")
    at = {u: i for i, u in enumerate(unit.to_pylist())}
    monkeypatch.setattr(sentencepiece_lattice, "write_dictionaries", lambda src, path: str(tmp_path))
    docs, seen = spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, place long"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, kind: seen.append(f) or df.selectExpr("id", "place", "1L n_tokens", "array(1) ids", "true round_trip"))
    encode_documents(docs, MODEL, place="place")
    texts[700] = texts[701] = None
    n = len(texts)
    batch = pa.record_batch([pa.array(range(n)), pa.array(range(n)), pa.array([0] * n, pa.int64()), pa.array(texts, pa.string())], names=["id", "place", "chunk", "text"])
    # beside the words that the task keeps
    held, pool, before = sentencepiece_lattice.Dictionary.of(f"{tmp_path}/chunk=0"), pa.proxy_memory_pool(pa.system_memory_pool()), pa.default_memory_pool()
    lengths, ids = [], []
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        for out in seen[0](iter([batch])):
            lengths += out.column("n_tokens").to_pylist()
            if len(lengths) < 300:
                ids += out.column("ids").to_pylist()
            del out
        most = pool.max_memory() + tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)
        sentencepiece_lattice.Dictionary._held = None
    assert held.unit.equals(unit)
    words = [p.units([t])[0].to_pylist() for t in texts]
    assert lengths == [2 * len(w) for w in words]
    assert ids == [[x for u in w for x in (at[u] % 5, 7)] for w in words[: len(ids)]]
    assert most < 110e6, most


def test_rules_on_small_texts():
    assert repeats("a b c a b c".encode().split()) == 6 and repeats("a b c d".encode().split()) == 0 and repeats([b"a"] * 5) == 5


@pytest.mark.parametrize("judge", [judge_quality, score_quality])
def test_models_take_odd_rows_and_no_labels(spark, odd, judge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert judge(odd, none).count() == 10 and judge(odd.where("false"), none).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    s = score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (s.predicted == s.quality).mean() >= 0.97
    k = judge_quality(docs, labels).join(labels, "doc_id").toPandas()
    passed = k[~k.base_failed]
    assert passed[passed.quality == 1].kept.mean() >= 0.99 and passed[passed.quality == 0].kept.mean() <= 0.1


def test_pairs_by_sum_of_squares():
    m, x = FactorisationMachine(6, 3), np.random.default_rng(0).normal(size=(2, 6)).astype(np.float32)
    pairs = sum((m.v[i] @ m.v[j]) * x[:, i] * x[:, j] for i in range(6) for j in range(i + 1, 6))
    assert np.allclose(m.raw(x), pairs, atol=1e-5)


def test_globs_match_regular_expressions():
    import re

    globs = [("*.org", "/a*b"), ("x?y.com", "/*"), ("*", "*z"), ("q" * 70 + "*", "/")]
    texts = ["a.org/ab", "a.org/axxb", "a/b.org/ab", "x1y.com/", "x/y.com/", "zzz", "q" * 70 + "r/", "", ".org/ab"]
    hit = url_filter.ShiftAnd(globs).match([t.encode() for t in texts])
    part = lambda g, c: "".join({"*": f"{c}*", "?": c}.get(x, re.escape(x)) for x in g)
    for i, t in enumerate(texts):
        for j, (h, p) in enumerate(globs):
            assert hit[i, j] == bool(re.fullmatch(part(h, "[^/]") + part(p, "."), t, re.S)), (t, h, p)


def test_long_texts_step_alone():
    rng = np.random.default_rng(6)
    automaton = url_filter.ShiftAnd([("*a?b", "/x*y*"), ("q" * 70 + "*", "/*z"), ("*", "*ab")])
    texts = [bytes(rng.choice(list(b"abxyz/q"), int(n)).tolist()) for n in rng.integers(0, 60, 200)] + [b"aab/x" + bytes(rng.choice(list(b"xyz"), 3000).tolist()) + b"y", b"q" * 75 + b"/" + b"w" * 5000 + b"z", b"k" * 9000 + b"ab"]
    mixed = automaton.match(texts)
    automaton.few = 0
    assert (mixed == automaton.match(texts)).all() and mixed[-3:].any(axis=1).all()


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("block", "b.com", "/x*", True), ("allow", "b.com", "/", False)], "verdict string, host string, path string, subdomains boolean")
    df = spark.createDataFrame([(1, "http://a.b.com/xy"), (2, "http://b.com/"), (3, "http://a.b.com/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, rules=url_filter.rules_of(table), otherwise=[], default="none").collect()}
    assert got == {1: ("b.com/x", "block"), 2: ("b.com/", "allow"), 3: (None, "none")}
    with pytest.raises(ValueError):
        url_filter.rules_of(table, most=1)


def test_urls_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "no host"), (3, "http://WWW.Example.org/es/x?y"), (4, "a://h.com#f"), (5, "http://b.com/de/")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.org", "/es/x", "example.org/es/", "block"), 4: ("h.com", "", None, "allow"), 5: ("b.com", "/de/", "com/de/", "block")}


def _pairs(rng, n, size, label, cosine):
    """n lone vectors of one label, and size pairs at one cosine."""
    x = rng.normal(size=(n + 2 * size, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(n, n + size):
        y = x[i + size] - (x[i + size] @ x[i]) * x[i]
        x[i + size] = cosine * x[i] + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)
    return [(v.tolist(), label) for v in x]


def test_sparse_links_are_found_beside_a_hot_group(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    rows = [((centre + 0.01 * rng.normal(size=32)).tolist(), 0) for _ in range(600)]
    rows += _pairs(rng, 3000, 0, 0, 0.0) + _pairs(rng, 200, 150, 1, 0.94)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = near_vectors(df, tables=1, rounds=1, cell=8, tries=1).toPandas().set_index("vec_id").sort_index()
    x = np.array([r[0] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[1] for r in rows])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    assert got.n_links.tolist() == link.sum(1).tolist()
    assert got.component_id.to_dict() == components(range(len(rows)), zip(*np.nonzero(link)))


def test_null_and_repeated_ids_have_tokens(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENS)
    rows = [(None, "no id"), (None, None), (-3, "minus three"), (5, "five of one"), (5, "five of two"), (None, "no id either")]
    got = token_digest(spark.createDataFrame(rows, "doc_id long, text string"), TOKENS, per_file=2).collect()
    encode = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=key) == sorted(((i, zlib.crc32(encode(t))) for i, t in rows), key=key)
    by_place = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_place] == [None, None, None, -3, 5, 5]
    assert [r.start for r in by_place] == np.cumsum([0, *[r.n_tokens for r in by_place]])[:-1].tolist()


def test_null_and_repeated_ids_have_archives(spark):
    import hashlib

    rows = [(None, "u", "q" * 5000), (None, "u", "q" * 5000), (None, None, None), (1, "u", "q" * 5000), (2, "u", "q" * 5000), (1, "u", "r" * 9000), (4, "u", "s" * 9000), (4, "u", "s" * 9000)]
    got = warc.archive_digest(spark.createDataFrame(rows, "page_id long, url string, html string"), segment=1024).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, len(t or ""), sha(t), "response", None) for i, _, t in rows]
    want[3] = (1, 5000, sha("q" * 5000), "revisit", 2)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_archives_of_other_writers_are_read(spark, tmp_path):
    import base64
    import hashlib

    one, two, three = b"<p>one</p>", b"<p>two</p>" * 90, b"plain"
    b32 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    parts = [http + two[:300], two[300:]]
    data = [
        ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:a>")], b"software: x\r\n"),
        ([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:b>"), ("WARC-Payload-Digest", b32(b""))], b"GET / HTTP/1.1\r\n\r\n"),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:c>"), ("WARC-Payload-Digest", b32(one))], http + one),
        ([("WARC-Type", "continuation"), ("WARC-Record-ID", "<urn:e>"), ("WARC-Segment-Origin-ID", "<urn:d>"), ("WARC-Segment-Number", "2"), ("WARC-Segment-Total-Length", str(sum(map(len, parts))))], parts[1]),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:d>"), ("WARC-Segment-Number", "1"), ("WARC-Payload-Digest", b32(two))], parts[0]),
        ([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:f>")], three),
        ([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:g>"), ("WARC-Payload-Digest", b32(one))], http),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(warc._record(h, b) for h, b in data))
    got = warc.read_archives(spark, f"file://{tmp_path}", spark.createDataFrame([("x.warc.gz",)], "file string")).collect()
    want = [("response", one), ("response", two), ("resource", three), ("revisit", None)]
    assert sorted((r.kind, bytes(r.payload or b"")) for r in got) == sorted((k, p or b"") for k, p in want)
    assert {r.digest for r in got} == {hashlib.sha1(p).hexdigest() for p in (one, two, three)} and all(r.page_id is None for r in got)


def test_written_shards_stay_within_the_limit(spark, tmp_path):
    sizes = [900, *[3000] * 7, *[1] * 40, *[1500, 2047, 2049] * 20, 9000]
    rows = [(7, "y" * n) for n in sizes] + [(None, "n" * 3000)] * 5 + [(i, "z" * 500) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.sharded(docs, limit=4096).toPandas()
    assert sorted(zip(got.doc_id.fillna(-1), got.n_bytes)) == sorted((-1 if i is None else i, len(t)) for i, t in rows)
    per = got.groupby("shard").n_bytes.agg(["sum", "count"])
    assert ((per["sum"] <= 4096) | (per["count"] == 1)).all()
    assert (got.shard_bytes == got.shard.map(per["sum"])).all() and (got.shard_rows == got.shard.map(per["count"])).all()
    sharding.write_shards(docs, str(tmp_path / "shards"), limit=4096)
    written = sharding.read_shards(spark, str(tmp_path / "shards"), docs.schema)
    files = written.groupBy("_shard").agg(F.sum(F.length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert {r._shard: (r.b, r.n) for r in files} == {s: (r["sum"], r["count"]) for s, r in per.iterrows()}
    assert sharding.sharded(docs.where("false")).count() == 0


def test_pairs_in_large_nodes_are_found(spark):
    """Documents around one long passage, 0.735 alike, with pairs among them of 0.76."""
    rng = np.random.default_rng(5)
    passage, rows = " ".join(f"p{i}" for i in range(404)), []
    for i in range(200):
        own = [f"d{i}_{j}" for j in range(72)]
        rows.append(" ".join([passage, *own]))
        if i < 60:
            rows.append(" ".join([passage, *own[:8], *[f"e{i}_{j}" for j in range(64)]]))
    order = rng.permutation(len(rows))
    docs = [(n, rows[i]) for n, i in enumerate(order)]
    sets = {n: set(shingles(t).tolist()) for n, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) == 60
    got = near_documents(spark.createDataFrame(docs, "doc_id long, text string"), node_size=4, block=16, likely=1.0).toPandas().set_index("doc_id")
    assert got.component_id.to_dict() == components(sets, links)


def test_rules_match_brute_force(spark, sf, odd):
    import re

    for docs, labels in ((spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")), (odd, spark.createDataFrame([], "doc_id long, quality int"))):
        want = []
        for r in docs.collect():
            text = r.text or ""
            w, lines = re.findall("[^\x20\x09-\x0D]+", text), text.split("\n")
            windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            count = {x: windows.count(x) for x in set(windows)} if len(w) < 3000 else {x: 2 for x in ()}
            if len(w) >= 3000:
                for x in windows:
                    count[x] = count.get(x, 0) + 1
            hit = {j for i, x in enumerate(windows) if count[x] > 1 for j in (i, i + 1, i + 2)}
            dup = sum(bool(re.search("[^\x20\x09-\x0D]", x)) and x in set(lines[:i]) for i, x in enumerate(lines)) if len(lines) < 3000 else 0
            want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
        got = [tuple(r) for r in judge_quality(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
        assert sorted(got) == sorted(want)
        assert judge_quality(docs, labels).where("base_failed and kept").count() == 0


def test_isolation_depths_match_a_walk():
    from tierflow.llm.quality_rules import IsolationForest

    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 5)), np.full((1, 5), 9.0), np.zeros((2, 5))])
    f = IsolationForest(x[:300], trees=20, sample=64)
    for row, score in zip(x[::10], f.score(x[::10])):
        total = 0.0
        for t in range(20):
            node = 1
            while node < 1 << f.depth and np.isfinite(f.split[t, node]):
                node = 2 * node + (row[f.column[t, node]] >= f.split[t, node])
            total += f.length[t, node]
        assert abs(score - 2 ** -(total / 20 / f.norm)) < 1e-9
    assert f.score(x[300:301])[0] > np.quantile(f.score(x[:300]), 0.99)


def test_scores_match_explicit_pairs(spark, sf):
    from tierflow.llm import quality_classifier as q

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m, centre = q.fit(docs, labels)
    for text in ("", "one two two three", "Some SHOUTED words!! and 12 numbers\nand lines"):
        i, v, s = q._row(text)
        at, x = np.r_[i, np.arange(q.WORDS, len(m.w))], np.r_[v, q._structure(np.array(s), centre)]
        raw = m.w0 + sum(m.w[a] * b for a, b in zip(at, x)) + sum((m.v[at[j]] @ m.v[at[k]]) * x[j] * x[k] for j in range(len(at)) for k in range(j))
        assert abs(q._score((m, centre), text) - 1 / (1 + np.exp(-raw))) < 1e-4
    got = score_quality(docs.withColumn("score", F.lit(1)).withColumn("held_out", F.lit("x")), labels).collect()
    want = {r.doc_id: r.h for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("h")).collect()}
    assert all(r.held_out == want[r.doc_id] and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got) and len(got) == len(want)


def test_urls_long_repeated_and_none(spark):
    long = "http://a.org/" + "x" * 20_000
    rows = [(1, long, "r"), (1, long, "r"), (2, "http://big-casino.net/", "r"), (3, "http://example.org/en/1", "r"), (4, "http://example.org/es/en/1", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string").withColumn("host", F.lit(0))
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in url_filter.judge_urls(df).collect())
    assert got == [(1, "org/", "allow"), (1, "org/", "allow"), (2, "", "block"), (3, "example.org/en/1", "block"), (4, "example.org/es/", "block")]
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_clashing_columns_and_lengths(spark, odd):
    extra = odd.select("*", *[F.lit(1).alias(c) for c in HELPERS])
    assert near_documents(extra).count() == 10 and sharding.sharded(extra).count() == 10 and mixing.mixed(extra).columns == extra.columns
    assert encode_documents(extra, MODEL).count() == 10 and token_digest(extra, TOKENS).count() == 10
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert judge_quality(extra, none).count() == 10 and score_quality(extra, none).count() == 10 and mixing.mix_sources(extra).count() == 9
    assert keep_one(extra).columns == extra.columns and keep_judged(extra, none).columns == extra.columns and keep_quality(extra, none).columns == extra.columns
    pages = extra.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *[c for c in extra.columns if c not in ("doc_id", "source", "text")])
    assert warc.archive_digest(pages).count() == 10 and url_filter.judge_urls(pages).count() == 10
    two = [(1, [1.0, 0.0], 64691), (2, [1.0, 0.0], 100720), (3, [1.0, 0.0, 0.0], 64691), (4, [1.0, 0.01], 64691), (4, [1.0, 0.01], 64691)]
    got = near_vectors(spark.createDataFrame(two, "vec_id long, embedding array<double>, label long").withColumn("part", F.lit(1)))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 2, 1), (4, 2, 1)]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label long")
    assert near_vectors(none).count() == 0 and sharding.sharded(odd.where("false")).count() == 0 and mixing.mix_sources(odd.where("false")).count() == 0


def test_vectors_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (None, [1.0, 0.02]), (None, None), (None, [-1.0, 0.1]), (None, [-1.0, 0.11]), (7, [-1.0, -1.0]), (7, [-1.0, -1.0])]
    rows += [(None if i % 5 == 0 else int(rng.integers(10, 60)), rng.normal(size=2).tolist()) for i in range(150)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = near_vectors(df.select("*", F.lit(1).alias("rid"), F.lit(1).alias("_metadata"), F.lit(1).alias("least"))).collect()
    x = np.array([v or [0.0, 0.0] for _, v in rows])
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    of = components(range(len(rows)), zip(*np.nonzero(link)))
    ids = {c: min((rows[i][0] for i in of if of[i] == c and rows[i][0] is not None), default=None) for c in set(of.values())}
    want = [(rows[i][0], int(link[i].sum()), ids[of[i]], ids[of[i]] == rows[i][0]) for i in range(len(rows))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_documents_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(12)
    base = [[f"b{k}_{j}" for j in range(40)] for k in range(12)]
    rows = [(1, " ".join(base[0])), (1, " ".join(base[1])), (3, " ".join([*base[1], "one"])), (None, " ".join([*base[2], "two"])), (None, " ".join(base[2])), (None, "alone " * 9), (None, None), (4, ""), (4, " ".join(base[0])), (5, "a b")]
    for _ in range(60):
        w = list(base[rng.integers(12)])
        w[int(rng.integers(2, 38))] = "x"
        rows.append((None if rng.integers(4) == 0 else int(rng.integers(1, 30)), " ".join(w[: int(rng.integers(30, 41))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(shingles(t).tolist()) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    of = components(range(len(rows)), links)
    ids = {c: min((rows[i][0] for i in of if of[i] == c and rows[i][0] is not None), default=None) for c in set(of.values())}
    want = [(rows[i][0], len(sets[i]), ids[of[i]], ids[of[i]] == rows[i][0]) for i in range(len(rows))]
    got = near_documents(docs.select("*", F.lit(1).alias("n"), F.lit(1).alias("_metadata"), F.lit(1).alias("component_id"))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = [tuple(r) for r in keep_one(docs).collect()]
    assert all(sum(rows[i] in kept for i in of if of[i] == c) >= 1 for c in set(of.values())) and len(kept) == len(set(of.values()))


def test_labelled_rows_are_bounded(spark, sf, monkeypatch):
    """One labelled id may have any number of rows."""
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.range(900).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit(text), "id").alias("text")))
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id <> 1").select("doc_id", "quality").unionByName(spark.sql("select 1L doc_id, 1 quality"))
    seen = []
    fit, forest = FactorisationMachine.fit, quality_rules.IsolationForest
    monkeypatch.setattr(FactorisationMachine, "fit", lambda m, dense, y: seen.append(len(y)) or fit(m, dense, y))
    monkeypatch.setattr(quality_rules, "IsolationForest", lambda x, *a: seen.append(2 * len(x)) or forest(x, *a))
    quality_classifier.fit(docs, labels, sample=60)
    quality_rules.fit(docs, labels, sample=60)
    assert len(seen) == 2 and all(0 < n <= 61 for n in seen)


def test_mix_of_repeated_ids(spark, odd):
    rows = [(7, "h" * 50, f"{i}", "hot") for i in range(400)] + [(None, "n", f"n{i}", None) for i in range(30)] + [(i, "x" * 40, "", "s1") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string, source string").repartition(6)
    place = {r.doc_id: r.position for r in mixing.mix_sources(docs, block_bytes=1000).collect()}
    got = mixing.mixed(docs, block_bytes=1000).withColumn("part", F.spark_partition_id()).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.tag, r.source) for r in got))) == sorted(map(str, rows))
    assert [place[r.doc_id] for r in got] == sorted(place[r.doc_id] for r in got)
    assert len({r.part for r in got if r.doc_id == 7}) > 1


def test_threshold_costs_least():
    rng = np.random.default_rng(2)
    for care in (1.0, 10.0):
        for _ in range(20):
            good = rng.random(60) < 0.7
            scores = np.round(np.where(good, rng.normal(0, 1, 60), rng.normal(1.5, 1, 60)), 1)
            cost = lambda t: care * (scores[good] > t).mean() + (scores[~good] <= t).mean()
            assert cost(quality_rules._threshold(scores, good, care)) <= min(cost(t) for t in np.linspace(-5, 6, 2000)) + 1e-9


def test_thresholds_count_all_labelled_rows(spark, sf, monkeypatch):
    """The threshold came from the same few rows as the forest."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen, threshold = [], quality_rules._threshold
    monkeypatch.setattr(quality_rules, "_threshold", lambda cells, good, bad, care: seen.append((good.sum(), bad.sum())) or threshold(cells, good, bad, care))
    quality_rules.fit(docs, labels, sample=20)
    known = judge_quality(docs, labels).where("not base_failed").join(labels.where("quality is not null"), "doc_id")
    assert seen[0] == (known.where("quality = 1").count() - 10, known.where("quality = 0").count())


def test_threshold_by_counts():
    cells = np.array([10, 20, 21, 40])
    at = lambda good, bad: quality_rules._threshold(cells, np.array(good), np.array(bad), 10.0) * 65536
    assert abs(at([5, 5, 0, 0], [0, 0, 3, 9]) - 21) < 1e-6 and abs(at([5, 5, 1, 0], [0, 0, 0, 9]) - 31) < 1e-6
    assert abs(at([5, 5, 5, 5], [1, 0, 0, 0]) - 41) < 1e-6 and abs(at([1, 1, 1, 1], [0, 0, 0, 0]) - 44) < 1e-6
