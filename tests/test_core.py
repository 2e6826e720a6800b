import gzip
import os
import struct
import subprocess
import sys
import tempfile

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierflow.functions import names, tags, text
from tierflow.functions.checksums import crc32c
from tierflow.operators import catalog, index_gzip, metrics, multipart, placement, policy
from tierflow.plans import fixtures as fx, queries as core
from tierflow.plans.pipeline import Pipeline, chunk_step, register
from tierflow.sources import readers
from tierflow.streaming import state


def rows(df):
    return [tuple(r) for r in df.collect()]


def cells(df: pd.DataFrame):
    def one(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return repr([one(x) for x in v])
        return "" if v is None or v is pd.NaT or v is pd.NA or v != v else "%.9g" % v if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    assert cells(core.QUERIES[name](spark, sf).toPandas()) == cells(duck.execute(core.ORACLES[name]).fetchdf())


def test_names(spark):
    keys = ["topic1-NocMJpqTTtyKaFJDURStjg/0/00000000000000000000-zsj9DCIER9OaE0B3ZwcMpQ.log", "d536f64d-4a32-43e5-944e-b32e05e3c790-ledger-16", "scope/stream/test.txt", "/a/b/0.#epoch.0", "x", None]
    df = names.with_scope(names.with_system(spark.createDataFrame([(k,) for k in keys], "key string")))
    assert rows(df.select("system", "scope", "stream")) == [("KAFKA", "topic1", "0"), ("PULSAR", "pulsar", "pulsar"), ("DEFAULT", "scope", "stream"), ("PRAVEGA", "a", "b"), (None, None, None), (None, None, None)]


def test_policy_flags(spark):
    steps = [(0, "S1", "ALL", "NONE", False, False, False, "EDGE", []), (1, "S2", "ALL", "GPU", True, True, False, "EDGE", []), (2, "S3", "ALL", "NONE", False, False, False, "CLOUD", [])]
    p = policy.policies(spark, [("1", "KAFKA", "a", "b", steps, [])])
    assert policy.steps(p, "EDGE").count() == 2
    flags = lambda r, h: policy.policy_flags(p, r, h, "PUT").first()
    assert flags("EDGE", "NONE").next_region == "CLOUD" and flags("CLOUD", "NONE").next_region is None
    assert not flags("EDGE", "NONE").can_execute and flags("EDGE", "GPU").can_execute and flags("CLOUD", "GPU").can_execute
    assert flags("EDGE", "GPU").special_hardware == "GPU"


def test_ring(spark):
    assert len(placement.ring_points(["a", "b"], 10)) == 20 and len(placement.ring_points(["a"], 10)) == 10
    got = spark.range(200).select(F.concat(F.lit("k"), "id").alias("k")).select(placement.ring_owner(F.col("k"), fx.NODES).alias("o")).groupBy("o").count().collect()
    assert sum(r["count"] for r in got) == 200


def test_readers(spark):
    chunk = lambda b: spark.createDataFrame([("c", bytearray(b))], "key string, content binary")
    frames = struct.pack("<iq", 3, 7) + b"abc" + struct.pack("<iq", 0, 8) + struct.pack("<iq", 9, 9) + b"cut"
    assert [(r[2], bytes(r[3])) for r in rows(readers.read_frames(chunk(frames)))] == [(7, b"abc"), (8, b"")]
    assert [bytes(r[2]) for r in rows(readers.split_markers(chunk(b"x\xff\xd8a\xff\xd9y\xff\xd8b")))] == [b"\xff\xd8a\xff\xd9"]
    js = b"12345678" + b'{"id":1,"s":"}{\\""}' + b"abc\xff" + b'{"id":broken' + b'{"id":2}' + b'zzz{"id":'
    assert [r[2] for r in rows(readers.read_prefixed_json(chunk(js)))] == ['{"id":1,"s":"}{\\""}', '{"id":2}']
    fq = b"junk\n@r1\nACGT\n+\n@@@@\n@r2\nAC\n+x\nII\n@r3\n"
    assert [r[2:] for r in rows(readers.read_fastq(chunk(fq)))] == [("r1", "ACGT", "", "@@@@"), ("r2", "AC", "x", "II")]
    lines = spark.createDataFrame([("c", "a  \nb\ntail")], "key string, content string")
    assert [r[2] for r in rows(readers.read_lines(lines))] == ["a", "b"]
    assert [bytes(r[2]) for r in rows(readers.read_blocks(chunk(b"abcdefg"), 3))] == [b"abc", b"def"]


def _zigzag(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _snappy(b):
    return pa.compress(b, codec="snappy", asbytes=True)


def _packed(codec):
    def run(b):
        out = pa.BufferOutputStream()
        with pa.CompressedOutputStream(out, codec) as f:
            f.write(b)
        return out.getvalue().to_pybytes()

    return run


def _batch(body, base, count, attributes=0, producer=-1):
    rest = struct.pack(">hiqqqhii", attributes, count - 1, 1000, 1010, producer, -1, -1, count) + body
    return struct.pack(">qiibI", base, 9 + len(rest), 0, 2, crc32c(rest)) + rest


def _body(*pairs):
    out = b""
    for i, (k, v) in enumerate(pairs):
        r = b"\0" + _zigzag(0) + _zigzag(i) + _zigzag(len(k)) + k + _zigzag(len(v)) + v + _zigzag(0)
        out += _zigzag(len(r)) + r
    return out


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0 and crc32c(bytes(32)) == 0x8A9136AA
    data = bytes(range(256)) * 400
    register = 0xFFFFFFFF
    for x in data:
        register ^= x
        for _ in range(8):
            register = register >> 1 ^ (0x82F63B78 if register & 1 else 0)
    assert crc32c(data) == register ^ 0xFFFFFFFF


def test_broken_and_aborted_batches():
    one, two, three = (_batch(_body((b"k", b"v%d" % i), (b"k", b"w%d" % i)), 10 * i, 2, 16, 7 + i % 2) for i in range(3))
    read = lambda data, **how: [(r[0], r[3]) for r in readers.read_kafka_log.__wrapped__(data, **how)]
    whole = [(0, b"v0"), (1, b"w0"), (10, b"v1"), (11, b"w1"), (20, b"v2"), (21, b"w2")]
    assert read(one + two + three) == whole
    for at in range(len(one) + 17, len(one) + len(two)):  # any flipped bit of the second batch from its checksum on
        flipped = bytearray(one + two + three)
        flipped[at] ^= 1 << at % 8
        assert read(bytes(flipped)) == whole[:2]
    marker = lambda base, kind, producer: _batch(_body((struct.pack(">hh", 0, kind), b"\0" * 6)), base, 1, 48, producer)
    log = one + two + marker(15, 0, 7) + three + marker(25, 1, 8) + marker(26, 1, 7)
    assert read(log) == whole and read(log, committed_only=True) == whole[2:]
    assert [r[0] for r in read(log, control=True)] == [0, 1, 10, 11, 15, 20, 21, 25, 26]
    late = one + marker(5, 1, 7) + three + marker(25, 0, 7)
    assert read(late, committed_only=True) == whole[:2]


@pytest.mark.parametrize("codec", [0, 1, 2, 3, 4, "framed"])
def test_log_segments(spark, codec):
    body = b""
    for i, (k, v) in enumerate([(b"k", b"v0"), (None, None), (None, b"v2")]):
        r = b"\0" + _zigzag(i * 5) + _zigzag(i) + (_zigzag(-1) if k is None else _zigzag(len(k)) + k) + (_zigzag(-1) if v is None else _zigzag(len(v)) + v) + _zigzag(0)
        body += _zigzag(len(r)) + r
    body = {0: bytes, 1: gzip.compress, 2: _snappy, 3: _packed("lz4"), 4: _packed("zstd"), "framed": lambda b: b"\x82SNAPPY\0" + bytes(8) + b"".join(struct.pack(">i", len(x)) + x for x in map(_snappy, (b[:9], b[9:])))}[codec](body)
    codec = 2 if codec == "framed" else codec
    batch = _batch(body, 100, 3, codec)
    df = spark.createDataFrame([("c", bytearray(batch + batch[:30]))], "key string, content binary")
    got = [(r.offset, r.ts, r.value and bytes(r.value)) for r in readers.read_kafka_log(df).collect()]
    assert got == [(100, 1000, b"v0"), (101, 1005, None), (102, 1010, b"v2")]
    assert readers.read_kafka_log(df, values_only=True).count() == 2


def test_indexed_gzip(spark):
    recs = spark.range(0, 1050).select(F.lit("f").alias("key"), F.col("id").alias("pos"), F.concat(F.lit("@r"), "id", F.lit("\nA\n+\nI\n")).alias("value"))
    m = index_gzip.index_gzip(recs, 100).cache()
    assert all(gzip.decompress(bytes(r.member)).startswith(b"@r") and gzip.decompress(bytes(r.member)).count(b"\n") % 4 == 0 for r in m.collect())
    whole = b"".join(bytes(r.member) for r in sorted(m.collect(), key=lambda r: r.block))
    ranges = index_gzip.plan_ranges(index_gzip.offsets(m), 4)
    files = spark.createDataFrame([("f", bytearray(whole))], "key string, content binary")
    assert index_gzip.scan_indexed_gzip(files, ranges).agg(F.sum("lines")).first()[0] == 4200
    assert bytes(index_gzip.gunzip_chunks(files).first().content).count(b"@r") == 1050


def test_pipeline_and_encryption_restore_content(spark):
    df = spark.createDataFrame([("a", bytearray(b"hello" * 50)), ("b", bytearray())], "key string, content binary")
    p = Pipeline([chunk_step("gz", gzip.compress, gzip.decompress), chunk_step("flip", lambda b: b[::-1], lambda b: b[::-1])])
    assert rows(p.get(p.put(df))) == rows(df)
    key = catalog.encryption_key("secret", b"salt")
    enc = catalog.encrypt(df, key)
    assert enc.first().key == "a.s3enc" and rows(catalog.decrypt(enc, key)) == rows(df)


def test_tags_and_parts(spark):
    df = spark.range(1).select(tags.put_tags(F.create_map(F.lit("A"), F.lit("X")), F.create_map(F.lit("a"), F.lit("Y"), F.lit("tierflow-z"), F.lit("1"))).alias("t"))
    assert df.first().t == {"a": "y"}
    parts = spark.createDataFrame([("u", 2, 1, bytearray(b"b")), ("u", 1, 2, bytearray(b"a")), ("u", 2, 3, bytearray(b"c"))], "upload string, part int, seq int, content binary")
    r = multipart.assemble(parts).first()
    assert (r.parts, r.size, bytes(r.content)) == (2, 2, b"ac")
    assert spark.range(1).select(text.byte_range(F.lit(b"abc"), F.lit("bytes=1-9"), strict=True).alias("x")).first().x is None


@pytest.mark.parametrize("scope,want", [("shared", [None, "1", None]), ("partitioned", [None, None, None])])
def test_state_of_streams(spark, scope, want):
    d = tempfile.mkdtemp(prefix="spark-")
    puts = [("s", "a", "0", "A", "1", 1), ("s", "a", "1", "A", "2", 2), ("s", "b", "0", "A", "3", 3)]
    schema = "scope string, stream string, partition string, k string, v string, seq long"
    spark.createDataFrame(puts, schema).coalesce(1).write.parquet(f"{d}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).parquet(f"{d}/in")
    state.run_available(state.previous_values(stream, scope), f"{d}/out", f"{d}/check")
    assert [r.previous for r in spark.read.parquet(f"{d}/out").orderBy("seq").collect()] == want
    held = state.read_state(spark, f"{d}/check").select("stream", "k", "v").collect()
    assert sorted(map(tuple, held)) == ([("a", "A", "2"), ("b", "A", "3")] if scope == "shared" else [("a", "A", "1"), ("a", "A", "2"), ("b", "A", "3")])


def test_stream_equals_batch_and_replay(spark, sf):
    d = tempfile.mkdtemp(prefix="spark-")
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    src = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(sf)
    fails = [True]

    def process(df):
        if fails:
            fails.pop()
            raise OSError("a step fails")
        return df.select("doc_id", text.words(F.col("text")).alias("words"))

    with pytest.raises(Exception):
        state.run_stream(src(), process, f"{d}/out", f"{d}/check")
    assert not os.path.exists(f"{d}/out")
    state.run_stream(src(), process, f"{d}/out", f"{d}/check")
    batch = process(spark.read.parquet(f"{sf}/documents.parquet"))
    assert rows(spark.read.parquet(f"{d}/out").select("doc_id", "words").orderBy("doc_id")) == rows(batch.orderBy("doc_id"))


def test_records_are_counted_in_every_mode(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    lines = [f"@r{i}\nACGT\n+\nFFFF\n" for i in range(1000)]
    parts = [gzip.compress("".join(lines[i : i + 300]).encode()) for i in range(0, 1000, 300)]
    for folder, name, data in (("plain", "a.txt", "".join(lines).encode()), ("gzip", "a.txt.gz", b"".join(parts)), ("indexed", "a.gz", b"".join(parts))):
        os.makedirs(f"{d}/{folder}")
        with open(f"{d}/{folder}/{name}", "wb") as f:
            f.write(data)
    starts = [sum(map(len, parts[:i])) for i in range(4)]
    index = spark.createDataFrame([(f"{d}/indexed/a.gz", ",".join(map(str, starts)))], "key string, index string")
    for mode in ("plain", "gzip"):
        assert [r.records for r in index_gzip.count_records(spark, f"{d}/{mode}", mode).collect()] == [1000]
    got = index_gzip.count_records(spark, f"{d}/indexed", "indexed", index_gzip.plan_ranges(index, 3)).collect()
    assert [r.records for r in got] == [1000]
    with pytest.raises(ValueError):
        index_gzip.count_records(spark, d, "other")


def test_running_sums_over_ranges(spark):
    rows = [(None if i % 3 == 0 else "a", i * 7 % 1000, i % 5) for i in range(1000)]
    got = metrics.running_sum(spark.createDataFrame(rows, "g string, o long, v long"), ["g"], ["o"], F.col("v"), "s", width=64).collect()
    assert len(got) == 1000
    for g in (None, "a"):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.o):
            total += r.v
            assert r.s == total


def test_ranges_of_lines_leave_the_session_alone(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n" for i in range(300_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = readers.scan_ranges(spark, f"{tmp_path}/x.txt", 1)
    assert got.count() == 300_000 and got.rdd.getNumPartitions() >= 3
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before and spark.sql("select 1").first()[0] == 1


def test_metadata_by_kind(spark):
    kv = [
        ("policy:p", '{"id":"p","system":"KAFKA","scope":"s","stream":"t","pipeline":[{"id":"count","region":"EDGE","arguments":["n=1"]}],"storage":["t0"]}'),
        ("fn:count", '{"id":"count","executeOn":"ALL","hardware":"NONE","dataRouting":true}'), ("fn:bad", "{"), ("worker:w", '{"endpoint":"e","region":"EDGE"}'), ("target:t0", '{"other":1}'), ("x", "{}"), (None, None),
    ]
    t = catalog.metadata_tables(spark.createDataFrame(kv, "key string, value string"), {"function": "fn"})
    p = t["policy"].first()
    assert (p.key_id, p.system, p.pipeline[0].id, p.pipeline[0].arguments, p.storage) == ("p", "KAFKA", "count", ["n=1"], ["t0"])
    assert [(r.key_id, r.executeOn, r.dataRouting, r.transformsContent) for r in t["function"].collect()] == [("count", "ALL", True, None)]
    assert [(r.endpoint, r.region, r.hardware) for r in t["worker"].collect()] == [("e", "EDGE", None)] and t["target"].count() == 0
    w = policy.validate_workers(t["worker"]).first()
    f = spark.createDataFrame([("f", "ALL", "NONE"), (" ", "ALL", "NONE"), ("f", None, "NONE")], "id string, execute_on string, hardware string")
    assert not w.valid and [r.valid for r in policy.validate_functions(f).collect()] == [True, False, False]


def test_policy_of_a_tag(spark):
    df = spark.createDataFrame([(None, "edge:count, CLOUD:pack"), ("p", "edge:count"), (None, ""), (None, None)], "policy_id string, tag string").withColumns({c: F.lit("x") for c in ("system", "scope", "stream")})
    got = [r.fallback for r in policy.with_fallback_policy(df, F.col("tag")).collect()]
    assert got[1:] == [None] * 3 and got[0].id == "mock" and [(s.pos, s.id, s.region, s.arguments) for s in got[0].steps] == [(0, "count", "EDGE", []), (1, "pack", "CLOUD", [])]
    made = policy.with_fallback_policy(df, F.col("tag")).where("fallback is not null").select("fallback.*")
    assert [(r.id, r.turn) for r in policy.steps(made, "EDGE").collect()] == [("count", 1)]


def test_first_registration_of_a_step_counts():
    first = register("test-first", put=lambda df: df)
    assert register("test-first", put=lambda df: None) is first


def test_approximate_percentiles(spark):
    ops = spark.range(10_001).select(F.lit("op").alias("op"), F.col("id").cast("double").alias("latency_s"))
    r = metrics.approx_latency_summary(ops, ["op"]).first()
    assert abs(r.p50 - 5000) <= 2 and abs(r.p99 - 9900) <= 2 and r.max == 10_000


def test_entry_without_the_training_data_part():
    """With its folders gone the other queries are still there, and the pipeline is not."""
    code = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "tierflow.llm" or name.startswith("tierflow.llm."):
            raise ModuleNotFoundError(name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), "pipeline" in e.queries(), any(n.startswith("op1_") for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(core.QUERIES)), "False", "False", "True"], out.stderr
