import time

import pytest
from pyspark.sql import functions as F

from tierflow.operators import policy
from tierflow.plans import pipeline
from tierflow.sources import readers
from tierflow.streaming import state, stateful


def _chunks(spark, n=60):
    rows = [(i, "s", f"t{i % 6}", f"k{i}", f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, scope string, stream string, key string, content string").withColumn("system", F.lit("DEFAULT"))


def test_pipelines_share_their_first_steps(spark, tmp_path):
    """A tree of steps: every step runs once on just the chunks of its policies."""
    ran, counted = [], {}

    def step(name):
        seen = spark.sparkContext.accumulator(0)
        counted[name] = seen

        def put(df):
            ran.append(name)

            @F.udf("string")
            def mark(x):
                seen.add(1)
                return f"{x or ''}{name}"

            return df.withColumn("trace", mark(F.col("trace") if "trace" in df.columns else F.lit(None).cast("string")))

        pipeline.register(f"tree-{name}", put)
        return f"tree-{name}"

    a, b, c, d = map(step, "abcd")
    lines = {"p0": [a, b, c], "p1": [a, b, d], "p2": [a, b], "p3": [a], "p4": [d, a]}
    pol = policy.policies(spark, [(p, "DEFAULT", "s", f"t{i}", [(k, n, "ALL", "NONE", False, False, False, "EDGE", []) for k, n in enumerate(names)], []) for i, (p, names) in enumerate(lines.items())])
    src = _chunks(spark)
    src.write.parquet(f"{tmp_path}/chunks")
    out = pipeline.run_policies(spark.read.parquet(f"{tmp_path}/chunks"), pol, "EDGE")
    got = {r.doc_id: r.trace for r in out.collect()}
    want = {i: "".join(n[-1] for n in lines.get(f"p{i % 6}", [])) or None for i in range(60)}
    assert got == want
    assert sorted(ran) == sorted("abcd" + "da")  # one run a place in the tree: a, a-b, a-b-c, a-b-d, d, d-a
    assert {n: s.value for n, s in counted.items()} == {"a": 50, "b": 30, "c": 10, "d": 20}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/chunks" not in plan  # read before, once


def test_chunks_and_logs_are_stored_and_read_back(spark, tmp_path):
    df = _chunks(spark).select(F.lit("tier").alias("container"), "scope", "stream", "key", F.encode("content", "utf-8").alias("content"), F.create_map(F.lit("kind"), F.lit("text")).alias("tags"))
    pipeline.write_chunks(df, f"{tmp_path}/default")
    back = spark.read.parquet(f"{tmp_path}/default")
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert back.where("stream = 't3'").count() == 10 and (tmp_path / "default/container=tier/scope=s/stream=t3").is_dir()
    routed = df.withColumn("target_id", F.when(F.col("stream") == "t1", "cold").otherwise("hot"))
    pipeline.write_routed(routed, f"{tmp_path}/routed")
    assert sorted(p.name for p in (tmp_path / "routed").glob("target_id=*")) == ["target_id=cold", "target_id=hot"]
    assert spark.read.parquet(f"{tmp_path}/routed/target_id=cold").count() == 10
    sized = df.withColumn("length", F.octet_length("content"))
    assert pipeline.write_discard(sized) == sum(len(f"text {i}") for i in range(60)) and pipeline.write_discard(sized.where("false")) == 0
    log = spark.createDataFrame([(1, "t0", 5), (2, "t1", 7)], "at long, target string, size long")
    for _ in range(2):
        pipeline.append_log(log, f"{tmp_path}/log")
    assert sorted(map(tuple, spark.read.schema(log.schema).csv(f"{tmp_path}/log").collect())) == [(1, "t0", 5)] * 2 + [(2, "t1", 7)] * 2


def test_chunks_are_scanned_by_name(spark, tmp_path):
    files = {"a/0/x.log": b"one\ntwo\n", "a/0/x.index": b"no", "b/1/y.log": b"three\npart"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = readers.scan_chunks(spark, str(tmp_path))
    assert sorted((r.key.split(f"{tmp_path}/")[1], r.length, bytes(r.content)) for r in got.collect()) == [(k, len(v), v) for k, v in sorted(files.items()) if k.endswith(".log")]
    assert "content" not in got.select("key", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    lines = readers.read_lines(got.where("length < 9")).select("value")
    assert sorted(r.value for r in lines.collect()) == ["one", "two"]


def test_record_functions_tag_chunks(spark):
    chunks = spark.createDataFrame([("a", b"one\ntwo\nthree\n"), ("b", b"none"), ("c", None)], "key string, content binary")
    step = pipeline.record_step("lines-tag", readers.read_lines, lambda r: r.groupBy("key").agg(F.create_map(F.lit("lines"), F.count("*").cast("string")).alias("tags")))
    got = {r.key: (r.content and bytes(r.content), r.tags) for r in step.put(chunks).collect()}
    assert got == {"a": (b"one\ntwo\nthree\n", {"lines": "3"}), "b": (b"none", None), "c": (None, None)}


def test_null_puts_remove(spark, tmp_path):
    own = stateful.state_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    kind = "scope string, stream string, partition string, k string, v string, seq long"
    own.createDataFrame([("s", "t", "p", "k", "1", 1), ("s", "t", "p", "k", None, 2), ("s", "t", "p", "k", "3", 3), ("s", "t", "p", "gone", "4", 4), ("s", "t", "p", "gone", None, 5)], kind).write.parquet(f"{tmp_path}/in")
    state.run_available(state.previous_values(own.readStream.schema(kind).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert [r.previous for r in own.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()] == [None, "1", None, None, "4"]
    assert [(r.k, r.v) for r in state.read_state(own, f"{tmp_path}/ck").collect()] == [("k", "3")]
