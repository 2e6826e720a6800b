import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierflow.streaming import stateful as st
from tierflow.streaming.state import read_state, run_available

PUTS = "scope string, stream string, partition string, k string, v string, seq long"


@pytest.fixture()
def own(spark):
    """A session with the state store that transformWithState needs."""
    s = st.state_session(spark)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    return s


def puts(n=60):
    return [("s", f"t{i % 2}", f"p{i % 3}", None if i % 19 == 7 else f"k{i % 4}", None if i % 11 == 5 else f"v{i}", i) for i in range(n)]


def previous(state, r):
    yield r.scope, r.stream, r.partition, r.k, state["values"].put(r.k, r.v), r.seq


def distinct(state, r):
    """How many different values a key has had, and how many keys there are."""
    if r.v is not None and r.k is not None and state["seen"].put(f"{r.k}/{r.v}", True) is None:
        state["n"].put(r.k, state["n"].get(r.k, 0) + 1)
    yield r.scope, r.stream, r.partition, f"{state['n'].get(r.k, 0)}/{sum(1 for _ in state['n'].items())}", None, r.seq


def fresh(state, r):
    """Counts rows and starts over when a null value comes."""
    if r.v is None:
        state["rows"].clear()
    state["rows"].put("n", state["rows"].get("n", 0) + 1)
    yield r.scope, r.stream, r.partition, str(state["rows"].get("n")), state["rows"].remove("absent"), r.seq


FUNCTIONS = {previous: {"values": "string"}, distinct: {"seen": "boolean", "n": "long"}, fresh: {"rows": "long"}}


class Plain:
    """A dict that acts like a field."""

    def __init__(self):
        self.d = {}

    def get(self, k, default=None):
        return self.d.get(k, default) if k is not None else default

    def put(self, k, v):
        before = self.get(k)
        if k is not None:
            self.d.pop(k, None)
            if v is not None:
                self.d[k] = v
        return before

    def remove(self, k):
        return self.put(k, None)

    def items(self):
        return iter(self.d.items())

    def clear(self):
        self.d.clear()


@pytest.mark.parametrize("fn", list(FUNCTIONS), ids=lambda f: f.__name__)
@pytest.mark.parametrize("scope", ["shared", "partitioned"])
def test_functions_with_state(own, tmp_path, fn, scope):
    rows, held, want = puts(), {}, []
    for r in map(lambda r: type("R", (), dict(zip(["scope", "stream", "partition", "k", "v", "seq"], r))), rows):
        key = (r.scope, r.stream) + (r.partition,) * (scope == "partitioned")
        want += fn(held.setdefault(key, {f: Plain() for f in FUNCTIONS[fn]}), r)
    out = "scope string, stream string, partition string, k string, previous string, seq long"
    for part in (rows[:25], rows[25:]):  # stopped and started again
        own.createDataFrame(part, PUTS).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(PUTS).parquet(f"{tmp_path}/in")
        run_available(st.stateful(stream, fn, out, FUNCTIONS[fn], scope), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = own.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    if fn is previous:
        left = {(r.stream, r.k): r.v for r in read_state(own, f"{tmp_path}/ck").collect()} if scope == "shared" else None
        assert left is None or left == {(k[1], f): v for k, s in held.items() for f, v in s["values"].items()}


def test_scopes():
    with pytest.raises(ValueError):
        st.keys_of("other")


def _wait(test, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if test():
            return
        time.sleep(0.3)
    raise AssertionError("it did not happen in time")


def test_a_silent_node_is_reported_without_traffic(own, tmp_path):
    now = int(time.time() * 1000)
    own.createDataFrame([("a", now + 15_000), ("a", now), ("old", now - 60_000), ("none", None), ("b", now + 90_000)], "node string, last_seen long").write.parquet(f"{tmp_path}/in")
    beats = own.readStream.schema("node string, last_seen long").parquet(f"{tmp_path}/in")
    q = st.liveness(beats, 2000).writeStream.format("memory").queryName("alive").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="500 milliseconds").start()
    events = lambda: [tuple(r) for r in own.sql("select node, event from alive order by at, node").collect()]
    try:
        _wait(lambda: ("a", "removed") in events())
        own.createDataFrame([("a", int(time.time() * 1000) + 60_000)], "node string, last_seen long").write.mode("append").parquet(f"{tmp_path}/in")
        _wait(lambda: events().count(("a", "added")) == 2)
    finally:
        q.stop()
    assert sorted(set(events())) == [("a", "added"), ("a", "removed"), ("b", "added")]
    r = own.sql("select at - last_seen from alive where event = 'removed'").first()
    assert r[0] >= 2000


def test_refused_chunks_are_retried_alone(own, tmp_path):
    kind = "partition string, uri string, seq long, content binary"
    box, calls = f"{tmp_path}/box", f"{tmp_path}/calls"
    os.mkdir(box)

    def store(partition, uri, content):
        with open(calls, "a") as f:
            f.write(f"{partition} {uri}\n")
        if b"refuse" in content and not os.path.exists(f"{box}/open"):
            raise OSError("refused")
        with open(f"{box}/{partition}-{uri}", "wb") as f:
            f.write(content)

    def run(rows):
        own.createDataFrame(rows, kind).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(kind).parquet(f"{tmp_path}/in")
        return st.write_behind(stream, store, 1000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="300 milliseconds").start()

    tried = lambda x: open(calls).read().split("\n").count(x) if os.path.exists(calls) else 0
    q = run([("p", "1", 1, b"refuse 1"), ("p", "2", 2, b"two"), ("p", "3", 3, b"refuse 3"), ("q", "1", 4, b"one"), ("q", "5", 5, None)])
    try:
        _wait(lambda: tried("p 1") >= 3)
    finally:
        q.stop()
    assert sorted(os.listdir(box)) == ["p-2", "q-1", "q-5"] and tried("p 2") == tried("q 1") == tried("q 5") == 1
    left = {r.uri: r.attempts for r in st.waiting(own, f"{tmp_path}/ck").collect()}
    assert left.keys() == {"1", "3"} and min(left.values()) >= 2
    open(f"{box}/open", "w").close()
    before = tried("p 2")
    q = run([("p", "3", 6, b"newer")])
    try:
        _wait(lambda: {"p-1", "p-3"} <= set(os.listdir(box)))
        _wait(lambda: own.read.parquet(f"{tmp_path}/out").where("stored and partition = 'p'").count() >= 3)
    finally:
        q.stop()
    assert open(f"{box}/p-3", "rb").read() == b"newer" and open(f"{box}/p-1", "rb").read() == b"refuse 1" and tried("p 2") == before
    tries = own.read.parquet(f"{tmp_path}/out").where("uri = '1' and partition = 'p'").orderBy("attempts").collect()
    assert [r.attempts for r in tries] == list(range(1, len(tries) + 1)) and [r.stored for r in tries] == [False] * (len(tries) - 1) + [True]
    assert len({r.first_try for r in tries}) == 1 and all(b.at - a.at >= 1000 for a, b in zip(tries, tries[1:]))
    assert st.waiting(own, f"{tmp_path}/ck").count() == 0


def test_rows_are_sorted_in_bounded_memory(monkeypatch):
    """All rows of a key were held at once; now runs of them wait in files, and no more than a few are read ahead."""
    rng, files = np.random.default_rng(4), []
    make = st.tempfile.TemporaryFile
    monkeypatch.setattr(st.tempfile, "TemporaryFile", lambda: files.append(make()) or files[-1])
    seq = rng.permutation(5000) // 2
    rows = [(None if s % 50 == 7 else int(s), None if s % 3 else f"v{s}", i) for i, s in enumerate(seq.tolist())]
    batches = [pd.DataFrame(rows[i : i + 300], columns=["seq", "a b", "n"]) for i in range(0, 5000, 300)]
    want = [r for _, r in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0]))]
    assert list(map(tuple, st._rows(iter(batches), "seq", most=40_000, step=100))) == want and len(files) > 3 and all(f.closed for f in files)
    assert list(map(tuple, st._rows(iter(batches), "seq"))) == want and list(map(tuple, st._rows(iter(batches), None))) == rows


def test_a_field_holds_few_keys_at_once():
    class Held(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    f = st.Field(Held())
    for i in range(50):
        assert f.put(f"k{i % 25}", i) == (None if i < 25 else i - 25)
        f.save(9)
        assert len(f._now) <= 9


def test_lanes_share_a_partition(own, tmp_path):
    """A partition's chunks were stored by one task, whatever their number."""
    kind = "partition string, uri string, seq long, content binary"
    own.createDataFrame([("p", str(i), i, b"x") for i in range(40)], kind).write.parquet(f"{tmp_path}/in")
    os.mkdir(f"{tmp_path}/box")

    def store(partition, uri, content):
        open(f"{tmp_path}/box/{uri}", "wb").close()
        if uri == "7" and not os.path.exists(f"{tmp_path}/seen"):
            open(f"{tmp_path}/seen", "w").close()
            raise OSError("busy")

    tries = st.write_behind(own.readStream.schema(kind).parquet(f"{tmp_path}/in"), store, 500, lanes=8)
    st.run_until_stored(tries, f"{tmp_path}/out", f"{tmp_path}/ck", 40)
    done = own.read.parquet(f"{tmp_path}/out").where("stored").collect()
    assert sorted((r.partition, int(r.uri), r.attempts) for r in done) == [("p", i, 2 if i == 7 else 1) for i in range(40)]
    lanes = own.read.format("statestore").option("path", f"{tmp_path}/ck").option("stateVarName", "waiting").load()
    assert "lane" in lanes.schema["key"].dataType.names and st.waiting(own, f"{tmp_path}/ck").count() == 0


def test_a_batch_that_runs_again_repeats_its_tries(own, tmp_path):
    """The store remembered what it had refused, so a task that ran again stored it at its first try."""
    kind = "partition string, uri string, seq long, content binary"

    def store(partition, uri, content, attempt):
        if uri == "7" and not os.path.exists(f"{tmp_path}/lost"):
            open(f"{tmp_path}/lost", "w").close()
            raise RuntimeError("the task is lost")
        if int(uri) % 3 == 0 and attempt == 1:
            raise OSError("busy")

    own.createDataFrame([("p", str(i), i, b"x") for i in range(8)], kind).write.parquet(f"{tmp_path}/in")
    tries = st.write_behind(own.readStream.schema(kind).parquet(f"{tmp_path}/in"), store, 500, lanes=2, numbered=True)
    with pytest.raises(Exception, match="the task is lost"):
        st.run_until_stored(tries, f"{tmp_path}/out", f"{tmp_path}/ck", 8)
    st.run_until_stored(tries, f"{tmp_path}/out", f"{tmp_path}/ck", 8)
    got = {(r.uri, r.attempts, r.stored) for r in own.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(str(i), 1, i % 3 > 0) for i in range(8)} | {(str(i), 2, True) for i in (0, 3, 6)}
    assert own.conf.get("spark.sql.streaming.stateStore.checkpointFormatVersion") == "2" and st.waiting(own, f"{tmp_path}/ck").count() == 0


def test_stored_chunks_are_read_by_name(spark, sf, tmp_path, monkeypatch):
    """The driver listed a file for every document; now tasks open files by name, a few MB at a time."""
    from tierflow.plans import queries as q
    from tierflow.sources.files import read_named

    for i in range(5):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * i)
    rows = spark.createDataFrame([(i, f"{i}.bin") for i in range(7)], "id long, name string").coalesce(1)
    got = read_named(rows, f"file://{tmp_path}", most=3).collect()
    assert [(r.id, r.name, bytes(r.content)) for r in got] == [(i, f"{i}.bin", bytes([i]) * i) for i in range(5)]
    assert read_named(rows.where("id > 4"), f"file://{tmp_path}").count() == 0

    def listed(*_):
        raise AssertionError("a folder was listed")

    monkeypatch.setattr(q.readers, "scan_chunks", listed)
    out = {r.doc_id: (r.attempts, r.digest) for r in q.QUERIES["b4_write_behind"](spark, sf).collect()}
    want = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "if(doc_id % 7 = 0, 2, 1) AS n", "md5(encode(coalesce(text, ''), 'utf-8')) AS d").collect()
    assert out == {r.doc_id: (r.n, r.d) for r in want}


def test_only_a_standstill_ends_a_run(monkeypatch):
    """The limit was for the whole run, which takes longer the more there is to store."""
    from unittest.mock import MagicMock

    clock = [0]
    monkeypatch.setattr(time, "time", lambda: clock[0])
    monkeypatch.setattr(time, "sleep", lambda s: clock.__setitem__(0, clock[0] + 400))
    tries = MagicMock()
    tries.writeStream.format().option().option().trigger().start().exception.return_value = None
    count = tries.sparkSession.read.schema().parquet().where().count
    count.side_effect = [1, 2, 3, 4]
    st.run_until_stored(tries, "", "", 4)
    count.side_effect = [1, 2, 2, 2, 2]
    with pytest.raises(TimeoutError, match="2 chunks are not stored"):
        st.run_until_stored(tries, "", "", 4)
