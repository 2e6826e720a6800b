import gzip
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from tierflow.operators import index_gzip
from tierflow.sources import readers
from tierflow.sources.indexed_gzip import INDEX_TAG, _Reader, index_tags, ranges_of, restored, scan_indexed, write_indexed

PIECES = "key string, kind int, pos long, value binary"


def record(k):
    return f"@r{k}\n{'ACGT' * (k % 7)}\n+\n@{'I' * (4 * (k % 7))}\n".encode()


def store(spark, tmp_path, counts, n=10, per_part=4):
    """Objects of FASTQ records with bytes ahead and after, written to a folder; their contents."""
    content = {key: b"# head\nnot a record\n" * (key != "b") + b"".join(map(record, range(c))) + b"@cut\nACG" * (key != "c") for key, c in counts.items()}
    chunks = spark.createDataFrame(list(content.items()), "key string, content binary")
    pieces = readers.cut_fastq(chunks).select("key", "kind", F.col("number").alias("pos"), "value")
    path = f"file://{tmp_path}/store"
    return path, write_indexed(pieces, path, n, per_part), content


def test_pieces_lose_no_byte():
    for data in (b"", b"no record", b"\n\n@a\nA\n+\n@\n@b\nC\n+\nI", b"@a\nA\n+\n@", b"@a\nA\n+\n@\n", b"x\n@a\nA\n+b\n+\n@b\nCC\n+\n@@\nrest\n"):
        assert b"".join(v for *_, v in readers.fastq_pieces(data)) == data
    one = lambda k: b"%08d" % k + json.dumps({"id": k, "v": 'a"}{' + "\\" * k + "é"}, ensure_ascii=False).encode()
    for data in (b"", b"junk", one(0), b"head" + one(1) + one(2) + b"xx" + one(3) + b"tail", b"12" + b'{"id":1}', one(1) + b'00000002{"id":2,"v":"cut'):
        got = list(readers.json_pieces(data))
        assert b"".join(v for *_, v in got) == data
        assert [p for k, p, _ in got if k == 1] == list(range(sum(k == 1 for k, *_ in got)))


def test_members_start_with_records_and_restore(spark, tmp_path):
    path, members, content = store(spark, tmp_path, {"a/x": 137, "b": 40, "c": 0})
    m = members.orderBy("key", "block").collect()
    for key, data in content.items():
        mine = [r for r in m if r.key == key]
        part = {f: open(f"{tmp_path}/store/data/{f}", "rb").read() for f in {r.file for r in mine}}
        whole = b"".join(part[f] for f in sorted(part))
        assert gzip.decompress(whole) == data
        for r in mine:
            member = gzip.decompress(whole[r.start : r.start + r.size])
            assert member == gzip.decompress(part[r.file][r["at"] : r["at"] + r.size]) and len(member) == r.raw
            assert not r.records or (member.startswith(f"@r{r.first}\n".encode()) and member.count(b"\n") == 4 * r.records)
        starts = [r.start for r in mine if r.records]
        tag = index_tags(members).where(F.col("key") == key).first().tags[INDEX_TAG]
        assert tag == ",".join(map(str, starts))
    assert [r.records for r in m if r.key == "a/x"] == [0, *[10] * 13, 7, 0]
    back = restored(spark, path).orderBy("key", "part", "block").collect()
    assert {k: b"".join(bytes(r.content) for r in back if r.key == k) for k in content} == content
    got = ranges_of(members, 4).orderBy("key", "range").collect()
    assert [(r.key, r.range, r.members) for r in got] == [("a/x", 0, 4), ("a/x", 1, 4), ("a/x", 2, 4), ("a/x", 3, 2), ("b", 0, 1), ("b", 1, 1), ("b", 2, 1), ("b", 3, 1)]
    assert [r.end for r in got if r.key == "b"] == [r.start for r in got if r.key == "b"][1:] + [None]


def test_ranges_are_read_alone(spark, tmp_path):
    path, members, content = store(spark, tmp_path, {"a": 300, "b": 95})
    for size in (1, 200, 1 << 20):
        got = scan_indexed(spark, path, "fastq", size).collect()
        assert sorted((r.key, r.pos, bytes(r.value)) for r in got) == [(k, i, record(i)) for k, c in (("a", 300), ("b", 95)) for i in range(c)]
        assert scan_indexed(spark, path, "fastq", size).rdd.getNumPartitions() == sum(-(-r.size // size) for r in spark.read.parquet(f"{path}/parts").collect())
    lines = scan_indexed(spark, path, "line").where("key = 'b'").count()
    assert lines == 4 * 95
    # what a filter leaves out isn't opened: the other files are gone
    need = {r.file for r in members.where("key = 'a' and first + records > 85 and first <= 118 and records > 0").collect()}
    for r in members.select("file").distinct().collect():
        if r.file not in need:
            os.rename(f"{tmp_path}/store/data/{r.file}", f"{tmp_path}/store/data/{r.file}.away")
    some = scan_indexed(spark, path, "fastq").where("key = 'a' and pos > 84 and pos <= 118")
    assert sorted(r.pos for r in some.collect()) == list(range(85, 119))
    assert scan_indexed(spark, path, "fastq").where("key in ('a') and pos = 100 and value is not null").count() == 1
    assert scan_indexed(spark, path, "fastq").where("key = 'none'").count() == 0
    with pytest.raises(Exception, match="No such file"):
        scan_indexed(spark, path, "fastq").count()


def test_filters_taken_over():
    r = _Reader("p", "fastq", 1)
    rest = StringContains(("file",), "x")
    assert list(r.pushFilters([EqualTo(("key",), "a"), In(("key",), ("a", "b")), GreaterThan(("pos",), 4), LessThanOrEqual(("pos",), 9), rest])) == [rest]
    assert (r.keys, r.low, r.high) == ({"a"}, 5, 9)


def test_many_small_objects_share_tasks(spark, tmp_path):
    """Each of the files of many small objects took a task of its own."""
    pieces = spark.range(1100).selectExpr("cast(id as string) as key", "1 as kind", "0L as pos", "encode(concat('@r', id, '\n\n+\n@\n'), 'utf-8') as value")
    path = f"file://{tmp_path}/small"
    assert write_indexed(pieces, path).agg(F.count("*"), F.sum("records"), F.max("start")).first()[:] == (1100, 1100, 0)
    got = scan_indexed(spark, path, "fastq")
    assert got.rdd.getNumPartitions() < 10
    assert sorted(bytes(r.value) for r in got.where("pos = 0").collect()) == sorted(f"@r{i}\n\n+\n@\n".encode() for i in range(1100))


def test_unpacked_members_are_given_on_in_pieces(spark):
    """All members of a batch were unpacked before the first was given on."""
    values = [None if i == 3 else gzip.compress(bytes([i]) * 1000) for i in range(20)]
    got = list(index_gzip._udf(gzip.decompress, 2500).func(iter([pd.Series(values[:15]), pd.Series([], dtype=object), pd.Series(values[15:])])))
    assert max(map(len, got)) <= 4 and len(got) > 5
    assert [x for s in got for x in s] == [None if v is None else gzip.decompress(v) for v in values]
