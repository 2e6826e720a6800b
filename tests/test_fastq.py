import io

import numpy as np
import pytest

from tierflow.sources.fastq import Fastq, first_record, read_fastq_files, records
from tierflow.sources.files import together


def fastq(rng, n):
    out = []
    for i in range(n):
        k = int(rng.integers(1, 30))
        quality = "".join(rng.choice(list("@+I#é" if i % 5 == 0 else "@+I#"), k))
        out.append((f"r{i} @x", "".join(rng.choice(list("ACGTN"), k)), "" if i % 2 else f"r{i}", "@" + quality[1:] if i % 3 else quality))
    return out


def text(rows, end="\n"):
    return "".join(f"@{h}{end}{s}{end}+{o}{end}{q}{end}" for h, s, o, q in rows).encode()


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**6])
def test_each_record_once(size):
    rng = np.random.default_rng(size)
    for rows, data in ((r := fastq(rng, 60), text(r)), (r, text(r, "\r\n")), (r[:-1], text(r)[:-4]), ([], b""), ([], b"no record\n" * 9), (r[:5], text(r[:5])[:-1])):
        got = [x for i in range(0, len(data), size) for x in records(io.BytesIO(data), i, i + size)]
        cut = data.endswith(text(r)[-40:-4]) and rows == r[:-1]
        want = [tuple(x.encode() for x in (f"@{h}", s, f"+{o}", q)) for h, s, o, q in rows]
        assert got[: len(want)] == want and (len(got) == len(want) or cut)


def test_first_records():
    lines = text(fastq(np.random.default_rng(1), 9)).splitlines(True)
    for i in range(0, len(lines) - 8):
        assert (i + first_record(lines[i : i + 6])) % 4 == 0


def test_files_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(5)
    one, two = fastq(rng, 700), fastq(rng, 300)
    (tmp_path / "a.fastq").write_bytes(text(one))
    (tmp_path / "b.fastq").write_bytes(text(two))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    for size in (500, 1 << 20):
        got = read_fastq_files(spark, f"file://{tmp_path}", size).orderBy("id").collect()
        assert [r.id for r in got] == list(range(1000))
        assert [(r.header, r.sequence, r.optional_header, r.quality) for r in got] == one + two
    spark.dataSource.register(Fastq)
    parts = spark.read.format("fastq_ranges").option("path", f"{tmp_path}").option("rangebytes", 500).load()
    assert parts.rdd.getNumPartitions() == sum(-(-len(text(x)) // 500) for x in (one, two))
    assert read_fastq_files(spark, f"file://{tmp_path}/b.fastq").count() == 300


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_sequences_that_begin_like_other_lines(spark, tmp_path, end):
    """A range that begins ahead of such a record was left out whole."""
    rows = [(f"r{i}", "@+xA"[i % 4] * (i % 9) + "\r" * (end == "\n" and i % 5 == 0), "", "@+"[i % 2] * (1 + i % 7)) for i in range(300)]
    (tmp_path / "a.fastq").write_bytes(text(rows, end))
    (tmp_path / "b.fastq").write_bytes(b"head\n" + text(rows[7:], end))
    for size in (1, 60, 10**6)[end == "\r\n" :]:
        got = read_fastq_files(spark, f"file://{tmp_path}", size).orderBy("id").collect()
        assert [(r.id, r.header, r.sequence, r.optional_header, r.quality) for r in got] == [(i, *r) for i, r in enumerate(rows + rows[7:])]


def test_many_small_ranges_share_a_task():
    assert together(list(range(5)), [1] * 5, most=3, few=5) == [[0], [1], [2], [3], [4]]
    assert together(list(range(6)), [1, 1, 1, 9, 2, 1], most=3, few=5) == [[0, 1, 2], [3], [4, 5]]
