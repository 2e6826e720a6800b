import struct

import numpy as np
import pyarrow as pa
import pytest

from tierflow.sources import readers
from tierflow.sources.slices import Frames, Lines, Marked, read_apart, read_in_order, sliced

SLICES = "key string, slice long, content binary"


def cut_anywhere(rng, data, most):
    at = [0, *sorted(set(rng.integers(0, len(data) + 1, len(data) // most + 2).tolist())), len(data)] if data else [0, 0]
    return [data[i:j] for i, j in zip(at, at[1:])]


def frames(rng, n):
    out = []
    for i in range(n):
        body = rng.integers(0, 3, int(rng.integers(0, 60))).astype(np.uint8).tobytes() if i % 3 else struct.pack("<iq", int(rng.integers(0, 9)), i) * 3
        out.append(struct.pack("<iq", len(body), i) + body)
    return b"".join(out)


CASES = {
    "lines": (Lines(), lambda rng, n: "".join(rng.choice(list("ab é \n\n"), 9 * n)).encode(), lambda d: [(x.decode().rstrip(),) for x in d.split(b"\n")[:-1]]),
    "lines with the tail": (Lines(partial=True), lambda rng, n: "".join(rng.choice(list("ab \n"), 9 * n)).encode(), lambda d: [(x.decode().rstrip(),) for x in (d.split(b"\n") if not d.endswith(b"\n") and d else d.split(b"\n")[:-1])]),
    "markers": (Marked(), lambda rng, n: rng.choice([0xFF, 0xD8, 0xD9, 1], 9 * n, p=[0.5, 0.2, 0.2, 0.1]).astype(np.uint8).tobytes(), lambda d: list(readers.split_markers.__wrapped__(d))),
    "long markers": (Marked(b"aab", b"abab"), lambda rng, n: bytes(rng.choice(list(b"ab"), 12 * n).tolist()), lambda d: list(readers.split_markers.__wrapped__(d, b"aab", b"abab"))),
    "frames": (Frames(), lambda rng, n: frames(rng, n), lambda d: list(readers.read_frames.__wrapped__(d))),
    "frames, cut off": (Frames(), lambda rng, n: frames(rng, n)[:-3] if n % 2 else frames(rng, n) + struct.pack("<iq", -1, 0) + frames(rng, 2), lambda d: list(readers.read_frames.__wrapped__(d))),
}


@pytest.mark.parametrize("name", list(CASES))
def test_slices_equal_the_whole(spark, name):
    form, make, whole = CASES[name]
    rng, rows, want = np.random.default_rng(len(name)), [], []
    for k in range(40):
        data = make(rng, int(rng.integers(0, 25)))
        rows += [(f"k{k}" if k else None, i, s) for i, s in enumerate(cut_anywhere(rng, data, int(rng.integers(1, 80))))]
        want += [(f"k{k}" if k else None, i, *r) for i, r in enumerate(whole(data))]
    rng.shuffle(rows)
    got = read_apart(spark.createDataFrame([(k, int(i), bytes(c)) for k, i, c in rows], SLICES), form).collect()
    clean = lambda r: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)
    assert sorted(map(str, map(clean, got))) == sorted(map(str, want)) and want


def test_leftovers_go_from_slice_to_slice(spark):
    rng, rows, want = np.random.default_rng(3), [], []

    def decode(data, last):
        """Numbers that end with a semicolon; the last one may lack it."""
        *done, rest = data.split(b";")
        made = [(int(x),) for x in done if x]
        return (made + [(int(rest),)] * bool(rest), len(data)) if last else (made, len(data) - len(rest))

    for k in range(12):
        numbers = rng.integers(0, 10**6, int(rng.integers(0, 40))).tolist()
        data = b";".join(str(n).encode() for n in numbers)
        rows += [(f"k{k}", i, s) for i, s in enumerate(cut_anywhere(rng, data, 9))]
        want += [(f"k{k}", i, n) for i, n in enumerate(numbers)]
    got = read_in_order(spark.createDataFrame(rows, SLICES).repartition(7), decode, "number long").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_sliced(spark):
    df = spark.createDataFrame([("a", b"0123456789"), ("b", b""), ("c", None), ("d", b"0123")], "key string, content binary")
    assert sorted((r.key, r.slice, bytes(r.content)) for r in sliced(df, 4).collect()) == [("a", 0, b"0123"), ("a", 1, b"4567"), ("a", 2, b"89"), ("d", 0, b"0123")]


def test_short_slices_share_batches(spark, monkeypatch):
    """Every slice made a batch of its own in two passes."""
    made, batch = spark.sparkContext.accumulator(0), pa.record_batch
    data = b"".join(b"line %d\n" % i for i in range(3000))
    rows = sliced(spark.createDataFrame([("k", data)], "key string, content binary"), 20).coalesce(1)
    counted = lambda *a, **k: made.add(1) or batch(*a, **k)

    class Counting(Lines):
        def exits(self, *a):
            pa.record_batch = counted
            return super().exits(*a)

        def cut(self, *a):
            pa.record_batch = counted
            return super().cut(*a)

    try:
        assert read_apart(rows, Counting()).count() == 3000
    finally:
        pa.record_batch = batch
    assert 0 < made.value < 300
