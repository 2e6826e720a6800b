import hashlib

import numpy as np
from pyspark.sql import functions as F

from tierflow.operators import multipart


def test_uploads_go_to_files_and_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for u in range(12):
        for part in rng.permutation(int(rng.integers(1, 30))).tolist():
            for seq in range(int(rng.integers(1, 4))):
                data = rng.bytes(int(rng.integers(0, 3000))) if rng.integers(9) else None
                rows.append((f"u{u}", int(part) + 1, seq, data))
                want.setdefault(f"u{u}", {})[int(part) + 1] = data or b""  # sent last
    rows += [("large", k, 0, bytes([k]) * 200_000) for k in range(1, 40)]
    want["large"] = {k: bytes([k]) * 200_000 for k in range(1, 40)}
    parts = spark.createDataFrame(rows, "upload string, part int, seq int, content binary").repartition(7)
    path = f"file://{tmp_path}/store"
    manifest = multipart.assemble_files(parts, path, file_bytes=500_000)
    files = {r.file for r in manifest.where("upload = 'large'").collect()}
    assert len(files) > 8 and all((tmp_path / "store" / f).stat().st_size < 800_000 for f in files)
    got = multipart.read_uploads(manifest, path).collect()
    whole = {u: b"".join(p[k] for k in sorted(p)) for u, p in want.items()}
    for u, data in whole.items():
        mine = sorted((r.part, r.start, bytes(r.content)) for r in got if r.upload == u)
        assert [(p, c) for p, _, c in mine] == sorted(want[u].items()) and all(data[s : s + len(c)] == c for _, s, c in mine)
    for r in multipart.upload_digests(manifest, path, piece=1000).collect():
        data = whole[r.upload]
        assert (r.parts, r.size, r.md5, r.sha256) == (len(want[r.upload]), len(data), hashlib.md5(data).hexdigest(), hashlib.sha256(data).hexdigest())
    assert multipart.upload_digests(manifest, path).count() == 13
    assert multipart.assemble_files(parts.where("false"), f"{path}-none").count() == 0


def test_tasks_grow_with_the_parts(spark):
    """The number of tasks was fixed, so that what one of them holds grew with the table."""
    rows = [(u, p, "e" if (u + p) % 5 else "x", 4 + (u * p) % 9) for u in range(60) for p in range(1, 2 + u % 4)]
    sent = spark.createDataFrame(rows, "upload long, part int, etag string, size long")
    wanted = sent.select("upload", "part", F.lit("e").alias("etag"))
    last = {u: p for u, p, *_ in rows}
    want = sorted((u, p, "INVALID_PART" if e != "e" else "ENTITY_TOO_SMALL" if s < 8 and p < last[u] else "OK") for u, p, e, s in rows)
    assert multipart.tasks_for(sent, rows=10) == -(-len(rows) // 10) and multipart.tasks_for(sent) == 8
    got = multipart.validate_parts(sent, wanted, 8, task_rows=10)
    assert sorted(map(tuple, got.collect())) == want
    e = sent.select("upload", F.col("part").alias("seq"), F.lit("part").alias("op"), "part", "size")
    e = e.unionByName(e.where("upload % 3 = 0").withColumn("op", F.lit("complete"))).unionByName(e.where("upload % 5 = 0").withColumn("op", F.lit("abort")))
    got = multipart.uploads(e, task_rows=10)
    assert got.rdd.getNumPartitions() == -(-e.count() // 10)
    parts = {u: [s for v, _, _, s in rows if v == u] for u in range(60)}
    state = lambda u: "ABORTED" if u % 5 == 0 else "COMPLETED" if u % 3 == 0 else "OPEN"
    assert sorted(map(tuple, got.collect())) == [(u, state(u), len(parts[u]), sum(parts[u]) if state(u) == "COMPLETED" else None) for u in range(60)]
