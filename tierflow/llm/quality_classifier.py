"""Quality classifier: a factorisation machine on hashed words, structure and length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import pieces_of
from ._features import NAMES, base, statistics

WORDS = 1 << 12


def _row(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed lower-cased words with damped counts of unit length, and the statistics."""
    known = base(text)
    stats = statistics(text, known)
    if not known[5]:
        return np.empty(0, np.int64), np.empty(0), stats
    at = np.fromiter(map(zlib.crc32, (text or "").encode("utf-8", "surrogatepass").lower().split()), np.int64, known[0])
    count = np.bincount(at & (WORDS - 1), minlength=WORDS)
    i = np.flatnonzero(count)
    v = np.log1p(count[i])
    return i, v / np.sqrt((v * v).sum()), stats


class FactorisationMachine:
    """w0 + w.x + sum over pairs <v_i, v_j> x_i x_j, the pairs by ((xV)^2 - x^2 V^2) / 2."""

    def __init__(self, n: int, rank: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(n, np.float32), rng.normal(0, 0.02, (n, rank)).astype(np.float32)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.w0 + x @ self.w + 0.5 * ((x @ self.v) ** 2 - (x * x) @ (self.v * self.v)).sum(1)

    def fit(self, rows, y: np.ndarray, steps: int = 480, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 2) -> "FactorisationMachine":
        """Adam on the log loss, about ``steps`` batches; ``rows(i)`` gives the dense rows of numbers ``i``, so only a batch is dense."""
        rng, state, step = np.random.default_rng(seed), [[0.0, 0.0] for _ in range(3)], 0
        for _ in range(-(-steps * batch // len(y)) if len(y) > batch else steps):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                some, step = order[at : at + batch], step + 1
                x = rows(some)
                xx, xv = x * x, x @ self.v
                z = self.w0 + x @ self.w + 0.5 * (xv**2 - xx @ (self.v * self.v)).sum(1)
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)).astype(np.float32)
                grads = [g.sum(), x.T @ g + decay * self.w, x.T @ (g[:, None] * xv) - self.v * (xx.T @ g)[:, None] + decay * self.v]
                new = []
                for s, p, d in zip(state, (self.w0, self.w, self.v), grads):
                    s[0], s[1] = 0.9 * s[0] + 0.1 * d, 0.999 * s[1] + 0.001 * d * d
                    new.append(p - rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
                self.w0, self.w, self.v = new
        self.w, self.v = self.w.astype(np.float32), self.v.astype(np.float32)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30).astype(np.float64)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text"):
    """(machine, centre) learnt from at most ``sample`` labelled rows outside the held-out fold.

    Rows are picked by hashes of id and text; only their features reach the driver.
    Labels, language, source and id are no features.
    """
    label = labels.where(F.col("quality").isNotNull() & ~held_out(F.col(id_col)))
    label = label.groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("_q"))
    picked = label.orderBy(F.xxhash64("_id", F.lit(9)), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(picked, "_id").withColumn("_h", F.xxhash64("_t", F.lit(9)))

    def features(batches):
        for b in pieces_of(batches):
            got = [_row(t) for t in b.column("_t").to_pylist()]
            yield pa.record_batch([
                b.column("_id"), b.column("_q").cast(pa.int64()), b.column("_h"), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())),
                pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32())), pa.array([g[2] for g in got], pa.list_(pa.float32())),
            ], names=["id", "q", "h", "i", "v", "s"])

    kind = rows.schema["_id"].dataType.simpleString()
    got = rows.select("_id", "_q", "_h", "_t").mapInArrow(features, f"id {kind}, q bigint, h bigint, i array<int>, v array<float>, s array<float>")
    got = got.orderBy(F.xxhash64("id", F.lit(9)), "id", "h").limit(sample).toArrow()  # an id may have any number of rows
    if not got.num_rows:
        return None
    got = got.sort_by([("id", "ascending"), ("h", "ascending")]).combine_chunks()  # rows of unequal length stay flat
    column, value, s = (got[c].combine_chunks() for c in "ivs")
    y = got["q"].to_numpy().astype(np.float32)
    begin, column, value = column.offsets.to_numpy(), column.values.to_numpy(), value.values.to_numpy()
    s = s.flatten().to_numpy().astype(np.float64).reshape(len(y), -1)
    centre = (s.mean(0), s.std(0) + 1e-6)
    s = _structure(s, centre).astype(np.float32)

    def dense(some: np.ndarray) -> np.ndarray:
        x = np.zeros((len(some), WORDS + len(NAMES)), np.float32)
        for r, k in enumerate(some):
            i = slice(begin[k], begin[k + 1])
            x[r, column[i]] = value[i]
        x[:, WORDS:] = s[some]
        return x

    return FactorisationMachine(WORDS + len(NAMES)).fit(dense, y), centre


def _structure(s: np.ndarray, centre: tuple) -> np.ndarray:
    z = (s - centre[0]) / centre[1]
    return 0.5 * np.sign(z) * np.log1p(np.abs(z))


def held_out(id_col):
    """Rows whose crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0, F.lit(False))


def _score(model, text: str | None) -> float:
    if not model:
        return 0.5
    machine, centre = model
    i, v, s = _row(text)
    z = _structure(np.array(s), centre).astype(np.float32)
    x, at = np.r_[v.astype(np.float32), z], np.r_[i, np.arange(WORDS, WORDS + len(NAMES))]
    w, f = machine.w[at], machine.v[at]
    raw = machine.w0 + x @ w + 0.5 * ((x @ f) ** 2 - (x * x) @ (f * f)).sum()
    return 1 / (1 + np.exp(-np.clip(float(raw), -30, 30)))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` predicts to be good, each judged by itself, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **how))

    def run(batches):
        for b in pieces_of(batches):
            yield b.filter(pa.array([_score(shared.value, t) >= cut for t in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, **how) -> DataFrame:
    """``(id, held_out, score, predicted)``, one row per row of ``docs``.

    Null and empty texts are scored as texts without words. Repeated ids are
    scored row by row; a null id is not held out. Without labelled rows every
    score is 0.5; an empty table gives no rows.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for b in pieces_of(batches):
            score = np.fromiter((_score(shared.value, t) for t in b.column("text").to_pylist()), float, b.num_rows)
            yield pa.record_batch([b.column("id"), b.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
