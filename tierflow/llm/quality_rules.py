"""Quality rules and an isolation forest on their statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bounded, pieces_of, stored
from ._features import NAMES, base, statistics

_STATS = ", ".join(f"s{i} double" for i in range(len(NAMES)))


class IsolationForest:
    """Random splits of small samples; rows that few splits isolate are anomalous.

    A split is drawn from the sample's range widened by ``margin`` on both sides,
    so that a figure that never varies in the sample still isolates rows that
    differ in it.
    """

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 3, margin: float = 4.0):
        self.margin = margin
        rng = np.random.default_rng(seed)
        self.depth = int(np.ceil(np.log2(max(2, min(sample, len(x))))))
        size = 2 ** (self.depth + 1)
        self.column = np.zeros((trees, size), np.int64)
        self.split = np.full((trees, size), np.inf)
        self.length = np.zeros((trees, size))
        for t in range(trees):
            self._grow(t, 1, x[rng.choice(len(x), min(sample, len(x)), replace=False)], 0, rng)
        self.norm = self._path(min(sample, len(x)))

    @staticmethod
    def _path(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, x: np.ndarray, depth: int, rng) -> None:
        if depth == self.depth or len(x) < 2:
            self.length[t, node] = depth + self._path(len(x))
            # every place below a leaf holds its length, so all rows walk to the bottom
            for d in range(1, self.depth - depth + 1):
                self.length[t, node << d : (node + 1) << d] = self.length[t, node]
            return
        c = rng.integers(x.shape[1])
        self.column[t, node], self.split[t, node] = c, rng.uniform(x[:, c].min() - self.margin, x[:, c].max() + self.margin)
        left = x[:, c] < self.split[t, node]
        self._grow(t, 2 * node, x[left], depth + 1, rng)
        self._grow(t, 2 * node + 1, x[~left], depth + 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path, the higher."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.split)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, self.column[t][node]] >= self.split[t][node])
            total += self.length[t][node]
        return 2.0 ** -(total / len(self.split) / max(self.norm, 1e-9))


def _forest_of(figures: dict) -> IsolationForest:
    forest = object.__new__(IsolationForest)
    forest.__dict__.update(figures)
    return forest


_CELLS = 1 << 16  # places that a threshold may have


def _threshold(cells: np.ndarray, good: np.ndarray, bad: np.ndarray, care: float) -> float:
    """Where the share of bad rows below plus ``care`` times that of good rows above is least.

    Good and bad rows are counted in ``cells`` of 1 / 65536 of the score, which are sorted. Of equal places the
    middle is taken; without bad rows, a little above the highest good score.
    """
    if not bad.any():
        return float((cells[-1] + 1 + 0.1 * (cells[-1] - cells[0])) / _CELLS)
    cost = care * (1 - np.cumsum(good) / max(1, good.sum())) + np.cumsum(bad) / bad.sum()
    best = int(cost.argmin())
    upto = cells[best + 1] if best + 1 < len(cells) else cells[best] + 1
    return float(np.nextafter((cells[best] + 1 + upto) / 2 / _CELLS, 0))


def fit(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, sample: int = 51_200, trees: int = 100, care: float = 10.0, id_col: str = "doc_id", text_col: str = "text"):
    """(forest, centre, threshold) from all labelled rows.

    Rows that fail the base rule take no part. The centre is that of all rows labelled good. Each tree
    isolates the rows of a draw of its own, as the method has it; the draws are from half of the good
    rows, ``sample`` / 2 at most (by default as many as all trees draw), picked by hashes of id and text.
    The threshold is set on all other good rows and all bad ones, where
    losing a good row counts ``care`` times as much as keeping a bad one. With fewer
    than 8 good rows nothing is anomalous. Only the drawn rows' statistics, sums and counts reach the driver.
    """
    label = stored(labels.where("quality is not null").groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("_q")), "labels")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(bounded(label), "_id").withColumn("_h", F.xxhash64("_t", F.lit(5)))

    def stats(batches):
        for b in pieces_of(batches):
            known = [base(t) for t in b.column("_t").to_pylist()]
            x = np.array([statistics(t, k) for t, k in zip(b.column("_t").to_pylist(), known)], float).reshape(-1, len(NAMES))
            passed = pa.array([not fails(k[0], k[4], min_words, max_repeat_percent) for k in known], pa.bool_())
            out = pa.record_batch([b.column("_id"), b.column("_q"), b.column("_h"), *[pa.array(c) for c in x.T]], names=["id", "q", "h", *[f"s{i}" for i in range(len(NAMES))]])
            yield out.filter(passed)

    id_kind, q_kind = (rows.schema[c].dataType.simpleString() for c in ("_id", "_q"))
    got = rows.select("_id", "_q", "_h", "_t").mapInArrow(stats, f"id {id_kind}, q {q_kind}, h bigint, {_STATS}")
    columns = [f"s{i}" for i in range(len(NAMES))]
    got = stored(got.select((F.col("q") == 1).alias("good"), F.xxhash64("id", "h", F.lit(5)).alias("place"), *columns), "statistics")
    good = got.where("good")
    n, *sums = good.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    if n < 8:
        return None
    # rounded, as the order of a sum is left to chance
    centre = tuple(np.array([float(f"{v:.9g}") for v in part]) + e for part, e in ((sums[: len(columns)], 0), (sums[len(columns) :], 1e-9)))
    # an id may have any number of rows, so the rows are bounded
    drawn = good.orderBy("place", *columns).limit(max(1, min(n, sample) // 2)).toArrow().to_pandas().sort_values(["place", *columns])
    forest = IsolationForest(_spread(drawn[columns].to_numpy(), centre), trees)
    last = int(drawn["place"].iloc[-1])
    shared = docs.sparkSession.sparkContext.broadcast((vars(forest), centre))

    def score(batches):
        forest, centre = _forest_of(shared.value[0]), shared.value[1]
        for b in pieces_of(batches):
            cell = np.floor(forest.score(_spread(np.column_stack([b.column(c).to_numpy() for c in columns]), centre)) * _CELLS).astype(np.int64)
            yield pa.record_batch([b.column("good"), pa.array(cell)], names=["good", "cell"])

    scored = got.where(~F.col("good") | (F.col("place") > last)).mapInArrow(score, "good boolean, cell bigint")
    count = scored.groupBy("cell").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("cell")
    if not len(count):
        return None
    return forest, centre, _threshold(*(count[c].to_numpy() for c in ("cell", "good", "bad")), care)


def fails(n_words, n_repeat_words, min_words: int, max_repeat_percent: int):
    """The base rule, of numbers or arrays."""
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat_percent * n_words)


def _spread(x: np.ndarray, centre: tuple) -> np.ndarray:
    """Standard scores, drawn in at the far ends, where a split by range would see single rows only."""
    z = (x - centre[0]) / centre[1]
    return np.sign(z) * np.log1p(np.abs(z))


def _judge(texts: list, model, min_words: int, max_repeat_percent: int) -> tuple:
    """(counts, failed the base rule, anomaly, kept) of some texts."""
    forest, centre, limit = model or (None, None, None)
    counts, x = [], []
    for t in texts:
        k = base(t)
        counts.append(k[:5])
        x.append(statistics(t, k))
    counts = np.array(counts, np.int64).reshape(-1, 5)
    score = forest.score(_spread(np.array(x, float), centre)) if forest and len(x) else np.zeros(len(x))
    failed = fails(counts[:, 0], counts[:, 4], min_words, max_repeat_percent)
    return counts, failed, score, ~failed & (score <= limit if forest else True)


def keep_judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, **how) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, each judged by itself, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, min_words, max_repeat_percent, id_col=id_col, text_col=text_col, **how))

    def run(batches):
        for b in pieces_of(batches):
            yield b.filter(pa.array(_judge(b.column(text_col).to_pylist(), shared.value, min_words, max_repeat_percent)[3], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, **how) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept)``, one row per row.

    Null and empty texts have no words and fail the base rule. Repeated ids are
    judged row by row. An empty table gives no rows; without labels the forest
    rejects nothing.
    """
    model = fit(docs, labels, min_words, max_repeat_percent, id_col=id_col, text_col=text_col, **how)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in pieces_of(batches):
            counts, failed, score, kept = _judge(b.column("text").to_pylist(), shared.value, min_words, max_repeat_percent)
            cols = [b.column("id"), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(score), pa.array(kept)]
            yield pa.record_batch(cols, names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept"])

    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, anomaly double, kept boolean")
    return out.withColumnRenamed("id", id_col)
