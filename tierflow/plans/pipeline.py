"""Pipelines of steps over chunks, forwards for uploads and backwards for reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.policy import applies, resolve_policy, steps
from ..sources.files import new_folder

Transform = Callable[[DataFrame], DataFrame]


def same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Step:
    name: str
    put: Transform = same
    get: Transform = same


REGISTRY: dict[str, Step] = {}


def register(name: str, put: Transform = same, get: Transform = same) -> Step:
    """A step by name; the first registration of a name counts."""
    return REGISTRY.setdefault(name, Step(name, put, get))


def source_step(name: str, serve: Callable[[DataFrame], Column]) -> Step:
    """A step that says for each read which target serves it; null leaves what was decided before."""
    def get(df: DataFrame) -> DataFrame:
        before = F.col("served_by") if "served_by" in df.columns else F.lit(None).cast("string")
        return df.withColumn("served_by", F.coalesce(serve(df), before))

    return register(name, get=get)


def with_context(chunks: DataFrame, pol: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``context`` to named chunks: what a step may know of a chunk, as one struct.

    Policy and tier, the URIs of stream and partition, and the policy's targets in
    their order as ``(id, path)``; all but the URIs are null without a policy.
    """
    paths = pol.select(F.col("id").alias("_policy"), F.posexplode("storage").alias("_pos", "_target"))
    paths = paths.join(targets.select(F.col("id").alias("_target"), "path"), "_target")
    listed = F.array_sort(F.collect_list(F.struct("_pos", "_target", "path")))
    paths = paths.groupBy("_policy").agg(F.transform(listed, lambda x: F.struct(x["_target"].alias("id"), x["path"].alias("path"))).alias("_targets"))
    rows = resolve_policy(chunks, pol).join(paths, F.col("policy_id") == F.col("_policy"), "left")
    context = F.struct("policy_id", "policy_tier", "stream_uri", "partition_uri", F.col("_targets").alias("targets"))
    return rows.withColumn("context", context).drop("_policy", "_targets")


def ordered_apply(df: DataFrame, by: list[str], order: list[str], start, step: Callable, schema: str) -> DataFrame:
    """The requests of a partition strictly one after the other, partitions side by side.

    ``step(state, row)`` gives the next state and a row of ``schema``; every
    partition begins with ``start``. Rows stream through, none are gathered.
    """
    import pyarrow as pa

    names, kinds = list(df.columns), df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema, last, state = to_arrow_schema(kinds), object(), None
        for b in batches:
            out = []
            for values in zip(*(b.column(c).to_pylist() for c in names)):
                row = dict(zip(names, values))
                key = tuple(row[c] for c in by)
                if key != last:
                    last, state = key, start
                state, made = step(state, row)
                out.append(made)
            cols = list(zip(*out)) or [[] for _ in out_schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def score(df: DataFrame, loader: Callable[[], Callable], column: str, name: str = "score", kind: str = "double") -> DataFrame:
    """Adds what a model makes of a column, batch by batch; ``loader`` gives the model, once per task."""
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for b in batches:
            yield pd.Series(model(b))

    return df.withColumn(name, run(column))


def update_cache(cache: DataFrame, chunks: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Copies of the chunks written last, by key: a rewrite replaces the copy."""
    from ..operators.catalog import latest

    return latest(cache.unionByName(chunks.select(*cache.columns)), [key], order)


def chunk_step(name: str, put: Callable[[bytes], bytes] | None = None, get: Callable[[bytes], bytes] | None = None, content: str = "content") -> Step:
    """A step from functions of bytes."""
    from ..operators.index_gzip import _udf

    wrap = lambda f: same if f is None else (lambda df: df.withColumn(content, _udf(f)(content)))
    return register(name, wrap(put), wrap(get))


def record_step(name: str, read: Transform, tag: Callable[[DataFrame], DataFrame], key: str = "key") -> Step:
    """Tags from decoded records: ``tag`` gives rows (key, tags); chunks pass unchanged."""
    def put(df: DataFrame) -> DataFrame:
        return df.join(tag(read(df)), key, "left")

    return register(name, put)


@dataclass
class Pipeline:
    steps: list[Step] = field(default_factory=list)

    def put(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: s.put(d), self.steps, df)

    def get(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: s.get(d), reversed(self.steps), df)


def run_policies(chunks: DataFrame, pol: DataFrame, region: str, op: str = "PUT") -> DataFrame:
    """Each chunk through the steps of its policy; chunks without one pass.

    Pipelines are a tree of steps, so those that begin alike share their first steps.
    Where the tree branches, the chunks so far are stored once, a folder per branch, and each
    branch reads its own: the chunks are scanned once, and a shared step runs
    once, whatever the number of pipelines. A step keeps the column ``policy_id``. Steps of other
    regions or operations never enter the plan.
    """
    rows = steps(pol, region, op).where(applies(op)).select("policy_id", "turn", "id").collect()  # policies are configuration
    by_policy: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        by_policy.setdefault(r.policy_id, []).append((r.turn, r.id))
    lines = {p: tuple(i for _, i in sorted(s)) for p, s in by_policy.items()}

    def walk(df: DataFrame, depth: int, policies: list[str]) -> list[DataFrame]:
        branches: dict[str | None, list[str]] = {}  # by next step; None: done, or without a policy
        for p in policies:
            branches.setdefault(lines[p][depth] if depth < len(lines[p]) else None, []).append(p)
        if depth == 0:
            branches.setdefault(None, [])
        if len(branches) == 1:
            stored = {next(iter(branches)): df}
        else:
            number = reduce(lambda c, b: c.when(F.col("policy_id").isin(b[1]), b[0]), ((i, ps) for i, (s, ps) in enumerate(branches.items()) if s is not None), F.when(F.lit(False), -1)).otherwise(-1)
            path = new_folder(df.sparkSession, "branches")
            df.withColumn("_branch", number).write.partitionBy("_branch").parquet(path)
            back = df.sparkSession.read.schema(StructType([*df.schema, StructField("_branch", IntegerType())])).parquet(path)
            stored = {s: back.where(F.col("_branch") == (-1 if s is None else i)).drop("_branch") for i, s in enumerate(branches)}
        out = []
        for name, part in stored.items():
            if name is None:
                out.append(part)
            else:
                step = REGISTRY[name]
                out += walk(step.put(part) if op == "PUT" else step.get(part), depth + 1, branches[name])
        return out

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), walk(resolve_policy(chunks, pol), 0, list(lines)))


def write_chunks(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("container", "scope", "stream").parquet(path)


def write_routed(df: DataFrame, path: str) -> None:
    """Chunks to their targets in one pass: a folder per target id."""
    df.write.mode("append").partitionBy("target_id").parquet(path)


def write_discard(df: DataFrame, length: str = "length") -> int:
    """Consume everything; only the sum of lengths is kept."""
    from pyspark.sql import Observation

    o = Observation()
    df.observe(o, F.sum(length).alias("bytes")).write.format("noop").mode("overwrite").save()
    return o.get["bytes"] or 0


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path)


def publish(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Topic and JSON value of every record, for a Kafka sink or files."""
    rest = [c for c in df.columns if c != topic]
    return df.select(F.col(topic).alias("topic"), F.to_json(F.struct(*rest)).alias("value"))
