"""State per stream or per partition, and streams that write behind with retries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

PUT = "scope string, stream string, partition string, k string, v string, previous string, seq long"


def previous_values(stream: DataFrame, scope: str = "partitioned") -> DataFrame:
    """For every put ``(scope, stream, partition, k, v, seq)`` what k held before.

    State is one map per scope and stream (``shared``) or per partition as well;
    a null v removes the key. Rows of a micro-batch are taken in the order of seq.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    keys = ["scope", "stream"] + ["partition"] * (scope == "partitioned")

    class Puts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getMapState("values", "k string", "v string")

        def handleInputRows(self, key, rows, timerValues):
            out = []
            for r in pd.concat(list(rows)).sort_values("seq").itertuples():
                before = self.state.getValue((r.k,))[0] if self.state.containsKey((r.k,)) else None
                if r.v is None:
                    self.state.removeKey((r.k,))
                else:
                    self.state.updateValue((r.k,), (r.v,))
                out.append((r.scope, r.stream, r.partition, r.k, r.v, before, r.seq))
            yield pd.DataFrame(out, columns=["scope", "stream", "partition", "k", "v", "previous", "seq"])

        def close(self) -> None:
            pass

    return stream.groupBy(*keys).transformWithStateInPandas(Puts(), PUT, "Append", "None")


def read_state(spark: SparkSession, checkpoint: str, var: str = "values", operator: int = 0) -> DataFrame:
    """``(scope, stream[, partition], k, v)``: what a stopped stream's state holds, read from its checkpoint."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", var).load()
    return rows.select("key.*", F.col("user_map_key.k").alias("k"), F.col("user_map_value.v").alias("v"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived and stop."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_stream(chunks: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Chunks through ``process`` batch by batch, each written under its batch number.

    A batch that is replayed overwrites its own folder, so every chunk is stored
    once; a step that fails stores nothing of its batch.
    """
    def each(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    chunks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def word_counts(stream: DataFrame, by: list[str], text: str = "content") -> DataFrame:
    from ..operators.metrics import word_count

    return word_count(stream, by, text)
