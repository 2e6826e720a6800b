"""Functions with state over streams, heartbeats with timers, and writes that are retried chunk by chunk."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string


_STEP = 10_000  # rows given on at once, and keys of a field held at once


class Field:
    """One field of a function's state: a map that stays from row to row and from run to run.

    A null value is no value: to put it removes the key. A null key holds nothing.
    Within a micro-batch values are read once and written once, as long as they are few.
    """

    def __init__(self, held):
        self._held, self._now, self._new = held, {}, set()

    def get(self, key: str | None, default: Any = None) -> Any:
        if key is None:
            return default
        if key not in self._now:
            self._now[key] = self._held.getValue((key,))[0] if self._held.containsKey((key,)) else None
        value = self._now[key]
        return default if value is None else value

    def put(self, key: str | None, value: Any) -> Any:
        """Sets a value and gives what the key held before."""
        before = self.get(key)
        if key is not None and not (value is None and before is None):
            self._now[key] = value
            self._new.add(key)
        return before

    def remove(self, key: str | None) -> Any:
        return self.put(key, None)

    def items(self) -> Iterator[tuple[str, Any]]:
        self.save()
        return ((k[0], v[0]) for k, v in self._held.iterator())

    def clear(self) -> None:
        self._now, self._new = {}, set()
        self._held.clear()

    def save(self, beyond: int = -1) -> None:
        """Writes what is new and forgets what was read, if that is more than ``beyond`` keys."""
        if len(self._now) <= beyond:
            return
        for key in self._new:
            if self._now[key] is not None:
                self._held.updateValue((key,), (self._now[key],))
            elif self._held.containsKey((key,)):
                self._held.removeKey((key,))
        self._now, self._new = {}, set()


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that functions with state need.

    A task may run twice, and both runs write state; the state that stays is that of the run whose rows count
    (format 2). The stores of an executor share a bound of memory.
    """
    own, store = spark.newSession(), "spark.sql.streaming.stateStore"
    own.conf.set(f"{store}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set(f"{store}.checkpointFormatVersion", "2")
    own.conf.set(f"{store}.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def _clean(b: pd.DataFrame) -> Iterator[Any]:
    return b.astype(object).where(b.notna(), None).itertuples(index=False)


def _rows(batches: Iterable[pd.DataFrame], order: str | None, most: int = 16 << 20, step: int = 1000) -> Iterator[Any]:
    """The rows of a micro-batch, nulls as None; sorted by ``order`` if there is one (nulls last), else as they come.

    Rows to be sorted are held for about ``most`` bytes; sorted runs beyond that wait
    in a temporary file each, of which ``step`` rows are held, and are merged.
    """
    if not order:
        for b in batches:
            yield from _clean(b)
        return
    held, size, runs = [], 0, []

    def run() -> pd.DataFrame:
        return pd.concat(held).sort_values(order, kind="stable")

    def read(file, rows) -> Iterator[Any]:
        file.seek(0)
        for _ in range(0, rows, step):
            yield from _clean(pickle.load(file))

    def place(row) -> tuple:
        value = row[at]
        return (True, 0) if value is None else (False, value)

    try:
        for b in batches:
            at = b.columns.get_loc(order)
            held.append(b)
            size += int(b.memory_usage(deep=True).sum())
            if size > most:
                whole, file = run(), tempfile.TemporaryFile()
                runs.append((file, len(whole)))
                for i in range(0, len(whole), step):
                    pickle.dump(whole.iloc[i : i + step], file)
                held, size = [], 0
        last = (_clean(w[i : i + step]) for w in ([run()] if held else []) for i in range(0, len(w), step))
        last = (row for rows in last for row in rows)
        yield from heapq.merge(*(read(*r) for r in runs), last, key=place) if runs else last
    finally:
        for file, _ in runs:
            file.close()


def _frame(rows: list[tuple], schema: StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.names, dtype=object)


def keys_of(scope: str) -> list[str]:
    """The columns that share a state: ``shared``, scope and stream; ``partitioned``, the partition as well."""
    if scope not in ("shared", "partitioned"):
        raise ValueError(f"no such scope: {scope}")
    return ["scope", "stream"] + ["partition"] * (scope == "partitioned")


def stateful(
    stream: DataFrame, fn: Callable[[dict[str, Field], Any], Iterable[tuple]], schema: str,
    fields: dict[str, str], scope: str = "partitioned", order: str | None = "seq",
) -> DataFrame:
    """What a user's function makes of a stream's rows with state of its own.

    ``fn(state, row)`` gives rows of ``schema``; ``state`` has a map (see ``Field``) from
    string keys for each of ``fields`` (name to type). State is one per scope and stream
    (``shared``) or per partition as well (``partitioned``); it lies in the query's
    checkpoint, so a stopped stream goes on with it. The rows of a micro-batch are taken in
    the order of ``order``, for which a key's rows of the batch are sorted in runs on disk; without it they
    pass as they come. Null parts of a key are a key of their own.
    """
    out = _parse_datatype_string(schema)

    class Apply(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = {name: Field(handle.getMapState(name, "k string", f"v {kind}")) for name, kind in fields.items()}

        def handleInputRows(self, key, rows, timerValues):
            made = []
            for row in _rows(rows, order):
                made += fn(self.state, row)
                if len(made) >= _STEP:
                    yield _frame(made, out)
                    made = []
                for f in self.state.values():
                    f.save(_STEP)
            for f in self.state.values():
                f.save()
            yield _frame(made, out)

        def close(self) -> None:
            pass

    return stream.groupBy(*keys_of(scope)).transformWithStateInPandas(Apply(), out, "Append", "None")


EVENTS = "node string, event string, last_seen long, at long"


def liveness(beats: DataFrame, timeout_ms: int) -> DataFrame:
    """``(node, event, last_seen, at)``: ``added`` with a node's first heartbeat, ``removed`` when it has been silent too long.

    ``beats`` has ``node`` and ``last_seen`` (milliseconds). A timer of processing time
    expires with the timeout, so a silent node is reported without any other
    traffic; a heartbeat moves it. A null time, and one whose timeout is already
    over, bring no node in; a node that comes back is added again.
    """
    out = _parse_datatype_string(EVENTS)

    class Watch(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.seen = handle, handle.getValueState("seen", "at long")

        def beat(self, node, rows, now) -> list[tuple]:
            times = [int(r.last_seen) for r in rows if r.last_seen is not None]
            before = self.seen.get()[0] if self.seen.exists() else None
            last = max(times + [before] * (before is not None), default=None)
            if last in (None, before) or (before is None and last + timeout_ms <= now):
                return []
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.seen.update((last,))
            self.handle.registerTimer(max(last + timeout_ms, now + 1))
            return [(node, "added", last, now)] if before is None else []

        def handleInputRows(self, key, rows, timerValues):
            yield _frame(self.beat(key[0], _rows(rows, None), timerValues.getCurrentProcessingTimeInMs()), out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last = self.seen.get()[0]
            self.seen.clear()
            yield _frame([(key[0], "removed", last, timerValues.getCurrentProcessingTimeInMs())], out)

        def close(self) -> None:
            pass

    return beats.groupBy("node").transformWithStateInPandas(Watch(), out, "Append", "ProcessingTime")


TRIES = "partition string, uri string, attempts int, first_try long, at long, stored boolean"


def write_behind(chunks: DataFrame, store: Callable[..., None], retry_ms: int = 5000, lanes: int = 1, numbered: bool = False) -> DataFrame:
    """Store chunks ``(partition, uri, seq, content)`` one by one and say what came of every try.

    ``store(partition, uri, content)`` raises OSError to refuse a chunk. A refused
    chunk waits in the state, with its content, attempts and time of the first try, until a
    timer finds it due, ``retry_ms`` after the last try; it is tried for ever, the oldest of a
    partition first. Chunks that are stored, and those that are not due, are not
    touched, and none waits for another. A newer chunk of the same uri replaces
    one that waits. After a stop the stream goes on with what waits; a chunk may be stored
    twice if a run ends amid a batch, so ``store`` overwrites.

    Chunks of a partition are stored by one task; ``lanes`` deals them by uri to so many, each with an order of its own.
    A task that is lost runs again and repeats its tries with the same numbers; ``numbered`` gives ``store`` that number
    (from 1) as a fourth argument, so that it can answer a repeated try as it did at first.
    """
    out = _parse_datatype_string(TRIES)

    class Queue(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "uri string", "content binary, attempts int, first_try long, due long, seq long")

        def attempt(self, partition, uri, content, attempts, first, seq, now) -> tuple:
            try:
                store(partition, uri, bytes(content or b""), *[attempts] * numbered)
            except OSError:
                self.waiting.updateValue((uri,), (content, attempts, first, now + retry_ms, seq))
                self.handle.registerTimer(now + retry_ms)
                return partition, uri, attempts, first, now, False
            if self.waiting.containsKey((uri,)):
                self.waiting.removeKey((uri,))
            return partition, uri, attempts, first, now, True

        def handleInputRows(self, key, rows, timerValues):
            now, made = timerValues.getCurrentProcessingTimeInMs(), []
            for r in _rows(rows, "seq"):
                made.append(self.attempt(key[0], r.uri, r.content, 1, now, r.seq, now))
                if len(made) == _STEP:
                    yield _frame(made, out)
                    made = []
            yield _frame(made, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentProcessingTimeInMs()
            due, made = sorted((v[2], v[4] is None, v[4] or 0, k[0]) for k, v in self.waiting.iterator() if v[3] <= now), []
            for *_, uri in due:  # contents are read one by one
                content, attempts, first, _, seq = self.waiting.getValue((uri,))
                made.append(self.attempt(key[0], uri, content, attempts + 1, first, seq, now))
                if len(made) == _STEP:
                    yield _frame(made, out)
                    made = []
            yield _frame(made, out)

        def close(self) -> None:
            pass

    by = ["partition"]
    if lanes > 1:
        chunks, by = chunks.withColumn("lane", F.pmod(F.xxhash64("uri"), F.lit(lanes))), ["partition", "lane"]
    return chunks.groupBy(*by).transformWithStateInPandas(Queue(), out, "Append", "ProcessingTime")


def run_until_stored(tries: DataFrame, path: str, checkpoint: str, total: int, every_ms: int = 500, limit_s: int = 600) -> None:
    """Run ``write_behind`` until ``total`` chunks are stored; ``path`` gets every try.

    It gives up when, after the first batch, nothing new has been stored for ``limit_s`` seconds.
    """
    import time

    spark, most = tries.sparkSession, -1
    q = tries.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every_ms} milliseconds").start()
    try:
        while q.isActive and q.lastProgress is None:
            time.sleep(0.2)
        schema = _parse_datatype_string(TRIES)
        while True:
            if q.exception():
                raise q.exception()
            stored = spark.read.schema(schema).parquet(path).where("stored").count()
            if stored >= total:
                return
            if stored > most:
                most, end = stored, time.time() + limit_s
            if time.time() > end:
                raise TimeoutError(f"{total - stored} chunks are not stored, and none was for {limit_s} s")
            time.sleep(0.5)
    finally:
        q.stop()


def waiting(spark, checkpoint: str) -> DataFrame:
    """``(partition, uri, attempts, first_try, due)``: what a stopped ``write_behind`` has yet to store."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load()
    return rows.selectExpr("key.partition", "user_map_key.uri", "user_map_value.attempts", "user_map_value.first_try", "user_map_value.due")
