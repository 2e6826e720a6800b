"""Shared folder, checkpoints, words and file access used by the operators here."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: ASCII white space, the only separators between words.
SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none (tests, a single machine) a temporary
    folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base:
        base = have.get() if have.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-")
    if not have.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read again."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(files: DataFrame, key: str) -> DataFrame:
    """Rows that stand for a file each, spread over about as many tasks, which their small size would not make."""
    most = 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(1, min(files.count(), most)), key)


def bounded(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` marked to be sent to all tasks if it has at most ``most`` rows; for narrow rows that are stored."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def new_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that ``df`` does not have."""
    name, taken = f"_{name}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _of_files(df: DataFrame) -> bool:
    """Whether every row of ``df`` is one row of a Parquet file and no row of the files is missing."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") and "parquet" in plan.toString().split("\n")[0]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of every row, from 0 without gaps: files by name, and the rows in each.

    The numbers depend on the files alone, so every evaluation gives the same.
    Rows that do not come from Parquet files as they are get written first.
    """
    if not _of_files(df):
        df = stored(df, "rows")
    file, at, of, base = (new_name(df, x) for x in ("file", "at", "of", "base"))
    meta = df.metadataColumn("_metadata")  # also where df has a column of that name
    rows = df.select("*", meta["file_path"].alias(file), meta["row_index"].alias(at))
    files = stored(rows.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("n")), "places")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select(F.col("file").alias(of), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    rows = rows.join(bounded(files), F.col(file) == F.col(of))
    return rows.withColumn(name, F.col(base) + F.col(at)).drop(file, at, of, base)


def pieces_of(batches, rows: int = 512):
    """Record batches in pieces of at most ``rows`` rows; what Arrow has freed goes back to the system at the end."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (bytes methods see ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


_M = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``size``-word shingles.

    Fewer words than ``size`` make one shingle of them all; no word, none.
    """
    w = lower_words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    size = min(size, len(w))
    n = len(w) - size + 1
    s = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            s = (s ^ h[i : i + n]) * _M
            s ^= s >> np.uint64(29)
        return np.unique(mix(s))
