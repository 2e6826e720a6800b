"""Files in stores that tasks write and read themselves, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StructField, StructType


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder (``spark.checkpoint.dir``); a temporary folder only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = have.get() if have.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-")
        if not have.isDefined():
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """The same rows, written as Parquet and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def read_named(rows: DataFrame, root: str, name: str = "name", most: int = 8 << 20) -> DataFrame:
    """Rows with the ``content`` of the file below ``root`` that ``name`` names; rows without such a file are left out.

    Tasks open files by name, so nobody lists the folder. Contents are given on after ``most`` bytes.
    """

    def read(batches):
        where, base = locate(root)
        for b in batches:
            held, size = [], 0
            for i, file in enumerate(b.column(name).to_pylist()):
                try:
                    with where.open_input_file(f"{base}/{file}") as f:
                        held.append((i, f.read()))
                except FileNotFoundError:
                    continue
                size += len(held[-1][1])
                if size > most:
                    yield given(b, held)
                    held, size = [], 0
            yield given(b, held)

    def given(b, held):
        at, contents = zip(*held) if held else ((), ())
        columns = b.take(pa.array(at, pa.int64())).columns
        return pa.record_batch([*columns, pa.array(contents, pa.binary())], names=[*b.schema.names, "content"])

    return rows.mapInArrow(read, StructType([*rows.schema.fields, StructField("content", BinaryType())]))


def together(ranges: list, sizes: list[int], most: int = 4 << 20, few: int = 1000) -> list[list]:
    """Ranges for each task: one of them, but of more than ``few`` as many neighbours as stay within ``most`` bytes."""
    if len(ranges) <= few:
        return [[r] for r in ranges]
    out, held = [], most
    for r, size in zip(ranges, sizes):
        if held + size > most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += size
    return out


class Whole:
    """A file that appears whole or not at all: written under another name, then renamed.

    A task that runs again writes the same name, so the last one stays.
    """

    def __init__(self, uri: str):
        self.fs, self.path = locate(uri)
        folder, _, name = self.path.rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        self.part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """The place where ``data`` starts."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)
