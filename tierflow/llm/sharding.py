"""Byte-bounded shards by extendible hashing (DataFrame functions only)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._common import bounded, cut, new_folder, new_name, numbered, stored

BITS = 60


def _hash(key: Column) -> Column:
    """First 60 bits of the MD5 of the key's text; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def assign_shards(df: DataFrame, key_col: str = "doc_id", size_col: Column | None = None, limit: int = 256 << 10, step: int = 3) -> DataFrame:
    """``(key, n_bytes, shard, depth, shard_bytes, shard_rows)``, one row per row of ``df``.

    The directory is indexed by prefix bits of a hash of the key. A bucket of
    more than ``limit`` bytes and more than one row splits on the next bit, and
    no other bucket does. Bytes are summed by prefixes of as many bits as equal
    shards would need and two more; only rows of buckets still too large take
    part in the next turns, of ``step`` bits each.
    ``shard`` is the prefix as a bit string, with pieces of at most ``limit``
    bytes ``+<range of rows>.<piece>`` where one key alone is over the limit. A
    single row over the limit has a shard of its own. Null keys are one key, null
    texts have no bytes; an empty table gives no rows.
    """
    row = new_name(df, "row")
    rows, levels, pieces = _directory(numbered(df, row), row, key_col, size_col, limit, step)
    done = [rows.withColumn("cell", F.shiftright("h", BITS - deep)).join(leaf, "cell").select("key", "n_bytes", "depth", "shard", "shard_bytes", "shard_rows") for deep, leaf in levels]
    if pieces is not None:
        done.append(pieces.select("key", "n_bytes", "depth", "shard", "shard_bytes", "shard_rows"))
    out = reduce(DataFrame.unionByName, done)
    return out.select(F.col("key").alias(key_col), "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")


def _directory(df: DataFrame, row_col: str, key_col: str, size_col: Column | None, limit: int, step: int = 3) -> tuple:
    """(rows without their text, levels, pieces) of numbered rows.

    A level is a number of bits and a table of the cells of so many bits that lie
    in a bucket that fits. ``pieces`` has the rows, as ``_row``, of keys that are
    alone over the limit, or is None.
    """
    size = F.octet_length(F.col("text")) if size_col is None else size_col
    rows = stored(df.select(F.col(row_col).alias("_row"), F.col(key_col).alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes")).withColumn("h", _hash(F.col("key"))), "sizes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    levels, open_, depth, more = [], rows, 0, math.ceil(math.log2(max(1.0, total / limit))) + 2
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(p), depth, '0')"))
    while depth < BITS:
        deep, more = min(depth + more, BITS), step
        cells = cut(open_.withColumn("cell", F.shiftright("h", BITS - deep)).groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
        above = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deep)))).withColumn("p", F.expr(f"shiftright(cell, {deep} - depth)"))
        sums = above.groupBy("depth", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        sums = cut(sums.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)))
        split = sums.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("p").alias("half"))
        first = sums.where(F.col("fits") & (F.col("depth") == depth))
        fits = sums.where("fits").withColumn("half", F.shiftright("p", 1)).join(split, ["depth", "half"], "left_semi").drop("half").unionByName(first)
        leaf = above.select("cell", "depth", "p").join(fits.drop("fits"), ["depth", "p"])  # one bucket a cell
        leaf = stored(leaf.select("cell", "depth", bits.alias("shard"), "shard_bytes", "shard_rows"), "directory")
        levels.append((deep, leaf))
        large = cut(cells.join(leaf.select("cell"), "cell", "left_anti").select("cell"))
        if large.isEmpty():
            return rows, levels, None
        at = open_.withColumn("cell", F.shiftright("h", BITS - deep))
        open_, depth = at.join(large, "cell", "left_semi").select("_row", "key", "n_bytes", "h"), deep
    # one key over the limit: pieces by ranges of rows; rows of more than half the limit stay alone
    half = max(1, limit // 2)
    w = Window.partitionBy("h", "origin").orderBy("n_bytes", "_row")
    run = F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1))
    piece = open_.withColumn("origin", F.expr("_row div 65536")).withColumn("q", F.floor(F.coalesce(run, F.lit(0)) / half).cast("string"))
    piece = piece.withColumn("q", F.when(F.col("n_bytes") > half, F.concat(F.lit("r"), "_row")).otherwise(F.col("q")))
    piece = piece.withColumn("shard", F.concat(F.expr(f"lpad(bin(h), {BITS}, '0')"), F.lit("+"), "origin", F.lit("."), "q"))
    piece = stored(piece.select("_row", "key", "n_bytes", F.lit(BITS).alias("depth"), "shard"), "pieces")
    sums = piece.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return rows, levels, piece.join(sums, "shard")


def write_shards(df: DataFrame, path: str, key_col: str = "doc_id", size_col: Column | None = None, limit: int = 256 << 10) -> None:
    """Write ``df`` with one folder ``_shard=s<shard>`` and one file per shard; every row goes to its own shard.

    Where ``df`` has a column ``_shard`` the folders' name ends with more underscores.
    Rows look their shard up in the directory, so they are shuffled once, to be
    written. Only rows of a key that is alone over the limit meet their piece by
    a join.
    """
    row, h, cell, shard = (new_name(df, x) for x in ("row", "hash", "cell", "shard"))
    rows = numbered(df, row)
    _, levels, pieces = _directory(rows, row, key_col, size_col, limit)
    found = rows.withColumn(h, _hash(F.col(key_col)))
    names = []
    for i, (deep, leaf) in enumerate(levels):
        names.append(new_name(df, f"shard_{i}"))
        leaf = leaf.select(F.col("cell").alias(cell), F.col("shard").alias(names[-1]))
        found = found.join(bounded(leaf), F.shiftright(h, BITS - deep) == F.col(cell), "left").drop(cell)
    of = F.coalesce(*names)
    out = found.where(of.isNotNull()).select(*[F.col(f"`{c}`") for c in df.columns], F.concat(F.lit("s"), of).alias(shard))
    if pieces is not None:
        rest = found.where(of.isNull()).join(pieces.select(F.col("_row").alias(cell), F.col("shard").alias(shard)), F.col(row) == F.col(cell))
        out = out.unionByName(rest.select(*[F.col(f"`{c}`") for c in df.columns], F.concat(F.lit("s"), F.col(shard)).alias(shard)))
    out.repartition(shard).write.partitionBy(shard).parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of written shards, with one more column, ``_shard`` (``_shard_`` where they have one)."""
    shard = new_name(spark.createDataFrame([], schema), "shard")
    found = spark.read.schema(StructType([*schema, StructField(shard, StringType())])).parquet(path)
    return found.withColumn(shard, F.substring(shard, 2, 1 << 30))


def sharded(df: DataFrame, key_col: str = "doc_id", size_col: Column | None = None, limit: int = 256 << 10) -> DataFrame:
    """``(key, n_bytes, shard, depth, shard_bytes, shard_rows)`` of every row, measured on the shards as written."""
    path = new_folder(df.sparkSession, "shards")
    write_shards(df, path, key_col, size_col, limit)
    size = F.octet_length(F.col("text")) if size_col is None else size_col
    rows = read_shards(df.sparkSession, path, df.schema)
    rows = rows.select(F.col(key_col).alias("_key"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"), F.col(rows.columns[-1]).alias("shard"))
    rows = stored(rows, "written")
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    depth = F.length(F.substring_index("shard", "+", 1)).cast("int")
    return rows.join(sums, "shard").select(F.col("_key").alias(key_col), "n_bytes", "shard", depth.alias("depth"), "shard_bytes", "shard_rows")


ORACLE = """
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
g AS (SELECT doc_id, n_bytes, depth, h >> (60 - depth) AS p FROM d, (SELECT unnest(range(0, 51)) AS depth)),
s AS (SELECT depth, p, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM g GROUP BY 1, 2),
l AS (SELECT g.doc_id, g.n_bytes, g.depth, g.p, s.shard_bytes, s.shard_rows,
             row_number() OVER (PARTITION BY g.doc_id ORDER BY g.depth) AS r
      FROM g JOIN s USING (depth, p) WHERE s.shard_bytes <= 262144 OR s.shard_rows = 1)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(depth AS INTEGER) AS depth, shard_bytes, shard_rows
FROM l WHERE r = 1
"""
