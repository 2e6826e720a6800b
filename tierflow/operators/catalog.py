"""Object catalog: listing, latest versions, copy, delete, conditions, aliases, tiers, encryption sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .policy import _small

MAX_KEYS = 1000
# Suffix of an encrypted object and bytes its envelope adds per part.
SUFFIX, OVERHEAD = ".s3enc", 64
TIERS = ["STANDARD", "INFREQUENT", "ARCHIVE", "COLD"]


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key; partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def list_objects(objs: DataFrame, prefix: str = "", delimiter: str | None = None, marker: str | None = None, max_keys: int = MAX_KEYS, key: str = "key") -> DataFrame:
    """``(name, is_prefix, length, truncated)``: a page of a listing in key order.

    Keys that go on after ``delimiter`` appear once as a common prefix. The page
    starts after ``marker`` and holds at most ``max_keys`` names (1000 at most).
    """
    k = F.col(key)
    o = objs.where(k.startswith(prefix))
    if delimiter:
        rest = F.substring(k, len(prefix) + 1, 1 << 20)
        common = F.when(F.contains(rest, F.lit(delimiter)), F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter)))
    else:
        common = F.lit(None).cast("string")
    o = o.select(F.coalesce(common, k).alias("name"), common.isNotNull().alias("is_prefix"), F.when(common.isNull(), F.col("length")).alias("length"))
    o = o.groupBy("name", "is_prefix").agg(F.max("length").alias("length"))
    if marker is not None:
        o = o.where(F.col("name") > marker)
    n = min(max_keys, MAX_KEYS)
    page = o.orderBy("name").limit(n + 1)  # a page of a listing is the feature
    w = Window.orderBy("name")  # over one page
    page = page.withColumn("_n", F.row_number().over(w)).withColumn("truncated", F.max("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > n)
    return page.where(F.col("_n") <= n).drop("_n")


def conditional(objs: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds ``status`` 200, 304, 412 or 404 to requests with if_match, if_none_match, modified_since, unmodified_since."""
    j = requests.join(objs.select("key", "etag", "modified"), "key", "left")
    failed = (F.col("if_match") != F.col("etag")) | (F.col("unmodified_since") < F.col("modified"))
    same = (F.col("if_none_match") == F.col("etag")) | (F.col("modified_since") >= F.col("modified"))
    status = F.when(F.col("etag").isNull(), 404).when(F.coalesce(failed, F.lit(False)), 412).when(F.coalesce(same, F.lit(False)), 304).otherwise(200)
    return j.withColumn("status", status).select(*requests.columns, "status")


def copy_objects(objs: DataFrame, commands: DataFrame) -> DataFrame:
    """Result rows of ``(source, target, replace, new_meta)``: COPIED with the source's metadata or the new one, SELF_COPY, NO_SOURCE."""
    j = commands.join(objs.withColumnRenamed("key", "source"), "source", "left")
    self_copy = (F.col("source") == F.col("target")) & ~F.col("replace")
    status = F.when(F.col("etag").isNull(), "NO_SOURCE").when(self_copy, "SELF_COPY").otherwise("COPIED")
    return j.select(F.col("target").alias("key"), "source", status.alias("status"), F.when(status == "COPIED", F.when(F.col("replace"), F.col("new_meta")).otherwise(F.col("meta"))).alias("meta"), F.when(status == "COPIED", F.col("length")).alias("length"))


def delete_objects(objs: DataFrame, keys: DataFrame) -> DataFrame:
    return objs.join(keys.select("key").distinct(), "key", "left_anti")


def _aliases(aliases: DataFrame) -> DataFrame:
    once = aliases.withColumn("_n", F.count("*").over(Window.partitionBy("backend")))
    return once.select("alias", F.when(F.col("_n") > 1, F.raise_error(F.lit("a backend has two aliases")).cast("string")).otherwise(F.col("backend")).alias("backend"))


def apply_alias(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Containers by their backend's name; a backend with two aliases raises an error."""
    return df.join(_small(_aliases(aliases)), df.container == F.col("alias"), "left").withColumn("container", F.coalesce("backend", "container")).drop("alias", "backend")


def show_alias(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """The inverse, for listings: backends by their alias."""
    return df.join(_small(_aliases(aliases)), df.container == F.col("backend"), "left").withColumn("container", F.coalesce("alias", "container")).drop("alias", "backend")


def set_tier(df: DataFrame, tier: Column) -> DataFrame:
    return df.withColumn("tier", F.when(F.upper(tier).isin(TIERS), F.upper(tier)).otherwise("STANDARD"))


def logical_size(stored: Column, parts: Column) -> Column:
    """Size of an encrypted object's content."""
    return stored - OVERHEAD * parts


def list_encrypted(objs: DataFrame) -> DataFrame:
    enc = F.col("key").endswith(SUFFIX)
    return objs.select(F.when(enc, F.expr(f"substring(key, 1, length(key) - {len(SUFFIX)})")).otherwise(F.col("key")).alias("key"), F.when(enc, logical_size(F.col("length"), F.col("parts"))).otherwise(F.col("length")).alias("length"))


def list_encrypted_page(objs: DataFrame, prefix: str = "", delimiter: str | None = None, marker: str | None = None, max_keys: int = MAX_KEYS) -> DataFrame:
    """A page of ``list_objects`` by the names and sizes of the content; markers are such names too."""
    return list_objects(list_encrypted(objs), prefix, delimiter, marker, max_keys)


def encryption_key(password: str, salt: bytes) -> bytes:
    """128-bit key, derived once on the driver."""
    import hashlib

    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, 65_536, 16)


def encrypt(df: DataFrame, key: bytes) -> DataFrame:
    """Content under AES-GCM; the name gets the suffix."""
    return df.withColumn("content", F.aes_encrypt("content", F.lit(key), F.lit("GCM"))).withColumn("key", F.concat("key", F.lit(SUFFIX)))


def decrypt(df: DataFrame, key: bytes) -> DataFrame:
    return df.withColumn("content", F.aes_decrypt("content", F.lit(key), F.lit("GCM"))).withColumn("key", F.regexp_replace("key", r"\.s3enc$", ""))


def bucket_report(objs: DataFrame) -> DataFrame:
    """Count and bytes of data objects per system; index and manifest objects are left out."""
    from ..functions.names import system

    s, k = system(F.col("key")), F.col("key")
    data = (s == "KAFKA") & k.endswith(".log") | (s == "PULSAR") & ~k.endswith("-index") | (s == "PRAVEGA") & ~k.contains("_system")
    return objs.withColumn("system", s).where(data).groupBy("system").agg(F.count("*").alias("objects"), F.sum("length").alias("bytes"))


_FUNCTION = "id string, executeOn string, hardware string, partitionLocality boolean, transformsContent boolean, dataRouting boolean"
#: Kinds of documents and their fields; credentials of targets are not read.
METADATA = {
    "policy": "id string, system string, scope string, stream string, pipeline array<struct<id:string,region:string,arguments:array<string>>>, storage array<string>",
    "function": _FUNCTION,
    "worker": "endpoint string, region string, hardware string",
    "target": "id string, endpoint string, container string",
}


def read_metadata(kv: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Kind, id and JSON of documents under keys ``kind:id``; rows of no kind or broken JSON are left out."""
    kind = F.substring_index("key", ":", 1)
    doc = F.from_json("value", "map<string,string>")
    return kv.where(F.contains("key", F.lit(":")) & kind.isin(list(kinds or METADATA))).select(kind.alias("kind"), F.regexp_replace("key", "^[^:]*:", "").alias("id"), doc.alias("doc")).where(F.size("doc") > 0)


def metadata_tables(kv: DataFrame, prefixes: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """A table of each kind in ``METADATA``, of ``key_id`` and the fields, from the documents ``(key, value)``.

    ``prefixes`` gives the store's own prefix of a kind, else it is the kind's
    name. Rows of broken JSON, or with none of the fields, are left out.
    """
    out = {}
    for kind, fields in METADATA.items():
        mark = (prefixes or {}).get(kind, kind) + ":"
        rows = kv.where(F.col("key").startswith(mark)).select(F.substring("key", len(mark) + 1, 1 << 20).alias("key_id"), F.from_json("value", fields).alias("d"))
        rows = rows.select("key_id", "d.*")
        out[kind] = rows.where(F.coalesce(*[F.col(c).cast("string") for c in rows.columns[1:]]).isNotNull())
    return out


def apply_changes(table: DataFrame, feed: DataFrame, honour_deletes: bool = False) -> DataFrame:
    """``(key, value)`` after a feed ``(seq, channel, op, value)``: sets win by sequence, other operations are ignored."""
    key = F.regexp_replace("channel", "^__keyspace@0__:", "")
    ops = ["set", "del", "expired"] if honour_deletes else ["set"]
    new = feed.where(F.col("op").isin(ops)).select(key.alias("key"), "value", F.col("seq").cast("long").alias("seq"), (F.col("op") != "set").alias("gone"))
    old = table.select("key", "value", F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("gone"))
    return latest(old.unionByName(new), ["key"], "seq").where("not gone").select("key", "value")
