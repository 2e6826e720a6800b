"""Column functions on the content of chunks and records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The three patterns of personal data.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\b(?:\+\d{1,3}\s?)?(?:\(\d{1,4}\)|\d{1,4})[-\s]?\d{1,4}[-\s]?\d{3,4}\b"
CARD = r"\b(?:\d[ -]*?){13,16}\b"
PII = {"has_email": EMAIL, "has_phone": PHONE, "has_card": CARD}


def pii(text: Column) -> dict[str, Column]:
    """One flag per pattern; null text has none."""
    return {k: F.coalesce(text.rlike(p), F.lit(False)) for k, p in PII.items()}


def any_pii(text: Column) -> Column:
    a, b, c = pii(text).values()
    return a | b | c


def any_pii_sliced(text: Column, n: int = 8192) -> Column:
    """The same over slices of n characters looked at alone: a match across a cut is missed."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / n).cast("int") - 1))
    return F.coalesce(F.exists(starts, lambda i: F.exists(F.array(*[F.lit(p) for p in PII.values()]), lambda p: F.regexp_like(F.substr(text, i * n + 1, F.lit(n)), p))), F.lit(False))


def words(text: Column) -> Column:
    """Number of non-empty parts between white space."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("long")


def is_jpeg(data: Column, strict: bool = False) -> Column:
    n, magic = (3, "FFD8FF") if strict else (2, "FFD8")
    return F.coalesce(F.hex(F.substring(data, 1, n)) == magic, F.lit(False))


def is_rgb(data: Column, width: int, height: int) -> Column:
    return F.octet_length(data) == width * height * 3


def tai_to_unix(ns: Column) -> Column:
    """Nanoseconds of atomic time as nanoseconds of Unix time."""
    return ns - F.lit(37 * 10**9).cast("long")


def content_matches(data: Column, md5_base64: Column) -> Column:
    return F.lower(F.hex(F.unbase64(md5_base64))) == F.md5(data)


def normalise(values: Column, mean: list[float], std: list[float]) -> Column:
    """Scaled by 1/255, then by channel; channels alternate."""
    k = len(mean)
    m, s = F.array(*[F.lit(x) for x in mean]), F.array(*[F.lit(x) for x in std])
    return F.transform(values, lambda x, i: (x.cast("double") / 255.0 - F.get(m, i % k)) / F.get(s, i % k))


def multi_label(logits: Column, labels: list[str], threshold: float = 0.5) -> Column:
    """Names of the labels whose sigmoid reaches the threshold, comma-joined."""
    names = F.array(*[F.lit(x) for x in labels])
    hit = F.filter(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: 1 / (1 + F.exp(-F.get(logits, i).cast("double"))) >= threshold)
    return F.array_join(F.transform(hit, lambda i: F.get(names, i)), ",")


def sample_pct(key: Column, pct: float, seed: int = 0) -> Column:
    """Keep about pct % of the keys; the same keys on every run."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return h % 10_000 < int(pct * 100)


def route_random(key: Column, n: int, seed: int = 0) -> Column:
    """One of n targets, uniform over keys and repeatable."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key.cast("string"))), 1, 8), 16, 10).cast("long") % n).cast("int")


def norm_throughput(value: Column) -> Column:
    """``12.5MiB/s`` and the like as MB/s; an unknown unit gives null."""
    x = F.try_to_number(F.regexp_extract(value, r"^([0-9.]+)", 1), F.lit("9999999999.999999")).cast("double")
    unit = F.regexp_extract(value, r"([A-Za-z/]+)$", 1)
    return F.when(unit == "KiB/s", x * 1024 / 1e6).when(unit == "MiB/s", x * 1048576 / 1e6).when(unit == "GiB/s", x * 1073741824 / 1e6).when(unit == "MB/s", x)


def byte_range(data: Column, spec: Column, strict: bool = False) -> Column:
    """Bytes that ``bytes=a-b``, ``bytes=a-`` or ``bytes=-n`` asks for; several ranges or none: all of it.

    ``strict`` gives null where the range goes beyond the data.
    """
    n = F.octet_length(data)
    a, b = F.nullif(F.regexp_extract(spec, r"^bytes=(\d*)-(\d*)$", 1), F.lit("")).cast("long"), F.nullif(F.regexp_extract(spec, r"^bytes=(\d*)-(\d*)$", 2), F.lit("")).cast("long")
    start = F.when(a.isNull(), F.greatest(n - b, F.lit(0))).otherwise(a)
    size = F.when(a.isNull(), F.least(b, n)).when(b.isNull(), n - a).otherwise(b - a + 1)
    out = F.substr(data, (start + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))
    beyond = (start >= n) | (start + size > n) if strict else F.lit(False)
    return F.when(spec.isNull() | (a.isNull() & b.isNull()), data).when(~beyond, out)


def state_key(scope: str, partition_uri: Column, stream_uri: Column, fn: str, field: str) -> Column:
    return F.lower(F.concat_ws("-", stream_uri if scope == "shared" else partition_uri, F.lit(fn), F.lit(field)))
