"""User metadata of chunks as a map of lower-cased strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RESERVED = "tierflow-"


def put_tags(old: Column, new: Column) -> Column:
    """``old`` overridden by ``new``; keys and values lower-cased, reserved keys rejected, the last of equal keys wins."""
    def clean(m: Column) -> Column:
        e = F.transform(F.map_entries(m), lambda x: F.struct(F.lower(x.key).alias("key"), F.lower(x.value).alias("value")))
        return F.filter(e, lambda x: ~x.key.startswith(RESERVED))
    both = F.concat(F.coalesce(clean(old), F.array().cast("array<struct<key:string,value:string>>")), F.coalesce(clean(new), F.array().cast("array<struct<key:string,value:string>>")))
    keys = F.array_distinct(F.transform(both, lambda x: x.key))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(both, lambda x: x.key == k), -1).value)))


def get_tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key.lower()))


def tags_from_headers(headers: Column, prefix: str = "x-amz-meta-") -> Column:
    """Headers with the prefix in any case, without it."""
    kept = F.map_filter(headers, lambda k, v: F.lower(F.substring(k, 1, len(prefix))) == prefix)
    return F.transform_keys(kept, lambda k, v: F.substring(k, len(prefix) + 1, 1 << 20))


def encode_applied(steps: Column, region: str) -> Column:
    """``REGION:id`` of the content-changing steps of one region, comma-joined."""
    done = F.filter(steps, lambda s: (s.region == region) & s.transforms)
    return F.array_join(F.transform(done, lambda s: F.concat(s.region, F.lit(":"), s.id)), ",")


def decode_applied(tag: Column, region: str) -> Column:
    """Ids applied in one region (any case); entries without ``:`` are dropped."""
    parts = F.transform(F.split(tag, ","), lambda x: F.split(x, ":", 2))
    mine = F.filter(parts, lambda p: (F.size(p) == 2) & (F.upper(F.trim(p[0])) == region.upper()))
    return F.transform(mine, lambda p: F.replace(p[1], F.lit(":"), F.lit("")))


def parse_args(args: Column) -> Column:
    """``k=v`` strings as a map: cut at the first ``=``, trimmed, keys lower-cased; others dropped, the last of equal keys wins."""
    kv = F.filter(args, lambda x: F.contains(x, F.lit("=")))
    e = F.transform(kv, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    keys = F.array_distinct(F.transform(e, lambda x: x.key))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(e, lambda x: x.key == k), -1).value)))
