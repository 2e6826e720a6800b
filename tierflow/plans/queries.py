"""One query per operator over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names, tags, text
from ..operators import catalog, metrics, multipart, placement, policy, routing
from ..sources import readers
from . import fixtures as fx

_EPOCH_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"  # ts has no time zone
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def _with(body: str, *more: str) -> str:
    return "WITH " + ", ".join([fx.CHUNKS_SQL, *more]) + " " + body


SYSTEM = f"""CASE WHEN regexp_matches(key, '{names.KAFKA}') THEN 'KAFKA' WHEN regexp_matches(key, '{names.PULSAR}') THEN 'PULSAR'
 WHEN regexp_matches(key, '{names.PRAVEGA}') THEN 'PRAVEGA' WHEN regexp_matches(key, '{names.DEFAULT}') THEN 'DEFAULT' END"""
NAMED = f"""n AS (SELECT *, {SYSTEM} AS system FROM chunks),
named AS (SELECT *, CASE system WHEN 'KAFKA' THEN split_part(split_part(key,'/',1),'-',1) WHEN 'PULSAR' THEN 'pulsar' WHEN 'PRAVEGA' THEN split_part(ltrim(key,'/'),'/',1) ELSE split_part(key,'/',1) END AS scope,
 CASE system WHEN 'PULSAR' THEN 'pulsar' WHEN 'PRAVEGA' THEN split_part(ltrim(key,'/'),'/',2) ELSE split_part(key,'/',2) END AS stream,
 CASE system WHEN 'PULSAR' THEN 'pulsar' WHEN 'PRAVEGA' THEN split_part(ltrim(key,'/'),'/',1) ELSE split_part(key,'/',1) END AS p_scope,
 CASE system WHEN 'PULSAR' THEN '0' WHEN 'PRAVEGA' THEN split_part(ltrim(key,'/'),'/',2) ELSE split_part(key,'/',2) END AS p_stream,
 CASE system WHEN 'PULSAR' THEN key WHEN 'PRAVEGA' THEN split_part(ltrim(key,'/'),'/',3) ELSE split_part(key,'/',3) END AS p_partition FROM n)"""
PII = " OR ".join(f"regexp_matches(coalesce(content,''), '{p}')" for p in text.PII.values())
RESOLVED = """r AS (SELECT named.*, (SELECT min(CASE
   WHEN p.scope = named.scope AND p.stream = named.stream THEN '1' || p.policy_id
   WHEN p.stream <> '' AND regexp_full_match(named.scope, replace(p.scope,'*','.*')) AND regexp_full_match(named.stream, replace(p.stream,'*','.*')) THEN '2' || p.policy_id
   WHEN p.stream = '' AND p.scope = named.scope THEN '3' || p.policy_id
   WHEN p.stream = '' AND regexp_full_match(named.scope, replace(p.scope,'*','.*')) THEN '4' || p.policy_id END)
  FROM pol p WHERE p.system = named.system) AS best FROM named),
resolved AS (SELECT *, substr(best, 2) AS policy_id, CAST(substr(best,1,1) AS INTEGER) AS policy_tier FROM r)"""


def _named(spark, sf):
    return names.with_uris(names.with_partition(names.with_scope(names.with_system(fx.chunks(spark, sf)))))


def _resolved(spark, sf):
    return policy.resolve_policy(_named(spark, sf), fx.sample_policies(spark))


@query("sensitive_report", _with("""SELECT scope, stream, CASE WHEN pii THEN 't0' ELSE 't1' END AS target_id, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes,
 CAST(sum(len(list_filter(regexp_split_to_array(coalesce(content,''), '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words
 FROM (SELECT *, (""" + PII + """) AS pii FROM resolved WHERE policy_id IS NOT NULL) GROUP BY 1, 2, 3""", NAMED, fx.STEPS_SQL, RESOLVED))
def sensitive_report(spark, sf):
    """Chunks, bytes and words of each governed stream that go to the sensitive and to the general target."""
    r = _resolved(spark, sf).where("policy_id is not null")
    r = routing.route_pii(r, "content", F.array(F.lit("t0"), F.lit("t1")))
    return r.groupBy("scope", "stream", "target_id").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"), F.sum(text.words(F.col("content"))).alias("words"))


@query("c1_c4_names", _with("SELECT doc_id, system, scope, stream, p_scope || '/' || p_stream || '/' || p_partition AS partition_uri, p_scope || '/' || p_stream AS stream_uri FROM named", NAMED))
def c1_c4_names(spark, sf):
    return _named(spark, sf).select("doc_id", "system", "scope", "stream", "partition_uri", "stream_uri")


@query("c5_forward_url", _with("SELECT doc_id, 'http://edge-a:80/tier' || CASE WHEN starts_with(key, '/') THEN '' ELSE '/' END || replace(key, '#', '%23') AS url FROM chunks"))
def c5_forward_url(spark, sf):
    return fx.chunks(spark, sf).select("doc_id", names.forward_url(F.lit("edge-a:80"), F.col("container"), F.col("key")).alias("url"))


@query("c6_digests", "SELECT doc_id, sha1(t) AS sha1, md5(t) AS md5, sha256(t) AS sha256, doc_id % 3 > 0 AS matches FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def c6_digests(spark, sf):
    """Digests, and whether the content is what an MD5 in base64 claims; every third claim is of other content."""
    t = F.coalesce("text", F.lit(""))
    claim = F.base64(F.unhex(F.md5(F.when(F.col("doc_id") % 3 > 0, t).otherwise(F.concat(t, F.lit("!"))))))
    return fx.table(spark, sf, "documents").select("doc_id", F.sha1(t).alias("sha1"), F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), text.content_matches(t.cast("binary"), claim).alias("matches"))


@query("c7_tai_to_unix", "SELECT event_id, CAST(epoch_us(ts) * 1000 - 37000000000 AS BIGINT) AS unix_ns FROM events")
def c7_tai_to_unix(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", text.tai_to_unix(F.expr(_EPOCH_US) * 1000).alias("unix_ns"))


@query("c8_c9_magic", "SELECT doc_id, starts_with(md5(CAST(doc_id AS VARCHAR)), 'ff') AS jpeg, octet_length(encode(text)) = 300 AS rgb FROM documents")
def c8_c9_magic(spark, sf):
    data = F.concat(F.unhex(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2)), F.lit(b"\xd8"))
    return fx.table(spark, sf, "documents").select("doc_id", text.is_jpeg(data).alias("jpeg"), text.is_rgb(F.encode("text", "utf-8"), 10, 10).alias("rgb"))


@query("c10_c11_tags", "SELECT doc_id, lower(lang) AS lang, '2' AS kept, lower(source) AS source FROM documents")
def c10_c11_tags(spark, sf):
    d = fx.table(spark, sf, "documents")
    old = F.create_map(F.lit("Kept"), F.lit("1"), F.lit("LANG"), F.upper("lang"))
    new = tags.tags_from_headers(F.create_map(F.lit("X-Amz-Meta-kept"), F.lit("2"), F.lit("x-amz-meta-Source"), F.col("source"), F.lit("Host"), F.lit("h")))
    t = d.select("doc_id", tags.put_tags(old, new).alias("t"))
    return t.select("doc_id", *[tags.get_tag(F.col("t"), k).alias(k) for k in ("lang", "kept", "source")])


@query("c12_c13_applied", _with("SELECT doc_id, CASE policy_id WHEN 'p1' THEN 'EDGE:detect' WHEN 'p3' THEN 'EDGE:pack' ELSE '' END AS tag, CASE policy_id WHEN 'p1' THEN 'detect' WHEN 'p3' THEN 'pack' ELSE '' END AS ids FROM resolved WHERE policy_id IS NOT NULL", NAMED, fx.STEPS_SQL, RESOLVED))
def c12_c13_applied(spark, sf):
    p = fx.sample_policies(spark).select(F.col("id").alias("policy_id"), "steps")
    rows = _resolved(spark, sf).select("doc_id", "policy_id").join(p, "policy_id")
    rows = rows.select("doc_id", tags.encode_applied(F.col("steps"), "EDGE").alias("tag"))
    return rows.withColumn("ids", F.array_join(tags.decode_applied(F.col("tag"), "edge"), ","))


@query("c14_args", "SELECT event_id, event_type AS kind, props AS value FROM events")
def c14_args(spark, sf):
    a = tags.parse_args(F.array(F.concat(F.lit(" Kind = "), "event_type"), F.lit("flag"), F.concat(F.lit("V="), "props")))
    return fx.table(spark, sf, "events").select("event_id", a.alias("a")).select("event_id", F.col("a")["kind"].alias("kind"), F.col("a")["v"].alias("value"))


@query("c15_rename", _with("SELECT doc_id, CASE WHEN contains(key, '.log') THEN replace(key, '.log', '.data') WHEN regexp_matches(key, '^/') THEN regexp_replace(key, '^/', 'root/') ELSE key END AS key FROM chunks"))
def c15_rename(spark, sf):
    return fx.chunks(spark, sf).select("doc_id", names.rename(F.col("key"), [(r"\.log", ".data"), ("^/", "root/")]).alias("key"))


@query("c16_c17_alias_tier", "SELECT doc_id, CASE source WHEN 'src1' THEN 'bucket-a' WHEN 'src2' THEN 'bucket-b' ELSE source END AS container, CASE lang WHEN 'en' THEN 'ARCHIVE' ELSE 'STANDARD' END AS tier FROM documents")
def c16_c17_alias_tier(spark, sf):
    a = spark.createDataFrame([("src1", "bucket-a"), ("src2", "bucket-b")], "alias string, backend string")
    d = fx.table(spark, sf, "documents").select("doc_id", F.col("source").alias("container"), "lang")
    d = catalog.apply_alias(d, a)
    return catalog.set_tier(d, F.when(F.col("lang") == "en", "archive").otherwise(F.col("lang"))).select("doc_id", "container", "tier")


@query("c18_h6_encrypted_listing", "SELECT CASE WHEN doc_id % 2 = 0 THEN source || '/' || doc_id ELSE source || '/' || doc_id || '.txt' END AS key, n_chars - CASE WHEN doc_id % 2 = 0 THEN 128 ELSE 0 END AS length FROM documents")
def c18_h6_encrypted_listing(spark, sf):
    k = F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, catalog.SUFFIX).otherwise(".txt"))
    return catalog.list_encrypted(fx.table(spark, sf, "documents").select(k.alias("key"), F.col("n_chars").alias("length"), F.lit(2).alias("parts")))


@query("c16_show_alias", "SELECT doc_id, CASE source WHEN 'src1' THEN 'first' WHEN 'src2' THEN 'second' ELSE source END AS container FROM documents")
def c16_show_alias(spark, sf):
    a = spark.createDataFrame([("first", "src1"), ("second", "src2")], "alias string, backend string")
    return catalog.show_alias(fx.table(spark, sf, "documents").select("doc_id", F.col("source").alias("container")), a)


@query("h6_encrypted_page", "WITH k AS (SELECT source || '/' || doc_id AS name, CAST(n_chars - CASE WHEN doc_id % 2 = 0 THEN 128 ELSE 0 END AS BIGINT) AS length FROM documents) SELECT name, false AS is_prefix, length, (SELECT count(*) FROM k WHERE name > 'src1/2') > 40 AS truncated FROM k WHERE name > 'src1/2' ORDER BY name LIMIT 40")
def h6_encrypted_page(spark, sf):
    k = F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, catalog.SUFFIX).otherwise(""))
    objs = fx.table(spark, sf, "documents").select(k.alias("key"), F.col("n_chars").alias("length"), F.lit(2).alias("parts"))
    return catalog.list_encrypted_page(objs, marker="src1/2", max_keys=40)  # a page of a listing is the feature


@query("d1_pii", "SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '{p}'), false) AS {k}" for k, p in text.PII.items()) + " FROM documents")
def d1_pii(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in text.pii(F.col("text")).items()])


@query("d2_pii_sliced", f"SELECT doc_id, len(list_filter(range(0, greatest(1, CAST(ceil(length(text) / 512.0) AS BIGINT))), lambda i: " + " OR ".join(f"regexp_matches(substr(text, i * 512 + 1, 512), '{p}')" for p in text.PII.values()) + ")) > 0 AS pii FROM documents")
def d2_pii_sliced(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.any_pii_sliced(F.col("text"), 512).alias("pii"))


@query("d3_screen", "SELECT doc_id, source AS chunk, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS id FROM documents WHERE NOT contains(text, 'tion')")
def d3_screen(spark, sf):
    r = fx.table(spark, sf, "documents").select("doc_id", F.col("source").alias("chunk"), F.col("text").alias("sequence"))
    return metrics.screen(r, "tion", ["chunk"], "doc_id").select("doc_id", "chunk", F.col("id").cast("long").alias("id"))



HASH = "CAST(('0x' || substr(md5('7/' || {}), 1, 8)) AS BIGINT)"


@query("d4_k6_sampled_routes", f"SELECT event_id, CAST({HASH.format('event_id')} % 3 AS INTEGER) AS target FROM events WHERE {HASH.format('event_id')} % 10000 < 2500")
def d4_k6_sampled_routes(spark, sf):
    e = fx.table(spark, sf, "events").where(text.sample_pct(F.col("event_id"), 25, 7))  # sampling is the operator
    return e.select("event_id", text.route_random(F.col("event_id"), 3, 7).alias("target"))


@query("d5_every_kth", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 5 = 0")
def d5_every_kth(spark, sf):
    return metrics.every_kth(fx.table(spark, sf, "events"), ["user_id"], "event_id", 5).select("event_id", "user_id")


@query("d6_conditional", """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 412 WHEN o_orderkey % 3 = 1 THEN 304 WHEN o_orderkey % 3 = 2 AND o_orderdate <= TIMESTAMP '1996-01-01' THEN 304 ELSE 200 END AS status FROM orders""")
def d6_conditional(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.md5(F.col("o_orderkey").cast("string")).alias("etag"), F.col("o_orderdate").alias("modified"))
    k = F.col("key")
    req = o.select("key", F.when((k % 3 == 0) & (k % 2 == 1), "other").when(k % 3 == 0, F.col("etag")).alias("if_match"), F.when(k % 3 == 1, F.col("etag")).alias("if_none_match"),
                   F.when(k % 3 == 2, F.lit("1996-01-01").cast("timestamp")).alias("modified_since"), F.lit(None).cast("timestamp").alias("unmodified_since"))
    return catalog.conditional(o, req).select("key", "status")


@query("d7_d8_valid_policies", "SELECT 'c' || c_custkey AS policy_id, c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 11 > 0 AS valid, CASE c_custkey % 3 WHEN 0 THEN 'f' || c_custkey % 4 END AS function FROM customer")
def d7_d8_valid_policies(spark, sf):
    """A policy per customer: every fifth without a scope, every seventh without steps, every eleventh without a system; a third with a step of an unknown function."""
    k = F.col("c_custkey")
    step = F.struct(F.when(k % 3 == 0, F.concat(F.lit("f"), (k % 4).cast("string"))).otherwise("count").alias("id"))
    p = fx.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(k % 11 > 0, "KAFKA").otherwise(" ").alias("system"), F.when(k % 5 > 0, "scope").alias("scope"),
        F.lit("stream").alias("stream"), F.when(k % 7 > 0, F.array(step)).otherwise(F.slice(F.array(step), 1, 0)).alias("steps"), F.array(step).alias("named"))
    bad = policy.check_refs(p.select("id", F.col("named").alias("steps")), spark.createDataFrame([("count",)], "id string"))
    return policy.validate(p).select(F.col("id").alias("policy_id"), "valid").join(bad, "policy_id", "left")


@query("e1_policy_resolution", _with("SELECT doc_id, policy_id, policy_tier FROM resolved", NAMED, fx.STEPS_SQL, RESOLVED))
def e1_policy_resolution(spark, sf):
    return _resolved(spark, sf).select("doc_id", "policy_id", "policy_tier")


LOC = "loc AS (SELECT user_id AS uri, arg_max(event_type, event_id) AS target_id FROM events WHERE event_type <> 'error' GROUP BY 1)"


def _locations(spark, sf):
    e = fx.table(spark, sf, "events").where("event_type <> 'error'").select(F.col("user_id").alias("uri"), F.col("event_type").alias("target_id"), F.col("event_id").alias("seq"))
    return routing.update_locations(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"))


@query("e2_k7_locations", f"WITH {LOC} SELECT c_custkey AS uri, coalesce(target_id, 'default') AS target_id FROM customer LEFT JOIN loc ON uri = c_custkey")
def e2_k7_locations(spark, sf):
    return routing.locate(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("uri")), _locations(spark, sf))


@query("e3_tiered_read", f"WITH {LOC} SELECT c_custkey AS uri, CASE WHEN c_custkey % 4 = 0 THEN 'cache' WHEN target_id IS NOT NULL THEN 'routed' ELSE 'default' END AS source, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE coalesce(target_id, 'default') END AS served_by FROM customer LEFT JOIN loc ON uri = c_custkey")
def e3_tiered_read(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("uri"))
    return routing.resolve_read(c, c.where("uri % 4 = 0"), _locations(spark, sf))


@query("e4_policy_targets", _with("SELECT doc_id, policy_id, CAST(pos AS INTEGER) AS pos, target_id, path FROM resolved JOIN (VALUES ('p1',0,'t0'),('p1',1,'t1'),('p2',0,'t1'),('p3',0,'t0'),('p3',1,'t1'),('p3',2,'t2'),('p4',0,'t2'),('p5',0,'t0')) s(policy_id, pos, target_id) USING (policy_id) JOIN (VALUES ('t0','s3a://hot'),('t1','s3a://warm'),('t2','s3a://cold')) t(target_id, path) USING (target_id)", NAMED, fx.STEPS_SQL, RESOLVED))
def e4_policy_targets(spark, sf):
    t = policy.policy_targets(fx.sample_policies(spark), fx.targets(spark))
    return _resolved(spark, sf).select("doc_id", "policy_id").join(policy._small(t), "policy_id")


def _ring_sql(key: str) -> str:
    points = ",".join(f"({p},'{n}')" for p, n in placement.ring_points(fx.NODES))
    h = f"((('0x' || substr(md5({key}),1,8))::BIGINT % 2147483648) * 4294967296 + ('0x' || substr(md5({key}),9,8))::BIGINT)"
    return f"coalesce((SELECT arg_min(node, p) FROM (VALUES {points}) r(p, node) WHERE p >= {h}), (SELECT arg_min(node, p) FROM (VALUES {points}) r(p, node)))"


@query("e6_ring_owner", f"SELECT c_name AS key, {_ring_sql('c_name')} AS node FROM customer")
def e6_ring_owner(spark, sf):
    return fx.table(spark, sf, "customer").select(F.col("c_name").alias("key"), placement.ring_owner(F.col("c_name"), fx.NODES).alias("node"))


@query("f11_ring_balance", f"SELECT node, count(*) AS keys, CAST(5 AS INTEGER) AS slots FROM (SELECT {_ring_sql('c_name')} AS node FROM customer) GROUP BY 1")
def f11_ring_balance(spark, sf):
    return placement.ring_balance(fx.table(spark, sf, "customer"), "c_name", fx.NODES)


@query("e5_find_worker", "SELECT user_id, event_id, CASE WHEN event_type IN ('click','view') THEN 'edge-a:80' WHEN user_id % 2 = 0 THEN 'cloud-a:80/' END AS endpoint FROM events")
def e5_find_worker(spark, sf):
    e = fx.table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("click", "view"), "EDGE").otherwise("CLOUD").alias("region"),
                                              F.when(F.col("event_type").isin("click", "view") | (F.col("user_id") % 2 == 0), "NONE").otherwise("GPU").alias("required"))
    return placement.find_worker(e, fx.workers(spark)).select("user_id", "event_id", "endpoint")


@query("e7_locate_store", "SELECT doc_id, CASE WHEN source LIKE 'src1%' AND lang = 'en' THEN CASE WHEN source LIKE 'src1_' THEN 's2' ELSE 's1' END END AS store FROM documents")
def e7_locate_store(spark, sf):
    g = spark.createDataFrame([(0, "src1*", "en", "s1"), (1, "src1?", "en", "s2"), (2, "*", "zz", "s3")], "pos int, glob string, identity string, store string")
    g = g.withColumn("glob", F.regexp_replace("glob", r"\?", "[^/]"))
    d = fx.table(spark, sf, "documents").select("doc_id", F.col("source").alias("container"), F.col("lang").alias("identity"))
    return placement.locate_store(d, g).select("doc_id", "store")


@query("e8_fallback_policy", _with("SELECT doc_id, CASE WHEN policy_id IS NOT NULL THEN 'policy' WHEN doc_id % 3 = 0 THEN 'tag' ELSE 'none' END AS policy_source FROM resolved", NAMED, fx.STEPS_SQL, RESOLVED))
def e8_fallback_policy(spark, sf):
    return policy.fallback_policy(_resolved(spark, sf), F.when(F.col("doc_id") % 3 == 0, "EDGE:pack")).select("doc_id", "policy_source")


@query("e8_policy_of_tag", _with("SELECT doc_id, len(s) AS n_steps, s[1] AS first_step, CASE WHEN s IS NOT NULL THEN 'EDGE' END AS region FROM (SELECT doc_id, CASE WHEN policy_id IS NULL AND doc_id % 3 = 0 THEN ['pack', lang] END AS s FROM resolved JOIN documents USING (doc_id))", NAMED, fx.STEPS_SQL, RESOLVED))
def e8_policy_of_tag(spark, sf):
    r = _resolved(spark, sf).join(fx.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    tag = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("edge:pack,edge:"), "lang"))
    s = F.col("fallback.steps")
    return policy.with_fallback_policy(r, tag).select("doc_id", F.when(s.isNotNull(), F.size(s)).cast("long").alias("n_steps"), F.get(s, 0)["id"].alias("first_step"), F.get(s, 0)["region"].alias("region"))


@query("e9_copy", "SELECT 'k' || CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE o_orderkey + 1000000 END AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'NO_SOURCE' WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 'SELF_COPY' ELSE 'COPIED' END AS status, CASE WHEN o_orderkey % 7 = 0 OR (o_orderkey % 5 = 0 AND o_orderkey % 2 = 0) THEN NULL WHEN o_orderkey % 2 = 1 THEN 'new' ELSE o_orderpriority END AS meta FROM orders")
def e9_copy(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.concat(F.lit("k"), "o_orderkey")
    objs = o.where("o_orderkey % 7 <> 0").select(k.alias("key"), F.col("o_orderpriority").alias("meta"), F.lit("e").alias("etag"), F.col("o_custkey").alias("length"))
    to = F.concat(F.lit("k"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 1000000))
    cmd = o.select(k.alias("source"), to.alias("target"), (F.col("o_orderkey") % 2 == 1).alias("replace"), F.lit("new").alias("new_meta"))
    return catalog.copy_objects(objs, cmd).select("key", "status", "meta")


@query("e10_delete", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def e10_delete(spark, sf):
    gone = fx.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return catalog.delete_objects(fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")), gone)


@query("f1_f2_steps", _with("""SELECT doc_id, id AS step, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS INTEGER) AS turn, execute_on IN ('ALL','GET') AND NOT routes AS applies
 FROM resolved JOIN steps USING (policy_id) WHERE region = 'EDGE'""", NAMED, fx.STEPS_SQL, RESOLVED))
def f1_f2_steps(spark, sf):
    s = policy.steps(fx.sample_policies(spark), "EDGE", "GET").withColumn("applies", policy.applies("GET"))
    return _resolved(spark, sf).select("doc_id", "policy_id").join(policy._small(s), "policy_id").select("doc_id", F.col("id").alias("step"), "turn", "applies")


FLAGS = """flags AS (SELECT policy_id, arg_min(CASE WHEN region='EDGE' THEN hardware END, pos) FILTER (region='EDGE' AND hardware<>'NONE') AS special_hardware,
 count(*) FILTER (region='EDGE') > 0 AND coalesce(bool_and(hardware IN ('NONE','GPU')) FILTER (region='EDGE'), true) AS can_execute,
 coalesce(bool_or(region='EDGE' AND execute_on IN ('ALL','PUT')), false) AS some_step, bool_or(routes) AS has_router, arg_min(id, pos) FILTER (routes) AS router_id,
 bool_or(region='EDGE' AND local) AS has_local, max(CASE WHEN region='CLOUD' THEN 'CLOUD' END) AS next_region FROM steps GROUP BY 1)"""


@query("f3_f4_policy_flags", _with("SELECT doc_id, special_hardware, can_execute, can_execute AND some_step AS any_step, has_router, router_id, has_local, next_region FROM resolved JOIN flags USING (policy_id)", NAMED, fx.STEPS_SQL, RESOLVED, FLAGS))
def f3_f4_policy_flags(spark, sf):
    f = policy.policy_flags(fx.sample_policies(spark), "EDGE", "GPU", "PUT")
    return _resolved(spark, sf).select("doc_id", "policy_id").join(policy._small(f), "policy_id").drop("policy_id")


@query("f5_route_plan", _with(f"""SELECT doc_id, CASE policy_id WHEN 'p1' THEN CASE WHEN o.owner <> 'node-a' THEN 'REROUTE' ELSE 'INTER_REGION' END WHEN 'p3' THEN 'NO_SUITABLE_WORKER' WHEN 'p5' THEN 'INTER_REGION' ELSE 'STORE' END AS decision,
 CASE WHEN policy_id = 'p1' AND o.owner <> 'node-a' THEN o.owner || '/' WHEN policy_id IN ('p1','p5') THEN 'cloud-a:80/' END AS next, false AS unprocessed
 FROM (SELECT *, {_ring_sql("p_scope || '/' || p_stream || '/' || p_partition")} AS owner FROM resolved) o""", NAMED, fx.STEPS_SQL, RESOLVED))
def f5_route_plan(spark, sf):
    c = _resolved(spark, sf).select("doc_id", "policy_id", "partition_uri")
    return placement.route_plan(c, fx.sample_policies(spark), fx.workers(spark), fx.NODES, "EDGE", "GPU", "node-a").select("doc_id", "decision", "next", "unprocessed")


@query("f6_step_args", _with("SELECT doc_id, CASE policy_id WHEN 'p4' THEN 'n=100| Mode = Fast |flag' END AS args FROM resolved WHERE policy_id IS NOT NULL", NAMED, fx.STEPS_SQL, RESOLVED))
def f6_step_args(spark, sf):
    a = policy.step_args(fx.sample_policies(spark), "dex")
    return _resolved(spark, sf).select("doc_id", "policy_id").join(policy._small(a), "policy_id").select("doc_id", F.array_join("arguments", "|").alias("args"))


@query("f7_shards", "SELECT doc_id, 'shard-' || list_max(list_transform(range(0, 8), lambda i: struct_pack(h := md5(doc_id || '#' || i), i := i))).i AS shard FROM documents")
def f7_shards(spark, sf):
    return placement.assign_shard(fx.table(spark, sf, "documents"), "doc_id", 8).select("doc_id", "shard")


@query("f8_logical_buckets", "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'other' || c_custkey ELSE 'data' || (c_custkey % 3) END AS bucket, count(*) AS shards, arg_min(c_custkey * 10, c_custkey) AS created FROM customer GROUP BY 1")
def f8_logical_buckets(spark, sf):
    n = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("other"), "c_custkey")).otherwise(F.concat(F.lit("data"), F.col("c_custkey") % 3, F.lit("-"), "c_custkey"))
    b = fx.table(spark, sf, "customer").select(n.alias("name"), (F.col("c_custkey") * 10).alias("created"))
    return placement.logical_buckets(b, ["data0", "data1", "data2"])


LIVE = "SELECT user_id AS node, max(epoch_us(ts) // 1000) AS last_ms FROM events WHERE event_type <> 'error' AND {} GROUP BY 1 HAVING max(epoch_us(ts) // 1000) >= 1704110400000 - 3600000"


def _live(spark, sf, where):
    e = fx.table(spark, sf, "events").where(where)
    b = e.select(F.col("user_id").alias("node"), F.when(F.col("event_type") == "error", "broken").otherwise(F.floor(F.expr(_EPOCH_US) / 1000).cast("long").cast("string")).alias("beat"))
    return placement.live_members(b, F.lit(1704110400000), 3600)


@query("f9_live_members", LIVE.format("true"))
def f9_live_members(spark, sf):
    return _live(spark, sf, "true")


@query("f10_membership", f"WITH a AS ({LIVE.format('event_id % 2 = 0')}), b AS ({LIVE.format('event_id % 3 = 0')}) SELECT coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL THEN 'added' WHEN b.node IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.node = b.node")
def f10_membership(spark, sf):
    return placement.membership_diff(_live(spark, sf, "event_id % 2 = 0"), _live(spark, sf, "event_id % 3 = 0"))


WORDS = "CAST(len(list_filter(regexp_split_to_array(coalesce(text,''), '\\s+'), lambda w: w <> '')) AS BIGINT)"


@query("g1_word_count", f"SELECT source, CAST(sum({WORDS}) AS BIGINT) AS words FROM documents GROUP BY 1")
def g1_word_count(spark, sf):
    return metrics.word_count(fx.table(spark, sf, "documents"), ["source"], "text")


@query("g2_byte_count", "SELECT source, count(*) AS chunks, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def g2_byte_count(spark, sf):
    d = fx.table(spark, sf, "documents").select("source", F.octet_length("text").cast("long").alias("length"))
    return metrics.byte_count(d, ["source"])



DET = "det AS (SELECT vec_id // 10 AS chunk, vec_id // 2 AS frame, CASE label WHEN 0 THEN 'person' WHEN 1 THEN 'worker' ELSE 'thing' END AS class FROM embeddings)"
HUMANS = ["person", "worker"]


def _detections(spark, sf):
    v = F.col("vec_id")
    return fx.table(spark, sf, "embeddings").select(F.floor(v / 10).alias("chunk"), F.floor(v / 2).alias("frame"), F.when(F.col("label") == 0, "person").when(F.col("label") == 1, "worker").otherwise("thing").alias("class"))


@query("g4_k5_hits", f"WITH {DET}, f AS (SELECT chunk, frame, bool_or(class IN ('person','worker')) AS hit FROM det GROUP BY 1, 2), c AS (SELECT chunk, count(*) FILTER (hit) AS n FROM f GROUP BY 1) SELECT chunk, CAST(n AS VARCHAR) AS inference_result, CASE WHEN n = 0 THEN 't0' ELSE 't1' END AS target_id FROM c")
def g4_k5_hits(spark, sf):
    c = metrics.count_hits(_detections(spark, sf), HUMANS)
    return routing.route_by_tag(c, F.col("inference_result"), F.array(F.lit("t0"), F.lit("t1")))


@query("g5_detection_notes", f"WITH {DET} SELECT chunk, 'detection_' || frame AS tag, 'timestamp=' || frame || ',objects=' || count(*) || ',humans=' || count(*) FILTER (class IN ('person','worker')) AS note FROM det GROUP BY chunk, frame")
def g5_detection_notes(spark, sf):
    return metrics.detection_notes(_detections(spark, sf), HUMANS)


@query("g6_bucket_report", _with("SELECT system, count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes FROM named WHERE system IN ('KAFKA','PULSAR','PRAVEGA') GROUP BY 1", NAMED))
def g6_bucket_report(spark, sf):
    return catalog.bucket_report(fx.chunks(spark, sf))


@query("g7_ratio_report", "SELECT l_linenumber AS batch, l_returnflag AS location, CAST(l_linenumber * 10 AS INTEGER) AS rate, avg(l_linenumber * 10 * 6 * 60 * 1024 / l_extendedprice) AS ratio, avg(l_tax) AS p95 FROM lineitem GROUP BY 1, 2, 3")
def g7_ratio_report(spark, sf):
    r = fx.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("batch"), F.col("l_returnflag").alias("location"), (F.col("l_linenumber") * 10).alias("rate"), F.lit(5).alias("minutes"), F.lit(1024).alias("message_size"), F.col("l_extendedprice").alias("stored"), F.col("l_tax").alias("p95"))
    return metrics.ratio_report(r)


OPS = "ops AS (SELECT event_type AS op, event_id AS seq, ts, value AS size_bytes, (event_id % 997 + 1) / 100.0::DOUBLE AS latency_s FROM events)"


def _ops(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("event_type").alias("op"), F.col("event_id").alias("seq"), "ts", F.col("value").alias("size_bytes"), ((F.col("event_id") % 997 + 1) / F.lit(100.0)).alias("latency_s"))


@query("g8_op_metrics", f"WITH {OPS} SELECT op, count(*) AS n, arg_max(size_bytes, (ts, seq)) / 1e6 AS last_mb, sum(size_bytes) / 1048576 / sum(latency_s) AS mib_s, " + ", ".join(f"count(*) FILTER (latency_s <= {b}) AS le_{str(b).replace('.', '_')}" for b in metrics.BUCKETS) + " FROM ops GROUP BY 1")
def g8_op_metrics(spark, sf):
    return metrics.op_metrics(_ops(spark, sf))


@query("g9_latency_summary", f"WITH {OPS} SELECT op, min(latency_s) AS min, max(latency_s) AS max, avg(latency_s) AS avg, quantile_cont(latency_s, 0.5) AS p50, quantile_cont(latency_s, 0.9) AS p90, quantile_cont(latency_s, 0.95) AS p95, quantile_cont(latency_s, 0.99) AS p99 FROM ops GROUP BY 1")
def g9_latency_summary(spark, sf):
    return metrics.latency_summary(_ops(spark, sf), ["op"])


@query("g10_throughput", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 100) * 1024 / 1e6 WHEN 1 THEN (event_id % 100) * 1048576 / 1e6 WHEN 2 THEN (event_id % 100) * 1073741824 / 1e6 WHEN 3 THEN CAST(event_id % 100 AS DOUBLE) END AS mb_s FROM events")
def g10_throughput(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("KiB/s", "MiB/s", "GiB/s", "MB/s", "blocks/s")]), (F.col("event_id") % 5 + 1).cast("int"))
    return fx.table(spark, sf, "events").select("event_id", text.norm_throughput(F.concat((F.col("event_id") % 100).cast("string"), unit)).alias("mb_s"))


@query("g11_access_rate", "SELECT date_trunc('hour', ts) AS start, event_type AS op, count(*) AS n FROM events GROUP BY 1, 2")
def g11_access_rate(spark, sf):
    return metrics.access_rate(_ops(spark, sf))


@query("h1_running_words", f"SELECT doc_id, source, CAST(sum({WORDS}) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS words_so_far FROM documents")
def h1_running_words(spark, sf):
    return metrics.running_word_count(fx.table(spark, sf, "documents"), ["source"], "doc_id", "text").select("doc_id", "source", "words_so_far")


@query("h3_previous_value", "SELECT event_id, lag(value) OVER (PARTITION BY user_id % 10, event_type ORDER BY event_id) AS previous FROM events")
def h3_previous_value(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("stream", F.col("user_id") % 10)
    return metrics.previous_value(e, ["stream"], "event_type", "value", "event_id").select("event_id", "previous")


@query("h4_listing", _with("SELECT name, is_prefix, CASE WHEN NOT is_prefix THEN length END AS length, (SELECT count(*) FROM l) > 200 AS truncated FROM l ORDER BY name LIMIT 200", "l AS (SELECT CASE WHEN contains(key[2:], '/') THEN '/' || split_part(key[2:], '/', 1) || '/' ELSE key END AS name, contains(key[2:], '/') AS is_prefix, max(length) AS length FROM chunks WHERE starts_with(key, '/') GROUP BY 1, 2)"))
def h4_listing(spark, sf):
    return catalog.list_objects(fx.chunks(spark, sf), "/", "/", None, 200)


@query("h4_listing_page", _with("SELECT key AS name, false AS is_prefix, length, (SELECT count(*) FROM chunks WHERE key > 'en/src1/') > 50 AS truncated FROM chunks WHERE key > 'en/src1/' ORDER BY key LIMIT 50"))
def h4_listing_page(spark, sf):
    return catalog.list_objects(fx.chunks(spark, sf), marker="en/src1/", max_keys=50)


@query("h5_latest", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def h5_latest(spark, sf):
    return catalog.latest(fx.table(spark, sf, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


@query("i1_assemble", "SELECT conv_id AS upload, count(*) AS parts, CAST(sum(length(text)) AS BIGINT) AS size, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def i1_assemble(spark, sf):
    p = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("upload"), F.col("turn").alias("part"), F.lit(0).alias("seq"), F.coalesce("text", F.lit("")).alias("content"))
    return multipart.assemble(p, text=True).select("upload", "parts", "size", F.md5("content").alias("digest"))


@query("i2_validate_parts", "SELECT l_orderkey AS upload, l_linenumber AS part, CASE WHEN l_returnflag = 'R' THEN 'INVALID_PART' WHEN l_quantity < 10 AND l_linenumber < max(l_linenumber) OVER (PARTITION BY l_orderkey) THEN 'ENTITY_TOO_SMALL' ELSE 'OK' END AS status FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)")
def i2_validate_parts(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    li = li.repartition(multipart.tasks_for(li), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_quantity").alias("l_quantity"))
    sent = li.select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("part"), F.lit("e").alias("etag"), F.col("l_quantity").alias("size"))
    want = li.select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("part"), F.when(F.col("l_returnflag") == "R", "x").otherwise("e").alias("etag"))
    return multipart.validate_parts(sent, want, 10)


@query("i3_uploads", "SELECT l_orderkey AS upload, CASE WHEN bool_or(l_returnflag = 'R') THEN 'ABORTED' WHEN bool_or(l_linestatus = 'F') THEN 'COMPLETED' ELSE 'OPEN' END AS state, count(DISTINCT l_linenumber) AS parts, CASE WHEN NOT bool_or(l_returnflag = 'R') AND bool_or(l_linestatus = 'F') THEN sum(l_quantity) END AS bytes FROM lineitem GROUP BY 1")
def i3_uploads(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    ev = lambda op, d, n: d.select(F.col("l_orderkey").alias("upload"), (F.col("l_linenumber") + n).alias("seq"), F.lit(op).alias("op"), F.col("l_linenumber").alias("part"), F.col("l_quantity").alias("size"))
    e = ev("part", li, 0).unionByName(ev("abort", li.where("l_returnflag = 'R'"), 100)).unionByName(ev("complete", li.where("l_linestatus = 'F'"), 200))
    return multipart.uploads(e)


@query("a2_lines", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(p[i], '\\s+$', '') AS value FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))")
def a2_lines(spark, sf):
    return readers.read_lines(fx.table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("a3_blocks", "SELECT doc_id, CAST(i AS INTEGER) AS pos, md5(b[i * 512 + 1 : i * 512 + 512]) AS digest FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) // 512)) AS i FROM (SELECT doc_id, encode(text) AS b FROM documents))")
def a3_blocks(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return readers.read_blocks(d, 512).select("doc_id", "pos", F.md5("value").alias("digest"))


@query("a10_byte_range", "SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN b[3 : 8] WHEN 1 THEN b[11 : octet_length(b)] ELSE b[greatest(1, octet_length(b) - 499) : octet_length(b)] END) AS digest FROM (SELECT doc_id, encode(text) AS b FROM documents)")
def a10_byte_range(spark, sf):
    spec = F.element_at(F.array(F.lit("bytes=2-7"), F.lit("bytes=10-"), F.lit("bytes=-500")), (F.col("doc_id") % 3 + 1).cast("int"))
    return fx.table(spark, sf, "documents").select("doc_id", F.md5(text.byte_range(F.encode("text", "utf-8"), spec)).alias("digest"))


@query("a12_metadata", "SELECT 'policy' AS kind, CAST(event_id AS VARCHAR) AS id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE event_type IN ('click')")
def a12_metadata(spark, sf):
    e = fx.table(spark, sf, "events")
    kv = e.select(F.concat(F.when(F.col("event_type") == "click", "policy:").otherwise("other:"), F.col("event_id").cast("string")).alias("key"), F.col("props").alias("value"))
    return catalog.read_metadata(kv).select("kind", "id", F.col("doc")["k"].alias("k"))


@query("b3_publish", "SELECT source || '-' || lang AS topic, to_json({'doc_id': doc_id, 'text': coalesce(text, ''), 'lang': lang, 'source': source, 'n_chars': n_chars})::VARCHAR AS value FROM documents")
def b3_publish(spark, sf):
    from .pipeline import publish

    return publish(fx.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars", F.concat("source", F.lit("-"), "lang").alias("topic")))


@query("j4_plan_ranges", """WITH o AS (SELECT source AS key, doc_id, CAST(sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY source ORDER BY doc_id) - octet_length(encode(coalesce(text, ''))) AS BIGINT) AS start FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM o), r AS (SELECT key, pos // CAST(ceil(n / 4.0) AS BIGINT) AS range, min(start) AS start, count(*) AS members FROM n GROUP BY 1, 2)
SELECT *, lead(start) OVER (PARTITION BY key ORDER BY range) AS end FROM r""")
def j4_plan_ranges(spark, sf):
    """At most four ranges of each source, whose members are the documents' bytes one after the other."""
    from ..sources.indexed_gzip import ranges_of

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("block"), size.alias("size"), F.lit(1).alias("records"))
    m = metrics.running_sum(d, ["key"], ["block"], F.col("size"), "end")
    return ranges_of(m.select("key", "block", "records", (F.col("end") - F.col("size")).alias("start")), 4)


_RECORDS_SQL = """d AS (SELECT source AS key, doc_id, replace(coalesce(text, ''), chr(10), ' ') AS s FROM documents),
f AS (SELECT key, doc_id, s, CAST(row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS BIGINT) AS pos FROM d)"""


def _fastq_store(spark, sf, n):
    """A store with an object per source; a record of four lines is a whole document, its quality a line that starts with @."""
    from ..sources.files import new_folder
    from ..sources.indexed_gzip import write_indexed

    d = fx.table(spark, sf, "documents").select("doc_id", F.col("source").alias("key"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("s"))
    d = metrics.running_sum(d, ["key"], ["doc_id"], F.lit(1), "n")
    record = F.concat(F.lit("@r"), "doc_id", F.lit("\n"), "s", F.lit("\n+\n@"), "s", F.lit("\n"))
    path = new_folder(spark, "objects")
    return path, write_indexed(d.select("key", F.lit(1).alias("kind"), (F.col("n") - 1).alias("pos"), record.alias("value")), path, n)


@query("a9_scan_indexed", f"WITH {_RECORDS_SQL} SELECT key, pos, '@r' || doc_id AS header, md5(s) AS digest, CAST(octet_length(encode(s)) + 1 AS BIGINT) AS quality_bytes FROM f")
def a9_scan_indexed(spark, sf):
    """Documents as records in objects of indexed gzip, 50 a member, written and read back range by range."""
    from ..sources.indexed_gzip import scan_indexed

    path, _ = _fastq_store(spark, sf, 50)
    line = F.split(F.decode("value", "utf-8"), "\n")
    out = scan_indexed(spark, path, "fastq", range_bytes=256 << 10).select("key", "pos", line.alias("line"))
    return out.select("key", "pos", F.get("line", 0).alias("header"), F.md5(F.get("line", 1)).alias("digest"), F.octet_length(F.get("line", 3)).cast("long").alias("quality_bytes"))


_OBJECTS_SQL = """d AS (SELECT source || '/' || (doc_id // 64) AS key, doc_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') || '{"id":' || doc_id || ',"text":"' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', '_', 'g') || '"}' AS record FROM documents),
c AS (SELECT key, 'head' || string_agg(record, '' ORDER BY doc_id) || 'tail' AS content, count(*) AS n FROM d GROUP BY key)"""


@query("j2_index_json", f"WITH {_OBJECTS_SQL} SELECT key, CAST(n AS BIGINT) AS records, CAST((n + 9) // 10 AS BIGINT) AS indexed, CAST((n + 9) // 10 + 2 AS BIGINT) AS members, md5(content) AS digest FROM c")
def j2_index_json(spark, sf):
    """Chunks of prefixed JSON as indexed gzip, ten records a member, the index as a tag; and what restores from it."""
    from ..sources.files import new_folder
    from ..sources.indexed_gzip import INDEX_TAG, index_tags, restored, write_indexed

    text_ = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 .,]", "_")
    record = F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit('{"id":'), "doc_id", F.lit(',"text":"'), text_, F.lit('"}'))
    d = fx.table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.expr("doc_id div 64")).alias("key"), "doc_id", record.alias("record"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "record"))), lambda x: x["record"]), "")
    chunks = d.groupBy("key").agg(F.concat(F.lit("head"), joined, F.lit("tail")).alias("content"))
    path = new_folder(spark, "objects")
    pieces = readers.cut_json(chunks).select("key", "kind", F.col("number").alias("pos"), "value")
    members = write_indexed(pieces, path, 10)
    sums = members.groupBy("key").agg(F.sum("records").alias("records"), F.count("*").alias("members"))
    tags_ = index_tags(members).select("key", F.size(F.split(F.element_at("tags", INDEX_TAG), ",")).cast("long").alias("indexed"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", F.hex("content").alias("content")))), lambda x: x["content"]), "")  # a chunk of 64 documents
    whole = restored(spark, path).groupBy("key").agg(F.md5(F.unhex(parts)).alias("digest"))
    return sums.join(tags_, "key").join(whole, "key").select("key", "records", "indexed", "members", "digest")


@query("k2_normalise", "SELECT vec_id, list_transform(embedding, lambda x, i: (CAST(x AS DOUBLE) / 255.0 - CASE i % 3 WHEN 1 THEN 0.485 WHEN 2 THEN 0.456 ELSE 0.406 END) / CASE i % 3 WHEN 1 THEN 0.229 WHEN 2 THEN 0.224 ELSE 0.225 END) AS value FROM embeddings")
def k2_normalise(spark, sf):
    n = text.normalise(F.col("embedding"), [0.485, 0.456, 0.406], [0.229, 0.224, 0.225])
    return fx.table(spark, sf, "embeddings").select("vec_id", n.alias("value"))


# The tool labels of the classifier, in the order of its outputs.
TOOLS = ["Grasper", "Bipolar", "Hook", "Scissors", "Clipper", "Irrigator", "SpecimenBag"]


@query("k3_multi_label", f"SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 8), lambda i: 1 / (1 + exp(-CAST(embedding[i] AS DOUBLE))) >= 0.5), lambda i: {TOOLS}[i]), ',') AS labels FROM embeddings")
def k3_multi_label(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", text.multi_label(F.col("embedding"), TOOLS).alias("labels"))


@query("l3_state_keys", _with("SELECT doc_id, lower(p_scope || '/' || p_stream || '-count-total') AS shared, lower(p_scope || '/' || p_stream || '/' || p_partition || '-count-total') AS partitioned FROM named", NAMED))
def l3_state_keys(spark, sf):
    n = _named(spark, sf)
    return n.select("doc_id", *[text.state_key(s, F.col("partition_uri"), F.col("stream_uri"), "count", "total").alias(s) for s in ("shared", "partitioned")])


@query("l6_changes", "SELECT 'policy:' || user_id AS key, arg_max(props, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def l6_changes(spark, sf):
    e = fx.table(spark, sf, "events")
    feed = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("__keyspace@0__:policy:"), "user_id").alias("channel"), F.when(F.col("event_type") == "error", "del").otherwise("set").alias("op"), F.col("props").alias("value"))
    return catalog.apply_changes(spark.createDataFrame([], "key string, value string"), feed)


@query("l10_backlog", "SELECT event_id AS uri, CAST(user_id % 30 AS BIGINT) AS attempts, CAST(epoch(TIMESTAMP '2024-03-01') - CAST(floor(epoch(ts)) AS BIGINT) AS BIGINT) AS age_s, (epoch(TIMESTAMP '2024-03-01') - CAST(floor(epoch(ts)) AS BIGINT) > 3600 AND user_id % 30 % 10 = 0) AS warn FROM events")
def l10_backlog(spark, sf):
    p = fx.table(spark, sf, "events").select(F.col("event_id").alias("uri"), (F.col("user_id") % 30).alias("attempts"), F.floor(F.expr(_EPOCH_US) / 1e6).cast("long").alias("first_try"))
    return metrics.backlog(p, F.lit(1709251200))


@query("c19_j1_index_gzip", """WITH l AS (SELECT source AS key, doc_id, i, regexp_replace(p[i], '\\s+$', '') AS value FROM (SELECT source, doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS p FROM documents))),
n AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY doc_id, i) - 1) // 200 AS block FROM l)
SELECT key, CAST(block AS BIGINT) AS block, md5(string_agg(value || chr(10), '' ORDER BY doc_id, i)) AS digest FROM n GROUP BY 1, 2""")
def c19_j1_index_gzip(spark, sf):
    """Documents' lines of every source as indexed gzip, 200 lines a member, and what is in each member."""
    from ..operators import index_gzip

    m = index_gzip.gunzip_chunks(index_gzip.index_gzip(_lines(spark, sf), 200), "member")
    return m.select("key", "block", F.md5("member").alias("digest"))


def _lines(spark, sf):
    lines = readers.read_lines(fx.table(spark, sf, "documents").select(F.col("source").alias("key"), "doc_id", "text"), "text", keep_partial=True)
    return metrics.running_sum(lines, ["key"], ["doc_id", "pos"], F.lit(1), "n").select("key", (F.col("n") - 1).alias("pos"), F.concat("value", F.lit("\n")).alias("value"))


@query("g3_count_records", "SELECT source AS key, CAST(count(*) AS BIGINT) AS records FROM documents GROUP BY 1")
def g3_count_records(spark, sf):
    """Documents as records of four lines in indexed gzip, 100 a member, counted range by range."""
    from ..sources.indexed_gzip import scan_indexed

    path, _ = _fastq_store(spark, sf, 100)
    return scan_indexed(spark, path, "line").groupBy("key").agg(F.floor(F.count("*") / 4).alias("records"))


@query("h2_ordered_apply", "SELECT event_id, user_id, CAST(count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS clicks FROM events")
def h2_ordered_apply(spark, sf):
    from .pipeline import ordered_apply

    def step(clicks, row):
        clicks += row["event_type"] == "click"
        return clicks, (row["event_id"], row["user_id"], clicks)

    e = fx.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return ordered_apply(e, ["user_id"], ["event_id"], 0, step, "event_id bigint, user_id bigint, clicks bigint")


@query("k1_score", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * ((i - 1) % 7 - 3))), 6) + 0.0 AS score FROM embeddings")
def k1_score(spark, sf):
    """A fixed linear model over every vector, loaded once a task, a matrix product a batch."""
    from .pipeline import score

    def loader():
        import numpy as np

        def model(vectors):
            x = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.empty((0, 1))
            return x @ (np.arange(x.shape[1]) % 7 - 3.0)

        return model

    out = score(fx.table(spark, sf, "embeddings").select("vec_id", "embedding"), loader, "embedding")
    return out.select("vec_id", (F.round("score", 6) + 0.0).alias("score"))



@query("k8_cached_copies", "SELECT user_id AS key, max(event_id) AS seq, arg_max(props, event_id) AS content FROM events GROUP BY 1")
def k8_cached_copies(spark, sf):
    from .pipeline import update_cache

    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("content"))
    return update_cache(e.where("seq % 3 = 0"), e.where("seq % 3 > 0"))


@query("m3_source_function", f"WITH {LOC} SELECT c_custkey AS uri, CASE WHEN c_mktsegment = 'BUILDING' THEN 'replica' WHEN c_custkey % 4 = 0 THEN NULL ELSE coalesce(target_id, 'default') END AS served_by FROM customer LEFT JOIN loc ON uri = c_custkey")
def m3_source_function(spark, sf):
    """Reads served as usual, but for one segment by a function of the user's."""
    from .pipeline import source_step

    r = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("uri"), "c_mktsegment")
    r = routing.resolve_read(r, r.where("uri % 4 = 0"), _locations(spark, sf))
    step = source_step("replica", lambda df: F.when(F.col("c_mktsegment") == "BUILDING", "replica"))
    return step.get(r).select("uri", "served_by")


@query("m5_step_context", _with("SELECT doc_id, policy_id, p_scope || '/' || p_stream || '/' || p_partition AS partition_uri, CASE policy_id WHEN 'p1' THEN 't0=s3a://hot,t1=s3a://warm' WHEN 'p2' THEN 't1=s3a://warm' WHEN 'p3' THEN 't0=s3a://hot,t1=s3a://warm,t2=s3a://cold' WHEN 'p4' THEN 't2=s3a://cold' WHEN 'p5' THEN 't0=s3a://hot' END AS targets FROM resolved", NAMED, fx.STEPS_SQL, RESOLVED))
def m5_step_context(spark, sf):
    from .pipeline import with_context

    c = with_context(_named(spark, sf), fx.sample_policies(spark), fx.targets(spark)).select("doc_id", "context.*")
    return c.select("doc_id", "policy_id", "partition_uri", F.array_join(F.transform("targets", lambda t: F.concat(t["id"], F.lit("="), t["path"])), ",").alias("targets"))


@query("j6_run_policies", _with(f"SELECT doc_id, policy_id, CASE policy_id WHEN 'p1' THEN {WORDS.replace('text', 'content')} END AS words, CASE policy_id WHEN 'p1' THEN {PII} END AS pii, CASE policy_id WHEN 'p2' THEN CASE WHEN {PII} THEN 't0' ELSE 't1' END END AS target_id, CASE policy_id WHEN 'p3' THEN md5(content) END AS digest FROM resolved", NAMED, fx.STEPS_SQL, RESOLVED))
def j6_run_policies(spark, sf):
    """Every chunk through the steps of its policy: words counted, personal data found, routed, packed (and unpacked for the digest)."""
    from ..operators import index_gzip
    from .pipeline import register, run_policies

    register("count", lambda d: d.withColumn("words", text.words(F.col("content"))))
    register("detect", lambda d: d.withColumn("pii", text.any_pii(F.col("content"))))
    register("route", lambda d: routing.route_pii(d, "content", F.array(F.lit("t0"), F.lit("t1"))))
    register("pack", lambda d: index_gzip.gzip_chunks(d.withColumn("packed", F.encode("content", "utf-8")), "packed"))
    register("index"), register("score")
    out = index_gzip.gunzip_chunks(run_policies(_named(spark, sf), fx.sample_policies(spark), "EDGE"), "packed")
    return out.select("doc_id", "policy_id", F.col("words").cast("long").alias("words"), "pii", "target_id", F.md5("packed").alias("digest"))


@query("l1_l2_state", """SELECT event_id, CAST(row_number() OVER s AS BIGINT) AS shared_n, lag(user_id) OVER s AS shared_last, CAST(row_number() OVER p AS BIGINT) AS own_n
FROM events WINDOW s AS (PARTITION BY user_id % 10, event_type ORDER BY event_id), p AS (PARTITION BY user_id, event_type ORDER BY event_id)""")
def l1_l2_state(spark, sf):
    """A user's function over a stream of events, once with the state of its stream and once with that of its partition."""
    from ..sources.files import new_folder
    from ..streaming.state import run_available
    from ..streaming.stateful import state_session, stateful

    path, own = new_folder(spark, "stream"), state_session(spark)
    e = fx.table(spark, sf, "events").select(F.lit("events").alias("scope"), (F.col("user_id") % 10).cast("string").alias("stream"), F.col("user_id").cast("string").alias("partition"), F.col("event_type").alias("k"), F.col("event_id").alias("seq"))
    e.write.parquet(f"{path}/in")

    def count(state, r):
        last = state["last"].put(r.k, int(r.partition))
        state["n"].put(r.k, state["n"].get(r.k, 0) + 1)
        yield r.seq, state["n"].get(r.k), last

    def run(scope):
        stream = own.readStream.schema(e.schema).parquet(f"{path}/in")
        run_available(stateful(stream, count, "event_id long, n long, last long", {"n": "long", "last": "long"}, scope), f"{path}/{scope}", f"{path}/{scope}-checkpoint")
        return spark.read.schema("event_id long, n long, last long").parquet(f"{path}/{scope}")

    shared, mine = run("shared"), run("partitioned")
    shared = shared.select("event_id", F.col("n").alias("shared_n"), F.col("last").alias("shared_last"))
    return shared.join(mine.select("event_id", F.col("n").alias("own_n")), "event_id")


@query("m4_slices", """SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, md5(regexp_replace(p[i], '\\s+$', '')) AS digest FROM (
 SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))""")
def m4_slices(spark, sf):
    """Terminated lines of documents that come in slices of 700 bytes, cut wherever that falls, decoded slice by slice."""
    from ..sources.slices import Lines, read_apart, sliced

    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.encode("text", "utf-8").alias("content"))
    return read_apart(sliced(d, 700), Lines()).select(F.col("key").alias("doc_id"), "pos", F.md5("value").alias("digest"))


@query("a7_fastq_ranges", f"WITH {_RECORDS_SQL}, g AS (SELECT doc_id, s, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS id FROM f) SELECT id, 'r' || doc_id AS header, md5(s) AS sequence, md5('@' || s) AS quality FROM g")
def a7_fastq_ranges(spark, sf):
    """Documents as FASTQ files, read in ranges of 64 KiB that find their first record themselves, and numbered over all files."""
    from ..sources.fastq import read_fastq_files
    from ..sources.files import new_folder

    d = fx.table(spark, sf, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("s"))
    path = new_folder(spark, "fastq")
    record = F.concat(F.lit("@r"), "doc_id", F.lit("\n"), "s", F.lit("\n+\n@"), "s")
    d.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select(record.alias("value")).write.text(path)
    out = read_fastq_files(spark, path, 64 << 10)
    return out.select("id", "header", F.md5("sequence").alias("sequence"), F.md5("quality").alias("quality"))


@query("i1_assemble_files", "SELECT conv_id AS upload, CAST(count(*) AS BIGINT) AS parts, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS size, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS md5, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS sha256 FROM conversations GROUP BY 1")
def i1_assemble_files(spark, sf):
    """Turns as parts of an upload, sent twice in part, written to files by a manifest and read back from them."""
    from ..sources.files import new_folder

    p = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("upload"), F.col("turn").alias("part"), F.lit(2).alias("seq"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    first = p.where("part % 3 = 0").select("upload", "part", F.lit(1).alias("seq"), F.unhex(F.lit("00")).alias("content"))
    path = new_folder(spark, "uploads")
    return multipart.upload_digests(multipart.assemble_files(p.unionByName(first), path), path)


@query("c18_encrypt", "SELECT doc_id, source || '/' || doc_id || '.s3enc' AS stored_as, source || '/' || doc_id AS key, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) > 0 AS hidden FROM documents")
def c18_encrypt(spark, sf):
    """Documents encrypted and decrypted again; what was stored in between is other bytes under another name."""
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("key"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    secret = catalog.encryption_key("a password", b"a salt of 16 byte")
    e = catalog.encrypt(d.withColumn("plain", F.md5("content")).withColumn("size", F.octet_length("content").cast("long")), secret)
    e = e.withColumn("stored_as", F.col("key")).withColumn("hidden", (F.md5("content") != F.col("plain")) & (F.col("size") > 0))
    return catalog.decrypt(e, secret).select("doc_id", "stored_as", "key", "size", F.md5("content").alias("digest"), "hidden")


@query("g9_latency_sketch", f"WITH {OPS} SELECT op, count(*) AS n, min(latency_s) AS min, max(latency_s) AS max, avg(latency_s) AS avg, true AS p50, true AS p90, true AS p95, true AS p99 FROM ops GROUP BY 1")
def g9_latency_sketch(spark, sf):
    """Sketches of each hour, stored and added up; whether their percentiles' ranks are within a hundredth of what is asked."""
    from ..sources.files import kept, new_folder

    ops = _ops(spark, sf)
    hourly = kept(metrics.latency_sketch(ops.withColumn("hour", F.date_trunc("hour", "ts")), ["op", "hour"]), new_folder(spark, "sketches"))
    s = metrics.sketch_summary(metrics.merged_sketches(hourly, ["op"]), ["op"])
    quantiles = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    j = ops.select("op", "latency_s").join(F.broadcast(s), "op")  # a row an operation
    ranks = j.groupBy("op").agg(*[F.avg((F.col("latency_s") <= F.col(p)).cast("double")).alias(f"hi_{p}") for p in quantiles], *[F.avg((F.col("latency_s") < F.col(p)).cast("double")).alias(f"lo_{p}") for p in quantiles])
    near = [((F.col(f"lo_{p}") <= q + 0.01) & (F.col(f"hi_{p}") >= q - 0.01)).alias(p) for p, q in quantiles.items()]
    return s.select("op", "n", "min", "max", "avg").join(ranks, "op").select("op", "n", "min", "max", "avg", *near)


@query("b4_write_behind", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS attempts, md5(coalesce(text, '')) AS digest FROM documents")
def b4_write_behind(spark, sf):
    """Documents stored one by one in a store that refuses every seventh at first; what is stored in the end, and after how many tries."""
    from ..sources.files import Whole, kept, new_folder, read_named
    from ..streaming.stateful import TRIES, run_until_stored, state_session, write_behind

    path, own = new_folder(spark, "behind"), state_session(spark)
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("partition"), F.col("doc_id").cast("string").alias("uri"), F.col("doc_id").alias("seq"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    total = kept(d, f"{path}/in").count()
    shares = -(-total // 20_000)  # lanes and tasks grow with the documents

    def store(partition, uri, content, attempt):
        if int(uri) % 7 == 0 and attempt == 1:
            raise OSError("busy")
        out = Whole(f"{path}/store/{int(uri) % 1000}/{uri}.chunk")
        out.write(content)
        out.close()

    tries = write_behind(own.readStream.schema(d.schema).parquet(f"{path}/in"), store, retry_ms=1000, lanes=max(8, shares), numbered=True)
    run_until_stored(tries, f"{path}/tries", f"{path}/checkpoint", total)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shares)
    done = spark.read.schema(TRIES).parquet(f"{path}/tries").where("stored").repartition(tasks, "uri").groupBy("uri").agg(F.max("attempts").alias("attempts"))
    doc_id = F.col("uri").cast("long")
    files = read_named(done.select(doc_id.alias("doc_id"), "attempts", F.concat(F.pmod(doc_id, F.lit(1000)), F.lit("/"), "uri", F.lit(".chunk")).alias("name")), f"{path}/store")
    return files.select("doc_id", "attempts", F.md5("content").alias("digest"))
