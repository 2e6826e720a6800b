"""Tables of the shapes that tiered storage has, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.policy import policies

_MD5 = "md5(cast(doc_id as string))"
KEY = f"""CASE doc_id % 4
 WHEN 0 THEN concat(source, '-', substr({_MD5},1,22), '/', cast(doc_id % 5 AS string), '/', lpad(cast(doc_id AS string),20,'0'), '.log')
 WHEN 1 THEN concat(substr({_MD5},1,8), '-', substr({_MD5},9,4), '-', substr({_MD5},13,4), '-', substr({_MD5},17,4), '-', substr({_MD5},21,12), '-ledger-', cast(doc_id AS string))
 WHEN 2 THEN concat('/', lang, '/', source, '/', cast(doc_id % 3 AS string), '.#epoch.0.', cast(doc_id AS string))
 ELSE concat(lang, '/', source, '/', cast(doc_id AS string), '.txt') END"""
CHUNKS_SQL = "chunks AS (SELECT doc_id, 'tier' AS container, " + KEY.replace(" string)", " VARCHAR)") + " AS key, text AS content, n_chars AS length FROM documents)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.lit("tier").alias("container"), F.expr(KEY).alias("key"), F.col("text").alias("content"), F.col("n_chars").alias("length"))


def _step(pos, name, on="ALL", hw="NONE", local=False, transforms=False, routes=False, region="EDGE", args=()):
    return (pos, name, on, hw, local, transforms, routes, region, list(args))


def sample_policies(spark: SparkSession) -> DataFrame:
    """Four tiers of one resolution, and a stream without a policy."""
    return policies(spark, [
        ("p1", "KAFKA", "src1", "1", [_step(0, "count"), _step(1, "detect", hw="GPU", local=True, transforms=True), _step(2, "pack", region="CLOUD", transforms=True)], ["t0", "t1"]),
        ("p2", "KAFKA", "src1*", "*", [_step(0, "route", "PUT", routes=True)], ["t1"]),
        ("p3", "PRAVEGA", "en", "", [_step(0, "pack", transforms=True), _step(1, "score", region="CLOUD", hw="GPU")], ["t0", "t1", "t2"]),
        ("p4", "DEFAULT", "*", "", [_step(0, "index", "GET", args=["n=100", " Mode = Fast ", "flag"])], ["t2"]),
        ("p5", "PULSAR", "pulsar", "pulsar", [_step(0, "score", region="CLOUD")], ["t0"]),
    ])


STEPS_SQL = """pol(policy_id, system, scope, stream) AS (VALUES ('p1','KAFKA','src1','1'),('p2','KAFKA','src1*','*'),('p3','PRAVEGA','en',''),('p4','DEFAULT','*',''),('p5','PULSAR','pulsar','pulsar')),
steps(policy_id, pos, id, execute_on, hardware, local, transforms, routes, region) AS (VALUES
 ('p1',0,'count','ALL','NONE',false,false,false,'EDGE'),('p1',1,'detect','ALL','GPU',true,true,false,'EDGE'),('p1',2,'pack','ALL','NONE',false,true,false,'CLOUD'),
 ('p2',0,'route','PUT','NONE',false,false,true,'EDGE'),('p3',0,'pack','ALL','NONE',false,true,false,'EDGE'),('p3',1,'score','ALL','GPU',false,false,false,'CLOUD'),
 ('p4',0,'index','GET','NONE',false,false,false,'EDGE'),('p5',0,'score','ALL','NONE',false,false,false,'CLOUD'))"""


def workers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("edge-b:80", "EDGE", "NONE"), ("edge-a:80", "EDGE", "GPU"), ("cloud-a:80/", "CLOUD", "NONE")], "endpoint string, region string, hardware string")


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("t0", "s3a://hot"), ("t1", "s3a://warm"), ("t2", "s3a://cold")], "id string, path string")


NODES = ["node-a", "node-b", "node-c"]
