"""Object names of tiered chunks: system, scope, stream, partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The naming schemes of the three stream systems.
KAFKA = r"^([a-zA-Z0-9_-]+)/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_-]+\.(log|index))$"
KAFKA_DATA = r"^([a-zA-Z0-9_-]+)/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_-]+\.log)$"
PULSAR = r"^[a-zA-Z0-9]+-[a-zA-Z0-9]+-[a-zA-Z0-9]+-[a-zA-Z0-9]+-[a-zA-Z0-9]+-ledger-[0-9]+$"
PRAVEGA = r"^(/|_system/|/_system/)([^/]+)/([^/]+)/(.*)$"
DEFAULT = r"^([^/]+)/([^/]+)/([^/]+)$"


def system(key: Column) -> Column:
    """First scheme that the name follows, or null. Only names that start with ``/`` or ``_system/`` are Pravega's."""
    return (
        F.when(key.rlike(KAFKA), "KAFKA").when(key.rlike(PULSAR), "PULSAR")
        .when(key.rlike(PRAVEGA), "PRAVEGA").when(key.rlike(DEFAULT), "DEFAULT")
    )


def with_system(df: DataFrame, key: str = "key") -> DataFrame:
    return df.withColumn("system", system(F.col(key)))


def with_scope(df: DataFrame, key: str = "key", strip_topic_id: str = "first") -> DataFrame:
    """Scope and stream that policies refer to.

    A Kafka scope ends at its first ``-``; with ``strip_topic_id="suffix"`` only the
    trailing id is taken off, so that topics may hold ``-`` themselves.
    """
    k, s = F.col(key), system(F.col(key))
    topic = F.split(k, "/")[0]
    scope = F.regexp_replace(topic, "-[^-]{22}$", "") if strip_topic_id == "suffix" else F.split(topic, "-")[0]
    pravega = F.split(F.regexp_replace(k, "^/", ""), "/")
    return df.withColumn("scope", F.when(s == "KAFKA", scope).when(s == "PULSAR", "pulsar").when(s == "PRAVEGA", pravega[0]).when(s == "DEFAULT", topic)).withColumn(
        "stream", F.when(s.isin("KAFKA", "DEFAULT"), F.split(k, "/")[1]).when(s == "PULSAR", "pulsar").when(s == "PRAVEGA", pravega[1]))


def with_partition(df: DataFrame, key: str = "key") -> DataFrame:
    """Scope, stream and partition of the place a chunk belongs to; ``malformed`` where a system's data name is expected and not met."""
    k, s = F.col(key), system(F.col(key))
    group = lambda i: (
        F.when((s == "KAFKA") & k.rlike(KAFKA_DATA), F.regexp_extract(k, KAFKA_DATA, i))
        .when(s == "PULSAR", [F.lit("pulsar"), F.lit("0"), k][i - 1])
        .when(s == "PRAVEGA", F.regexp_extract(k, PRAVEGA, i + 1)).when(s == "DEFAULT", F.regexp_extract(k, DEFAULT, i))
    )
    return df.withColumns({"p_scope": group(1), "p_stream": group(2), "p_partition": group(3), "malformed": F.coalesce((s == "KAFKA") & ~k.rlike(KAFKA_DATA), F.lit(False))})


def with_uris(df: DataFrame) -> DataFrame:
    return df.withColumn("partition_uri", F.concat("p_scope", F.lit("/"), "p_stream", F.lit("/"), "p_partition")).withColumn("stream_uri", F.concat("p_scope", F.lit("/"), "p_stream"))


def forward_url(endpoint: Column, container: Column, key: Column, put: bool = True) -> Column:
    """Address of an object at another worker; blanks are ``%20`` in uploads only."""
    base = F.when(endpoint.startswith("http://") | endpoint.startswith("https://"), endpoint).otherwise(F.concat(F.lit("http://"), endpoint))
    path = F.replace(F.url_encode(key), F.lit("%2F"), F.lit("/"))
    path = F.replace(path, F.lit("+"), F.lit("%20")) if put else path
    return F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), F.url_encode(container), F.when(key.startswith("/"), "").otherwise("/"), path)


def rename(key: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule that finds a match rewrites all its matches."""
    out = key
    for pattern, to in reversed(rules):
        out = F.when(key.rlike(pattern), F.regexp_replace(key, pattern, to)).otherwise(out)
    return out
