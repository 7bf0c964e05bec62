"""URL filters: rules on host suffixes and path prefixes, looked up by short hashes.

Every URL is expanded into the expressions that a rule could name: each label-aligned suffix
of its host times each prefix of its path that has the length of some rule's path. The
expressions equi-join the rules on 32 bits of SHA-256; a match counts only if the full
digests agree, and of a URL's matching rules the longest wins. Each distinct URL is expanded once, alone;
only the URLs that a rule fits join the pages again, by broadcast where they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

#: Tables of rules and of judged URLs up to this many bytes (counted, not estimated) are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


#: What follows the first ``://`` of the working column __url.
AFTER = "substring(__url, length(substring_index(__url, '://', 1)) + 4)"


def _host() -> Column:
    host = F.regexp_extract(F.expr(AFTER), r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.col("__url").contains("://"), lowered).otherwise("")


def _path() -> Column:
    return F.when(F.col("__url").contains("://"), F.regexp_extract(F.expr(AFTER), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row of ``pages``; adds host, path, rule and verdict to its columns.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the
    path starts with the rule's; the longest rule (host and path together, then host) wins;
    equal rules with different verdicts block. A URL that no rule fits gets ``default``.

    Nulls: a null URL or one without ``://`` has empty host and path, and a rule fits it only
    if it is empty too; rules with a null host or path never fit. Empty tables give empty
    results; repeated rows are judged each. Columns of ``pages`` named host, path, rule or
    verdict are replaced.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rules = (
        rules.where("host is not null and path is not null")
        .groupBy("host", "path")
        .agg(F.max(F.when(F.col("verdict") == "block", "block").otherwise(F.col("verdict"))).alias("verdict"))
        .select(
            F.concat("host", "path").alias("__rule"),
            (F.length("host") + F.length("path")).alias("__len"),
            F.length("host").alias("__hlen"),
            F.length("path").alias("__plen"),
            F.col("verdict").alias("__verdict"),
        )
        .withColumn("__digest", F.sha2(F.concat("__plen", F.lit(":"), "__rule"), 256))
        .withColumn("__short", F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long"))
    )
    facts = rules.agg(F.sum(F.length("__rule") + 120).alias("b"), F.collect_set("__plen").alias("l")).first()
    lengths = sorted(facts["l"])  # distinct path lengths: bounded by the longest rule path
    given = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    d = pages.select(given.alias("__url")).distinct().withColumn("host", _host()).withColumn("path", _path())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.struct(n.alias("n"), F.substring(F.col("path"), F.lit(1), n).alias("p")),
    )
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(p["n"].cast("string"), F.lit(":"), s, p["p"]))))
    e = d.select("__url", F.explode(expressions).alias("__e")).select("__url", F.sha2("__e", 256).alias("__d"))
    e = e.withColumn("__k", F.conv(F.substring("__d", 1, 8), 16, 10).cast("long"))
    right = F.broadcast(rules) if (facts["b"] or 0) <= BROADCAST_BYTES else rules
    hit = (F.col("__k") == F.col("__short")) & (F.col("__d") == F.col("__digest"))
    best = F.max(F.struct("__len", "__hlen", "__rule", "__verdict")).alias("__best")
    judged = materialize(e.join(right, hit).groupBy("__url").agg(best).select("__url", "__best.__rule", "__best.__verdict"))
    size = judged.agg(F.sum(F.octet_length("__url") + F.octet_length("__rule") + 32)).first()[0] or 0
    out = pages.select(*[F.col(f"`{c}`") for c in names], given.alias("__url")).withColumn("host", _host()).withColumn("path", _path())
    out = out.join(F.broadcast(judged) if size <= BROADCAST_BYTES else judged, "__url", "left")
    return out.select(*[F.col(f"`{c}`") for c in names], "host", "path", F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every url of ``pages`` against the five rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT page_id, row_number() OVER () AS n,
  CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, n,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
QUALIFY row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) = 1
"""
