"""Mixing sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix_sum import hash_key, with_running_sum
from .runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``sizes`` (source, source_size: one row a source) with rank, weight and target.

    Sources in code point order (null last) weigh ``weights`` in turn and share the sum of all
    sizes. A target stops at ``cap`` times its source's size and the excess goes to the others
    by weight until none is above: with sources in order of capacity for their weight those that
    stop come first, so one pass of running sums finds the level. Windows here run over one row
    per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    s = ranked.withColumn("weight", weight.cast("long")).withColumn("room", (F.col("source_size") * cap).cast("decimal(38,0)"))
    order = Window.orderBy(F.col("room").cast("double") / F.col("weight"), "rank")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (
        s.withColumn("left", F.sum("source_size").over(whole).cast("decimal(38,0)") - F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("left") * F.col("weight") >= F.col("room") * F.col("open"))
    )
    rest = F.when(~F.col("full"), F.struct(-F.col("open"), F.col("left").cast("double").alias("left"), F.col("open").alias("open")))
    s = s.withColumn("level", F.min(rest).over(whole))
    shared = F.col("level.left") * F.col("weight") / F.col("level.open")
    return s.select("source", "source_size", "rank", "weight", F.when(F.col("full"), F.col("room").cast("double")).otherwise(shared).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken; ``keep`` names further columns to carry.

    Documents get hash-random keys (md5 of ``seed`` and doc_id), so reruns agree. A source's
    budget is its target's whole words: full epochs over the source take every document as
    often, and the rest of the budget goes to documents in key order, the last of them in part,
    so that a source's ``taken`` sums to its budget exactly. No document exceeds ``cap`` times
    its size.

    Nulls: a null text has size 0, a null source is a source of its own (the last), a null
    doc_id has one key. Rows that repeat a doc_id are taken in order of size, then of a hash of the text. A source of size
    0 has target 0. Empty tables give no rows. Other columns are ignored.
    """
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), *keep)
    d = materialize(d.withColumn("key", hash_key(F.lit(seed), F.col("doc_id"))))
    plan = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    plan = plan.withColumnRenamed("source", "__source")
    d = d.join(F.broadcast(plan) if plan.count() <= 100_000 else plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "weight")
    d = materialize(d)
    d = with_running_sum(d, "rank", "key", F.col("size"), ["doc_id", "size"], "hash", "before")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return d.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the whole of ``documents`` mixed by the contract's weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1]::HUGEINT AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "left",
  sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
f AS (SELECT *, "left" * weight >= 3 * source_size * open AS is_full FROM o),
t AS (SELECT source, source_size, rank, CASE WHEN is_full THEN (3 * source_size)::DOUBLE
  ELSE (SELECT arg_max("left"::DOUBLE, open) FROM f WHERE NOT is_full) * weight::DOUBLE / (SELECT max(open)::DOUBLE FROM f WHERE NOT is_full) END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  coalesce(sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END * size
   + greatest(0, least(size, floor(target)::BIGINT - CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM r
"""
