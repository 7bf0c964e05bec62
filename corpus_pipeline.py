"""The corpus pipeline: five stages over ``documents``, each one of the operators, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate as leaks
from quarry.llm import jaccard_join, mixing, quality, sharding
from quarry.llm.runtime import materialize
from quarry.session import ship


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` by place (c0, c1, ...), whatever its columns are called, with key: a 64-bit hash of them all, nulls told apart from values."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.withColumn("key", F.xxhash64(*[c for n in plain.columns for c in (F.col(n).isNull(), F.col(n))]))


def unkeyed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def place(docs: DataFrame, name: str) -> Column:
    return F.col(f"c{docs.columns.index(name)}").alias(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    ship(spark)
    return quality.classify(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep_columns=True)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of smallest doc_id, null ids last; then by a hash of the row.

    Rows are told apart by a 64-bit hash of all their columns, so a doc_id that is null or that
    different texts share decides nothing. Documents without words are in no group and all stay.
    """
    ship(spark)
    keyed = keyed_rows(docs)
    text = place(docs, "text")
    has_words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    grouped = keyed.where(has_words)
    groups = jaccard_join.ngram_jaccard_join(grouped.select(F.col("key").alias("doc_id"), text)).select(F.col("doc_id").alias("key"), "component_id").distinct()
    rows = grouped.select("key", place(docs, "doc_id")).distinct().join(groups, "key")
    stay = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key")).select("key")
    kept = grouped.join(stay, "key", "left_semi").dropDuplicates(["key"])
    return unkeyed(kept, docs).union(unkeyed(keyed.where(~has_words), docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole; the one in which a source's budget ends counts once more.

    Rows are told apart by a 64-bit hash of all their columns. Rows that agree in all of them are
    emitted as often as the mix takes them together. Documents without words are never taken.
    """
    ship(spark)
    keyed = keyed_rows(docs)
    named = keyed.select(place(docs, "doc_id"), place(docs, "source"), place(docs, "text"), "key")
    mixed = mixing.mix_sources(named.withColumnRenamed("key", "row"), keep=["row"]).where("taken > 0")
    times = mixed.groupBy(F.col("row").alias("key")).agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    rows = keyed.join(times, "key").dropDuplicates(["key"])
    return unkeyed(rows.withColumn("nth", F.explode(F.sequence(F.lit(1), "times"))), docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix."""
    ship(spark)
    return sharding.shard_documents(docs, 24)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: No SQL: the classifier's trees and the benchmark's hashing are not expressible; tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
