"""Distributed running sums over hash-random keys: no task sees a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A range with this many times its share of rows, and so many at least, is hot.
HOT, HOT_LEAST = 8, 4096
#: Parts into which rows of one key and equal ties are dealt by the hash that spreads them.
DEAL = 1024


def with_running_sum(df: DataFrame, group: str, key: str, weight: Column, ties: list[str], spread: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of ``group`` (an int column) before this one by (``key``, ``ties``, ``spread``).

    ``key`` is uniform over [0, 2**60), so equal-width ranges of it hold equal shares of any
    group however large. Ranges are summed, the range sums are summed in order, and rows are
    summed only inside their range. A range is hot where one key repeats (null ids, say): its rows are
    dealt on by the key and ``ties`` (integral columns), and rows that agree in these, if they are many, by ``spread``
    (a hash of the row). Only rows that agree in all of it share a task. ``df`` should be
    materialised: it is read several times.
    """
    total = df.count()
    buckets = max(1, math.isqrt(total))  # as many ranges as rows a range, so neither side outgrows a task
    most = max(HOT_LEAST, HOT * buckets)
    fine = [f"__t{i}" for i in range(len(ties))]
    part = F.pmod(F.col(spread), F.lit(DEAL)).cast("int")
    d = df.withColumn("__b", F.floor(F.col(key) / F.lit(float(1 << 60)) * buckets).cast("long"))
    hot = d.groupBy(group, "__b").agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(group, "__b").collect()  # at most an eighth of the ranges
    if hot:
        d = d.join(F.broadcast(df.sparkSession.createDataFrame([(*r, True) for r in hot], f"{group} int, __b long, __hot boolean")), [group, "__b"], "left")
        least = F.lit(-(1 << 63)).cast("long")
        d = d.withColumn("__k", F.when(F.col("__hot"), F.col(key)).otherwise(least))
        for name, t in zip(fine, ties, strict=True):
            d = d.withColumn(name, F.coalesce(F.when(F.col("__hot"), F.col(t).cast("long")), least))
        many = d.where("__hot").groupBy(group, "__b", "__k", *fine).agg(F.count("*").alias("__n")).where(F.col("__n") > most).drop("__n").withColumn("__many", F.lit(True))
        d = d.join(F.broadcast(many), [group, "__b", "__k", *fine], "left")  # bounded like ``hot``
        d = d.withColumn("__p", F.when(F.col("__many"), part).otherwise(-1)).drop("__hot", "__many")
        ranges = ["__b", "__k", *fine, "__p"]
    else:
        ranges = ["__b"]
    sums = d.groupBy(group, *ranges).agg(F.sum(weight).alias("__s"))
    w = Window.partitionBy(group).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group), *ranges, F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(group, *ranges).orderBy(key, *ties, part, spread).rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.withColumn("__i", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, [group, *ranges])
        .withColumn(out, F.col("__o") + F.col("__i"))
        .drop(*ranges, "__i", "__o")
    )


def hash_key(*cols: Column) -> Column:
    """A uniform key in [0, 2**60): the first 15 hex digits of an md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])), 1, 15), 16, 10).cast("long")
