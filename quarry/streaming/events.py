"""Streams of observations and file changes; every function takes batch or streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UINT16 = 65_535


def valid_observation(rate: Column) -> Column:
    """Names present, counts in 16 bits, and weight within one of observed times the sample rate."""
    ok = (F.col("src") != "") & (F.col("dst") != "") & F.col("observed").between(0, UINT16) & F.col("weight").between(0, UINT16)
    return F.coalesce(ok & (F.abs(F.col("weight") - F.col("observed") * rate) <= 1), F.lit(False))


def accept_batches(rows: DataFrame, batch: str, rate: Column) -> DataFrame:
    """Per batch: rows and whether all of it is accepted; one bad row rejects the whole batch."""
    return rows.groupBy(batch).agg(F.count("*").alias("rows"), F.bool_and(valid_observation(rate)).alias("accepted"))


def tumbling(rows: DataFrame, ts: str = "ts", width: str = "60 seconds", watermark: str | None = None) -> DataFrame:
    """Sums by (src, dst, window start in epoch seconds). Late rows count unless a watermark is asked for."""
    r = rows.withColumn("__t", F.col(ts).cast("timestamp") if dict(rows.dtypes)[ts] != "bigint" else F.timestamp_seconds(ts))
    if watermark:
        r = r.withWatermark("__t", watermark)
    g = r.groupBy("src", "dst", F.window("__t", width).alias("w")).agg(F.sum("observed").alias("observed"), F.sum("weight").alias("weight"))
    return g.select("src", "dst", F.unix_seconds("w.start").alias("bucket"), "observed", "weight")


def dedup(rows: DataFrame, keys: list[str], ts: str | None = None, watermark: str | None = None) -> DataFrame:
    """First row a key; with a watermark state is bounded to it."""
    if watermark and ts:
        return rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def debounced(changes: DataFrame, quiet: str = "200 milliseconds") -> DataFrame:
    """Bursts of a file's changes (file, kind, at timestamp) end after a quiet spell: file, last kind, events, first and last ms."""
    g = changes.groupBy("file", F.session_window("at", quiet).alias("w")).agg(F.max_by("kind", F.struct("at", "kind")).alias("kind"), F.count("*").alias("events"), F.min("at").alias("a"), F.max("at").alias("b"))
    return g.select("file", "kind", "events", F.unix_millis("a").alias("first_ms"), F.unix_millis("b").alias("last_ms"))


def change_sets(changes: DataFrame, rebuild_over: int = 2000) -> DataFrame:
    """A batch as file, action: changed beats deleted; a rename deletes its origin; a large batch is one rebuild."""
    c = changes.select("file", F.when(F.col("kind") == "delete", "deleted").otherwise("changed").alias("action"))
    c = c.union(changes.where("kind = 'rename' and origin is not null").select("origin", F.lit("deleted")))
    c = c.groupBy("file").agg(F.min("action").alias("action"))
    n = c.agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(n)).select("file", F.when(F.col("n") > rebuild_over, "rebuild").otherwise(F.col("action")).alias("action"))


def rate_guard(starts: DataFrame, least_gap_s: int = 30, most_an_hour: int = 30) -> DataFrame:
    """Runs (key, ts seconds) that come too soon after the last, or after too many in the trailing hour.

    Runs are counted by second; a span of time is judged with the span before it, so a task holds two spans of a key, not the key. The count
    of the trailing hour is a running count less that of an hour before, which asks for itself as a row of its own: no window slides.
    """
    span = max(3600, int(least_gap_s))
    n = starts.groupBy("key", "ts").agg(F.count("*").alias("n"))
    at = F.floor(F.col("ts") / span)
    row = lambda bucket, t, n, real, own: F.struct(bucket.alias("bucket"), t.alias("t"), n.alias("n"), F.lit(real).alias("real"), F.lit(own).alias("own"))
    ts, none = F.col("ts"), F.lit(0).cast("long")
    rows = n.select("key", "ts", F.explode(F.array(row(at, ts, F.col("n"), 1, True), row(at + 1, ts, F.when(ts.isNotNull(), F.col("n")).otherwise(none), 1, False), row(at, ts - 3600, none, 0, True))).alias("r")).select("key", "ts", "r.*")
    w = Window.partitionBy("key", "bucket").orderBy("t", "real")
    rows = rows.withColumn("sum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("last", F.last(F.when(F.col("real") == 1, F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    seen = rows.where("own").groupBy(F.col("key").alias("__k"), F.col("ts").alias("__t")).agg(F.sum(F.when(F.col("real") == 1, F.col("sum")).otherwise(-F.col("sum"))).alias("__sum"), F.max(F.when(F.col("real") == 1, F.col("last"))).alias("__last"))
    nth = F.row_number().over(Window.partitionBy("key", "ts").orderBy(F.lit(1)))
    s = starts.withColumn("__nth", nth).join(seen, F.col("key").eqNullSafe(F.col("__k")) & F.col("ts").eqNullSafe(F.col("__t")))
    gap = F.col("ts") - F.when(F.col("__nth") == 1, F.col("__last")).otherwise(F.col("ts"))
    trailing = F.col("__sum") - 1
    verdict = F.when(gap < least_gap_s, "too-soon").when(trailing >= most_an_hour, "tripped").otherwise("run")
    return s.select(*starts.columns, trailing.alias("trailing"), verdict.alias("verdict"))


def log_windows(rows: DataFrame, window_ms: int = 60_000, most: int = 5) -> DataFrame:
    """Repeated log lines: a key's window opens with its first record; five are emitted, the rest counted.

    Rows (key, at ms) to (key, opened, emitted, suppressed). Records are first counted by key and time; a key's windows are then found one by
    one in its sorted times, by bisection, so a step is a window, not a record, and a batch is held at once.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, opened, n = None, 0, 0
        for b in batches:
            out = []
            keys, at, count = b["key"].to_numpy(), b["at"].to_numpy(), b["n"].to_numpy().cumsum()
            cut = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1), len(keys)] if len(keys) else [0]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if keys[lo] != key:
                    if key is not None:
                        out.append((key, opened, min(n, most), max(0, n - most)))
                    key, opened, n = keys[lo], int(at[lo]), 0
                while lo < hi:
                    end = lo + int(at[lo:hi].searchsorted(opened + window_ms))
                    n += int(count[end - 1] - (count[lo - 1] if lo else 0)) if end > lo else 0
                    if end < hi:
                        out.append((key, opened, min(n, most), max(0, n - most)))
                        opened, n = int(at[end]), 0
                    lo = end
            yield pd.DataFrame(out, columns=["key", "opened", "emitted", "suppressed"])
        if key is not None:
            yield pd.DataFrame([(key, opened, min(n, most), max(0, n - most))], columns=["key", "opened", "emitted", "suppressed"])

    counted = rows.where("key is not null and at is not null").groupBy("key", "at").agg(F.count("*").alias("n"))
    return counted.repartition("key").sortWithinPartitions("key", "at").mapInPandas(fold, "key string, opened long, emitted long, suppressed long")


def stalls(beats: DataFrame, most_ms: int = 60_000) -> DataFrame:
    """Gaps between heartbeats of a source longer than a minute."""
    w = Window.partitionBy("source").orderBy("at")
    return beats.withColumn("gap", F.col("at") - F.lag("at").over(w)).where(F.col("gap") > most_ms)
