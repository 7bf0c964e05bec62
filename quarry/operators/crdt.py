"""Replicated state: last-writer-wins registers, grow-only and observed-remove sets, Merkle comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialize
from .relational import positions

BUCKET_S = 60
CLOCK = ["wall", "counter", "writer"]


def lww_current(ops: DataFrame, key: str = "entity") -> DataFrame:
    """The value of each key by the greatest (wall, counter, writer, content hash)."""
    rest = [c for c in ops.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*CLOCK, F.sha2("value", 256).alias("h"))).alias("r")
    return ops.groupBy(key).agg(best).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def lww_conflicts(ops: DataFrame, key: str = "entity") -> DataFrame:
    """Clock readings of a key that carry different contents."""
    return ops.groupBy(key, *CLOCK).agg(F.countDistinct(F.sha2("value", 256)).alias("versions")).where("versions > 1")


def dedup_ops(ops: DataFrame) -> DataFrame:
    return ops.dropDuplicates(CLOCK)


def gset_buckets(observations: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """Sums by (src, dst, 60 s bucket) and the number of observers."""
    bucket = (F.floor(F.col("ts") / bucket_s) * bucket_s).cast("long").alias("bucket")
    return observations.groupBy("src", "dst", bucket).agg(F.sum("observed").alias("observed"), F.sum("weight").alias("weight"), F.countDistinct("source").alias("observers"))


def orset_active(adds: DataFrame, removes: DataFrame, now: int | None = None) -> DataFrame:
    """The latest add of each claim whose tag no remove has observed; with ``now`` also not expired.

    ``adds`` has claim, tag, the clock, expires; ``removes`` has tags (array).
    """
    gone = removes.select(F.explode("tags").alias("tag")).distinct()
    alive = adds.join(gone, "tag", "left_anti")
    if now is not None:
        alive = alive.where(F.col("expires") > now)
    rest = [c for c in adds.columns if c != "claim"]
    best = F.max_by(F.struct(*[c for c in alive.columns if c != "claim"]), F.struct(*CLOCK)).alias("r")
    return alive.groupBy("claim").agg(best).select("claim", *[F.col(f"r.{c}").alias(c) for c in rest])


def merkle_leaves(ops: DataFrame, group: list[str], key: str) -> DataFrame:
    """One leaf a group: the hash of its distinct keys in order, after a zero byte.

    A group is a day's segment of one type; keys are hashed first so that a leaf holds 64
    characters a key.
    """
    keys = F.array_sort(F.collect_set(F.sha2(F.col(key).cast("string"), 256)))
    return ops.groupBy(*group).agg(F.sha2(F.concat(F.lit("00"), F.array_join(keys, "")), 256).alias("leaf"), F.countDistinct(key).alias("keys"))


def merkle_root(leaves: DataFrame) -> DataFrame:
    """One row: the root over all leaf hashes in order, paired as hash(01, least, greatest) level by level; an odd one is promoted. '' without leaves.

    Leaves are numbered by ranges, and each level is a join-free aggregate of half as many rows.
    """
    level = positions(leaves.select("leaf").where("leaf is not null"), [F.col("leaf")], "at").select("leaf", (F.col("at") - 1).alias("at"))
    n = level.count()
    while n > 1:
        pair = level.groupBy((F.col("at") / 2).cast("int").alias("at")).agg(F.min("leaf").alias("a"), F.max("leaf").alias("b"), F.count("*").alias("k"))
        level = materialize(pair.select(F.when(F.col("k") == 2, F.sha2(F.concat(F.lit("01"), "a", "b"), 256)).otherwise(F.col("a")).alias("leaf"), "at"))
        n = (n + 1) // 2
    return level.agg(F.coalesce(F.max("leaf"), F.lit("")).alias("root"))


def merkle_diff(local: DataFrame, remote: DataFrame, group: list[str]) -> DataFrame:
    """Groups to pull (missing here or different) and to push (only here)."""
    a = local.select(*group, F.col("leaf").alias("a"))
    b = remote.select(*group, F.col("leaf").alias("b"))
    action = F.when(F.col("b").isNull(), "push").when(F.col("a").isNull() | (F.col("a") != F.col("b")), "pull")
    return a.join(b, group, "full_outer").select(*group, action.alias("action")).where("action is not null")


def verify_contents(ops: DataFrame) -> DataFrame:
    return ops.withColumn("valid", F.sha2("value", 256) == F.col("content_hash"))


def segment_window(segments: DataFrame, now_day: str, ahead: int = 7) -> DataFrame:
    """Segments whose day is from 1970-01-01 to a week from now."""
    return segments.where((F.col("day") >= "1970-01-01") & (F.to_date("day") <= F.date_add(F.lit(now_day).cast("date"), ahead)))


def retention_report(segments: DataFrame, most_bytes: int, most_segments: int) -> DataFrame:
    """Per type: segments, bytes, first and last day, and which thresholds are passed."""
    r = segments.groupBy("type").agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    codes = F.concat_ws("|", F.when(F.col("bytes") > most_bytes, "bytes"), F.when(F.col("segments") > most_segments, "segments"))
    return r.withColumn("violations", codes)


def newest_peers(peers: DataFrame, cap: int = 64) -> DataFrame:
    """One row a writer, the last seen; the ``cap`` newest."""
    p = peers.groupBy("writer").agg(F.max("seen").alias("seen"))
    return p.orderBy(F.col("seen").desc(), "writer").limit(cap)


def clock_skew(ops: DataFrame, now_ms: int, most_ms: int = 86_400_000) -> DataFrame:
    """Operations whose wall clock is at most a day ahead."""
    return ops.where(F.col("wall") - now_ms <= most_ms)


def orset_merge(adds: list[DataFrame], removes: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union of replicas' adds, one a tag, and of their removed tags, one row each."""
    a, r = adds[0], removes[0].select(F.explode("tags").alias("tag"))
    for more in adds[1:]:
        a = a.unionByName(more)
    for more in removes[1:]:
        r = r.union(more.select(F.explode("tags").alias("tag")))
    return a.dropDuplicates(["tag"]), r.distinct()


def remove_ops(adds: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim, tags): the removal of each claim covers every tag of it that was seen, removed before or not."""
    return adds.join(claims.select("claim").distinct(), "claim").groupBy("claim").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def hydrate(lww: DataFrame, gset: DataFrame, adds: DataFrame, removes: DataFrame, now: int | None = None) -> dict[str, DataFrame]:
    """The states that a whole operation log gives, each operation counted once."""
    return {"lww": lww_current(lww), "gset": gset_buckets(dedup_ops(gset)), "orset": orset_active(adds.dropDuplicates(["tag"]), removes, now)}


class HybridClock:
    """A replica's clock: (wall ms, counter), never going back.

    ``tick`` follows the wall clock, else counts; a full counter moves on by a millisecond. ``observe`` adopts a remote
    reading that is ahead, unless it is more than a day ahead of the wall clock, which is refused.
    """

    COUNTER, SKEW_MS = 65_535, 86_400_000

    def __init__(self, now) -> None:
        self.now, self.wall, self.counter, self.refused = now, 0, 0, 0

    def tick(self) -> tuple[int, int]:
        wall = self.now()
        if wall > self.wall:
            self.wall, self.counter = wall, 0
        elif self.counter >= self.COUNTER:
            self.wall, self.counter = self.wall + 1, 0
        else:
            self.counter += 1
        return self.wall, self.counter

    def observe(self, wall: int, counter: int) -> bool:
        if wall > self.now() + self.SKEW_MS:
            self.refused += 1
            return False
        self.wall, self.counter = max((self.wall, self.counter), (wall, counter))
        return True
