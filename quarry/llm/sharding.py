"""Sharding by a k-d tree: weighted medians along the widest metadata dimension, native throughout."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix_sum import hash_key, with_running_sum
from .runtime import materialize

#: Coordinates: 24 bits of the dimension, then 24 bits of a text hash that break its ties.
BITS, RADIX = 48, 12
#: A group of equal texts stays whole up to this share of a leaf; larger ones are dealt row by row.
WHOLE = 4


def _node(splits: Sequence[tuple[int, int, int, int, int]], root: int = 0) -> Column:
    """The leaf of a row under ``splits`` (node, dimension, threshold, left, right): the tree as nested conditions."""
    for node, dim, threshold, left, right in splits:
        if node == root:
            return F.when(F.col(f"c{dim}") < threshold, _node(splits, left)).otherwise(_node(splits, right))
    return F.lit(root)


def _lookup(values: dict[int, int]) -> Column:
    """The value of the row's node; null for other nodes."""
    return F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in values.items() for x in kv]), F.col("node").cast("long"))


def _histogram(rows: DataFrame, shift: int, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, F.shiftright("x", shift).alias("b")).agg(F.sum("size").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def _cut(points: DataFrame, goals: dict[int, tuple[int, float, float]], first: dict[int, list[tuple[int, int]]]) -> dict[int, int]:
    """For each node (dimension, bytes to put left, bytes that it may miss by): the coordinate threshold that comes nearest.

    A radix search from the histogram of the first 12 bits: every pass sums bytes by the next 12 bits under the
    prefix found so far, until the bucket that holds the threshold is light enough. The
    driver sees at most 4096 sums a node however large the table is.
    """
    prefix, below, cuts = dict.fromkeys(goals, 0), dict.fromkeys(goals, 0), {}
    found, shift = first, BITS - RADIX
    while True:
        for node, sums in found.items():
            last = 0
            for b, s in sorted(sums):
                prefix[node], last = b, s
                if below[node] + s >= goals[node][1]:
                    break
                below[node] += s
            else:
                below[node] -= last
            if shift == 0 or last <= goals[node][2]:
                cuts[node] = (prefix[node] + (goals[node][1] - below[node] > last / 2)) << shift
        left = {n: g for n, g in goals.items() if n not in cuts}
        if not left:
            return cuts
        dim = _lookup({n: d for n, (d, _, _) in left.items()})
        x = F.element_at(F.array(*[c for c in points.columns if re.fullmatch(r"c\d+", c)]), (dim + 1).cast("int"))
        under = points.withColumn("x", x).where(F.shiftright("x", shift) == _lookup({n: prefix[n] for n in left}))
        shift -= RADIX
        found = {n: [] for n in left}
        for r in _histogram(under, shift, "node").collect():
            found[r["node"]].append((r["b"], r["s"]))


def kd_shards(points: DataFrame, shards: int, dims: int, tolerance: float = 0.002) -> list[tuple[int, int, int, int, int]]:
    """The splits that cut ``points`` (size and coordinates c0..) into ``shards`` leaves of near equal size.

    A level of the tree is one pass for the histograms of all dimensions, which also show the widest, and a pass or two
    that refine the chosen ones until a cut misses its goal by at most ``tolerance`` of a leaf, or can't come nearer.
    """
    splits: list[tuple[int, int, int, int, int]] = []
    open_nodes, free = {0: shards}, 1
    while open_nodes := {n: k for n, k in open_nodes.items() if k > 1}:
        p = points.withColumn("node", _node(splits)).where(F.col("node").isin(list(open_nodes)))
        each = p.select("node", "size", F.posexplode(F.array(*[f"c{d}" for d in range(dims)])).alias("d", "x"))
        seen: dict[int, list[list]] = {}
        for r in _histogram(each, BITS - RADIX, "node", "d").collect():
            seen.setdefault(r["node"], [[] for _ in range(dims)])[r["d"]].append(r)
        goals, first = {}, {}
        for n, by_dim in seen.items():
            k = open_nodes[n]
            total = sum(r["s"] for r in by_dim[0])
            wide = max(range(dims), key=lambda d: ((max(r["hi"] for r in by_dim[d]) >> 24) - (min(r["lo"] for r in by_dim[d]) >> 24), -d))
            goals[n] = (wide, total * (k // 2) / k, tolerance * total / k)
            first[n] = [(r["b"], r["s"]) for r in by_dim[wide]]
        cuts = _cut(p, goals, first)
        following = {}
        for n, cut in cuts.items():
            left, right, free = free, free + 1, free + 2
            splits.append((n, goals[n][0], cut, left, right))
            following |= {left: open_nodes[n] // 2, right: open_nodes[n] - open_nodes[n] // 2}
        open_nodes = following
    return splits


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Deal documents into shards of near equal bytes: doc_id, size, text_crc32, shard, slot.

    A document weighs its UTF-8 bytes plus 8. The dimensions are the logarithm of the size, the
    source and the language (of a group of equal texts: its least). Every node of the tree is cut
    at the weighted quantile of its widest dimension that gives both sides bytes for their
    numbers of leaves. Equal texts share all coordinates and so a shard, unless their bytes exceed
    a quarter of a leaf: such a group is dealt by doc_id. Slots are gapless from 0 in each shard.

    Nulls: a null text weighs 8 and counts as empty; null source, lang or doc_id are values of
    their own. Repeated rows are separate rows. With fewer rows than shards some shards stay
    empty; empty tables give no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce("source", F.lit("\0")).alias("source"),
        F.coalesce("lang", F.lit("\0")).alias("lang"),
    )
    d = materialize(d.withColumn("key", hash_key(F.lit("shard"), F.col("doc_id"))))
    total = d.agg(F.sum("size")).first()[0]
    if total is None:
        return d.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).where("false")
    groups = d.groupBy("h", "text_crc32").agg(F.sum("size").alias("bytes"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    q = lambda c: F.shiftright(F.crc32(c.cast("binary")), 8)
    d = d.drop("source", "lang").join(groups, ["h", "text_crc32"])
    tie = F.when(F.col("bytes") > total / shards / WHOLE, F.shiftright("key", 36)).otherwise(F.shiftright(F.xxhash64("h"), 40).bitwiseAND(F.lit((1 << 24) - 1)))
    coords = [F.floor(F.log2("size") * ((1 << 24) // 64)), q(F.col("source")), q(F.col("lang"))]
    points = materialize(d.select("doc_id", "size", "text_crc32", "key", "h", *[(F.shiftleft(c.cast("long"), 24) + tie).alias(f"c{i}") for i, c in enumerate(coords)]))
    splits = kd_shards(points, shards, len(coords))
    leaves = sorted({x for s in splits for x in s[3:]} - {s[0] for s in splits}) or [0]
    number = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(leaves) for x in (n, i)]), _node(splits))
    placed = points.withColumn("shard", number)
    out = with_running_sum(placed, "shard", "key", F.lit(1), ["doc_id", "size", "text_crc32"], "h", "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all of ``documents`` in shards 0 to 23 under the law ``bytes``."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
