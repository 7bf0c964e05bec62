"""Relational operators of the graph: folds, references, rollups, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialize


def is_call(kind: Column) -> Column:
    return (kind == "call") | kind.endswith("_call")


def fold_edges(raw: DataFrame) -> DataFrame:
    """Sum of occurrences (or of ``weight``) by (src, dst, kind)."""
    weight = F.sum("weight") if "weight" in raw.columns else F.count("*")
    return raw.groupBy("src", "dst", "kind").agg(weight.cast("long").alias("weight"))


def references(edges: DataFrame) -> DataFrame:
    """Callers and importers of every node: dst, src, via, weight."""
    return edges.where(is_call(F.col("kind")) | (F.col("kind") == "import")).select("dst", "src", F.when(F.col("kind") == "import", "import").otherwise("call").alias("via"), "weight")


def references_summary(edges: DataFrame) -> DataFrame:
    """Per node: callers and importers (edges) and sites (sum of weights)."""
    r = references(edges)
    n = lambda via: F.count(F.when(F.col("via") == via, 1))
    return r.groupBy("dst").agg(n("call").alias("callers"), n("import").alias("importers"), F.sum("weight").alias("sites"))


def trace_rollup(observations: DataFrame) -> DataFrame:
    return observations.groupBy("src", "dst").agg(F.sum("observed").alias("observed"), F.sum("weight").alias("weight"), F.count("*").alias("n"))


def trace_neighbors(observations: DataFrame) -> DataFrame:
    """Each endpoint with its counterparts, either direction."""
    out = observations.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "observed", "weight")
    out = out.union(observations.select("dst", "src", F.lit("in"), "observed", "weight"))
    return out.groupBy("node", "other", "direction").agg(F.sum("weight").alias("invocations"), F.sum("observed").alias("observed"), F.count("*").alias("n"))


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows overwrite; ``summary`` falls back to the old one, ``logical_clock`` never sinks."""
    o, n = old.alias("o"), new.alias("n")
    fresh = F.col(f"n.{key}").isNotNull()
    cols = []
    for c in old.columns:
        if c == key or c == "summary":
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c == "logical_clock":
            cols.append(F.greatest(f"n.{c}", f"o.{c}").alias(c))
        else:
            cols.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def upsert_edges(old: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Weights add up, or with ``replace`` the new ones stand."""
    if not replace:
        return fold_edges(old.unionByName(new))
    both = old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1)))
    return both.groupBy("src", "dst", "kind").agg(F.max_by("weight", "__g").alias("weight"))


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``files`` go with their outgoing edges; incoming edges survive."""
    gone = nodes.join(files, "file", "left_semi").select("id")
    return nodes.join(files, "file", "left_anti"), edges.join(gone, edges.src == gone.id, "left_anti")


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Added, deleted and modified keys between two snapshots."""
    o = old.select(F.col(key).alias("k"), F.col(digest).alias("a"))
    n = new.select(F.col(key).alias("k"), F.col(digest).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return o.join(n, "k", "full_outer").select(F.col("k").alias(key), change.alias("change")).where("change is not null")


def positions(rows: DataFrame, order: list, out: str = "position") -> DataFrame:
    """Number all rows from 1 in ``order`` (a total order) without gathering them: ranges are sorted apart, and their sizes summed.

    The window over sizes has one row a range. Ranges and rows are written once, so their numbers stay as they are.
    """
    s = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    s = materialize(s.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = s.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    numbered = s.join(F.broadcast(before), "__part")  # one row a partition
    return numbered.withColumn(out, (F.col("__before") + F.col("__at") + 1).cast("int")).drop("__part", "__at", "__before")
