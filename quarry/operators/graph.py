"""Traversal of edge tables for many roots at once: impact, neighbourhoods, clusters, lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialize
from .relational import first_by, is_call

MAX_DEPTH = 64


def walk(edges: DataFrame, roots: DataFrame, max_depth: int, start: str = "dst", end: str = "src", written: bool = False) -> DataFrame:
    """(root, id, depth): nodes that each root (a column of ``roots``) reaches, at their least depth; the root at 0.

    A frontier loop: each hop joins the last frontier only, and is written once. All roots share
    the hops, so their number is that of the deepest walk. Edges are written as they come, unless ``written`` says that they are
    read from files already; a hop drops what repeats, so they needn't be dealt out to be made distinct.
    """
    steps = edges.select(F.col(start).alias("at"), F.col(end).alias("next"))
    steps = steps if written else materialize(steps)
    seen = frontier = materialize(roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        hop = frontier.select("root", F.col("id").alias("at")).join(steps, "at").select("root", F.col("next").alias("id")).distinct()
        hop = materialize(hop.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if hop.isEmpty():
            break
        seen, frontier = seen.union(hop), hop
    return seen


def dependency_edges(edges: DataFrame) -> DataFrame:
    return edges.where(is_call(F.col("kind")) | (F.col("kind") == "import"))


def impact(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, id, depth) of everything that depends on a root, without the root."""
    return walk(dependency_edges(edges), roots, min(max(int(depth), 1), MAX_DEPTH)).where("depth > 0")


def impact_summary(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Per root: how many dependents within ``depth``, and whether more lie beyond."""
    depth = min(max(int(depth), 1), MAX_DEPTH)
    dep = materialize(dependency_edges(edges).select("src", "dst"))
    seen = materialize(walk(dep, roots, depth, written=True))
    rim = seen.where(F.col("depth") == depth).select("root", F.col("id").alias("dst"))
    beyond = rim.join(dep.select("src", "dst"), "dst").select("root", F.col("src").alias("id")).distinct().join(seen, ["root", "id"], "left_anti").select("root").distinct()
    counts = seen.groupBy("root").agg(F.count(F.when(F.col("depth") > 0, 1)).alias("dependents"), F.max("depth").alias("deepest"))
    return counts.join(beyond.withColumn("capped", F.lit(True)), "root", "left").withColumn("capped", F.coalesce("capped", F.lit(False)))


def subtree_sizes(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(root, id, subtree): for every member (root, id) of a radius, how many members reach it, itself excluded.

    All members that anything reaches walk together inside their radius (the root belongs to it); the others, mostly the many on its rim, are 0 without a walk.
    """
    m = members.select(F.concat_ws("\t", "root", "id").alias("key"), "root", "id")
    inside = dependency_edges(edges).join(m.select(F.col("root").alias("r"), F.col("id").alias("dst")), "dst").join(m.select(F.col("root").alias("r"), F.col("id").alias("src")), ["r", "src"])
    local = inside.select(F.concat_ws("\t", "r", "src").alias("src"), F.concat_ws("\t", "r", "dst").alias("dst"))
    local = materialize(local.distinct())
    reached = walk(local, local.select(F.col("dst").alias("root")).distinct(), MAX_DEPTH, written=True).where("depth > 0").groupBy(F.col("root").alias("key")).agg(F.count("*").alias("subtree"))
    return m.join(reached, "key", "left").select("root", "id", F.coalesce("subtree", F.lit(0)).cast("long").alias("subtree"))


def impact_preview(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Dependents with depth, via (call, import, call+import; direct ones only), call sites and subtree size."""
    edges = materialize(dependency_edges(edges).select("src", "dst", "kind", "weight"))
    seen = materialize(walk(edges, roots, depth, written=True))
    sizes = subtree_sizes(edges, seen.select("root", "id"))
    direct = edges.join(roots.select(F.col("root").alias("dst")).distinct(), "dst", "left_semi")
    direct = direct.select(F.col("dst").alias("root"), F.col("src").alias("id"), (F.col("kind") == "import").alias("imp"), "weight")
    direct = direct.groupBy("root", "id").agg(F.bool_or("imp").alias("i"), F.bool_or(~F.col("imp")).alias("c"), F.sum(F.when(~F.col("imp"), F.col("weight"))).alias("call_sites"))
    via = F.when(F.col("i") & F.col("c"), "call+import").when(F.col("c"), "call").when(F.col("i"), "import")
    return seen.where("depth > 0").join(direct, ["root", "id"], "left").join(sizes, ["root", "id"]).select("root", "id", "depth", via.alias("via"), F.coalesce("call_sites", F.lit(0)).alias("call_sites"), "subtree")


def neighbors(edges: DataFrame, roots: DataFrame, depth: int = 1, written: bool = False) -> DataFrame:
    """Undirected (root, id, depth), depth clamped to 0..5. The edges are written once and read in both directions."""
    e = edges.select("src", "dst") if written else materialize(edges.select("src", "dst"))
    return walk(e.union(e.select("dst", "src")), roots, min(max(int(depth), 0), 5), "src", "dst", written=True)


def neighbor_edges(static: DataFrame, trace: DataFrame) -> DataFrame:
    """One edge a pair: a static one (the first by kind) before a traced one; weights are not summed."""
    return _one_a_pair(_ranked(static, trace))


def _ranked(static: DataFrame, trace: DataFrame) -> DataFrame:
    return static.select("src", "dst", "kind", "weight", F.lit(0).alias("p")).union(trace.select("src", "dst", F.lit("trace_call"), "weight", F.lit(1)))


def _one_a_pair(ranked: DataFrame) -> DataFrame:
    return first_by(ranked, ["src", "dst"], [F.col("p"), F.col("kind")]).drop("p")


def cluster_modules(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directories as nodes (count) and the summed edges between different ones."""
    d = nodes.select("id", F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("module"))
    counts = d.groupBy("module").agg(F.count("*").alias("n"))
    e = edges.join(d.select(F.col("id").alias("src"), F.col("module").alias("a")), "src")
    e = e.groupBy("a", "dst").agg(F.sum("weight").alias("weight"))  # before the other end is looked up: a module and a node have one row
    e = e.join(d.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst")
    return counts, e.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))


def in_scope(column: str, scope: str):
    return (F.col(column) == scope) | F.col(column).startswith(scope + "/")


def scoped_edges(edges: DataFrame, scope: str) -> DataFrame:
    """Edges with both ends inside the scope."""
    return edges.where(in_scope("src", scope) & in_scope("dst", scope))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of (a, b) reaches; minima spread and are shortcut until nothing moves."""
    e = pairs.where("a <> b").select("a", "b")
    e = materialize(e.union(e.select(F.col("b"), F.col("a"))).distinct())
    label = materialize(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        spread = e.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = label.join(spread, "node").select("node", F.least("root", "m").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = materialize(step.join(jump, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        if step.join(label.withColumnRenamed("root", "old"), "node").where("root <> old").isEmpty():
            return step
        label = step


def plan_lanes(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, max_in_degree: int | None = None) -> DataFrame:
    """(seed, lane): seeds whose radii share a symbol or a file belong to one lane, named by its first seed.

    With ``max_in_degree`` hubs are walked through but couple nothing; a seed always counts.
    """
    radius = walk(dependency_edges(edges), seeds.select(F.col("seed").alias("root")), depth)
    if max_in_degree is not None:
        hubs = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > max_in_degree)
        radius = radius.join(hubs, "id", "left_anti").unionByName(radius.join(hubs, "id", "left_semi").where("root = id"))
    touched = radius.join(nodes.select("id", "file"), "id", "left")
    marks = touched.select("root", F.explode(F.array(F.concat(F.lit("s:"), "id"), F.concat(F.lit("f:"), "file"))).alias("mark")).where("mark is not null").distinct()
    lanes = components(marks.select(F.concat(F.lit("a:"), "root").alias("a"), F.concat(F.lit("m:"), "mark").alias("b")))
    out = lanes.where(F.col("node").startswith("a:"))
    return out.select(F.substring("node", 3, 1 << 20).alias("seed"), F.substring("root", 3, 1 << 20).alias("lane"))


def hub_nodes(edges: DataFrame, least: int) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")).where(F.col("in_degree") >= least)


#: The zoom from which all nodes show labels, and the most raw nodes drawn without clusters.
ZOOM_LABELS, MOST_RAW = 1.5, 2000


def level_of_detail(nodes: DataFrame, zoom: float, active: list[str]) -> DataFrame:
    """Tier of each node: 2 where it is hovered, focused or selected, 1 for all from a zoom on, else 0."""
    return nodes.withColumn("tier", F.when(F.col("id").isin(active), 2).when(F.lit(zoom >= ZOOM_LABELS), 1).otherwise(0))


def degraded(total_raw: int, level: str) -> bool:
    """Whether a view is answered by a prompt in place of a drawing."""
    return level == "function" and total_raw > MOST_RAW


def visible(nodes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Nodes inside a rectangle, its edges included."""
    return nodes.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def neighborhood(static: DataFrame, trace: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 1, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``depth`` of each root over static and traced edges; ends that no node names are of kind unknown.

    With ``scope`` only ids inside it stay, and edges with both ends there.
    """
    both = materialize(_ranked(static, trace))
    near = materialize(neighbors(both, roots, depth, written=True))
    if scope is not None:
        near = near.where(in_scope("id", scope))
    named = near.join(nodes.select("id", "name", "kind"), "id", "left").select("root", "id", "depth", F.coalesce("name", "id").alias("name"), F.coalesce("kind", F.lit("unknown")).alias("kind"))
    ends = near.select("root", "id")
    ids = ends.select("id").distinct()  # only edges inside some neighbourhood are dealt by their ends
    inside = both.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = _one_a_pair(inside)
    e = e.join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), ["root", "dst"]).select("root", "src", "dst", "kind", "weight")
    return named, e


def clustered(named: DataFrame, edges: DataFrame, files: DataFrame, threshold: int = 500) -> tuple[str, DataFrame, DataFrame]:
    """(level, nodes, edges) of one neighbourhood: its functions, or beyond ``threshold`` nodes its modules."""
    if named.limit(threshold + 1).count() <= threshold:
        return "function", named, edges
    counts, between = cluster_modules(named.select("id").distinct().join(files.select("id", "file"), "id"), edges)
    return "module", counts, between
