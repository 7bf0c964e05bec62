"""Call edges and coverage from sampled stacks and profile trees."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import materialize
from .relational import positions

CAP = 65_535


def stack_edges(stacks: DataFrame, cap: int = CAP) -> DataFrame:
    """Leaf-first stacks to (src, dst, weight): each frame's caller is the next; blanks and self-calls skipped."""
    frames = F.filter("stack", lambda f: F.trim(f) != "")
    s = stacks.select(F.posexplode(F.arrays_zip(F.slice(frames, 1, F.greatest(F.size(frames) - 1, F.lit(0))).alias("dst"), F.slice(frames, 2, F.greatest(F.size(frames) - 1, F.lit(0))).alias("src"))).alias("p", "e"), "count")
    return s.where("e.src <> e.dst").groupBy(F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.least(F.sum("count"), F.lit(cap)).cast("long").alias("weight"))


def stack_coverage(stacks: DataFrame, test: str = "^Test[A-Z0-9_]", cap: int = CAP) -> DataFrame:
    """The outermost test frame covers every other frame of its stack."""
    s = stacks.withColumn("tests", F.filter("stack", lambda f: F.regexp_extract(f, r"([^.]*)$", 1).rlike(test)))
    s = s.where(F.size("tests") > 0).withColumn("test", F.element_at("tests", -1))
    e = s.select("test", F.explode(F.array_distinct("stack")).alias("entity"), "count").where("entity <> test and trim(entity) <> ''")
    return e.groupBy("test", "entity").agg(F.least(F.sum("count"), F.lit(cap)).cast("long").alias("weight"))


#: Levels that a tree can have; deeper nodes, and those on a cycle, count for nothing.
LEVELS = 10
#: Where frames come from that are not the page's own.
FOREIGN = ["chrome-extension://", "chrome://", "devtools://", "node:", "extensions::"]


def keep_frame(function: Column, url: Column, prefixes: list[str] | None = None) -> Column:
    """Whether a sampled frame is the project's: no parenthesised pseudo frame, and under a prefix, or with none given from a page."""
    f, u = F.coalesce(function, F.lit("")), F.coalesce(url, F.lit(""))
    pseudo = (u == "") & f.startswith("(") & f.endswith(")")
    start = lambda options: reduce(lambda a, b: a | b, [u.startswith(p) for p in options], F.lit(False))
    return ~pseudo & (start(prefixes) if prefixes else (u != "") & ~start(FOREIGN))


def frame_name(function: Column, url: Column, line: Column) -> Column:
    """module:function; the module is the script's base name without query and ending, an anonymous function goes by its line."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"([^/]*)$", 1)
    module = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    name = F.when(F.coalesce(function, F.lit("")) != "", function).otherwise(F.concat(F.lit("(anonymous):"), F.coalesce(line, F.lit(0))))
    return F.when(module != "", F.concat(module, F.lit(":"), name)).otherwise(name)


def runtime_frame(symbol: Column) -> Column:
    """Whether a Go symbol is the runtime's or the standard library's: the first part of its package path names no host."""
    first = F.when(symbol.contains("/"), F.substring_index(symbol, "/", 1)).otherwise(F.substring_index(symbol, ".", 1))
    return ~first.contains(".")


def _climb(nodes: DataFrame, state: list[str], step: Callable) -> DataFrame:
    """Pointer doubling: after round k each node's ``up`` is its ancestor 2**k levels above. ``step`` merges a round's joined columns."""
    t = materialize(nodes)
    for _ in range(LEVELS):
        t = materialize(step(t))
        if t.where("up is not null").isEmpty():
            break
    return t.select("id", "up", *state)


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(id, total): hits of each node of the trees (id, parent, hits) and all below it, in as many rounds as the logarithm of their depth."""

    def step(t: DataFrame) -> DataFrame:
        below = t.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("below"))
        above = t.select(F.col("id").alias("up"), F.col("up").alias("next"))
        j = t.join(below, "id", "left").join(above, "up", "left")
        return j.select("id", F.col("next").alias("up"), (F.col("total") + F.coalesce("below", F.lit(0))).alias("total"))

    start = nodes.select("id", F.col("parent").alias("up"), F.col("hits").cast("long").alias("total"))
    return _climb(start, ["total"], step).where("up is null").select("id", "total")


def nearest_above(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """(id, above): for each node of the trees (id, parent) the nearest ancestor, itself not, that ``named`` (id) holds; null if none does."""

    def step(t: DataFrame) -> DataFrame:
        above = t.select(F.col("id").alias("up"), F.col("above").alias("far"), F.col("up").alias("next"))
        j = t.join(above, "up", "left")
        found = F.col("above").isNotNull()
        return j.select("id", F.when(~found, F.col("next")).alias("up"), F.coalesce("above", "far").alias("above"))

    marks = named.select(F.col("id").alias("parent"), F.col("id").alias("above")).distinct()
    start = nodes.select("id", "parent").join(marks, "parent", "left").select("id", F.when(F.col("above").isNull(), F.col("parent")).alias("up"), "above")
    return _climb(start, ["above"], step).select("id", "above")


def tree_edges(nodes: DataFrame, cap: int = CAP) -> DataFrame:
    """Profile trees (id, parent, function or null, hits) to call edges weighted by inclusive hits.

    A node without a name is transparent: its children belong to the nearest named ancestor.
    """
    inclusive = subtree_totals(nodes)
    named = nodes.where("function is not null").select("id", "function")
    nearest = nearest_above(nodes, named).join(named.select(F.col("id").alias("above"), F.col("function").alias("caller")), "above").select("id", "caller")
    e = named.withColumnRenamed("function", "callee").join(nearest, "id").join(inclusive, "id").where("caller <> callee and total > 0")
    return e.groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.least(F.sum("total"), F.lit(cap)).cast("long").alias("weight"))


def tree_coverage(nodes: DataFrame, cap: int = CAP) -> DataFrame:
    """(entity, weight): per name the hits of its nodes' subtrees; names without a hit are not covered."""
    n = nodes.where("function is not null").select("id", "function").join(subtree_totals(nodes), "id").where("total > 0")
    return n.groupBy(F.col("function").alias("entity")).agg(F.least(F.sum("total"), F.lit(cap)).cast("long").alias("weight"))


def is_runtime_test(node: Column) -> Column:
    """A root test by the name of a Python frame (module:qualified name): test_* or test, and not defined inside a function."""
    qual = F.regexp_extract(node, r"([^:]*)$", 1)
    last = F.regexp_extract(qual, r"([^.]*)$", 1)
    return ~qual.contains("<locals>") & (last.startswith("test_") | (last == "test"))


def call_coverage(calls: DataFrame) -> DataFrame:
    """(test, entity, weight) of call events (id, parent: the caller's event, node): each call inside a test covers callee and caller.

    The test is the innermost one on the stack. Coverage is never sampled.
    """
    tests = calls.where(is_runtime_test(F.col("node"))).select("id")
    context = nearest_above(calls, tests)
    c = calls.join(context, "id").withColumn("ctx", F.when(is_runtime_test(F.col("node")), F.col("id")).otherwise(F.col("above"))).where("ctx is not null")
    names = calls.select(F.col("id").alias("ctx"), F.col("node").alias("test"))
    c = c.join(names, "ctx").join(calls.select(F.col("id").alias("parent"), F.col("node").alias("src")), "parent", "left")
    rows = c.select("test", F.col("node").alias("entity")).union(c.where("src is not null and src <> test").select("test", "src"))
    return rows.groupBy("test", "entity").agg(F.count("*").alias("weight"))


def sampled_edges(calls: DataFrame, rate: int) -> DataFrame:
    """(src, dst, observed, weight) of every ``rate``-th call in the order of ``id``; a call without a caller comes from <entry>."""
    numbered = positions(calls, [F.col("id")], "nth").where(F.col("nth") % rate == 0)
    e = numbered.join(calls.select(F.col("id").alias("parent"), F.col("node").alias("src")), "parent", "left")
    e = e.groupBy(F.coalesce("src", F.lit("<entry>")).alias("src"), F.col("node").alias("dst")).agg(F.count("*").alias("observed"))
    return e.withColumn("weight", F.col("observed") * rate)


def collector_flush(calls: DataFrame, seconds: int, rate: int = 1) -> DataFrame:
    """(src, dst, kind, ts, observed, weight): calls (src, dst, kind, ts) folded between flushes and stamped with the flush."""
    flush = (F.floor(F.col("ts") / seconds) * seconds + seconds).cast("long")
    f = calls.groupBy("src", "dst", "kind", flush.alias("ts")).agg(F.count("*").alias("observed"))
    return f.withColumn("weight", F.col("observed") * rate)


def coverage_flush(cells: DataFrame) -> DataFrame:
    return cells.groupBy("test", "entity").agg(F.count("*").alias("weight"))
