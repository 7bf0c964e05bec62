"""Index maintenance: health, staleness, branches, notes, file scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fnv1a
from .relational import last_write, positions

#: Directories that file discovery skips.
SKIPPED = ["node_modules", "target", "dist", "build", ".venv", "venv", "__pycache__", "vendor"]
MAX_FILE = 8 << 20


def index_health(facts: DataFrame) -> DataFrame:
    """facts (ingesting, nodes, claims_nodes, readable) to a status."""
    emptied = (F.col("nodes") == 0) & (F.col("claims_nodes") > 0)
    s = F.when(~F.col("readable"), "unreadable").when(emptied, "empty-but-claims-content").when(F.col("ingesting"), "ingest-interrupted").otherwise("ok")
    return facts.withColumn("status", s)


def staleness(files: DataFrame, last_ingest: Column) -> DataFrame:
    f = files.agg(F.max("mtime").alias("newest"), F.count("*").alias("files"))
    return f.withColumn("stale", F.coalesce(F.col("newest") > last_ingest, F.lit(False)))


def newest_branches(branches: DataFrame, active: str, keep: int) -> DataFrame:
    """(key, mtime, kept): the active branch and the ``keep`` newest others stay."""
    r = F.row_number().over(Window.partitionBy(F.col("key") == active).orderBy(F.col("mtime").desc(), "key"))
    kept = branches.withColumn("kept", (F.col("key") == active) | (r <= keep))
    return positions(kept, [F.col("key") == active, F.col("mtime").desc(), F.col("key")])


def note_ids(notes: DataFrame, *columns: str) -> DataFrame:
    """Deterministic ids: two FNV-1a hashes, of different seeds and primes, over the NUL-joined fields."""
    joined = F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return notes.withColumn("note_id", F.concat(F.lit("mem_"), fnv1a(joined), fnv1a(joined, 0x01000193, 0x85EBCA6B)))


def record_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes after recording ``new`` (agent, node_id, kind, note, scope, created, ttl): the same fields at the same time are one note."""
    n = note_ids(new, "agent", "node_id", "kind", "note", "created").withColumnRenamed("note_id", "id").select(*old.columns)
    return old.join(n.select("id"), "id", "left_anti").unionByName(n.dropDuplicates(["id"]))


def list_notes(notes: DataFrame, now_ms: int, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Live notes, newest first, of one kind or all."""
    from .search import live

    n = notes.where(live(F.col("created"), F.col("ttl"), now_ms))
    n = n if kind is None else n.where(F.col("kind") == kind)
    return n.orderBy(F.col("created").desc(), "id").limit(max(0, limit))


def prune_notes(notes: DataFrame, now_ms: int) -> DataFrame:
    """Notes without the expired; those without a time to live stay."""
    from .search import live

    return notes.where(live(F.col("created"), F.col("ttl"), now_ms))


def forget_notes(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return notes.join(ids.select("id"), "id", "left_anti")


def watermark(prior: Column, count: Column, authoritative: Column) -> Column:
    """The node count that readers hold the index to: a whole rebuild sets it, any other run only raises it."""
    return F.when(authoritative, count).otherwise(F.greatest(F.coalesce(prior, F.lit(0)), count))


def record_rejections(nodes: DataFrame, old: DataFrame, new: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejections) after the files of ``verified`` (file) were checked: their old state is cleared, ``new`` recorded, by file and phase."""
    left = old.join(verified, "file", "left_anti").join(new.select("file", "phase").distinct(), ["file", "phase"], "left_anti")
    latest = last_write(new, ["file", "phase"], ["detected_at", "reason"]).select(*old.columns)
    bad = new.select("file").distinct().withColumn("__bad", F.lit(1))
    n = nodes.join(verified.select("file").distinct().withColumn("__seen", F.lit(1)), "file", "left").join(bad, "file", "left")
    flag = F.when(F.col("__bad") == 1, 1).when(F.col("__seen") == 1, 0).otherwise(F.col("merge_flagged"))
    return n.withColumn("merge_flagged", flag).select(*nodes.columns), left.unionByName(latest)


def list_rejections(rejections: DataFrame, limit: int = 200) -> DataFrame:
    return rejections.orderBy(F.col("detected_at").desc(), "file", "phase").limit(max(0, limit))


def needs_summary(nodes: DataFrame, placeholder: str, limit: int = 0) -> DataFrame:
    """Ids without a summary of their own, in order; all of them unless a limit is given."""
    n = nodes.where(F.col("summary").isNull() | F.col("summary").isin("", placeholder)).select("id").orderBy("id")
    return n.limit(limit) if limit > 0 else n


def set_stats(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """A key-value table after ``changes`` (key, value, seq): the last write of a key stands."""
    latest = last_write(changes, ["key"], ["seq"]).select("key", "value")
    return stats.join(latest.select("key"), "key", "left_anti").unionByName(latest)


def clear_graph(tables: dict[str, DataFrame], kept_stats: list[str]) -> dict[str, DataFrame]:
    """Tables before a rebuild: derived ones emptied; notes, claims, operations and the stats named in ``kept_stats`` stay."""
    derived = {"nodes", "edges", "call_sites", "merge_rejections"}
    out = {name: t.where("false") if name in derived else t for name, t in tables.items()}
    if "stats" in out:
        out["stats"] = out["stats"].where(F.col("key").isin(kept_stats))
    return out


def indexable_count(files: DataFrame, cap: int) -> DataFrame:
    """(files, capped): how many files are in scope, counted up to ``cap``."""
    n = files.where(in_file_scope(F.col("path"), F.col("size"))).limit(cap + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(cap)).alias("files"), (F.col("n") > cap).alias("capped"))


def accepted_files(asked: DataFrame, files: DataFrame, rules: list[str]) -> DataFrame:
    """(path, reason) of an explicit list: null where a file can be indexed, else why not."""
    known = files.select(F.col("path"), "size").dropDuplicates(["path"])
    outside = F.col("path").rlike(r"(^|/)\.\.(/|$)")
    reason = F.when(F.col("path").startswith("/"), "absolute").when(outside, "outside").when(F.col("size").isNull(), "missing").when(ignored(F.col("path"), rules), "ignored").when(F.col("size") > MAX_FILE, "too large")
    return asked.select("path").distinct().join(known, "path", "left").select("path", reason.alias("reason"))


def memory_for_node(notes: DataFrame, node: str) -> DataFrame:
    return notes.where((F.col("node_id") == node) | F.array_contains("scope", node))


def in_file_scope(path: Column, size: Column) -> Column:
    """Indexable: no hidden or skipped directory on the path, a known extension, not too large."""
    from ..functions.names import language

    skipped = F.exists(F.split(path, "/"), lambda p: p.isin(SKIPPED) | (p.startswith(".") & (F.length(p) > 1)))
    return ~skipped & language(path).isNotNull() & (size <= MAX_FILE)


def ignore_regex(pattern: str) -> str:
    """A gitignore-like rule as a regular expression over repository paths."""
    import re

    anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")[:-1]
    body = pattern.strip("/")
    out = ""
    i = 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last matching rule ignores the path (``!`` takes back)."""
    out = F.lit(False)
    for r in rules:
        negate = r.startswith("!")
        out = F.when(path.rlike(ignore_regex(r[1:] if negate else r)), F.lit(not negate)).otherwise(out)
    return out
