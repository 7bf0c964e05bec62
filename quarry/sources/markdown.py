"""Nodes as markdown files: front matter, summary, observed neighbours; rendered and parsed by expressions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import materialize

PLACEHOLDER = "_Summary pending._"
#: Neighbours of a direction that a file lists at most; the rest is counted.
LISTED = 1000


def _quoted(value: Column) -> Column:
    return F.when(value.rlike(r"^[A-Za-z0-9_./\-]+$"), value).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))


def node_path(id_: Column) -> Column:
    """The file of a node: its id with everything but letters, digits, _ . - and / replaced."""
    return F.concat(F.regexp_replace(id_, r"[^A-Za-z0-9_.\-/]", "_"), F.lit(".md"))


def _listed(edges: DataFrame, key: str, other: str, out: str) -> DataFrame:
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col(other).alias("o"))))
    line = lambda x: F.concat(F.lit("- [["), x["o"], F.lit("]] ("), (-x["w"]).cast("string"), F.when(x["w"] == -1, " invocation)").otherwise(" invocations)"))
    listed = edges.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.slice(ranked, 1, LISTED).alias("of"))
    return listed.select("id", F.array_join(F.transform("of", line), "\n").alias(out))  # lines are spelled where they end up


def render_nodes(nodes: DataFrame, edges: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """(id, path, content) of every node; ``edges`` (src, dst, weight) are the observed ones, heaviest first."""
    front = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("id: "), _quoted(F.col("id"))),
        F.concat(F.lit("name: "), _quoted(F.col("name"))),
        F.concat(F.lit("qualified_name: "), _quoted(F.col("qualified_name"))),
        F.concat(F.lit("kind: "), "kind"),
        F.concat(F.lit("language: "), F.coalesce("language", F.lit("unknown"))),
        F.concat(F.lit("file: "), _quoted(F.coalesce("file", F.lit("")))),
        F.concat(F.lit("range: ["), F.col("range_start").cast("string"), F.lit(", "), F.col("range_end").cast("string"), F.lit("]")),
        F.concat(F.lit("ast_hash: blake3:"), F.coalesce("ast_hash", F.lit(""))),
        F.concat(F.lit("last_seen: "), F.date_format(F.timestamp_millis(F.coalesce("last_seen", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
        F.concat(F.lit("logical_clock: "), F.coalesce("logical_clock", F.lit(0)).cast("string")),
        F.lit("---"),
    )
    edges = materialize(edges.select("src", "dst", "weight"))
    n = nodes.join(_listed(edges, "dst", "src", "callers"), "id", "left").join(_listed(edges, "src", "dst", "callees"), "id", "left")
    body = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.trim("summary")).otherwise(placeholder)
    none = F.lit("_None observed yet._")
    content = F.concat_ws("\n", front, F.lit(""), F.concat(F.lit("# `"), "name", F.lit("`")), F.lit(""), body, F.lit(""), F.lit("## Observed callers (from traces)"), F.coalesce("callers", none), F.lit(""), F.lit("## Observed callees (from traces)"), F.coalesce("callees", none), F.lit(""))
    return n.select("id", node_path(F.col("id")).alias("path"), content.alias("content"))


def _steady(content: Column) -> Column:
    """The content without the one line that changes on every run."""
    return F.regexp_replace(content, r"(?m)^last_seen: .*$", "last_seen: -")


def changed_files(rendered: DataFrame, existing: DataFrame) -> DataFrame:
    """Rendered files (path, content) that are new or differ from the existing ones in more than when they were seen."""
    old = existing.select("path", F.sha2(_steady(F.col("content")), 256).alias("old"))
    r = rendered.withColumn("new", F.sha2(_steady(F.col("content")), 256)).join(old, "path", "left")
    return r.where(F.col("old").isNull() | (F.col("old") != F.col("new"))).drop("old", "new")


FIELDS = ["id", "name", "qualified_name", "kind", "language", "file", "range", "ast_hash", "logical_clock"]


def _text(content: str) -> Column:
    return F.when(F.col(content).startswith("\ufeff"), F.expr(f"substring({content}, 2)")).otherwise(F.col(content))


def _front(content: str) -> Column:
    return F.regexp_extract(_text(content), r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)


def _raw(front: str, name: str) -> Column:
    return F.trim(F.regexp_extract(front, rf"(?m)^{name}:(.*)$", 1))


def _plain(raw: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r'^"(.*)"$', "$1"), r'\\"', '"'), r"\\\\", r"\\")
    return F.when(raw.startswith('"'), plain).otherwise(raw)


def _field(front: str, name: str) -> Column:
    return _plain(_raw(front, name))


def orphans(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """Paths of existing files whose own id maps to them and is no longer among ``ids``; files of others are left alone."""
    own = existing.select("path", _front("content").alias("front")).select("path", _field("front", "id").alias("id")).where(node_path(F.col("id")) == F.col("path"))
    return own.join(ids.select("id").distinct(), "id", "left_anti").select("path")


def parse_nodes(files: DataFrame) -> DataFrame:
    """(path, id, name, qualified_name, kind, language, file, range_start, range_end, ast_hash, logical_clock, summary) of files (path, content).

    The summary is the body after the heading up to the first observed section; values may be quoted; a file without front matter has an empty id.
    """
    # The front is cut out once, and each raw value once: a column of several uses isn't merged into them.
    parts = files.select("path", _front("content").alias("front"), F.regexp_replace(_text("content"), r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "").alias("rest"))
    files, rest = parts.select("path", "rest", *[_raw("front", f).alias(f"raw_{f}") for f in FIELDS]), F.col("rest")

    def field(name: str) -> Column:
        return _plain(F.col(f"raw_{name}"))

    body = F.regexp_replace(rest, r"(?s)(?:^|\n)## Observed .*\z", "")
    body = F.trim(F.regexp_replace(body, r"(?s)\A\s*# [^\n]*", ""))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    number = lambda name, i: F.regexp_extract(field(name), r"\[\s*(\d+)\s*,\s*(\d+)\s*\]", i).try_cast("long")
    return files.select(
        "path",
        field("id").alias("id"),
        F.when(field("name") != "", field("name")).otherwise(F.regexp_extract(field("id"), r"([^/]*)$", 1)).alias("name"),
        field("qualified_name").alias("qualified_name"),
        field("kind").alias("kind"),
        F.when(field("language") != "", field("language")).otherwise("unknown").alias("language"),
        field("file").alias("file"),
        number("range", 1).alias("range_start"),
        number("range", 2).alias("range_end"),
        F.regexp_replace(field("ast_hash"), "^blake3:", "").alias("ast_hash"),
        F.coalesce(field("logical_clock").try_cast("long"), F.lit(0)).alias("logical_clock"),
        body.alias("summary"),
    )


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to the folder, content) of its markdown files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    return f.select(F.substring_index("path", root + "/", -1).alias("path"), F.decode("content", "UTF-8").alias("content"))


def write_files(rendered: DataFrame, folder: str) -> int:
    """Write rendered files into a shared folder, each whole or not at all, and return how many; writing one twice leaves it the same."""
    root = folder.removeprefix("file://")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                target = os.path.normpath(os.path.join(root, path))
                if not target.startswith(os.path.normpath(root) + os.sep):
                    continue  # an id that leads out of the folder
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target + ".part", "w", encoding="utf-8", newline="") as out:
                    out.write(content)
                os.replace(target + ".part", target)
            yield pd.DataFrame({"n": [len(f)]})

    return int(rendered.select("path", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
