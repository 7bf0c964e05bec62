"""Repositories as tables: explicit file lists, snapshots and their differences, change events, observation batches, generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SCHEMA = "source string, sample_rate int, observations array<struct<src:string,dst:string,ts:bigint,observed:bigint,weight:bigint>>, test_coverage array<struct<test:string,entity:string,weight:bigint>>"
CHANGE_SCHEMA = "file string, kind string, origin string, ts_ms long"


def observation_batches(bodies: DataFrame, column: str = "body") -> DataFrame:
    """JSON bodies as columns source, sample_rate, observations, test_coverage; a body that is no such object gives nulls. Batch or streaming."""
    return bodies.select("*", F.from_json(column, BATCH_SCHEMA, {"mode": "PERMISSIVE"}).alias("__b")).select(*bodies.columns, "__b.*")


def observations_of(batches: DataFrame) -> DataFrame:
    """One row an observation, each with its batch's source and rate (1 where none is given)."""
    b = batches.select("source", F.coalesce("sample_rate", F.lit(1)).alias("rate"), F.explode("observations").alias("o"))
    return b.select("o.src", "o.dst", "o.ts", "o.observed", "o.weight", "source", "rate")


def coverage_of(batches: DataFrame) -> DataFrame:
    """Coverage rows (test, entity, source, weight), summed by key."""
    c = batches.select("source", F.explode("test_coverage").alias("c"))
    return c.groupBy(F.col("c.test").alias("test"), F.col("c.entity").alias("entity"), "source").agg(F.sum("c.weight").alias("weight"))


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """File changes as a stream: JSON lines of file, kind (create, modify, delete, rename, overflow), origin of a rename, time."""
    return spark.readStream.schema(CHANGE_SCHEMA).json(folder)


def watch_events(changes: DataFrame, heartbeat_ms: int = 15_000, now_ms: int | None = None) -> DataFrame:
    """(file, kind, origin, ts_ms) as a watcher tells them: renames keep their origin, unknown kinds count as overflow; with ``now_ms`` a heartbeat if all was quiet."""
    known = F.col("kind").isin("create", "modify", "delete", "rename")
    c = changes.select("file", F.when(known, F.col("kind")).otherwise("overflow").alias("kind"), F.when(F.col("kind") == "rename", F.col("origin")).alias("origin"), "ts_ms")
    if now_ms is None:
        return c
    quiet = c.agg(F.max("ts_ms").alias("last")).where(F.coalesce(F.lit(now_ms) - F.col("last") >= heartbeat_ms, F.lit(True)))
    return c.unionByName(quiet.select(F.lit(None).cast("string").alias("file"), F.lit("heartbeat").alias("kind"), F.lit(None).cast("string").alias("origin"), F.lit(now_ms).cast("long").alias("ts_ms")))


def changed_since(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file, state) between two snapshots (file, hash; ``now`` also tracked): changed, deleted, or untracked."""
    j = before.select("file", F.col("hash").alias("old")).join(now.select("file", F.col("hash").alias("new"), "tracked"), "file", "full_outer")
    state = F.when(F.col("new").isNull(), "deleted").when(~F.col("tracked"), "untracked").when(F.col("old").isNull() | (F.col("old") != F.col("new")), "changed")
    return j.select("file", state.alias("state")).where("state is not null")


def replay(spill: DataFrame, after: int, page: int) -> DataFrame:
    """A page of a spilled ingest: the next ``page`` records (seq, …) after a sequence number, in order."""
    return spill.where(F.col("seq") > after).orderBy("seq").limit(page)


def notification(batch: DataFrame) -> DataFrame:
    """(batch, line): one line a batch of changes (batch, file, action), its files in order, twenty named and the rest counted."""
    g = batch.groupBy("batch").agg(F.sort_array(F.collect_set(F.concat(F.col("action"), F.lit(" "), F.col("file")))).alias("f"))
    rest = F.size("f") - 20
    more = F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise("")
    return g.select("batch", F.concat(F.array_join(F.slice("f", 1, 20), ", "), more).alias("line"))


def live_ops(ops: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, type, key): operations (type, key, writer) sent on to every subscriber (subscriber, writer, types) but their own writer; no types: all."""
    s = subscriptions.select("subscriber", F.col("writer").alias("own"), F.explode(F.when(F.size("types") > 0, F.col("types")).otherwise(F.array(*[F.lit(t) for t in ("gset", "lww", "orset")]))).alias("type"))
    return ops.join(F.broadcast(s), "type").where("writer <> own").select("subscriber", "type", "key").distinct()


def _pick(seed: str, *parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


#: Languages of generated files, with a function and an import in each.
GENERATED = {
    "py": ("def {f}(x):\n    return {g}(x) + {n}\n", "from {m} import {g}\n"),
    "ts": ("export function {f}(x: number) {{ return {g}(x) + {n}; }}\n", 'import {{ {g} }} from "./{m}";\n'),
    "js": ("export function {f}(x) {{ return {g}(x) + {n}; }}\n", 'import {{ {g} }} from "./{m}.js";\n'),
    "rs": ("pub fn {f}(x: i64) -> i64 {{ {g}(x) + {n} }}\n", "use crate::{m}::{g};\n"),
    "go": ("func {f}(x int) int {{ return {g}(x) + {n} }}\n", "// uses {m}.{g}\n"),
}


def synthetic_repo(spark: SparkSession, files: int, functions: int = 4, seed: str = "repo") -> DataFrame:
    """(file, text) of a generated repository: five languages in turn, each file importing a peer of its language."""
    kinds = list(GENERATED)
    d = spark.range(files).withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % len(kinds) + 1).cast("int")))
    per = F.greatest(F.lit((files + len(kinds) - 1) // len(kinds)), F.lit(1))
    peer = (_pick(seed, F.col("id")) % per) * len(kinds) + F.col("id") % len(kinds)
    d = d.withColumn("peer", F.when(peer < files, peer).otherwise(F.col("id") % len(kinds)))
    out = F.lit("")
    for kind, (body, head) in GENERATED.items():
        fill = lambda t, f, g, m, n: F.concat(*[x for part in _cut(t) for x in ([F.lit(part)] if not part.startswith("\0") else [{"f": f, "g": g, "m": m, "n": n}[part[1:]]])])
        name = lambda of, i: F.concat(F.lit("f"), of.cast("string"), F.lit("_"), i.cast("string"))
        module = F.concat(F.lit("m"), F.col("peer").cast("string"))
        g = name(F.col("peer"), F.lit(0))
        lines = F.transform(F.sequence(F.lit(0), F.lit(functions - 1)), lambda i: fill(body, name(F.col("id"), i), g, module, (_pick(seed, F.col("id"), i) % 1000).cast("string")))  # noqa: B023
        out = F.when(F.col("kind") == kind, F.concat(fill(head, g, g, module, F.lit("0")), F.array_join(lines, "\n"))).otherwise(out)
    return d.select(F.concat(F.lit("src/m"), F.col("id").cast("string"), F.lit("."), "kind").alias("file"), out.alias("text"))


def _cut(template: str) -> list[str]:
    """A template's literal parts, and its fields marked by a NUL."""
    import string

    out = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            out.append(literal)
        if field:
            out.append("\0" + field)
    return out
