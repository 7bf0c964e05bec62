"""Registered queries on stored state: notes, rejections, stats, operation logs, replicas, collectors, repositories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import crdt, maintain, profiles, relational
from ..sources import derived as d
from ..sources import oplog, repo
from . import registry
from .state_queries import _NOTES, _notes, _orset

QUERIES, SQL, register = registry.new()
NOW = 1_706_000_000_000


# Notes, rejections, stats


@register("note_ids")
def note_ids(spark, sf):
    n = d.table(spark, sf, "events").select(F.concat(F.lit("a"), "user_id").alias("agent"), F.col("event_type").alias("kind"), F.col("props").alias("note"), F.col("event_id").alias("created"))
    return maintain.note_ids(n, "agent", "kind", "note", "created")


@register("note_listing", f"WITH {_NOTES} SELECT id, created FROM notes WHERE ttl IS NULL OR created + ttl * 1000 >= {NOW} ORDER BY created DESC, id LIMIT 100")
def note_listing(spark, sf):
    return maintain.list_notes(_notes(spark, sf), NOW).select("id", "created")


@register("note_pruning", f"WITH {_NOTES} SELECT count(*) AS kept, count(*) FILTER (WHERE id % 7 <> 0) AS after_forget FROM notes WHERE ttl IS NULL OR created + ttl * 1000 >= {NOW}")
def note_pruning(spark, sf):
    kept = maintain.prune_notes(_notes(spark, sf), NOW)
    left = maintain.forget_notes(kept, kept.where("id % 7 = 0"))
    return kept.agg(F.count("*").alias("kept")).crossJoin(left.agg(F.count("*").alias("after_forget")))  # one row each


_REJ = "old AS (SELECT 'f' || (event_id % 90) AS file, CASE WHEN event_id % 2 = 0 THEN 'syntax' ELSE 'type' END AS phase, max(event_id) AS detected_at FROM events WHERE event_type = 'view' GROUP BY ALL), new AS (SELECT 'f' || (event_id % 70) AS file, 'type' AS phase, max(event_id) + 1000000 AS detected_at FROM events WHERE event_type = 'error' GROUP BY ALL)"


def _rejections(spark, sf):
    e = d.table(spark, sf, "events")
    k = F.col("event_id")
    row = lambda x, file, phase, at: x.select(file.alias("file"), phase.alias("phase"), F.lit("python").alias("language"), F.lit("why").alias("reason"), at.alias("detected_at"))
    old = row(e.where("event_type = 'view'"), F.concat(F.lit("f"), k % 90), F.when(k % 2 == 0, "syntax").otherwise("type"), k)
    old = relational.last_write(old, ["file", "phase"], ["detected_at"]).select("file", "phase", "language", "reason", "detected_at")
    new = row(e.where("event_type = 'error'"), F.concat(F.lit("f"), k % 70), F.lit("type"), k + 1_000_000)
    nodes = e.select(k.alias("id"), F.concat(F.lit("f"), k % 100).alias("file"), F.lit(1).alias("merge_flagged"))
    verified = e.where("event_id % 2 = 0").select(F.concat(F.lit("f"), k % 80).alias("file")).distinct()
    return maintain.record_rejections(nodes, old, new, verified)


@register("merge_rejections", f"WITH {_REJ}, v AS (SELECT DISTINCT 'f' || (event_id % 80) AS file FROM events WHERE event_id % 2 = 0), x AS (SELECT * FROM old WHERE file NOT IN (SELECT file FROM v) AND (file, phase) NOT IN (SELECT (file, phase) FROM new) UNION ALL SELECT * FROM new) SELECT file, phase, detected_at FROM x ORDER BY detected_at DESC, file, phase LIMIT 200")
def merge_rejections(spark, sf):
    return maintain.list_rejections(_rejections(spark, sf)[1]).select("file", "phase", "detected_at")


@register("merge_flags", f"WITH {_REJ}, v AS (SELECT DISTINCT 'f' || (event_id % 80) AS file FROM events WHERE event_id % 2 = 0), n AS (SELECT 'f' || (event_id % 100) AS file FROM events) SELECT CASE WHEN file IN (SELECT file FROM new) THEN 1 WHEN file IN (SELECT file FROM v) THEN 0 ELSE 1 END AS merge_flagged, count(*) AS n FROM n GROUP BY 1")
def merge_flags(spark, sf):
    return _rejections(spark, sf)[0].groupBy("merge_flagged").agg(F.count("*").alias("n"))


@register("node_watermarks", "SELECT o_orderkey AS run, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE greatest(coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END, 0), o_custkey) END AS mark FROM orders")
def node_watermarks(spark, sf):
    o, k = d.table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(k.alias("run"), maintain.watermark(F.when(k % 5 > 0, k), F.col("o_custkey"), k % 3 == 0).alias("mark"))


@register("stats_table", "WITH s AS (SELECT DISTINCT 'k' || (event_id % 50) AS key, 'old' AS value FROM events), c AS (SELECT event_type AS key, 'v' || event_id AS value, event_id AS seq FROM events UNION ALL SELECT 'k' || (event_id % 20), 'w' || event_id, event_id FROM events) SELECT key, value FROM s WHERE key NOT IN (SELECT key FROM c) UNION ALL SELECT key, arg_max(value, seq) FROM c GROUP BY key")
def stats_table(spark, sf):
    e, k = d.table(spark, sf, "events"), F.col("event_id")
    stats = e.select(F.concat(F.lit("k"), k % 50).alias("key"), F.lit("old").alias("value")).distinct()
    changes = e.select(F.col("event_type").alias("key"), F.concat(F.lit("v"), k).alias("value"), k.alias("seq")).union(e.select(F.concat(F.lit("k"), k % 20), F.concat(F.lit("w"), k), k))
    return maintain.set_stats(stats, changes)


@register("cleared_tables", f"WITH {d.NODES}, {_NOTES} SELECT 'nodes' AS name, 0::BIGINT AS rows UNION ALL SELECT 'notes', count(*) FROM notes UNION ALL SELECT 'stats', 1")
def cleared_tables(spark, sf):
    stats = spark.createDataFrame([("last_ingest_nodes", "9"), ("last_ingest_at", "7")], "key string, value string")
    t = maintain.clear_graph({"nodes": d.nodes(spark, sf), "notes": _notes(spark, sf), "stats": stats}, ["last_ingest_nodes"])
    out = [x.agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, x in t.items()]
    return out[0].union(out[1]).union(out[2])


@register("index_states", "SELECT o_orderkey AS run, CASE WHEN o_orderkey % 7 = 0 THEN 'unreadable' WHEN o_orderkey % 2 = 0 AND o_custkey % 3 > 0 THEN 'empty-but-claims-content' WHEN o_orderkey % 5 = 0 THEN 'ingest-interrupted' ELSE 'ok' END AS status FROM orders")
def index_states(spark, sf):
    k = F.col("o_orderkey")
    f = d.table(spark, sf, "orders").select(k.alias("run"), (k % 5 == 0).alias("ingesting"), (k % 2).alias("nodes"), (F.col("o_custkey") % 3).alias("claims_nodes"), (k % 7 != 0).alias("readable"))
    return maintain.index_health(f).select("run", "status")


@register("stale_index", "SELECT max(epoch_us(ts) // 1000) AS newest, count(*) AS files, max(epoch_us(ts) // 1000) > 1706000000000 AS stale FROM events")
def stale_index(spark, sf):
    return maintain.staleness(d.table(spark, sf, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("mtime")), F.lit(NOW))


@register("needs_summary", f"WITH {d.NODES} SELECT id FROM nodes WHERE key % 3 <> 2")
def needs_summary(spark, sf):
    n = d.nodes(spark, sf)
    return maintain.needs_summary(n.withColumn("summary", F.when(F.col("key") % 3 == 0, "").when(F.col("key") % 3 == 1, "_pending_").otherwise("done")), "_pending_")


_PATHS = "(['src/a{k}.py', 'node_modules/x{k}.js', '.git/y{k}.py', 'docs/z{k}.md', '/abs{k}.ts', '../up{k}.go', 'gen/b{k}.ts', 'c{k}.rs', 'gen/keep{k}.ts'])"


def _paths(spark, sf):
    k = F.col("o_orderkey")
    forms = ["src/a{k}.py", "node_modules/x{k}.js", ".git/y{k}.py", "docs/z{k}.md", "/abs{k}.ts", "../up{k}.go", "gen/b{k}.ts", "c{k}.rs", "gen/keep{k}.ts"]
    return d.table(spark, sf, "orders").select(F.replace(F.element_at(F.array(*[F.lit(f) for f in forms]), (k % 9 + 1).cast("int")), F.lit("{k}"), k.cast("string")).alias("path"), (k * 30_000).alias("size"), k.alias("k"))


_P = f"p AS (SELECT replace({_PATHS}[o_orderkey % 9 + 1], '{{k}}', o_orderkey::VARCHAR) AS path, o_orderkey * 30000 AS size, o_orderkey AS k FROM orders)"


@register("files_in_scope", f"WITH {_P} SELECT path FROM p WHERE NOT regexp_matches(path, '(^|/)(node_modules|\\.git)/') AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)') AND regexp_matches(path, '\\.(py|js|ts|go|rs)$') AND size <= 8388608")
def files_in_scope(spark, sf):
    return _paths(spark, sf).where(maintain.in_file_scope(F.col("path"), F.col("size"))).select("path")


@register("indexable_files", f"WITH {_P}, n AS (SELECT count(*) AS n FROM p WHERE NOT regexp_matches(path, '(^|/)(node_modules|\\.git)/') AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)') AND regexp_matches(path, '\\.(py|js|ts|go|rs)$') AND size <= 8388608) SELECT least(n, 100) AS files, n > 100 AS capped FROM n")
def indexable_files(spark, sf):
    return maintain.indexable_count(_paths(spark, sf), 100)


@register("accepted_files", f"WITH {_P} SELECT path, CASE WHEN path LIKE '/%' THEN 'absolute' WHEN path LIKE '../%' THEN 'outside' WHEN k % 4 = 0 THEN 'missing' WHEN path LIKE 'gen/%' AND path NOT LIKE 'gen/keep%' THEN 'ignored' WHEN size > 8388608 THEN 'too large' END AS reason FROM p")
def accepted_files(spark, sf):
    p = _paths(spark, sf)
    return maintain.accepted_files(p, p.where("k % 4 <> 0"), ["gen/*", "!gen/keep*"])


@register("file_languages", f"WITH {_P} SELECT regexp_extract(path, '\\.([a-z]+)$', 1) AS ext, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END AS language, count(*) AS n FROM p GROUP BY ALL")
def file_languages(spark, sf):
    p = _paths(spark, sf)
    return p.groupBy(names.extension(F.col("path")).alias("ext"), names.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@register("replaced_edges", f"WITH {d.EDGES}, n AS (SELECT src, dst, kind, weight + 5 AS weight FROM edges WHERE kind = 'import') SELECT e.src, e.dst, e.kind, coalesce(n.weight, e.weight) AS weight FROM edges e LEFT JOIN n USING (src, dst, kind)")
def replaced_edges(spark, sf):
    e = d.edges(spark, sf)
    return relational.upsert_edges(e, e.where("kind = 'import'").withColumn("weight", F.col("weight") + 5), replace=True)


@register("observations_last_write", "SELECT 'u' || user_id AS src, event_type AS dst, epoch_us(ts) // 60000000 AS ts, arg_max(floor(value)::BIGINT, event_id) AS weight FROM events GROUP BY ALL")
def observations_last_write(spark, sf):
    e = d.table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).cast("long").alias("ts"), F.floor("value").cast("long").alias("weight"), F.col("event_id").alias("seq"))
    return relational.last_write(e, ["src", "dst", "ts"], ["seq"]).drop("seq")


# Replicas and logs


@register("orset_live", f"WITH {d.OPS}, adds AS (SELECT entity AS claim, 't' || op AS tag, wall, counter, writer, wall + 259200000 AS expires FROM ops WHERE writer <> 'error'), gone AS (SELECT 't' || (op - i) AS tag FROM ops, (VALUES (1), (2), (3)) v(i) WHERE writer = 'error') SELECT claim, tag, expires FROM adds WHERE tag NOT IN (SELECT tag FROM gone) AND expires > {NOW} QUALIFY row_number() OVER (PARTITION BY claim ORDER BY wall DESC, counter DESC, writer DESC) = 1")
def orset_live(spark, sf):
    return crdt.orset_active(*_orset(spark, sf), NOW).select("claim", "tag", "expires")


@register("orset_merge", f"WITH {d.OPS}, g AS (SELECT DISTINCT 't' || (op - i) AS tag FROM ops, (VALUES (1), (2), (3)) v(i) WHERE writer = 'error') SELECT 'add' AS kind, count(*) AS n FROM ops WHERE writer <> 'error' UNION ALL SELECT 'remove', count(*) FROM g")
def orset_merge(spark, sf):
    adds, removes = _orset(spark, sf)
    a, r = crdt.orset_merge([adds, adds.where("counter % 2 = 0")], [removes, removes])
    return a.agg(F.lit("add").alias("kind"), F.count("*").alias("n")).union(r.agg(F.lit("remove"), F.count("*")))


@register("orset_removals", f"WITH {d.OPS} SELECT entity AS claim, string_agg('t' || op, ',' ORDER BY 't' || op) AS tags FROM ops WHERE writer <> 'error' AND entity IN ('e1', 'e2') GROUP BY 1")
def orset_removals(spark, sf):
    c = spark.createDataFrame([("e1",), ("e2",)], "claim string")
    return crdt.remove_ops(_orset(spark, sf)[0], c).select("claim", F.array_join("tags", ",").alias("tags"))


@register("hydrated_states", f"WITH {d.OPS}, {d.OBSERVATIONS} SELECT 'lww' AS state, count(DISTINCT entity) AS n FROM ops UNION ALL SELECT 'gset', count(*) FROM (SELECT DISTINCT src, dst, ts // 60 FROM observations) UNION ALL SELECT 'orset', count(DISTINCT entity) FROM ops WHERE writer <> 'error' AND 't' || op NOT IN (SELECT 't' || (op - i) FROM ops, (VALUES (1), (2), (3)) v(i) WHERE writer = 'error')")
def hydrated_states(spark, sf):
    e = d.table(spark, sf, "events")
    obs = d.observations(spark, sf).withColumns({"wall": F.col("ts"), "counter": F.monotonically_increasing_id(), "writer": F.col("source")})
    del e
    adds, removes = _orset(spark, sf)
    states = crdt.hydrate(d.ops(spark, sf), obs, adds.union(adds), removes)
    rows = [s.agg(F.lit(n).alias("state"), F.count("*").alias("n")) for n, s in states.items()]
    return rows[0].union(rows[1]).union(rows[2])


@register("merkle_root")
def merkle_root(spark, sf):
    o = d.ops(spark, sf).select(F.col("writer").alias("type"), F.date_format(F.timestamp_millis("wall"), "yyyy-MM-dd").alias("day"), "op")
    return crdt.merkle_root(crdt.merkle_leaves(o, ["type", "day"], "op"))


@register("content_checks", f"WITH {d.OPS} SELECT op, op % 9 <> 0 AS valid FROM ops")
def content_checks(spark, sf):
    o = d.ops(spark, sf).withColumn("content_hash", F.when(F.col("op") % 9 == 0, "x").otherwise(F.sha2("value", 256)))
    return crdt.verify_contents(o).select("op", "valid")


@register("clock_skew", f"WITH {d.OPS} SELECT op FROM ops WHERE wall - 1705000000000 <= 86400000")
def clock_skew(spark, sf):
    return crdt.clock_skew(d.ops(spark, sf), 1_705_000_000_000).select("op")


@register("segment_days", "SELECT DISTINCT event_type AS type, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts < TIMESTAMP '2024-01-22'")
def segment_days(spark, sf):
    s = d.table(spark, sf, "events").select(F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return crdt.segment_window(s, "2024-01-14")


@register("newest_peers", "SELECT 'w' || (event_id % 200) AS writer, max(event_id) AS seen FROM events GROUP BY 1 ORDER BY seen DESC, writer LIMIT 64")
def newest_peers(spark, sf):
    return crdt.newest_peers(d.table(spark, sf, "events").select(F.concat(F.lit("w"), F.col("event_id") % 200).alias("writer"), F.col("event_id").alias("seen")))


def _log_ops(spark, sf):
    e, k = d.table(spark, sf, "events"), F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in oplog.KINDS]), (k % 4 + 1).cast("int"))
    o = e.select(kind.alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("wall"), (k % 65536).cast("int").alias("counter"), F.unhex(F.substring(F.md5(F.col("event_type")), 1, 32)).alias("writer"), F.concat(F.lit("e"), k % 300).alias("a"), k.alias("k"))
    payload = F.when(F.col("kind") == "gset_observe", None).when(F.col("kind") == "lww", F.concat(F.unhex(F.sha2(k.cast("string"), 256)), k.cast("string").cast("binary"))).when(F.col("kind") == "or_add", k.cast("string").cast("binary")).otherwise(F.unhex(F.repeat(F.lit("ab"), 28)))
    o = o.withColumn("event_id", F.col("k"))
    g = F.col("kind") == "gset_observe"
    return o.select("kind", "wall", "counter", "writer", "a", F.when(g | (F.col("kind") == "or_add"), F.concat(F.lit("b"), F.col("k") % 50)).alias("b"), payload.alias("payload"), F.when(g, F.floor(F.col("wall") / 60000).cast("long")).alias("bucket"), F.when(g, F.lit(1)).alias("observed"), F.when(g, (F.col("k") % 1000).cast("int")).alias("weight"))


@register(
    "oplog_round_trip",
    """WITH o AS (SELECT event_id AS k, ['lww', 'gset_observe', 'or_add', 'or_remove'][event_id % 4 + 1] AS kind, epoch_us(ts) // 1000 AS wall, 'e' || (event_id % 300) AS a FROM events) SELECT CASE kind WHEN 'lww' THEN 'lww' WHEN 'gset_observe' THEN 'gset' ELSE 'orset' END AS type, strftime(make_timestamp(wall * 1000), '%Y-%m-%d') AS day, count(*) AS n, sum(wall)::BIGINT AS walls, count(DISTINCT a) AS names,
    sum(CASE WHEN kind = 'gset_observe' THEN k % 1000 END)::BIGINT AS weights, sum(CASE kind WHEN 'lww' THEN 32 + length(k::VARCHAR) WHEN 'or_add' THEN length(k::VARCHAR) WHEN 'or_remove' THEN 28 END)::BIGINT AS bytes FROM o GROUP BY ALL""",
)
def oplog_round_trip(spark, sf):
    """Operations framed into daily segments and decoded again, by segment."""
    import pandas as pd

    def decode(frames):
        for f in frames:
            for t, day, content in zip(f["type"], f["day"], f["content"], strict=True):
                rows = [{"type": t, "day": day, **op} for op in oplog._decoded(bytes(content))]
                yield pd.DataFrame(rows)

    back = oplog.segments(_log_ops(spark, sf)).mapInPandas(decode, "type string, day string, " + oplog.SCHEMA)
    return back.groupBy("type", "day").agg(F.count("*").alias("n"), F.sum("wall").alias("walls"), F.countDistinct("a").alias("names"), F.sum("weight").cast("long").alias("weights"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


@register("segment_ranges", "SELECT doc_id, substr(coalesce(text, ''), 1, 0) AS none, least(greatest(strlen(text) - 100, 0), 64) AS got, strlen(text) AS size, 100 + least(greatest(strlen(text) - 100, 0), 64) >= strlen(text) AS eof FROM documents WHERE text IS NOT NULL")
def segment_ranges(spark, sf):
    s = d.table(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    return oplog.segment_range(s, 100, 64).select("doc_id", F.lit("").alias("none"), F.octet_length("bytes").cast("long").alias("got"), F.col("size").cast("long").alias("size"), "eof")


# Collectors


def _profile(spark, sf):
    c, k = d.table(spark, sf, "customer").where("c_custkey >= 1"), F.col("c_custkey")
    return c.select(k.alias("id"), F.when(k > 1, F.floor(k / 2).cast("long")).alias("parent"), F.when(k % 7 > 0, F.concat(F.lit("f"), k % 40)).alias("function"), F.col("c_nationkey").alias("hits"))


_TREE = """t AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, CASE WHEN c_custkey % 7 > 0 THEN 'f' || (c_custkey % 40) END AS fn, c_nationkey AS hits FROM customer WHERE c_custkey >= 1),
    up AS (SELECT id AS leaf, id AS node FROM t UNION ALL SELECT up.leaf, t.parent FROM up JOIN t ON t.id = up.node WHERE t.parent IS NOT NULL), inc AS (SELECT node AS id, sum(hits) AS total FROM up JOIN t ON t.id = up.leaf GROUP BY node)"""


@register("profile_coverage", f"WITH RECURSIVE {_TREE} SELECT fn AS entity, least(sum(total), 65535)::BIGINT AS weight FROM t JOIN inc USING (id) WHERE fn IS NOT NULL AND total > 0 GROUP BY fn")
def profile_coverage(spark, sf):
    return profiles.tree_coverage(_profile(spark, sf))


@register("stack_coverage", "WITH s AS (SELECT ['p' || l_partkey, 'x.Test' || chr((65 + l_suppkey % 3)::INT) || (l_suppkey % 2), 'o' || (l_orderkey % 300)] AS st, l_suppkey % 4 AS k, l_linenumber AS n FROM lineitem), c AS (SELECT st[2] AS test, unnest([st[1], st[3]]) AS entity, n FROM s WHERE k > 0) SELECT test, entity, least(sum(n), 65535)::BIGINT AS weight FROM c GROUP BY ALL")
def stack_coverage(spark, sf):
    s = F.col("l_suppkey")
    test = F.when(s % 4 > 0, F.concat(F.lit("x.Test"), F.char(65 + s % 3), s % 2)).otherwise("plain")
    li = d.table(spark, sf, "lineitem").select(F.array(F.concat(F.lit("p"), "l_partkey"), test, F.concat(F.lit("o"), F.col("l_orderkey") % 300)).alias("stack"), F.col("l_linenumber").alias("count"))
    return profiles.stack_coverage(li)


def _calls(spark, sf):
    c, k = d.table(spark, sf, "customer").where("c_custkey >= 1"), F.col("c_custkey")
    node = F.when(k % 9 == 0, F.concat(F.lit("t:test_"), k % 30)).when(k % 11 == 0, F.concat(F.lit("t:test_x.<locals>.test_"), k % 5)).otherwise(F.concat(F.lit("m:f"), k % 40))
    return c.select(k.alias("id"), F.when(k > 1, F.floor(k / 2).cast("long")).alias("parent"), node.alias("node"))


_CALLS = """t AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, CASE WHEN c_custkey % 9 = 0 THEN 't:test_' || (c_custkey % 30) WHEN c_custkey % 11 = 0 THEN 't:test_x.<locals>.test_' || (c_custkey % 5) ELSE 'm:f' || (c_custkey % 40) END AS node, c_custkey % 9 = 0 AS is_test FROM customer WHERE c_custkey >= 1)"""


@register(
    "call_coverage",
    f"""WITH RECURSIVE {_CALLS}, up AS (SELECT id AS leaf, id AS node, 0 AS depth FROM t UNION ALL SELECT up.leaf, t.parent, up.depth + 1 FROM up JOIN t ON t.id = up.node WHERE t.parent IS NOT NULL),
    ctx AS (SELECT up.leaf AS id, arg_min(t.node, up.depth) AS test FROM up JOIN t ON t.id = up.node WHERE t.is_test GROUP BY up.leaf), r AS (SELECT test, t.node AS entity FROM ctx JOIN t USING (id) UNION ALL SELECT test, p.node FROM ctx JOIN t USING (id) JOIN t p ON p.id = t.parent WHERE p.node <> test) SELECT test, entity, count(*) AS weight FROM r GROUP BY ALL""",
)
def call_coverage(spark, sf):
    return profiles.call_coverage(_calls(spark, sf))


@register("sampled_call_edges", f"WITH {_CALLS}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS nth FROM t) SELECT coalesce(p.node, '<entry>') AS src, n.node AS dst, count(*) AS observed, count(*) * 10 AS weight FROM n LEFT JOIN t p ON p.id = n.parent WHERE nth % 10 = 0 GROUP BY ALL")
def sampled_call_edges(spark, sf):
    return profiles.sampled_edges(_calls(spark, sf), 10)


@register("collector_flush", "SELECT 'u' || user_id AS src, event_type AS dst, 'call' AS kind, epoch_us(ts) // 3600000000 * 3600 + 3600 AS ts, count(*) AS observed, count(*) * 100 AS weight FROM events GROUP BY ALL")
def collector_flush(spark, sf):
    e = d.table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.lit("call").alias("kind"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    return profiles.collector_flush(e, 3600, 100)


@register("coverage_flush", "SELECT 'test_' || (user_id % 5) AS test, event_type AS entity, count(*) AS weight FROM events GROUP BY ALL")
def coverage_flush(spark, sf):
    return profiles.coverage_flush(d.table(spark, sf, "events").select(F.concat(F.lit("test_"), F.col("user_id") % 5).alias("test"), F.col("event_type").alias("entity")))


@register("frame_names", "WITH p AS (SELECT url, CASE WHEN page_id % 3 > 0 THEN 'fn' || (page_id % 7) ELSE '' END AS f, page_id AS line FROM pages), b AS (SELECT *, regexp_extract(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '([^/]*)$', 1) AS base FROM p), m AS (SELECT *, CASE WHEN regexp_matches(base, '^.+\\.[^.]*$') THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS module FROM b), n AS (SELECT *, CASE WHEN f <> '' THEN f ELSE '(anonymous):' || line END AS name FROM m) SELECT CASE WHEN module <> '' THEN module || ':' || name ELSE name END AS frame, count(*) AS n FROM n WHERE coalesce(url, '') <> '' GROUP BY 1")
def frame_names(spark, sf):
    k = F.col("page_id")
    p = d.table(spark, sf, "pages").select("url", F.when(k % 3 > 0, F.concat(F.lit("fn"), k % 7)).otherwise("").alias("f"), k.alias("line"))
    p = p.where(profiles.keep_frame(F.col("f"), F.col("url")))
    return p.groupBy(profiles.frame_name(F.col("f"), F.col("url"), F.col("line")).alias("frame")).agg(F.count("*").alias("n"))


@register("go_frames", "WITH s AS (SELECT ['runtime.main', 'net/http.Serve', 'github.com/a/b.(*T).Run' || (o_orderkey % 5), 'main.main', 'example.com/x.TestA'][o_orderkey % 5 + 1] AS symbol FROM orders) SELECT symbol, NOT contains(CASE WHEN contains(symbol, '/') THEN split_part(symbol, '/', 1) ELSE split_part(symbol, '.', 1) END, '.') AS runtime, count(*) AS n FROM s GROUP BY ALL")
def go_frames(spark, sf):
    k = F.col("o_orderkey")
    s = d.table(spark, sf, "orders").select(F.element_at(F.array(F.lit("runtime.main"), F.lit("net/http.Serve"), F.concat(F.lit("github.com/a/b.(*T).Run"), k % 5), F.lit("main.main"), F.lit("example.com/x.TestA")), (k % 5 + 1).cast("int")).alias("symbol"))
    return s.groupBy("symbol", profiles.runtime_frame(F.col("symbol")).alias("runtime")).agg(F.count("*").alias("n"))


# Repositories and change events


@register("changed_since", "WITH o AS (SELECT doc_id AS file, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id AS file, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(text) END AS h, doc_id % 13 <> 0 AS tracked FROM documents WHERE doc_id % 11 <> 0) SELECT file, CASE WHEN n.h IS NULL THEN 'deleted' WHEN NOT tracked THEN 'untracked' ELSE 'changed' END AS state FROM o FULL JOIN n USING (file) WHERE n.h IS NULL OR NOT tracked OR o.h IS DISTINCT FROM n.h")
def changed_since(spark, sf):
    h = d.table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.sha2("text", 256).alias("hash"))
    now = h.where("file % 11 <> 0").withColumn("hash", F.when(F.col("file") % 7 == 0, "x").otherwise(F.col("hash"))).withColumn("tracked", F.col("file") % 13 != 0)
    return repo.changed_since(h.where("file % 10 <> 0"), now)


def _changes(spark, sf):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "rename").when(F.col("event_type") == "signup", "moved").otherwise("modify")
    return d.table(spark, sf, "events").select(F.concat(F.lit("f"), F.col("event_id") % 700).alias("file"), kind.alias("kind"), F.concat(F.lit("o"), "user_id").alias("origin"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


@register("watch_events", "WITH c AS (SELECT 'f' || (event_id % 700) AS file, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'rename' WHEN 'signup' THEN 'overflow' ELSE 'modify' END AS kind, CASE WHEN event_type = 'view' THEN 'o' || user_id END AS origin, epoch_us(ts) // 1000 AS ts_ms FROM events) SELECT * FROM c UNION ALL SELECT NULL, 'heartbeat', NULL, 1900000000000")
def watch_events(spark, sf):
    return repo.watch_events(_changes(spark, sf), now_ms=1_900_000_000_000)


@register("change_notifications", "WITH b AS (SELECT user_id AS batch, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'changed' END || ' f' || (event_id % 40) AS x FROM events), g AS (SELECT batch, list_sort(list_distinct(list(x))) AS f FROM b GROUP BY batch) SELECT batch, array_to_string(f[1:20], ', ') || CASE WHEN len(f) > 20 THEN ' and ' || (len(f) - 20) || ' more' ELSE '' END AS line FROM g")
def change_notifications(spark, sf):
    b = d.table(spark, sf, "events").select(F.col("user_id").alias("batch"), F.concat(F.lit("f"), F.col("event_id") % 40).alias("file"), F.when(F.col("event_type") == "error", "deleted").otherwise("changed").alias("action"))
    return repo.notification(b)


@register("live_ops", "WITH o AS (SELECT ['lww', 'gset', 'orset'][event_id % 3 + 1] AS type, 'k' || event_id AS key, event_type AS writer FROM events), s(subscriber, writer, type) AS (VALUES ('s1', 'click', 'lww'), ('s2', 'view', 'lww'), ('s2', 'view', 'gset'), ('s2', 'view', 'orset')) SELECT DISTINCT subscriber, o.type, key FROM o JOIN s ON s.type = o.type AND s.writer <> o.writer")
def live_ops(spark, sf):
    o = d.table(spark, sf, "events").select(F.element_at(F.array(F.lit("lww"), F.lit("gset"), F.lit("orset")), (F.col("event_id") % 3 + 1).cast("int")).alias("type"), F.concat(F.lit("k"), "event_id").alias("key"), F.col("event_type").alias("writer"))
    return repo.live_ops(o, spark.createDataFrame([("s1", "click", ["lww"]), ("s2", "view", [])], "subscriber string, writer string, types array<string>"))


@register("observation_batches", "WITH r AS (SELECT user_id, event_type, floor(value)::BIGINT AS w FROM events WHERE event_type <> 'view') SELECT 'u' || user_id AS src, event_type AS dst, sum(w)::BIGINT AS weight, 100 AS rate FROM r GROUP BY ALL")
def observation_batches(spark, sf):
    e = d.table(spark, sf, "events").where("event_type <> 'view'")
    o = F.struct(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.lit(0).alias("ts"), F.lit(1).alias("observed"), F.floor("value").cast("long").alias("weight"))
    bodies = e.groupBy((F.col("event_id") % 500).alias("b")).agg(F.to_json(F.struct(F.lit("s").alias("source"), F.lit(100).alias("sample_rate"), F.collect_list(o).alias("observations"))).alias("body"))
    rows = repo.observations_of(repo.observation_batches(bodies.union(spark.createDataFrame([(-1, "{broken")], bodies.schema))))
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.max("rate").alias("rate"))


@register("ingest_page", "SELECT o_orderkey AS seq, o_custkey AS payload FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 250")
def ingest_page(spark, sf):
    return repo.replay(d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("payload")), 100, 250)


@register("entity_ids", f"WITH {d.NODES}, f AS (SELECT id, CASE key % 3 WHEN 0 THEN file WHEN 1 THEN 'a/b/__init__.py' ELSE 'top.py' END AS file, CASE key % 4 WHEN 0 THEN 'Cls.m' WHEN 1 THEN 'b.fn' WHEN 2 THEN '' ELSE name END AS qn, key % 4 = 0 AS m FROM nodes), p AS (SELECT *, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(file, '([^/]*)$', 1) AS base FROM f), g AS (SELECT *, CASE WHEN base = '__init__.py' AND dir <> '' THEN regexp_extract(dir, '([^/]*)$', 1) ELSE regexp_replace(base, '\\.[^.]*$', '') END AS module, CASE WHEN dir = '' THEN '' ELSE dir || '/' END AS scope FROM p), q AS (SELECT *, CASE WHEN NOT m AND starts_with(qn, module || '.') THEN regexp_replace(qn, '^[^.]*\\.', '') ELSE qn END AS local FROM g) SELECT id, CASE WHEN local = '' THEN scope || module ELSE scope || module || '/' || local END AS entity FROM q")
def entity_ids(spark, sf):
    k = F.col("key")
    n = d.nodes(spark, sf).select("id", F.when(k % 3 == 0, F.col("file")).when(k % 3 == 1, "a/b/__init__.py").otherwise("top.py").alias("file"), F.when(k % 4 == 0, "Cls.m").when(k % 4 == 1, "b.fn").when(k % 4 == 2, "").otherwise(F.col("name")).alias("qn"), (k % 4 == 0).alias("m"))
    return n.select("id", names.entity_id(F.col("file"), F.trim("qn"), F.col("m")).alias("entity"))


@register("synthetic_repo")
def synthetic_repo(spark, sf):
    return repo.synthetic_repo(spark, 500)
