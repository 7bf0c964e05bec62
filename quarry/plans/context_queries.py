"""Registered queries on context packs, prompts, drawings and node files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, pack
from ..sources import derived as d
from ..sources import markdown
from . import registry

QUERIES, SQL, register = registry.new()

# Files made of the suppliers: a library file declares a type and a constant, an application file uses some of them.


def _files(spark, sf):
    s = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"))
    k = F.col("s").cast("string")
    lib = F.concat(F.lit("import x\n"), F.lit("// type\nclass T"), k, F.lit(" {\n  a;\n}\n\nexport const K"), k, F.lit(" = {\n  v: [1,\n  2],\n};\nexport type A"), k, F.lit(" = T"), k, F.lit(";\n"))
    n = ((F.col("s") * 7) % 10).cast("string")
    app = F.concat(F.lit("// head\n\nimport lib\n# note\n@mark\nfunction f"), k, F.lit("(p: T"), k, F.lit(") {\n  return K"), k, F.lit(" + A"), k, F.lit(" + T"), n, F.lit("\n}\nlast = 1\n"))
    both = s.select(F.concat(F.lit("lib/l"), k, F.lit(".ts")).alias("file"), lib.alias("text")).union(s.select(F.concat(F.lit("app/a"), k, F.lit(".ts")), app))
    return both


def _graph(spark, sf):
    s = d.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    row = lambda id_, name, kind, file, a, b: s.select(id_.alias("id"), name.alias("name"), F.lit(kind).alias("kind"), file.alias("file"), F.lit(a).cast("long").alias("range_start"), F.lit(b).cast("long").alias("range_end"))
    lib, app = F.concat(F.lit("lib/l"), "k"), F.concat(F.lit("app/a"), "k")
    t, f = F.concat(F.lit("T"), "k"), F.concat(F.lit("f"), "k")
    dot = lambda x: F.concat(x, F.lit(".ts"))
    n = row(lib, F.concat(F.lit("l"), "k"), "module", dot(lib), 1, 12).union(row(app, F.concat(F.lit("a"), "k"), "module", dot(app), 1, 10))
    n = n.union(row(F.concat(lib, F.lit("/"), t), t, "class", dot(lib), 3, 5)).union(row(F.concat(app, F.lit("/"), f), f, "function", dot(app), 6, 8))
    e = s.select(app.alias("src"), lib.alias("dst"), F.lit("import").alias("kind"), F.lit(1).cast("long").alias("weight"))
    return n, e, s.select(F.concat(app, F.lit("/"), f).alias("root"))


@register("type_references", "SELECT 'app/a' || s_suppkey || '/f' || s_suppkey AS root, 'lib/l' || s_suppkey || '/T' || s_suppkey AS id, 'lib/l' || s_suppkey || '.ts' AS file, 3::BIGINT AS start, 5::BIGINT AS \"end\", FALSE AS truncated FROM supplier")
def type_references(spark, sf):
    n, e, roots = _graph(spark, sf)
    return context.type_references(n, e, _files(spark, sf), roots)


@register("imported_declarations", "SELECT 'app/a' || s_suppkey || '/f' || s_suppkey AS root, unnest(['K' || s_suppkey, 'A' || s_suppkey]) AS name, 'lib/l' || s_suppkey || '.ts' AS file, unnest([7, 11])::BIGINT AS start, unnest([10, 11])::BIGINT AS \"end\" FROM supplier")
def imported_declarations(spark, sf):
    n, e, roots = _graph(spark, sf)
    out = context.imported_declarations(n, e, _files(spark, sf), roots)
    return out.select("root", "name", "file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@register("module_frames", "SELECT 'lib/l' || s_suppkey || '.ts' AS file, unnest([1, 6])::BIGINT AS start, unnest([1, 12])::BIGINT AS \"end\" FROM supplier UNION ALL SELECT 'app/a' || s_suppkey || '.ts', unnest([1, 9]), unnest([3, 10]) FROM supplier")
def module_frames(spark, sf):
    n, _, _ = _graph(spark, sf)
    none = spark.createDataFrame([], "file string, start long, end long")
    return context.module_frame(_files(spark, sf), n, none)


@register("trimmed_frames", "SELECT 'lib/l' || s_suppkey || '.ts' AS file, 1::BIGINT AS start, 1::BIGINT AS \"end\" FROM supplier UNION ALL SELECT 'app/a' || s_suppkey || '.ts', 9, 10 FROM supplier")
def trimmed_frames(spark, sf):
    n, _, _ = _graph(spark, sf)
    f = _files(spark, sf)
    anchors = f.select("file", F.when(F.col("file").startswith("lib/"), 1).otherwise(10).cast("long").alias("start")).withColumn("end", F.col("start"))
    return context.module_frame(f, n, anchors, 2)


@register(
    "change_slices",
    """WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT 'app/a' || k || '.ts' AS file, 'target' AS role, 'app/a' || k || '/f' || k AS id, 6::BIGINT AS start, 8::BIGINT AS "end" FROM s WHERE k % 3 = 0
    UNION ALL SELECT 'app/a' || k || '.ts', 'frame', NULL, 1, 3 FROM s WHERE k % 3 = 1 UNION ALL SELECT 'app/a' || k || '.ts', 'frame', NULL, 9, 10 FROM s WHERE k % 3 = 1
    UNION ALL SELECT 'app/a' || k || '.ts', 'file', NULL, 1, 10 FROM s WHERE k % 3 = 2""",
)
def change_slices(spark, sf):
    n, _, _ = _graph(spark, sf)
    k = F.col("s_suppkey")
    regions = d.table(spark, sf, "supplier").select(F.concat(F.lit("app/a"), k, F.lit(".ts")).alias("file"), F.when(k % 3 == 0, 7).when(k % 3 == 1, 2).otherwise(1).cast("long").alias("start"), F.when(k % 3 == 0, 8).when(k % 3 == 1, 2).otherwise(10).cast("long").alias("end"))
    return context.change_slices(regions, n, _files(spark, sf)).select("file", "role", "id", "start", "end")


def _slices(spark, sf):
    li = d.table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("t"), F.col("l_orderkey") % 500).alias("task"), F.concat(F.lit("s"), "l_suppkey").alias("symbol"), (F.col("l_linenumber") % 3).alias("rung"), F.concat(F.lit("f"), F.col("l_partkey") % 40).alias("file"), F.col("l_suppkey").alias("start"), (F.col("l_suppkey") + 2).alias("end"), F.lit("target").alias("role"), F.concat(F.lit("x"), F.col("l_partkey") % 40, F.lit("_"), "l_suppkey").alias("text"))


_SL = """sl AS (SELECT 't' || (l_orderkey % 500) AS task, 's' || l_suppkey AS symbol, l_linenumber % 3 AS rung, 'f' || (l_partkey % 40) AS file, l_suppkey AS start, l_suppkey + 2 AS e, 'x' || (l_partkey % 40) || '_' || l_suppkey AS text FROM lineitem)"""
_BLOCKS = """b AS (SELECT DISTINCT {g} AS g, file, start, e, '### ' || file || ':' || start || '-' || e || ' (target)' || chr(10) || '```' || chr(10) || text || chr(10) || '```' AS block FROM {t}), r AS (SELECT g, string_agg(block, chr(10) || chr(10) ORDER BY file, start, e) AS pack, count(*) AS n FROM b GROUP BY g)"""


@register("rendered_packs", f"WITH {_SL}, {_BLOCKS.format(g='task', t='sl')} SELECT g AS task, sha256(pack) AS content_key, ceil(length(pack) / 4)::BIGINT AS tokens, n AS slices FROM r")
def rendered_packs(spark, sf):
    return context.render_blocks(_slices(spark, sf), "task").select("task", "content_key", "tokens", F.size("order").cast("long").alias("slices"))


def _rungs(spark, sf):
    s = _slices(spark, sf)
    r = s.groupBy("task", "symbol", "rung").agg(F.sum(F.length("text")).alias("tokens"))
    return s, r.withColumn("recommended", F.col("rung") == 1)


_RG = f"{_SL}, rg AS (SELECT task, symbol, rung, sum(length(text))::BIGINT AS tokens FROM sl GROUP BY ALL)"


@register("agent_choices", f"WITH {_RG}, p AS (SELECT *, tokens <= 6 AS ok FROM rg) SELECT task, symbol, rung, tokens, NOT ok AS over_budget FROM p QUALIFY row_number() OVER (PARTITION BY task, symbol ORDER BY NOT ok, CASE WHEN ok THEN -rung ELSE rung END) = 1")
def agent_choices(spark, sf):
    s, r = _rungs(spark, sf)
    return context.agent_context(r, s, budget=6)[0]


@register("agent_blocks", f"WITH {_RG}, c AS (SELECT task, symbol, rung FROM rg QUALIFY row_number() OVER (PARTITION BY task, symbol ORDER BY rung > 1, CASE WHEN rung <= 1 THEN -rung ELSE rung END) = 1), u AS (SELECT sl.* FROM sl JOIN c USING (task, symbol, rung)), {_BLOCKS.format(g='task', t='u')} SELECT g AS task, sha256(pack) AS content_key FROM r")
def agent_blocks(spark, sf):
    s, r = _rungs(spark, sf)
    return context.agent_context(r, s, level="pack-2hop")[1].select("task", "content_key")


@register("extended_context", f"WITH {_SL}, cur AS (SELECT task, file || ':' || start || ':' || e AS key, min(sha256(text)) AS digest FROM sl GROUP BY ALL), pr AS (SELECT task, key, CASE WHEN key LIKE 'f3%' THEN 'old' ELSE digest END AS digest, row_number() OVER (PARTITION BY task ORDER BY key DESC) AS position FROM cur), k AS (SELECT task, key, position, bool_and(digest <> 'old') OVER (PARTITION BY task ORDER BY position) AS ok FROM pr), f AS (SELECT * FROM k WHERE ok) SELECT task, position, key, 'prefix' AS part FROM f UNION ALL SELECT task, row_number() OVER (PARTITION BY task ORDER BY key), key, 'tail' FROM cur WHERE (task, key) NOT IN (SELECT (task, key) FROM f)")
def extended_context(spark, sf):
    from pyspark.sql import Window

    s = _slices(spark, sf)
    key = F.concat_ws(":", "file", F.col("start").cast("string"), F.col("end").cast("string"))
    now = s.select("task", key.alias("key"), F.unhex(F.sha2("text", 256)).alias("d")).groupBy("task", "key").agg(F.min("d").alias("d"))
    prior = now.withColumn("position", F.row_number().over(Window.partitionBy("task").orderBy(F.col("key").desc())))
    prior = prior.withColumn("digest", F.when(F.col("key").startswith("f3"), "old").otherwise(F.lower(F.hex("d")))).drop("d")
    return context.extended(s, prior, "task")


@register("fleet_totals", "WITH s AS (SELECT l_partkey AS key, l_orderkey % 50 AS lane, max(l_partkey % 90 + 10) AS tokens FROM lineitem GROUP BY ALL), n AS (SELECT key, count(*) AS n FROM s GROUP BY key), p AS (SELECT s.*, n >= 20 OR key % 97 = 0 AS shared FROM s JOIN n USING (key)), o AS (SELECT count(DISTINCT key) FILTER (WHERE shared) AS shared_slices, sum(tokens) AS naive, coalesce(sum(tokens) FILTER (WHERE NOT shared), 0) AS own FROM p), h AS (SELECT coalesce(sum(tokens), 0) AS once FROM (SELECT DISTINCT key, tokens FROM p WHERE shared)) SELECT 50::BIGINT AS lanes, shared_slices, naive::BIGINT AS naive, (own + once)::BIGINT AS deduped, (naive - own - once)::BIGINT AS saved FROM o, h")
def fleet_totals(spark, sf):
    s = d.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") % 50).alias("lane"), (F.col("l_partkey") % 90 + 10).alias("tokens"))
    return context.fleet_split(s, d.table(spark, sf, "part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("key")), 20)[1]


def _prompts(spark, sf):
    f = _files(spark, sf).withColumn("s", F.regexp_extract("file", r"(\d+)", 1).cast("long"))
    k = F.col("s")
    body = F.when(k % 5 == 0, "short").when(k % 5 == 1, F.concat(F.lit("\n"), "text", F.lit("\n"))).otherwise(F.concat(F.lit("\n"), F.repeat(F.lit("pad "), 200), "text", F.lit("\n")))
    path = F.when(k % 7 == 0, "gone.ts").otherwise(F.col("file"))
    p = f.select(F.col("file").alias("prompt"), F.concat(F.lit("see <file path=\""), path, F.lit("\">"), body, F.lit("</file> and $1 <file path='no.ts' x=1></file> end")).alias("text"))
    packs = f.where(k % 2 == 0).select(F.col("file").alias("prompt"), F.col("file").alias("path"), F.repeat(F.lit("p$"), 150).alias("pack"))
    return f, p, packs


def _actions(spark, sf):
    f, p, packs = _prompts(spark, sf)
    n, _, _ = _graph(spark, sf)
    return p, context.marker_actions(context.prompt_markers(p), f, n, packs)


_ACT = """fl AS (SELECT s_suppkey AS k, 'lib/l' || s_suppkey || '.ts' AS file, 'import x' || chr(10) || '// type' || chr(10) || 'class T' || s_suppkey || ' {' || chr(10) || '  a;' || chr(10) || '}' || chr(10) || chr(10) || 'export const K' || s_suppkey || ' = {' || chr(10) || '  v: [1,' || chr(10) || '  2],' || chr(10) || '};' || chr(10) || 'export type A' || s_suppkey || ' = T' || s_suppkey || ';' || chr(10) AS text FROM supplier
      UNION ALL SELECT s_suppkey, 'app/a' || s_suppkey || '.ts', '// head' || chr(10) || chr(10) || 'import lib' || chr(10) || '# note' || chr(10) || '@mark' || chr(10) || 'function f' || s_suppkey || '(p: T' || s_suppkey || ') {' || chr(10) || '  return K' || s_suppkey || ' + A' || s_suppkey || ' + T' || ((s_suppkey * 7) % 10) || chr(10) || '}' || chr(10) || 'last = 1' || chr(10) FROM supplier),
    mk AS (SELECT file AS prompt, 0 AS n, CASE WHEN k % 7 = 0 THEN 'gone.ts' ELSE file END AS path, CASE k % 5 WHEN 0 THEN 'short' WHEN 1 THEN chr(10) || text || chr(10) ELSE chr(10) || repeat('pad ', 200) || text || chr(10) END AS body, k FROM fl UNION ALL SELECT file, 1, 'no.ts', '', k FROM fl),
    ac AS (SELECT *, CASE WHEN path IN ('gone.ts', 'no.ts') THEN 'unreadable' WHEN k % 5 = 0 THEN 'not-whole-file' WHEN k % 2 = 1 THEN 'no-intent' WHEN 75 >= ceil(length(body) / 4) THEN 'not-smaller' ELSE 'packed' END AS action, ceil(length(body) / 4)::BIGINT AS tb FROM mk)"""


@register("prompt_actions", f"WITH {_ACT} SELECT prompt, n, path, action, tb AS tokens_before, CASE WHEN action = 'packed' THEN 75 ELSE tb END::BIGINT AS tokens_after FROM ac")
def prompt_actions(spark, sf):
    return _actions(spark, sf)[1].drop("pack")


@register("rewritten_prompts", f"WITH {_ACT} SELECT prompt, sha256('see ' || CASE WHEN action = 'packed' THEN '<file path=\"' || path || '\">' || chr(10) || repeat('p$', 150) || chr(10) || '</file>' ELSE '<file path=\"' || path || '\">' || body || '</file>' END || ' and $1 <file path=''no.ts'' x=1></file> end') AS digest FROM ac WHERE n = 0")
def rewritten_prompts(spark, sf):
    p, a = _actions(spark, sf)
    return context.rewrite_prompts(p, a).select("prompt", F.sha2("text", 256).alias("digest"))


@register("rewrite_totals", f"WITH {_ACT} SELECT prompt, count(*) AS files, count(*) FILTER (WHERE action = 'packed') AS packed, sum(tb)::BIGINT AS tokens_before, sum(CASE WHEN action = 'packed' THEN 75 ELSE tb END)::BIGINT AS tokens_after, sum(CASE WHEN action = 'packed' THEN tb - 75 ELSE 0 END)::BIGINT AS saved FROM ac GROUP BY prompt")
def rewrite_totals(spark, sf):
    return context.rewrite_stats(_actions(spark, sf)[1])


_READS = """m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'p' || (conv_id % 3) END AS path, coalesce(text, '') || repeat(' more', (conv_id % 40)::INT) AS text FROM conversations),
    o AS (SELECT *, count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS age FROM m), x AS (SELECT *, len(string_split(text, chr(10))) AS lines FROM o WHERE age >= 2 AND path IS NOT NULL AND length(text) > 0),
    y AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN '[older read of ' || path || ' compacted (was ~' || lines || ' lines)]' || chr(10) || chr(10) || 'slice' || CASE WHEN conv_id % 4 = 0 THEN chr(10) || chr(10) || 'edit' ELSE '' END END AS named, '[older read of ' || path || ' (~' || lines || ' lines) left out; read the file again if needed]' AS pointer FROM x),
    z AS (SELECT *, CASE WHEN length(named) < length(text) THEN 'slice' WHEN length(pointer) < length(text) THEN 'pointer' END AS kind FROM y)"""


def _reads(spark, sf):
    m = d.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("p"), F.col("conv_id") % 3)).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit(" more"), (F.col("conv_id") % 40).cast("int"))).alias("text"))
    own = m.where("path is not null").select("conv_id", "path").distinct()
    return context.compact_reads(m, own.where("conv_id % 2 = 0").withColumn("text", F.lit("slice")), own.where("conv_id % 4 = 0").withColumn("text", F.lit("edit")), 2)


@register("compacted_reads", f"WITH {_READS} SELECT conv_id, turn, path, kind, ceil(length(text) / 4)::BIGINT AS tokens_before, ceil(length(CASE kind WHEN 'slice' THEN named ELSE pointer END) / 4)::BIGINT AS tokens_after FROM z WHERE kind IS NOT NULL")
def compacted_reads(spark, sf):
    return _reads(spark, sf)


@register("compaction_totals", f"WITH {_READS} SELECT count(*) AS compacted, coalesce(sum(ceil(length(text) / 4)), 0)::BIGINT AS tokens_before, coalesce(sum(ceil(length(CASE kind WHEN 'slice' THEN named ELSE pointer END) / 4)), 0)::BIGINT AS tokens_after FROM z WHERE kind IS NOT NULL")
def compaction_totals(spark, sf):
    return context.compaction_stats(_reads(spark, sf))


@register("escalated_rungs", "WITH r AS (SELECT l_orderkey AS symbol, l_linenumber AS rung, floor(l_extendedprice / 100)::BIGINT AS tokens FROM lineitem WHERE l_linenumber <= 3), w AS (SELECT *, max(CASE WHEN rung = 3 THEN tokens END) OVER (PARTITION BY symbol) AS whole FROM r) SELECT symbol, rung, tokens FROM w WHERE rung = 3 OR tokens < whole QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY tokens, rung) = 1")
def escalated_rungs(spark, sf):
    r = d.table(spark, sf, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("symbol"), F.col("l_linenumber").alias("rung"), F.floor(F.col("l_extendedprice") / 100).cast("long").alias("tokens"))
    return pack.escalation(r)


@register("drawn_layout")
def drawn_layout(spark, sf):
    """One drawing a region: its nations and fifty marks that their customers are dealt to."""
    c = d.table(spark, sf, "customer").join(d.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = c.select(F.col("n_regionkey").alias("graph"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit(0).cast("long").alias("k")).distinct()
    e = c.groupBy(F.col("n_regionkey").alias("graph"), F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("m"), F.col("c_custkey") % 50).alias("dst")).agg(F.count("*").alias("weight"))
    nodes = n.select("graph", "id").union(e.select("graph", "dst")).distinct()
    return context.force_layout(context.start_positions(nodes, e), e, 5).select("graph", "id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("energy", 3).alias("energy"))


def _node_files(spark, sf):
    n = d.nodes(spark, sf)
    n = n.withColumns({"qualified_name": F.concat(F.lit("Q "), "name"), "language": F.lit("python"), "ast_hash": F.sha2("id", 256), "last_seen": F.lit(0), "logical_clock": F.col("key"), "summary": F.when(F.col("key") % 2 == 0, F.concat(F.lit(" Does "), "name", F.lit(".\n\nMore: \"x\" ")))})
    return n, markdown.render_nodes(n, d.trace_edges(spark, sf))


@register("node_files", f"WITH {d.NODES} SELECT id, regexp_replace(id, '[^A-Za-z0-9_.\\-/]', '_', 'g') || '.md' AS path, name, 'Q ' || name AS qualified_name, kind, file, range_start, range_end, sha256(id) AS ast_hash, key AS logical_clock, CASE WHEN key % 2 = 0 THEN 'Does ' || name || '.' || chr(10) || chr(10) || 'More: \"x\"' ELSE '_Summary pending._' END AS summary FROM nodes")
def node_files(spark, sf):
    """Every node rendered as a file and parsed again."""
    files = _node_files(spark, sf)[1].select("path", "content")
    return markdown.parse_nodes(files).drop("language")


@register("orphaned_files", f"WITH {d.NODES} SELECT id || '.md' AS path FROM nodes WHERE key % 10 = 3")
def orphaned_files(spark, sf):
    n, files = _node_files(spark, sf)
    alien = spark.createDataFrame([("notes.md", "no front matter")], "path string, content string")
    return markdown.orphans(files.select("path", "content").union(alien), n.where("key % 10 <> 3"))


@register("changed_node_files", f"WITH {d.NODES} SELECT id FROM nodes WHERE key % 6 = 0")
def changed_node_files(spark, sf):
    files = _node_files(spark, sf)[1]
    k = F.regexp_extract("id", r"/(\d+)$", 1).cast("long")
    old = files.where(k % 12 != 0).select("path", F.when(k % 12 == 6, F.lit("edited")).otherwise(F.regexp_replace("content", "last_seen: .*", "last_seen: then")).alias("content"))
    return markdown.changed_files(files, old).select("id")
