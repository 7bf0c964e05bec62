"""Registered graph, resolution and test-selection queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, relational, resolve, select_tests
from ..sources import derived as d
from . import registry

QUERIES, SQL, register = registry.new()


def roots(spark, *ids: str):
    return spark.createDataFrame([(i,) for i in ids], "root string")


def reverse_walk(ids: str, depth: int, edges: str = "edges") -> str:
    return f"w AS (SELECT id AS root, id, 0 AS depth FROM (VALUES {ids}) t(id) UNION SELECT w.root, e.src AS id, w.depth + 1 FROM w JOIN {edges} e ON e.dst = w.id WHERE w.depth < {depth}), seen AS (SELECT root, id, min(depth) AS depth FROM w GROUP BY ALL)"


@register("impact_depths", f"WITH RECURSIVE {d.EDGES}, {reverse_walk("('region/0')", 6)} SELECT root, id, depth::INT AS depth FROM seen WHERE depth > 0")
def impact_depths(spark, sf):
    return graph.impact(d.edges(spark, sf), roots(spark, "region/0"), 6)


@register(
    "impact_summary",
    f"WITH RECURSIVE {d.EDGES}, {reverse_walk("('region/1'), ('nation/3'), ('supplier/2')", 3)}, s AS (SELECT root, count(*) FILTER (WHERE depth BETWEEN 1 AND 2) AS dependents, max(least(depth, 2))::INT AS deepest, bool_or(depth = 3) AS capped FROM seen GROUP BY root) SELECT * FROM s",
)
def impact_summary(spark, sf):
    return graph.impact_summary(d.edges(spark, sf), roots(spark, "region/1", "nation/3", "supplier/2"), 2)


@register(
    "impact_preview",
    f"""WITH RECURSIVE {d.EDGES}, {reverse_walk("('supplier/3'), ('nation/4')", 2)}, inner_edges AS (SELECT DISTINCT a.root, e.src, e.dst FROM edges e JOIN seen a ON a.id = e.src JOIN seen b ON b.id = e.dst AND b.root = a.root),
    up AS (SELECT root, dst AS start, src AS id FROM inner_edges UNION SELECT up.root, up.start, e.src FROM up JOIN inner_edges e ON e.root = up.root AND e.dst = up.id),
    sub AS (SELECT root, start AS id, count(DISTINCT id) AS subtree FROM up WHERE id <> start GROUP BY ALL),
    direct AS (SELECT dst AS root, src AS id, bool_or(kind = 'import') AS i, bool_or(kind <> 'import') AS c, sum(weight) FILTER (WHERE kind <> 'import') AS n FROM edges GROUP BY ALL)
    SELECT s.root, s.id, s.depth::INT AS depth, CASE WHEN i AND c THEN 'call+import' WHEN c THEN 'call' WHEN i THEN 'import' END AS via, coalesce(n, 0)::BIGINT AS call_sites, coalesce(subtree, 0)::BIGINT AS subtree
    FROM seen s LEFT JOIN direct USING (root, id) LEFT JOIN sub USING (root, id) WHERE depth > 0""",
)
def impact_preview(spark, sf):
    return graph.impact_preview(d.edges(spark, sf), roots(spark, "supplier/3", "nation/4"), 2)


@register("refs_by_symbol", f"WITH {d.EDGES} SELECT dst, src, CASE WHEN kind = 'import' THEN 'import' ELSE 'call' END AS via, weight FROM edges WHERE dst LIKE 'supplier/%'")
def refs_by_symbol(spark, sf):
    return relational.references(d.edges(spark, sf)).where(F.col("dst").startswith("supplier/"))


@register("importers_by_module", f"WITH {d.EDGES} SELECT dst, src FROM edges WHERE kind = 'import' AND dst LIKE 'nation/%'")
def importers_by_module(spark, sf):
    return d.edges(spark, sf).where("kind = 'import'").where(F.col("dst").startswith("nation/")).select("dst", "src")


@register("refs_summary", f"WITH {d.EDGES} SELECT dst, count(*) FILTER (WHERE kind <> 'import') AS callers, count(*) FILTER (WHERE kind = 'import') AS importers, sum(weight)::BIGINT AS sites FROM edges GROUP BY dst")
def refs_summary(spark, sf):
    return relational.references_summary(d.edges(spark, sf))


@register(
    "node_detail",
    f"WITH {d.NODES}, {d.EDGES} SELECT id, name, kind, file, (SELECT count(*) FROM edges WHERE src = id) AS n_out, (SELECT count(*) FROM edges WHERE dst = id) AS n_in FROM nodes WHERE kind IN ('class', 'module')",
)
def node_detail(spark, sf):
    n = d.nodes(spark, sf).where("kind in ('class', 'module')").select("id", "name", "kind", "file")
    e = d.edges(spark, sf)
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    inn = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    return n.join(out, "id", "left").join(inn, "id", "left").fillna(0, ["n_out", "n_in"])


@register("edge_fold", f"WITH {d.EDGES} SELECT kind, count(*) AS edges, sum(weight)::BIGINT AS occurrences, max(weight) AS heaviest FROM edges GROUP BY kind")
def edge_fold(spark, sf):
    return d.edges(spark, sf).groupBy("kind").agg(F.count("*").alias("edges"), F.sum("weight").alias("occurrences"), F.max("weight").alias("heaviest"))


@register("trace_edge_rollup", f"WITH {d.OBSERVATIONS} SELECT src, dst, sum(observed)::BIGINT AS observed, sum(weight)::BIGINT AS weight, count(*) AS n FROM observations GROUP BY ALL")
def trace_edge_rollup(spark, sf):
    return relational.trace_rollup(d.observations(spark, sf))


@register(
    "trace_neighbors",
    f"WITH {d.OBSERVATIONS}, b AS (SELECT src AS node, dst AS other, 'out' AS direction, observed, weight FROM observations UNION ALL SELECT dst, src, 'in', observed, weight FROM observations) SELECT node, other, direction, sum(weight)::BIGINT AS invocations, sum(observed)::BIGINT AS observed, count(*) AS n FROM b GROUP BY ALL",
)
def trace_neighbors(spark, sf):
    return relational.trace_neighbors(d.observations(spark, sf))


@register(
    "neighbors_khop",
    f"WITH RECURSIVE {d.EDGES}, both_ways AS (SELECT DISTINCT src, dst FROM edges UNION SELECT dst, src FROM edges), {reverse_walk("('supplier/1'), ('nation/2')", 2, 'both_ways')} SELECT root, id, depth::INT AS depth FROM seen",
)
def neighbors_khop(spark, sf):
    return graph.neighbors(d.edges(spark, sf), roots(spark, "supplier/1", "nation/2"), 2)


@register(
    "neighbor_edges",
    f"WITH {d.EDGES}, {d.TRACE}, b AS (SELECT src, dst, kind, weight, 0 AS p FROM edges UNION ALL SELECT src, dst, 'trace_call', weight, 1 FROM trace) SELECT src, dst, kind, weight FROM b QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY p, kind) = 1",
)
def neighbor_edges(spark, sf):
    return graph.neighbor_edges(d.edges(spark, sf), d.trace_edges(spark, sf))


@register("cluster_modules", f"WITH {d.NODES} SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) AS module, count(*) AS n FROM nodes GROUP BY 1")
def cluster_modules(spark, sf):
    return graph.cluster_modules(d.nodes(spark, sf), d.edges(spark, sf))[0]


@register(
    "cluster_edges",
    f"WITH {d.NODES}, {d.EDGES}, m AS (SELECT id, regexp_extract(file, '^(.*)/[^/]*$', 1) AS module FROM nodes) SELECT a.module AS src, b.module AS dst, sum(weight)::BIGINT AS weight FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.module <> b.module GROUP BY ALL",
)
def cluster_edges(spark, sf):
    return graph.cluster_modules(d.nodes(spark, sf), d.edges(spark, sf))[1]


@register("scope_filtered_neighbors", f"WITH {d.EDGES} SELECT src, dst, kind, weight FROM edges WHERE (src = 'nation' OR starts_with(src, 'nation/')) AND (dst = 'region' OR starts_with(dst, 'region/'))")
def scope_filtered_neighbors(spark, sf):
    return d.edges(spark, sf).where(graph.in_scope("src", "nation") & graph.in_scope("dst", "region"))


@register("hub_nodes", f"WITH {d.EDGES} SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY dst HAVING count(*) >= 25")
def hub_nodes(spark, sf):
    return graph.hub_nodes(d.edges(spark, sf), 25)


@register(
    "lane_components",
    f"""WITH RECURSIVE {d.NODES}, {d.EDGES}, {reverse_walk("('customer/1'), ('customer/2'), ('customer/3'), ('customer/21'), ('part/5'), ('part/6'), ('nation/7')", 1)},
    marks AS (SELECT DISTINCT root, unnest(['s:' || s.id, 'f:' || n.file]) AS mark FROM seen s LEFT JOIN nodes n ON n.id = s.id), links AS (SELECT DISTINCT a.root AS x, b.root AS y FROM marks a JOIN marks b USING (mark)),
    c AS (SELECT root AS node, root AS lane FROM marks UNION SELECT l.y, c.lane FROM c JOIN links l ON l.x = c.node) SELECT node AS seed, min(lane) AS lane FROM c GROUP BY node""",
)
def lane_components(spark, sf):
    seeds = spark.createDataFrame([(s,) for s in ("customer/1", "customer/2", "customer/3", "customer/21", "part/5", "part/6", "nation/7")], "seed string")
    return graph.plan_lanes(d.edges(spark, sf), d.nodes(spark, sf), seeds, 1)


@register(
    "name_unique_resolution",
    f"""WITH {d.NODES}, p AS (SELECT id, file, regexp_extract(file, '^([^/]*)', 1) AS package, split_part(name, '#', 1) || '_' || (key % 3000) AS name FROM nodes),
    l AS (SELECT file, name, min(id) AS target FROM p GROUP BY ALL HAVING count(DISTINCT id) = 1), g AS (SELECT package, name, min(id) AS target FROM p GROUP BY ALL HAVING count(DISTINCT id) = 1),
    r AS (SELECT p.file, p.package, p.name, count(*) AS n FROM p GROUP BY ALL)
    SELECT r.file, r.package, r.name, r.n, coalesce(l.target, g.target, '?:' || r.name) AS target FROM r LEFT JOIN l USING (file, name) LEFT JOIN g USING (package, name)""",
)
def name_unique_resolution(spark, sf):
    n = d.nodes(spark, sf).select("id", "file", F.regexp_extract("file", "^([^/]*)", 1).alias("package"), F.concat(F.substring_index("name", "#", 1), F.lit("_"), F.col("key") % 3000).alias("name"))
    raw = n.groupBy("file", "package", "name").agg(F.count("*").alias("n"))
    return resolve.resolve_names(raw, n)


_RUNTIME = """rn AS (SELECT DISTINCT regexp_replace(file, '\\.py$', '') || '/' || CASE WHEN kind = 'method' THEN 'Cat.' ELSE '' END || 'e' || (key % 400) AS id, 'e' || (key % 400) AS name, CASE WHEN kind = 'method' THEN 'Cat.' ELSE '' END || 'e' || (key % 400) AS qn FROM nodes WHERE kind IN ('function', 'method')),
    raws AS (SELECT DISTINCT unnest(['geo::x.e' || (key % 400), 'app/sales/customer_' || (key % 20) || '.py:e' || (key % 400), 'catalog.part_' || (key % 7) || '.Cat.e' || (key % 400), 'e' || (key % 450)]) AS raw FROM nodes WHERE kind IN ('function', 'method'))"""


@register(
    "hint_resolution",
    f"""WITH {d.NODES}, {_RUNTIME}, g AS (SELECT raw, list_filter(string_split(regexp_replace(raw, '::|[.:/]', chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM raws),
    ids AS (SELECT id, name, qn, list_filter(string_split(regexp_replace(id, '[.:/]', chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM rn),
    lv AS (SELECT raw, 2 AS lv, s[-2] || '.' || s[-1] AS k, s[:-3] AS h FROM g WHERE len(s) >= 2 UNION ALL SELECT raw, 3, s[-3] || '.' || s[-2] || '.' || s[-1], s[:-4] FROM g WHERE len(s) >= 3 UNION ALL SELECT raw, 9, s[-1], s[:-2] FROM g),
    c AS (SELECT raw, lv, list_filter(coalesce(h, []), lambda x: x NOT IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'mts', 'cts', 'py', 'rs', 'go')) AS h, id, ss FROM lv JOIN ids ON (lv.lv < 9 AND ids.qn = lv.k) OR (lv.lv = 9 AND ids.name = lv.k)),
    sc AS (SELECT raw, lv, id, coalesce(list_max(list_filter(range(1, len(h) + 1), lambda L: len(list_filter(range(1, len(ss) - L + 2), lambda i: ss[i:i + L - 1] = h[len(h) - L + 1:])) > 0)), 0) AS run, len(list_filter(ss, lambda x: list_contains(h, x))) AS shared, count(*) OVER (PARTITION BY raw, lv) AS n FROM c),
    rk AS (SELECT *, rank() OVER (PARTITION BY raw, lv ORDER BY run DESC, shared DESC) AS r FROM sc),
    best AS (SELECT raw, lv, min(id) AS id, max(n) AS n, count(*) AS tied, max(run) AS run, max(shared) AS shared FROM rk WHERE r = 1 GROUP BY raw, lv), ok AS (SELECT raw, lv, id FROM best WHERE n = 1 OR (tied = 1 AND (run > 0 OR shared > 0)))
    SELECT raws.raw, arg_min(ok.id, ok.lv) AS id FROM raws LEFT JOIN ok USING (raw) GROUP BY raws.raw""",
)
def hint_resolution(spark, sf):
    n = d.nodes(spark, sf).where("kind in ('function', 'method')")
    e = F.concat(F.when(F.col("kind") == "method", "Cat.").otherwise(""), F.lit("e"), F.col("key") % 400)
    p = n.select(F.concat(F.regexp_replace("file", r"\.py$", ""), F.lit("/"), e).alias("id"), F.concat(F.lit("e"), F.col("key") % 400).alias("name"), e.alias("qualified_name")).distinct()
    leaf = F.concat(F.lit("e"), F.col("key") % 400)
    forms = [F.concat(F.lit("geo::x."), leaf), F.concat(F.lit("app/sales/customer_"), F.col("key") % 20, F.lit(".py:"), leaf), F.concat(F.lit("catalog.part_"), F.col("key") % 7, F.lit(".Cat."), leaf), F.concat(F.lit("e"), F.col("key") % 450)]
    return resolve.resolve_runtime(n.select(F.explode(F.array(*forms)).alias("raw")).distinct(), p)


@register(
    "unresolved_retry",
    f"""WITH {d.NODES}, {d.EDGES}, x AS (SELECT src, CASE WHEN dst LIKE 'supplier/%' THEN '?:' || n.name ELSE e.dst END AS dst, 'static_call' AS kind, weight FROM edges e JOIN nodes n ON n.id = e.dst),
    u AS (SELECT name, min(id) AS target FROM nodes GROUP BY name HAVING count(*) = 1)
    SELECT src, coalesce(CASE WHEN u.target <> src THEN u.target END, dst) AS dst, kind, sum(weight)::BIGINT AS weight FROM x LEFT JOIN u ON x.dst = '?:' || u.name GROUP BY ALL""",
)
def unresolved_retry(spark, sf):
    n = d.nodes(spark, sf)
    e = d.edges(spark, sf).join(n.select(F.col("id").alias("dst"), "name"), "dst")
    e = e.select("src", F.when(F.col("dst").startswith("supplier/"), F.concat(F.lit("?:"), "name")).otherwise(F.col("dst")).alias("dst"), F.lit("static_call").alias("kind"), "weight")
    return resolve.retry_unresolved(e, n)


@register(
    "package_of_file",
    f"WITH {d.NODES}, f AS (SELECT DISTINCT 'repo/' || file AS file FROM nodes), p(dir) AS (VALUES ('repo'), ('repo/sales'), ('repo/geo'), ('repo/ge')) SELECT f.file, coalesce(arg_max(dir, length(dir)), '') AS package FROM f LEFT JOIN p ON starts_with(f.file, p.dir || '/') GROUP BY f.file",
)
def package_of_file(spark, sf):
    files = d.nodes(spark, sf).select(F.concat(F.lit("repo/"), "file").alias("file")).distinct()
    return resolve.package_of(files, spark.createDataFrame([("repo",), ("repo/sales",), ("repo/geo",), ("repo/ge",)], "dir string"))


@register(
    "relative_imports",
    """WITH f AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS file FROM pages), files AS (SELECT rtrim(file, '/') || '/index.js' AS file FROM f),
    i AS (SELECT DISTINCT 'x/y/z.js' AS file, '../../' || f.file AS specifier FROM f), b AS (SELECT *, trim(regexp_replace(substr(specifier, 7), '/+', '/', 'g'), '/') AS base FROM i)
    SELECT b.file, b.specifier, CASE WHEN EXISTS (SELECT 1 FROM files WHERE files.file = b.base) THEN b.base WHEN EXISTS (SELECT 1 FROM files WHERE files.file = b.base || '/index.js') THEN b.base || '/index.js' END AS target FROM b""",
)
def relative_imports(spark, sf):
    f = d.table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1).alias("p")).distinct()
    files = f.select(F.concat(F.rtrim("p", F.lit("/")), F.lit("/index.js")).alias("file"))
    imports = f.select(F.lit("x/y/z.js").alias("file"), F.concat(F.lit("../../"), "p").alias("specifier")).distinct()
    return resolve.resolve_relative(imports, files)


IS_TEST = "(starts_with(file, 'tests/') OR starts_with(file, 'test/') OR contains(file, '/test/') OR contains(file, '/tests/') OR contains(file, '_test.') OR contains(file, 'test_') OR regexp_matches(name, '^test_|_test'))"
INDEX = f"{d.COVERAGE}, idx AS (SELECT e.id AS entity, t.id AS test, sum(weight)::BIGINT AS weight FROM coverage c JOIN nodes t ON t.name = c.test JOIN nodes e ON e.id = c.entity GROUP BY ALL)"


@register("coverage_index", f"WITH {d.NODES}, {INDEX} SELECT entity, test, weight FROM idx")
def coverage_index(spark, sf):
    return select_tests.coverage_index(d.coverage(spark, sf), d.nodes(spark, sf))


def _affected_sql(ids: str, depth: int) -> str:
    return f"""{d.NODES}, {d.EDGES}, {d.TRACE}, {INDEX}, both_e AS (SELECT src, dst, FALSE AS traced, weight FROM edges UNION ALL SELECT src, dst, TRUE, weight FROM trace), {reverse_walk(ids, depth, 'both_e')},
    relaxed AS (SELECT s.root, e.src AS id, bool_or(traced) AS vt, max(weight) FILTER (WHERE traced) AS tw, max(weight) FILTER (WHERE NOT traced) AS sw FROM seen s JOIN both_e e ON e.dst = s.id WHERE s.depth < {depth} AND e.src <> s.root GROUP BY ALL),
    u AS (SELECT s.id, s.depth, vt, tw, sw, FALSE AS observed FROM seen s JOIN relaxed USING (root, id) WHERE s.depth > 0 UNION ALL SELECT test, 1, TRUE, weight, NULL, TRUE FROM idx WHERE entity IN (SELECT root FROM seen)),
    m AS (SELECT id, min(depth)::INT AS depth, bool_or(vt) AS vt, max(tw) AS tw, max(sw) AS sw, bool_or(observed) AS observed FROM u WHERE id NOT IN (SELECT root FROM seen) GROUP BY id),
    a AS (SELECT m.id, depth, CASE WHEN vt THEN 'trace' ELSE 'static' END AS evidence, coalesce(CASE WHEN vt THEN tw ELSE sw END, 0)::BIGINT AS weight, CASE WHEN observed THEN 'observed' ELSE 'reachable' END AS confidence FROM m JOIN nodes USING (id) WHERE {IS_TEST})"""


def _affected(spark, sf, ids, depth):
    n = d.nodes(spark, sf)
    return select_tests.affected_tests(d.edges(spark, sf), d.trace_edges(spark, sf), select_tests.coverage_index(d.coverage(spark, sf), n), n, roots(spark, *ids), depth)


@register("affected_tests", f"WITH RECURSIVE {_affected_sql("('supplier/1')", 2)} SELECT a.*, row_number() OVER (ORDER BY confidence <> 'observed', evidence <> 'trace', depth, weight DESC, id)::INT AS rank FROM a")
def affected_tests(spark, sf):
    return select_tests.ranked(_affected(spark, sf, ["supplier/1"], 2))


@register("affected_tests_files", f"WITH RECURSIVE {_affected_sql("('part/3'), ('part/23'), ('part/43')", 4)} SELECT * FROM a")
def affected_tests_files(spark, sf):
    return _affected(spark, sf, ["part/3", "part/23", "part/43"], 4)


@register(
    "hub_fraction",
    f"WITH RECURSIVE {d.NODES}, {d.EDGES}, {reverse_walk("('nation/1'), ('supplier/1'), ('part/1')", 3)}, total AS (SELECT count(*) AS n FROM nodes WHERE {IS_TEST}), p AS (SELECT root, count(DISTINCT id) AS affected FROM seen JOIN nodes USING (id) WHERE depth > 0 AND {IS_TEST} GROUP BY root) SELECT root, affected, n AS total, round(affected / n, 6) AS fraction, affected / n >= 0.3 AS hub FROM p, total",
)
def hub_fraction(spark, sf):
    n = d.nodes(spark, sf)
    tests = n.where(select_tests.is_test(F.col("file"), F.col("name"))).select("id")
    hit = graph.impact(d.edges(spark, sf), roots(spark, "nation/1", "supplier/1", "part/1"), 3).join(tests, "id", "left_semi")
    return select_tests.hub_fraction(hit, n)


NOW = 1_710_000_000_000
_TESTS_SQL = f"""t AS (SELECT 't' || event_id AS id, CASE WHEN event_type = 'error' THEN 'trace' ELSE 'static' END AS evidence, (event_id % 5 + 1)::INT AS depth, floor(value)::DOUBLE AS weight,
    CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 END AS last_failed_at, CASE WHEN event_id % 4 <> 0 THEN (event_id % 700)::DOUBLE END AS last_duration_ms FROM events)"""
_PRIOR_SQL = f"""{_TESTS_SQL}, s AS (SELECT *, round(CASE WHEN last_failed_at IS NULL THEN 0.0 ELSE pow(2.0, -greatest(0.0, ({NOW} - last_failed_at) / 86400000.0) / 7.0) END + 0.6 / greatest(1, depth) + 0.4 * weight / (weight + 4), 9) AS score, coalesce(last_duration_ms, (SELECT avg(last_duration_ms) FROM t)) AS duration FROM t),
    p AS (SELECT id, evidence, score, row_number() OVER (ORDER BY evidence <> 'trace', score DESC, duration, id)::INT AS position FROM s)"""


def _tests(spark, sf):
    e = d.table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("t"), "event_id").alias("id"),
        F.when(F.col("event_type") == "error", "trace").otherwise("static").alias("evidence"),
        (F.col("event_id") % 5 + 1).cast("int").alias("depth"),
        F.floor("value").cast("double").alias("weight"),
        F.when(F.col("event_id") % 3 == 0, F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_failed_at"),
        F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 700).cast("double")).alias("last_duration_ms"),
    )


@register("prioritized_tests", f"WITH {_PRIOR_SQL} SELECT id, evidence, round(score, 6) AS score, position FROM p")
def prioritized_tests(spark, sf):
    return select_tests.prioritize(_tests(spark, sf), NOW).select("id", "evidence", F.round("score", 6).alias("score"), "position")


@register(
    "apfd",
    f"WITH {_PRIOR_SQL}, n AS (SELECT count(*) AS n FROM p), f AS (SELECT 'f' || user_id AS fault, 't' || event_id AS id FROM events WHERE event_type = 'error' OR event_id % 11 = 0), x AS (SELECT fault, coalesce(min(position), (SELECT n FROM n) + 1) AS pos FROM f LEFT JOIN p USING (id) GROUP BY fault) SELECT n, count(*) AS m, round(1 - sum(pos) / (n * count(*)) + 1 / (2 * n), 6) AS apfd FROM x, n GROUP BY n",
)
def apfd(spark, sf):
    p = select_tests.prioritize(_tests(spark, sf), NOW).select("id", "position")
    faults = d.table(spark, sf, "events").where("event_type = 'error' or event_id % 11 = 0").select(F.concat(F.lit("f"), "user_id").alias("fault"), F.concat(F.lit("t"), "event_id").alias("id"))
    return select_tests.apfd(p, faults)


@register("test_classification", f"WITH {d.NODES} SELECT file, count(*) AS n, count(*) FILTER (WHERE {IS_TEST}) AS tests, 'pytest' AS runner FROM nodes GROUP BY file")
def test_classification(spark, sf):
    from ..functions.names import is_test, runner

    n = d.nodes(spark, sf)
    return n.groupBy("file").agg(F.count("*").alias("n"), F.count(F.when(is_test(F.col("file"), F.col("name")), 1)).alias("tests"), F.first(runner(F.col("file"))).alias("runner"))
