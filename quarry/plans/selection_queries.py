"""Registered queries on search and test selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import graph, search, select_tests
from ..sources import derived as d
from . import registry
from .graph_queries import INDEX, IS_TEST, reverse_walk, roots

QUERIES, SQL, register = registry.new()

# Test selection. Suppliers are the members of one class a file, so a class of siblings is a file's suppliers.


def _nodes(spark, sf):
    qualified = F.when(F.col("id").startswith("supplier/"), F.concat(F.lit("Vendor."), "name")).otherwise(F.col("name"))
    return d.nodes(spark, sf).withColumn("qualified_name", qualified)


def _selected(spark, sf, ids, depth, **how):
    n = _nodes(spark, sf)
    index = select_tests.coverage_index(d.coverage(spark, sf), n)
    return select_tests.select_tests(d.edges(spark, sf), d.trace_edges(spark, sf), index, n, roots(spark, *ids), depth, **how)


def _selection_sql(ids: list[str], depth: int, rollup: bool = False, only: str = "TRUE", extra: str = "", note: str = select_tests.PRECISE_NOTE) -> str:
    values = ", ".join(f"('{i}')" for i in ids)
    more = "UNION ALL SELECT test, NULL, TRUE, max(weight), NULL, FALSE FROM idx JOIN sib ON sib.id = entity WHERE test NOT IN (SELECT root FROM seen) GROUP BY test" if rollup else ""
    return f"""WITH RECURSIVE {d.NODES}, {d.EDGES}, {d.TRACE}, {INDEX}, both_e AS (SELECT src, dst, FALSE AS traced, weight FROM edges UNION ALL SELECT src, dst, TRUE, weight FROM trace), {reverse_walk(values, depth, 'both_e')},
    sw AS (SELECT id AS root, id, 0 AS depth FROM (VALUES {values}) t(id) UNION SELECT sw.root, e.src, sw.depth + 1 FROM sw JOIN edges e ON e.dst = sw.id WHERE sw.depth < {depth}), st AS (SELECT DISTINCT id FROM sw WHERE depth > 0),
    relaxed AS (SELECT s.root, e.src AS id, bool_or(traced) AS vt, max(weight) FILTER (WHERE traced) AS tw, max(weight) FILTER (WHERE NOT traced) AS sw FROM seen s JOIN both_e e ON e.dst = s.id WHERE s.depth < {depth} AND e.src <> s.root GROUP BY ALL),
    sib AS (SELECT id FROM nodes WHERE id LIKE 'supplier/%' AND file IN (SELECT file FROM nodes WHERE id LIKE 'supplier/%' AND id IN (SELECT root FROM seen)) AND id NOT IN (SELECT root FROM seen)),
    u AS (SELECT s.id, s.depth, vt, tw, sw, FALSE AS observed FROM seen s JOIN relaxed USING (root, id) WHERE s.depth > 0 UNION ALL SELECT test, 1, TRUE, weight, NULL, TRUE FROM idx WHERE entity IN (SELECT root FROM seen) {more}),
    m AS (SELECT id, coalesce(min(depth), 1)::INT AS depth, bool_or(vt) AS vt, max(tw) AS tw, max(sw) AS sw, bool_or(observed) AS observed FROM u WHERE id NOT IN (SELECT root FROM seen) GROUP BY id),
    a AS (SELECT m.id, depth, CASE WHEN vt THEN 'trace' ELSE 'static' END AS evidence, coalesce(CASE WHEN vt THEN tw ELSE sw END, 0)::BIGINT AS weight, CASE WHEN observed THEN 'observed' ELSE 'reachable' END AS confidence, st.id IS NOT NULL AS static_reachable, vt AND st.id IS NULL AS dispatch_only FROM m JOIN nodes USING (id) LEFT JOIN st USING (id) WHERE {IS_TEST}),
    o AS (SELECT * FROM a WHERE {only} {extra}) SELECT *, row_number() OVER (ORDER BY NOT dispatch_only, confidence <> 'observed', evidence <> 'trace', depth, weight DESC, id)::INT AS rank, '{note}' AS note FROM o"""


@register("tests_of_symbol", _selection_sql(["supplier/2"], 2))
def tests_of_symbol(spark, sf):
    return _selected(spark, sf, ["supplier/2"], 2)


@register("tests_observed_only", _selection_sql(["supplier/1", "supplier/3"], 3, only="confidence = 'observed'"))
def tests_observed_only(spark, sf):
    return _selected(spark, sf, ["supplier/1", "supplier/3"], 3, trace_only=True)


@register("tests_with_class_rollup", _selection_sql(["supplier/4"], 1, rollup=True))
def tests_with_class_rollup(spark, sf):
    return _selected(spark, sf, ["supplier/4"], 1, rollup=True)


@register("tests_reachable_fallback", _selection_sql(["part/3"], 3, only="confidence = 'observed' OR NOT EXISTS (SELECT 1 FROM a WHERE confidence = 'observed')", note=select_tests.FALLBACK_NOTE))
def tests_reachable_fallback(spark, sf):
    return _selected(spark, sf, ["part/3"], 3, trace_only=True, fallback=True)


@register("tests_of_files_fallback", _selection_sql(["part/3", "supplier/1"], 1, only="confidence = 'observed'", extra="UNION ALL SELECT id, 1 AS depth, 'static', (SELECT max(weight) FROM edges e WHERE e.src = a.id AND e.dst = 'part/3')::BIGINT, 'reachable', static_reachable, FALSE FROM a WHERE confidence <> 'observed' AND id IN (SELECT src FROM edges WHERE dst = 'part/3')", note=select_tests.FALLBACK_NOTE))
def tests_of_files_fallback(spark, sf):
    return _selected(spark, sf, ["part/3", "supplier/1"], 1, trace_only=True, fallback=True, by_root=True)


_CANDIDATES = """cand AS (SELECT o_orderkey AS k, (['tests/test_a.py', 'tests/conftest.py', 'src/b_test.py', 'pkg/c_test.go', 'web/d.spec.ts', 'jest/e.test.js', 'tests/f.rs', 'src/g.py'])[o_orderkey % 8 + 1] AS file,
    (['test_x', 'TestFoo.test_y', 'Helper.send', 'test', 'TestBar', 'testCamel', 'run.<locals>.test_z', 'TestExecute', 'plain', 'pkg.TestQ.test_m'])[o_orderkey % 10 + 1] AS name, CASE WHEN o_orderkey % 13 = 0 THEN 'module' ELSE 'function' END AS kind FROM orders),
    cn AS (SELECT *, 's/' || k || '/' || name AS id FROM cand)"""
_PY = r"regexp_matches(regexp_extract(file, '([^/]*)$', 1), '^test_.*\.py$|_test\.py$')"
_NAME_RULE = "|".join(names.TEST_NAMES.values())
_LEAF = "regexp_extract(name, '([^.]*)$', 1)"


@register(
    "runnable_tests",
    f"""WITH {_CANDIDATES}, t AS (SELECT *, {_LEAF} AS leaf, regexp_extract(name, '([^.]*)\\.[^.]*$', 1) AS owner FROM cn WHERE {IS_TEST.split(' OR regexp_matches')[0]} OR contains(file, '.test.') OR contains(file, '.spec.') OR regexp_matches(name, '{_NAME_RULE}') OR regexp_matches({_LEAF}, '{_NAME_RULE}'))),
    r AS (SELECT *, CASE WHEN file LIKE '%.py' THEN 'pytest' WHEN file LIKE '%.ts' OR file LIKE '%.js' THEN CASE WHEN contains(file, 'jest') THEN 'jest' ELSE 'vitest' END WHEN file LIKE '%.go' THEN 'go' ELSE 'cargo' END AS runner FROM t)
    SELECT id, runner, CASE WHEN runner = 'pytest' THEN CASE WHEN kind = 'module' THEN CASE WHEN {_PY} THEN file END
        WHEN {_PY} AND NOT contains(name, '.<locals>.') AND leaf <> 'test' AND (NOT contains(name, '.') OR owner LIKE 'Test%') AND regexp_matches(leaf, '^[tT]est') THEN CASE WHEN regexp_matches(owner, '^[A-Z]') THEN file || '::' || owner || '::' || leaf ELSE file || '::' || name END END
      WHEN runner = 'go' AND kind <> 'module' AND regexp_matches(leaf, '{names.TEST_NAMES["go"]}') THEN file || '::' || leaf ELSE file END AS runnable FROM r""",
)
def runnable_tests(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda options: F.element_at(F.array(*[F.lit(o) for o in options]), (k % len(options) + 1).cast("int"))
    files = ["tests/test_a.py", "tests/conftest.py", "src/b_test.py", "pkg/c_test.go", "web/d.spec.ts", "jest/e.test.js", "tests/f.rs", "src/g.py"]
    name = ["test_x", "TestFoo.test_y", "Helper.send", "test", "TestBar", "testCamel", "run.<locals>.test_z", "TestExecute", "plain", "pkg.TestQ.test_m"]
    c = d.table(spark, sf, "orders").select(k.alias("k"), pick(files).alias("file"), pick(name).alias("name"), F.when(k % 13 == 0, "module").otherwise("function").alias("kind"))
    return select_tests.runnable_tests(c.withColumn("id", F.concat(F.lit("s/"), "k", F.lit("/"), "name")))


@register(
    "ci_selection",
    f"WITH {d.NODES}, ch AS (SELECT DISTINCT file FROM nodes WHERE key % 3 = 1), s AS (SELECT DISTINCT 'tests/test_orders_' || (o_orderkey % 20) || '.py::' || 'test_order_' || o_orderkey AS r FROM orders WHERE o_orderkey % 10 = 0) SELECT 'selected' AS mode, 'selected' AS reason, r AS runnable FROM s UNION SELECT 'selected', 'selected', file FROM ch WHERE regexp_matches(file, '(^|/)tests?/')",
)
def ci_selection(spark, sf):
    n = d.nodes(spark, sf)
    changed = n.where("key % 3 = 1").select("file")
    picked = n.where("kind = 'function' and key % 10 = 0").where(F.col("id").startswith("order/")).select(F.concat("file", F.lit("::"), "name").alias("runnable"))
    return select_tests.ci_selection(changed, n, picked)


# Search over nodes with a summary


def _named(spark, sf):
    n = d.nodes(spark, sf)
    summary = F.when(F.col("key") % 3 == 0, F.concat(F.lit("Handles "), F.lower("name"), F.lit(" requests"))).when(F.col("key") % 3 == 1, F.lit(""))
    return n.withColumn("qualified_name", F.concat(F.lit("repo."), "name")).withColumn("summary", summary)


_NAMED = f"""{d.NODES}, {d.EDGES}, sn AS (SELECT id, file, kind, key, lower(name) AS c1, lower('repo.' || name) AS c2, CASE WHEN key % 3 = 0 THEN lower('Handles ' || lower(name) || ' requests') ELSE '' END AS c3, lower(translate(file || ' ' || id, '/.-_', '    ')) AS c4 FROM nodes)"""


def _ranked_sql(terms: list[str], hit: str, limit: int, where: str = "TRUE") -> str:
    """The search in SQL: ``hit`` says of a row's text x whether it matches."""
    occurs = lambda c, t: f"len(list_filter(range(1, length({c}) - {len(t) - 2}), lambda i: substr({c}, i, {len(t)}) = '{t}'))"
    tf = ", ".join(f"{' + '.join(occurs(c, t) for c in ('c1', 'c2', 'c3'))} + 0.35 * {occurs('c4', t)} AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / mean))" for i in range(len(terms)))
    scaffold = "(file ILIKE 'tests/%' OR file ILIKE '%/tests/%' OR file ILIKE 'test\\_%.py' ESCAPE '\\' OR file ILIKE '%/test\\_%.py' ESCAPE '\\')"
    return f"""WITH {_NAMED}, tf AS (SELECT id, file, kind, c1 || chr(10) || c2 || chr(10) || c3 || chr(10) || c4 AS x, greatest(length(c1) - 2, 0) + greatest(length(c2) - 2, 0) + greatest(length(c3) - 2, 0) + greatest(length(c4) - 2, 0) AS l, {tf} FROM sn),
    fs AS (SELECT count(*) AS n, avg(l) AS mean, {df} FROM tf), sc AS (SELECT id, file, kind, round(-({score}), 6) AS score FROM tf, fs WHERE ({hit}) AND {where}),
    pool AS (SELECT * FROM sc ORDER BY score, id LIMIT {max(50, 4 * limit)}), dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
    fin AS (SELECT pool.id, kind, score, coalesce(degree, 0)::BIGINT AS degree, round(score - 0.30 * ln(1 + coalesce(degree, 0)) + CASE WHEN {scaffold} THEN 1.0 ELSE 0.0 END, 6) AS final FROM pool LEFT JOIN dg USING (id) ORDER BY final, score, pool.id LIMIT {limit})"""


def _shown(df):
    return df.select("id", F.round("score", 3).alias("score"), "degree", F.round("final", 3).alias("final"))


_SHOW = "SELECT id, round(score, 3) AS score, degree, round(final, 3) AS final FROM fin"
_HAS = "contains(x, '{0}')"


@register("ranked_symbol_search", _ranked_sql(["customer", "000"], "contains(x, 'customer') AND contains(x, '000')", 20) + _SHOW)
def ranked_symbol_search(spark, sf):
    return _shown(search.ranked_search(_named(spark, sf), d.edges(spark, sf), "Customer 000"))


@register("relaxed_symbol_search", _ranked_sql(["supplier", "zzqq"], "contains(x, 'supplier') OR contains(x, 'zzqq')", 10) + _SHOW)
def relaxed_symbol_search(spark, sf):
    return _shown(search.ranked_search(_named(spark, sf), d.edges(spark, sf), "how does the supplier zzqq", 10))


@register("scoped_symbol_search", _ranked_sql(["test"], "contains(x, 'test')", 12, "starts_with(file, 'tests/test_orders_1')") + _SHOW)
def scoped_symbol_search(spark, sf):
    return _shown(search.ranked_search(_named(spark, sf), d.edges(spark, sf), "test", 12, path=" tests/test_orders_1/ "))


@register("semantic_symbol_search", _ranked_sql(["nosuch", "requests"], "contains(x, 'nosuch') OR contains(x, 'requests')", 15) + _SHOW)
def semantic_symbol_search(spark, sf):
    return _shown(search.ranked_search(_named(spark, sf), d.edges(spark, sf), "nosuch", 15, semantic=["requests", "qq"]))


@register("degree_rerank_search", _ranked_sql(["part"], "contains(x, 'part')", 20) + _SHOW)
def degree_rerank_search(spark, sf):
    return _shown(search.ranked_search(_named(spark, sf), d.edges(spark, sf), "part"))


@register("task_symbols", _ranked_sql(["nation"], "contains(x, 'nation')", 20) + "SELECT id, round(score, 3) AS score, round(final, 3) AS final FROM fin WHERE kind <> 'module' ORDER BY final, score, id LIMIT 3")
def task_symbols(spark, sf):
    out = search.task_symbols(_named(spark, sf), d.edges(spark, sf), "what is the nation")
    return out.select("id", F.round("score", 3).alias("score"), F.round("final", 3).alias("final"))


@register("resolved_node", _ranked_sql(["asia"], "contains(x, 'asia')", 1) + ", ex AS (SELECT 'part/7' AS asked, id, TRUE AS exact FROM nodes WHERE id = 'part/7') SELECT * FROM ex UNION ALL SELECT 'asia', id, FALSE FROM fin")
def resolved_node(spark, sf):
    n, e = _named(spark, sf), d.edges(spark, sf)
    return search.resolve_node(n, e, "part/7").union(search.resolve_node(n, e, "asia")).union(search.resolve_node(n, e, "regoin/ASIA"))


_WORDS = "(['authHandler retries twice', 'cfg is cached', 'the database index', 'message parser drops blanks', 'handler for auth tokens'])"


@register("note_search", f"WITH n AS (SELECT event_id AS id, {_WORDS}[event_id % 5 + 1] AS note, epoch_us(ts) // 1000 AS created, CASE WHEN event_id % 4 = 0 THEN 86400 * (event_id % 9) END AS ttl FROM events) SELECT id, created FROM n WHERE (contains(lower(note), 'auth') OR contains(lower(note), 'authentication')) AND contains(lower(note), 'handler') AND (ttl IS NULL OR created + ttl * 1000 >= 1706000000000) ORDER BY created DESC, id LIMIT 100")
def note_search(spark, sf):
    k = F.col("event_id")
    words = ["authHandler retries twice", "cfg is cached", "the database index", "message parser drops blanks", "handler for auth tokens"]
    n = d.table(spark, sf, "events").select(k.alias("id"), F.element_at(F.array(*[F.lit(w) for w in words]), (k % 5 + 1).cast("int")).alias("note"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created"), F.when(k % 4 == 0, 86400 * (k % 9)).alias("ttl"))
    return search.search_notes(n, "auth handler", 1_706_000_000_000).select("id", "created")


# Neighbourhoods as a viewer asks for them


@register(
    "neighborhood_edges",
    f"WITH RECURSIVE {d.NODES}, {d.EDGES}, {d.TRACE}, pairs AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM trace), both_ways AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs), {reverse_walk("('supplier/5'), ('part/9')", 1, 'both_ways')}, one AS (SELECT src, dst, kind, weight FROM (SELECT src, dst, kind, weight, 0 AS p FROM edges UNION ALL SELECT src, dst, 'trace_call', weight, 1 FROM trace) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY p, kind) = 1) SELECT a.root, src, dst, kind, weight FROM one JOIN seen a ON a.id = src JOIN seen b ON b.id = dst AND b.root = a.root",
)
def neighborhood_edges(spark, sf):
    return graph.neighborhood(d.edges(spark, sf), d.trace_edges(spark, sf), d.nodes(spark, sf), roots(spark, "supplier/5", "part/9"))[1]


@register(
    "neighborhood_nodes",
    f"WITH RECURSIVE {d.NODES}, {d.EDGES}, {d.TRACE}, pairs AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM trace), both_ways AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs), {reverse_walk("('nation/4'), ('ghost/1')", 1, 'both_ways')} SELECT root, seen.id, depth::INT AS depth, coalesce(name, seen.id) AS name, coalesce(kind, 'unknown') AS kind FROM seen LEFT JOIN nodes USING (id)",
)
def neighborhood_nodes(spark, sf):
    return graph.neighborhood(d.edges(spark, sf), d.trace_edges(spark, sf), d.nodes(spark, sf), roots(spark, "nation/4", "ghost/1"))[0]


@register("scoped_edges", f"WITH {d.EDGES}, x AS (SELECT replace(src, 'order/1', 'a/o/1') AS src, replace(dst, 'part/1', 'a/p/1') AS dst, kind, weight FROM edges) SELECT * FROM x WHERE (src = 'a' OR starts_with(src, 'a/')) AND (dst = 'a' OR starts_with(dst, 'a/'))")
def scoped_edges(spark, sf):
    e = d.edges(spark, sf)
    return graph.scoped_edges(e.select(F.replace("src", F.lit("order/1"), F.lit("a/o/1")).alias("src"), F.replace("dst", F.lit("part/1"), F.lit("a/p/1")).alias("dst"), "kind", "weight"), "a")


@register("viewport_tiers", "SELECT 'customer/' || c_custkey AS id, CASE WHEN c_custkey IN (7, 8) THEN 2 ELSE 1 END AS tier FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 3 AND 9")
def viewport_tiers(spark, sf):
    n = d.table(spark, sf, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    return graph.level_of_detail(graph.visible(n, 0, 3, 5000, 9), 1.5, ["customer/7", "customer/8"]).select("id", "tier")


@register("scaffold_files", f"WITH {d.NODES}, f AS (SELECT DISTINCT CASE key % 4 WHEN 0 THEN file WHEN 1 THEN 'bench/' || file WHEN 2 THEN replace(file, '.py', '.mock.py') ELSE 'x/__Mocks__/' || file END AS file FROM nodes) SELECT file, file ILIKE 'tests/%' OR file ILIKE '%/tests/%' OR file ILIKE '%/test\\_%.py' ESCAPE '\\' AS is_test, file ILIKE 'tests/%' OR file ILIKE '%/tests/%' OR file ILIKE '%/test\\_%.py' ESCAPE '\\' OR file LIKE 'bench/%' OR file LIKE '%.mock.%' OR file ILIKE '%/__mocks__/%' AS scaffold FROM f")
def scaffold_files(spark, sf):
    k, f = F.col("key"), F.col("file")
    n = d.nodes(spark, sf).select(F.when(k % 4 == 0, f).when(k % 4 == 1, F.concat(F.lit("bench/"), f)).when(k % 4 == 2, F.replace(f, F.lit(".py"), F.lit(".mock.py"))).otherwise(F.concat(F.lit("x/__Mocks__/"), f)).alias("file")).distinct()
    return n.select("file", names.test_path(F.col("file")).alias("is_test"), names.scaffold_path(F.col("file")).alias("scaffold"))
