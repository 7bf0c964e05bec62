"""Operators on the small fixtures of the design notes."""

from __future__ import annotations

import hashlib
import math
import random

from pyspark.sql import functions as F

from quarry.functions import names
import pytest

from quarry.operators import calls, claims, context, crdt, graph, maintain, pack, profiles, relational, resolve, search, select_tests
from quarry.sources import code, markdown, oplog, repo
from quarry.streaming import events

EDGE = "src string, dst string, kind string, weight long"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_walk_on_a_cycle_keeps_least_depths(spark):
    e = spark.createDataFrame([("b", "a", "static_call", 1), ("c", "b", "import", 1), ("a", "c", "static_call", 1), ("c", "a", "other", 1)], EDGE)
    r = spark.createDataFrame([("a",)], "root string")
    assert rows(graph.impact(e, r, 99), "depth") == [("a", "b", 1), ("a", "c", 2)]
    assert rows(graph.impact_summary(e, r, 1), "root") == [("a", 1, 1, True)]


def test_static_test_reach_and_trace_wins(spark):
    e = spark.createDataFrame([("helper", "sym", "static_call", 3), ("test_x", "helper", "static_call", 5), ("test_y", "sym", "static_call", 2)], EDGE)
    t = spark.createDataFrame([("test_y", "sym", 9)], "src string, dst string, weight long")
    n = spark.createDataFrame([(i, i, f"src/{i}.py", "function") for i in ("sym", "helper", "test_x", "test_y")], "id string, name string, file string, kind string")
    index = spark.createDataFrame([], "entity string, test string, weight long")
    got = select_tests.ranked(select_tests.affected_tests(e, t, index, n, spark.createDataFrame([("sym",)], "root string")))
    assert rows(got.select("id", "depth", "evidence", "weight", "rank"), "rank") == [("test_y", 1, "trace", 9, 1), ("test_x", 2, "static", 5, 2)]


def test_prioritize_puts_weak_trace_before_strong_static(spark):
    t = spark.createDataFrame([("weak", "trace", 99, 0.01, None, None), ("strong", "static", 1, 1e6, None, None), ("recent", "static", 1, 1.0, 1_000_000_000_000, 5.0), ("old", "static", 1, 1.0, 992_224_000_000, 5.0)], "id string, evidence string, depth int, weight double, last_failed_at long, last_duration_ms double")
    got = [r[0] for r in rows(select_tests.prioritize(t, 1_000_086_400_000).select("id", "position"), "position")]
    assert got[0] == "weak" and got.index("recent") < got.index("old")


def test_apfd_edges(spark):
    none = spark.createDataFrame([], "id string, position int")
    faults = spark.createDataFrame([("f", "a")], "fault string, id string")
    assert select_tests.apfd(none, faults).first()["apfd"] == 0.0
    some = spark.createDataFrame([("a", 1), ("b", 2)], "id string, position int")
    assert select_tests.apfd(some, faults.where("false")).first()["apfd"] == 1.0
    assert select_tests.apfd(some, faults).first()["apfd"] == 0.75


def test_crdt_order_and_duplication_do_not_matter(spark):
    rng = random.Random(3)
    ops = [(f"e{rng.randrange(4)}", f"v{i}", rng.randrange(5), rng.randrange(3), f"w{rng.randrange(2)}") for i in range(60)]
    schema = "entity string, value string, wall long, counter long, writer string"
    states = []
    for _ in range(3):
        shuffled = ops + rng.sample(ops, 20)
        rng.shuffle(shuffled)
        df = spark.createDataFrame(shuffled, schema)
        states.append((rows(crdt.lww_current(df), "entity"), rows(crdt.merkle_leaves(df.withColumn("day", F.lit("d")), ["day"], "value"), "day")))
    assert states[0] == states[1] == states[2]


def test_orset_remove_spares_concurrent_adds(spark):
    adds = spark.createDataFrame([("c", "t1", 1, 0, "a", 10), ("c", "t2", 2, 0, "b", 10)], "claim string, tag string, wall long, counter long, writer string, expires long")
    removes = spark.createDataFrame([(["t1"],)], "tags array<string>")
    assert rows(crdt.orset_active(adds, removes).select("claim", "tag"), "claim") == [("c", "t2")]
    assert crdt.orset_active(adds, removes, now=11).count() == 0


def test_merkle_root_is_independent_of_order(spark):
    leaves = [(f"{i:02d}",) for i in range(7)]
    root = lambda x: crdt.merkle_root(spark.createDataFrame(x, "leaf string")).first()[0]
    level = sorted(x for (x,) in leaves)
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [hashlib.sha256(("01" + min(p) + max(p)).encode()).hexdigest() if len(p) == 2 else p[0] for p in pairs]
    assert root(leaves) == root(leaves[::-1]) == level[0] and root(leaves[:0]) == "" and root(leaves[:1]) == "00"


def test_lanes_are_disjoint_and_hubs_can_be_left_out(spark):
    e = spark.createDataFrame([("x", "s1", "static_call", 1), ("x", "s2", "static_call", 1), ("hub", "s3", "static_call", 1), ("hub", "s4", "static_call", 1), ("y1", "hub", "import", 1), ("y2", "hub", "import", 1)], EDGE)
    n = spark.createDataFrame([(i, f"{i}.py") for i in ("s1", "s2", "s3", "s4", "x", "hub", "y1", "y2")], "id string, file string")
    seeds = spark.createDataFrame([(f"s{i}",) for i in range(1, 5)], "seed string")
    assert rows(graph.plan_lanes(e, n, seeds, 1), "seed") == [("s1", "s1"), ("s2", "s1"), ("s3", "s3"), ("s4", "s3")]
    apart = graph.plan_lanes(e.where("dst <> 'hub'"), n, seeds, 1, max_in_degree=0)
    assert len({r["lane"] for r in apart.collect()}) == 2


def test_ambiguous_names_stay_unresolved(spark):
    n = spark.createDataFrame([("1", "a.py", "p", "f"), ("2", "b.py", "p", "f"), ("3", "b.py", "p", "g")], "id string, file string, package string, name string")
    raw = spark.createDataFrame([("a.py", "p", "f"), ("c.py", "p", "f"), ("c.py", "p", "g")], "file string, package string, name string")
    assert rows(resolve.resolve_names(raw, n).select("file", "name", "target"), "file", "name") == [("a.py", "f", "1"), ("c.py", "f", "?:f"), ("c.py", "g", "3")]


def test_search_terms_and_expansion():
    assert names.sanitize_terms("get!! Get user_id ++") == ["get", "user_id"]
    groups = names.expand_terms(["getAuth", "db"])
    assert groups[0][:3] == ["getAuth", "get", "auth"] and "authentication" in groups[0] and groups[1] == ["db", "database"]
    assert [g[0] for g in search.query_groups("how does the", relaxed=True)] == ["how", "does", "the"]


def test_identifier_tokens(spark):
    d = spark.createDataFrame([("getUserById",), ("HTTPServer",), ("v12Migration",), ("parse-tree",)], "t string")
    assert [r[0] for r in d.select(names.identifier_tokens(F.col("t"))).collect()] == [["get", "user", "by", "id"], ["http", "server"], ["12", "migration"], ["parse", "tree"]]


def test_fnv_and_entity_ids(spark):
    d = spark.createDataFrame([("", "811c9dc5"), ("a", "e40c292c"), ("foobar", "bf9cf968")], "t string, want string")
    assert all(r[0] == r[1] for r in d.select(names.fnv1a(F.col("t")), "want").collect())
    d = spark.createDataFrame([("src/auth/login.py", "login.check", "src/auth/login/check"), ("pkg/__init__.py", "", "pkg/pkg"), ("a.py", "f", "a/f")], "f string, q string, want string")
    assert all(r[0] == r[1] for r in d.select(names.entity_id(F.col("f"), F.col("q"), F.lit(False)), "want").collect())


def test_upserts(spark):
    old = spark.createDataFrame([("a", "x", "s", 5)], "id string, name string, summary string, logical_clock long")
    new = spark.createDataFrame([("a", "y", None, 3), ("b", "z", "t", 1)], old.schema)
    assert rows(relational.upsert_nodes(old, new), "id") == [("a", "y", "s", 5), ("b", "z", "t", 1)]
    e = spark.createDataFrame([("a", "b", "import", 2)], EDGE)
    assert relational.upsert_edges(e, e).first()["weight"] == 4
    assert relational.upsert_edges(e, e.withColumn("weight", F.lit(9).cast("long")), replace=True).first()["weight"] == 9


def test_python_parser_records():
    text = "import os\n\ndef greet(n) -> str:\n    return n.upper()\n\nclass Greeter:\n    def hello(self, n):\n        return greet(n)\n"
    r = code.parse_python("pkg/sample.py", text)
    assert r[0]["kind"] == "module" and r[0]["range_end"] == 8
    assert [(x["qualified_name"], x["kind"]) for x in r if x["record"] == "node"][1:] == [("greet", "function"), ("Greeter", "class"), ("Greeter.hello", "method")]
    assert ("Greeter.hello", "greet") in [(x["src_name"], x["dst_name"]) for x in r if x["record"] == "edge"]
    assert code.parse_python("x.py", "def (")[1]["record"] == "warning"


def test_parser_on_spark_and_edge_resolution(spark):
    files = spark.createDataFrame([("a/x.py", "def f():\n    g()\n\ndef g():\n    pass\n"), ("a/y.py", "import x\nx.f()\n"), ("a/z.py", None)], "file string, text string")
    r = code.extract(files)
    nodes = r.where("record = 'node'").withColumn("id", F.concat_ws("#", "file", "qualified_name"))
    nodes = nodes.select("id", "name", "qualified_name", "kind", "file", F.lit("a").alias("package"), F.col("range_start").cast("long").alias("seq"))
    imported = r.where("edge_kind = 'import'").select(F.col("file").alias("src_file"), "dst_name").distinct()
    targets = imported.join(nodes.where("kind = 'module'").select(F.col("name").alias("dst_name"), F.col("id").alias("module")), "dst_name", "left")
    raw, imports = calls.parsed_edges(r, targets)
    got = rows(calls.resolve_calls(raw, nodes, imports).select("src", "dst", "kind"), "src", "dst")
    assert ("a/x.py#f", "a/x.py#g", "static_call") in got and ("a/y.py#", "a/x.py#", "import") in got and ("a/y.py#", "a/x.py#f", "static_call") in got


def test_stacks(spark):
    s = spark.createDataFrame([(["leaf", "", "mid", "mid", "pkg.TestX"], 2)], "stack array<string>, count long")
    assert rows(profiles.stack_edges(s), "src") == [("mid", "leaf", 2), ("pkg.TestX", "mid", 2)]
    assert rows(profiles.stack_coverage(s), "entity") == [("pkg.TestX", "leaf", 2), ("pkg.TestX", "mid", 2)]


def test_slices_and_segments(spark):
    d = spark.createDataFrame([("f", "a\nb\n\nc\nd")], "file string, text string")
    assert d.select(pack.slice_text(F.col("text"), F.lit(0), F.lit(2))).first()[0] == "a\nb"
    ranges = spark.createDataFrame([("f", 2, 2)], "file string, start int, end int")
    assert rows(pack.uncovered_segments(pack.lines_of(d), ranges), "start") == [("f", 1, 1, 1), ("f", 4, 5, 2)]


def test_ignore_rules(spark):
    d = spark.createDataFrame([("build/a.py",), ("src/a.log",), ("src/keep.log",), ("src/a.py",)], "p string")
    got = [r[0] for r in d.select(maintain.ignored(F.col("p"), ["build/", "*.log", "!keep.log"])).collect()]
    assert got == [True, True, False, False]


def test_streaming_equals_batch(spark, tmp_path):
    rows_ = [("a", "b", 60 * (i % 7) + i, 1, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows_, "src string, dst string, ts long, observed long, weight long")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream).writeStream.format("memory").queryName("buckets").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("buckets"), "bucket") == rows(events.tumbling(df), "bucket")


def test_log_windows(spark):
    d = spark.createDataFrame([("k", i * 10) for i in range(8)] + [("k", 100_000)], "key string, at long")
    assert rows(events.log_windows(d, 60_000), "opened") == [("k", 0, 5, 3), ("k", 100_000, 1, 0)]


def test_brace_scanners():
    ts = "import { a } from './a';\n// call()\nexport class Box<T> {\n  private open(x: number): void {\n    this.lid.lift(x);\n  }\n}\nconst f = (y) => {\n  new Box();\n};\n"
    r = code.parse("src/box.ts", ts)
    assert [(x["qualified_name"], x["kind"], x["range_start"], x["range_end"]) for x in r if x["record"] == "node"][1:] == [("Box", "class", 3, 7), ("Box.open", "method", 4, 6), ("f", "function", 8, 10)]
    e = [(x["src_name"], x["dst_name"], x["edge_kind"]) for x in r if x["record"] == "edge"]
    assert e == [("src/box.ts", "./a", "import"), ("Box.open", "lift", "static_call"), ("f", "Box", "static_call")]
    rs = code.parse("a.rs", "use std::fmt;\npub struct P;\nimpl P {\n    pub fn go(&self, n: u8) -> u8 {\n        helper(n)\n    }\n}\nfn helper(n: u8) -> u8 { n }\n")
    assert [(x["qualified_name"], x["kind"], x.get("visibility")) for x in rs if x["record"] == "node"][1:] == [("P", "struct", "public"), ("P::go", "method", "public"), ("helper", "function", "private")]
    go = code.parse("a.go", 'package a\nimport "fmt"\ntype T struct {\n}\nfunc (t *T) Run(n int) {\n\tfmt.Println(n)\n}\nfunc main() {\n\tRun(1)\n}\n')
    assert [(x["qualified_name"], x["kind"]) for x in go if x["record"] == "node"][1:] == [("T", "struct"), ("T.Run", "method"), ("main", "function")]
    assert ("T.Run", "Println") in [(x["src_name"], x["dst_name"]) for x in go if x["record"] == "edge"]
    astro = code.parse("p.astro", "---\nimport Card from './Card.astro';\n---\n<Card x={1} />\n")
    assert [(x["dst_name"], x["line"]) for x in astro if x["record"] == "edge"] == [("./Card.astro", 2), ("Card", 4)]


def test_mutants(spark):
    from quarry.operators import mutants

    body = "def f(a):\n    # true\n    if a == 1:\n        log('true')\n    return a + 2"
    got = mutants.mutants(spark.createDataFrame([("f", "python", body), ("g", "python", None)], "id string, language string, body string")).collect()
    assert [(r["op"], r["line"]) for r in got] == [("comparison-swap", 3), ("off-by-one", 3), ("remove-call", 4), ("arithmetic-swap", 5), ("return-empty", 5), ("off-by-one", 5)]
    r = got[0]
    assert "if a != 1:" in mutants.apply_mutant(body, r["line"], r["original"], r["mutated"])


def test_aliases_and_workspaces(spark):
    files = spark.createDataFrame([("app/src/lib/x.ts",), ("pkgs/core/src/index.ts",), ("pkgs/core/src/util.ts",)], "file string")
    aliases = spark.createDataFrame([("app", "@/*", "src/*"), ("", "@/*", "other/*")], "dir string, pattern string, target string")
    imports = spark.createDataFrame([("app/src/a.ts", "@/lib/x"), ("app/src/a.ts", "@/none")], "file string, specifier string")
    assert rows(resolve.resolve_aliases(imports, aliases, files), "specifier") == [("app/src/a.ts", "@/lib/x", "app/src/lib/x.ts"), ("app/src/a.ts", "@/none", None)]
    packages = spark.createDataFrame([("@o/core", "pkgs/core", "dist/index.js")], "name string, dir string, entry string")
    imports = spark.createDataFrame([("@o/core",), ("@o/core/util",), ("react",)], "specifier string")
    assert rows(resolve.resolve_workspace(imports, packages, files), "specifier") == [("@o/core", "pkgs/core/src/index.ts"), ("@o/core/util", "pkgs/core/src/util.ts"), ("react", None)]


def test_symbol_packs(spark):
    n = spark.createDataFrame([("m", "m", "a.py", "module", 1, 9), ("f", "f", "a.py", "function", 3, 4), ("g", "g", "b.py", "function", 1, 2)], "id string, name string, file string, kind string, range_start long, range_end long")
    e = spark.createDataFrame([("f", "g", "static_call", 2), ("f", "m", "static_call", 9)], EDGE)
    files = spark.createDataFrame([("a.py", "import b\n\ndef f():\n    g()\n" + "# tail\n" * 40), ("b.py", "def g():\n    pass")], "file string, text string")
    got = pack.symbol_packs(n, e, files, spark.createDataFrame([("f",)], "root string"))
    assert rows(got.select("role", "file", "start", "end", "worthwhile"), "role") == [("callee", "b.py", 1, 2, True), ("header", "a.py", 1, 2, True), ("target", "a.py", 3, 4, True)]


def test_pprof_stacks(spark):
    import gzip

    from quarry.sources import pprof

    def message(number, body):
        return bytes([number << 3 | 2, len(body)]) + body

    names = [b"", b"leaf", b"main"]
    raw = b"".join(message(6, n) for n in names)
    raw += message(5, b"\x08\x01\x10\x01") + message(5, b"\x08\x02\x10\x02")
    raw += message(4, b"\x08\x01" + message(4, b"\x08\x01")) + message(4, b"\x08\x02" + message(4, b"\x08\x02"))
    raw += message(2, message(1, b"\x01\x02") + message(2, b"\x07\x00"))
    df = spark.createDataFrame([("a", bytearray(gzip.compress(raw))), ("b", None), ("c", bytearray(b"\xff\xff"))], "file string, content binary")
    assert [tuple(r) for r in pprof.decode(df).collect()] == [("a", ["leaf", "main"], 7)]


def test_verdicts(spark):
    from quarry.functions import verdicts

    d = spark.createDataFrame([("Well, YES: they clash",), ("no.",), ("maybe",), (None,)], "r string")
    assert [r[0] for r in d.select(verdicts.yes_no(F.col("r"))).collect()] == [True, False, None, None]
    pair = spark.createDataFrame([('text {"entity": "a", "signature_changed": true, "references": [],} end', '{"entity": "b", "signature_changed": false, "references": ["a"]}'), ("none", '{"entity": "b"}')], "x string, y string")
    assert [r[0] for r in pair.select(verdicts.extractor_conflict(verdicts.edit_facts(F.col("x")), verdicts.edit_facts(F.col("y")))).collect()] == [True, False]


def test_calls_through_aliases_namespaces_and_outside_modules(spark):
    nodes = spark.createDataFrame([(i, n, q, k, f, p, 0) for i, n, q, k, f, p in [
        ("lib/m", "m", "m", "module", "lib/m.ts", "lib"), ("lib/m/run", "run", "run", "function", "lib/m.ts", "lib"), ("lib/m/api/get", "get", "api.get", "method", "lib/m.ts", "lib"),
        ("lib/deep/only", "only", "only", "function", "lib/deep.ts", "lib"), ("app/a", "a", "a", "module", "app/a.ts", "app"), ("app/a/main", "main", "main", "function", "app/a.ts", "app"), ("app/b/run", "run", "run", "function", "app/b.ts", "app"),
    ]], "id string, name string, qualified_name string, kind string, file string, package string, seq long")
    imports = spark.createDataFrame([("app/a.ts", 1, "lib/m", ["r", "ns", "api", "only"], [("r", "run")]), ("app/a.ts", 2, None, ["ext"], []), ("app/a.ts", 3, "other", ["r"], [])], "src_file string, seq long, module string, local array<string>, aliases array<struct<local:string,imported:string>>")
    forms = [("r", None, None), ("run", "ns", None), ("get", "ns", ["ns", "api"]), ("get", "api", None), ("only", None, None), ("run", "ext", None), ("ext", None, None), ("run", None, None), ("gone", None, None)]
    raw = spark.createDataFrame([("app/a.ts", "main", dst, "static_call", rec, chain, None, i, 1) for i, (dst, rec, chain) in enumerate(forms)] + [("app/a.ts", "app/a.ts", "run", "static_call", None, None, None, 50, 2), ("no.ts", "x", "y", "static_call", None, None, None, 1, 1)], "src_file string, src_name string, dst_name string, kind string, receiver string, chain array<string>, module string, line long, col long")
    got = calls.resolve_calls(raw, nodes, imports)
    by = {r["line"]: (r["src"], r["dst"]) for r in got.collect()}
    want = ["lib/m/run", "lib/m/run", "lib/m/api/get", "lib/m/api/get", "lib/deep/only", "?:run", "?:ext", "app/b/run", "?:gone"]
    assert by == {i: ("app/a/main", w) for i, w in enumerate(want)} | {50: ("app/a", "app/b/run")}
    assert calls.call_sites(got).count() == 7


def test_hybrid_clock():
    at = [1000]
    c = crdt.HybridClock(lambda: at[0])
    assert [c.tick(), c.tick()] == [(1000, 0), (1000, 1)]
    at[0] = 900
    assert c.tick() == (1000, 2) and c.observe(2000, crdt.HybridClock.COUNTER) and c.tick() == (2001, 0)
    assert not c.observe(900 + crdt.HybridClock.SKEW_MS + 1, 0) and c.refused == 1 and c.tick() == (2001, 1)
    assert c.observe(5, 5) and c.tick() == (2001, 2)


def test_operation_batches_round_trip_and_torn_segments(spark, tmp_path):
    w = bytes(range(16))
    ops = [
        {"kind": "lww", "wall": 1 << 40, "counter": 65535, "writer": w, "a": "e\u00e9", "b": None, "payload": bytes(32) + b"body", "bucket": None, "observed": None, "weight": None},
        {"kind": "gset_observe", "wall": 5, "counter": 0, "writer": w, "a": "x", "b": "y", "payload": None, "bucket": 60, "observed": 3, "weight": 300},
        {"kind": "or_add", "wall": 6, "counter": 1, "writer": w, "a": "c", "b": "x", "payload": b"\xa0", "bucket": None, "observed": None, "weight": None},
        {"kind": "or_remove", "wall": 7, "counter": 1, "writer": w, "a": "c", "b": None, "payload": bytes(56), "bucket": None, "observed": None, "weight": None},
    ]
    blob = oplog.encode_batch(ops)
    assert oplog.decode_batch(blob) == ops and oplog.decode_batch(oplog.encode_batch([])) == []
    for bad in (b"", b"\x07" + blob[1:], blob[:1] + b"XXXX" + blob[5:], blob[:-1]):
        with pytest.raises(ValueError):
            oplog.decode_batch(bad)
    assert [oplog.read_varint(oplog.varint(n), 0)[0] for n in (0, 127, 128, 300, oplog.VARINT_MOST)] == [0, 127, 128, 300, oplog.VARINT_MOST]
    with pytest.raises(ValueError):
        oplog.read_varint(b"\xff\xff\xff\xff\x7f", 0)
    framed = oplog.varint(len(blob)) + blob
    assert oplog.split_batches(framed * 2 + framed[:-3]) == [blob, blob]
    (tmp_path / "gset").mkdir()
    (tmp_path / "gset" / "2024-01-02.log").write_bytes(framed + framed[:9])
    got = oplog.read_segments(spark, str(tmp_path))
    assert got.count() == 4 and {(r["type"], r["day"]) for r in got.collect()} == {("gset", "2024-01-02")}
    oplog.append_ops(got.drop("type", "day"), str(tmp_path / "log"))
    oplog.append_ops(got.drop("type", "day"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("type").count().orderBy("type").collect() == [("gset", 2), ("lww", 2), ("orset", 4)]


def test_node_files_are_written_once_and_swept(spark, tmp_path):
    n = spark.createDataFrame([("a/b", "b", "b", "function", "python", "a.py", 1, 2, "h", 0, 3, 'say "hi": \\ there'), ("../up", "up", "up", "function", "python", "u.py", 1, 2, "h", 0, 3, None)], "id string, name string, qualified_name string, kind string, language string, file string, range_start long, range_end long, ast_hash string, last_seen long, logical_clock long, summary string")
    e = spark.createDataFrame([("a/b", "c", 1), ("z", "a/b", 5), ("y", "a/b", 5)], "src string, dst string, weight long")
    files = markdown.render_nodes(n, e)
    folder = str(tmp_path / "nodes")
    (tmp_path / "nodes").mkdir()
    (tmp_path / "nodes" / "notes.md").write_text("mine")
    markdown.write_files(files, folder)
    assert not (tmp_path / "up.md").exists() and sorted(p.name for p in (tmp_path / "nodes").rglob("*.md")) == ["b.md", "notes.md"]
    back = markdown.read_files(spark, folder)
    assert markdown.changed_files(files.where("id = 'a/b'"), back).count() == 0
    parsed = {r["path"]: r for r in markdown.parse_nodes(back).collect()}
    assert parsed["a/b.md"]["summary"] == 'say "hi": \\ there' and parsed["a/b.md"]["range_end"] == 2 and parsed["notes.md"]["id"] == ""
    text = (tmp_path / "nodes" / "a" / "b.md").read_text()
    assert "- [[y]] (5 invocations)\n- [[z]] (5 invocations)" in text and "- [[c]] (1 invocation)" in text
    assert [r[0] for r in markdown.orphans(back, n.where("false")).collect()] == ["a/b.md"]


def test_note_ids_hash_utf16_units(spark):
    def fnv(units, h, prime):
        for c in units:
            h = ((h ^ c) * prime) & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "a", "note \u00fc", "\U0001f600 x" * 30]
    got = [r[0] for r in maintain.note_ids(spark.createDataFrame([(t,) for t in texts], "t string"), "t").select("note_id").collect()]
    units = [[int.from_bytes(t.encode("utf-16-be")[i : i + 2], "big") for i in range(0, len(t.encode("utf-16-be")), 2)] for t in texts]
    assert got == ["mem_" + fnv(u, 0x811C9DC5, 0x01000193) + fnv(u, 0x01000193, 0x85EBCA6B) for u in units]


def test_layout_equals_plain_loops_and_is_bounded(spark):
    n = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "graph string, id string")
    e = spark.createDataFrame([("g", "a", "b", 1)], "graph string, src string, dst string, weight long")
    at = context.start_positions(n, e)
    start = {r["id"]: (r["x"], r["y"], r["mass"]) for r in at.collect()}
    out = {r["id"]: (r["x"], r["y"], r["vx"], r["vy"]) for r in context.force_layout(at, e).collect()}
    for i, (x, y, m) in start.items():
        vx = vy = 0.0
        for j, (u, v, k) in start.items():
            if i != j:
                d = ((u - x) ** 2 + (v - y) ** 2) ** 0.5
                vx, vy = vx - 400 * k * (u - x) / d**3, vy - 400 * k * (v - y) / d**3
        if i in "ab":
            u, v, _ = start["b" if i == "a" else "a"]
            d = ((u - x) ** 2 + (v - y) ** 2) ** 0.5
            f = 0.05 * (d - 60) * min(2, 0.5 + math.log10(2)) / d / m
            vx, vy = vx + f * (u - x), vy + f * (v - y)
        vx, vy = (vx + (400 - x) * 0.005) * 0.85, (vy + (300 - y) * 0.005) * 0.85
        assert out[i] == pytest.approx((x + vx, y + vy, vx, vy))
    many = spark.range(context.MOST_DRAWN + 1).select(F.lit("g").alias("graph"), F.col("id").cast("string").alias("id"))
    with pytest.raises(Exception, match="cluster them first"):
        context.force_layout(context.start_positions(many, e), e).count()


def test_trees_on_cycles_and_empty_inputs(spark):
    t = spark.createDataFrame([(1, None, "a", 1), (2, 1, None, 2), (3, 2, "b", 4), (8, 9, "x", 5), (9, 8, "y", 5)], "id long, parent long, function string, hits long")
    assert rows(profiles.subtree_totals(t), "id") == [(1, 7), (2, 6), (3, 4)]
    assert rows(profiles.tree_edges(t), "src") == [("a", "b", 4)] and rows(profiles.tree_coverage(t), "entity") == [("a", 7), ("b", 4)]
    assert profiles.tree_edges(t.where("false")).count() == 0


def test_verdicts_by_edges_and_modules(spark):
    c = spark.createDataFrame([("i", "p", ["m/n/a"], "change the signature"), ("x", "q", ["m/n/b"], "rename the parameter"), ("y", "q", ["m/o/c"], "internal logic only"), ("z", "q", ["k"], "touch it"), ("w", "p", ["m/n/d"], "rename")], "id string, agent string, scope array<string>, intent string")
    e = spark.createDataFrame([("m/o/c", "m/n/a")], "src string, dst string")
    p = claims.adjacent(c.where("id = 'i'"), c, e)
    assert rows(p.select("b", "direct", "same_module"), "b") == [("x", False, True), ("y", True, False)]
    signed = spark.createDataFrame([("m/n/a", "public", True), ("m/n/b", "unknown", True), ("m/o/c", "private", True)], "id string, visibility string, callable boolean")
    both = p.select("a", "b").union(spark.createDataFrame([("i", "z"), ("i", "i2")], "a string, b string"))
    assert rows(claims.contract_verdicts(both, c, e, signed).drop("a"), "b") == [("i2", False, 0.0), ("x", True, 0.6), ("y", True, 0.85), ("z", False, 0.0)]


def test_selection_without_coverage_is_cold(spark):
    n = spark.createDataFrame([("sym", "sym", "sym", "s.py", "function"), ("t", "test_a", "test_a", "tests/t.py", "function")], "id string, name string, qualified_name string, file string, kind string")
    e, none = spark.createDataFrame([("t", "sym", "static_call", 3)], EDGE), spark.createDataFrame([], "src string, dst string, weight long")
    index = spark.createDataFrame([], "entity string, test string, weight long")
    root = spark.createDataFrame([("sym",)], "root string")
    got = select_tests.select_tests(e, none, index, n, root).collect()
    assert [(r["id"], r["evidence"], r["weight"], r["confidence"], r["dispatch_only"], r["note"]) for r in got] == [("t", "static", 3, "reachable", False, select_tests.COLD_NOTE)]
    assert select_tests.select_tests(e, none, index, n, root, trace_only=True).count() == 0


def test_positions_number_every_row(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    got = relational.positions(d, [F.col("v").desc()]).collect()
    assert sorted(r["position"] for r in got) == list(range(1, 5001)) and all(r["position"] == 5000 - r["v"] for r in got)
    assert relational.positions(d.where("false"), [F.col("v")]).count() == 0


def test_generated_repositories_repeat(spark):
    a, b = (sorted(map(tuple, repo.synthetic_repo(spark, 40).collect())) for _ in range(2))
    assert a == b and len({f for f, _ in a}) == 40 and all(t for _, t in a)


def test_adjacent_pairs_are_counted_without_being_made(spark):
    rnd = random.Random(5)
    scope = lambda i: [f"s/m{rnd.randrange(9)}/{rnd.randrange(12)}" for _ in range(i % 7)] + ["bare"] * (i % 3)
    c = spark.createDataFrame([(f"c{i}", None if i == 9 else f"a{i % 4}", scope(i)) for i in range(60)], "id string, agent string, scope array<string>")
    e = c.select(F.explode("scope").alias("src"), F.reverse("scope")[0].alias("dst")).where("src <> dst").distinct()
    board = c.withColumn("agent", F.when(F.col("id") == "c12", "other").otherwise(F.col("agent")))
    asked = c.where("id like '%2' or id like '%6'")
    want = claims.adjacent(asked, board, e).groupBy("a").agg(F.count("*").alias("pairs"))
    assert rows(claims.adjacent_counts(asked, board, e), "a") == rows(want, "a") != []


def test_module_counts_make_no_pairs(spark):
    c = spark.range(4000).select(F.concat(F.lit("c"), "id").alias("id"), F.concat(F.lit("a"), F.col("id") % 2).alias("agent"), F.array(F.concat(F.lit("one/m/"), "id")).alias("scope"))
    e = spark.createDataFrame([("one/m/1", "one/m/2")], "src string, dst string")
    got = claims.adjacent_counts(c, c, e)
    assert {r["pairs"] for r in got.collect()} == {2000}
    assert 0 < most_joined(got) <= 20_000  # 8,000,000 pairs


def most_joined(df):
    """The most rows that any join made of a collected frame."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if name.endswith("Join") and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo.extend(kids.apply(i) for i in range(kids.size()))
    return most


def test_a_hub_costs_a_pair_of_claims_one_row(spark, monkeypatch):
    monkeypatch.setattr(claims, "materialize", lambda df: df)
    c = spark.range(200).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("x").alias("agent"), F.array(F.when(F.col("id") < 100, "m/hub").otherwise(F.concat(F.lit("n/"), "id"))).alias("scope"), F.lit("rename").alias("intent"))
    e = spark.range(100, 400).select(F.lit("m/hub").alias("src"), F.concat(F.lit("n/"), "id").alias("dst"))
    pairs = c.where("scope[0] = 'm/hub'").select(F.col("id").alias("a")).crossJoin(c.where("scope[0] in ('n/150', 'n/151')").select(F.col("id").alias("b")))
    signed = c.select(F.col("scope")[0].alias("id"), F.lit("public").alias("visibility"), F.lit(True).alias("callable")).distinct()
    got = claims.contract_verdicts(pairs, c, e, signed)
    assert {(r["conflict"], r["confidence"]) for r in got.collect()} == {(True, 0.85)}
    assert 0 < most_joined(got) <= 1000  # 200 pairs, 60,000 neighbours of their hub


def test_direct_pairs_make_no_pairs_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(claims, "materialize", lambda df: df)
    c = spark.range(300).select(F.concat(F.lit("c"), "id").alias("id"), F.concat(F.lit("a"), F.col("id") % 2).alias("agent"), F.array(F.concat(F.lit("m/"), "id")).alias("scope"))
    e = c.select(F.col("scope")[0].alias("src"), F.lit("m/0").alias("dst")).where("src <> dst")
    got = claims.direct_pairs(c.where("id <> 'c0'"), c, e)
    assert {(r["a"], r["b"], r["direct"]) for r in got.collect()} == {(f"c{i}", "c0", True) for i in range(1, 300, 2)}
    assert 0 < most_joined(got) <= 1000  # 90,000 pairs of neighbours of m/0


def test_pairs_of_claims_are_dealt_once(spark):
    c = spark.createDataFrame([("i", "p", ["x"], "stock levels"), ("j", "q", ["y"], "stock levels")], "id string, agent string, scope array<string>, intent string")
    e = spark.createDataFrame([("x", "n"), ("y", "n"), ("x", "y")], "src string, dst string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        near = claims.adjacent(c.where("id = 'i'"), c, e, "graph")
        assert rows(near, "b") == [("i", "j", True, 1, False)]
        got = claims.heuristic_verdicts(near, c)
        assert [tuple(r) for r in got.collect()] == [("i", "j", 2, 0.8, True)]
        plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(a#" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(a#" in x and ", b#" in x]


def test_calls_are_dealt_by_file_and_by_question(spark):
    nodes = spark.createDataFrame([("f", "f", "f", "module", "f.ts", "app", 0), ("f/main", "main", "main", "function", "f.ts", "app", 0), ("lib", "lib", "lib", "module", "lib.ts", "pkg", 0), ("lib/go", "go", "go", "function", "lib.ts", "pkg", 0), ("f/own", "own", "own", "function", "f.ts", "app", 0), ("g/far", "far", "far", "function", "g.ts", "app", 0)], "id string, name string, qualified_name string, kind string, file string, package string, seq long")
    imports = spark.createDataFrame([("f.ts", 1, "lib", ["l"], []), ("f.ts", 2, None, ["out"], [])], "src_file string, seq long, module string, local array<string>, aliases array<struct<local:string,imported:string>>")
    names_ = ["go", "go", "own", "far", "nowhere", "out"]
    raw = spark.createDataFrame([("f.ts", "main", n, "static_call", "l" if n == "go" else None, None, None, i) for i, n in enumerate(names_)], "src_file string, src_name string, dst_name string, kind string, receiver string, chain array<string>, module string, line long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = calls.resolve_calls(raw, nodes, imports)
        assert rows(got.select("line", "src", "dst"), "line") == [(0, "f/main", "lib/go"), (1, "f/main", "lib/go"), (2, "f/main", "f/own"), (3, "f/main", "g/far"), (4, "f/main", "?:nowhere"), (5, "f/main", "?:out")]
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") <= 4


def test_bindings_are_dealt_before_they_are_exploded(spark):
    imports = spark.range(50).select(F.concat(F.lit("f"), F.col("id") % 5).alias("src_file"), F.col("id").alias("seq"), F.lit("m").alias("module"), F.array(F.lit("a"), F.lit("b")).alias("local"), F.array(F.struct(F.lit("a").alias("local"), F.lit("x").alias("imported"))).alias("aliases"))
    got = calls.import_bindings(imports)
    assert rows(got, "src_file", "local")[:2] == [("f0", "a", "m", "x"), ("f0", "b", "m", "b")] and got.count() == 10
    plan = got._jdf.queryExecution().sparkPlan().toString()
    text = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan and text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")


def written(monkeypatch, *modules):
    """The frames that the modules' operators write, in order."""
    out = []
    for m in modules:
        monkeypatch.setattr(m, "materialize", lambda df, real=m.materialize: (out.append(df), real(df))[1])
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_walks_write_edges_as_they_come(spark, monkeypatch):
    e = spark.createDataFrame([("b", "a", "static_call", 1), ("b", "a", "import", 2), ("c", "b", "static_call", 1), ("d", "c", "import", 1)], EDGE)
    root = spark.createDataFrame([("a",)], "root string")
    out = written(monkeypatch, graph)
    assert rows(graph.walk(e, root, 2), "depth") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    assert "Exchange" not in plan_of(out[0])
    out.clear()
    assert rows(graph.impact_preview(e, root, 2), "depth") == [("a", "b", 1, "call+import", 1, 1), ("a", "c", 2, None, 0, 0)]
    assert "weight" in out[0].columns and not [d for d in out[1:] if "LocalTableScan" in plan_of(d) and {"src", "dst"} <= set(d.columns)]


def test_neighbourhoods_deal_only_their_own_edges(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b", "static_call", 1), ("b", "a", "import", 2), ("x", "y", "static_call", 1), ("b", "x", "import", 1)], EDGE)
    t = spark.createDataFrame([("a", "b", 7), ("c", "a", 3)], "src string, dst string, weight long")
    n = spark.createDataFrame([("a", "a", "function")], "id string, name string, kind string")
    out = written(monkeypatch, graph)
    got = graph.neighborhood(e, t, n, spark.createDataFrame([("a",)], "root string"))[1]
    assert rows(got, "src", "dst") == [("a", "a", "b", "static_call", 1), ("a", "b", "a", "import", 2), ("a", "c", "a", "trace_call", 3)]
    assert "LeftSemi" in plan_of(got) and [d for d in out if {"src", "dst", "kind"} <= set(d.columns)] == out[:1]


def test_modules_are_summed_before_the_other_end(spark):
    n = spark.createDataFrame([("a", "x/1.py"), ("b", "y/1.py"), ("c", "y/2.py")], "id string, file string")
    e = spark.createDataFrame([("a", "b", "import", 2), ("a", "c", "import", 3), ("b", "c", "import", 9)], EDGE)
    got = graph.cluster_modules(n, e)[1]
    assert rows(got, "src") == [("x", "y", 5)]
    assert plan_of(got).count("partial_sum") == 2


def test_selections_write_index_and_edges_once(spark, monkeypatch):
    n = spark.createDataFrame([("sym", "sym", "sym", "s.py", "function"), ("t", "test_a", "test_a", "tests/t.py", "function")], "id string, name string, qualified_name string, file string, kind string")
    e, trace = spark.createDataFrame([("t", "sym", "static_call", 3)], EDGE), spark.createDataFrame([("t", "sym", 2)], "src string, dst string, weight long")
    index = spark.createDataFrame([("sym", "t", 4)], "entity string, test string, weight long")
    out = written(monkeypatch, select_tests, graph)
    got = select_tests.select_tests(e, trace, index, n, spark.createDataFrame([("sym",)], "root string"), trace_only=True, fallback=True, by_root=True).collect()
    assert [(r["id"], r["confidence"], r["weight"]) for r in got] == [("t", "observed", 4)]
    assert len([d for d in out if "traced" in d.columns]) == 1 and not [d for d in out if d.columns == ["at", "next"]]
    assert [d for d in out if "entity" in d.columns]


def test_names_are_resolved_by_id_then_by_the_only_name(spark):
    n = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "t"), ("t2", "a")], "id string, name string")
    c = spark.createDataFrame([("t", "a", 1), ("t", "x", 5), ("c", "a", 2), ("gone", "a", 3)], "test string, entity string, weight long")
    got = select_tests.coverage_index(c, n)
    assert rows(got, "entity") == [("a", "c", 3)]


def test_rate_guard_slides_no_window(spark):
    rnd = random.Random(3)
    runs = [("k", rnd.randrange(40_000)) for _ in range(400)] + [("k", 7199), ("k", 7200), ("k", 3600), ("k", 0), ("k", 0), ("l", 5), ("k", None)]
    got = events.rate_guard(spark.createDataFrame(runs, "key string, ts long"), 30, 3)
    want = []
    for key in ("k", "l"):
        ts = sorted(t for k, t in runs if k == key and t is not None)
        for i, t in enumerate(ts):
            trailing = sum(t - 3600 <= u <= t for u in ts) - 1
            want.append((key, t, trailing, "too-soon" if i and t - ts[i - 1] < 30 else "tripped" if trailing >= 3 else "run"))
    assert sorted(tuple(r) for r in got.where("ts is not null").collect()) == sorted(want)
    assert [tuple(r) for r in got.where("ts is null").collect()] == [("k", None, 0, "run")]
    assert "RangeFrame, -3600" not in plan_of(got)


def test_prefixes_meet_their_slices_once(spark):
    s = spark.createDataFrame([("g", "f", 1, 2, "a"), ("g", "f", 3, 4, "b"), ("g", "f", 5, 6, "c"), ("h", "f", 1, 2, "z")], "task string, file string, start long, end long, text string")
    d = lambda x: hashlib.sha256(x.encode()).hexdigest()
    prior = spark.createDataFrame([("g", 1, "f:1:2", d("a")), ("g", 2, "f:3:4", "old"), ("g", 3, "f:5:6", d("c"))], "task string, position int, key string, digest string")
    got = context.extended(s, prior, "task")
    assert rows(got, "task", "part", "position") == [("g", 1, "f:1:2", "prefix"), ("g", 1, "f:3:4", "tail"), ("g", 2, "f:5:6", "tail"), ("h", 1, "f:1:2", "tail")]
    assert "digest" not in plan_of(got) and "sha2" not in plan_of(got)


def test_observed_edges_of_files_are_written_once(spark, monkeypatch):
    n = spark.createDataFrame([("a", "a", "q", "function", "f.py", 1, 2)], "id string, name string, qualified_name string, kind string, file string, range_start int, range_end int").withColumns({"language": F.lit("py"), "ast_hash": F.lit("h"), "last_seen": F.lit(0), "logical_clock": F.lit(1), "summary": F.lit("s")})
    e = spark.createDataFrame([("b", "a", 1), ("c", "a", 5)], "src string, dst string, weight long")
    out = written(monkeypatch, markdown)
    files = markdown.render_nodes(n, e)
    assert len(out) == 1 and "- [[c]] (5 invocations)\n- [[b]] (1 invocation)" in files.first()["content"]
    assert plan_of(markdown.orphans(files, n)).count("regexp_extract") < plan_of(markdown.parse_nodes(files)).count("regexp_extract")
