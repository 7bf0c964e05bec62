"""Affected-test selection and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialize
from ..functions.names import is_test, runnable
from .graph import dependency_edges, walk
from .relational import first_by, positions

DAY_MS = 86_400_000


def coverage_index(coverage: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entity, test, weight) by node ids: both names resolved (exact id, else the only node of that name), others dropped."""
    spelled = nodes.select(F.col("id").alias("name"), "id", F.lit(True).alias("exact")).union(nodes.select("name", "id", F.lit(False)))
    spelled = spelled.groupBy("name").agg(F.min(F.when(F.col("exact"), F.col("id"))).alias("own"), F.count(F.when(~F.col("exact"), 1)).alias("n"), F.min(F.when(~F.col("exact"), F.col("id"))).alias("only"))
    names = spelled.select("name", F.coalesce("own", F.when(F.col("n") == 1, F.col("only"))).alias("id")).where("id is not null")
    c = coverage.join(names.select(F.col("name").alias("test"), F.col("id").alias("test_id")), "test").join(names.select(F.col("name").alias("entity"), F.col("id").alias("entity_id")), "entity")
    return c.groupBy(F.col("entity_id").alias("entity"), F.col("test_id").alias("test")).agg(F.sum("weight").alias("weight"))


def reach(static: DataFrame, trace: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """(root, id, depth, via_trace, trace_weight, static_weight): a reverse walk over static and traced edges together.

    Weights are the greatest over all edges that lead from the walked nodes, tree edges or not;
    edges back into the walk's own root don't count.
    """
    return _reach(_traced(static, trace), roots, depth)


def _traced(static: DataFrame, trace: DataFrame) -> DataFrame:
    """(src, dst, traced, weight) of both, written once for all walks."""
    s = dependency_edges(static).select("src", "dst", F.lit(False).alias("traced"), "weight")
    return materialize(s.union(trace.select("src", "dst", F.lit(True), "weight")))


def _reach(both: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    seen = materialize(walk(both, roots, depth, written=True))
    relaxed = seen.where(F.col("depth") < depth).select("root", F.col("id").alias("dst")).join(both, "dst").where("src <> root")
    top = lambda traced: F.max(F.when(F.col("traced") == traced, F.col("weight")))
    weights = relaxed.groupBy("root", F.col("src").alias("id")).agg(F.bool_or("traced").alias("via_trace"), top(True).alias("trace_weight"), top(False).alias("static_weight"))
    return seen.where("depth > 0").join(weights, ["root", "id"])


def affected_tests(static: DataFrame, trace: DataFrame, index: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """Ranked tests that reach the roots, merged over roots: least depth, greatest weights, any trace.

    Coverage of a root puts its tests at depth 1 as observed. ``rank`` orders observed before
    reachable, traced before static, near before far, heavy before light.
    """
    roots = materialize(roots.select("root"))
    walked = reach(static, trace, roots, depth).withColumn("observed", F.lit(False))
    seen = index.join(roots.select(F.col("root").alias("entity")), "entity").select(F.col("test").alias("id"), F.lit(1).alias("depth"), F.lit(True).alias("via_trace"), F.col("weight").alias("trace_weight"), F.lit(None).cast("long").alias("static_weight"), F.lit(True).alias("observed"))
    both = walked.drop("root").unionByName(seen)
    merged = both.groupBy("id").agg(F.min("depth").alias("depth"), F.bool_or("via_trace").alias("via_trace"), F.max("trace_weight").alias("tw"), F.max("static_weight").alias("sw"), F.bool_or("observed").alias("observed"))
    merged = merged.join(roots, merged.id == roots.root, "left_anti")
    tests = nodes.where(is_test(F.col("file"), F.col("name"))).select("id")
    m = merged.join(tests, "id", "left_semi")
    evidence = F.when(F.col("via_trace"), "trace").otherwise("static")
    weight = F.coalesce(F.when(F.col("via_trace"), F.col("tw")).otherwise(F.col("sw")), F.lit(0))
    return m.select("id", "depth", evidence.alias("evidence"), weight.alias("weight"), F.when(F.col("observed"), "observed").otherwise("reachable").alias("confidence"))


def ranked(tests: DataFrame) -> DataFrame:
    order = [F.col("confidence") != "observed", F.col("evidence") != "trace", F.col("depth"), F.col("weight").desc(), F.col("id")]
    return positions(tests, order, "rank")


#: What a selection says of itself.
PRECISE_NOTE = "precise (per-test coverage)"
FALLBACK_NOTE = "precise (per-test coverage); no observed coverage for the change — fell back to the reachable safety set (a minimal selector must never return zero tests for a change)"
COLD_NOTE = "no traces yet — static only, may UNDER-report"


def class_siblings(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): the other members of each root's class, of the same file. The class is the capitalised segment before the last of a qualified name."""
    cls = F.regexp_extract("qualified_name", r"(?:^|\.)([A-Z][^.]*)\.[^.]*$", 1)
    n = nodes.select("id", "file", "qualified_name", cls.alias("cls")).where("cls <> '' and file is not null")
    own = n.join(roots, n.id == roots.root).select("root", "file", "cls")
    member = F.col("qualified_name").startswith(F.concat("cls", F.lit(".")))
    return own.join(n.where(member).select("id", "file", "cls"), ["file", "cls"]).where("id <> root").select("root", "id")


def select_tests(static: DataFrame, trace: DataFrame, index: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 64, trace_only: bool = False, fallback: bool = False, by_root: bool = False, rollup: bool = False, limit: int | None = None) -> DataFrame:
    """Ranked tests of a change: id, depth, evidence, weight, confidence, static_reachable, dispatch_only, rank, note.

    With coverage (``index`` has rows) a root's own tests are observed, all others reachable. ``rollup`` adds, as reachable, the tests
    of the members of a root's class. dispatch_only marks what traces reach and static edges don't; those come first.
    ``trace_only`` keeps the observed tests (without coverage: those with trace evidence); with ``fallback`` a change without any
    is answered by its reachable set: all of it if nothing at all was observed, or ``by_root`` that of every root that no test covers.
    """
    roots = materialize(roots.select("root").distinct())
    index = materialize(index)
    precise = not index.isEmpty()
    both = _traced(static, trace)
    walked = materialize(_reach(both, roots, depth))
    own = roots.select(F.col("root").alias("id"))
    parts = walked.drop("root").withColumn("observed", F.lit(False))
    seen = lambda of, observed: index.join(of, index.entity == of.id).select(F.col("test").alias("id"), F.lit(1).alias("depth"), F.lit(True).alias("via_trace"), F.col("weight").alias("trace_weight"), F.lit(None).cast("long").alias("static_weight"), F.lit(observed).alias("observed"))
    if precise:
        parts = parts.unionByName(seen(own, True))
    merge = lambda p: p.groupBy("id").agg(F.min("depth").alias("depth"), F.bool_or("via_trace").alias("via_trace"), F.max("trace_weight").alias("tw"), F.max("static_weight").alias("sw"), F.bool_or("observed").alias("observed"))
    merged = merge(parts)
    if precise and rollup:
        more = seen(class_siblings(nodes, roots).select("id").join(own, "id", "left_anti").distinct(), False).groupBy("id").agg(F.max("trace_weight").alias("rw"))
        merged = merged.join(more, "id", "full_outer").select("id", F.coalesce("depth", F.lit(1)).alias("depth"), (F.coalesce("via_trace", F.lit(False)) | F.col("rw").isNotNull()).alias("via_trace"), F.greatest("tw", "rw").alias("tw"), "sw", F.coalesce("observed", F.lit(False)).alias("observed"))
    still = walk(both.where("not traced"), roots, depth, written=True).where("depth > 0").select("id").distinct().withColumn("static_reachable", F.lit(True))
    tests = nodes.where(is_test(F.col("file"), F.col("name"))).select("id")

    def shown(m: DataFrame) -> DataFrame:
        m = m.join(own, "id", "left_anti").join(tests, "id", "left_semi").join(still, "id", "left")
        evidence = F.when(F.col("via_trace"), "trace").otherwise("static")
        weight = F.coalesce(F.when(F.col("via_trace"), F.col("tw")).otherwise(F.col("sw")), F.lit(0))
        reachable = F.coalesce("static_reachable", F.lit(False))
        return m.select("id", "depth", evidence.alias("evidence"), weight.alias("weight"), F.when(F.col("observed"), "observed").otherwise("reachable").alias("confidence"), reachable.alias("static_reachable"), (F.col("via_trace") & ~reachable).alias("dispatch_only"))

    full = materialize(shown(merged))
    out, fell = full, False
    if trace_only:
        out = full.where("confidence = 'observed'" if precise else "evidence = 'trace'")
        if precise and fallback and by_root:
            bare = roots.join(index.select(F.col("entity").alias("root")).distinct(), "root", "left_anti")
            alone = first_by(walked.join(bare, "root", "left_semi"), ["id"], [F.col("root")])
            alone = alone.select("id", "depth", "via_trace", F.col("trace_weight").alias("tw"), F.col("static_weight").alias("sw"), F.lit(False).alias("observed"))
            extra = shown(alone).join(out.select("id"), "id", "left_anti")
            extra = extra.join(full.where("confidence = 'observed'").select("id"), "id", "left_anti")
            fell = not extra.isEmpty()
            out = out.unionByName(extra)
        elif precise and fallback and out.isEmpty():
            out, fell = full, not full.isEmpty()
    order = [~F.col("dispatch_only"), F.col("confidence") != "observed", F.col("evidence") != "trace", F.col("depth"), F.col("weight").desc(), F.col("id")]
    out = out.orderBy(*order).limit(limit) if limit is not None else out
    note = (FALLBACK_NOTE if fell else PRECISE_NOTE) if precise else (COLD_NOTE if trace.isEmpty() else None)
    return positions(out, order, "rank").withColumn("note", F.lit(note).cast("string"))


def runnable_tests(nodes: DataFrame) -> DataFrame:
    """Every test node with its runner and the handle by which that selects it; null where it can't be run by itself."""
    from ..functions.names import runner

    t = nodes.where(is_test(F.col("file"), F.col("name")))
    return t.select("id", runner(F.col("file")).alias("runner"), runnable(F.col("file"), F.col("name"), F.col("id"), F.col("kind")).alias("runnable"))


#: Changed files that force the full suite, and those that are tests themselves.
ALWAYS_FULL = r"(^|/)conftest\.py$|(^|/)(setup\.py|setup\.cfg|pyproject\.toml|tox\.ini|requirements[^/]*\.txt|pytest\.ini)$|(^|/)\.github/"
CHANGED_TEST = r"(^|/)(test_[^/]*\.py|[^/]*_test\.py)$|(^|/)tests?/"


def ci_selection(changed: DataFrame, nodes: DataFrame, selected: DataFrame, note: str = "") -> DataFrame:
    """(mode, reason, runnable): what a build runs for the ``changed`` files (file): full, selected or nothing; full on any doubt.

    ``selected`` has runnable (null: not runnable alone). Changed tests run whatever the graph says of them.
    """
    always, test = F.col("file").rlike(ALWAYS_FULL), F.col("file").rlike(CHANGED_TEST)
    known = nodes.select("file").distinct().withColumn("known", F.lit(True))
    count = lambda c: F.count(F.when(c, 1))
    facts = changed.select("file").distinct().join(known, "file", "left").agg(F.count("*").alias("n"), count(always).alias("always"), count(test).alias("tests"), count(F.col("known")).alias("roots"))
    run = changed.where(test).select(F.col("file").alias("runnable")).union(selected.where("runnable is not null").select("runnable")).distinct()
    n = run.agg(F.count("*").alias("picked"))
    stale = any(w in note for w in ("stale", "cold"))
    only_tests = (F.col("tests") > 0) & (F.col("tests") == F.col("n"))
    reason = (
        F.when(F.col("n") == 0, "no changed files")
        .when(F.col("always") > 0, "a global-impact file changed")
        .when(F.lit(stale), "the index may be stale")
        .when((F.col("roots") == 0) & only_tests, "only changed test files")
        .when(F.col("roots") == 0, "no changed file mapped to an indexed entity")
        .when(F.col("picked") == 0, "the selection is empty")
        .otherwise("selected")
    )
    mode = F.when(F.col("reason") == "no changed files", "none").when(F.col("reason").isin("only changed test files", "selected"), "selected").otherwise("full")
    verdict = facts.crossJoin(n).select(reason.alias("reason")).select(mode.alias("mode"), "reason")  # one row
    picked = verdict.where("mode = 'selected'").crossJoin(run)
    return picked.union(verdict.where("mode <> 'selected'").select("mode", "reason", F.lit(None).cast("string")))


def hub_fraction(tests: DataFrame, nodes: DataFrame, least: float = 0.3) -> DataFrame:
    """Share of all test nodes that a root affects; a hub from 0.3 on. ``tests`` has root and id."""
    total = nodes.where(is_test(F.col("file"), F.col("name"))).agg(F.count("*").alias("total"))
    per = tests.groupBy("root").agg(F.countDistinct("id").alias("affected"))
    share = F.when(F.col("total") > 0, F.col("affected") / F.col("total")).otherwise(0.0)
    return per.crossJoin(F.broadcast(total)).select("root", "affected", "total", F.round(share, 6).alias("fraction"), (share >= least).alias("hub"))


def prioritize(tests: DataFrame, now_ms: int, half_life_days: float = 7.0) -> DataFrame:
    """Score and position: traced before static, recent failures, near and heavy tests first, then short ones."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.col("last_failed_at")) / DAY_MS)
    failed = F.when(F.col("last_failed_at").isNotNull(), F.pow(F.lit(2.0), -age / half_life_days)).otherwise(0.0)
    score = F.round(failed + 0.6 / F.greatest(F.lit(1), F.col("depth")) + 0.4 * F.col("weight") / (F.col("weight") + 4), 9)
    mean = tests.agg(F.coalesce(F.avg("last_duration_ms"), F.lit(0.0)).alias("__mean"))
    s = tests.withColumn("score", score).crossJoin(F.broadcast(mean))  # one row
    s = s.withColumn("duration", F.coalesce("last_duration_ms", "__mean")).drop("__mean")
    return positions(s, [F.col("evidence") != "trace", F.col("score").desc(), F.col("duration"), F.col("id")]).drop("duration")


def apfd(positions: DataFrame, faults: DataFrame) -> DataFrame:
    """1 - sum of first detecting positions / (n m) + 1 / (2 n); no tests give 0, no faults 1.

    ``positions`` has id and position, ``faults`` fault and id (the tests that detect it).
    """
    n = positions.agg(F.count("*").alias("n"))
    first = faults.join(positions, "id", "left").groupBy("fault").agg(F.min("position").alias("p"))
    m = first.crossJoin(F.broadcast(n)).agg(F.count("*").alias("m"), F.sum(F.coalesce("p", F.col("n") + 1)).alias("s"))
    value = F.when(F.col("n") == 0, 0.0).when(F.col("m") == 0, 1.0).otherwise(1 - F.col("s") / (F.col("n") * F.col("m")) + 1 / (2 * F.col("n")))
    return m.crossJoin(F.broadcast(n)).select("n", "m", F.round(value, 6).alias("apfd"))
