"""The corpus pipeline, stage by stage, on the small tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as c

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in c.STAGES:
        seen.append(c.materialize(stage(spark, seen[-1], SF)))
    for before, after in zip(seen[:4], seen[1:5], strict=True):
        assert after.columns == docs.columns and {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r[0] for r in seen[1].select("doc_id").collect()}
    judged = [(i in good) == (q == 1) for i, q in labels.items() if i in texts]
    assert sum(judged) / len(judged) > 0.97
    unique = [r["text"] for r in seen[2].collect()]
    assert len(unique) == len(set(unique))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in r["text"] for r in seen[3].collect() for i in items)
    assert any(i in r["text"] for r in seen[2].collect() for i in items)
    times = Counter(r["doc_id"] for r in seen[4].collect())
    assert max(times.values()) <= 3
    shards = seen[5].collect()
    assert Counter(r["doc_id"] for r in shards) == times and {r["shard"] for r in shards} == set(range(24))


def test_near_duplicates_without_ids(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = one.replace("a59", "other")
    rows = [(None, one, "x"), (None, one, "x"), (None, near, "y"), (5, two, "x"), (None, two, "x"), (7, three, "x"), (7, "another text of its own", "x"), (8, "unlike all of the others", "x"), (8, "unlike all of the others", "x"), (None, "", "x"), (9, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["text"]) for r in c.near_duplicates_stage(spark, docs, SF).collect())
    mine = [k for k in got if k[0] is None and k[1]]
    assert len(mine) == 1 and mine[0][1] in (one, near)
    assert got == Counter([mine[0], (5, two), (7, three), (7, "another text of its own"), (8, "unlike all of the others"), (None, ""), (9, None)])
    again = Counter((r["doc_id"], r["text"]) for r in c.near_duplicates_stage(spark, docs.orderBy(c.F.desc("source"), "text").repartition(3), SF).collect())
    assert got == again


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, `extra.col` string, size long, hash long, __times int"


def awkward_rows():
    words = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    a, b = words("a", 80), words("b", 60)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a + " tail", "en", "s", 1), (None, a, None, None, None), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "t", 0), (4, "", "en", "t", 0), (5, b, "de", "t", 1), (6, words("c", 9000), "de", "t", 1), (5, words("d", 40), "de", "t", 1)]
    return [(*r, "x", 7, 8, 9) for r in rows]


def test_stages_on_awkward_rows(spark):
    docs = spark.createDataFrame(awkward_rows(), AWKWARD).repartition(3)
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    for name, stage in c.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert set(texts(out)) <= set(texts(docs)), name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    kept = texts(c.near_duplicates_stage(spark, docs, SF))
    assert sum(n for (i, t), n in kept.items() if t and t.startswith("a0 ")) == 1
    assert {k for k in kept if k[1] and not k[1].startswith("a0 ")} == {k for k in texts(docs) if k[1] and not k[1].startswith("a0 ")}
    mixed = texts(c.mixing_stage(spark, docs, SF))
    assert all(t for _, t in mixed)  # nothing without words is taken
    shards = c.sharding_stage(spark, docs, SF)
    assert shards.count() == docs.count() and c.sharding_stage(spark, docs.where("false"), SF).count() == 0


def test_mixing_takes_rows_that_agree_together(spark):
    text = " ".join(f"w{i}" for i in range(10))
    rows = [(1, text, "en", "s", 1)] * 4 + [(None, text + " x", "en", "s", 1)] * 3 + [(9, "lone words here", "en", "s", 1), (9, "other words here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in c.mixing_stage(spark, docs, SF).collect())
    assert got == Counter({(1, text): 4, (None, text + " x"): 3, (9, "lone words here"): 1, (9, "other words here"): 1})  # one source: its target is its size
