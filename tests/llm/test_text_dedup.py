"""Window, substring and near-duplicate operators against brute force."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
from collections import defaultdict

import numpy as np

from quarry.llm import components, decontaminate, jaccard_join, runtime, sketch, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def windows_brute(rows, size):
    least = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            least[key] = min(least.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - size + 1):
            if least[tuple(w[s : s + size])] < (LAST if i is None else i):
                gone |= set(range(s, s + size))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_windows(spark, documents, awkward):
    got = substring_dedup.dedup_windows(documents, 50, keep_text=True)
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == windows_brute(awkward, 50)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_windows_with_a_full_sketch_lose_nothing(spark, documents, awkward, monkeypatch):
    monkeypatch.setattr(sketch, "repeated", lambda table, h: h == h)
    assert by_row(substring_dedup.dedup_windows(documents, 50), "doc_id", "n_words", "n_removed", "kept_sha256") == windows_brute(awkward, 50)


def substrings_brute(rows, size):
    order = sorted({((LAST if i is None else i), t or "") for i, t, *_ in rows})
    first, result = {}, {}
    for i, t in order:
        b = t.encode()
        for s in range(len(b) - size + 1):
            first.setdefault(b[s : s + size], (i, t, s))
    for i, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            j, u, at = first[b[s : s + size]]
            if j < i or (u == t and at < s):
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        result[i, t] = (len(b), sum(gone), sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])), hashlib.sha256(kept).hexdigest())
    return sorted(((i, *result[LAST if i is None else i, t or ""]) for i, t, *_ in rows), key=repr)


def test_substrings(spark, documents, awkward):
    got = suffix_dedup.dedup_substrings(documents, 100, keep_bytes=True)
    # Two null ids hold different texts that never judge each other; the brute force judges by id and text alike.
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == substrings_brute(awkward, 100)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_multikey_order_sorts_like_bytes():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, size=(300, 24), dtype=np.uint8)
    order = suffix_dedup.multikey_order(suffix_dedup._tokens(rows))
    assert [bytes(rows[i]) for i in order] == sorted(bytes(r) for r in rows)
    lcp = suffix_dedup.common_prefixes(rows, order)
    for a, b, n in zip(order[:-1], order[1:], lcp[1:], strict=True):
        assert (rows[a][:n] == rows[b][:n]).all() and (n == 24 or rows[a][n] != rows[b][n])


def components_brute(rows):
    sets = {}
    for k, (_, t, *_) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    parent[find(a)] = find(b)
    least = defaultdict(lambda: LAST)
    for k in sets:
        if rows[k][0] is not None:
            least[find(k)] = min(least[find(k)], rows[k][0])
    return sorted(((rows[k][0], len(sets[k]), (least[find(k)] if least[find(k)] < LAST else None) if sets[k] else rows[k][0]) for k in sets), key=repr)


def test_jaccard_components(spark, documents, awkward):
    assert by_row(jaccard_join.ngram_jaccard_join(documents), "doc_id", "n_shingles", "component_id") == components_brute(awkward)


def test_jaccard_with_tiny_blocks_and_star_rounds(spark, documents, awkward, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 600)
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    assert by_row(jaccard_join.ngram_jaccard_join(documents), "doc_id", "n_shingles", "component_id") == components_brute(awkward)


def test_jaccard_in_small_steps(spark, documents, awkward, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COUNT_STEP", 40)
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    assert by_row(jaccard_join.ngram_jaccard_join(documents), "doc_id", "n_shingles", "component_id") == components_brute(awkward)


def test_counting_shingles_in_steps(monkeypatch):
    """Equal to plain loops, and steps take well under the memory of one pass over all."""
    rng = np.random.default_rng(3)
    parts, blobs, home = 7, [], defaultdict(set)
    for _ in range(60):
        cid = np.repeat(rng.integers(1, 1 << 62, 2000), 5)
        token = rng.integers(0, 1 << 50, len(cid)).astype(np.uint64)
        token[::6] %= np.uint64(20000)
        token = token * np.uint64(parts) + np.uint64(2)
        blobs.append((token, *jaccard_join._pack(cid, np.full(len(cid), 9))))
        for t, c in zip(token.tolist(), cid.tolist(), strict=True):
            home[t].add(c)
    marks = np.sort(blobs[0][0][:3])
    marked = set(marks.tolist())
    wanted = {(t, c, jaccard_join.HOT_COUNT if t in marked else len(cs)) for t, cs in home.items() for c in cs if len(cs) > 1 or t in marked}
    peaks = []
    for step in (1 << 40, 1 << 14):
        monkeypatch.setattr(jaccard_join, "COUNT_STEP", step)
        tracemalloc.start()
        found = jaccard_join._repeated(list(blobs), marks, parts)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        token, cid, size, n = (np.concatenate(x).tolist() for x in zip(*found, strict=True))
        assert len(token) == len(wanted) and set(zip(token, cid, n, strict=True)) == wanted and set(size) == {9}
    assert peaks[1] < 0.6 * peaks[0], peaks


def test_width_of_a_projection_counts_whole_texts(spark, tmp_path):
    """The pipeline asks with two of many columns; Catalyst alone would give a fraction of the table."""
    rows = [(i, "w" * 4000, "en", "a", i, i) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, other long").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert runtime.input_bytes(docs.select((docs.doc_id + 1).alias("doc_id"), "text")) == runtime.input_bytes(docs)


def test_parts_of_shingles_are_tasks_of_their_own(spark, documents, monkeypatch):
    """As many tasks count shingles as there are parts: none gets several parts while others idle."""
    monkeypatch.setattr(jaccard_join, "partitions", lambda docs, mb_each=8.0: 24)
    plans = []
    monkeypatch.setattr(jaccard_join, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    jaccard_join._active(documents)
    assert plans[0].count("hashpartitioning(part") == 0 and plans[0].count("shufflepartitionidpassthrough") == 2


def test_components_both_ways(spark, monkeypatch):
    import random

    rng = random.Random(6)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    df = spark.createDataFrame(pairs, "a long, b long")
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    for most in (components.LOCAL_EDGES, 0):
        monkeypatch.setattr(components, "LOCAL_EDGES", most)
        got = {r["node"]: r["root"] for r in components.components(df).collect()}
        assert all(got.get(x, x) == find(x) for x in parent)


def test_prefix_tree_finds_every_link():
    import random

    rng = random.Random(2)
    for _ in range(30):
        sets = [sorted(rng.sample(range(40), rng.randrange(5, 30))) for _ in range(25)]
        sets += [sorted(set(s) ^ {rng.randrange(40)}) for s in sets[:12]]
        tree = jaccard_join.PrefixTree()
        for s in sets:
            tree.add(s, len(s))
        parent = list(range(len(sets)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                n = len(set(sets[a]) & set(sets[b]))
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    parent[find(a)] = find(b)
        same = lambda f, m: {tuple(f(a) == f(b) for b in range(m)) for a in range(m)}
        assert same(tree.find, len(sets)) == same(find, len(sets))


def test_empty_tables(spark, documents):
    none = documents.where("false")
    assert substring_dedup.dedup_windows(none).count() == 0
    assert suffix_dedup.dedup_substrings(none).count() == 0
    assert jaccard_join.ngram_jaccard_join(none).count() == 0


def test_leaks_found_verified_and_clean_left(spark, documents):
    import random

    from .conftest import SCHEMA, prose

    rng = random.Random(4)
    items = [(k, prose(rng, 25 + k % 20)) for k in range(40)] + [(90, None), (91, "a b"), (None, prose(rng, 30))]
    rows, edited = [], set()
    for k, (item, text) in enumerate(items[:40]):
        words = text.split(" ")
        for _ in range(k % 4):
            p = rng.randrange(len(words))
            words[p : p + 1] = [[], ["changed"], [words[p], "more"]][rng.randrange(3)]
        rows.append((200 + k, f"{prose(rng, 80)} {' '.join(words)} {prose(rng, 20)}", "en", "a", 1))
        edited.add((200 + k, item))
    rows += [(100 + k, prose(rng, 200), "en", "a", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(documents.where("doc_id is null or text is null"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert len(found & edited) >= 38 and {(200 + k, k) for k in range(0, 40, 4)} <= found and found <= edited
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in found}
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0 and decontaminate.decontaminate(docs.where("false"), bench).count() == 0


def test_edit_search_is_exact():
    import random

    rng = random.Random(9)
    for _ in range(60):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 14)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            row, old = [i], row
            for j, x in enumerate(t, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != x)))
        assert decontaminate.edit_search(p, t) == min(row)


def test_leaks_by_character_edits():
    import random

    import pyarrow as pa

    from quarry.llm.text import chunks

    from .conftest import prose

    rng = random.Random(7)
    items = [(k, prose(rng, 12 + k, 200)) for k in range(40)]
    texts = []
    for _, t in items:
        b = list(t)
        for p in rng.sample(range(len(b)), len(b) * 18 // 100):
            b[p] = rng.choice(["#", "", b[p] + "#"])
        texts.append(f"{prose(rng, 80)} {''.join(b)} {prose(rng, 20)}")
    index = decontaminate.ItemIndex(items)
    found = {(i + doc, item): d for i, _, data, offs in chunks(pa.array(texts)) for doc, item, d in index.find(data, offs)}
    least = [decontaminate.edit_search(t, " ".join(x.lower().split()).encode()) for t, x in zip(index.texts, texts, strict=True)]
    leaks = {(k, k): d for k, d in enumerate(least) if d <= 0.2 * len(index.texts[k])}
    assert len(leaks) >= 36 and found == leaks


def test_leaks_of_items_of_few_words():
    import random

    import numpy as np
    import pyarrow as pa

    from quarry.llm.text import chunks

    from .conftest import prose

    rng = random.Random(8)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(90))
    items = [(1, han), (2, "https://example.org/a/b?c=1"), (3, "Quick  Brown fox"), (4, "zq"), (5, " \n")]
    texts = [prose(rng, 50) + han + prose(rng, 50), "see HTTPS://example.org/A/b?c=2, there", "the quick\nbrwn FOX ran", "a zq b", prose(rng, 300), "quick brown", "fox", "", None, han[:40] + "\u3042" * 8 + han[40:]]
    index = decontaminate.ItemIndex(items)
    found = {(i + doc, index.ids[item]): d for i, _, data, offs in chunks(pa.array(texts)) for doc, item, d in index.find(data, offs)}
    assert found == {(0, 1): 0, (1, 2): 1, (2, 3): 1, (3, 4): 0, (9, 1): 24}
    for pattern in (b"zq", b"quick brown fox", b"0123456789" * 6):
        for _ in range(20):
            t = bytes(rng.choice(pattern) for _ in range(rng.randrange(1, 90)))
            ends, distances = decontaminate.short_search(pattern, np.frombuffer(t, np.uint8))
            best = decontaminate.edit_search(pattern, t)
            assert min(distances.tolist(), default=None) == (best if best <= 0.2 * len(pattern) else None)
