"""Equality is by bytes: inputs whose sums of odd multiples cancel, hot keys, and statistics against plain loops."""

from __future__ import annotations

import collections
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import jaccard_join, media, prefix_sum, quality, sharding, substring_dedup, suffix_dedup, text

from .conftest import SCHEMA, prose
from .test_text_dedup import by_row, components_brute, substrings_brute, windows_brute

LONG = ["".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1024)) for flip in (0, 1)]


@pytest.mark.parametrize("parts", [1, 3])
def test_long_words_that_differ_are_told_apart(spark, parts):
    rest = " ".join(f"r{i}" for i in range(49))
    rows = [(i, f"{w} {rest}", "en", "a", 1) for i, w in enumerate(LONG)] + [(2, f"{LONG[1]} {rest}", "en", "a", 1), (3, f"{LONG[0]} b c", "en", "a", 1), (4, f"{LONG[1]} b c", "en", "a", 1)]
    rows += [(10 + n, w, "en", "a", 1) for n, w in enumerate(["a" * 15, "a" * 15 + "\0", "a" * 16, "a\0", "a", "a\0\0", "b" * 31, "b" * 32])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert by_row(substring_dedup.dedup_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == windows_brute(rows, 50)
    assert by_row(jaccard_join.ngram_jaccard_join(docs), "doc_id", "n_shingles", "component_id") == components_brute(rows)


@pytest.mark.parametrize("parts", [1, 4])
def test_case_changes_repeat_nothing(spark, parts):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghij ") for _ in range(360))
    rows = [(0, base, "en", "a", 1)]
    for i in range(1, 40):
        p = rng.randrange(90, 100)
        q = p + 8 * rng.randrange(1, 20)
        rows.append((i, "".join(c.upper() if at in (p, q) else c for at, c in enumerate(base)), "en", "a", 1))
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == substrings_brute(rows, 100)


def test_hot_grams_give_their_strings_to_other_anchors(spark, monkeypatch):
    rng = random.Random(5)
    line = "a very common line of words "
    rows = [(i, "".join(f"{line}{prose(rng, 4, 40)} " for _ in range(6)), "en", "a", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 0)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10**9)  # every sampled gram is hot
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 700)  # and blocks end inside texts
    got = suffix_dedup.dedup_substrings(docs)
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == substrings_brute(rows, 100)


def test_minimizers_in_steps(monkeypatch):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 40, 3000, dtype=np.uint64) << np.uint64(30)
    valid = rng.random(2975) < 0.9
    want = np.where(valid, [s + int(np.argmin(h[s : s + 26])) for s in range(2975)], -1)
    for step in (1 << 22, 100, 7):
        monkeypatch.setattr(text, "MINIMIZER_STEP", step)
        assert (text.minimizers(h, valid, 26) == want).all()


@pytest.mark.parametrize("least", [4096, 3])
def test_running_sums_with_hot_keys(spark, monkeypatch, least):
    monkeypatch.setattr(prefix_sum, "HOT_LEAST", least)
    monkeypatch.setattr(prefix_sum, "HOT", 1)
    rng = random.Random(1)
    rows = [(i % 2, None if i % 3 == 0 else i, rng.randrange(5), rng.randrange(1 << 40) if i % 4 else 77) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, id long, size long, h long").withColumn("key", prefix_sum.hash_key(F.col("id")))
    got = prefix_sum.with_running_sum(df, "g", "key", F.col("size"), ["id", "size"], "h", "before").collect()
    for g in (0, 1):
        mine = sorted(((r["key"], -1 if r["id"] is None else r["id"], r["size"], r["h"] % prefix_sum.DEAL, r["h"], r["before"]) for r in got if r["g"] == g))
        sums = [sum(r[2] for r in mine[:i]) for i in range(len(mine))]
        by_tie, want = collections.defaultdict(list), collections.defaultdict(list)
        for r, s in zip(mine, sums, strict=True):
            by_tie[r[:5]].append(r[5])
            want[r[:5]].append(s)
        assert {k: sorted(v) for k, v in by_tie.items()} == {k: sorted(v) for k, v in want.items()}


def test_text_operators_with_many_null_ids(spark):
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(None if i % 3 == 0 else i, f"{prose(rng, 20)} {shared if i % 2 else ''} {prose(rng, 15)}", "en", "a", 1) for i in range(60)] + [(None, "", "en", "a", 0)] * 30 + [(None, shared, "en", "a", 1)] * 4
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert by_row(substring_dedup.dedup_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == windows_brute(rows, 50)
    assert by_row(suffix_dedup.dedup_substrings(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == substrings_brute(rows, 100)


def features_brute(t: str) -> list[float]:
    b = t.encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    lines = [x for x in re.findall(rb"[^\n]*\n|[^\n]+$", b)]
    n, size = max(len(w), 1), max(len(b), 1)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    kind = {k: set(v) for k, v in quality.CLASSES.items()}
    has = lambda x, *ks: sum(c in kind[k] for c in x for k in ks)
    out = [math.log1p(len(b)), math.log1p(len(w)), sum(map(len, w)) / n, math.log1p(max(map(len, w), default=0))]
    out += [has(b, k) / size for k in quality.CLASSES]
    out += [len(set(w)) / n, max(collections.Counter(w).values(), default=0) / n, len(set(grams)) / max(len(grams), 1)]
    out += [math.log1p(len(lines)), math.log1p(len(b) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1)]
    return out + [sum(has(x, "upper") > 1 for x in w) / n, sum(has(x, "symbol", "shout", "digit") > 0 for x in w) / n, sum(len(x) < 3 for x in w) / n]


def test_features_equal_plain_loops(awkward):
    import pyarrow as pa

    texts = [t or "" for _, t, *_ in awkward] + ["A\n\nA\nB", "\n", "x!\nx!\nÄÖ 12 $$ ABC", LONG[0]]
    got = np.concatenate([quality.features(data, offs) for *_, data, offs in text.chunks(pa.array(texts))])
    assert np.allclose(got, [features_brute(t) for t in texts])


def test_training_reads_one_row_a_label(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    once, often = quality.train(documents, labels), quality.train(documents.union(documents).union(documents), labels)
    assert (once.leaf == often.leaf).all() and (once.threshold == often.threshold).all()


def hash_brute(image: np.ndarray) -> str:
    h, w = image.shape
    cell = lambda i, j: sum(
        float(image[y, x]) * max(0, min(y + 1, (i + 1) * h / 8) - max(y, i * h / 8)) * max(0, min(x + 1, (j + 1) * w / 9) - max(x, j * w / 9)) for y in range(int(i * h / 8), min(h, math.ceil((i + 1) * h / 8))) for x in range(int(j * w / 9), min(w, math.ceil((j + 1) * w / 9)))
    )
    scale = 72 / (h * w)
    bits = "".join("1" if round(cell(i, j) * scale, 6) < round(cell(i, j + 1) * scale, 6) else "0" for i in range(8) for j in range(8))
    return f"{int(bits, 2):016x}"


def test_media_features_equal_plain_loops(spark, documents, awkward):
    want = []
    for i, t, *_ in awkward:
        b = (t or "").encode()
        p = np.frombuffer(b + bytes(-len(b) % 64 if b else 64), np.uint8).reshape(-1, 64)
        want.append((i, zlib.crc32(p.tobytes()), f"{hash_brute(p)}:{p.mean():.4f}"))
    got = [(r["doc_id"], r["payload_crc"], r["feature"]) for r in media.text_media(documents).select("doc_id", "feature", "bmp_sha256", "npy_sha256", F.lit(0).alias("payload_crc")).collect()]
    assert sorted((repr(a), f) for a, _, f in got) == sorted((repr(a), f) for a, _, f in want)


def test_images_without_pixels_and_clashing_names(spark):
    blobs = [b"P5\n0 0\n255\n", b"P6\n3 0\n255\n", b"P1\n0 4\n", b"P5\n2 2\n0\n\0\0\0\0", b"BM" + bytes(60), media.encode_bmp(np.zeros((1, 1), np.uint8))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "height long, npy binary")
    got = {r["key"]: r for r in media.media_columns(df, column="npy", key="height").collect()}
    assert all(got[i]["height"] is None and got[i]["npy"] is None for i in range(5)) and got[5]["height"] == 1
    assert np.load(io.BytesIO(bytes(got[5]["npy"]))).shape == (32, 32)


def test_bmp_round_trip():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (3, 5), (7, 64), (2, 3)):
        a = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_bmp(a))[:, :, 0] == a).all()


def test_splits_come_near_their_goals(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(1, 90), (rng.randrange(1 << 20) << 24) + rng.randrange(1 << 24), (rng.choice([3, 9, 9, 1 << 22]) << 24) + rng.randrange(1 << 24)) for _ in range(1500)]
    points = spark.createDataFrame(rows, "size long, c0 long, c1 long")
    splits = sharding.kd_shards(points, 7, 2, 0.0)
    leaves = {0: (rows, 7)}
    for node, dim, cut, left, right in splits:
        mine, k = leaves.pop(node)
        span = [max(r[d + 1] for r in mine) // (1 << 24) - min(r[d + 1] for r in mine) // (1 << 24) for d in (0, 1)]
        assert dim == (0 if span[0] >= span[1] else 1)
        goal = sum(r[0] for r in mine) * (k // 2) / k
        best = min(abs(sum(r[0] for r in mine if r[dim + 1] < c) - goal) for c in {r[dim + 1] for r in mine} | {max(r[dim + 1] for r in mine) + 1})
        halves = [r for r in mine if r[dim + 1] < cut], [r for r in mine if r[dim + 1] >= cut]
        assert abs(sum(r[0] for r in halves[0]) - goal) == pytest.approx(best)
        leaves |= {left: (halves[0], k // 2), right: (halves[1], k - k // 2)}
    assert len(leaves) == 7 and all(k == 1 for _, k in leaves.values())
    loose = sharding.kd_shards(points, 7, 2)
    assert len(loose) == len(splits)
