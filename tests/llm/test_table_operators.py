"""Row, mix, shard, classifier, licence and media operators against brute force, SQL and round trips."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import licenses, media, mixing, quality, queries, sharding, url_filter
from tools.compare import connect, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(rel.fetchall(), rel.columns)


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if None not in r[:2] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_filter(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", -1)
    rules = [*url_filter.RULES, ("a.b.com", "/x", "block"), ("a.b.com", "/x", "allow"), ("c.org", "", "block"), (None, "/", "block"), ("d.org", "/p/q", "allow"), ("d.org", "/p/", "block")]
    urls = [None, "", "nourl", "http://", "HTTP://WWW.Example.COM/en/1?q#f", "https://example.com/en/", "https://xexample.com/en/", "http://a.b.com/xyz", "http://s.c.org", "http://c.org?x", "http://d.org/p/q/r", "http://d.org/p/", "http://n.net/es/1", "http://n.net/ES/1", "http://com/", "http://u@h.com:80/a#b", "a://b://c.com/"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls + urls[3:6])], "page_id long, url string, host string, verdict int")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    assert got == sorted((i, *judge(u, rules)) for i, u in enumerate(urls + urls[3:6]))
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.filter_urls(pages, none).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.where("false"), none).count() == 0


def targets_brute(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in stopped)
        open_ = sum(w[s] for s in order if s not in stopped)
        over = {s for s in order if s not in stopped and left * w[s] >= cap * sizes[s] * open_}
        if not over:
            return {s: float(cap * sizes[s]) if s in stopped else left * w[s] / open_ for s in order}
        stopped |= over


def test_mixing(spark, documents, awkward):
    got = mixing.mix_sources(documents).collect()
    size = Counter()
    for _, t, _, s, _ in awkward:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets_brute(size)
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(awkward) and all(taken[s] == int(want[s] + 1e-9) for s in want)
    again = mixing.mix_sources(documents.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_sources(documents.where("false")).count() == 0


def test_targets_reshare_until_none_is_above(spark):
    for sizes in ({"a": 1, "b": 1000, "c": 10, "d": 5, None: 70}, {"a": 0}, {"a": 7, "b": 7}):
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(targets_brute(sizes))


def test_sharding(spark, documents, awkward):
    rows = sharding.shard_documents(documents, 5).collect()
    assert len(rows) == len(awkward)
    where, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
    want = Counter((zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for _, t, *_ in awkward)
    assert want == Counter((r["text_crc32"], r["size"]) for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(5))
    assert all(len(s) == 1 for s in where.values())  # no group of equal texts is large here
    assert sharding.shard_documents(documents.where("false"), 5).count() == 0


def test_shards_are_near_equal_and_large_groups_are_dealt(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text " * 20)).otherwise(F.repeat(F.md5(F.col("id").cast("string")), 5)).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    load = Counter()
    for r in sharding.shard_documents(docs, 24).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 24 and max(load.values()) < 1.05 * min(load.values())


def test_quality(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op4_quality"](spark, SF.replace("0.001", "0.01")).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in out.items())
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet").collect() if r["doc_id"] in out]
    held = [(out[i]["predicted"], q) for i, q in labels if out[i]["held_out"]]
    assert len(held) > 30 and sum(p == q for p, q in held) / len(held) > 0.95


def test_quality_without_labels_and_on_awkward_rows(spark, documents, awkward):
    model = quality.train(documents, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.classify(documents, model).collect()
    assert len(got) == len(awkward) and {r["score"] for r in got} == {0.5}
    assert quality.classify(documents, model, keep_columns=True).count() == len(awkward)
    assert quality.classify(documents.where("false"), model).count() == 0


def test_boosting_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.BoostedTrees(60, 3).fit(x[:600], y[:600])
    assert ((model.predict(x[600:]) > 0.5) == y[600:]).mean() > 0.95


def test_licenses(spark):
    mit = "The MIT License (MIT)\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + licenses.SENTENCES[10][0]
    texts = [(1, mit), (2, "Intro.  Licensed under the Apache License, Version 2.0. licensed UNDER cc by-nc 4.0."), (3, None), (4, ""), (None, "All rights reserved."), (6, "Released under the MIT License! Released under the MIT License."), (7, "nothing " * 5000)]
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: ("Apache-2.0|CC-BY-NC-4.0", ""), 3: ("", ""), 4: ("", ""), None: ("", "rights-reserved"), 6: ("MIT", ""), 7: ("", "")}


def test_licenses_wrapped(spark):
    known = licenses.SENTENCES
    wrap = lambda s, n, sign: "\n".join(sign + " ".join(s.split()[i : i + n]) for i in range(0, len(s.split()), n))
    texts = [(4 * k + v, f"Some code.\n\n{t}\n\nMore text.") for k, (s, _) in enumerate(known) for v, t in enumerate((s, wrap(s, 3, ""), wrap(s, 4, " * "), wrap(s, 5, "# ")))]
    by = dict(known)
    bsd = " ".join(next(s for s, i in known if i == x) for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"))
    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one"
    texts += [(1000, wrap(bsd, 7, "// ")), (1001, wrap(gpl2, 9, "# ")), (1002, mpl), (1003, "SPDX-License-Identifier: MIT-0"), (1004, "# SPDX-License-Identifier: MIT OR Apache-2.0"), (1005, "submit the MIT Licenses (MIT)")]
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, (s, i) in enumerate(known):
        assert [got[4 * k + v][0] for v in range(4)] == [by[s]] * 4, (s, i)
    assert [got[n][1] for n in range(1000, 1006)] == ["BSD-3-Clause", "GPL-2.0-or-later", "MPL-2.0", "", "MIT", ""]


def test_licenses_far_apart_make_no_run(spark):
    by = {i: s for s, i in licenses.SENTENCES}
    three = [by[i] for i in ("bsd-grant", "bsd-source", "bsd-binary")]
    filler = "some other words of a paragraph go here "
    texts = [(n, f"{three[0]}\n{filler * n}\n{three[1]}\n{three[2]}") for n in (0, 1, 24, 26, 90)]
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {n: bool(x) for n, (x, _) in got.items()} == {0: True, 1: True, 24: True, 26: False, 90: False}
    assert got[90] == ("", "bsd-grant|bsd-source|bsd-binary")


def test_text_media_round_trip(spark, documents, awkward):
    got = sorted((r for r in media.text_media(documents).collect()), key=lambda r: (repr(r["doc_id"]), r["payload_sha256"]))
    want = []
    for i, t, *_ in awkward:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        m = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()))
    assert [tuple(r)[:7] for r in got] == sorted(want, key=lambda r: (repr(r[0]), r[3]))


def bmp(image):
    h, w, _ = image.shape
    rows = b"".join(r[:, ::-1].tobytes() + bytes(-w * 3 % 4) for r in image[::-1])
    head = (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24)
    return b"BM" + head + rows


def test_media_formats(spark):
    rng = np.random.default_rng(5)
    grey, rgb = rng.integers(0, 256, (7, 5), dtype=np.uint8), rng.integers(0, 256, (6, 9, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P2 # c\n5 7\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode(b"P6\n9 6\n255\n" + rgb.tobytes()) == rgb).all() and (media.decode(bmp(rgb)) == rgb).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 1, 0], [1, 0, 1]] == media.decode(b"P4\n3 2\n\xa0\x40").tolist()
    whole = grey[:6, :4].astype(float)
    assert np.allclose(media.area_resize(whole, 3, 2), whole.reshape(3, 2, 2, 2).mean(axis=(1, 3)))
    assert media.area_resize(grey, 4, 9).sum() / 36 == pytest.approx(grey.mean())
    df = spark.createDataFrame([(1, bytearray(bmp(rgb))), (2, None), (3, bytearray(b"junk")), (4, bytearray(b"P5\n9 9\n255\n"))], "id long, media binary")
    got = {r["id"]: r for r in media.media_columns(df).collect()}
    assert (got[1]["height"], got[1]["width"]) == (6, 9) and np.load(io.BytesIO(bytes(got[1]["npy"]))).shape == (32, 32) and len(got[1]["dhash"]) == 16
    assert all(got[i]["npy"] is None for i in (2, 3, 4))
