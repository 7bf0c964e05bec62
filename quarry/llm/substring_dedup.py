"""Substring dedup on word windows: a count-min prefilter, then exact grouping of what it lets through.

A window is 50 consecutive words. To keep the sketch small it counts anchors, not windows: the
8-word gram of least hash in a window. Equal windows have equal anchors, so an anchor's estimate
is never below its windows' counts, and one in twenty grams is an anchor. The second pass groups the
windows whose anchor is estimated at two or more by 128 bits: two hashes, each of its own half of
the words' 128-bit digests, so that neither depends on the other's. A full sketch would only let more through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .runtime import input_bytes, materialize, partitions
from .text import U64, chunks, gram_hashes, minimizers, mix, runs, split_by, within, word_digests, word_hashes, words

GRAM = 8
FLUSH = 1 << 20
NO_ID = (1 << 63) - 1


def _anchors(data: np.ndarray, offs: np.ndarray, window: int):
    starts, ends, firsts = words(data, offs)
    digests = word_digests(data, starts, ends)
    n = len(starts)
    grams = gram_hashes(digests[0], GRAM)
    at = minimizers(grams, within(firsts, n, window), window - GRAM + 1) if n >= window else np.zeros(0, np.int64)
    return firsts, digests, grams, *runs(at)


def _repeats(docs: DataFrame, window: int) -> DataFrame:
    """(k, t, hashes): for each document the hashes of its windows that a smaller doc_id has too.

    ``docs`` has k (the doc_id that judges), t (a hash of the text, so that rows of one k are answered apart) and text.
    """

    def extract(data, offs):
        *_, grams, a, _, _ = _anchors(data, offs, window)
        return grams[a], None

    table = docs.sparkSession.sparkContext.broadcast(sketch.build(docs, extract, sketch.bits_for(input_bytes(docs) / 75))[0])
    parts = partitions(docs)
    names = ["part", "known", "h1", "h2", "k", "t"]

    def rows(found: list) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        h1, h2, k, t, g = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        order = np.lexsort((k, h2, h1))
        h1, h2, k, t, g = h1[order], h2[order], k[order], t[order], g[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        least = k[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        # Of each window the least k asks, once for each of its texts; the others are known to be later.
        first = k == least
        first[1:] &= new[1:] | (t[1:] != t[:-1])
        out = []
        for known, at in ((0, np.flatnonzero(first)), (1, np.flatnonzero(k > least))):
            # Equal windows have equal anchors, and a document's neighbouring windows mostly one, so by anchors it asks few tasks.
            part = (mix(g[at]) if not known else mix(t[at].view(np.uint64))) % U64(parts)
            out += [(p, known, h1[at[i]].tobytes(), h2[at[i]].tobytes() if not known else b"", k[at[i]].tobytes(), t[at[i]].tobytes()) for p, i in split_by(part.astype(np.int32))]
        types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, _, data, offs in chunks(b.column(2)):
                firsts, digests, grams, a, lo, hi = _anchors(data, offs, window)
                keep = sketch.repeated(table.value, grams[a])
                a, lo, hi = a[keep], lo[keep], hi[keep]
                if not len(lo):
                    continue
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                owner = i + np.searchsorted(firsts, at, side="right") - 1
                found.append((*(gram_hashes(d, window)[at] for d in digests), ids[owner], texts[owner], np.repeat(grams[a], n)))
                size += len(at)
                if size >= FLUSH:
                    yield from rows(found)
                    found, size = [], 0
        yield from rows(found)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, known = [], []
        for b in batches:
            for flag, *blobs in zip(*[b.column(i).to_pylist() for i in (1, 2, 3, 4, 5)], strict=True):
                h1, h2, k, t = (np.frombuffer(x, kind) for x, kind in zip(blobs, (np.uint64, np.uint64, np.int64, np.int64), strict=True))
                known.append((h1, k, t)) if flag else ask.append((h1, h2, k, t))
        if ask:
            h1, h2, k, t = (np.concatenate(x) for x in zip(*ask, strict=True))
            ask.clear()
            order = np.lexsort((k, h2, h1))
            h1, h2, k, t = h1[order], h2[order], k[order], t[order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            later = k > k[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
            known.append((h1[later], k[later], t[later]))
        if known:
            h, k, t = (np.concatenate(x) for x in zip(*known, strict=True))
            (keys, texts), blob = sketch.grouped([k, t], h)
            for i in range(0, len(keys), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 10_000]), pa.array(texts[i : i + 10_000]), blob[i : i + 10_000]], names=["k", "t", "hashes"])

    asked = docs.select("k", "t", "text").mapInArrow(candidates, "part int, known int, h1 binary, h2 binary, k binary, t binary")
    return asked.repartition(parts, "part").mapInArrow(resolve, "k long, t long, hashes binary").groupBy("k", "t").agg(F.collect_list("hashes").alias("hashes"))


def dedup_windows(docs: DataFrame, window: int = 50, keep_text: bool = False) -> DataFrame:
    """Remove each word covered by a window that also starts in a document of smaller doc_id.

    Words are ``[^\\x20\\x09-\\x0D]+``; windows are judged on the input. Returns doc_id, n_words,
    n_removed and kept_sha256 (of the kept words joined by one space), and with ``keep_text``
    kept_text. A null text has no words; a null doc_id comes after all others, and rows of one
    doc_id (null included) are one document to each other, so repeats of a row are judged alike.
    Texts below ``window`` words stay whole. Empty tables give no rows; other columns are ignored.

    A window that a third of the documents share costs one entry a task: within a task only the least
    doc_id asks, and the others are known to be later.
    """
    d = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    found = materialize(_repeats(d, window))
    # A text too short for a window asks for a key of its own that is never answered, so equal short texts don't pile up.
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * window - 1
    d = d.withColumn("t", F.when(short, F.monotonically_increasing_id()).otherwise(F.col("t"))).withColumn("short", short)
    parts = partitions(docs, 16.0)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            replies = b.column(2)
            for i, j, data, offs in chunks(b.column(1)):
                starts, ends, firsts = words(data, offs)
                keep = np.ones(len(starts), dtype=bool)
                asked = [r for r in range(i, j) if replies[r].is_valid]
                if asked:
                    grams = gram_hashes(word_hashes(data, starts, ends), window)
                    for r in asked:
                        lo, hi = firsts[r - i], firsts[r - i + 1]
                        if hi - lo < window:
                            continue
                        mine = grams[lo : hi - window + 1]
                        listed = np.unique(np.frombuffer(b"".join(replies[r].as_py()), np.uint64))
                        hit = np.flatnonzero(listed[np.minimum(np.searchsorted(listed, mine), len(listed) - 1)] == mine)
                        cover = np.zeros(hi - lo + 1, np.int32)
                        np.add.at(cover, hit, 1)
                        np.add.at(cover, hit + window, -1)
                        keep[lo:hi] = np.cumsum(cover[:-1]) == 0
                out = np.append(data, np.uint8(32))
                flags = np.zeros(len(data) + 2, np.int8)
                flags[starts[keep]] += 1
                np.add.at(flags, ends[keep] + 1, -1)  # with one byte after each word, made a space
                mask = np.cumsum(flags[:-1], dtype=np.int8) > 0
                at_end = np.isin(ends, offs[1:])
                out[ends[~at_end]] = 32
                # A word that ends its text has no byte of its own to follow it: that of the next text must not count.
                tail = ends[keep & at_end]
                own = np.isin(tail, starts[keep])
                mask[tail[~own]] = False
                sums = np.concatenate([[0], np.cumsum(mask)])
                flat = out[mask]
                counts = np.concatenate([[0], np.cumsum(keep)])
                for r in range(j - i):
                    lo, hi = sums[offs[r]], sums[offs[r + 1]]
                    kept = flat[lo:hi]
                    if len(kept) and kept[-1] == 32:
                        kept = kept[:-1]
                    w = int(firsts[r + 1] - firsts[r])
                    n_words.append(w)
                    n_removed.append(w - int(counts[firsts[r + 1]] - counts[firsts[r]]))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        texts.append(kept.tobytes().decode())
            cols = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * keep_text, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + keep_text])

    keys = ["k", "t", "short"]
    joined = d.repartition(parts, *keys).join(found.withColumn("short", F.lit(False)).repartition(parts, *keys), keys, "left").select("doc_id", "text", "hashes")
    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: 50-word windows over all of ``documents``."""
    return dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)


SQL = """
WITH w AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS n, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT n, doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT n, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
l AS (SELECT h, min(coalesce(doc_id, 9223372036854775807)) AS least FROM g GROUP BY h HAVING min(coalesce(doc_id, 9223372036854775807)) < max(coalesce(doc_id, 9223372036854775807))),
c AS (SELECT DISTINCT n, unnest(range(i, i + 50)) AS i FROM g JOIN l USING (h) WHERE coalesce(doc_id, 9223372036854775807) > least),
r AS (SELECT n, list(i) AS gone FROM c GROUP BY n)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (n)
"""
