"""Suffix-array dedup: repeated 100-byte strings found by range-partitioned, locally sorted suffixes.

Not every suffix is sorted. A 100-byte string is assigned to its anchor, the 16-byte gram of
least hash in it; equal strings have equal anchors at equal offsets, so it is enough to sort the
suffixes that start at anchors (one byte in forty) and, for what lies before the anchor, the
reversed prefixes that end there. A string is equal to another where both orders agree: their
common prefixes reach far enough to the right and to the left. Sampled leading tokens (8 bytes)
split the suffixes into buckets by range and volume; a leading token never straddles two buckets, so no
pair of equal strings crosses a boundary. A gram that holds a noticeable share of all sampled contexts
gives its strings to their next best anchors, so that one lead doesn't fill a bucket. A count-min
sketch of anchors keeps suffixes out whose anchor occurs once.
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
from .substring_dedup import NO_ID
from .text import STEP_BYTES, U64, chunks, join, minimizers, mix, runs, split_by, tokens_at

GRAM = 16
LEAD = 8
FLUSH = 1 << 17
#: A gram with more than this share of the sampled contexts, and so many samples at least, is hot: there are at most 256.
HOT_SHARE, HOT_LEAST = 256, 8
META = np.dtype([("k", "<i8"), ("h", "<i8"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1")])
SPAN = np.dtype([("k", "<i8"), ("h", "<i8"), ("start", "<u4"), ("end", "<u4")])


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows by their columns (64-bit tokens): each round sorts only runs that are tied so far by the next token."""
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    new = np.concatenate([[True], first[1:] != first[:-1]])[: len(order)]
    run = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    for w in range(1, words.shape[1]):
        tied = np.flatnonzero(np.bincount(run, minlength=len(order))[run] > 1)
        if not len(tied):
            break
        value, group = words[order[tied], w], run[tied]
        within_run = np.lexsort((value, group))
        order[tied] = order[tied][within_run]
        value = value[within_run]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])])
        run[tied] = np.maximum.accumulate(np.where(new, tied, 0))
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with its predecessor in ``order`` (the first: 0)."""
    out = np.zeros(len(order), np.int32)
    for i in range(1, len(order), 1 << 16):
        j = min(len(order), i + (1 << 16))
        differ = rows[order[i:j]] != rows[order[i - 1 : j - 1]]
        out[i:j] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _tokens(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def repeats_in_bucket(context: np.ndarray, meta: np.ndarray, length: int) -> np.ndarray:
    """Spans of the strings of ``length`` in one bucket that start earlier too.

    ``context`` holds the bytes around each anchor: length - 16 before it, length from it. A row
    stands for the strings that begin lo to hi bytes before its anchor.
    """
    left = length - GRAM
    order = multikey_order(_tokens(context[:, left:]))
    lcp = common_prefixes(context[:, left:], order)
    shared = lcp >= GRAM
    live = order[shared | np.append(shared[1:], False)]
    context, meta = context[live], meta[live]
    by = np.lexsort((meta["pos"], meta["h"], meta["k"]))
    context, meta = context[by], meta[by]
    n = len(meta)
    if not n:
        return np.zeros(0, SPAN)
    sides = []
    for rows in (context[:, left:], context[:, left - 1 :: -1] if left else context[:, :0]):
        o = multikey_order(_tokens(rows))
        sides.append((o, common_prefixes(rows, o)))

    def classes(side: int, size: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[sides[side][0]] = np.cumsum(sides[side][1] < size)
        return out

    k, h, pos = meta["k"], meta["h"], meta["pos"]
    again = np.zeros((n, left + 2), dtype=bool)
    for offset in range(left + 1):
        at = np.flatnonzero((meta["lo"] <= offset) & (offset <= meta["hi"]))
        if len(at) < 2:
            continue
        key = (classes(0, length - offset) * (n + 1) + classes(1, offset))[at] if offset else classes(0, length)[at]
        o = np.argsort(key, kind="stable")
        at, key = at[o], key[o]
        i = np.arange(len(at))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = at[np.maximum.accumulate(np.where(new, i, 0))]
        own = new | np.concatenate([[True], (k[at[1:]] != k[at[:-1]]) | (h[at[1:]] != h[at[:-1]])])
        mine = at[np.maximum.accumulate(np.where(own, i, 0))]
        again[at, offset] = (k[head] < k[at]) | (pos[mine] < pos[at])
    step = np.diff(np.concatenate([np.zeros((n, 1), np.int8), again.astype(np.int8)], axis=1), axis=1)
    row, first = np.nonzero(step == 1)
    _, past = np.nonzero(step == -1)
    out = np.zeros(len(row), SPAN)
    out["k"], out["h"] = k[row], h[row]
    out["start"], out["end"] = pos[row] - (past - 1), pos[row] - first + length
    return out


def _windows(data: np.ndarray, offs: np.ndarray, length: int, hot: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(first anchor, anchor, gram hashes, offset) for the windows of ``length`` bytes of blocks of a chunk; -1 where none is.

    Of a window whose least gram is ``hot`` the second anchor is the least of its other grams.
    """
    n = len(data)
    for x in range(0, n - length + 1, STEP_BYTES):
        m = min(STEP_BYTES, n - length + 1 - x)
        at = tokens_at(data[x : x + m + length - 1])
        grams = join(mix(at[: m + length - GRAM]), at[8 : m + length - GRAM + 8])
        lo, hi = np.searchsorted(offs, x, side="right") - 1, np.searchsorted(offs, x + m, side="left")
        ends = np.repeat(offs[lo + 1 : hi + 1], np.diff(np.clip(offs[lo : hi + 1], x, x + m)))
        inside = np.arange(x + length, x + length + m) <= ends
        first = chosen = minimizers(grams, inside, length - GRAM + 1)
        if hot is not None and len(hot):
            known = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
            if known.any():
                ordered = (grams >> U64(1)) | (known.astype(np.uint64) << U64(63))
                chosen = np.where(known[first], minimizers(ordered, inside, length - GRAM + 1), first)
        yield first, chosen, grams, x


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """(k, h, spans): for each document the byte spans that repeat earlier text, possibly overlapping."""
    left, wide = length - GRAM, 2 * length - GRAM

    def lead_of(data, a):
        return tokens_at(data)[a].byteswap()

    def extract(data, offs):
        hashes, samples = [np.zeros(0, np.uint64)], [np.zeros((0, 3), np.uint64)]
        for first, _, grams, x in _windows(data, offs, length):
            a, *_ = runs(first)
            at = tokens_at(data)
            g, p = grams[a], a + x
            # A context is told by 16 bytes before and 24 from the anchor.
            context = join(join(at[np.maximum(p - 16, 0)], at[np.maximum(p - 8, 0)]), join(g, at[np.minimum(p + GRAM, len(data))]))
            hashes.append(g)
            samples.append(np.stack([context, lead_of(data, p), g], axis=1))
        return np.concatenate(hashes), np.concatenate(samples)

    sc = docs.sparkSession.sparkContext
    parts = partitions(docs)
    cells, sample = sketch.build(docs, extract, sketch.bits_for(input_bytes(docs) / 25))
    table = sc.broadcast(cells)
    leads = np.sort(sample[:, 0])
    splitters = sc.broadcast(np.unique(leads[np.linspace(0, len(leads) - 1, parts + 1).astype(int)[1:-1]]) if len(leads) else leads)
    grams, often = np.unique(sample[:, 1], return_counts=True)
    hot = sc.broadcast(grams[often > max(HOT_LEAST, len(sample) // HOT_SHARE)])
    fields = pa.schema([("part", pa.int32()), ("known", pa.int32()), ("context", pa.binary()), ("meta", pa.binary())])

    def rows(found: list) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        context, meta, lead = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        tokens = _tokens(context)
        digest = mix(meta["lo"].astype(np.uint64) * U64(256) + meta["hi"])
        for c in range(tokens.shape[1]):
            digest = join(digest, tokens[:, c])
        order = np.lexsort((meta["pos"], meta["h"], meta["k"], digest))
        m, tokens = meta[order], tokens[order]
        # Rows are settled here only where all their bytes agree; the digest just brings such rows together.
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]).any(axis=1) | (m["lo"][1:] != m["lo"][:-1]) | (m["hi"][1:] != m["hi"][:-1])])
        head = m[np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))]
        same = (m["k"] == head["k"]) & (m["h"] == head["h"])
        later = (m["k"] > head["k"]) | (same & (m["pos"] > head["pos"]))
        ship, known = order[~later & (new | ~same)], m[later]
        out = [(p, 0, context[ship[i]].tobytes(), meta[ship[i]].tobytes()) for p, i in split_by(np.searchsorted(splitters.value, lead[ship], side="right").astype(np.int32))]
        span = np.zeros(len(known), SPAN)
        span["k"], span["h"], span["start"], span["end"] = known["k"], known["h"], known["pos"] - known["hi"], known["pos"] - known["lo"] + length
        out += [(p, 1, b"", span[i].tobytes()) for p, i in split_by((mix(known["h"].astype(np.uint64)) % U64(parts)).astype(np.int32))]
        yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in out], schema=fields)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for b in batches:
            ids, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, _, data, offs in chunks(b.column(2)):
                padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(length, np.uint8)])
                around = np.lib.stride_tricks.sliding_window_view(padded, wide)
                for first, chosen, grams, offset in _windows(data, offs, length, hot.value):
                    a, lo, hi = runs(first)
                    keep = sketch.repeated(table.value, grams[a])
                    if chosen is first:
                        a, lo, hi = a[keep], lo[keep], hi[keep]
                    else:
                        step = np.zeros(len(first) + 1, np.int8)
                        np.add.at(step, lo[keep], 1)
                        np.add.at(step, hi[keep], -1)
                        a, lo, hi = runs(np.where(np.cumsum(step[:-1]) > 0, chosen, -1))
                    a, lo, hi = a + offset, lo + offset, hi + offset
                    for x in range(0, len(a), FLUSH):
                        p, back, ahead = a[x : x + FLUSH], (a - lo)[x : x + FLUSH], (a - hi + 1)[x : x + FLUSH]
                        context = around[p]
                        at = np.arange(wide) - left
                        context[(at < -back[:, None]) | (at >= length - ahead[:, None])] = 0
                        owner = np.searchsorted(offs, p, side="right") - 1
                        meta = np.zeros(len(p), META)
                        meta["k"], meta["h"], meta["pos"], meta["lo"], meta["hi"] = ids[i + owner], hs[i + owner], p - offs[owner], ahead, back
                        found.append((context, meta, lead_of(data, p)))
                        size += len(p)
                        if size >= FLUSH:
                            yield from rows(found)
                            found, size = [], 0
        yield from rows(found)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list] = {}
        spans = []
        for b in batches:
            for part, known, context, meta in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if known:
                    spans.append(np.frombuffer(meta, SPAN))
                else:
                    buckets.setdefault(part, []).append((np.frombuffer(context, np.uint8).reshape(-1, wide), np.frombuffer(meta, META)))
        for part in list(buckets):
            context, meta = (np.concatenate(x) for x in zip(*buckets.pop(part), strict=True))
            spans.append(repeats_in_bucket(context, meta, length))
        if spans:
            s = np.concatenate(spans)
            (k, h), blob = sketch.grouped([s["k"], s["h"]], np.stack([s["start"], s["end"]], axis=1))
            for i in range(0, len(k), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 10_000]), pa.array(h[i : i + 10_000]), blob[i : i + 10_000]], names=["k", "h", "spans"])

    shipped = docs.select("k", "h", "text").mapInArrow(suffixes, "part int, known int, context binary, meta binary")
    found = shipped.repartition(parts, "part").mapInArrow(resolve, "k long, h long, spans binary")
    return found.groupBy("k", "h").agg(F.collect_list("spans").alias("spans"))


def dedup_substrings(docs: DataFrame, length: int = 100, keep_bytes: bool = False) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts earlier.

    Texts are UTF-8 bytes; matches stay inside a document; earlier means a smaller doc_id, or an
    earlier start in the same document; strings may overlap and are judged on the input. Returns
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with
    ``keep_bytes`` kept (bytes; a cut may fall inside a character). A null text is empty, a
    null doc_id comes after all others. Rows that repeat a doc_id and text (by 64 bits of hash) are one document and get
    the same result; rows of one doc_id with other texts do not judge each other. Empty tables
    give no rows; other columns are ignored.

    Anchors whose whole context repeats inside a task are settled there: only the earliest is
    shipped, so a passage that a third of the documents share costs one row a task.
    """
    if length < 2 * GRAM or length > 255:
        raise ValueError("length must be 32 to 255")
    d = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    found = materialize(_spans(d, length))
    # A text below ``length`` has no spans: it asks for a key of its own that is never answered, so equal short texts don't pile up.
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < length
    d = d.withColumn("h", F.when(short, F.monotonically_increasing_id()).otherwise(F.col("h"))).withColumn("short", short)
    parts = partitions(docs, 16.0)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            lists = b.column(2)
            for i, j, data, offs in chunks(b.column(1)):
                for r in range(i, j):
                    text = data[offs[r - i] : offs[r - i + 1]]
                    removed = pieces = 0
                    if lists[r].is_valid:
                        s = np.frombuffer(b"".join(lists[r].as_py()), np.uint32).reshape(-1, 2).astype(np.int64)
                        cover = np.zeros(len(text) + 1, np.int32)
                        np.add.at(cover, s[:, 0], 1)
                        np.add.at(cover, s[:, 1], -1)
                        gone = np.cumsum(cover[:-1]) > 0
                        removed = int(gone.sum())
                        pieces = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = text[~gone]
                    else:
                        kept = text
                    for c, v in zip(out, (len(text), removed, pieces, hashlib.sha256(np.ascontiguousarray(kept)).hexdigest(), kept.tobytes() if keep_bytes else None), strict=True):
                        c.append(v)
            cols = [b.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out[4], pa.binary())] * keep_bytes, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_bytes])

    keys = ["k", "h", "short"]
    joined = d.repartition(parts, *keys).join(found.withColumn("short", F.lit(False)).repartition(parts, *keys), keys, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: 100-byte strings over all of ``documents``."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), 100)
