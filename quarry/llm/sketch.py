"""Count-min sketches over a whole table, merged slice by slice and read as "seen at least twice" bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .runtime import partitions
from .text import U64, chunks, mix, split_by

SLICE = 20  # log2 of the counters that one merging task's slice has
FLUSH = 1 << 21
#: Sampled rows of a task's flush, tokens of a row, and rows that the driver gets.
SAMPLES, TOKENS, MOST_SAMPLES = 32, 3, 1 << 16
#: Of a chunk with more rows than this only a sixteenth, by hash, is looked at for samples.
THIN = 1 << 12
DEPTH = 2
#: The merged bits are broadcast: 2**29 of them a row (64 MB) are the most, whatever the input.
MOST_BITS = 29


def bits_for(items: float, most: int = MOST_BITS) -> int:
    """log2 of a row's counters: four an item, within the bound."""
    return int(min(most, max(SLICE, np.ceil(np.log2(max(4 * items, 1))))))


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes ^ U64(0x9E3779B97F4A7C15 * (row + 1) & (2**64 - 1))) >> U64(64 - bits)).astype(np.int64)


def repeated(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the sketch estimates at two or more: all that are, and a few that are not."""
    bits = int(table.shape[1] * 8 - 1).bit_length()
    out = np.ones(len(hashes), dtype=bool)
    for row in range(len(table)):
        at = np.flatnonzero(out)
        c = cells(hashes[at], row, bits)
        out[at] = (table[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return out


def _sampled(rows: list[np.ndarray]) -> np.ndarray:
    t = np.concatenate(rows)
    return t[np.argsort(t[:, 0], kind="stable")[:MOST_SAMPLES]]


def build(docs: DataFrame, extract: Callable, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(table, samples) for the hashes that ``extract(data, offsets)`` finds in the text chunks of ``docs``.

    Every task sketches its own partition sparsely (cells seen once, cells seen more often) and
    deals it in slices; a slice's counters, which stop at two, are added in one task. The
    driver receives the merged bits, whose number ``bits`` fixes. ``extract`` returns hashes and either None
    or, for each, a row of tokens: those whose first token hashes least in a task's flush are sampled (each
    first token once), and the others of their tokens come back, 65,536 rows at most.
    """
    width = 1 << (bits - SLICE)

    def rows(found: list[np.ndarray], leads: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        h = np.concatenate(found)
        parts, payloads = [], []
        for row in range(DEPTH):
            c, n = np.unique(cells(h, row, bits), return_counts=True)
            value = (c & ((1 << SLICE) - 1)).astype(np.uint32) | ((n > 1).astype(np.uint32) << np.uint32(31))
            for s, at in split_by(c >> SLICE):
                parts.append(row * width + s)
                payloads.append(value[at].tobytes())
        if leads:
            t = np.concatenate(leads)
            _, at = np.unique(t[:, 0], return_index=True)  # a first token that repeats in the flush is drawn once
            parts.append(-1)
            payloads.append(t[at[:SAMPLES]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], names=["slice", "payload"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, leads, size = [], [], 0
        draw = U64(0)
        for b in batches:
            for _, _, data, offs in chunks(b.column(0)):
                h, lead = extract(data, offs)
                found.append(h)
                if lead is not None:
                    draw = draw or mix(np.array([TaskContext.get().partitionId() + 1], np.uint64))[0]
                    lead[:, 0] = mix(lead[:, 0] ^ draw)
                    leads.append(lead[lead[:, 0] < U64(1 << 60)] if len(lead) > THIN else lead)
                size += len(h)
                if size >= FLUSH:
                    yield from rows(found, leads)
                    found, leads, size = [], [], 0
        yield from rows(found, leads)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        leads: list[np.ndarray] = []
        for b in batches:
            for s, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = payload.as_buffer()
                if s < 0:
                    leads.append(np.frombuffer(raw, np.uint64).reshape(-1, TOKENS))
                    if sum(map(len, leads)) > 4 * MOST_SAMPLES:
                        leads = [_sampled(leads)]
                    continue
                v = np.frombuffer(raw, np.uint32)
                c = counts.setdefault(s, np.zeros(1 << SLICE, np.uint8))
                at = v & np.uint32((1 << SLICE) - 1)
                c[at] = np.minimum(c[at] + 1 + (v >> np.uint32(31)).astype(np.uint8), 2)
        out = {s: np.packbits(c > 1).tobytes() for s, c in counts.items()}
        if leads:
            out[-1] = _sampled(leads)[:, 1:].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.binary())], names=["slice", "payload"])

    sparse = docs.select("text").mapInArrow(sketch, "slice int, payload binary")
    merged = sparse.repartition(min(DEPTH * width + 1, partitions(docs)), "slice").mapInArrow(merge, "slice int, payload binary")
    table, samples = np.zeros((DEPTH, (1 << bits) // 8), np.uint8), np.zeros((0, TOKENS - 1), np.uint64)
    step = (1 << SLICE) // 8
    for r in merged.toLocalIterator():
        if r["slice"] < 0:
            samples = np.frombuffer(bytes(r["payload"]), np.uint64).reshape(-1, TOKENS - 1)
        else:
            row, s = divmod(r["slice"], width)
            table[row, s * step : (s + 1) * step] = np.frombuffer(bytes(r["payload"]), np.uint8)
    return table, samples


def grouped(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], pa.Array]:
    """One binary per distinct key (int64 columns): the bytes of its rows of ``values``; no loop over keys."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    values = np.ascontiguousarray(values[order])
    n = len(order)
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    cut = np.flatnonzero(new)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = (np.append(cut, n) * width).astype(np.int32)
    return [k[cut] for k in keys], pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
