"""Vectorised text primitives over Arrow string buffers.

Texts are seen as UTF-8 bytes, without copying them out of Arrow. A word is 128 bits: up to 15
bytes and their number, permuted, so that different ones never agree, or BLAKE2b of a longer
one. Hashes of runs of words join halves by a finaliser; nothing is a sum that could cancel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step handles (a longer single text is one step).
STEP_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: The first k bytes of a little-endian token.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Windows that one step of ``minimizers`` sees; their positions fit 24 bits.
MINIMIZER_STEP = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's), a permutation."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two in order."""
    return mix(a * U64(0x9E3779B97F4A7C15) + b)


def tokens_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on as little-endian integers; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 9,), "<u8", buffer=padded, strides=(1,))


def chunks(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null text counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    size = 8 if wide else 4
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=n + 1, offset=column.offset * size).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + step, side="right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words ``[^\\x20\\x09-\\x0D]+``, and each text's first word number."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offs[(offs > 0) & (offs < n)]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word's bytes (A-Z as a-z if ``lower``), as two halves.

    Words of at most 15 bytes are permuted with their length in three Feistel rounds: equal digests are equal words.
    """
    data = LOWER_BYTES[data] if lower else data
    at = tokens_at(data)
    size = ends - starts
    a = at[starts] & FIRST_BYTES[np.minimum(size, 8)]
    b = (at[starts + 8] & FIRST_BYTES[np.clip(size - 8, 0, 7)]) | (size.astype(np.uint64) << U64(56))
    a ^= mix(b + U64(0xA0761D6478BD642F))
    b ^= mix(a + U64(0xE7037ED1A0B428DB))
    a ^= mix(b + U64(0x8EBC6AF09C88C6E3))
    long = np.flatnonzero(size > 15)
    if len(long):
        digests = [hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        a[long], b[long] = both[:, 0], both[:, 1]
    return a, b


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """The first half of each word's digest."""
    return word_digests(data, starts, ends, lower)[0]


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive values, across texts too (callers mask those); runs are doubled."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    out, have = values, 1
    for bit in bin(k)[3:]:
        out, have = join(out[:-have], out[have:]), 2 * have
        if bit == "1":
            out, have = join(out[:-1], values[have:]), have + 1
    return out


def range_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the value ranges [lo, hi): a step for each value of the longest."""
    out = mix((hi - lo).astype(np.uint64))
    for step in range(int((hi - lo).max(initial=0))):
        at = np.flatnonzero(lo + step < hi)
        out[at] = join(out[at], values[lo[at] + step])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive elements, by doubling."""
    if len(x) < w:
        return x[:0]
    m, have = x, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = w - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def within(firsts: np.ndarray, total: int, k: int) -> np.ndarray:
    """For ``total`` items dealt to texts by ``firsts``: which items start a run of ``k`` inside one text."""
    ok = np.zeros(max(total - k + 1, 0), dtype=bool)
    if len(ok):
        doc_end = np.repeat(firsts[1:], np.diff(firsts))[: len(ok)]
        ok = np.arange(len(ok)) + k <= doc_end
    return ok


def minimizers(hashes: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Position of the least hash among each window's ``w`` (leftmost of equals), for valid windows; -1 elsewhere.

    Equal windows choose equal anchors, wherever they stand and however long their texts are: only
    the first 40 bits of their own hashes, and then the order of the positions, decide.
    """
    at = np.full(len(valid), -1, np.int64)
    for x in range(0, len(valid), MINIMIZER_STEP):
        part = hashes[x : x + MINIMIZER_STEP + w - 1]
        packed = (part & U64(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=np.uint64)
        found = (sliding_min(packed, w) & U64(0xFFFFFF)).astype(np.int64) + x
        at[x : x + MINIMIZER_STEP] = found[: len(valid) - x]
    at[~valid] = -1
    return at


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, end) of the runs of equal values, without those of -1."""
    if not len(at):
        return at, at, at
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = np.append(cut[1:], len(at))
    keep = at[cut] >= 0
    return at[cut][keep], cut[keep], end[keep]


def split_by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, indices in their order) for every value of ``part``."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    p = part[order]
    cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(p)), strict=True):
        yield int(p[a]), order[a:b]
