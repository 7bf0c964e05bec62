"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over windows, exact edit verification.

A random walk (CGK) rewrites a word sequence: at each step it emits the word under its pointer and
moves on or stays by a random bit of (step, word). Few edits make few differing steps, so edit
distance becomes Hamming distance. Tables sample a few steps of the walk, spread over it; a window
of a document and one of an item that agree on a table's samples are a candidate. Every word of
every document starts a window, sized by the item: the largest power of two that it holds, 16
words at most; a longer item enters with a window at every fourth word. Candidates are verified by
the edit distance between the whole item and the best stretch of text around the place.

Edits spread over characters leave few whole words. So every byte of a document also starts a gram
of eight bytes; grams that agree with an item's along nearby diagonals are a candidate too, however
the bytes are cut into words. Items shorter than 64 bytes have too few grams: their edit distance is
computed at every byte of every document, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import map_rows, materialize
from .text import LOWER_BYTES, SPACE, U64, chunks, mix, split_by, word_hashes, words

CLASSES = (16, 8, 4)
REPEATS, TABLES, SAMPLES = 3, 4, 4
STRIDE = 4
PAD = 32
#: Edit distance up to this share of an item's bytes is a leak.
EDITS = 0.2
#: Bytes of a gram; items below SHORT bytes are searched exactly; zero bytes that part two texts, more than any short item's edits.
GRAM, SHORT, GAP = 8, 64, 64
#: A candidate has one of so many of its item's distinct grams at least, two in any case.
SPARSE = 16
#: Pairs of equal grams that are counted at once; a single text with more is one step.
PAIRS = 1 << 21
#: Items and bytes of their texts that one pass over the documents looks for (their index takes some 30 bytes a byte); a larger benchmark takes several passes.
BLOCK, BLOCK_BYTES = 20_000, 2 << 20
_RNG = np.random.default_rng(31337)
SALTS = _RNG.integers(1, 2**63, size=REPEATS, dtype=np.uint64)
#: Sampled steps, one of each quarter of a class's walk, and the multipliers of the table's hash.
STEPS = {c: np.stack([_RNG.integers(q * (c * 3 // 2) // SAMPLES, (q + 1) * (c * 3 // 2) // SAMPLES, size=(REPEATS, TABLES)) for q in range(SAMPLES)], axis=2) for c in CLASSES}
FACTORS = _RNG.integers(1, 2**63, size=(REPEATS, TABLES, SAMPLES), dtype=np.uint64) * U64(2) + U64(1)


def signatures(padded: np.ndarray, starts: np.ndarray, classes: tuple[int, ...]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(class, repeat, table, hash of the sampled steps) of the walks from ``starts``; gaps hold PAD zeros."""
    for r in range(REPEATS):
        bits = mix(padded ^ SALTS[r])
        at = starts.copy()
        sums = {(c, t): np.zeros(len(starts), np.uint64) for c in classes for t in range(TABLES)}
        for step in range(max(classes) * 3 // 2):
            due = [(c, t, q) for c in classes for t in range(TABLES) for q in range(SAMPLES) if STEPS[c][r, t, q] == step]
            if due:
                word = padded[at]
                for c, t, q in due:
                    sums[c, t] += word * FACTORS[r, t, q]
            at += ((bits[at] >> U64(step)) & U64(1)).astype(np.int64)
        for (c, t), s in sums.items():
            yield c, r, t, mix(s)


def _padded(wh: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with a gap after each text, and each word's place among them."""
    place = np.arange(len(wh)) + PAD * np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    out = np.zeros(len(wh) + PAD * len(firsts), np.uint64)
    out[place] = wh
    return out, place


@lru_cache(maxsize=1024)
def _masks(pattern: bytes) -> list[int]:
    masks = [0] * 256
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return masks


def edit_search(pattern: bytes, text: bytes) -> int:
    """The least edit distance between ``pattern`` and any stretch of ``text`` (bit-parallel, exact)."""
    m = len(pattern)
    peq = _masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq[c]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best


def _plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words in lower case, one space between; starts and ends of the texts, which GAP zeros part."""
    inside = ~SPACE[data]
    keep = inside.copy()
    last = np.zeros(len(starts), dtype=bool)
    last[firsts[1:][firsts[1:] > firsts[:-1]] - 1] = True
    keep[ends[~last]] = True  # the blank after a word that another of its text follows
    inside |= ~keep
    low = np.where(inside, LOWER_BYTES[data], np.uint8(0x20))[keep]
    length = np.concatenate([[0], np.cumsum(ends - starts + ~last)])
    cut = length[firsts]
    first = cut[:-1] + GAP * np.arange(1, len(cut))
    out = np.zeros(len(low) + GAP * len(cut), np.uint8)
    for f, a, b in zip(first.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        out[f : f + b - a] = low[a:b]
    return out, first, first + np.diff(cut)


def _grams(plain: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each byte on."""
    n = max(len(plain) - GRAM + 1, 0)
    return np.ndarray((n,), "<u8", buffer=np.ascontiguousarray(plain), strides=(1,)) * U64(0x9E3779B97F4A7C15) if n else np.zeros(0, np.uint64)


def short_search(pattern: bytes, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all stretches within the bound of a pattern of at most 64 bytes, and their distances.

    The bit-parallel edit distance of ``edit_search``, over many segments of the text side by side;
    each starts as early as a stretch that ends in it can.
    """
    m = len(pattern)
    most = int(EDITS * m)
    lead, width = m + most, 512
    peq = np.zeros(256, np.uint64)
    for i, c in enumerate(pattern):
        peq[c] |= U64(1 << i)
    padded = np.concatenate([np.zeros(lead, np.uint8), plain, np.zeros(width, np.uint8)])
    at = np.arange(0, len(plain), width)
    one, high = U64(1), U64(m - 1)
    pv, mv, score = np.full(len(at), ~U64(0)), np.zeros(len(at), np.uint64), np.full(len(at), m, np.int16)
    ends, distances = [], []
    for step in range(lead + width):
        eq = peq[padded[at + step]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> high) & one).astype(np.int16) - ((mh >> high) & one).astype(np.int16)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        if step >= lead and (hit := np.flatnonzero(score <= most)).size:
            ends.append(at[hit] + step - lead)
            distances.append(score[hit].astype(np.int64))
    return (np.concatenate(ends), np.concatenate(distances)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class ItemIndex:
    """The items of one block: normal forms, and per table the sorted signatures of their windows."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        column = pa.array([t for _, t in items], pa.string())
        self.ids = [i for i, _ in items]
        self.texts: list[bytes] = []
        owners, offsets, sizes = [], [], []
        hashes, firsts = [], [0]
        for _, _, data, offs in chunks(column, 1 << 40):
            s, e, f = words(data, offs)
            hashes, firsts = word_hashes(data, s, e, lower=True), f
            for r in range(len(offs) - 1):
                n = int(f[r + 1] - f[r])
                self.texts.append(b" ".join(data[s[w] : e[w]].tobytes().lower() for w in range(f[r], f[r + 1])))
                c = next((c for c in CLASSES if c <= n), 0) if len(self.texts[r]) >= SHORT else 0
                for at in sorted({*range(0, n - c + 1, STRIDE), n - c}) if c else []:
                    owners.append(r)
                    offsets.append(at)
                    sizes.append(c)
        self.words = np.diff(firsts)
        self.owner, self.offset, size = np.array(owners, np.int64), np.array(offsets, np.int64), np.array(sizes, np.int64)
        self.classes = tuple(c for c in CLASSES if (size == c).any())
        self.tables: dict = {}
        self._index_grams()
        if not self.classes:
            return
        padded, place = _padded(np.asarray(hashes), np.asarray(firsts))
        starts = place[np.asarray(firsts)[self.owner] + self.offset]
        for c, r, t, sig in signatures(padded, starts, self.classes):
            mine = np.flatnonzero(size == c)
            mine = mine[np.argsort(sig[mine], kind="stable")]
            log = max(16, int(np.ceil(np.log2(16 * len(mine)))))
            filled = np.zeros(1 << log, dtype=bool)
            filled[(sig[mine] >> U64(64 - log)).astype(np.int64)] = True
            self.tables[c, r, t] = (sig[mine], mine, log, filled)

    def _index_grams(self) -> None:
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.short = np.flatnonzero((sizes > 0) & (sizes < SHORT)).tolist()
        self.sizes, long = sizes, np.flatnonzero(sizes >= SHORT)
        once = [np.unique(_grams(np.frombuffer(self.texts[r], np.uint8)), return_index=True) for r in long]
        gram = np.concatenate([g for g, _ in once]) if once else np.zeros(0, np.uint64)
        item = np.repeat(long, [len(g) for g, _ in once])
        offset = np.concatenate([at for _, at in once]) if once else np.zeros(0, np.int64)
        self.enough = np.maximum(2, np.bincount(item, minlength=len(sizes)) // SPARSE)
        order = np.argsort(gram, kind="stable")
        self.gram, sharers = np.unique(gram, return_counts=True)
        self.gram_first = np.concatenate([[0], np.cumsum(sharers)])
        self.gram_item, self.gram_offset = item[order], offset[order]
        self.gram_log = max(16, int(np.ceil(np.log2(16 * max(len(gram), 1)))))
        self.gram_filled = np.zeros(1 << self.gram_log, dtype=bool)
        self.gram_filled[(gram >> U64(64 - self.gram_log)).astype(np.int64)] = True

    def _near_grams(self, plain: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first byte, end byte) of stretches with enough of an item's grams; bytes count from the text's start."""
        gram = _grams(plain)
        at = np.flatnonzero(self.gram_filled[(gram >> U64(64 - self.gram_log)).astype(np.int64)])
        if not len(at) or not len(self.gram):
            return
        known = np.minimum(np.searchsorted(self.gram, gram[at]), len(self.gram) - 1)
        same = self.gram[known] == gram[at]
        at, lo, n = at[same], self.gram_first[known[same]], np.diff(self.gram_first)[known[same]]
        text = np.searchsorted(first, at, side="right") - 1
        before = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(text, text, side="left")]
        for _, some in split_by(before // PAIRS):
            yield from self._near_pairs(at[some] - first[text[some]], text[some], lo[some], n[some])

    def _near_pairs(self, at: np.ndarray, text: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        g = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc, item = np.repeat(text, n), self.gram_item[g]
        size = self.sizes[item]
        band = size * 2 // 5  # edits shift by a fifth at most, so one of two half-overlapping bands holds all of a stretch's grams
        diagonal = np.repeat(at, n) - self.gram_offset[g] + size
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for half in (0, 1):
            place = (diagonal + half * (band // 2)) // band
            wide = int(place.max()) + 1
            key, count = np.unique((doc * len(self.texts) + item) * wide + place, return_counts=True)
            owner = key // wide % len(self.texts)
            ok = count >= self.enough[owner]
            for k, i in zip(key[ok].tolist(), owner[ok].tolist(), strict=True):
                m = int(self.sizes[i])
                b = m * 2 // 5
                begin = k % wide * b - half * (b // 2) - m
                spans.setdefault((k // wide // len(self.texts), i), []).append((begin - b // 2 - 1, begin + b + m + b // 2 + 1))
        for (doc, i), near in spans.items():
            near.sort()
            begin, end = near[0]
            for a, b in near[1:]:
                if a > end:
                    yield doc, i, begin, end
                    begin = a
                end = max(end, b)
            yield doc, i, begin, end

    def _by_bytes(self, plain: np.ndarray, first: np.ndarray, end: np.ndarray, found: dict[tuple[int, int], int]) -> None:
        """Adds to ``found`` the leaks that grams and the search for short items see."""
        for item in self.short:
            ends, distances = short_search(self.texts[item], plain)
            for doc, d in zip((np.searchsorted(first, ends, side="right") - 1).tolist(), distances.tolist(), strict=True):
                if 0 <= doc and d < found.get((doc, item), 1 << 60):
                    found[doc, item] = d
        for doc, item, a, b in self._near_grams(plain, first):
            if found.get((doc, item)) == 0:
                continue
            pattern = self.texts[item]
            text = plain[first[doc] + max(a, 0) : min(first[doc] + b, end[doc])].tobytes()
            d = 0 if pattern in text else edit_search(pattern, text)
            if d <= EDITS * len(pattern) and d < found.get((doc, item), 1 << 60):
                found[doc, item] = d

    def find(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, distance) of the verified leaks in a chunk."""
        starts, ends, firsts = words(data, offs)
        if not len(starts):
            return []
        found: dict[tuple[int, int], int] = {}
        if self.classes:
            self._by_words(data, starts, ends, firsts, found)
        self._by_bytes(*_plain(data, starts, ends, firsts), found)
        return [(doc, item, d) for (doc, item), d in sorted(found.items())]

    def _by_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, found: dict[tuple[int, int], int]) -> None:
        """Adds to ``found`` the leaks that the walks see."""
        wh = word_hashes(data, starts, ends, lower=True)
        padded, place = _padded(wh, firsts)
        hits = []
        for x in range(0, len(place), 1 << 16):
            for c, r, t, sig in signatures(padded, place[x : x + (1 << 16)], self.classes):
                sigs, windows, log, filled = self.tables[c, r, t]
                maybe = np.flatnonzero(filled[(sig >> U64(64 - log)).astype(np.int64)])
                lo, hi = np.searchsorted(sigs, sig[maybe], "left"), np.searchsorted(sigs, sig[maybe], "right")
                some = np.flatnonzero(hi > lo)
                for _, at in split_by(np.cumsum(hi[some] - lo[some]) // PAIRS):  # a window that many items share is counted out step by step
                    i = some[at]
                    n = hi[i] - lo[i]
                    w = windows[np.repeat(lo[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                    place = maybe[i] + x
                    # Alignments a few words apart see the same stretch.
                    quarter = (np.repeat(place, n) - self.offset[w]) >> 2
                    hits.append(np.unique(np.stack([quarter, np.repeat(np.searchsorted(firsts, place, side="right") - 1, n), self.owner[w]], axis=1), axis=0))
        if not hits:
            return
        for quarter, doc, item in np.unique(np.concatenate(hits), axis=0).tolist():
            pattern, n = self.texts[item], int(self.words[item])
            slack = n // 4 + 6
            a, b = max(int(firsts[doc]), quarter * 4 - slack), min(int(firsts[doc + 1]), quarter * 4 + n + slack + 4)
            text = b" ".join(data[starts[w] : ends[w]].tobytes().lower() for w in range(a, b))
            d = 0 if pattern in text else edit_search(pattern, text)
            if d <= EDITS * len(pattern) and d < found.get((doc, item), 1 << 60):
                found[doc, item] = d


def _blocks(benchmark: DataFrame) -> Iterator[tuple[ItemIndex, bool]]:
    """(index of a block of items, whether it is the last); one block is held at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) == BLOCK or size > BLOCK_BYTES):
            yield ItemIndex(block), False
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield ItemIndex(block), True


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_bytes): items within 20 % edits of a stretch of a document.

    Case of A-Z and kind of blanks don't count. The benchmark is a stated query set: blocks of it (20,000
    items or 2 MB of text are broadcast) pass over all documents, whole texts, one after the other; what a block but the last
    finds is written, and its broadcast freed. Only items without
    words are not looked for (any text holds them); null texts on either side match nothing; a null
    doc_id or item_id is carried along; repeated rows repeat; empty tables give no rows; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, distance int, item_bytes int"
    out = docs.sparkSession.createDataFrame([], schema)
    for index, last in _blocks(benchmark):
        bc = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0)
                rows = [(ids[i + doc].as_py(), bc.value.ids[item], d, len(bc.value.texts[item])) for i, _, data, offs in chunks(b.column(1)) for doc, item, d in bc.value.find(data, offs)]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "distance", "item_bytes"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        if not last:
            found = materialize(found)
            bc.unpersist()
        out = out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak any item; one pass a block of items, no shuffle; between blocks what is left is written."""
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index("text")
    for index, last in _blocks(benchmark):
        bc = sc.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, dtype=bool)
                for i, _, data, offs in chunks(b.column(at)):
                    clean[[i + doc for doc, _, _ in bc.value.find(data, offs)]] = False
                yield b.filter(pa.array(clean))

        docs = map_rows(docs, keep)
        if not last:
            docs = materialize(docs)
            bc.unpersist()
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """op6: leaks of ``benchmark`` in all of ``documents``."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
