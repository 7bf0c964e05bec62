"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_rows
from .text import SPACE, U64, chunks, gram_hashes, within, word_hashes, words

#: Labelled rows that training reads at most, those of least hash.
SAMPLE = 20_000
BINS = 64
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "quote": b"'\"()-",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
FEATURES = ["bytes", "words", "word_bytes", "longest_word", *CLASSES, "distinct_words", "top_word", "distinct_grams", "lines", "line_bytes", "distinct_lines", "upper_words", "odd_words", "short_words"]


def _distinct(owner: np.ndarray, values: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct values (told apart by 40 bits), and the count of the most frequent."""
    key = (owner.astype(np.uint64) << U64(40)) | (values >> U64(24))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    o = (key[first] >> U64(40)).astype(np.int64)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, o, np.diff(np.append(first, len(key))))
    return np.bincount(o, minlength=docs), top


def _counts(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the runs that begin at ``starts`` (none empty)."""
    return np.add.reduceat(flags, starts, dtype=np.int32) if len(starts) else np.zeros(0, np.int32)


def _line_numbers(data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A number for each line [cut[i], cut[i + 1]), equal for equal lines only (in the bits that ``_distinct`` reads)."""
    lines = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(np.ascontiguousarray(cut, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return lines.dictionary_encode().indices.to_numpy().astype(np.uint64) << U64(24)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of statistics per text of a chunk; all of each text counts."""
    docs = len(offs) - 1
    size = np.diff(offs)
    starts, ends, firsts = words(data, offs)
    n = np.diff(firsts)
    owner = np.repeat(np.arange(docs), n)
    length = ends - starts
    safe, safe_n = np.maximum(size, 1), np.maximum(n, 1)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, owner, length)
    cols = [np.log1p(size), np.log1p(n), np.bincount(owner, length, docs) / safe_n, np.log1p(longest)]
    full = np.flatnonzero(size > 0)
    letters = data[~SPACE[data]]
    at_word = np.cumsum(length) - length
    in_word: dict[str, np.ndarray] = {}
    for name, members in CLASSES.items():
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        share = np.zeros(docs)
        share[full] = _counts(table[data], offs[full])
        cols.append(share / safe)
        if name in ("upper", "symbol", "shout", "digit"):
            in_word[name] = _counts(table[letters], at_word)
    del letters
    wh = word_hashes(data, starts, ends)
    distinct, top = _distinct(owner, wh, docs)
    grams = gram_hashes(wh, 3)
    ok = np.flatnonzero(within(firsts, len(wh), 3))
    gram_owner = owner[ok]
    distinct_grams, _ = _distinct(gram_owner, grams[ok], docs)
    cols += [distinct / safe_n, top / safe_n, distinct_grams / np.maximum(np.bincount(gram_owner, minlength=docs), 1)]
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offs[:-1], offs[1:]]))
    lo = cut[:-1]
    line_owner = np.searchsorted(offs, lo, side="right") - 1
    lines = np.bincount(line_owner, minlength=docs)
    distinct_lines, _ = _distinct(line_owner, _line_numbers(data, cut), docs)
    cols += [np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), distinct_lines / np.maximum(lines, 1)]
    odd = in_word["symbol"] + in_word["shout"] + in_word["digit"] > 0
    cols += [np.bincount(owner, in_word["upper"] > 1, docs) / safe_n, np.bincount(owner, odd, docs) / safe_n, np.bincount(owner, length < 3, docs) / safe_n]
    return np.stack(cols, axis=1).astype(np.float64)


class BoostedTrees:
    """Logistic boosting of full binary trees, stored as flat arrays: feature, threshold, leaf."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, smooth: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.smooth = trees, depth, rate, smooth

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        inner = (1 << self.depth) - 1
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.threshold = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        if n == 0:
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        flat = binned + np.arange(f) * BINS
        score = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                width = 1 << level
                key = (flat + node[:, None] * (f * BINS)).ravel()
                gs, hs = (np.bincount(key, np.repeat(v, f), width * f * BINS).reshape(width, f, BINS) for v in (g, h))
                gl, hl = np.cumsum(gs, axis=2), np.cumsum(hs, axis=2)
                ga, ha = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.smooth) + (ga - gl) ** 2 / (ha - hl + self.smooth) - ga**2 / (ha + self.smooth)
                gain[(hl < 1) | (ha - hl < 1)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                for i, b in enumerate(best):
                    j, cut = divmod(int(b), BINS)
                    if gain[i, j, cut] > 1e-9 and cut < len(edges[j]):
                        self.feature[t, width - 1 + i], self.threshold[t, width - 1 + i] = j, edges[j][cut]
                at = width - 1 + node
                node = 2 * node + (x[np.arange(n), self.feature[t, at]] > self.threshold[t, at])
            gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
            self.leaf[t] = -self.rate * gs / (hs + self.smooth)
            score += self.leaf[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            score += self.leaf[t][node]
        return 1 / (1 + np.exp(-score))


def held_out() -> F.Column:
    """Whether crc32 of doc_id as text is 0 modulo 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BoostedTrees:
    """Fit on at most ``sample`` labelled rows that are not held out, those whose doc_id hashes least."""
    chosen = labels.where("quality is not null and doc_id is not null").where(~held_out()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(data, offs) for _, _, data, offs in chunks(b.column(2))]
            if rows:
                flat = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in flat], pa.binary())], names=["doc_id", "quality", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")  # bounded by ``sample``
    found = joined.mapInArrow(run, "doc_id long, quality int, x binary")
    found = found.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # one row of each label, however often its doc_id repeats
    rows = sorted(found.collect(), key=lambda r: (r[0], r[1]))
    x = np.array([np.frombuffer(bytes(r["x"])) for r in rows]).reshape(-1, len(FEATURES))
    return BoostedTrees().fit(x, np.array([r["quality"] for r in rows], dtype=np.float64))


def classify(docs: DataFrame, model: BoostedTrees, threshold: float = 0.3, keep_columns: bool = False) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted; or with ``keep_columns`` the accepted rows of ``docs``.

    Only statistics of the text enter. A null text counts as empty and is scored as such; a null doc_id is
    kept and not held out; repeated rows repeat; empty tables give no rows; without labels every
    score is 0.5 and accepted. One pass, no shuffle.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def score(b: pa.RecordBatch, column: int) -> np.ndarray:
        rows = [bc.value.predict(features(data, offs)) for _, _, data, offs in chunks(b.column(column))]
        return np.concatenate(rows) if rows else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(b, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score(b, at) >= threshold))

    if keep_columns:
        return map_rows(docs, accept)
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: quality of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
