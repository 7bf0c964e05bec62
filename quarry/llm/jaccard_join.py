"""N-gram Jaccard join by prefix trees over globally ordered shingle sets.

1. Every text becomes its set of 64-bit shingle hashes; equal sets form one class (128-bit digest).
2. Shingles are counted over all classes. A shingle of one class is in no intersection, so a class
   goes on with its repeated shingles only, and not at all if these are under three quarters.
3. Shingles are ordered by (count, hash). Two sets that link share one of the first
   size - ceil(0.75 size) + 1 shingles of each, so classes meet in the buckets of these.
   Buckets whose members are connected already (by a first round on minimum hashes) don't count.
4. In a bucket the sets, most frequent shingle first, stand in a prefix tree. Each set walks
   down it: an overlap counted on a path serves all sets below, a subtree is left when what
   remains of either side cannot reach the needed overlap, or when all below is linked already.
   The walk yields a spanning forest of the links, not all pairs.
5. Connected components of the forest.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import materialize, partitions
from .text import U64, chunks, gram_hashes, mix, range_hashes, split_by, within, word_hashes, words

SHINGLE = 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Shingles that a task deals at once: 256 for each of the tasks they go to, within these bounds.
FLUSH = (1 << 19, 1 << 22)
#: From so many classes in one flush a shingle is dealt over several tasks and counts as the most frequent.
HOT = 64
HOT_COUNT = (1 << 32) - 1
#: Shingles that a task counts at once.
COUNT_STEP = 1 << 17
#: Minimum hashes by which sets meet in the first round.
MEETINGS = 3
#: Bytes of sets that one tree holds; larger buckets are joined block against block.
BLOCK_BYTES = 32 << 20


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, shingle), sorted and distinct: the sets of the texts of a chunk."""
    starts, ends, firsts = words(data, offs)
    wh = word_hashes(data, starts, ends, lower=True)
    n = np.diff(firsts)
    grams = gram_hashes(wh, SHINGLE)
    at = np.flatnonzero(within(firsts, len(wh), SHINGLE)) if len(grams) else np.zeros(0, np.int64)
    owner = np.searchsorted(firsts, at, side="right") - 1
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    owner = np.concatenate([owner, short])
    grams = np.concatenate([grams[at] if len(at) else grams[:0], range_hashes(wh, firsts[short], firsts[short + 1])])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[new], grams[new]


def needed(n: int, m: int) -> int:
    """The least intersection with which sets of sizes n and m link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class PrefixTree:
    """Ordered sets with shared prefixes; finds for a set the links to sets of other groups."""

    def __init__(self) -> None:
        #: node: [tokens, children by first token, sets that end here, least size, most tokens below, one set below if all are one group]
        self.root = [[], {}, [], 1 << 60, 0, None]
        self.size: list[int] = []
        self.parent: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, tokens: list[int], size: int, group: int | None = None) -> None:
        """Link a set (ascending tokens; ``size`` counts its private ones too) with those before it, then insert it.

        ``group`` is an earlier set that it is known to be connected with, or itself.
        """
        me = len(self.size)
        self.size.append(size)
        self.parent.append(me if group is None else group)
        mine = set(tokens)
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, shared = stack.pop()
            same = node[5]
            if same is not None and self.find(same) == self.find(me):
                continue
            seg = node[0]
            if seg:
                shared += sum(t in mine for t in seg)
                depth += len(seg)
                rest = min(node[4] - depth, len(tokens) - bisect_right(tokens, seg[-1]))
            else:
                rest = len(tokens)
            least = max(node[3], -(-PERCENT * size // 100))
            if shared + rest < needed(size, least):
                continue
            for other in node[2]:
                if shared >= needed(size, self.size[other]):
                    a, b = self.find(other), self.find(me)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
                        self.links.append((other, me))
            stack.extend((child, depth, shared) for child in node[1].values())
        self._insert(tokens, size, me)

    def _insert(self, tokens: list[int], size: int, me: int) -> None:
        node, at = self.root, 0
        while True:
            node[3], node[4] = min(node[3], size), max(node[4], len(tokens))
            if node[5] is None:
                node[5] = me if not node[1] and not node[2] else None
            elif self.find(node[5]) != self.find(me):
                node[5] = None
            if at == len(tokens):
                node[2].append(me)
                return
            child = node[1].get(tokens[at])
            if child is None:
                node[1][tokens[at]] = [tokens[at:], {}, [me], size, len(tokens), me]
                return
            seg, k = child[0], 1
            while k < len(seg) and at + k < len(tokens) and seg[k] == tokens[at + k]:
                k += 1
            if k < len(seg):
                upper = [seg[:k], {seg[k]: child}, [], child[3], child[4], child[5]]
                child[0] = seg[k:]
                node[1][tokens[at]] = child = upper
            node, at = child, at + k


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, cid, digest) of every row; cid is 64 bits of the digest, null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cid = [], []
            for i, j, data, offs in chunks(b.column(1)):
                owner, grams = shingle_sets(data, offs)
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                n.append(np.diff(cut))
                cid += [_cid(grams[x:y]) if y > x else None for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64()), pa.array(cid, pa.int64())], names=["doc_id", "n_shingles", "cid"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cid long")


def _cid(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams, digest_size=8).digest(), "little", signed=True)


def _pack(cid: np.ndarray, size: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Runs of equal classes as bytes: classes, their sizes, lengths of the runs."""
    cut = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]]))
    return cid[cut].tobytes(), size[cut].astype(np.uint32).tobytes(), np.diff(np.append(cut, len(cid))).astype(np.uint32).tobytes()


def _unpack(cids: bytes, sizes: bytes, lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(lengths, np.uint32)
    return np.repeat(np.frombuffer(cids, np.int64), n), np.repeat(np.frombuffer(sizes, np.uint32), n)


def _repeated(blobs: list[tuple], marks: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(shingle, class, its size, count) of the shingles of two classes or more and of the marked ones.

    ``blobs`` has shingles with their packed classes, all equal modulo ``parts``; it is emptied. Steps
    of about COUNT_STEP, dealt by the shingle, are unpacked, sorted and counted one by one.
    """
    steps = -(-sum(len(x[0]) for x in blobs) // COUNT_STEP)
    step = np.concatenate([(x[0] // U64(parts) % U64(steps)).astype(np.uint16 if steps < 1 << 16 else np.uint32) for x in blobs])
    tokens, cids, sizes, lengths = (np.concatenate([np.frombuffer(x[k], kind) for x in blobs]) for k, kind in enumerate((np.uint64, np.int64, np.uint32, np.uint32)))
    blobs.clear()
    run = np.repeat(np.arange(len(cids), dtype=np.uint32), lengths)
    out = []
    for k in range(steps):
        at = np.flatnonzero(step == k)
        if not len(at):
            continue
        token, cid, size = tokens[at], cids[run[at]], sizes[run[at]]
        order = np.lexsort((cid, token))
        token, cid, size = token[order], cid[order], size[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])  # a class can come from several tasks
        token, cid, size = token[new], cid[new], size[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        each = np.diff(np.append(first, len(token)))
        n = np.where(np.isin(token[first], marks), HOT_COUNT, each) if len(marks) else each
        n = np.repeat(n, each)
        keep = n > 1
        out.append((token[keep], cid[keep], size[keep], n[keep].astype(np.uint32)))
    return out


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def _active(docs: DataFrame) -> DataFrame:
    """(cid, n, shingles, heads, meetings) of the classes that can link: repeated shingles in order, the prefix, minimum hashes.

    Shingles travel in blobs: to the task that counts them, and those of two classes or more to
    the task that gathers their class. A part is a task of its own; by a hash of their numbers
    several parts would meet in one and leave others idle.
    """
    parts = partitions(docs, 4.0)
    width = partitions(docs)
    flush = min(max(256 * parts, FLUSH[0]), FLUSH[1])
    dealt = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("tokens", pa.binary()), ("cids", pa.binary()), ("sizes", pa.binary()), ("lengths", pa.binary())])
    counted = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary()), ("cids", pa.binary()), ("sizes", pa.binary()), ("lengths", pa.binary())])

    def rows(found: list) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        token, cid, size = (np.concatenate(x) for x in zip(*found, strict=True))
        values, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
        hot = count[inverse] >= HOT
        home = (token % U64(parts)).astype(np.int32)
        away = ((mix(token) ^ cid.view(np.uint64)) % U64(parts)).astype(np.int32)
        out = []
        for kind, at in ((0, np.flatnonzero(~hot)), (1, np.flatnonzero(hot))):
            for p, i in split_by((away if kind else home)[at]):
                out.append((p, kind, token[at[i]].tobytes(), *_pack(cid[at[i]], size[at[i]])))
        marks = values[count >= HOT]
        out += [(p, 2, marks[i].tobytes(), b"", b"", b"") for p, i in split_by((marks % U64(parts)).astype(np.int32))]
        yield _batch(out, dealt)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, seen = [], 0, set()
        for b in batches:
            for i, j, data, offs in chunks(b.column(0)):
                owner, grams = shingle_sets(data, offs)
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                n = np.diff(cut)
                cids, fresh = np.zeros(j - i, np.int64), np.zeros(j - i, dtype=bool)
                for r in np.flatnonzero(n):
                    cids[r] = _cid(grams[cut[r] : cut[r + 1]])
                    if cids[r] not in seen:  # copies in one task are one class already
                        seen.add(cids[r])
                        fresh[r] = True
                keep = fresh[owner]
                found.append((grams[keep], cids[owner[keep]], n[owner[keep]].astype(np.uint32)))
                size += int(keep.sum())
                if size >= flush:
                    yield from rows(found)
                    found, size = [], 0
        yield from rows(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold, out, marks = [], [], []
        for b in batches:
            kinds = b.column(1).to_numpy()
            for r in range(len(kinds)):
                tokens, *packed = (c[r].as_buffer() for c in b.columns[2:])  # not copied out of Arrow
                token = np.frombuffer(tokens, np.uint64)
                if kinds[r] == 2:
                    marks.append(token)
                elif kinds[r] == 1:
                    out.append((token, *_unpack(*packed), np.full(len(token), HOT_COUNT, np.uint32)))
                else:
                    cold.append((token, *packed))
        if cold:
            out += _repeated(cold, np.concatenate(marks) if marks else np.zeros(0, np.uint64), parts)
        del cold, marks
        if out:
            token, cid, size, n = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            order = np.argsort(cid, kind="stable")
            token, cid, size, n = token[order], cid[order], size[order], n[order]
            found = [(p, token[i].tobytes(), n[i].tobytes(), *_pack(cid[i], size[i])) for p, i in split_by((cid.view(np.uint64) % U64(width)).astype(np.int32))]
            if found:
                yield _batch(found, counted)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint32), *_unpack(*packed)) for b in batches for t, c, *packed in zip(*[x.to_pylist() for x in b.columns[1:]], strict=True)]
        if not got:
            return
        token, n, cid, size = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((token, n, cid))
        token, cid, size = token[order], cid[order], size[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
        token, cid, size = token[new], cid[new], size[new].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]]))
        length = np.diff(np.append(first, len(cid)))
        need = -(-PERCENT * size[first] // 100)
        alive = np.flatnonzero(length >= need)
        lowest = np.stack([np.minimum.reduceat(mix(token ^ U64(k + 1)), first).view(np.int64) for k in range(MEETINGS)], axis=1)
        for x in range(0, len(alive), 2000):
            at = alive[x : x + 2000]
            sets = [token[first[r] : first[r] + length[r]].tobytes() for r in at]
            heads = [token[first[r] : first[r] + length[r] - need[r] + 1].view(np.int64) for r in at]
            yield pa.RecordBatch.from_arrays([pa.array(cid[first[at]]), pa.array(size[first[at]]), pa.array(sets, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(list(lowest[at]), pa.list_(pa.int64()))], names=["cid", "n", "shingles", "heads", "meetings"])

    x = docs.select("text").mapInArrow(deal, "part int, kind int, tokens binary, cids binary, sizes binary, lengths binary")
    x = x.repartitionById(parts, "part").mapInArrow(count, "part int, tokens binary, counts binary, cids binary, sizes binary, lengths binary")
    x = x.repartitionById(width, "part").mapInArrow(gather, "cid long, n long, shingles binary, heads array<long>, meetings array<long>")
    return materialize(x)


def _meetings(posts: DataFrame) -> DataFrame:
    """(token, cid, root, i, j): the groups in which the members of the buckets of ``posts`` meet.

    ``posts`` has token, cid, bytes, root and weight (sets of the root). Only buckets of two roots or more
    count. Those with the same heaviest root become one group with the members of all: sets that met
    still meet, and a group of near copies with outsiders is walked once, not once for every
    shingle they share. Sets of the heaviest root are connected already, so a large group is
    cut in blocks of these, which the others meet one by one; only if the others exceed a block are they too
    cut, and meet each other block against block.
    """
    b = posts.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max(F.struct("weight", "root")).alias("top"))
    b = b.where("r <> s").select("token", F.col("top.root").alias("top"))
    m = posts.join(b, "token").select(F.col("top").alias("token"), "cid", "root", "bytes").distinct()
    own = F.col("root") == F.col("token")
    count = lambda inside: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.when(inside, F.col("bytes"))), F.lit(0)) / BLOCK_BYTES)).cast("int")
    m = m.join(m.groupBy("token").agg(count(own).alias("own_blocks"), count(~own).alias("other_blocks")), "token")
    mine = lambda blocks: F.pmod(F.xxhash64("cid", F.lit(1)), F.col(blocks)).cast("int")
    each = lambda blocks, f: F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), f)
    at = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    inner = each("other_blocks", lambda j: at(mine("own_blocks"), j))
    outer = each("own_blocks", lambda i: at(i, mine("other_blocks")))
    others = each("other_blocks", lambda k: at(-1 - F.least(k, mine("other_blocks")), F.greatest(k, mine("other_blocks"))))
    outer = F.when(F.col("other_blocks") > 1, F.concat(outer, others)).otherwise(outer)
    return m.select("token", "cid", "root", F.explode(F.when(own, inner).otherwise(outer)).alias("p")).select("token", "cid", "root", "p.i", "p.j")


def _walk(members: DataFrame, active: DataFrame, width: int) -> DataFrame:
    """(a, b): the links found in groups (token, i, j) of ``members``."""
    filled = members.join(active.select("cid", "n", "shingles"), "cid").select("token", "i", "j", "cid", "n", "root", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        group, rows = None, []
        for batch in batches:
            token, i, j, cid, n, root = (batch.column(x).to_pylist() for x in range(6))
            for r, key in enumerate(zip(token, i, j, strict=True)):
                if key != group:
                    _tree_join(rows, a, b)
                    group, rows = key, []
                rows.append((cid[r], n[r], batch.column(6)[r].as_py(), root[r]))
        _tree_join(rows, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return filled.repartition(width, "token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _links(docs: DataFrame) -> DataFrame:
    """(a, b): links between classes that connect what all links connect.

    First classes meet by minimum hashes, each in one block of its bucket: that connects nearly all
    near copies at little cost, and decides nothing. Then the buckets of the prefixes, which miss no
    link, are walked where their members are not connected yet.
    """
    width = partitions(docs)
    active = _active(docs)
    sets = active.select("cid", F.octet_length("shingles").alias("bytes"), "heads", "meetings")
    posts = sets.select("cid", "bytes", F.explode("meetings").alias("token"))
    met = posts.join(posts.groupBy("token").agg(F.count("*").alias("m"), F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks")).where("m > 1"), "token")
    block = F.pmod(F.xxhash64("cid", "token"), F.col("blocks")).cast("int")  # other blocks at every meeting, so blocks connect
    first = materialize(_walk(met.select("token", "cid", F.col("cid").alias("root"), block.alias("i"), F.lit(0).alias("j")), active, width))
    named = materialize(components(first).select(F.col("node").alias("cid"), "root"))
    weights = named.groupBy("root").agg(F.count("*").alias("weight"))
    posts = sets.join(named.join(weights, "root"), "cid", "left").select("cid", "bytes", F.coalesce("root", "cid").alias("root"), F.coalesce("weight", F.lit(0)).alias("weight"), F.explode("heads").alias("token"))
    return materialize(first.union(_walk(_meetings(materialize(posts)), active, width)))


def _tree_join(rows: list, a: list[int], b: list[int]) -> None:
    """Walk one bucket's sets through a prefix tree; appends linked classes."""
    if len(rows) < 2:
        return
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    cut = np.cumsum([0] + [len(s) for s in sets])
    x = np.concatenate(sets)
    values, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    place = np.empty(len(values), np.int64)
    place[np.lexsort((values, -count))] = np.arange(len(values))  # the bucket's most frequent first
    rank = place[inverse]
    tree = PrefixTree()
    known: dict[int, int] = {}
    for r, (_, n, _, root) in enumerate(rows):
        tree.add(np.sort(rank[cut[r] : cut[r + 1]]).tolist(), n, known.setdefault(root, r))
    for u, v in tree.links:
        a.append(rows[u][0])
        b.append(rows[v][0])


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text of fewer than five
    words is one shingle, one without words has an empty set and links with nothing. Returns
    doc_id, n_shingles, component_id (the smallest doc_id that links reach) and class_id (equal
    for equal sets, null for empty ones). The join is exact up to 64-bit hash collisions.

    Nulls: a null text is empty; a null doc_id is linked like any other but is never a
    component_id unless alone. Repeated rows repeat. Empty tables give no rows; other columns
    are ignored.
    """
    rows = materialize(_classes(docs))
    linked = components(_links(docs))
    least = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first"))
    least = least.join(linked.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = least.groupBy("root").agg(F.min("first").alias("component"))
    named = least.join(lowest, "root").select("cid", "component")
    return rows.join(named, "cid", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.col("cid").alias("class_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all of ``documents``."""
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS MATERIALIZED (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS MATERIALIZED (SELECT s.doc_id, s.g FROM s JOIN f USING (g)),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * i >= 75 * (u.n + v.n - i)),
c AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.y AS node, c.root FROM c JOIN e ON e.x = c.node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM c GROUP BY node) m ON m.node = w.doc_id
"""
