"""Operator 5, SimHash near-dedup: anchor-point covering by the binary Golay code.

A document's features are its distinct words (runs of letters and digits, lower case).  Its fingerprint has 128 bits: bit
b is set if more features have bit b of their 128-bit hash set than not.  Two documents are near copies if their
fingerprints differ in at most `NEAR` of the first 92 bits and at most `NEAR_ALL` of the 128.  A group is a connected
component of near copies.  The result has a row for each document of a group of two or more: doc_id, group_id (the
least doc_id of the group), n_docs, and keep (true for the document whose doc_id is group_id).

Search.  The first 92 bits are four words of 23 bits.  The Golay code of 4,096 codewords covers 23-bit words with radius 3
and is perfect: every word has one anchor within 3.  If fingerprints differ in at most 12 bits, they differ in a word by
no more than its share (SHARES: 3, 2, 2 or 2 bits, as 4 + 3 + 3 + 3 = 12 + 1).  So each fingerprint is sent, for each
of its four words, to its own anchor as a home, and to every anchor within 3 + share as a visitor; two near copies meet
at the home anchor of either.  The search is exact.

Documents with one fingerprint are one node of the search.  Anchors are put in as many parts as make a part PART_BYTES at most;
where there are not anchors enough, a part's visitors are split, and its homes go to each split.  In a part a union-find
leaves one edge a node, not all pairs, and nodes that are known to be linked aren't compared: a group of very many near
copies is linked by a few of its nodes, and its others are compared with those outside of it only (linked()).  Components
are found with alternating large-star and small-star rounds over tables in the shared folder, until nothing changes.

Defined cases: a null text is an empty one; all texts without a word have one fingerprint (0) and are one group; rows with
a null doc_id are left out; rows that share a doc_id are one document, whose fingerprints are linked; an empty table gives
no rows; other columns are not read.  kept() returns one row of each group: of rows that share the doc_id kept, that of
least text (null first, then in the order of bytes) and then of least other columns; rows with a null doc_id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import textscan
from loomgraph.llm.shared import blobs, chunks, doc_ids, forget, give_back, grouped, pieces, unused, utf8_buffers, written
from loomgraph.llm.windows import PACKED_ROWS, pack, packed_rows, unpack
from loomgraph.operators.graph import components

NEAR, NEAR_ALL = 12, 20
SHARES = (3, 2, 2, 2)
#: Bytes that a fingerprint takes at the anchors it is sent to, and bytes of a part.
SENT_BYTES, PART_BYTES = 3800, 4 << 20
#: Anchors of a word, and parts of them at least: with so many, a part gets few of a fingerprint's anchors, so that what is
#: sent follows the input.
ANCHORS, LEAST_PARTS = 1 << 12, 256

#: Bytes that end a word: ASCII other than letters and digits.
GAP = np.ones(256, bool)
GAP[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    GAP[_a:_b] = False


def _golay() -> np.ndarray:
    """The syndrome of each 23-bit word: the remainder modulo the generator."""
    remainder = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for b in range(22, 10, -1):
            if r >> b & 1:
                r ^= 0b110001110101 << (b - 11)
        remainder[i] = r
    syndrome = np.zeros(1 << 23, np.uint16)
    for i in range(23):
        syndrome[1 << i : 2 << i] = syndrome[: 1 << i] ^ remainder[i]
    return syndrome


class Golay:
    """Anchors of 23-bit words."""

    _made: "Golay | None" = None

    @classmethod
    def get(cls) -> "Golay":
        if cls._made is None:
            cls._made = cls()
        return cls._made

    def __init__(self) -> None:
        self.syndrome = _golay()
        self.visits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for share in sorted({0, *(s + 3 for s in SHARES), 3}):
            w = self.patterns(max(share, 3))
            s = self.syndrome[w]
            order = np.argsort(s, kind="stable")
            self.visits[max(share, 3)] = (w[order], np.searchsorted(s[order], np.arange(2049)))

    @staticmethod
    def patterns(weight: int) -> np.ndarray:
        n = np.arange(1 << 23, dtype=np.uint32)
        return n[np.bitwise_count(n) <= weight]

    def anchors(self, words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word the anchors within reach: indices of words, and the anchors' numbers."""
        pattern, cut = self.visits[reach]
        s = self.syndrome[words].astype(np.int64)
        n = cut[s + 1] - cut[s]
        which = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cut[s], n)
        return which, (words[which] ^ pattern[at]) >> 11


def split_words(low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """The four 23-bit words of the first 92 bits: bits 0-45 of low, and of high."""
    mask = np.uint64((1 << 23) - 1)
    return [(x >> np.uint64(s) & mask).astype(np.uint32) for x in (low, high) for s in (0, 23)]


FIRST = np.uint64((1 << 46) - 1)


def near(a_low, a_high, b_low, b_high) -> np.ndarray:
    x, y = a_low ^ b_low, a_high ^ b_high
    head = np.bitwise_count(x & FIRST) + np.bitwise_count(y & FIRST)
    return (head <= NEAR) & (np.bitwise_count(x).astype(np.uint16) + np.bitwise_count(y) <= NEAR_ALL)


#: The byte b as eight bytes of a 64-bit word, one for each of its bits.
_LANES = np.zeros(256, np.uint64)
for _b in range(256):
    _LANES[_b] = sum((_b >> i & 1) << (8 * i) for i in range(8))


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit word for each run of hashes, of the bits that more than half of the run have."""
    n = np.diff(np.r_[first, len(hashes)])
    # bytes are summed in runs of 255 at most, so that none overflows
    parts = -(-n // 255)
    row = np.repeat(np.arange(len(n)), parts)
    start = first[row] + 255 * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
    head = np.cumsum(parts) - parts
    by = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(n), np.uint64)
    for k in range(8):
        sums = np.add.reduceat(_LANES[by[:, k]], start).view(np.uint8).reshape(-1, 8).astype(np.int64)
        count = np.add.reduceat(sums, head, axis=0)
        bits = np.packbits(count * 2 > n[:, None], axis=1, bitorder="little")[:, 0]
        out |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprint(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low and high 64 bits of the fingerprint of each text."""
    data, off = utf8_buffers(pc.utf8_lower(texts))
    _, _, word_off, h = textscan.scan(data, off, GAP)
    low, high = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    if not len(h):
        return low, high
    row = np.repeat(np.arange(len(texts)), np.diff(word_off))
    order = np.lexsort((h, row))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    rows, first = np.unique(row, return_index=True)
    low[rows] = majority(h, first)
    high[rows] = majority(textscan.mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), first)
    return low, high


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        ids, ok = doc_ids(batch)
        low, high = fingerprint(batch.column("text").fill_null(""))
        yield pa.RecordBatch.from_pydict({"doc_id": ids[ok], "low": low[ok].view(np.int64), "high": high[ok].view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, low, high of each row with a doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_prints, "doc_id long, low long, high long")


def parts_of(nodes: int) -> tuple[int, int, int]:
    """Parts of each word's anchors, splits of each part's visitors, and tasks."""
    n = pieces(nodes * SENT_BYTES, 4 * PART_BYTES)
    return min(max(n, LEAST_PARTS), ANCHORS), pieces(n, ANCHORS), max(8, 4 * n)


def _send(parts: int, splits: int, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay.get()
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 13):
                batch = whole.slice(at, 1 << 13)
                node = np.asarray(batch.column("node"))
                low, high = (np.asarray(batch.column(c)).view(np.uint64) for c in ("low", "high"))
                split = (textscan.mix(node.astype(np.uint64)) % np.uint64(splits)).astype(np.int64)
                keys, rows = [], []
                for w, words in enumerate(split_words(low, high)):
                    sides = []
                    for reach in (3, 3 + SHARES[w]):
                        i, anchor = golay.anchors(words, reach)
                        part = anchor.astype(np.int64) % parts
                        if reach > 3:
                            part = part * splits + split[i]
                        order = np.argsort(part, kind="stable")
                        i, anchor = i[order], anchor[order].astype(np.uint16)
                        cut = np.searchsorted(part[order], np.arange(parts * (splits if reach > 3 else 1) + 1))
                        sides.append((i, anchor, cut))
                    for p in range(parts * splits):
                        arrays = []
                        for (i, anchor, cut), q in zip(sides, (p // splits, p)):
                            j = i[cut[q] : cut[q + 1]]
                            arrays += [anchor[cut[q] : cut[q + 1]], node[j], low[j], high[j]]
                        if len(arrays[0]) or len(arrays[4]):
                            keys.append(w * parts * splits + p)
                            rows.append(pack(*arrays))
                yield from packed_rows(keys, rows, 4 * parts * splits, tasks).to_batches()
        give_back()

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    return root


def linked(home: list[np.ndarray], visit: list[np.ndarray], block: int = 1 << 20, leaders: int = 16, crowd: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, node) that link all near homes and visitors (node, low, high) of an anchor: not all pairs, but as
    many as make the same components.

    Up to `leaders` homes, none linked to one before it, are compared with all; then the homes of each component of over
    `crowd` homes are compared with the visitors outside of it, so that they cost nothing among themselves.
    """
    names, of = np.unique(np.r_[home[0], visit[0]], return_inverse=True)
    h, v = of[: len(home[0])], of[len(home[0]) :]
    root = np.arange(len(names))
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        """Links homes i with visitors j."""
        step = max(1, block // max(1, len(j)))
        low, high = visit[1][j][None], visit[2][j][None]
        for k in range(0, len(i), step):
            x, y = np.nonzero(near(home[1][i[k : k + step], None], home[2][i[k : k + step], None], low, high))
            a, b = h[i[k + x]], v[j[y]]
            edges.append((a, b))

    def join() -> None:
        nonlocal root
        if edges:
            root = roots(len(names), *(root[np.concatenate(x)] for x in zip(*edges)))[root]
            edges.clear()

    if len(h) * len(v) <= block:
        compare(np.arange(len(h)), np.arange(len(v)))
        join()
    else:
        led = np.zeros(len(h), bool)
        for _ in range(leaders):
            lone = np.flatnonzero((np.bincount(root, minlength=len(names))[root[h]] == 1) & ~led)
            if not len(lone):
                break
            led[lone[0]] = True
            compare(lone[:1], np.arange(len(v)))
            join()
        order = np.argsort(root[h], kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(root[h][order]) > 0, True])
        big = np.diff(cut) > crowd
        small = np.concatenate([order[cut[c] : cut[c + 1]] for c in np.flatnonzero(~big)] or [order[:0]])
        compare(small, np.arange(len(v)))
        for c in np.flatnonzero(big):
            own = order[cut[c] : cut[c + 1]]
            compare(own, np.flatnonzero(root[v] != root[h[own[0]]]))
        join()
    star = np.flatnonzero(root != np.arange(len(names)))
    return names[star], names[root[star]]


def _meet(table: pa.Table) -> pa.Table:
    """Edges (node, least node of its component at an anchor)."""
    parts = [unpack(raw) for raw in blobs(table.column("packed"))]
    home, visit = ([np.concatenate([p[k + i] for p in parts]) for i in range(4)] for k in (0, 4))
    src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    home, visit = ([c[np.argsort(s[0], kind="stable")] for c in s] for s in (home, visit))
    for a in np.unique(home[0]):
        i, j = np.searchsorted(home[0], [a, a + 1]), np.searchsorted(visit[0], [a, a + 1])
        x, y = linked([c[i[0] : i[1]] for c in home[1:]], [c[j[0] : j[1]] for c in visit[1:]])
        src.append(x)
        dst.append(y)
    x, y = np.concatenate(src), np.concatenate(dst)
    names, inverse = np.unique(np.r_[x, y], return_inverse=True)
    root = roots(len(names), inverse[: len(x)], inverse[len(x) :])
    star = np.flatnonzero(root != np.arange(len(names)))
    give_back()
    return pa.table({"src": pa.array(names[star], pa.int64()), "dst": pa.array(names[root[star]], pa.int64())})


def near_groups(docs: DataFrame) -> DataFrame:
    """See the module's text.  Returns doc_id, group_id, n_docs, keep."""
    prints = written(fingerprints(docs).distinct(), "fingerprints")
    nodes = written(prints.groupBy("low", "high").agg(F.min("doc_id").alias("node")), "nodes")
    parts, splits, tasks = parts_of(nodes.count())
    found = grouped(nodes.mapInArrow(_send(parts, splits, tasks), PACKED_ROWS), tasks).applyInArrow(_meet, "src long, dst long")
    # copies of one fingerprint are put under their node once, and don't take part in the rounds
    of = written(prints.join(nodes, ["low", "high"]).select("doc_id", "node"), "members")
    several = of.groupBy("doc_id").agg(F.min("node").alias("dst"), F.count("*").alias("n")).where("n > 1").select("doc_id", "dst")
    shared = of.join(several, "doc_id").select(F.col("node").alias("src"), "dst")
    linked_nodes = components(found.union(shared))
    forget(prints)
    forget(nodes)
    members = of.join(linked_nodes, "node", "left").select("doc_id", F.coalesce("root", "node").alias("group_id")).distinct()
    counts = members.groupBy("group_id").agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    return members.join(counts, "group_id").select("doc_id", "group_id", "n_docs", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def kept(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group: see the module's text."""
    key, of = unused(docs, "gone", "of_id")
    doc_id = F.col("doc_id").cast("long")
    gone = near_groups(docs).where("not keep").select(F.col("doc_id").alias(key))
    left = docs.join(gone, doc_id == F.col(key), "left_anti")
    several = written(left.where("doc_id IS NOT NULL").groupBy(doc_id.alias(of)).agg(F.count("*").alias(key)).where(F.col(key) > 1).select(of), "repeated")
    if not several.take(1):
        return left
    # combined before the shuffle, so an id of very many rows is no skew
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.col("text"), F.xxhash64(*columns))
    one = left.join(several, doc_id == F.col(of), "left_semi").groupBy(doc_id.alias(of)).agg(F.min_by(F.struct(*columns), order).alias(key))
    return left.join(several, doc_id == F.col(of), "left_anti").union(one.select(*[F.col(key)[c].alias(c) for c in docs.columns]))
