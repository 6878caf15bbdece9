"""Operator 7, LM scoring by online logistic context mixing.

A text is its UTF-8 bytes; a byte is the binary decisions on its way down a Huffman tree, of the corpus' bytes that follow
the byte before it (3 to 4 on average).  Three predictors give each decision's log odds in a hashed context.  Two know
counts over the whole corpus: of the last four bytes, and of the word so far with the byte before it.  The third has
counters of the text alone (1 << OWN_BITS, hashed from the last two bytes and the place in the tree), which learn from each
decision.  The log odds are summed with weights, of a set gated by the decision's depth and by whether a letter came before;
after each decision the weights take a step down the coding loss, and the mixed probability is refined by an adaptive map
(per text, by its quantised logarithm).  The score is the sum of -log2 of the probabilities given to what came.

Weights, counters and map learn from a text's first decision to its last.  Texts run in lockstep, one lane each, so they
are dealt to tasks by their length (by_length()) and end together; a text of over LONG bytes is scored alone, one decision
after the other.  Which way a text is scored depends on its length only.

Plan: a first scan counts pairs of bytes, for the trees and the share of slots that contexts after each byte get; a second
one counts (context slot, byte) pairs; each task sends what it counted, by predictor and range of slots, and
one shuffle adds it up, so what is gathered follows the input.  The tables made of it have slots that double with each
fourfold corpus (table_bits()), to MOST_BITS at most: 256 bytes a slot, 128 MB in all.  They are broadcast; a scan of the
lengths and one shuffle of the texts lay those of like length together, and these are scored.  The model has seen the text it scores, as in two-pass compression.

scores(): doc_id, n_bytes, bits, bits_per_byte of each row.  Defined cases: null and empty texts have 0 bits and null
bits_per_byte; a null doc_id stays null; repeated rows count and are scored as often as they are there; an empty table
gives no rows; other columns are not read.  Bits are rounded to thousandths.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.fingerprints import GAP
from loomgraph.llm.shared import chunks, forget, give_back, utf8_buffers, written
from loomgraph.llm.windows import pack, unpack

PREDICTORS = 2
#: Bytes of a text after which its adaptation would start anew: none has as many.
SEGMENT = 1 << 62
#: Bytes of each text whose decisions are laid out at once; decisions after which costs are added up.
STRETCH, TURN = 512, 64
#: Lanes whose decisions are laid out by one step, so that what it makes stays in the cache.
FEW = 32
#: Bits of the tables' slots, at least and at most; slots of a part of a table.
LEAST_BITS, MOST_BITS, PART_SLOTS = 16, 18, 2048
#: Bytes of corpus up to which tables have 1 << LEAST_BITS slots, and of text that are scored in lockstep at most.
SMALL_CORPUS, GROUP_BYTES = 256 << 20, 32 << 20
#: Texts in lockstep at most, and bytes of a text beyond which it is scored alone.
LANES, LONG = 4096, 80 << 10
RATE, REFINE, OWN_RATE = 0.02, 0.02, 0.2
#: First weights of the predictors, of none, and of the text's own counters.
START = (0.6, 0.6, 0.0, 1.0)
#: Counters of a text's own, as a power of two.
OWN_BITS = 10
GATES, STEPS_OF_MAP = 6, 33
SCALE = np.float32(1 / 16)
#: Bits for a slot in features().
SLOT_BITS = np.uint64(24)
PACKED = pa.schema([("part", pa.int32()), ("packed", pa.binary())])


def pairs(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """256 times the byte before (0 at the beginning of a text), plus the byte, for each byte."""
    out = data.astype(np.int64)
    out[1:] += data[:-1].astype(np.int64) << 8
    begin = off[:-1][np.diff(off) > 0]
    out[begin] = data[begin]
    return out


class Slots:
    """The slots of a table: those of contexts after a byte lie together, and number by its share of the corpus."""

    def __init__(self, counts: np.ndarray, bits: int):
        n = counts.reshape(256, 256).sum(axis=1)
        self.size = np.maximum(1, ((1 << bits) - 256) * n // max(1, int(n.sum())))
        self.first = np.r_[0, np.cumsum(self.size)]
        self.total = 1 << bits

    def of(self, before: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of 32-bit hashes of contexts after the bytes `before`."""
        return self.first[before] + (h.astype(np.int64) * self.size[before] >> 32)


def contexts(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each byte's context for the two predictors, and of the last two bytes; nothing comes before a text's first
    byte."""
    n = len(data)
    begin = off[:-1][np.diff(off) > 0]
    d = data.astype(np.uint32)
    back = []
    for k in (1, 2, 3, 4):
        x = np.zeros(n, np.uint32)
        np.add(d[:-k], np.uint32(1), out=x[k:])
        for j in range(k):
            at = begin + j
            x[at[at < n]] = 0
        back.append(x)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = x * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        return x

    two = back[0] + back[1] * np.uint32(257)
    # the word so far: a prefix sum of bytes times powers, from the word's beginning, which is after
    # the last gap before the byte, or where the text begins
    here = np.arange(n, dtype=np.int32)
    start = np.zeros(n, np.int32)
    np.multiply(here[1:], GAP.take(data[:-1]), out=start[1:])
    start[begin] = begin
    np.maximum.accumulate(start, out=start)
    powers = _powers(n + 1)
    total = np.empty(n + 1, np.uint32)
    total[0] = 0
    np.cumsum((d | np.uint32(32)) * powers[0][:n], out=total[1:], dtype=np.uint32)
    word = (total[:n] - total.take(start)) * powers[1].take(start)
    length = (here - start).view(np.uint32)
    four = mixed(two + (back[2] + back[3] * np.uint32(257)) * np.uint32(66049))
    word = mixed(word * np.uint32(31) + length + two * (length == 0))
    return [four, word], mixed(two + np.uint32(0x10001))


_pow: list[np.ndarray] = [np.ones(1, np.uint32), np.ones(1, np.uint32)]


def _powers(n: int) -> list[np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for b in (0x01000193, pow(0x01000193, -1, 1 << 32)):
            p = np.empty(size, np.uint32)
            p[0], done = 1, 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint32(pow(b, done, 1 << 32))
                done *= 2
            out.append(p)
        _pow = out
    return _pow


def huffman(counts: list[int]) -> tuple[list[list[tuple[int, int]]], list[int], list[tuple[int, int, int]]]:
    """For each byte its path, (inner node, bit); the leaves in an order in which each inner node has a range of them; and
    the ranges (begin, middle, end)."""
    whole = sum(counts)
    # counts are scaled, so that no path is very long
    heap: list[tuple] = [(1 + (c << 16) // max(1, whole), i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], n, (a[2], b[2])))
        n += 1
    order: list[int] = []
    ranges: list[tuple[int, int, int]] = []
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]

    def walk(node, path: list[tuple[int, int]]) -> None:
        if isinstance(node, int):
            paths[node] = path
            order.append(node)
            return
        number = len(ranges)
        ranges.append((0, 0, 0))
        begin = len(order)
        walk(node[0], [*path, (number, 0)])
        middle = len(order)
        walk(node[1], [*path, (number, 1)])
        ranges[number] = (begin, middle, len(order))

    walk(heap[0][2], [])
    return paths, order, ranges


class Trees:
    """A Huffman tree of the bytes after each byte, of counts of pairs(); what is kept by pair is the way to the byte."""

    def __init__(self, counts: np.ndarray):
        made = [huffman(row) for row in counts.reshape(256, 256).tolist()]
        ways = [path for paths, _, _ in made for path in paths]
        self.size = np.array([len(w) for w in ways])
        self.first = np.cumsum(self.size) - self.size
        self.node = np.array([n for w in ways for n, _ in w], np.uint8)
        self.bit = np.array([x for w in ways for _, x in w], np.uint8)
        depth = np.arange(len(self.node)) - np.repeat(self.first, self.size)
        self.depth = np.where(depth == 0, 0, np.where(depth < 3, 1, 2)).astype(np.uint8)
        self.node_hash = (self.node.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
        self.sign = self.depth.astype(np.uint16) * np.uint16(2) + self.bit
        self.order = np.array([o for _, o, _ in made], np.uint8)
        self.ranges = np.array([r for _, _, r in made], np.int16)

    def table(self, before: int, counts: np.ndarray) -> np.ndarray:
        """For counts of bytes in contexts after a byte, the logarithm of the odds (in sixteenths) at each node."""
        total = np.zeros((len(counts), 257))
        np.cumsum(counts[:, self.order[before]], axis=1, out=total[:, 1:])
        a, m, b = self.ranges[before].T
        low, high = total[:, m] - total[:, a], total[:, b] - total[:, m]
        out = np.zeros((len(counts), 256), np.int8)
        out[:, :255] = np.clip(np.rint(16 * np.log((high + 0.4) / (low + 0.4))), -127, 127)
        return out


def table_bits(n_bytes: int) -> int:
    """Bits of the slots of a predictor's table for a corpus."""
    grown = LEAST_BITS
    while grown < MOST_BITS and n_bytes > SMALL_CORPUS << 2 * (grown - LEAST_BITS):
        grown += 1
    return grown


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n, first)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in chunks(batches):
        data, off = utf8_buffers(batch.column("text"))
        if len(data):
            total += np.bincount(pairs(data, off), minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["pair", "n"])
    give_back()


def _count(slots: Slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], list[np.ndarray]]] = [([], []) for _ in range(PREDICTORS)]
        for batch in chunks(batches):
            data, off = utf8_buffers(batch.column("text"))
            if not len(data):
                continue
            before = pairs(data, off) >> 8
            for (keys, counts), h in zip(held, contexts(data, off)[0]):
                key, n = np.unique((slots.of(before, h) << 8 | data).astype(np.uint32), return_counts=True)
                keys.append(key)
                counts.append(n.astype(np.uint32))
                if len(keys) >= 8:
                    keys[:], counts[:] = ([x] for x in summed(keys, counts))
        size = PART_SLOTS << 8
        for i, (keys, counts) in enumerate(held):
            if not keys:
                continue
            key, n = summed(keys, counts)
            cut = np.searchsorted(key, np.arange(0, (slots.total << 8) + 1, size))
            for p in range(len(cut) - 1):
                a, b = cut[p], cut[p + 1]
                if a < b:
                    at = (key[a:b] - np.uint32(p * size)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([i << 20 | p], pa.int32()), pa.array([pack(np.diff(at, prepend=0).astype(np.uint32), n[a:b], squeeze=True)], pa.binary())], schema=PACKED)
        give_back()

    return run


def _tables(trees, slots: Slots):
    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros(PART_SLOTS << 8, np.float64)
        for raw in table.column("packed").to_pylist():
            step, n = unpack(raw, True)
            counts[np.cumsum(step.astype(np.int64))] += n
        counts = counts.reshape(-1, 256)
        begin = (table.column("part")[0].as_py() & 0xFFFFF) * PART_SLOTS
        out = np.zeros((PART_SLOTS, 256), np.int8)
        cut = np.clip(slots.first - begin, 0, PART_SLOTS)
        for before in np.flatnonzero(np.diff(cut)):
            some = slice(cut[before], cut[before + 1])
            out[some] = trees.value.table(before, counts[some])
        return pa.table([table.column("part").slice(0, 1).combine_chunks(), pa.array([pack(out.reshape(-1), squeeze=True)], pa.binary())], schema=PACKED)

    return run


class Model:
    """Trees, slots, and for each predictor a table."""

    def __init__(self, trees: Trees, slots: Slots, tables: list[np.ndarray]):
        self.trees, self.slots, self.tables = trees, slots, tables


def model(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = np.zeros(1 << 16, np.int64)
    for r in texts.mapInArrow(_pair_counts, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        counts[r.pair] = r.n
    trees = Trees(counts)
    slots = Slots(counts, table_bits(int(counts.sum())))
    counted = written(texts.mapInArrow(_count(slots), "part int, packed binary"), "contexts")
    tables = [np.zeros((slots.total, 256), np.int8) for _ in range(PREDICTORS)]
    # rows of a fixed size, MOST_BITS bound their number
    for r in counted.groupBy("part").applyInArrow(_tables(spark.sparkContext.broadcast(trees), slots), "part int, packed binary").toLocalIterator():
        i, p = r.part >> 20, r.part & 0xFFFFF
        tables[i][p * PART_SLOTS : (p + 1) * PART_SLOTS] = unpack(bytes(r.packed), True)[0].reshape(-1, 256)
    forget(counted)
    return Model(trees, slots, tables)


def features(data: np.ndarray, off: np.ndarray, known: Model) -> tuple[np.ndarray, np.ndarray]:
    """pairs(), and for each byte the slots of the two predictors, above them the hash for the text's own counter, and above
    it whether a letter came before."""
    pair, feature = np.empty(len(data), np.uint16), np.empty(len(data), np.uint64)
    at = 0
    while at < len(off) - 1:  # few texts at a time, so that what a step makes stays in the cache
        to = max(at + 1, int(np.searchsorted(off, off[at] + (1 << 16), side="right")) - 1)
        some, begin = slice(off[at], off[to]), off[at : to + 1] - off[at]
        here = data[some]
        p = pairs(here, begin)
        hashes, own = contexts(here, begin)
        letter = np.zeros(len(here), np.uint64)
        letter[1:] = ~GAP[here[:-1]]
        letter[begin[:-1][np.diff(begin) > 0]] = 0
        x = letter << np.uint64(OWN_BITS) | own >> np.uint32(16) & np.uint32((1 << OWN_BITS) - 1)
        for h in hashes:
            x <<= SLOT_BITS
            x |= known.slots.of(p >> 8, h).view(np.uint64)
        pair[some], feature[some] = p, x
        at = to
    return pair, feature


def cells(pair: np.ndarray, feature: np.ndarray, known: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the number of its decisions; for each decision the predictors' odds (bytes), and twice the gate plus
    the bit, above the number of the text's own counter."""
    trees = known.trees
    n = trees.size.take(pair)
    # the place of each decision in the trees' paths
    flat = np.arange(int(n.sum()))
    flat += np.repeat(trees.first.take(pair) - np.cumsum(n) + n, n)
    node = trees.node.take(flat)
    cell = np.zeros((len(flat), 4), np.int8)
    low = np.uint64((1 << int(SLOT_BITS)) - 1)
    for i, table in enumerate(known.tables):
        slot = feature >> np.uint64(PREDICTORS - 1 - i) * SLOT_BITS & low
        at = np.repeat(slot.view(np.int64) << 8, n)
        at += node
        cell[:, i] = table.reshape(-1).take(at)
    top = (feature >> np.uint64(PREDICTORS) * SLOT_BITS).astype(np.uint16)
    letter = top >> np.uint16(OWN_BITS)
    own = np.repeat(top & np.uint16((1 << OWN_BITS) - 1), n)
    own ^= trees.node_hash.take(flat)
    own &= np.uint16((1 << OWN_BITS) - 1)
    own |= (trees.sign.take(flat) + np.repeat(np.uint16(6) * letter, n)) << np.uint16(OWN_BITS)
    return n, cell.view(np.uint32)[:, 0], own


def first_map() -> np.ndarray:
    return (1 / (1 + np.exp(-(np.arange(STEPS_OF_MAP) - 16) / 2))).astype(np.float32)


def alone(pair: np.ndarray, feature: np.ndarray, known: Model) -> float:
    """Bits of one text, one decision after the other."""
    weights = [[START[0], START[1], START[3]] for _ in range(GATES)]
    refined, counters = first_map().tolist(), [0.0] * (1 << OWN_BITS)
    below, total, exp, log2 = (1 << OWN_BITS) - 1, 0.0, math.exp, math.log2
    for at in range(0, len(pair), 1 << 16):
        _, cell, info = cells(pair[at : at + (1 << 16)], feature[at : at + (1 << 16)], known)
        odds = cell.view(np.int8).reshape(-1, 4)[:, :2] * float(SCALE)
        for a, b, q in zip(odds[:, 0].tolist(), odds[:, 1].tolist(), info.tolist()):
            m, o = q >> OWN_BITS, q & below
            w, c = weights[m >> 1], counters[o]
            dot = a * w[0] + b * w[1] + c * w[2]
            dot = -8.0 if dot < -8.0 else 8.0 if dot > 8.0 else dot
            p = 1 / (1 + exp(-dot))
            k = int(dot * 2 + 16.5)
            r = refined[k]
            if m & 1:
                total -= log2((p + r) / 2)
                refined[k] = r + (1 - r) * REFINE
                error = 1 - p
            else:
                total -= log2(1 - (p + r) / 2)
                refined[k] = r - r * REFINE
                error = -p
            counters[o] = c + error * OWN_RATE
            error *= RATE
            w[0] += a * error
            w[1] += b * error
            w[2] += c * error
    return total


def score(data: np.ndarray, off: np.ndarray, known: Model) -> np.ndarray:
    """Bits of each text."""
    size = np.diff(off)
    bits = np.zeros(len(size))
    if not len(data):
        return bits
    pair, feature = features(data, off, known)
    for i in np.flatnonzero(size > LONG):
        bits[i] = alone(pair[off[i] : off[i + 1]], feature[off[i] : off[i + 1]], known)
    # a lane for each other text, the longest first
    who = np.flatnonzero((size > 0) & (size <= LONG))
    who = who[np.argsort(-size[who], kind="stable")]
    size, begin, lanes = size[who], off[who], len(who)
    # a lane has a row of weights (16 bytes a gate, moved as one number), of the map and of counters
    weights = np.tile(np.array(START, np.float32), (GATES * lanes, 1)).view(np.complex128)[:, 0]
    refined = np.tile(first_map(), lanes)
    counters = np.zeros(lanes << OWN_BITS, np.float32)
    gate_of, bit_of = np.arange(2 * GATES) >> 1, (np.arange(2 * GATES) & 1).astype(np.float32)
    cost = np.zeros(lanes)
    one, two, half, middle, most = (np.float32(x) for x in (1, 2, 0.5, 16.5, 8))
    rate, refine, own_rate = np.float32(RATE), np.float32(REFINE), np.float32(OWN_RATE)
    above, below = np.uint16(OWN_BITS), np.uint16((1 << OWN_BITS) - 1)
    for done in range(0, int(size.max(initial=0)), STRETCH):
        # lay out the next decisions of all lanes that go on
        going = int(np.searchsorted(-size, -done, side="left"))
        n = np.minimum(size[:going] - done, STRETCH)
        length, parts = np.empty(going, np.int64), []
        for i in range(0, going, FEW):
            m, first = n[i : i + FEW], begin[i : min(going, i + FEW)] + done
            at = np.arange(m.sum()) + np.repeat(first - np.cumsum(m) + m, m)
            each, *laid = cells(pair[at], feature[at], known)
            length[i : i + len(m)] = np.add.reduceat(each, np.cumsum(m) - m)
            parts.append(laid)
        cell, info = map(np.concatenate, zip(*parts))
        lane = np.argsort(-length, kind="stable")
        place, length = (np.cumsum(length) - length)[lane], length[lane]
        live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
        map_of, gates_of, own_of = lane * STEPS_OF_MAP, lane * GATES, lane << OWN_BITS
        product = np.ones(going)
        for t, k in enumerate(live.tolist()):
            here = place[:k]
            x = (cell.take(here).view(np.int8) * SCALE).reshape(k, 4)
            q = info.take(here)
            here += 1
            m = q >> above
            q &= below
            bit, gate, o = bit_of.take(m), gate_of.take(m), own_of[:k] + q
            gate += gates_of[:k]
            w = weights.take(gate).view(np.float32).reshape(k, 4)
            c = counters.take(o)
            x[:, 3] = c
            # the sum of four products, two at a time
            both = (x * w).view(np.complex64)
            both = (both[:, 0] + both[:, 1]).view(np.float32)
            dot = both[::2] + both[1::2]
            np.maximum(dot, -most, out=dot)
            np.minimum(dot, most, out=dot)
            p = dot * two
            p += middle
            spot = p.astype(np.int64)
            spot += map_of[:k]
            np.negative(dot, out=dot)
            np.exp(dot, out=p)
            p += one
            np.divide(one, p, out=p)
            r = refined.take(spot)
            # the probability given to what came: final where the bit is 1, else 1 - final
            np.add(p, r, out=dot)
            dot *= half
            dot += bit
            dot -= one
            product[:k] *= np.abs(dot, out=dot)
            error = np.subtract(bit, p, out=p)
            np.subtract(bit, r, out=dot)
            dot *= refine
            r += dot
            refined[spot] = r
            np.multiply(error, own_rate, out=dot)
            c += dot
            counters[o] = c
            error *= rate
            x *= np.repeat(error, 4).reshape(k, 4)
            w += x
            weights[gate] = w.view(np.complex128)[:, 0]
            if t % TURN == TURN - 1:
                cost[lane] -= np.log2(product)
                product[:] = 1
        cost[lane] -= np.log2(product)
    bits[who] = cost
    return bits


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in runs of LANES, or of GROUP_BYTES of text, as batches are smaller."""
    held, rows, size = [], 0, 0
    for run in chunks(batches):
        while run.num_rows:
            some, run = run.slice(0, LANES - rows), run.slice(LANES - rows)
            held.append(some)
            rows += some.num_rows
            size += len(utf8_buffers(some.column("text"))[0])
            if rows == LANES or size >= GROUP_BYTES:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _scores(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            data, off = utf8_buffers(group.column("text"))
            bits, n = score(data, off, known.value), np.diff(off)
            each = pa.array(np.round(bits / np.maximum(n, 1), 6), mask=n == 0)
            yield pa.RecordBatch.from_arrays([group.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(np.round(bits, 3)), each], names=["doc_id", "n_bytes", "bits", "bits_per_byte"])
        give_back()

    return run


def shares(held: dict[int, int], tasks: int) -> tuple[list[float], int]:
    """For classes of length (four to a doubling) and the bytes of their texts, where each class begins when all are laid
    along parts, and the number of parts: parts have as many bytes as make `tasks` of all, but of long texts enough for
    LANES / 8 of them, and 3/4 of GROUP_BYTES at most, so that nearly every part makes one group."""
    most = GROUP_BYTES // 4 * 3
    each = min(most, max(1 << 20, sum(held.values()) // tasks))
    first = [0.0]
    for c in range(max(held, default=0) + 1):
        first.append(first[-1] + held.get(c, 0) / min(most, max(each, LANES // 8 * int(2 ** ((c + 1) / 4)))))
    return first, max(1, math.ceil(first[-1]))


def by_length(docs: DataFrame) -> DataFrame:
    """The rows in tasks of texts of like length, sorted by it, as texts in lockstep should end together."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    sized = docs.withColumn("size", size).withColumn("class", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1))) * 4).cast("int"))
    held = {r[0]: r[1] for r in sized.groupBy("class").agg(F.sum("size")).collect()}  # 124 classes at most
    first, n = shares(held, 4 * docs.sparkSession.sparkContext.defaultParallelism)
    begin = F.array(*map(F.lit, first))
    low, high = F.get(begin, F.col("class")), F.get(begin, F.col("class") + 1)
    within = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20)
    part = F.least(F.floor(low + (high - low) * within), F.lit(n - 1)).cast("int")
    return sized.repartitionById(n, part).sortWithinPartitions(F.desc("size")).select("doc_id", "text")


def scores(docs: DataFrame) -> DataFrame:
    """See the module's text."""
    known = docs.sparkSession.sparkContext.broadcast(model(docs))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_length(plain).mapInArrow(_scores(known), "doc_id long, n_bytes long, bits double, bits_per_byte double")
