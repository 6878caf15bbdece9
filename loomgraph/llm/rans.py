"""Operator 2, token ids as binary: a static range asymmetric numeral system with shared frequency tables.

Texts are encoded to token ids (operator 8's encoder), counted over the whole corpus, and the counts scaled to `1 << PRECISION`
with at least 1 for each id that occurs.  All blocks share that table.  A block has BLOCK tokens (the last of a task
fewer), of whole documents or parts of them, spread over LANES interleaved states: token i goes to state i % LANES.
States have 63 bits and are refilled by 32-bit words, which all lanes of a block write to one stream.  Every CHECKPOINT
tokens of each lane the states and the place in the stream are kept, so that a block can be decoded from there, and each
such span has a CRC-32 of its ids.  Blocks are independent: they decode in parallel.

Plan: one scan encodes and counts; the ids (2 bytes a token) are written once to the shared folder, with counts per task,
which Spark adds up (the table has a row per id, not more with more data); a second scan of the ids codes the blocks of a
group in lockstep.  No shuffle but that of the counts.

blocks(): rows part, block, n_tokens, doc_id[], doc_tokens[], doc_first[] (place of the first token in its document),
n_words, stream, states, checkpoints, crc[]; a row with part -1 has the frequency table as its stream.  decoded() gives
doc_id, first_token, tokens of each part of a document; tokens() puts documents together again.

Defined cases: null and empty texts have no tokens, and stand in a block with 0; a null doc_id stays null; repeated rows
are coded as often as they are there; an empty table gives the row of the (empty) table only; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import VOCABULARY, Encoder, grouped
from loomgraph.llm.shared import doc_ids, give_back, written
from loomgraph.llm.windows import pack, unpack

PRECISION, BLOCK, LANES, CHECKPOINT = 20, 1 << 16, 32, 512
#: Bytes of text that are encoded together: less than operator 8 takes, as workers also code blocks.
GROUP_BYTES = 20 << 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
ROW = "part int, block int, n_tokens int, doc_id array<long>, doc_tokens array<int>, doc_first array<int>, n_words int, stream binary, states binary, checkpoints binary, crc array<long>"
SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("doc_first", pa.list_(pa.int32())), ("n_words", pa.int32()), ("stream", pa.binary()), ("states", pa.binary()), ("checkpoints", pa.binary()), ("crc", pa.list_(pa.int64()))])


def frequencies(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Counts scaled to add up to 1 << precision, at least 1 where there is one."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    whole = 1 << precision
    out = np.maximum(counts * whole // total, counts > 0)
    spare = whole - int(out.sum())
    if spare > 0:
        out[np.argmax(out)] += spare
    while spare < 0:  # the greatest give what the least got too much
        order = np.argsort(-out, kind="stable")
        give = min(-spare, len(order))
        take = order[:give][out[order[:give]] > 1]
        out[take] -= 1
        spare += len(take)
    return out


def code(ids: np.ndarray, freq: np.ndarray, precision: int = PRECISION, lanes: int = LANES, block: int = BLOCK, every: int = CHECKPOINT) -> Iterator[dict]:
    """Codes blocks of `block` ids in lockstep.  Yields for each its stream, states, checkpoints and checksums."""
    n_blocks = -(-len(ids) // block)
    if not n_blocks:
        return
    f, start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    steps = -(-block // lanes)
    padded = np.full(n_blocks * steps * lanes, -1, np.int64)
    for b in range(n_blocks):
        part = ids[b * block : (b + 1) * block]
        padded[b * steps * lanes : b * steps * lanes + len(part)] = part
    grid = padded.reshape(n_blocks, steps, lanes)
    state = np.full((n_blocks, lanes), LOW, np.uint64)
    words, owners, points = [], [], []
    count = np.zeros(n_blocks, np.int64)
    kept_states, kept_counts = [], []
    for t in range(steps - 1, -1, -1):
        sym = grid[:, t, :]
        live = sym >= 0
        safe = np.where(live, sym, 0)
        fs, cs = f[safe], start[safe]
        full = live & (state >= (fs << np.uint64(63 - precision)))
        if full.any():
            b = np.nonzero(full)[0]
            words.append(state[full].astype(np.uint32))
            owners.append(b.astype(np.uint32))
            count += np.bincount(b, minlength=n_blocks)
            state = np.where(full, state >> WORD, state)
        fs1 = np.maximum(fs, np.uint64(1))
        q = state // fs1
        state = np.where(live, (q << np.uint64(precision)) + (state - q * fs1) + cs, state)
        if t % every == 0 and t:
            kept_states.append(state.copy())
            kept_counts.append(count.copy())
            points.append(t)
    owner = np.concatenate(owners) if owners else np.empty(0, np.uint32)
    word = np.concatenate(words) if words else np.empty(0, np.uint32)
    order = np.argsort(owner, kind="stable")
    owner, word = owner[order], word[order]
    cut = np.searchsorted(owner, np.arange(n_blocks + 1))
    for b in range(n_blocks):
        part = ids[b * block : (b + 1) * block]
        n = len(part)
        marks = [i for i, t in enumerate(points) if t * lanes < n]
        crc = [zlib.crc32(part[t * lanes : (t + every) * lanes].astype(np.uint32).tobytes()) for t in range(0, -(-n // lanes), every)]
        yield {
            "n_tokens": n,
            "n_words": int(cut[b + 1] - cut[b]),
            "stream": word[cut[b] : cut[b + 1]].tobytes(),
            "states": state[b].tobytes(),
            "checkpoints": pack(np.array([points[i] for i in marks], np.uint32), np.array([kept_counts[i][b] for i in marks], np.uint32), np.concatenate([kept_states[i][b] for i in marks]) if marks else np.empty(0, np.uint64)),
            "crc": crc,
        }


def uncode(row: dict, freq: np.ndarray, precision: int = PRECISION, lanes: int = LANES, every: int = CHECKPOINT, at: int = 0) -> np.ndarray:
    """The ids of a block, from its checkpoint `at` on (0: its beginning); a wrong checksum is an error."""
    table = Table.of(freq, precision)
    stream = np.frombuffer(row["stream"], np.uint32)
    state, place, step = np.frombuffer(row["states"], np.uint64).copy(), len(stream), 0
    if at:
        points, counts, states = unpack(row["checkpoints"])
        i = int(np.flatnonzero(points == at * every)[0])
        state, place, step = states[i * lanes : (i + 1) * lanes].copy(), int(counts[i]), int(points[i])
    n = row["n_tokens"]
    out = np.empty((-(-n // lanes) - step) * lanes, np.int64)
    mask = np.uint64((1 << precision) - 1)
    for k in range(0, len(out), lanes):
        width = min(lanes, n - step * lanes - k)
        slot = (state[:width] & mask).astype(np.int64)
        sym = table.symbol[slot]
        out[k : k + width] = sym
        state[:width] = table.freq[sym] * (state[:width] >> np.uint64(precision)) + slot.astype(np.uint64) - table.start[sym]
        need = np.flatnonzero(state[:width] < LOW)
        if len(need):
            # the words of a step were written in the order of lanes
            place -= len(need)
            state[need] = state[need] << WORD | stream[place : place + len(need)]
    out = out[: n - step * lanes]
    for i in range(0, len(out), every * lanes):
        if zlib.crc32(out[i : i + every * lanes].astype(np.uint32).tobytes()) != row["crc"][(step * lanes + i) // (every * lanes)]:
            raise ValueError(f"checksum of part {row.get('part')}, block {row.get('block')}, token {step * lanes + i}")
    return out


class Table:
    _made: "tuple[bytes, Table] | None" = None

    def __init__(self, freq: np.ndarray, precision: int):
        self.freq, self.start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq)

    @classmethod
    def of(cls, freq: np.ndarray, precision: int) -> "Table":
        key = freq.tobytes()
        if cls._made is None or cls._made[0] != key:
            cls._made = (key, cls(freq, precision))
        return cls._made[1]


def _tokens(encoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder.value
        kind = np.uint16 if enc.size < 1 << 16 else np.uint32
        counts = np.zeros(enc.size, np.int64)
        for group in grouped(batches, GROUP_BYTES):
            for batch, (ids, off) in zip(group, enc.texts([b.column("text") for b in group])):
                counts += np.bincount(ids, minlength=enc.size)
                raw = ids.astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary()), pa.nulls(batch.num_rows, pa.binary())], names=["doc_id", "ids", "counts"])
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["doc_id", "ids", "counts"])
        give_back()

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            c = np.frombuffer(raw, np.int64)
            total = c.copy() if total is None else total + c
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["id", "n"])


def _blocks(freq, wide: bool, block: int, group: int = 24):
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # doc_id (None: null), first token, ids
        size = 0

        def flush(last: bool):
            nonlocal held, size, number
            n = size if last else size // block * block
            if not n and not (last and held):
                return []
            use, rest, left = [], [], n
            for doc, first, ids in held:
                if left >= len(ids):
                    use.append((doc, first, ids))
                    left -= len(ids)
                else:
                    if left:
                        use.append((doc, first, ids[:left]))
                    rest.append((doc, first + left, ids[left:]))
                    left = 0
            ids = np.concatenate([i for _, _, i in use]).astype(np.int64)
            coded = list(code(ids, freq.value, block=block)) or [{"n_tokens": 0, "n_words": 0, "stream": b"", "states": b"", "checkpoints": b"", "crc": []}]
            owners: list[list[tuple]] = [[] for _ in coded]
            at = 0
            for doc, first, part_ids in use:
                done = 0
                while True:
                    b = min(at // block, len(coded) - 1)
                    take = min(len(part_ids) - done, (b + 1) * block - at) if len(part_ids) else 0
                    owners[b].append((doc, take, first + done))
                    at += take
                    done += take
                    if done >= len(part_ids):
                        break
            out = []
            for row, own in zip(coded, owners):
                out.append(row | {"part": part, "block": number, "doc_id": [o[0] for o in own], "doc_tokens": [o[1] for o in own], "doc_first": [o[2] for o in own]})
                number += 1
            held, size = rest, size - n
            return out

        for batch in batches:
            ids, ok = doc_ids(batch)
            for i, (raw, doc, has) in enumerate(zip(batch.column("ids").to_pylist(), ids.tolist(), ok.tolist())):
                held.append((doc if has else None, 0, np.frombuffer(raw, kind)))
                size += len(held[-1][2])
                if size >= group * block:
                    for row in flush(False):
                        yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)
        for row in flush(True):
            yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)
        give_back()

    return run


def blocks(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """See the module's text."""
    spark = docs.sparkSession
    encoder = Encoder.load(vocabulary)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = written(plain.mapInArrow(_tokens(spark.sparkContext.broadcast(encoder)), "doc_id long, ids binary, counts binary"), "tokens")
    sums = kept.where("counts IS NOT NULL").select("counts").mapInArrow(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(encoder.size, np.int64)
    for row in sums.collect():  # one row an id of the vocabulary
        counts[row.id] = row.n
    freq = frequencies(counts)
    rows = kept.where("ids IS NOT NULL").select("doc_id", "ids").mapInArrow(_blocks(spark.sparkContext.broadcast(freq), encoder.size >= 1 << 16, block), ROW)
    table = spark.createDataFrame([(-1, 0, 0, None, None, None, 0, freq.astype(np.uint32).tobytes(), None, None, None)], ROW)
    return rows.union(table)


def _decoded(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = uncode(row, freq.value) if row["n_tokens"] else np.empty(0, np.int64)
                off = np.r_[0, np.cumsum(row["doc_tokens"])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(row["doc_first"], pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(ids, pa.int32()))], names=["doc_id", "first_token", "tokens"])

    return run


def decoded(coded: DataFrame) -> DataFrame:
    """doc_id, first_token, tokens of each part of a document."""
    raw = coded.where("part = -1").select("stream").first()
    freq = np.frombuffer(bytes(raw.stream), np.uint32).astype(np.int64)
    return coded.where("part >= 0").mapInArrow(_decoded(coded.sparkSession.sparkContext.broadcast(freq)), "doc_id long, first_token int, tokens array<int>")


def tokens(coded: DataFrame) -> DataFrame:
    """doc_id and tokens of each document; ids must be present and differ."""
    parts = decoded(coded).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_token", "tokens"))).alias("p"))
    return parts.select("doc_id", F.flatten(F.col("p.tokens")).alias("tokens"))
