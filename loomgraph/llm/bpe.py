"""Operator 8, BPE encoding and decoding with a pair occurrence index.

Texts are cut into pieces as byte-level BPE does (contractions; letters, digits or other signs with one blank before
them; white space), by character classes of a whole chunk at once (cut()).  Each distinct piece of a group of chunks is
encoded once: Encoder.pieces() maps each pair that the vocabulary can merge to all its positions in the group's pieces,
takes the active ranks in ascending order, merges all positions of a rank (the leftmost of each piece first, as a merge
may make a pair of lower rank active), and adds the pairs that arise to the lists of their ranks.  The ids are those of
the vocabulary's own encoder.  decoded() is the inverse; encode() checks each row with it.

The vocabulary is a file of base64 tokens and ranks, given by path; the driver reads it and broadcasts it (its size is
fixed).  No shuffle.

Defined cases: null and empty texts have no tokens; special tokens in a text are ordinary text; rows with a null doc_id
and repeated rows are encoded like others; an empty table gives no rows; encode() returns doc_id, n_bytes, n_tokens,
tokens, round_trip; encoded() adds columns `tokens`, `n_tokens` to all columns of docs, in place of ones so named in any case.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import textscan
from loomgraph.llm.shared import chunks, give_back, utf8_buffers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text whose pieces are encoded together.
GROUP_BYTES = 20 << 20

#: Columns that encoded() adds.
ADDED = ("tokens", "n_tokens")

BLANK, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point."""
    global _classes
    if _classes is None:
        import regex

        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        at = np.r_[np.arange(0xD800), np.arange(0xE000, 0x110000)]
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT)):
            for m in regex.finditer(pattern, every):
                out[at[m.start() : m.end()]] = kind
        out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
        _classes = out
    return _classes


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the pieces, and the number of pieces before each row."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(off), np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at_byte = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    row = np.searchsorted(at_byte, off)
    kind = classes()[points]
    begin = np.zeros(n + 1, bool)
    begin[row] = True
    begin[1:n] |= kind[1:] != kind[:-1]
    begin[0] = begin[n] = True
    start = np.flatnonzero(begin)
    first, after = start[:-1], start[1:]
    edge = np.zeros(n + 1, bool)
    edge[row] = True
    piece = np.zeros(n + 1, bool)
    blank = kind[first] == BLANK
    piece[first] = True
    # the last of a run of blanks goes by itself or with what follows
    followed = blank & ~edge[after]
    piece[after[followed] - 1] = True
    signs = first[~blank]
    joined = signs[(signs > 0) & ~edge[signs]]
    piece[joined[points[joined - 1] == 32]] = False
    # contractions: an apostrophe alone, where a piece begins, before certain letters
    mark = first[(points[first] == 39) & (after - first == 1) & ~edge[after] & piece[first]]
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        one = points[mark + 1]
        room = np.minimum(mark + 2, n - 1)
        two = np.where((mark + 2 < n) & ~edge[room] & (kind[room] == LETTER), points[room], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 2, size)
        mark, size = mark[size > 0], size[size > 0]
        piece[mark + 1] = False
        rest = mark + 1 + size
        inside = rest < n
        inside[inside] = (kind[rest[inside]] == LETTER) & ~edge[rest[inside]]
        piece[rest[inside]] = True
    where = np.flatnonzero(piece[:n])
    return at_byte[where], np.searchsorted(where, row)


class Encoder:
    def __init__(self, tokens: list[tuple[bytes, int]]):
        self.size = max(r for _, r in tokens) + 1
        ranks = dict(tokens)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in tokens:
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        # open addressing: the slot of a key is the first free one from its hash on
        self.mask = (1 << int(4 * len(keys)).bit_length()) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask
        table = sorted((r, t) for t, r in tokens)
        lengths = np.zeros(self.size + 1, np.int64)
        for r, t in table:
            lengths[r + 1] = len(t)
        self.token_off = np.cumsum(lengths)
        self.token_bytes = np.frombuffer(b"".join(t for _, t in table), np.uint8)

    @classmethod
    def load(cls, path: str) -> "Encoder":
        with open(path, "rb") as f:
            return cls([(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (textscan.mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b merge to, or -1."""
        key = a.astype(np.int64) << 20 | b
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            found = self.keys[slot]
            hit = found == key[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            left, slot = left[go], (slot[go] + 1) & self.mask
        return out

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces data[off[i]:off[i + 1]], one after the other, and their offsets."""
        n = len(data)
        symbol = self.bytes[data].astype(np.int32)
        piece = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[off[1:][np.diff(off) > 0] - 1] = -1
        before[off[:-1][np.diff(off) > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            if len(at) == 1:
                names, parts = rank.tolist(), [at]
            else:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
                names, parts = rank[first].tolist(), np.split(at, first[1:]) if len(first) > 1 else [at]
            for name, part in zip(names, parts):
                have = index.get(name)
                if have is None:
                    index[name] = [part]
                    heapq.heappush(active, name)
                else:
                    have.append(part)

        at = np.flatnonzero(after >= 0).astype(np.int32)
        add(at, self.rank(symbol[at], symbol[at + 1]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            # positions whose pair has changed since are out of date; merged symbols are -1
            at = at[(symbol[at] >= 0) & (after[at] >= 0)]
            at = at[self.rank(symbol[at], symbol[after[at]]) == rank]
            if len(at) > 1:
                lead = np.r_[True, piece[at[1:]] != piece[at[:-1]]]
                if not lead.all():
                    index[rank] = [at[~lead]]
                    heapq.heappush(active, rank)
                    at = at[lead]
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            symbol[at], symbol[gone] = rank, -1
            after[at] = follow
            right = follow >= 0
            before[follow[right]] = at[right]
            lead = before[at]
            left = lead >= 0
            new = np.r_[lead[left], at[right]]
            if len(new):
                add(new, self.rank(symbol[new], symbol[after[new]]))
        kept = np.flatnonzero(symbol >= 0)
        return symbol[kept], np.searchsorted(kept, off)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens, and the offsets of rows in them."""
        size = self.token_off[ids + 1] - self.token_off[ids]
        ends = np.r_[0, np.cumsum(size)]
        flat = np.arange(ends[-1]) + np.repeat(self.token_off[ids] - ends[:-1], size)
        return self.token_bytes[flat], ends[off]

    def texts(self, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and offsets of the rows of each string column in turn; pieces that occur in several are encoded once."""
        parts, begins, base = [], [], 0
        for column in columns:
            data, off = utf8_buffers(column)
            start, piece_off = cut(data, off)
            size = np.diff(np.r_[start, len(data)])
            parts.append((data, textscan.span_hash(data, start, start + size), size.astype(np.int32), piece_off))
            begins.append((start + base).astype(np.int32))
            base += len(data)
        code, names = pd.factorize(np.concatenate([h for _, h, _, _ in parts]))
        code = code.astype(np.int32)
        first = np.empty(len(names), np.int32)
        first[code[::-1]] = np.arange(len(code), dtype=np.int32)[::-1]
        begin, size = np.concatenate(begins)[first], np.concatenate([s for _, _, s, _ in parts])[first]
        del begins
        ends = np.r_[0, np.cumsum(size, dtype=np.int64)]
        data = np.concatenate([d for d, _, _, _ in parts])
        ids, off = self.pieces(data[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)], ends)
        n, at = np.diff(off), 0
        for _, h, _, piece_off in parts:
            which = code[at : at + len(h)]
            at += len(h)
            ends = np.r_[0, np.cumsum(n[which])]
            flat = np.arange(ends[-1]) + np.repeat(off[which] - ends[:-1], n[which])
            yield ids[flat], ends[piece_off]


def grouped(batches: Iterator[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Chunks of about `size` bytes of text together."""
    held, n = [], 0
    for batch in chunks(batches):
        held.append(batch)
        n += int(utf8_buffers(batch.column("text"))[1][-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))


def _encode(encoder, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder.value
        for group in grouped(batches):
            for batch, (ids, off) in zip(group, enc.texts([b.column("text") for b in group])):
                count = pa.array(np.diff(off), pa.int32())
                if whole:
                    names = [n for n in batch.schema.names if n.lower() not in ADDED]
                    yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists(ids, off), count], names=[*names, "tokens", "n_tokens"])
                    continue
                data, row = utf8_buffers(batch.column("text"))
                back, back_off = enc.decode(ids, off)
                same = (np.diff(back_off) == np.diff(row))
                if len(back) == len(data) and same.all():
                    wrong = np.flatnonzero(back != data)
                    same[np.searchsorted(row, wrong, side="right") - 1] = False
                else:
                    same = np.array([back[back_off[i] : back_off[i + 1]].tobytes() == data[row[i] : row[i + 1]].tobytes() for i in range(len(same))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(row), pa.int64()), count, lists(ids, off), pa.array(same)], names=["doc_id", "n_bytes", "n_tokens", "tokens", "round_trip"])
        give_back()

    return run


def _broadcast(docs: DataFrame, vocabulary: str):
    return docs.sparkSession.sparkContext.broadcast(Encoder.load(vocabulary))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, tokens, round_trip (the tokens decode to the text) of each row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_encode(_broadcast(docs, vocabulary), False), "doc_id long, n_bytes long, n_tokens int, tokens array<int>, round_trip boolean")


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with columns tokens and n_tokens."""
    fields = [f for f in docs.schema.fields if f.name.lower() not in ADDED]
    schema = T.StructType([*fields, T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())])
    return docs.mapInArrow(_encode(_broadcast(docs, vocabulary), True), schema)


def _decode(encoder, tokens_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(tokens_at)
            n = np.asarray(pc.list_value_length(tokens).fill_null(0)).astype(np.int64)
            ids = np.asarray(tokens.flatten()).astype(np.int64)
            data, off = encoder.value.decode(ids, np.r_[0, np.cumsum(n)])
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
            yield batch.remove_column(tokens_at).append_column("text", pa.array(texts, pa.string()))

    return run


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with the text of their tokens (null: empty) as column text, in place of tokens and any text."""
    tokens = tokens.drop("text")
    names = [c.lower() for c in tokens.columns]
    fields = [f for f, name in zip(tokens.schema.fields, names) if name != "tokens"]
    schema = T.StructType([*fields, T.StructField("text", T.StringType())])
    return tokens.mapInArrow(_decode(_broadcast(tokens, vocabulary), names.index("tokens")), schema)
