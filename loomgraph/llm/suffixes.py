"""Operator 1, suffix-array dedup: the collection's Burrows-Wheeler transform and common prefixes, built column by
column, give every window of `length` words that occurs more than once.

The result is that of operator 9 (see windows.py for words, windows, kinds and the defined cases); the way is another:

1. Anchors.  In each window the least hashed `K`-gram (the leftmost of equals) is its anchor, so copies of a window have
   the same anchor at the same offset.  Anchors that occur at one place only can't belong to a repeated window; the
   others are found with one count over all anchors (about 1 in 20 words).
2. Segments.  Adjoining windows with one anchor make a segment, at most 2 * length - K words long.  Segments go to
   blocks by their anchor's hash: all copies of a window meet in one block.  Windows that a task has several times are
   combined before: the least place goes on, with a mark, and the others are later copies without more ado.
3. Construction (collection_bwt).  In each block, round j inserts the symbol before the last j - 1 symbols of every
   segment: the rank of a symbol up to the row of the suffix it extends is the row of the new suffix; the common prefix
   with its neighbours is one more than the least over the rows between the rests.  Segments are short, so there are at
   most 2 * length - K rounds whatever the length of the documents.  BWT, LCP, sort keys and places of the suffixes are
   files in the shared folder (any that pyarrow can open), which a round reads and writes from front to back in runs of
   ROWS; what it holds in memory is a few numbers a segment, and 8 bytes a symbol.
4. Rows whose common prefix is `length` at least are copies of a window; as in operator 9 they merge into intervals.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import textscan
from loomgraph.llm.shared import MOST_TASKS, blobs, chunks, doc_ids, give_back, grouped, parts, pieces, plan_bytes, prime, shared_dir, utf8_buffers
from loomgraph.llm.windows import LENGTH, PACKED, PACKED_ROWS, bucket_of, by_document, combined, pack, packed_rows, placed, places, repeated, shifted, spans_of, unpack, unplaced

#: Words of an anchor, and Parquet bytes of text whose segments make a block.
K = 12
BLOCK_BYTES = 2 << 20
#: Rows of the columns that are read or written at once.
ROWS = 1 << 17

_POS = np.uint64((1 << 28) - 1)
HEAD, REST = np.uint64(32), np.uint64(0xFFFFFFFF)


def anchors(words: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's first word for each window, and the hash of every k-gram."""
    grams = textscan.rolling(words, k)
    key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    span, width, least = length - k + 1, 1, key
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (np.minimum(least[at], least[at + span - width]) & _POS).astype(np.int64), textscan.mix(grams)


def _scan(length: int, k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in chunks(batches):
            ids, ok = doc_ids(batch)
            data, off = utf8_buffers(batch.column("text"))
            _, _, word_off, words = textscan.scan(data, off)
            at, row = textscan.window_starts(word_off, length)
            if not len(at):
                continue
            anchor, grams = anchors(words, at, length, k)
            new = np.ones(len(at), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            new &= ok[row]
            anchor, row = anchor[new], row[new]
            held.append((grams[anchor], ids[row], anchor - word_off[row]))
            n += len(anchor)
            if n >= 1 << 20:
                yield from places(*map(np.concatenate, zip(*held)), buckets)
                held, n = [], 0
        if held:
            yield from places(*map(np.concatenate, zip(*held)), buckets)
        give_back()

    return run


def _repeated_anchors(groups: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= groups:
            return shifted(table, -groups)
        out = by_document(*repeated(*unplaced(blobs(table.column("packed")))), groups)
        give_back()
        return out

    return run


def _hits(docs: pa.Table, found: pa.Table, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each chunk of texts: hashes, documents and positions of the windows whose anchor is repeated, their first
    words, their anchors' first words and hashes, and the symbols of all words."""
    d, code = placed(blobs(found.column("packed")))
    known, d = np.unique(d, return_inverse=True)
    wanted = np.unique(d.astype(np.int64) << 32 | code >> 1)
    for batch in chunks(iter(docs.to_batches())):
        ids, _ = doc_ids(batch)
        data, off = utf8_buffers(batch.column("text"))
        _, _, word_off, words = textscan.scan(data, off)
        at, row = textscan.window_starts(word_off, length)
        if not len(at):
            continue
        number = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        there = known[number] == ids
        anchor, grams = anchors(words, at, length, k)
        code = number[row] << 32 | (anchor - word_off[row])
        hit = wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
        hit &= there[row]
        at, row, anchor = at[hit], row[hit], anchor[hit]
        if len(at):
            yield textscan.rolling(words, length)[at], ids[row], at - word_off[row], at, anchor, grams[anchor], np.maximum((words >> np.uint64(32)).astype(np.uint32), 1)


def _segments(length: int, k: int, blocks: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows or not found.num_rows:
            return PACKED.empty_table()
        parts, base = [], 0
        for h, d, p, at, anchor, gram, words in _hits(docs, found, length, k):
            parts.append((h, d, p, at + base, anchor + base, gram, words))
            base += len(words)
        if not parts:
            return PACKED.empty_table()
        h, d, p, at, anchor, gram, words = map(np.concatenate, zip(*parts))
        del parts
        keep, again, later = combined(h, d, p)
        out = shifted(by_document(d[later], p[later], np.ones(len(later), bool), blocks), blocks)
        d, p, at, anchor, gram, again = d[keep], p[keep], at[keep], anchor[keep], gram[keep], again[keep]
        # a segment has 64 windows at most, so that its marks fit a word
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        run_no = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= run_no % 64 == 0
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, len(at)])
        marks = np.bitwise_or.reduceat(again.astype(np.uint64) << (run_no % 64).astype(np.uint64), first)
        begin, size, doc, pos = at[first], n + length - 1, d[first], p[first]
        block = bucket_of(gram[first], blocks)
        order = np.argsort(block, kind="stable")
        begin, size, doc, pos, block, marks = begin[order], size[order], doc[order], pos[order], block[order], marks[order]
        cut = np.searchsorted(block, np.arange(blocks + 1))
        keys, values = np.flatnonzero(np.diff(cut)), []
        for b in keys:
            i, j = cut[b], cut[b + 1]
            s = size[i:j]
            flat = np.arange(s.sum()) + np.repeat(begin[i:j] - np.cumsum(s) + s, s)
            values.append(pack(doc[i:j], pos[i:j].astype(np.uint32), s.astype(np.uint16), marks[i:j], words[flat]))
        give_back()
        return pa.concat_tables([out, packed_rows(keys, values, blocks)])

    return run


class Columns:
    """Columns of equal length as files in `folder` (of any file system that pyarrow knows, by URI or path): each turn
    reads the last one's from front to back, and writes new ones; then the last one's are deleted.  No file is written
    over: some file systems (ext4) send one that was cut to nothing and written again to the disk when it is closed, and
    a block would wait for all that its rounds write."""

    def __init__(self, folder: str, **kinds: np.dtype):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder)
        self.kinds = {name: np.dtype(kind) for name, kind in kinds.items()}
        self.turn, self.n, self.growing = 0, 0, 0

    def _path(self, name: str, turn: int) -> str:
        return f"{self.folder}/{name}{turn}"

    def begin(self) -> None:
        self.out = {name: self.fs.open_output_stream(self._path(name, self.turn + 1)) for name in self.kinds}
        self.growing = 0

    def append(self, **values: np.ndarray) -> None:
        for name, x in values.items():
            self.out[name].write(np.ascontiguousarray(x, self.kinds[name]).data.cast("B"))
        self.growing += len(x)

    def end(self) -> None:
        for f in self.out.values():
            f.close()
        if self.turn:
            for name in self.kinds:
                self.fs.delete_file(self._path(name, self.turn))
        self.turn, self.n = self.turn + 1, self.growing

    def runs(self, *names: str) -> Iterator[tuple]:
        """First row, and the columns, of each run of ROWS."""
        files = [self.fs.open_input_stream(self._path(name, self.turn)) for name in names]
        for at in range(0, self.n, ROWS):
            n = min(ROWS, self.n - at)
            out = []
            for name, f in zip(names, files):
                raw = f.read_buffer(n * self.kinds[name].itemsize)
                out.append(np.frombuffer(raw, self.kinds[name]))
            yield at, *out
        for f in files:
            f.close()

    def close(self) -> None:
        self.fs.delete_dir(self.folder)


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low .. high] (low <= high), by a table of the minima of runs of 2**i values."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    run = values
    for i in range(int(level.max(initial=-1)) + 1):
        if i:
            run = np.minimum(run[: -(1 << (i - 1))], run[1 << (i - 1) :])
        pick = np.flatnonzero(level == i)
        if len(pick):
            out[pick] = np.minimum(run[low[pick]], run[high[pick] - (1 << i) + 1])
    return out


def least_in_runs(runs: Iterator[tuple[int, np.ndarray]], n: int, low: np.ndarray, high: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The least of a column's rows low .. high, in one pass over its runs of ROWS."""
    top = np.iinfo(kind).max
    out = np.full(len(low), top, kind)
    a, b = low // ROWS, high // ROWS
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    n_runs = -(-n // ROWS)
    cut_a, cut_b = np.searchsorted(a[by_a], np.arange(n_runs + 1)), np.searchsorted(b[by_b], np.arange(n_runs + 1))
    whole = np.full(n_runs, top, kind)
    for r, (at, x) in enumerate(runs):
        whole[r] = x.min()
        pick = by_a[cut_a[r] : cut_a[r + 1]]
        if len(pick):
            out[pick] = least_between(x, low[pick] - at, np.minimum(high[pick] - at, len(x) - 1))
        pick = by_b[cut_b[r] : cut_b[r + 1]]
        pick = pick[a[pick] < r]
        if len(pick):
            out[pick] = np.minimum(out[pick], np.minimum.accumulate(x)[high[pick] - at])
    far = np.flatnonzero(b > a + 1)
    if len(far):
        out[far] = np.minimum(out[far], least_between(whole, a[far] + 1, b[far] - 1))
    return out


def collection_bwt(symbols: np.ndarray, size: np.ndarray, folder: str) -> Columns:
    """BWT, LCP and tags of a collection of segments (symbols from 1; none is empty), as columns in `folder`.

    Rows are the suffixes in order, first the empty ones by segment; the ends of segments differ.  A row's suffix starts
    with the symbol `head` and goes on with the suffix of row `rest`.  Rows are sorted by (head, rest): the place of a
    new row among them is the count of lesser symbols plus the rank of its symbol in the BWT up to the row it extends.
    A tag is the suffix's segment, times 1 << 16, plus its length.
    """
    m, ends, longest = len(size), np.cumsum(size), int(size.max(initial=0))
    kind = np.dtype(np.uint8 if longest < 255 else np.uint16)
    columns = Columns(folder, key=np.uint64, bwt=np.uint32, lcp=kind, tag=np.uint64 if m >= 1 << 16 else np.uint32)
    # Round 0: the empty suffixes, each preceded by its segment's last symbol.  A key is head << 32 | rest.
    columns.begin()
    for at in range(0, m, ROWS):
        seg = np.arange(at, min(m, at + ROWS))
        columns.append(key=seg, bwt=symbols[ends[seg] - 1], lcp=np.zeros(len(seg)), tag=seg << 16)
    columns.end()
    active, row = np.arange(m), np.arange(m)
    for j in range(1, longest + 1):
        live = size[active] >= j
        active, row = active[live], row[live]
        n = columns.n
        new = symbols[ends[active] - j].astype(np.uint64) << HEAD | row.astype(np.uint64)
        order = np.argsort(new)
        new, active, row = new[order], active[order], row[order]
        # first pass: where the new rows go, and the old rows' keys before and after these places
        into, before, nxt = np.full(len(new), n), np.empty(len(new), np.uint64), np.zeros(len(new), np.uint64)
        done, last = 0, np.uint64(0)
        for at, key in columns.runs("key"):
            to = int(np.searchsorted(new, key[-1]))
            pos = np.searchsorted(key, new[done:to])
            into[done:to], nxt[done:to] = pos + at, key[pos]
            before[done:to] = np.where(pos > 0, key[np.maximum(pos, 1) - 1], last)
            done, last = to, key[-1]
        before[done:] = last
        # the row before a new one: the new one before it, where both go to the same place, or an old one
        same = np.flatnonzero(into[1:] == into[:-1]) + 1
        before[same] = new[same - 1]
        alike = np.flatnonzero(before >> HEAD == new >> HEAD)
        # and the old row after the last of the new ones that go before it
        tail = into < n
        tail[:-1] &= into[1:] != into[:-1]
        after = np.flatnonzero(tail)
        alike2 = np.flatnonzero(nxt[after] >> HEAD == new[after] >> HEAD)
        # second pass: the least common prefixes between the rests
        low = np.r_[(before[alike] & REST).astype(np.int64), row[after[alike2]]] + 1
        high = np.r_[row[alike], (nxt[after[alike2]] & REST).astype(np.int64)]
        common = 1 + least_in_runs(columns.runs("lcp"), n, low, high, kind)
        here, value = np.zeros(len(new), kind), np.zeros(len(after), kind)
        here[alike], value[alike2] = common[: len(alike)], common[len(alike) :]
        changed = into[after]
        # third pass: merge the new rows in
        shift = np.cumsum(np.bincount(into, minlength=n + 1)[:n], dtype=np.uint32)
        rest = row + shift[row]
        key_in = (new & ~REST) + rest.astype(np.uint64)
        bwt_in = np.where(size[active] > j, symbols[ends[active] - j - 1], 0).astype(np.uint32)
        tag_in = active << 16 | j
        columns.begin()
        done = put = 0
        for at, key, bwt, lcp, tag in columns.runs("key", "bwt", "lcp", "tag"):
            end = at + len(key)
            to = len(new) if end == n else int(np.searchsorted(into, end))
            upto = int(np.searchsorted(changed, end))
            lcp = lcp.copy()
            lcp[changed[put:upto] - at] = value[put:upto]
            key = key + shift[(key & REST).astype(np.int64)]
            old = np.ones(len(key) + to - done, bool)
            old[into[done:to] - at + np.arange(to - done)] = False
            fresh = ~old
            out = {}
            for name, had, got in (("key", key, key_in), ("bwt", bwt, bwt_in), ("lcp", lcp, here), ("tag", tag, tag_in)):
                x = np.empty(len(old), had.dtype)
                x[old], x[fresh] = had, got[done:to]
                out[name] = x
            columns.append(**out)
            done, put = to, upto
        columns.end()
        row = into + np.arange(len(new))
    return columns


def copies(columns: Columns, doc: np.ndarray, begin: np.ndarray, size: np.ndarray, marks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, positions and later-copy flags of the windows that occur again: adjoining rows whose common prefix is
    `length` at least, and marked ones."""
    parts, group, held = [], 0, None
    for _, lcp, tag in columns.runs("lcp", "tag"):
        if held is not None:
            lcp, tag = np.r_[held[0], lcp], np.r_[held[1], tag]
        # the last row waits for the next one, which tells whether it has a copy
        lone = lcp < length
        number = group + np.cumsum(lone if held is None else np.r_[False, lone[1:]])
        seg, left = (tag >> 16).astype(np.int64), (tag & 0xFFFF).astype(np.int64)
        offset = size[seg] - left
        window = left >= length
        marked = window & (marks[seg] >> np.where(window, offset, 0).astype(np.uint64) & np.uint64(1)).astype(bool)
        again = ~lone
        again[:-1] |= ~lone[1:]
        again = window & (again | marked)
        pick = np.flatnonzero(again[:-1])
        parts.append((number[pick].astype(np.uint64), doc[seg[pick]], begin[seg[pick]] + offset[pick], marked[pick]))
        held, group = (lcp[-1:], tag[-1:]), int(number[-1])
        rest = [x[-1:] for x in (number.astype(np.uint64), doc[seg], begin[seg] + offset, marked, again)]
    if held is not None and rest[4][0]:
        parts.append(tuple(rest[:4]))
    return repeated(*map(np.concatenate, zip(*parts)))


def _blocks(length: int, groups: int, shared: str):
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= groups:
            return shifted(table, -groups)
        doc, begin, size, marks, symbols = map(np.concatenate, zip(*(unpack(raw) for raw in blobs(table.column("packed")))))
        begin, size = begin.astype(np.int64), size.astype(np.int64)
        columns = collection_bwt(symbols, size, f"{shared}/loomgraph-bwt-{uuid.uuid4().hex}")
        try:
            out = by_document(*copies(columns, doc, begin, size, marks, length), groups)
        finally:
            columns.close()
        del symbols
        give_back()
        return out

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """See the module's text.  Returns doc_id, kind, start_word, end_word (exclusive), n_words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = prime(pieces(plan_bytes(docs), BLOCK_BYTES, 16))
    found = grouped(docs.mapInArrow(_scan(length, k, n), PACKED_ROWS), n).applyInArrow(_repeated_anchors(n), PACKED_ROWS)
    tasks = min(n, MOST_TASKS)
    owners = docs.sparkSession.createDataFrame(list(enumerate(parts(np.arange(tasks), tasks).tolist())), "task int, part int")  # one row a task
    owned = docs.where("doc_id IS NOT NULL").withColumn("task", F.expr(f"cast(pmod(doc_id, {n}) % {tasks} as int)")).join(F.broadcast(owners), "task").drop("task")
    segments = owned.repartition(tasks, "part").groupBy("part").cogroup(found.repartition(tasks, "part").groupBy("part")).applyInArrow(_segments(length, k, n), PACKED_ROWS)
    blocks = grouped(segments, n).applyInArrow(_blocks(length, n, shared_dir(docs.sparkSession)), PACKED_ROWS)
    return spans_of(blocks, length, n)
