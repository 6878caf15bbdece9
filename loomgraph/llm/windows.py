"""Operator 9, substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted in Spark; repeated
windows merge into maximal intervals.

A word is a maximal run of bytes that are not ASCII white space.  A window is `length` consecutive words of a document.
A window is repeated if the same words occur at another (doc_id, position).  Of the places of a repeated window the
least (doc_id, position) is its first copy; the others are later copies.  The result has a row for each maximal run of
words covered by windows of a kind: kind 'first' (copies that stay) or 'later' (copies to remove).

Plan: one scan hashes all windows with prefix sums.  Each pack of PACK windows is combined before the shuffle: a window
that a pack has several times is known to be repeated, and all its places but the least are later copies whatever the rest
of the corpus holds, so they go straight to their document; only the least place goes to the hash's bucket, with a mark.
So a window that a third of all rows contain comes to its bucket once a pack, not once a row.  One shuffle brings the
equal hashes of a bucket together, where they are counted; places of repeated windows are shuffled again, by document, to
be merged.  The number of buckets and of tasks follows the input: a bucket has about BUCKET_BYTES of text at every size.

Defined cases: a null text is empty; texts of fewer than `length` words have no window; rows with a null doc_id are
left out, as they can't be reported; rows that share a doc_id are one document (the same words at the same position
count once); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import textscan
from loomgraph.llm.shared import MOST_TASKS, blobs, chunks, doc_ids, give_back, grouped, parts, pieces, plan_bytes, prime, unused, utf8_buffers

LENGTH = 50
#: Parquet bytes of text whose windows make a bucket, and windows that a scan task packs at once.
BUCKET_BYTES = 2 << 20
PACK = 1 << 20

INTERVALS = "doc_id long, kind string, start_word int, end_word int, n_words int"
PACKED = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])
PACKED_ROWS = "part int, bucket int, packed binary"


def pack(*arrays: np.ndarray, squeeze: bool = False) -> bytes:
    raw = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes) for a in arrays) + b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw) if squeeze else raw


def unpack(raw: bytes | pa.Buffer, squeezed: bool = False) -> list[np.ndarray]:
    if squeezed:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 10 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, 4 + 10 * i)
        kind = np.dtype(kind.decode())
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket by the high 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed_rows(buckets: list[int] | np.ndarray, rows: list[bytes], n: int, tasks: int = MOST_TASKS) -> pa.Table:
    return pa.table([pa.array(parts(np.asarray(buckets, np.int64), n, tasks)), pa.array(buckets, pa.int32()), pa.array(rows, pa.binary())], schema=PACKED)


def owner(docs: np.ndarray, groups: int) -> np.ndarray:
    """The group of a document, Spark's pmod(doc_id, groups)."""
    return docs % groups


def combined(h: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places with hashes: which are kept (the least of each hash), which of these occur again, and the other places."""
    order = np.argsort(h)
    s = h[order]
    twin = np.zeros(len(s), bool)
    np.equal(s[1:], s[:-1], out=twin[1:])
    twin[:-1] |= twin[1:].copy()
    order = order[twin]
    keep, again = np.ones(len(h), bool), np.zeros(len(h), bool)
    order = order[np.lexsort((p[order], d[order], h[order]))]
    if not len(order):
        return keep, again, order
    hs, ds, ps = h[order], d[order], p[order]
    first, new = np.ones(len(order), bool), np.ones(len(order), bool)
    first[1:] = hs[1:] != hs[:-1]
    new[1:] = first[1:] | (ds[1:] != ds[:-1]) | (ps[1:] != ps[:-1])
    keep[order[~first]] = False
    at = np.flatnonzero(first)
    again[order[at]] = np.add.reduceat(new.astype(np.int64), at) > 1
    return keep, again, order[new & ~first]


def places(hashes: np.ndarray, docs: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, bucket, packed): the least place of each hash, marked where it has others, by bucket of the hash (positions
    within a run of a document ascending); and the others as later copies, by `buckets` plus the document's owner."""
    if not len(hashes):
        return
    keep, again, later = combined(hashes, docs, pos)
    if len(later):
        yield from shifted(by_document(docs[later], pos[later], np.ones(len(later), bool), buckets), buckets).to_batches()
        hashes, docs, pos, again = hashes[keep], docs[keep], pos[keep], again[keep]
    b = bucket_of(hashes, buckets)
    order = np.argsort(b.astype(np.uint16) if buckets <= 1 << 16 else b, kind="stable")
    hashes, docs, pos, b, again = hashes[order], docs[order], pos[order], b[order], again[order]
    cut = np.searchsorted(b, np.arange(buckets + 1))
    for at in range(0, buckets, 1024):
        rows, keys = [], []
        for k in range(at, min(buckets, at + 1024)):
            i, j = cut[k], cut[k + 1]
            if i == j:
                continue
            d, p = docs[i:j], pos[i:j]
            # repeated rows of a document begin at its first positions again: steps don't go back within a run
            new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] <= p[:-1])])
            runs = np.diff(np.r_[new, j - i]).astype(np.uint32)
            step = np.diff(np.r_[0, p])
            step[new] = p[new]
            step = step << 1 | again[i:j]
            step = step.astype(np.uint16 if step.max(initial=0) < 1 << 16 else np.uint64)
            keys.append(k)
            rows.append(pack(hashes[i:j], step, np.frombuffer(pack(d[new], runs, squeeze=True), np.uint8)))
        yield from packed_rows(keys, rows, buckets).to_batches()


def unplaced(packed: list[pa.Buffer]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, documents and positions of the rows of a bucket, and which are marked."""
    hs, ds, ps, marks = [], [], [], []
    for raw in packed:
        h, step, rest = unpack(raw)
        docs, runs = unpack(rest.tobytes(), True)
        marks.append((step & step.dtype.type(1)).astype(bool))
        step = step.astype(np.int64) >> 1
        total = np.cumsum(step)
        first = np.cumsum(runs.astype(np.int64)) - runs
        hs.append(h)
        ds.append(np.repeat(docs, runs))
        ps.append(total - np.repeat(total[first] - step[first], runs))
    return np.concatenate(hs), np.concatenate(ds), np.concatenate(ps), np.concatenate(marks)


def _scan(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in chunks(batches):
            ids, ok = doc_ids(batch)
            data, off = utf8_buffers(batch.column("text"))
            _, _, word_off, words = textscan.scan(data, off)
            at, row = textscan.window_starts(word_off, length)
            if not ok.all():
                keep = ok[row]
                at, row = at[keep], row[keep]
            if len(at):
                held.append((textscan.rolling(words, length)[at], ids[row], at - word_off[row]))
                n += len(at)
            if n >= PACK:
                yield from places(*map(np.concatenate, zip(*held)), buckets)
                held, n = [], 0
        if held:
            yield from places(*map(np.concatenate, zip(*held)), buckets)
        give_back()

    return run


def repeated(h: np.ndarray, d: np.ndarray, p: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, positions and later-copy flags of the hashes that occur at more than one place, or are marked."""
    order = np.argsort(h)
    s = h[order]
    twin = marked[order]
    same = s[1:] == s[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    order = order[twin]
    order = order[np.lexsort((p[order], d[order], h[order]))]
    if not len(order):
        return d[order], p[order], np.empty(0, bool)
    h, d, p, marked = h[order], d[order], p[order], marked[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    new = first.copy()
    new[1:] |= (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    at = np.flatnonzero(first)
    many = (np.add.reduceat(new.astype(np.int64), at) > 1) | np.logical_or.reduceat(marked, at)
    new &= np.repeat(many, np.diff(np.r_[at, len(h)]))
    return d[new], p[new], ~first[new]


def by_document(d: np.ndarray, p: np.ndarray, later: np.ndarray, groups: int) -> pa.Table:
    """Rows (part, bucket, packed) of places, by the owner of the document."""
    g = owner(d, groups)
    order = np.lexsort((p, d, g))
    d, g, code = d[order], g[order], (p[order] << 1) | later[order]
    cut = np.searchsorted(g, np.arange(groups + 1))
    keys = np.flatnonzero(np.diff(cut))
    rows = []
    for k in keys:
        i, j = cut[k], cut[k + 1]
        new = np.flatnonzero(np.r_[True, d[i + 1 : j] != d[i : j - 1]])
        rows.append(pack(d[i:j][new], np.diff(np.r_[new, j - i]).astype(np.uint32), code[i:j].astype(np.uint32), squeeze=True))
    return packed_rows(keys, rows, groups)


def placed(packed: list[pa.Buffer]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and codes (twice the position, plus 1 for later copies) of by_document()'s rows."""
    ds, cs = [], []
    for raw in packed:
        d, runs, code = unpack(raw, True)
        ds.append(np.repeat(d, runs))
        cs.append(code.astype(np.int64))
    return np.concatenate(ds), np.concatenate(cs)


def shifted(table: pa.Table, by: int) -> pa.Table:
    """Rows (part, bucket, packed) with their buckets moved."""
    return table.set_column(1, PACKED.field(1), pa.compute.add(table.column("bucket"), pa.scalar(by, pa.int32())).cast(pa.int32()))


def _count(groups: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= groups:  # later copies on their way to their documents
            return shifted(table, -groups)
        out = by_document(*repeated(*unplaced(blobs(table.column("packed")))), groups)
        give_back()
        return out

    return run


def merged(d: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals covered by windows at places sorted by document and position."""
    if not len(d):
        return d, p, p
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + length)
    at = np.flatnonzero(new)
    return d[at], p[at], p[np.r_[at[1:], len(d)] - 1] + length


def intervals(d: np.ndarray, p: np.ndarray, later: np.ndarray, length: int) -> pa.Table:
    order = np.lexsort((p, d))
    d, p, later = d[order], p[order], later[order].astype(bool)
    out = []
    for kind, pick in (("first", ~later), ("later", later)):
        doc, a, b = merged(d[pick], p[pick], length)
        out.append(pa.table({"doc_id": pa.array(doc, pa.int64()), "kind": pa.array([kind] * len(doc), pa.string()), "start_word": pa.array(a, pa.int32()), "end_word": pa.array(b, pa.int32()), "n_words": pa.array(b - a, pa.int32())}))
    return pa.concat_tables(out)


def _merge(length: int):
    def run(table: pa.Table) -> pa.Table:
        d, c = placed(blobs(table.column("packed")))
        order = np.lexsort((c, d))
        d, c = d[order], c[order]
        # a place that is a first copy in one bucket and a later one in another is a later one
        last = np.ones(len(d), bool)
        last[:-1] = (d[1:] != d[:-1]) | (c[1:] >> 1 != c[:-1] >> 1)
        return intervals(d[last], c[last] >> 1, c[last] & 1, length)

    return run


def spans_of(places_by_document: DataFrame, length: int, n: int) -> DataFrame:
    return grouped(places_by_document, n).applyInArrow(_merge(length), INTERVALS)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """See the module's text.  Returns doc_id, kind, start_word, end_word (exclusive), n_words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = prime(pieces(plan_bytes(docs), BUCKET_BYTES, 16))
    packed = docs.mapInArrow(_scan(length, n), PACKED_ROWS)
    counted = grouped(packed, n).applyInArrow(_count(n), PACKED_ROWS)
    return spans_of(counted, length, n)


def oracle(length: int = LENGTH) -> str:
    """The same rows in DuckDB's SQL."""
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
v AS (SELECT doc_id, unnest(range(0, len(ws) - {length} + 1)) AS p, ws FROM w WHERE len(ws) >= {length}),
h AS (SELECT DISTINCT doc_id, p, md5(array_to_string(ws[p + 1 : p + {length}], ' ')) AS m FROM v),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY m) AS n, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS k FROM h),
s AS (SELECT doc_id, p, CASE WHEN k = 1 THEN 'first' ELSE 'later' END AS kind FROM r WHERE n > 1),
g AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id, kind ORDER BY p) + {length} THEN 1 ELSE 0 END AS cut FROM s),
i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, kind ORDER BY p) AS run FROM g)
SELECT doc_id, kind, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + {length} AS INTEGER) AS end_word, CAST(max(p) + {length} - min(p) AS INTEGER) AS n_words
FROM i GROUP BY doc_id, kind, run"""


_WORD = re.compile(r"[^ \t\n\r\f\v]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        i, j = words[a][0], words[b - 1][1]
        if j > at:
            out.append(text[at : max(at, i)])
            at = j
    return "".join(out) + text[at:]


def _cut(text_at: int, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(spans)
            batch = batch.select([n for n in batch.schema.names if n != spans])
            rows = np.flatnonzero(np.asarray(cuts.is_valid()))
            if len(rows):
                texts = batch.column(text_at).to_pylist()
                for r in rows.tolist():
                    if texts[r] is not None:
                        texts[r] = cut_words(texts[r], [(s["start_word"], s["end_word"]) for s in cuts[r].as_py()])
                batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))
            yield batch

    return run


def without_later(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs, all columns, without the words of the 'later' spans; documents that lose all their words go.

    Rows with a null doc_id and documents that had no word stay as they are.
    """
    mark, key, cut_mark = unused(docs, "spans", "spans_doc", "spans_cut")
    later = spans.where("kind = 'later'").groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(mark))
    joined = docs.join(later, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], mark, F.col(mark).isNotNull().alias(cut_mark))
    schema = T.StructType([*docs.schema.fields, T.StructField(cut_mark, T.BooleanType())])
    cut = joined.mapInArrow(_cut(docs.columns.index("text"), mark), schema)
    return cut.where(~F.col(cut_mark) | F.col("text").rlike("[^ \\t\\n\\r\\f\\x0B]")).drop(cut_mark)
