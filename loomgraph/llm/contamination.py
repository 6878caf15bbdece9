"""Operator 3, benchmark decontamination: a broadcast hash set of normalised benchmark n-grams; every window of training
words is looked up, hits are verified word by word, and spans or documents are removed.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, in lower case.  A window of `n` words of a
document is a hit if the same words occur in a benchmark item.  Items of fewer than `n` words, but SHORTEST at least, are
looked for whole; shorter ones say too little and are left out.  Hits of an item that overlap or adjoin make a span.
report(): a row for each span: doc_id, item_id, start_word, end_word (exclusive), n_words.
cleaned(): the documents without those spans (action 'span': the characters from the first to the last word of each
span are cut; documents of which only white space is left go), or without the documents that have one (action 'document').

Plan: no shuffle of texts or windows (report() makes its spans distinct, which shuffles these).  The benchmark's n-grams are counted; while they number at most `most_grams`, hashes, items and texts
are collected and broadcast (some 24 bytes an n-gram).  The scan hashes windows with prefix sums and looks them up in a
sorted array behind a bit table.  The words of a hit are then compared with the item's.  Beyond that, report() and
cleaned() scan with the bit table alone and join the windows it lets through with the n-grams by their words.

Defined cases: null texts are empty; rows with a null doc_id have no row in the report, and are cleaned like others;
items with a null id or text are left out; items that share n-grams each have their own row; repeated rows of an item
count once, repeated rows of a document give the same span once; an empty benchmark or documents table gives no rows;
other columns are kept by cleaned() whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import textscan
from loomgraph.llm.fingerprints import GAP
from loomgraph.llm.shared import chunks, doc_ids, utf8_buffers

N, SHORTEST = 8, 5
MOST_GRAMS = 2 << 20
SPANS = "doc_id long, item_id long, start_word int, end_word int"


class Words:
    """The words of texts: lower-case bytes, starts and ends in them, words before each row, and the hash of each word."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = utf8_buffers(pc.utf8_lower(texts.fill_null("")))
        self.starts, self.ends, self.word_off, self.h = textscan.scan(self.data, self.off, GAP)

    def gram(self, at: int, size: int) -> bytes:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + size))

    def sizes(self, n: int) -> np.ndarray:
        """Words of the n-grams of each row as an item: 0 where it is too short."""
        size = np.minimum(n, np.diff(self.word_off))
        return np.where(size < SHORTEST, 0, size)

    def grams(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The n-grams of all rows as items, for each size: hashes, first words and rows."""
        of = self.sizes(n)
        for size in np.unique(of[of > 0]).tolist():
            at, row = textscan.window_starts(self.word_off, size)
            at, row = at[of[row] == size], row[of[row] == size]
            yield size, textscan.rolling(self.h, size)[at], at, row

    def candidates(self, size: int, bits: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, rows and hashes of the windows that the bit table of the high `n_bits` bits lets through."""
        window = textscan.rolling(self.h, size)
        high = (window >> np.uint64(64 - n_bits)).astype(np.int64)
        at = np.flatnonzero(bits[high >> 3] >> (7 - (high & 7)).astype(np.uint8) & 1)
        row = np.searchsorted(self.word_off, at, side="right") - 1
        inside = at + size <= self.word_off[row + 1]
        return at[inside], row[inside], window[at[inside]]


class Grams:
    """The n-grams of the benchmark: for each length the sorted hashes, with item and first word of each entry."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        items = sorted(set(items))
        ids = np.array([i for i, _ in items], np.int64)
        self.words = Words(pa.array([t for _, t in items], pa.string()))
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, code, at, row in self.words.grams(n):
            order = np.argsort(code, kind="stable")
            code = code[order]
            bits = np.zeros(1 << 24, bool)
            bits[code >> np.uint64(40)] = True
            self.sizes[size] = (code, ids[row[order]], at[order], np.packbits(bits))

    def hits(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, start_word, end_word) of each span."""
        words = Words(texts)
        found: list[tuple[int, int, int, int]] = []
        for size, (code, item, first, bits) in self.sizes.items():
            at, row, window = words.candidates(size, bits, 24)
            k = np.searchsorted(code, window)
            ok = code[np.minimum(k, len(code) - 1)] == window
            for a, r, i in zip(at[ok].tolist(), row[ok].tolist(), k[ok].tolist()):
                gram, same = words.gram(a, size), code[i]
                p = a - int(words.word_off[r])
                while i < len(code) and code[i] == same:
                    if self.words.gram(int(first[i]), size) == gram:
                        found.append((r, int(item[i]), p, p + size))
                    i += 1
        return _joined(found)


def _joined(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping and adjoining spans of a row and item become one."""
    out: list[tuple[int, int, int, int]] = []
    for r, item, a, b in sorted(set(found)):
        if out and out[-1][:2] == (r, item) and a <= out[-1][3]:
            out[-1] = (r, item, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((r, item, a, b))
    return out


def _plain_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()


def _gram_counts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, np.int64)
        for batch in chunks(batches):
            for size, code, _, _ in Words(batch.column("text")).grams(n):
                total[size] += len(code)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1), pa.int32()), pa.array(total)], names=["size", "n"])

    return run


def _sizes(items: DataFrame, n: int) -> dict[int, int]:
    """The number of the benchmark's n-grams of each size."""
    counted = items.mapInArrow(_gram_counts(n), "size int, n long").groupBy("size").agg(F.sum("n").alias("n")).where("n > 0")
    return {r["size"]: r["n"] for r in counted.collect()}  # n - SHORTEST + 1 rows at most


def _report(grams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, ok = doc_ids(batch)
            spans = [s for s in grams.value.hits(batch.column("text")) if ok[s[0]]]
            row, item, a, b = (np.array(c, np.int64) for c in zip(*spans)) if spans else (np.empty(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(item, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "item_id", "start_word", "end_word"])

    return run


GRAM = "size int, code long, gram binary"


def _gram_rows(name: str, kind: pa.DataType, ids: pa.Array, more: list[np.ndarray], size: int, code: np.ndarray, grams: list[bytes]) -> pa.RecordBatch:
    arrays = [ids.cast(kind), pa.array(np.full(len(code), size, np.int32)), pa.array(code.view(np.int64)), pa.array(grams, pa.binary()), *[pa.array(x, pa.int32()) for x in more]]
    return pa.RecordBatch.from_arrays(arrays, names=[name, "size", "code", "gram", "p"][: len(arrays)])


def _item_grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=1 << 20):
            words = Words(batch.column("text"))
            for size, code, at, row in words.grams(n):
                yield _gram_rows("item_id", pa.int64(), batch.column("item_id").take(pa.array(row)), [], size, code, [words.gram(a, size) for a in at.tolist()])

    return run


def _candidates(kind: pa.DataType, sizes: list[int], bits, n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=1 << 20):
            words = Words(batch.column("text"))
            for size in sizes:
                at, row, code = words.candidates(size, bits.value, n_bits)
                if len(at):
                    yield _gram_rows("key", kind, batch.column("key").take(pa.array(row)), [at - words.word_off[row]], size, code, [words.gram(a, size) for a in at.tolist()])

    return run


def _part_of_bits(n_bits: int, n_parts: int):
    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros((1 << n_bits) >> n_parts, bool)
        code = table.column("code").to_numpy().view(np.uint64) >> np.uint64(64 - n_bits)
        bits[code & np.uint64(len(bits) - 1)] = True
        return pa.table({"part": table.column("part").slice(0, 1).combine_chunks(), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return run


def _joined_spans(docs: DataFrame, key: str, items: DataFrame, sizes: dict[int, int], n: int) -> DataFrame:
    """key, item_id, start_word, end_word by a join: for benchmarks too large to broadcast.

    docs has key and text.  Only the windows that a bit table of the benchmark's hashes lets through are shuffled, and
    joined by their words; the table grows with the benchmark to 128 MB, beyond which it lets more through.
    """
    spark = docs.sparkSession
    if not sizes:
        return spark.createDataFrame([], f"key {key}, item_id long, start_word int, end_word int")
    n_bits, n_parts = min(30, max(20, (32 * sum(sizes.values())).bit_length())), 10
    grams = items.mapInArrow(_item_grams(n), f"item_id long, {GRAM}").distinct()
    bits = np.zeros((1 << n_bits) // 8, np.uint8)
    each = len(bits) >> n_parts
    made = grams.select("code", F.shiftrightunsigned("code", 64 - n_parts).cast("int").alias("part")).groupBy("part").applyInArrow(_part_of_bits(n_bits, n_parts), "part int, bits binary")
    for r in made.toLocalIterator():
        bits[r.part * each : (r.part + 1) * each] = np.frombuffer(bytes(r.bits), np.uint8)
    kind = pa.string() if key == "string" else pa.int64()
    windows = docs.mapInArrow(_candidates(kind, sorted(sizes), spark.sparkContext.broadcast(bits), n_bits), f"key {key}, {GRAM}, p int")
    hits = windows.join(grams, ["size", "code", "gram"]).select("key", "item_id", "p", (F.col("p") + F.col("size")).alias("e")).distinct()
    by = Window.partitionBy("key", "item_id").orderBy("p", "e")
    hits = hits.withColumn("cut", (F.col("p") > F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    hits = hits.withColumn("run", F.sum(F.coalesce("cut", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return hits.groupBy("key", "item_id", "run").agg(F.min("p").alias("start_word"), F.max("e").alias("end_word")).drop("run")


def _collected(items: DataFrame, n: int) -> Grams:
    return Grams([(r.item_id, r.text) for r in items.toLocalIterator()], n)


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, most_grams: int = MOST_GRAMS) -> DataFrame:
    """See the module's text.  Returns doc_id, item_id, start_word, end_word, n_words."""
    items = _plain_items(benchmark)
    sizes = _sizes(items, n)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if sum(sizes.values()) > most_grams:
        spans = _joined_spans(plain.withColumnRenamed("doc_id", "key").dropna(), "long", items, sizes, n).withColumnRenamed("key", "doc_id")
    else:
        grams = docs.sparkSession.sparkContext.broadcast(_collected(items, n))
        spans = plain.mapInArrow(_report(grams), SPANS)
    return spans.distinct().withColumn("n_words", F.col("end_word") - F.col("start_word"))


def _cleaned(grams, action: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            spans = grams.value.hits(batch.column("text"))
            if not spans:
                yield batch
                continue
            rows = sorted({s[0] for s in spans})
            if action == "document":
                keep = np.ones(batch.num_rows, bool)
                keep[rows] = False
                yield batch.filter(pa.array(keep))
                continue
            texts = batch.column("text").to_pylist()
            of: dict[int, list[tuple[int, int]]] = {}
            for r, _, a, b in spans:
                of.setdefault(r, []).append((a, b))
            for r, cuts in of.items():
                texts[r] = cut_spans(texts[r], cuts)
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            left = np.ones(batch.num_rows, bool)
            left[[r for r in rows if not texts[r].strip()]] = False
            yield batch.filter(pa.array(left))

    return run


_ANY_WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    words = list(_ANY_WORD.finditer(text))
    out, at = [], 0
    for a, b in sorted(spans):
        i, j = words[a].start(), words[b - 1].end()
        if j <= at:
            continue
        out.append(text[at : max(at, i)])
        at = j
    return "".join(out) + text[at:]


def _cut(text_at: int, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(mark)
            batch = batch.select([c for c in batch.schema.names if c != mark])
            rows = np.flatnonzero(np.asarray(cuts.is_valid())).tolist()
            if rows:
                texts = batch.column(text_at).to_pylist()
                for r in rows:
                    texts[r] = cut_spans(texts[r], [(s["start_word"], s["end_word"]) for s in cuts[r].as_py()])
                batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))
                left = np.ones(batch.num_rows, bool)
                left[[r for r in rows if not texts[r].strip()]] = False
                batch = batch.filter(pa.array(left))
            yield batch

    return run


def _cleaned_by_join(docs: DataFrame, items: DataFrame, sizes: dict[int, int], n: int, action: str) -> DataFrame:
    """Spans depend on the text only, so rows find theirs by its SHA-256, whatever their doc_id."""
    mark = "spans"
    while any(c.lower() in (mark, f"{mark}_key") for c in docs.columns):
        mark += "_"
    key = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    spans = _joined_spans(docs.select(key.alias("key"), F.col("text").cast("string").alias("text")).dropna(), "string", items, sizes, n)
    cuts = spans.groupBy(F.col("key").alias(f"{mark}_key")).agg(F.collect_list(F.struct("start_word", "end_word")).alias(mark))
    same = key == F.col(f"{mark}_key")
    if action == "document":
        return docs.join(cuts.select(f"{mark}_key"), same, "left_anti")
    joined = docs.join(cuts, same, "left").drop(f"{mark}_key")
    return joined.mapInArrow(_cut(docs.columns.index("text"), mark), docs.schema)


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = N, action: str = "span", most_grams: int = MOST_GRAMS) -> DataFrame:
    """The documents with contaminated spans cut, or without contaminated documents; their columns stay as they are."""
    items = _plain_items(benchmark)
    sizes = _sizes(items, n)
    if sum(sizes.values()) > most_grams:
        return _cleaned_by_join(docs, items, sizes, n, action)
    grams = docs.sparkSession.sparkContext.broadcast(_collected(items, n))
    return docs.mapInArrow(_cleaned(grams, action), docs.schema)


def oracle(n: int = N) -> str:
    """report()'s rows in DuckDB's SQL."""
    split = "list_filter(string_split_regex(lower(text), '[^a-z0-9\\x{80}-\\x{10ffff}]+'), lambda x: x <> '')"
    return f"""
WITH b AS (SELECT DISTINCT item_id, {split} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bs AS (SELECT item_id, ws, least({n}, len(ws)) AS size FROM b WHERE len(ws) >= {SHORTEST}),
bp AS (SELECT item_id, ws, size, unnest(range(0, len(ws) - size + 1)) AS p FROM bs),
bg AS (SELECT DISTINCT item_id, size, array_to_string(ws[p + 1 : p + size], ' ') AS gram FROM bp),
d AS (SELECT DISTINCT doc_id, {split} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
ds AS (SELECT doc_id, ws, size FROM d, (SELECT DISTINCT size FROM bg) WHERE len(ws) >= size),
dp AS (SELECT doc_id, ws, size, unnest(range(0, len(ws) - size + 1)) AS p FROM ds),
h AS (SELECT DISTINCT doc_id, item_id, p, p + dp.size AS e FROM dp JOIN bg ON dp.size = bg.size AND array_to_string(dp.ws[p + 1 : p + dp.size], ' ') = gram),
g AS (SELECT *, CASE WHEN p > max(e) OVER (PARTITION BY doc_id, item_id ORDER BY p, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS cut FROM h),
i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, item_id ORDER BY p, e ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT doc_id, item_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(e) AS INTEGER) AS end_word, CAST(max(e) - min(p) AS INTEGER) AS n_words FROM i GROUP BY doc_id, item_id, run"""
