"""Operator 10, toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence is a run of text without '.', '!', '?' and line breaks that has a word (letters and digits, lower case).  Its
score is p = sigmoid(bias + sum of the weights of its distinct words), and 0 if no word of it has a weight, so that a long
text isn't toxic by its length; a document's is the noisy-or 1 - product(1 - p).  Weights are trained on labels of documents only, by minimising the log loss of the noisy-or with
Adagrad on a sample of SAMPLE labelled documents (those of least hash of doc_id, a documented bound; one Python worker
holds it).  Words in fewer than RARE sampled documents, or no likelier in toxic ones, have no weight.  Then every sentence of every document is scored.

offending(): a row for each sentence with p >= `threshold`, and where a document's score reaches `threshold` without such
a sentence, for its sentence of highest p (the first of equals): doc_id, sentence_no (from 0, of those with words),
start_char, end_char, sentence, score, doc_score.

Plan: the sample is one small join and one task; the model (weights of some hundred words) is broadcast; scoring is a scan without
shuffle.

Defined cases: null texts are empty, a document without words has score 0 and no row; a null doc_id is returned as null;
labels that are null or of absent documents are left out, of repeated labels of a document the greatest counts; without
toxic or without clean labels nothing can be learned and no sentence is offending; repeated rows give repeated rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import textscan
from loomgraph.llm.fingerprints import GAP
from loomgraph.llm.shared import chunks, give_back, utf8_buffers
from loomgraph.llm.windows import pack, unpack

SAMPLE, RARE, EPOCHS = 12000, 6, 100
#: Step of Adagrad, and the weight of the sum of absolute weights, in documents.
RATE, LASSO, START = 0.5, 0.1, 2.0
THRESHOLD = 0.5
#: Bytes that end a sentence.
STOP = np.zeros(256, bool)
STOP[[10, 13, 33, 46, 63]] = True


def sentences(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Hash and sentence of each word; for each row the sentences before it; for each sentence its start and end (from
    the first to the last word) in the bytes of the lower-case texts; and the offsets of the rows in these."""
    data, off = utf8_buffers(pc.utf8_lower(texts.fill_null("")))
    starts, ends, word_off, h = textscan.scan(data, off, GAP)
    if not len(starts):
        z = np.empty(0, np.int64)
        return h, z, np.zeros(len(off), np.int64), z, z, off
    part = np.cumsum(STOP[data])[starts]
    row = np.repeat(np.arange(len(texts)), np.diff(word_off))
    new = np.ones(len(starts), bool)
    new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    return h, np.cumsum(new) - 1, np.searchsorted(first, word_off), starts[first], ends[last], off


class Model:
    """Words, by sorted hash, that have a weight; and the bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias
        self.bits = np.zeros(1 << 20, bool)
        self.bits[words >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that have a weight, and which they are."""
        at = np.flatnonzero(self.bits[h >> np.uint64(44)])
        which = np.searchsorted(self.words, h[at])
        ok = which < len(self.words)
        ok[ok] = self.words[which[ok]] == h[at[ok]]
        return at[ok], which[ok]

    def scores(self, h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Of each of n sentences; a word that a sentence repeats counts once."""
        at, which = self.find(h)
        code = np.unique(of[at] << 32 | which)
        z = self.bias + np.bincount(code >> 32, weights=self.weights[code & 0xFFFFFFFF], minlength=n)
        p = np.zeros(n)
        some = np.unique(code >> 32)
        p[some] = 1 / (1 + np.exp(-np.clip(z[some], -700, 30)))
        return p


def train(texts: pa.Array, toxic: np.ndarray, rare: int = RARE, epochs: int = EPOCHS) -> Model:
    positive = toxic == 1
    if not positive.any() or positive.all():
        return Model(np.empty(0, np.uint64), np.empty(0), -1e9)
    parts, counts, n, n_sent = [], [], len(texts), 0
    for batch in chunks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        h, of, sent_off = sentences(batch.column("text"))[:3]
        parts.append((h, of + n_sent))
        counts.append(np.diff(sent_off))
        n_sent += int(sent_off[-1])
    h, of = map(np.concatenate, zip(*parts))
    rows = np.repeat(np.arange(n), np.concatenate(counts))
    names, index = np.unique(h, return_inverse=True)
    seen = np.unique(rows[of] * len(names) + index)
    n_all = np.bincount(seen % len(names), minlength=len(names))
    n_toxic = np.bincount(seen[positive[seen // len(names)]] % len(names), minlength=len(names))
    # the start: log odds of a word's documents, less START; words that aren't likelier in toxic documents have none
    odds = np.log((n_toxic + 0.5) / (positive.sum() + 1)) - np.log((n_all - n_toxic + 0.5) / ((~positive).sum() + 1))
    known = (n_all >= rare) & (odds > START / 2)
    w = np.maximum(odds[known] - START, 0)
    b = np.log(0.05 / max(1.0, n_sent / n))
    renamed = np.cumsum(known) - 1
    pick = known[index]
    code = np.unique(of[pick] << 32 | renamed[index[pick]])
    of, slots = code >> 32, code & 0xFFFFFFFF
    # sentences without a known word have score 0 whatever is learned
    some, of = np.unique(of, return_inverse=True)
    rows, n_some = rows[some], len(some)
    gw, gb = np.full(len(w), 1e-8), 1e-6
    for _ in range(epochs):
        z = b + np.bincount(of, weights=w[slots], minlength=n_some)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(rows, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
        doc = -np.expm1(none)
        grade = np.where(positive[rows], -(np.exp(none[rows]) / np.maximum(doc[rows], 1e-9)) * p, p)
        step = np.bincount(slots, weights=grade[of], minlength=len(w)) / n
        bias = grade.sum() / n
        gw += step**2
        gb += bias**2
        w -= RATE * step / np.sqrt(gw)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * LASSO / n / np.sqrt(gw), 0)
        b -= 0.1 * bias / np.sqrt(gb)
    kept = w != 0
    return Model(names[known][kept], w[kept], float(b))


def score(texts: pa.Array, model: Model) -> tuple[np.ndarray, ...]:
    """Score of each sentence and its row; of each document; starts and ends of sentences, sentences before each row,
    offsets of rows."""
    h, of, sent_off, start, end, off = sentences(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(sent_off))
    p = model.scores(h, of, len(rows))
    doc = -np.expm1(np.bincount(rows, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts)))
    return p, rows, doc, start, end, sent_off, off


def _train(epochs: int, rare: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("doc_id")
        w = train(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()), np.asarray(table.column("toxic")), rare, epochs)
        return pa.table({"model": pa.array([pack(w.words, w.weights, np.array([w.bias]))], pa.binary())})

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, rare: int = RARE) -> Model:
    """Weights trained on the sampled labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    made = rows.groupBy().applyInArrow(_train(epochs, rare), "model binary").collect()
    if not made:
        return Model(np.empty(0, np.uint64), np.empty(0), -1e9)
    words, weights, bias = unpack(bytes(made[0].model))
    return Model(words, weights, float(bias[0]))


def chosen(p: np.ndarray, rows: np.ndarray, doc: np.ndarray, threshold: float) -> np.ndarray:
    """The sentences that are reported."""
    hit = p >= threshold
    bare = (doc >= threshold) & ~np.isin(np.arange(len(doc)), rows[hit])
    if bare.any():
        order = np.lexsort((-p, rows))
        first = order[np.r_[True, rows[order][1:] != rows[order][:-1]]]
        hit[first[bare[rows[first]]]] = True
    return np.flatnonzero(hit)


def characters(data: np.ndarray, off: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters of a row before bytes `at`, for all rows in one pass."""
    before = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)]
    return before[at] - before[off[rows]]


def _offending(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text").fill_null("")
            p, rows, doc, start, end, sent_off, off = score(texts, model.value)
            hit = chosen(p, rows, doc, threshold)
            of = rows[hit]
            # lower case may change the bytes of a text, not its characters
            low, _ = utf8_buffers(pc.utf8_lower(texts))
            a, b = (characters(low, off, of, x[hit]) for x in (start, end))
            data, at = utf8_buffers(texts)
            point = np.flatnonzero((data & 0xC0) != 0x80)
            head = np.searchsorted(point, at)[of]
            ends = np.r_[point, len(data)]
            found = [data[i:j].tobytes().decode() for i, j in zip(ends[head + a], ends[head + b])]
            cols = [batch.column("doc_id").take(pa.array(of)), pa.array(hit - sent_off[of], pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(found, pa.string()), pa.array(np.round(p[hit], 6)), pa.array(np.round(doc[of], 6))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "sentence_no", "start_char", "end_char", "sentence", "score", "doc_score"])
        give_back()

    return run


def offending(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """See the module's text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_offending(model, threshold), "doc_id long, sentence_no int, start_char int, end_char int, sentence string, score double, doc_score double")
