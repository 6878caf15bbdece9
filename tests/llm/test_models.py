"""Operators 7 and 10: against plain versions and held-out labels."""

import math
import re

import numpy as np
import pyarrow as pa

from loomgraph.llm import mixing, textscan, toxicity
from loomgraph.llm.shared import utf8_buffers
from tests.llm.conftest import sentence


def plain_bits(data, known):
    """One decision after the other."""
    hashes, two = mixing.contexts(data, np.array([0, len(data)]))
    pair = mixing.pairs(data, np.array([0, len(data)]))
    slots = [known.slots.of(pair >> 8, h) for h in hashes]
    trees, total = known.trees, 0.0
    for begin in range(0, len(data), mixing.SEGMENT):
        w = np.tile(np.array(mixing.START, np.float32), (mixing.GATES, 1))
        a = (1 / (1 + np.exp(-(np.arange(mixing.STEPS_OF_MAP) - 16) / 2))).astype(np.float32)
        counters = np.zeros(1 << mixing.OWN_BITS, np.float32)
        for i in range(begin, min(len(data), begin + mixing.SEGMENT)):
            letter = 0 if i == 0 or mixing.GAP[data[i - 1]] else 1
            for j in range(trees.first[pair[i]], trees.first[pair[i]] + trees.size[pair[i]]):
                own = (int(two[i]) ^ int(trees.node[j]) * 0x9E3779B1) >> 16 & (1 << mixing.OWN_BITS) - 1
                x = np.array([t[s[i], trees.node[j]] for t, s in zip(known.tables, slots)] + [0, 0], np.float32) / np.float32(16)
                x[3] = counters[own]
                gate, bit = trees.depth[j] + 3 * letter, int(trees.bit[j])
                dot = np.clip(np.einsum("ij,ij->i", x[None], w[gate][None]), np.float32(-8), np.float32(8))
                p = (np.float32(1) / (np.float32(1) + np.exp(-dot)))[0]
                k = int((dot * np.float32(2) + np.float32(16.5))[0])
                final = (p + a[k]) * np.float32(0.5)
                total -= math.log2(abs((1 - bit) - final))
                counters[own] += (np.float32(bit) - p) * np.float32(mixing.OWN_RATE)
                w[gate] += x * ((np.float32(bit) - p) * np.float32(mixing.RATE))
                a[k] += (np.float32(bit) - a[k]) * np.float32(mixing.REFINE)
    return total


def test_tables_grow_with_the_corpus():
    sizes = [mixing.PREDICTORS << mixing.table_bits(n) for n in (0, 1 << 20, 1 << 28, 1 << 29, 1 << 31, 1 << 50)]
    assert sizes == sorted(sizes) and sizes[0] == sizes[2] < sizes[3] < sizes[4] == sizes[5]
    assert 256 * sizes[-1] <= 128 << 20


def test_scores(documents, rng):
    rows = [(i, sentence(rng, 60, 50)) for i in range(40)] + [(90, None), (91, ""), (None, "null id"), (92, sentence(rng, 3000, 50)), (93, "é中🙂" * 20), (94, "".join(chr(rng.randrange(33, 127)) for _ in range(400))), (1, "again")]
    docs = documents(rows)
    out = mixing.scores(docs).collect()
    assert len(out) == len(rows)
    known = mixing.model(docs)
    by = {r.doc_id: r for r in out if r.doc_id != 1}
    texts = dict(rows)
    for d in (0, 92, 93, 94, None):
        data = np.frombuffer(texts[d].encode(), np.uint8)
        want = plain_bits(data, known)
        assert abs(by[d].bits - want) < 1e-3 + 1e-4 * want and by[d].n_bytes == len(data)
    assert by[90].bits == by[91].bits == 0 and by[90].bits_per_byte is None
    other = mixing.model(docs.where("doc_id is null or doc_id <> 94"))
    noise = np.frombuffer(texts[94].encode(), np.uint8)
    assert mixing.score(noise, np.array([0, 400]), other)[0] / 400 > 2 * by[0].bits_per_byte
    total = sum(len(t) for _, t in rows if t)
    order0 = np.bincount(np.frombuffer("".join(t for _, t in rows if t).encode(), np.uint8), minlength=256)
    p = order0[order0 > 0] / order0.sum()
    assert sum(r.bits for r in out) / total < -(p * np.log2(p)).sum()
    assert mixing.scores(docs.where("doc_id < 0")).collect() == []


def test_adaptation_goes_on_to_the_end_of_a_text(documents, rng, monkeypatch):
    texts = [sentence(rng, n, 50) for n in (1, 3, 1500, 700, 40, 1500, 0, 200)] + ["x" * 1023, "y" * 1024, "z" * 1025]
    known = mixing.model(documents(list(enumerate(texts))))
    with monkeypatch.context() as m:
        m.setattr(mixing, "SEGMENT", 1 << 40)
        want = [plain_bits(np.frombuffer(t.encode(), np.uint8), known) for t in texts]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    got = mixing.score(data, off, known)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)
    # what a text's first part taught the weights helps its later ones: the parts cost more when each begins anew
    each = mixing.score(data[: 3 << 10], np.arange(0, (3 << 10) + 1, 1 << 10), known).sum()
    assert mixing.score(data[: 3 << 10], np.array([0, 3 << 10]), known)[0] < each
    # one decision after the other, with the same result
    monkeypatch.setattr(mixing, "LONG", 1024)
    assert np.allclose(mixing.score(data, off, known), got, rtol=1e-5, atol=1e-3)


def test_tasks_have_texts_of_like_length(documents, rng, monkeypatch):
    rows = [(i, "a" * rng.choice([1, 30, 500, 9000])) for i in range(300)] + [(None, None), (7, "again"), (7, "again")]
    found = mixing.by_length(documents(rows).select("doc_id", "text"))
    assert sorted((r.doc_id or -1, r.text or "") for r in found.collect()) == sorted((d or -1, t or "") for d, t in rows)
    first, n = mixing.shares({0: 10, 40: 30 << 30, 56: 1 << 30}, 8)
    assert first == sorted(first) and n == -(-(31 << 30) // (mixing.GROUP_BYTES // 4 * 3))
    # few bytes, but long texts in one task, as they are scored in lockstep
    assert mixing.shares({68: 8 << 20, 40: 8 << 20}, 1000)[1] == 9
    assert mixing.shares({}, 8)[1] == 1


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        parts = [sentence(rng, rng.randrange(4, 12), 600) + rng.choice(".!?\n") for _ in range(rng.randrange(2, 12))]
        if bad:
            for _ in range(2):
                k = rng.randrange(len(parts))
                parts[k] = "You " + rng.choice(["vile", "rotten", "nasty", "Vile"]) + " " + parts[k]
        rows.append((i, " ".join(parts)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(rng):
    rows, labels = labelled(rng, 1500)
    texts, y = pa.array([t for _, t in rows]), np.array([b for _, _, b in labels])
    model = toxicity.train(texts[:900], y[:900])
    p, of, doc, *_ = toxicity.score(texts[900:], model)
    best = np.zeros(600)
    np.maximum.at(best, of, p)
    assert ((best >= 0.5) == (y[900:] == 1)).mean() > 0.98
    assert (doc >= best - 1e-9).all()


def test_offending_sentences(documents, spark, rng):
    rows, labels = labelled(rng, 600)
    rows += [(900, None), (901, ""), (None, "You vile thing. Fine."), (902, "ÉÀ fine words here! You rotten one\nmore"), (903, "W1 w2. " * 3000 + "you nasty x."), (902, "ÉÀ fine words here! You rotten one\nmore")]
    labels += [(None, 1, 1), (5, 1, None), (99999, 0, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(rows)
    out = toxicity.offending(docs, known).collect()
    texts = {d: t for d, t in rows}
    for r in out:
        assert texts[r.doc_id][r.start_char : r.end_char] == r.sentence and r.score >= 0.5 and r.doc_score >= r.score - 1e-6
    assert sorted(r.sentence for r in out if r.doc_id == 902) == ["You rotten one"] * 2
    assert [r.sentence_no for r in out if r.doc_id == 903] == [3000 * 1]
    assert [r.sentence for r in out if r.doc_id is None] == ["You vile thing"]
    bad = {d for d, _, b in labels if b == 1 and d in texts and d is not None}
    assert {r.doc_id for r in out} - {None, 902, 903} == bad
    assert toxicity.offending(docs.where("doc_id < 0"), known).collect() == []
    assert toxicity.offending(docs, known.where("toxic = 0")).collect() == []
    assert toxicity.offending(docs, known.where("doc_id < 0")).collect() == []


def brute_offending(rows, model, threshold):
    """One sentence after the other, with Python's strings."""
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    out = []
    for d, t in rows:
        found = []
        for part in re.finditer(r"[^.!?\n\r]+", "".join(c.lower()[0] for c in t or "")):  # one character for each
            words = list(re.finditer(r"[a-z0-9\u0080-\U0010ffff]+", part.group()))
            if words:
                hashes = {int(textscan.span_hash(np.frombuffer(w.group().encode(), np.uint8), np.array([0]), np.array([len(w.group().encode())]))[0]) for w in words}
                known = hashes & weight.keys()
                z = model.bias + sum(weight[h] for h in known)
                found.append((part.start() + words[0].start(), part.start() + words[-1].end(), 1 / (1 + math.exp(-z)) if known else 0.0))
        doc = 1 - math.prod(1 - p for *_, p in found)
        hits = [i for i, (*_, p) in enumerate(found) if p >= threshold]
        if not hits and doc >= threshold:
            hits = [max(range(len(found)), key=lambda i: found[i][2])]
        out += [(d, i, found[i][0], found[i][1], t[found[i][0] : found[i][1]], round(found[i][2], 5), round(doc, 5)) for i in hits]
    return out


def test_offending_against_brute_force(documents, spark, rng):
    rows, labels = labelled(rng, 300)
    rows += [(900, None), (901, ""), (902, "ÉÀ İ words here! You rotten one\nmore. İİ nasty"), (903, "fine. " * 5000), (904, "é? ñ vile\r\nx")]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(rows)
    model = toxicity.fit(docs, known)
    # milder words: documents that reach the threshold by several sentences only
    model.weights, model.bias = np.full(len(model.weights), 0.8), -2.0
    from loomgraph.llm.toxicity import _offending

    shared = spark.sparkContext.broadcast(model)
    got = docs.select("doc_id", "text").mapInArrow(_offending(shared, 0.5), "doc_id long, sentence_no int, start_char int, end_char int, sentence string, score double, doc_score double").collect()
    want = brute_offending(rows, model, 0.5)
    assert sorted((*r[:5], round(r.score, 5), round(r.doc_score, 5)) for r in got) == sorted(want)
    assert any(p < 0.5 <= d for *_, p, d in want) and any(r[0] == 902 for r in want)
