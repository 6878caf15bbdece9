"""Operator 4 against the same estimate in numpy."""

import numpy as np
import pyarrow as pa

from loomgraph.llm import quality as q
from tests.llm.conftest import sentence


def median(v):
    return np.sort(v)[(len(v) + 1) // 2 - 1]


def brute(rows, least):
    """Squared distances, by row."""
    raw = q.counted(pa.array([r[1] or "" for r in rows])).astype(float)
    n, words, *classes, length, distinct = raw.T
    ok = words > 0
    mid = [c.sum() / n.sum() for c in classes]
    shares = [np.arcsin(np.sqrt((c + q.PRIOR[i] * m) / (n + q.PRIOR[i]))) for i, (c, m) in enumerate(zip(classes, mid))]
    mean_length = np.log((length + q.PRIOR[3] * length.sum() / words.sum()) / (words + q.PRIOR[3]))
    x = np.column_stack([*shares, mean_length, 10 * np.log((distinct + q.PRIOR[4]) / (words + q.PRIOR[4])) / np.log(words + q.PRIOR[4])])
    key = [(r[2], r[3]) for r in rows]

    def distances(v, mean, inv):
        return np.maximum(np.einsum("ij,jk,ik->i", v - mean, inv, v - mean), 0)

    def step(v, mean, inv):
        b = np.floor(np.log(distances(v, mean, inv) + 1e-9) * 50)
        s = v[b <= np.sort(b)[int(np.ceil(len(v) * q.H)) - 1]]
        cov = q.consistency(q.H) * (s.T @ s / len(s) - np.outer(s.mean(axis=0), s.mean(axis=0))) + np.diag(q.FLOOR)
        return s.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def fit(pick):
        v = x[pick & ok]
        middle = np.array([median(c) for c in v.T])
        starts = [(middle, np.diag(1 / ((1.4826 * np.array([median(c) for c in np.abs(v - middle).T])) ** 2 + q.FLOOR)))]
        for k in range(1, q.STARTS):
            lot = q.lots(v, k).view(np.int64)
            s = v[np.sort(np.unique(lot, return_index=True)[1])]
            s = s[np.argsort(q.lots(s, k).view(np.int64))][: 3 * q.D]
            starts.append((s.mean(axis=0), np.linalg.inv(np.cov(s.T, bias=True) + np.diag(q.FLOOR))))
        ends = []
        for at in starts:
            for _ in range(2):
                at = step(v, *at[:2])
            ends.append(at)
        at = min(ends, key=lambda e: e[2])
        while (new := step(v, *at[:2]))[2] < at[2] - q.GAIN:
            at = new
        return at[0], at[1] * q.chi_quantile(0.5, q.D) / median(distances(v, *at[:2]))

    out = np.full(len(rows), np.nan)
    for k in set(key):
        pick = np.array([a == k for a in key])
        lang = np.array([a[0] == k[0] for a in key])
        use = pick if (pick & ok).sum() >= least else lang if (lang & ok).sum() >= least else np.ones(len(rows), bool)
        out[pick & ok] = distances(x, *fit(use))[pick & ok]
    return out


def corpus(rng):
    rows = []
    for i in range(400):
        t = " ".join(rng.choice(["The", "house", "of", "many", "rivers,", "ran", "over.", "quick", f"w{rng.randrange(999)}"]) for _ in range(rng.randrange(30, 200)))
        rows.append((i, t, rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b"])))
    for i in range(400, 440):
        rows.append((i, " ".join(f"{rng.choice('#$%&')}{rng.choice('#$%&')}w{rng.randrange(99)}###" for _ in range(80)), "en", "a"))
    for i in range(440, 460):
        rows.append((i, "same words " * 150, "de", "a"))
    return rows + [(500, None, "en", "a"), (501, "", "de", "b"), (502, "word", "en", "a"), (None, rows[0][1], "en", "a"), (1, rows[1][1], rows[1][2], rows[1][3]), (503, sentence(rng, 15000), None, None), (504, "x y z", None, "a")]


def test_against_numpy(documents, rng):
    rows = corpus(rng)
    got = q.scores(documents(rows), least=40).collect()
    assert len(got) == len(rows)
    want = brute(rows, 40)
    by = {}
    for r, w in zip(rows, want):
        by.setdefault((r[0], r[2], r[3]), []).append(w)
    for g in got:
        w = by[g.doc_id, g.lang, g.source][0]
        if np.isnan(w):
            assert g.distance is None and not g.keep
        else:
            assert abs(g.distance - w) <= 1e-3 * max(1, w)
    kept = {g.doc_id: g.keep for g in got}
    assert not any(kept[i] for i in range(400, 460))
    assert sum(not kept[i] for i in range(400)) <= 4 and kept[502]
    assert not kept[500] and not kept[501]


def test_kept_keeps_columns(documents, rng):
    docs = documents(corpus(rng)).withColumnRenamed("packed", "raw_bytes").selectExpr("*", "1 AS MU", "2 AS key_lang", "3 AS as_text", "4 AS Distance")
    out = q.kept(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in q.scores(docs).collect() if r.keep}


def test_empty(documents):
    assert q.scores(documents([(1, "a b")]).where("doc_id < 0")).collect() == []
    assert q.scores(documents([(1, None), (2, "")])).where("keep").collect() == []


def test_consistency():
    x = np.random.default_rng(1).normal(size=(200000, q.D))
    d = (x * x).sum(axis=1)
    inner = x[d <= np.quantile(d, 0.75)]
    assert abs(q.consistency(0.75) * inner.var() - 1) < 0.01


def test_chi_square():
    x = np.random.default_rng(2).chisquare(q.D, 10**6)
    assert abs((x < q.chi_quantile(0.9, q.D)).mean() - 0.9) < 0.002
    assert abs(1 - q.chi_square(q.CUTOFF, q.D) - q.TAIL) < 1e-13


def test_starts_lead_away_from_a_poor_one(spark):
    """With half of the rows in a tight crowd far away, the least determinant is found from one of the starts."""
    r = np.random.default_rng(3)
    x = np.r_[r.normal(size=(600, q.D)), r.normal(size=(100, q.D)) * 0.05 + 30]
    vectors = spark.createDataFrame([("=a", "=b", *map(float, v)) for v in x], "key_lang string, key_source string, " + ", ".join(f"{n} double" for n in q.X))
    (e,) = q.estimates(vectors).collect()
    inv = np.zeros((q.D, q.D))
    inv[np.triu_indices(q.D)] = e.inv
    inv += np.triu(inv, 1).T
    d = np.einsum("ij,jk,ik->i", x - e.mu, inv, x - e.mu)
    assert np.abs(e.mu).max() < 0.5 and d[600:].min() > 500 and d[:600].max() < q.CUTOFF
