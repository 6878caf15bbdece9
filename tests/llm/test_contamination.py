"""Operator 3 against brute force, and removal."""

import re

import pytest

from loomgraph.llm import contamination as c
from tests.llm.conftest import sentence

SPLIT = re.compile("[^a-z0-9\u0080-\U0010ffff]+")


def words(text):
    return [w for w in SPLIT.split((text or "").lower()) if w]


def brute(docs, items, n):
    out = set()
    for item, text in set(items):
        ws = words(text)
        size = min(n, len(ws))
        if item is None or text is None or size < c.SHORTEST:
            continue
        grams = {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}
        for d, t in docs:
            if d is None:
                continue
            w = words(t)
            run = None
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in grams:
                    if run and p <= run[1]:
                        run[1] = p + size
                    else:
                        if run:
                            out.add((d, item, run[0], run[1], run[1] - run[0]))
                        run = [p, p + size]
            if run:
                out.add((d, item, run[0], run[1], run[1] - run[0]))
    return out


@pytest.fixture
def data(spark, documents, rng):
    items = [(i, sentence(rng, rng.randrange(5, 30))) for i in range(12)] + [(20, "one two"), (21, None), (None, sentence(rng, 20)), (22, "Écoute  bien, ÇA va; é1 é2 é3 é4 é5")]
    items += [(30, items[0][1]), items[1]]
    docs = [(None, items[3][1]), (1, None), (2, ""), (3, items[4][1].upper().replace(" ", " -- ")), (4, "a, " + items[4][1] + "!\nb"), (5, " ".join(items[5][1].split()[1:-1])), (6, "x écoute bien ça VA é1 é2 é3 é4 é5 y"), (7, items[0][1] + " " + items[0][1] + " z"), (8, sentence(rng, 20000) + " " + items[6][1])]
    docs += [(i, sentence(rng, 80)) for i in range(50, 90)] + [(4, docs[4][1])]
    return docs, items, documents(docs), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [c.MOST_GRAMS, 1])
def test_report(data, most):
    docs, items, df, bench = data
    got = [tuple(r) for r in c.report(df, bench, most_grams=most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items, c.N)
    assert {3, 4, 6, 7, 8} <= {d for d, *_ in got}


def test_cleaned(data):
    docs, items, df, bench = data
    out = c.cleaned(df, bench)
    assert out.columns == df.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert 3 not in rows and None not in rows  # nothing is left of them
    assert rows[4] == "a, !\nb" and rows[7].strip() == "z" and rows[1] is None and rows[2] == ""
    assert all(rows[d] == t for d, t in docs if d is not None and d >= 50)
    assert c.report(out, bench).collect() == []
    whole = {r.doc_id for r in c.cleaned(df, bench, action="document").collect()}
    assert not whole & {3, 4, 6, 7, 8} and {1, 2, 50, 89} <= whole


def test_empty(data, spark):
    _, _, df, bench = data
    assert c.report(df.where("doc_id < 0"), bench).collect() == []
    assert c.report(df, bench.where("item_id < 0")).collect() == []
    assert c.cleaned(df, bench.where("item_id < 0")).count() == df.count()


@pytest.mark.parametrize("action", ["span", "document"])
def test_cleaned_of_a_large_benchmark(data, action):
    _, items, df, bench = data
    rows = lambda most: sorted(map(repr, c.cleaned(df, bench, action=action, most_grams=most).collect()))
    assert rows(1) == rows(c.MOST_GRAMS)
    assert c.cleaned(df, bench.where("item_id < 0"), action=action, most_grams=-1).count() == df.count()


def test_n_grams_are_counted(data):
    _, items, _, bench = data
    want = {}
    for item, text in {(i, t) for i, t in items if i is not None and t is not None}:
        ws = words(text)
        if len(ws) >= c.SHORTEST:
            want[min(c.N, len(ws))] = want.get(min(c.N, len(ws)), 0) + max(1, len(ws) - c.N + 1)
    assert c._sizes(c._plain_items(bench), c.N) == want
