"""Operator 6 against SQL, and the loser tree."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import captures

URLS = ["http://a.com/x", "https://www.A.com/x/?utm_source=1", "http://b.org:80/?q=1&sid=3", "http://b.org/?q=1", None, "", "ftp://u@c.net/z#f", "HTTP://WWW2.a.com/x?utm_medium=y&b=2"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_merged(runs):
    """Batches, opened as they are due, give their entries in order; no more than are needed are open."""
    batches = sorted(sorted((x,) for x in r) for r in runs if r)
    opened = []

    def load(i):
        opened.append(i)
        return batches[i]

    out = [(r, i) for r, a, b in captures.merged((x[0], lambda i=i: load(i)) for i, x in enumerate(batches)) for i in range(a, b)]
    assert [batches[r][i] for r, i in out] == sorted((x,) for r in runs for x in r)
    assert len(out) == len(set(out)) and opened == list(range(len(batches)))


def test_batches_are_opened_late():
    opened = []
    merged = captures.merged(((i,), lambda i=i: opened.append(i) or [(i,), (i,)]) for i in range(5))
    assert next(merged) == (0, 0, 2) and opened == [0]


@pytest.mark.parametrize("ranges", [None, 3, 25])
def test_index(spark, rng, ranges, tmp_path):
    rows = [(i, rng.choice(URLS), rng.choice(["p", "p", "q", None, "long " * 20000])) for i in [*range(120), 5, 6, 7, None]]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, urlkey string, range int").repartition(5)
    out = captures.index(pages, ranges=ranges)
    got = out.collect()
    pages.toPandas().astype({"page_id": "Int64"}).to_parquet(tmp_path / "p.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p.parquet'")
    rel = con.sql(captures.oracle())
    at = [rel.columns.index(c) for c in out.columns]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, (tuple(x[i] for i in at) for x in rel.fetchall())))
    keys = [(r.urlkey, r.ts is not None, r.ts or 0) for r in got]
    assert keys == sorted(keys)
    assert {r.urlkey for r in got} == {"com,a)/x", "org,b)/?q=1", "", "net,c)/z", "com,a)/x?b=2"}


def test_time_column(spark, rng):
    """Null times come first; ties are ordered by page_id, digest and url; columns named like the plan's are no matter."""
    rows = [(i % 7, "http://a.com/x", f"p{i % 3}", rng.choice([None, 1, 2, 3]), i) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at long, RANGE long").repartition(4)
    got = captures.index(pages, time_column="at", ranges=6).collect()
    assert [r.capture_no for r in got] == list(range(1, 61))
    keys = [(r.ts is not None, r.ts or 0, r.page_id, r.digest) for r in got]
    assert keys == sorted(keys)
    for a, b in zip(got, got[1:]):
        assert b.n_prior_same == (a.n_prior_same + 1 if a.digest == b.digest else 0) and b.revisit == (a.digest == b.digest)


def test_empty(spark):
    assert captures.index(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
