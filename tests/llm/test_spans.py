"""Operators 1 and 9: repeated windows against brute force."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import suffixes, textscan, windows
from tests.llm.conftest import sentence


def brute(rows, length):
    """Rows (doc_id, kind, start, end, n) by comparing words."""
    where = defaultdict(set)
    for d, t in rows:
        ws = [w for w in __import__("re").split("[ \t\n\r\f\v]+", t or "") if w]
        for p in range(len(ws) - length + 1):
            if d is not None:
                where[tuple(ws[p : p + length])].add((d, p))
    marks = defaultdict(set)
    for at in where.values():
        if len(at) > 1:
            first, *later = sorted(at)
            marks[first[0], "first"].add(first[1])
            for d, p in later:
                marks[d, "later"].add(p)
    out = set()
    for (d, kind), ps in marks.items():
        run = None
        for p in sorted(ps):
            if run and p <= run[1]:
                run[1] = p + length
            else:
                if run:
                    out.add((d, kind, run[0], run[1], run[1] - run[0]))
                run = [p, p + length]
        out.add((d, kind, run[0], run[1], run[1] - run[0]))
    return out


def corpus(rng):
    shared = [sentence(rng, 30) for _ in range(4)]
    rows = [(None, shared[0]), (1, None), (2, ""), (3, "one two"), (4, " \n\t "), (5, "same " * 200), (6, shared[1] + " " + shared[1])]
    for i in range(7, 60):
        parts = [sentence(rng, rng.randrange(1, 60))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(2), rng.choice(shared))
        rows.append((i, "\n".join(parts)))
    rows += [(60, rows[20][1]), (61, rows[20][1]), (20, rows[20][1]), (62, sentence(rng, 30000)), (63, "é ü " * 40 + shared[2])]
    return rows


@pytest.mark.parametrize("operator", [windows.repeated_spans, suffixes.repeated_spans])
def test_against_brute_force(documents, rng, operator):
    rows = corpus(rng)
    got = [tuple(r) for r in operator(documents(rows), length=15).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 15)
    assert any(d == 5 for d, *_ in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 2), min_size=3, max_size=9), st.integers(0, 127)), min_size=1, max_size=9), st.integers(1, 9))
def test_copies_over_runs_of_few_rows(tmp_path_factory, segments, rows):
    """The windows of three symbols that occur again, or are marked, with columns read a few rows at a time."""
    size, n = np.array([len(s) for s, _ in segments]), len(segments)
    marks = np.array([m for _, m in segments], np.uint64)
    suffixes.ROWS, had = rows, suffixes.ROWS
    try:
        columns = suffixes.collection_bwt(np.concatenate([np.array(s, np.uint32) for s, _ in segments]), size, str(tmp_path_factory.mktemp("bwt") / "x"))
        got = suffixes.copies(columns, np.arange(n), np.full(n, 10), size, marks, 3)
        columns.close()
    finally:
        suffixes.ROWS = had
    where = defaultdict(list)
    for i, (s, _) in enumerate(segments):
        for o in range(len(s) - 2):
            where[tuple(s[o : o + 3])].append((i, o))
    want = {(i, o + 10, (i, o) != at[0]) for at in where.values() if len(at) > 1 or segments[at[0][0]][1] >> at[0][1] & 1 for i, o in at}
    assert set(zip(*(x.tolist() for x in got))) == want


@pytest.mark.parametrize("operator", [windows.repeated_spans, suffixes.repeated_spans])
def test_adjacent_repeated_rows(documents, rng, operator):
    twice, shared = sentence(rng, 40), sentence(rng, 20)
    rows = [(1, twice), (1, twice), (1, twice), (2, shared + " x"), (2, shared + " x"), (3, "y " + shared)]
    got = [tuple(r) for r in operator(documents(rows, 1), length=15).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 15)
    assert not any(d == 1 for d, *_ in got)


def test_places_of_repeated_rows():
    h, d, p = np.arange(6, dtype=np.uint64), np.array([7, 7, 7, 7, 8, 8]), np.array([3, 7, 3, 7, 1, 70000])
    (batch,) = windows.places(h, d, p, 1)
    back = windows.unplaced(windows.blobs(pa.table([batch.column("packed")], names=["packed"]).column("packed")))
    assert [x.tolist() for x in back] == [h.tolist(), d.tolist(), p.tolist(), [False] * 6]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(0, 3)), max_size=30), st.integers(1, 5))
def test_combined_places(rows, packs):
    """What is combined in packs gives the same as all places at once."""
    want = defaultdict(set)
    for h, d, p in rows:
        want[h].add((d, p))
    want = {(d, p, (d, p) != min(at)) for at in want.values() if len(at) > 1 for d, p in at}
    kept, direct = [], set()
    for i in range(packs):
        h, d, p = (np.array([r[k] for r in rows[i::packs]], t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
        keep, again, later = windows.combined(h, d, p)
        kept.append((h[keep], d[keep], p[keep], again[keep]))
        direct |= {(int(d[x]), int(p[x]), True) for x in later}
    got = set(zip(*(x.tolist() for x in windows.repeated(*map(np.concatenate, zip(*kept))))))
    # a place that is a first copy of one hash and a later one of another has both rows
    assert got | direct == want


@pytest.mark.parametrize("operator", [windows.repeated_spans, suffixes.repeated_spans])
def test_empty_table(documents, operator):
    assert operator(documents([(1, "a")]).where("doc_id < 0")).collect() == []


def test_cut_keeps_columns_and_nulls(documents):
    text = " ".join(f"a{i}" for i in range(20))
    docs = documents([(1, "x " + text + " y"), (2, text + "  z"), (3, text), (None, text), (4, None)])
    out = windows.without_later(docs, windows.repeated_spans(docs, length=10))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, "x " + text + " y"), (2, "  z"), (0, text), (4, None)], key=lambda r: r[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=9), min_size=1, max_size=7))
def test_collection_bwt(tmp_path_factory, segments):
    size = np.array([len(s) for s in segments])
    symbols = np.concatenate([np.array(s, np.uint32) for s in segments])
    suffixes.ROWS, rows = 5, suffixes.ROWS
    try:
        columns = suffixes.collection_bwt(symbols, size, str(tmp_path_factory.mktemp("bwt") / "x"))
        bwt, lcp, tag = (np.concatenate(x) for x in list(zip(*columns.runs("bwt", "lcp", "tag")))[1:])
        columns.close()
    finally:
        suffixes.ROWS = rows
    who, offset = tag >> 16, size[tag >> 16] - (tag & 0xFFFF)
    want = sorted((tuple((1, x) for x in s[o:]) + ((0, i),), i, o) for i, s in enumerate(segments) for o in range(len(s) + 1))
    assert [(i, o) for _, i, o in want] == list(zip(who, offset))
    for r, (suffix, i, o) in enumerate(want):
        assert bwt[r] == (segments[i][o - 1] if o else 0)
        before = want[r - 1][0] if r else ()
        common = next((k for k, (a, b) in enumerate(zip(before, suffix)) if a != b), min(len(before), len(suffix)))
        assert lcp[r] == common


def test_columns_are_never_written_over(tmp_path, monkeypatch):
    """A file that is cut and written again is sent to the disk by some file systems, round for round."""
    folder, opened, most = tmp_path / "bwt", [], []
    begin = suffixes.Columns.begin

    def checked(columns):
        had = set(folder.iterdir())
        most.append(len(had))
        begin(columns)
        opened.extend(set(folder.iterdir()) - had)
        assert set(folder.iterdir()) - had == {folder / columns._path(name, columns.turn + 1).rsplit("/", 1)[1] for name in columns.kinds}

    monkeypatch.setattr(suffixes.Columns, "begin", checked)
    columns = suffixes.collection_bwt(np.array([1, 2, 3, 1, 2, 3, 2], np.uint32), np.array([3, 4]), str(folder))
    assert len(opened) == 5 * len(columns.kinds) and max(most) == len(columns.kinds) == len(list(folder.iterdir()))
    columns.close()
    assert not folder.exists()


@pytest.mark.parametrize("n", [1, 5, 17, 40])
def test_parts_have_tasks_of_their_own(spark, n):
    from pyspark.sql import functions as F

    from loomgraph.llm.shared import parts

    found = parts(np.arange(n), n)
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(found)], "i int, part int").repartition(n, "part")
    assert sorted(r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()) == [1] * n
    assert (parts(np.arange(n) + n, n) == found).all()


def test_words_and_rolling_hash():
    import pyarrow as pa

    from loomgraph.llm.shared import utf8_buffers

    texts = ["a bb  ccc", "", None, "ccc", "\tbb ccc\n"]
    starts, ends, off, h = textscan.scan(*utf8_buffers(pa.array(texts)))
    assert off.tolist() == [0, 3, 3, 3, 4, 6]
    assert h[2] == h[3] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3
    pair = textscan.rolling(h, 2)
    assert pair[1] == pair[4] and pair[0] != pair[1]
