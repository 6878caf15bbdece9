"""Operator 5 against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import fingerprints as fp
from tests.llm.conftest import sentence


def test_golay_anchors():
    golay = fp.Golay.get()
    words = np.random.default_rng(1).integers(0, 1 << 23, 200).astype(np.uint32)
    own, home = golay.anchors(words, 3)
    assert (own == np.arange(200)).all()  # one anchor within the radius
    code = np.flatnonzero(golay.syndrome == 0).astype(np.uint32)
    assert len(code) == 4096
    for reach in (5, 6):
        which, anchor = golay.anchors(words, reach)
        for i in range(20):
            want = set((code[np.bitwise_count(code ^ words[i]) <= reach] >> 11).tolist())
            assert set(anchor[which == i].tolist()) == want


def near_copy(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_groups_against_brute_force(documents, rng):
    base = [sentence(rng, rng.randrange(60, 200)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, near_copy(rng, base[i % 20], 0.03)) for i in range(40)]
    rows += [(200, base[3]), (201, base[3]), (202, ""), (203, None), (204, "..."), (None, base[5]), (5, base[5]), (300, sentence(rng, 20000))]
    got = {tuple(r) for r in fp.near_groups(documents(rows)).collect()}
    kept = [(d, t) for d, t in rows if d is not None]
    low, high = fp.fingerprint(pa.array([t for _, t in kept]))
    ids = np.array([d for d, _ in kept])
    n = len(kept)
    x, y = np.nonzero(fp.near(low[:, None], high[:, None], low[None], high[None]) | (ids[:, None] == ids[None]))
    root = fp.roots(n, x, y)
    groups = {}
    for i in range(n):
        groups.setdefault(root[i], set()).add(int(ids[i]))
    want = {(d, min(g), len(g), d == min(g)) for g in groups.values() if len(g) > 1 for d in g}
    assert got == want
    assert {202, 203, 204} <= {d for d, *_ in got}
    found = {d for d, *_ in got}
    assert sum(100 + i in found for i in range(40)) >= 36


def test_empty_table_and_no_copies(documents, rng):
    docs = documents([(i, sentence(rng, 50)) for i in range(5)])
    assert fp.near_groups(docs).collect() == []
    assert fp.near_groups(docs.where("doc_id < 0")).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = {tuple(r) for r in fp.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(i, 1) for i in range(2, 41)} | {(95, 90), (100, 90)}


@pytest.mark.parametrize("crowd", [0, 3, 10**6])
def test_linked_makes_the_components_of_all_pairs(crowd):
    """A crowd of near copies, a chain away from it, and strangers: with few comparisons as with all."""
    r = np.random.default_rng(5)
    flip = lambda x, n: x ^ np.uint64(sum(1 << int(b) for b in r.choice(46, n, replace=False)))
    centre = r.integers(0, 1 << 63, 2).astype(np.uint64)
    low = [flip(centre[0], int(r.integers(0, 9))) for _ in range(80)]
    for _ in range(15):
        low.append(flip(low[-1], 11))
    low = np.r_[np.array(low, np.uint64), r.integers(0, 1 << 63, 25).astype(np.uint64)]
    high, node = np.full(len(low), centre[1]), r.permutation(len(low)).astype(np.int64) + 1000
    at = r.choice(len(low), 90, replace=False)
    home = [node[at], low[at], high[at]]
    x, y = fp.linked(home, [node, low, high], block=10, leaders=4, crowd=crowd)
    a, b = np.nonzero(fp.near(low[at][:, None], high[at][:, None], low[None], high[None]))
    want = fp.roots(len(low), node[at[a]] - 1000, node[b] - 1000)
    assert (fp.roots(len(low), x - 1000, y - 1000) == want).all()
    assert len(x) < len(low)


def test_kept_rows(documents, spark, rng):
    """One row of a group and of a doc_id stays, whichever columns clash with the plan's."""
    a, b = sentence(rng, 90), sentence(rng, 90)
    rows = [(1, a), (1, a), (2, a), (3, b), (None, a), (None, a), (4, None), (4, sentence(rng, 90))]
    docs = documents(rows).selectExpr("*", "1 AS gone", "2 AS GONE_", "3 AS Of_Id", "4 AS spans", "5 AS node", "6 AS keep")
    out = fp.kept(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in out.collect()) == sorted([(1, a), (3, b), (0, a), (0, a), (4, "")])
