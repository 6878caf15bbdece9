"""Hand-built graphs with values derived by hand from the rules, and brute-force versions where there is no SQL."""

import itertools
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.functions import text as X
from loomgraph.operators import edges as E
from loomgraph.operators import graph as G
from loomgraph.operators import relevance, semantic
from loomgraph.plans import catalog

DATA = "/root/testdata/sf0.001"


def nodes_of(spark, rows):
    """rows: name, PageRank, and optionally type, entry point, depth."""
    full = [(n, p, *more, *[S.FUNCTION, False, None][len(more) :], i) for i, (n, p, *more) in enumerate(rows)]
    return S.normalize(spark.createDataFrame(full, "name string, pagerank double, node_type string, entry_point boolean, api_depth int, node_pos long"), S.NODE_SCHEMA)


def edges_of(spark, pairs, kind=S.CALLS):
    return spark.createDataFrame([(a, b, 1.0, kind) for a, b in pairs], "src string, dst string, weight double, edge_type string")


def walk(spark, nodes, edges, start=None, **options):
    start = start or relevance.seed(nodes).first()["name"]
    priced = nodes.select("name", "node_pos").join(relevance.scores(nodes).select("name", "static"), "name").withColumn("cost", F.lit(1)).withColumn("full_cost", F.lit(1))
    asked = spark.createDataFrame([("q", start)], "query_id string, start string")
    found = relevance.query_contexts(asked, priced, edges, **options).orderBy("rank").collect()
    return [(r["name"], round(r.score, 7)) for r in found]


def test_chain_with_an_isolated_node(spark):
    nodes = nodes_of(spark, [("a", 0.10), ("b", 0.40), ("c", 0.25), ("d", 0.20), ("e", 0.05)])
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert walk(spark, nodes, edges) == [("b", 1.0), ("c", 0.1321429), ("d", 0.1178571)]
    assert walk(spark, nodes, edges, "e") == [("e", 1.0)]
    assert walk(spark, nodes, edges, max_nodes=1) == [("b", 1.0), ("c", 0.1321429)]


def test_entry_point_is_the_seed(spark):
    nodes = nodes_of(spark, [("a", 0.10, S.FUNCTION, True, 0), ("b", 0.40, S.FUNCTION, False, 1), ("c", 0.25, S.FUNCTION, False, 2)])
    assert walk(spark, nodes, edges_of(spark, [("a", "b"), ("b", "c")])) == [("a", 1.0), ("b", 0.225), ("c", 0.1571429)]


@pytest.mark.parametrize("budget", [50, 100, 250, 500, 1000])
def test_chain_from_its_end(spark, budget):
    names = [f"n{i}" for i in range(1, 9)]
    nodes = nodes_of(spark, [(n, 0.05 + 0.95 * i / 7) for i, n in enumerate(names)])
    assert walk(spark, nodes, edges_of(spark, list(zip(names, names[1:]))), budget=budget) == [("n8", 1.0)]


def test_hub(spark):
    spokes = [f"spoke{i}" for i in range(1, 7)]
    nodes = nodes_of(spark, [("hub", 0.9), *[(s, 0.1 / 6) for s in spokes]])
    edges = edges_of(spark, [("hub", s) for s in spokes])
    assert walk(spark, nodes, edges, "hub", min_relevance=0.0) == [("hub", 1.0), *[(s, 0.075) for s in spokes]]
    assert walk(spark, nodes, edges, "hub") == [("hub", 1.0)]


def test_scores_and_overrides(spark):
    rows = [("a", 0.10), ("b", 0.40), ("c", 0.30), ("d", 0.20), ("dplyr", 0.05, S.PACKAGE)]
    nodes = nodes_of(spark, rows)
    got = {r["name"]: r.score for r in relevance.scores(nodes).collect()}
    assert got == {k: pytest.approx(v, abs=1e-7) for k, v in {"a": 0.0892857, "b": 0.175, "c": 0.1464286, "d": 0.1178571, "dplyr": 0.075}.items()}
    traced = nodes.withColumn("task_trace_weight", F.when(F.col("name") == "b", 1.0))
    one = {r["name"]: r.score for r in relevance.scores(traced, weights={"semantic": 0, "pagerank": 0, "task_trace": 1, "cochange": 0, "other": 9}).collect()}
    assert one["b"] == 1.0 and one["a"] == pytest.approx(0.075)


def test_cochange_signal(spark):
    nodes = nodes_of(spark, [("x", 0.5), ("y", 0.5), ("z", 0.5)])
    e = spark.createDataFrame([("x", "y", 0.9, S.CO_CHANGES), ("y", "z", 0.8, S.CO_CHANGES)], "src string, dst string, weight double, edge_type string")
    none = {r["name"]: r.score for r in relevance.scores(nodes.withColumn("pagerank", F.lit(None).cast("double")), None, relevance.cochange_scores(e, [])).collect()}
    assert none["x"] == pytest.approx(0.125)
    some = {r["name"]: r.score for r in relevance.scores(nodes.withColumn("pagerank", F.lit(None).cast("double")), None, relevance.cochange_scores(e, ["y"])).collect()}
    assert some["x"] == pytest.approx(0.125 + 0.09) and some["z"] == pytest.approx(0.125 + 0.08)


def test_vectors(spark):
    def pairs(vectors, threshold):
        df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
        return semantic.pairs(df, threshold)

    assert [(r.a, r.b) for r in pairs([[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], 0.9).collect()] == [(0, 1)]
    assert pairs([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], 0.5).count() == 0
    found = semantic.capped(pairs([[1.0, 2.0]] * 6, 0.9), 2).collect()
    degree = {}
    for r in found:
        degree[r.src], degree[r.dst] = degree.get(r.src, 0) + 1, degree.get(r.dst, 0) + 1
    assert max(degree.values()) == 2


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1.0), 0.0, 0.0]
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b"))).collect()


def test_commit_log(spark):
    def parsed(lines):
        return {(r.commit_id[:1], r.file) for r in E.parse_log(spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "log int, line_no long, line string")).collect()}

    assert parsed(["a" * 40, "", "R/foo.R", "R/bar.R", "b" * 40, "", "R/baz.R"]) == {("a", "R/foo.R"), ("a", "R/bar.R"), ("b", "R/baz.R")}
    assert parsed(["a" * 40]) == set() and parsed([]) == set()


def test_usable_edges(spark):
    """Edges of what is neither a start nor led to take no part in the walks; types are put in after the joins."""
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("x", "b"), ("x", "y"), ("y", "z")])
    starts = spark.createDataFrame([("a",)], "name string")
    assert {(r.src, r.dst) for r in G.usable(edges, starts).collect()} == {("a", "b"), ("b", "c"), ("y", "z")}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    got = sorted((r.src, r.dst, r.edge_type) for r in E.assemble(nodes, CALLS=edges, TESTS=edges.where("src = 'b'")).collect())
    assert got == [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("b", "c", "TESTS")]


def test_calls_between_known_names(spark):
    rows = [("load_data", ["utils::read.csv"]), ("clean_data", ["dplyr::filter", "mutate"]), ("split_data", ["mean"]), ("fit_model", ["lm"]), ("run_benchmark", ["load_data", "clean_data", "split_data", "fit_model", "fit_model"])]
    nodes = spark.createDataFrame([(f"pkg::{n}", n, c) for n, c in rows], "id string, name string, calls_list array<string>")
    assert {(r.src, r.dst) for r in E.call_edges(nodes).collect()} == {("pkg::run_benchmark", f"pkg::{n}") for n in ("load_data", "clean_data", "split_data", "fit_model")}


def test_classes(spark):
    text = """setClass("Animal", representation(x = "numeric"))
setClass("Dog", representation(y = "numeric"), contains = "Animal")
Child <- R6Class("Child", public = list(), inherit = Base)
setRefClass("Kid", fields = list(), contains = "Base")
setClass("Unknown", contains = "Nowhere")
setClass("Self", contains = "Self")"""
    names = ["Animal", "Dog", "Child", "Base", "Kid", "Unknown", "Self", "Base"]
    nodes = spark.createDataFrame([(f"{i}::{n}", n, i) for i, n in enumerate(names)], "id string, name string, node_pos long")
    sources = spark.createDataFrame([(text,)], "text string")
    assert {(r.src, r.dst) for r in E.extends_edges(sources, nodes).collect()} == {("1::Dog", "0::Animal"), ("2::Child", "3::Base"), ("4::Kid", "3::Base")}


def test_library_needs_its_bracket(spark):
    lines = spark.createDataFrame([("a", "library(x, character.only = TRUE)"), ("a", "library(dplyr); require( 'data.table' )"), ("b", "my_pkg::f(stats:::g)")], "stem string, line string")
    got = [tuple(r)[:2] + (r.source,) for r in E.import_edges(lines).collect()]
    assert got == [("a", "data.table", "library"), ("a", "dplyr", "library"), ("b", "my_pkg", "qualified"), ("b", "stats", "qualified")]


def test_depths_of_a_long_chain(spark):
    """More hops than fronts that are kept apart; a circle; what can't be reached."""
    names = [f"n{i}" for i in range(25)]
    nodes = spark.createDataFrame([(n,) for n in [*names, "lost"]], "name string")
    edges = edges_of(spark, [*zip(names, names[1:]), ("n24", "n3"), ("n5", "outside")])
    got = {r["name"]: r.api_depth for r in G.depths(nodes, edges, nodes.where("name = 'n0'")).collect()}
    assert got == {**{n: i for i, n in enumerate(names)}, "lost": 99}


def test_both_ways_of_pagerank(spark):
    """In one task and by joins, with sinks, parallel edges and a node without edges."""
    r = random.Random(4)
    names = [f"n{i}" for i in range(12)]
    nodes = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = [(r.choice(names[:8]), r.choice(names[:11])) for _ in range(30)]
    edges = edges_of(spark, pairs)
    one, many = ({x["name"]: x.pagerank for x in G.pagerank(nodes, edges, iterations=8, tolerance=0.0, small=s).collect()} for s in (10**6, -1))
    assert one == {n: pytest.approx(p, abs=1e-12) for n, p in many.items()} and sum(one.values()) == pytest.approx(1.0)


def test_capped_against_brute_force(spark):
    """The greedy rule over all pairs in order, for the whole set at once."""
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 6))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    for cap in (1, 3):
        degree, want = [0] * 60, set()
        order = sorted(((i, -sim[i, j], j) for i, j in itertools.combinations(range(60), 2) if sim[i, j] >= 0.5))
        for i, _, j in order:
            if degree[i] < cap and degree[j] < cap:
                degree[i] += 1
                degree[j] += 1
                want.add((i, j))
        assert {(x.src, x.dst) for x in semantic.semantic_edges(df, 0.5, cap).collect()} == want


def crowd(spark, n=60):
    """Vectors of which many are equal and all hang together, and the pairs over 0.3 of them."""
    r = np.random.default_rng(5)
    v = np.abs(r.normal(size=(n // 3, 5))).repeat(3, axis=0)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    return df, semantic.pairs(df, 0.3)


@pytest.mark.parametrize("depth, rows", [(2, 10**6), (8, 500)])
def test_capped_in_parts_and_with_short_lists(spark, depth, rows):
    """One component; lists that end too early are made again; the fold goes on from part to part."""
    df, found = crowd(spark)
    degree, want = {}, set()
    for x in sorted(found.collect(), key=lambda x: (x.a, -x.score, x.b)):
        if degree.get(x.a, 0) < 4 and degree.get(x.b, 0) < 4:
            degree[x.a], degree[x.b] = degree.get(x.a, 0) + 1, degree.get(x.b, 0) + 1
            want.add((x.a, x.b))
    got = [(x.src, x.dst) for x in semantic.capped(found, 4, depth=depth, rows=rows).collect()]
    assert set(got) == want and len(got) == len(want)
    r = np.random.default_rng(6)
    apart = spark.createDataFrame([(i, [float(x) for x in np.abs(r.normal(size=5))]) for i in range(60)], "vec_id long, embedding array<double>")
    want = {(x.src, x.dst) for x in semantic.capped(semantic.pairs(apart, 0.3), 4, depth=10**4).collect()}
    got = [(x.src, x.dst) for x in semantic.semantic_edges(apart, 0.3, 4, block=45, depth=depth, rows=rows).collect()]
    assert set(got) == want and len(got) == len(want)


def test_pairs_come_tile_by_tile():
    """No more pairs at once than a tile has, though all vectors of a block are alike."""
    n = 5000
    batch = pa.record_batch({"id": pa.array(range(n), pa.int64()), "v": pa.array([[1.0, 2.0]] * n), "block": pa.array([0] * n, pa.int32()), "i": pa.array([0] * n, pa.int32()), "j": pa.array([0] * n, pa.int32())})
    sizes = [len(a) for a, _, _ in semantic._tiles(iter([batch]), 0.3)]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= semantic.PART


def test_nearest_equals_the_best_of_all_pairs(spark):
    """With ties, over several blocks; a pair of blocks sends no more than k rows a vector."""
    df, found = crowd(spark)
    want = sorted(tuple(r) for r in semantic.top_partners(found, 3).collect())
    assert sorted(tuple(r) for r in semantic.nearest(df, 0.3, 3, block=30).collect()) == want
    best = semantic.Best(2)
    best.add(np.array([1] * 5 + [2]), np.array([9, 8, 7, 6, 5, 4]), np.array([1.0, 1, 1, 3, 1, 1]), np.zeros(6))
    (got,) = best.batches()
    assert got.select(["id", "partner", "more"]).to_pylist() == [{"id": 1, "partner": 6, "more": False}, {"id": 1, "partner": 5, "more": True}, {"id": 2, "partner": 4, "more": False}]
    assert semantic.rounded(np.array([0.1234565, 0.1234575, 0.12345649, -0.5])).tolist() == [123457, 123458, 123456, -500000]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_contexts_against_the_plain_walk(spark):
    """query_context_nodes, whose query walks the whole graph's dictionaries here."""
    nodes, edges = catalog.context_nodes(spark, DATA)
    rows = {r["name"]: r for r in nodes.collect()}
    out = {}
    for e in edges.select("src", "dst").distinct().collect():
        out.setdefault(e.src, []).append(e.dst)
    out = {k: sorted(v, key=lambda n: (rows[n].node_pos, n)) for k, v in out.items()}
    got = {}
    for r in catalog.QUERIES["query_context_nodes"](spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r["name"], round(r.score, 9), r.tokens))
    starts = [n for n in rows if n.startswith("orders:") and int(n[7:]) % 100 == 0]
    assert set(got) == set(starts) and starts
    for start in starts:
        hits = relevance.traverse({n: r.static for n, r in rows.items()}, {n: r.cost for n, r in rows.items()}, out, {}, start, math.ceil(rows[start].full_cost), budget=120, max_nodes=8)
        assert sorted(got[start]) == [(i, n, round(s, 9), t) for i, (n, s, t) in enumerate(hits)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_exported_vectors_are_whole(spark):
    import json

    from loomgraph.session import read

    want = {f"vec:{r.vec_id}": [float(x) for x in r.embedding] for r in read(spark, DATA, "embeddings").collect()}
    got = {r.node_id: json.loads(r.embedding) for r in catalog.QUERIES["export_nodes_json"](spark, DATA).collect()}
    assert got == want
