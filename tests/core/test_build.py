"""A small project from files to contexts, caches and exports."""

import math
import os
import shutil
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import build as b
from loomgraph.sinks import store
from loomgraph.sources import files


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("proj")
    (root / "R").mkdir()
    (root / "tests/testthat").mkdir(parents=True)
    (root / "renv").mkdir()
    (root / "DESCRIPTION").write_text("Package: sums\nImports: stats,\n  utils (>= 4.0)\nDepends: R (>= 4.1)\n")
    (root / "NAMESPACE").write_text("export(total)\n")
    (root / "R/math.R").write_text("#' Adds two numbers.\nadd <- function(x, y) x + y\n\n#' Total of a vector.\ntotal <- function(v) {\n  out <- 0\n  for (i in v) out <- add(out, i)\n  stats::median(v)\n  out\n}\n")
    (root / "R/broken.R").write_text("f <- function( {")
    (root / "R/text.R").write_text("shout <- function(s) paste(total(nchar(s)), toupper(s))\n")
    (root / "renv/x.R").write_text("hidden <- function() 1\n")
    (root / "tests/testthat/test-math.R").write_text("library(testthat)\ntest_that('adds', { expect_equal(add(1, 2), 3) })\n")
    return str(root)


@pytest.fixture(scope="module")
def graph(spark, project):
    return b.build(spark, project)


def test_discovery(project):
    p = files.detect(project)
    assert p.type == "package" and len(p.r_files) == 4 and len(p.test_files) == 1 and p.description["Package"] == "sums"
    with pytest.raises(NotADirectoryError):
        files.detect(project + "/none")


def test_graph(graph):
    nodes = {r["name"]: r for r in graph.nodes.collect()}
    assert set(nodes) == {"R/math::add", "R/math::total", "R/text::shout", "stats", "utils", "testthat", "test-math"}
    es = {(r.src, r.dst, r.edge_type) for r in graph.edges.collect()}
    assert {("R/math::total", "R/math::add", "CALLS"), ("R/text::shout", "R/math::total", "CALLS"), ("test-math", "R/math::add", "TESTS"), ("test-math", "testthat", "IMPORTS")} == {e for e in es if e[2] != "SEMANTIC"}
    assert abs(sum(n.pagerank for n in nodes.values()) - 1) < 1e-9
    assert [n for n, r in nodes.items() if r.entry_point] == ["R/math::total"]
    assert (nodes["R/math::add"].api_depth, nodes["R/text::shout"].api_depth) == (1, 99)
    assert nodes["R/math::total"].complexity == 2 and nodes["R/math::total"].line_start == 5
    assert graph.summary()["nodes"] == {"function": 3, "package": 3, "testfile": 1}


def test_ask(graph):
    out = b.ask(graph, "total of a vector")
    assert out["seed_node"] == "R/math::total" and [n for n, _, _ in out["nodes"]][1] == "R/math::add"
    assert "Adds two numbers." in out["context_string"] and out["tokens_used"] <= out["budget_tokens"]
    small = b.ask(graph, "total", budget=12)
    assert small["tokens_used"] <= 12 and len(small["context_string"]) <= 42
    with pytest.raises(ValueError):
        b.ask(graph, "x", start="nobody")


def test_cache(spark, graph, tmp_path):
    folder = store.save(graph, str(tmp_path / "cache"))
    again = store.load(spark, folder)
    assert again.nodes.count() == graph.nodes.count() and again.edges.count() == graph.edges.count() and again.meta["version_matches"] == "True"
    assert set(again.parts) == set(b.PART_PATH)
    assert 'node_count: "7"' in (tmp_path / "cache/config.yml").read_text().splitlines()
    store.save(again, folder)  # over what it was read from
    assert store.load(spark, folder).nodes.count() == 7
    (tmp_path / "cache/config.yml").write_text('package_version: "0"\n')
    store.log_trace(str(tmp_path / "cache/traces.jsonl"), "q", ["R/math::add"], 0.5, "s", "2024-01-01T00:00:00Z")
    with pytest.warns(UserWarning, match="version 0"):
        old = store.load(spark, folder)
    assert {r["name"]: r.task_trace_weight for r in old.nodes.collect()}["R/math::add"] == 1.0
    with pytest.warns(UserWarning, match="no cache"):
        assert store.load(spark, str(tmp_path / "none")) is None
    (tmp_path / "cache/meta.json").write_text("{")
    with pytest.raises(ValueError):
        store.load(spark, folder)


def test_folders_and_yaml(graph, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert store.cache_dir(graph) == graph.meta["project_root"] + "/.loomgraph" and store.cache_dir(None) == str(tmp_path / ".loomgraph") and store.cache_dir(graph, "x") == "x"
    assert store.yaml_lines({"a": None, "b": 'x"y', "c": [1, 2], "d": []}) == ["a: ~", 'b: "x\\"y"', 'c: "1"', "d: ~"]
    assert store.trace_file(None) is None and store.trace_file(str(tmp_path)).endswith(".loomgraph/traces.jsonl")
    monkeypatch.setenv("LOOMGRAPH_SESSION_ID", "mine")
    assert store.session_id() == "mine"


def test_export(spark, graph, tmp_path):
    path, log = str(tmp_path / "g.db"), str(tmp_path / "log/traces.jsonl")
    store.log_trace(log, "q", ["R/math::add"], 0.5, "s", "2024-01-01T00:00:00Z")
    with open(log, "a") as f:
        f.write("\nnot json\n")
    traces = store.read_traces(spark, log)
    terms = spark.createDataFrame([("a", 2, 3), ("b", 1, 1), ("c", None, 1)], "term string, doc_count int, term_count int")
    for _ in range(2):
        store.export_sqlite(graph, path, vocabulary=terms, traces=traces)
    con = sqlite3.connect(path)
    assert con.execute("SELECT count(*) FROM nodes").fetchone() == (7,) and con.execute("SELECT count(*) FROM task_traces").fetchone() == (1,)
    joined = "SELECT n1.name, n2.name FROM edges e JOIN nodes n1 ON e.source_id = n1.node_id JOIN nodes n2 ON e.target_id = n2.node_id WHERE e.edge_type = 'CALLS' ORDER BY 1"
    assert con.execute(joined).fetchall() == [("R/math::total", "R/math::add"), ("R/text::shout", "R/math::total")]
    best = max(graph.nodes.collect(), key=lambda r: r.pagerank)["name"]
    assert con.execute("SELECT node_id FROM nodes ORDER BY pagerank DESC LIMIT 1").fetchone() == (best,)
    assert con.execute("SELECT count(*) FROM nodes WHERE node_type = 'function'").fetchone() == (3,)
    assert dict(con.execute("SELECT key, value FROM graph_metadata"))["node_count"] == "7"
    idf = dict(con.execute("SELECT term, idf FROM tfidf_vocab"))
    assert idf == {"a": pytest.approx(math.log(1 + 3 / 2)), "b": pytest.approx(math.log(4)), "c": pytest.approx(math.log(4))}
    with pytest.raises(sqlite3.IntegrityError):
        con.execute("INSERT INTO edges (source_id, target_id, edge_type) SELECT source_id, target_id, edge_type FROM edges LIMIT 1")
    back = store.read_sqlite_traces(spark, path)
    assert back.select(F.col("nodes")[0]).first()[0] == "R/math::add"
    con.execute("INSERT INTO task_traces (query, nodes_json) VALUES ('x', 'not json')")
    con.commit()
    assert store.read_sqlite_traces(spark, path).count() == 2
    assert store.read_sqlite_traces(spark, str(tmp_path / "no.db")) is None
    store.views(graph)
    assert [tuple(r) for r in spark.sql(joined).collect()] == con.execute(joined).fetchall()


def same(a, b):
    key = lambda df: sorted(map(repr, (tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in df.collect())))
    return key(a.nodes) == key(b.nodes) and key(a.edges.select("src", "dst", "weight", "edge_type")) == key(b.edges.select("src", "dst", "weight", "edge_type"))


def test_update_equals_a_new_build(spark, project, tmp_path, monkeypatch):
    """After a file changed, one came and one went, by reading only the first two."""
    root = str(tmp_path / "copy")
    shutil.copytree(project, root)
    g = b.build(spark, root)
    with open(f"{root}/R/math.R", "a") as f:
        f.write("twice <- function(x) add(x, x)\n")
    with open(f"{root}/R/new.R", "w") as f:
        f.write("fresh <- function() { library(dplyr)\n twice(2); total(1) }\nsetClass('K', contains = 'L')\n")
    os.remove(f"{root}/R/text.R")
    read = []
    texts = files.texts
    monkeypatch.setattr(files, "texts", lambda s, paths: read.extend(paths) or texts(s, paths))
    updated = b.update(g, spark, ["R/math.R", f"{root}/R/new.R", "R/text.R"])
    assert sorted(os.path.basename(p) for p in read) == ["math.R", "new.R"]
    assert same(updated, b.build(spark, root))
    assert {r["name"] for r in updated.nodes.collect()} >= {"R/math::twice", "R/new::fresh", "dplyr"}
    with pytest.raises(ValueError):
        b.update(g, spark, [])


def vectors():
    """Made in a function, so that workers get it by value."""

    class Letters:
        name, dimensions, batch = "letters", 26, 4

        def __call__(self, texts):
            return [[float(t.lower().count(chr(97 + i))) for i in range(26)] for t in texts]

    return Letters()


def test_vectors_in_the_graph(spark, project, tmp_path):
    g = b.build(spark, project, embedder=vectors(), cache=str(tmp_path), threshold=0.5)
    rows = {r["name"]: r.embedding for r in g.nodes.collect()}
    assert len(rows["R/math::add"]) == 26 and rows["stats"] is None and g.meta["embed_method"] == "letters"
    assert g.edges.where("edge_type = 'SEMANTIC'").count() > 0
    sims = {r["name"]: r.sem for r in b.similarities(g, g.nodes.where("node_type = 'function'"), "shout", vectors()).collect()}
    assert max(sims, key=sims.get) == "R/text::shout"
    assert b.ask(g, "shout", embedder=vectors())["seed_node"] == "R/math::total"
