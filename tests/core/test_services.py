"""Embedders and chat with stand-ins for services; rendering."""

import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.functions import embedders as e
from loomgraph.operators import context, feedback, relevance, semantic
from loomgraph.plans import chat
from loomgraph.plans.build import Graph
from loomgraph.sinks import plot


def counting(path):
    """Made in a function, so that workers get it by value."""

    class Counting:
        name, dimensions, batch = "counting", 2, 2

        def __call__(self, texts):
            assert len(texts) <= 2
            with open(path, "a") as f:
                f.writelines(json.dumps(t) + "\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

    return Counting()


def test_embed_asks_once_a_text(spark, tmp_path):
    log = tmp_path / "asked"
    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, "ccc")], "id long, text string")
    vectors, new = e.embed(texts, counting(str(log)))
    assert {r.id: r.embedding[0] for r in vectors.collect()} == {1: 1.0, 2: 2.0, 3: 1.0, 4: 3.0}
    assert sorted(map(json.loads, log.read_text().split())) == ["a", "bb", "ccc"]
    more = texts.union(spark.createDataFrame([(5, "dddd")], texts.schema))
    vectors, _ = e.embed(more, counting(str(log)), new)
    assert vectors.count() == 5 and len(log.read_text().split()) == 4


def test_services():
    waits, calls = [], []

    def post(url, body, headers, timeout):
        calls.append(body)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429, "", None, None)
        return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}

    assert e.HostedService("m", "k", post=post, wait=waits.append)(["a", "b"]) == [[1.0], [2.0]] and len(waits) == 2
    with pytest.raises(ValueError):
        e.HostedService("m", "")
    assert abs(e.HostedService.cost(10_000) - 0.02) < 1e-12

    def down(*_):
        raise OSError

    assert e.LocalDaemon("m", dimensions=3, post=down)(["a"]) == [[0.0, 0.0, 0.0]]
    assert e.LocalDaemon("m", url="http://127.0.0.1:9").available(0.2) is False


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("pkg::a", "function", 0, True, 0.1), ("pkg::b", "function", 1, False, 0.4), ("pkg::c", "function", 2, False, 0.3), ("pkg::d", "function", 99, False, 0.2), ("dplyr", "package", 99, False, 0.05)]
    nodes = spark.createDataFrame([(n, t, d, x, p, f"{n[5:]}(x)", f"body of {n}", i) for i, (n, t, d, x, p) in enumerate(rows)], "name string, node_type string, api_depth int, entry_point boolean, pagerank double, signature string, body_text string, node_pos long")
    edges = spark.createDataFrame([("pkg::a", "pkg::b", 1.0, "CALLS"), ("pkg::b", "pkg::c", 1.0, "CALLS"), ("pkg::c", "pkg::d", 1.0, "CALLS"), ("pkg::a", "dplyr", 1.0, "IMPORTS")], "src string, dst string, weight double, edge_type string")
    return Graph(S.normalize(nodes, S.NODE_SCHEMA), edges, {"project_name": "pkg"})


def test_chat(graph):
    seen = {}

    class Echo:
        name = "echo"

        def __call__(self, system, message, tools):
            seen.update(system=system, tools=tools)
            return "answer " * 200

    log = []
    assert chat.chat(graph, "body of b", Echo(), log=lambda *x: log.append(x)).startswith("answer") and "Project: pkg" in seen["system"]
    assert len(log[0][1]) == 500
    chat.chat(graph, "x", Echo(), use_tools=True)
    t = seen["tools"]
    assert t["find_callers"]("pkg::c") == "pkg::b" and t["find_callees"]("pkg::a") == "dplyr\npkg::b" and t["find_callees"]("dplyr") == "none"
    assert t["search_nodes"]("pkg::b body").splitlines()[0].startswith("pkg::b") and t["get_node_info"]("pkg::a") == "a(x) {\nbody of pkg::a\n}"
    assert t["get_node_info"]("zzz") == "no node zzz"

    class Broken:
        name = "broken"

        def __call__(self, *_):
            raise RuntimeError("no network")

    assert chat.chat(graph, "x", Broken()) == "[broken error] no network"
    with pytest.raises(ValueError):
        chat.chat(graph, " ", Echo())


def test_scores_and_walk(graph):
    got = {r["name"]: r.score for r in relevance.scores(graph.nodes).collect()}
    span = 0.35
    assert abs(got["pkg::a"] - (0.15 + 0.1 * 0.05 / span)) < 1e-9 and abs(got["dplyr"] - 0.075) < 1e-9
    hits = relevance.traverse({"b": 0.3, "c": 0.2, "d": 0.05}, {"b": 5, "c": 50, "d": 1}, {"a": ["b", "c"], "b": ["d"]}, {"d": [("b", 0.9)]}, "a", 10, budget=30)
    assert hits == [("a", 1.0, 10), ("b", 0.3, 5), ("d", pytest.approx(0.14), 1)]
    assert relevance.traverse({}, {}, {}, {}, "a", 99, budget=10) == [("a", 1.0, 10)]
    assert relevance.seed(graph.nodes).first()["name"] == "pkg::a"


def test_rendering(graph):
    short = {r["name"]: r.context for r in context.compressed_context(graph.nodes, graph.edges).collect()}
    assert short["pkg::b"] == "b(x)\nCalls: c\nCalled by: a"
    lines = [r.line for r in context.dot_lines(graph.nodes, graph.edges).collect()]
    assert lines[0] == "digraph project {" and lines[-1] == "}" and sum("->" in x for x in lines) == 4
    assert any("cluster_pkg" in x and '"pkg::a"; "pkg::b"' in x for x in lines)
    report = context.instructions("pkg", "package", graph.nodes, graph.edges, [("stats", "unknown")], pipe="native |>", tested=True)
    assert "- `pkg::b` (0.4)" in report and "- stats: unknown" in report and "- Pipe: native |>" in report and "- Tests: testthat" in report
    assert len(context.instructions("pkg", "package", graph.nodes, graph.edges, [("p", "1")] * 200, 100)) <= 400
    with pytest.raises(ValueError):
        context.instructions("pkg", "package", graph.nodes, graph.edges, max_tokens=5)


def test_cap_and_traces(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.95), (1, 4, 0.99)], "a long, b long, score double")
    assert {(r.src, r.dst) for r in semantic.capped(pairs, 1).collect()} == {(1, 4), (2, 3)}
    nodes = spark.createDataFrame([("model",), ("clean",), ("load",)], "name string")
    traces = spark.createDataFrame([("2024-01-02", ["clean"], 0.8), ("2024-02-01", ["model"], 0.9), (None, ["gone"], None)], "t string, nodes array<string>, polarity double").selectExpr("cast(t as timestamp) created_at", "nodes", "polarity")
    got = {r["name"]: r.weight for r in feedback.trace_weights(nodes, traces, "2024-02-01 00:00:00").collect()}
    assert got == {"model": 1.0, "load": 0.0, "clean": pytest.approx(1.8 / (1.9 * 2))}
    assert feedback.trace_weights(nodes, traces.where("polarity > 5"), "2024-02-01 00:00:00").agg({"weight": "max"}).first()[0] == 0


def test_conventions(spark):
    def style(names):
        return context.conventions(spark.createDataFrame([(n,) for n in names], "name string")).first().style

    assert style(["a_b"] * 5) == "unknown"
    assert style(["a_b"] * 5 + ["ab"]) == "snake_case"
    assert style(["aB"] * 3 + ["ab"] * 5) == "camelCase"
    assert style(["print.a"] * 4 + ["ab"] * 4) == "dot.case"
    # both underscores and humps: neither style, and dots decide
    assert style(["a_bC"] * 6) == "mixed" and style(["a_b.cD"] * 6) == "dot.case"
    assert style([""] * 9 + ["a_b"]) == "unknown"


def test_pipes(spark):
    def row(lines):
        return tuple(context.pipe_counts(spark.createDataFrame([(x,) for x in lines], "line string")).first())

    assert row(["x |> f() |> g()", "y %>% h()", "z"]) == (1, 1, "native |>")
    assert row(["y %>% h()"]) == (0, 1, "magrittr %>%") and row(["z"]) == (0, 0, "none") and row([]) == (0, 0, "none")


def test_context_of_a_node_and_of_a_query(graph):
    # a package is shown compressed whatever the mode: by its signature, or its name where it has none
    assert context.node_context("dplyr", graph.nodes, graph.edges, "full") == "(x)"
    assert context.node_context("dplyr", graph.nodes.withColumn("signature", F.lit(None).cast("string")), graph.edges, "full") == "dplyr"
    assert context.node_context("pkg::b", graph.nodes, graph.edges) == "b(x) {\nbody of pkg::b\n}"
    assert context.node_context("pkg::b", graph.nodes, graph.edges, "compressed") == "b(x)\nCalls: c\nCalled by: a"
    with pytest.warns(UserWarning):
        assert context.node_context("zzz", graph.nodes, graph.edges) == ""
    found = {"nodes": [(f"n{i}", 1 - i / 10, 5) for i in range(7)], "tokens_used": 35, "budget_tokens": 140, "seed_node": "n0"}
    assert context.shown_context(found) == "<context of n0: 7 nodes (n0, n1, n2, n3, n4, ...), 35 of 140 tokens>"
    assert context.context_summary(found)["utilisation"] == 25.0 and len(context.context_summary(found)["top"]) == 5


def test_completions():
    asked = []
    replies = [{"choices": [{"message": {"role": "assistant", "tool_calls": [{"id": "1", "function": {"name": "find_callers", "arguments": '{"name": "a"}'}}, {"id": "2", "function": {"name": "none", "arguments": "{}"}}]}}]}, {"choices": [{"message": {"content": "done"}}]}]

    def post(url, body, headers, timeout):
        asked.append(json.loads(json.dumps(body)))
        return replies[len(asked) - 1]

    backend = chat.Completions("m", "k", post=post)
    assert backend("s", "q", {"find_callers": lambda name, limit=20: f"callers of {name}"}) == "done"
    assert [m["content"] for m in asked[1]["messages"][-2:]][0] == "callers of a" and asked[1]["messages"][-1]["content"].startswith("no such call")
    assert asked[0]["tools"][0]["function"]["name"] == "find_callers"
    with pytest.raises(RuntimeError):
        chat.Completions("m", "k", post=lambda *_: {"error": {"message": "no"}})("s", "q", {})
    with pytest.raises(ValueError):
        chat.Completions("m", "")


def test_a_silent_service_gives_way(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert e.usable(e.LocalDaemon("m", url="http://127.0.0.1:9")) is None
    assert e.usable(None) is None and e.load_cache(spark, str(tmp_path)) is None
    _, new = e.embed(spark.createDataFrame([(1, "a")], "id long, text string"), counting(str(tmp_path / "x")))
    e.save_cache(new, str(tmp_path))
    assert e.load_cache(spark, str(tmp_path)).count() == 1


def test_plots(graph, tmp_path):
    dot = plot.plot(graph)
    assert dot.startswith("digraph") and '"pkg::a" -> "pkg::b"' in dot
    for kind in ("svg", "html", "dot"):
        plot.plot(graph, str(tmp_path / f"g.{kind}"))
    assert (tmp_path / "g.svg").read_text().count("<circle") == 5 and "addEventListener" in (tmp_path / "g.html").read_text()
    with pytest.raises(ValueError):
        plot.plot(graph, str(tmp_path / "g.xyz"))
