"""Relevance of nodes, seeds, and budgeted best-first traversal."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.operators.graph import union_all, usable
from loomgraph.session import written


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def pagerank_signal(value: Column, low: Column, high: Column) -> Column:
    """Min-max over the graph; 0.5 where there is no range or no value."""
    return F.coalesce(F.when(high > low, clamp((value - low) / (high - low))).otherwise(F.lit(0.5)), F.lit(0.5))


def depth_signal(depth: Column) -> Column:
    return F.when(depth.isNull() | (depth >= S.UNREACHABLE), 0.5).otherwise(1 / (1 + S.DEPTH_FACTOR * depth))


def cochange_scores(edges: DataFrame, visited: Sequence[str]) -> DataFrame:
    """name, cochange: mean weight of the CO_CHANGES edges, either way, between a node and visited ones."""
    e = edges.where(F.col("edge_type") == S.CO_CHANGES)
    there = e.where(F.col("dst").isin(*visited)).select(F.col("src").alias("name"), "weight")
    back = e.where(F.col("src").isin(*visited)).select(F.col("dst").alias("name"), "weight")
    return there.union(back).groupBy("name").agg(F.avg("weight").alias("cochange"))


def scores(nodes: DataFrame, similarity: DataFrame | None = None, cochange: DataFrame | None = None, weights: dict | None = None) -> DataFrame:
    """name, score, and the static part of it, for all nodes in one projection.

    nodes(name, pagerank, api_depth, task_trace_weight), similarity(name, sem), cochange(name, cochange).
    """
    w = S.weights(overrides=weights)
    span = nodes.agg(F.min("pagerank").alias("pr_low"), F.max("pagerank").alias("pr_high"))
    df = nodes.crossJoin(F.broadcast(span))
    df = df.join(similarity, "name", "left") if similarity is not None else df.withColumn("sem", F.lit(0.0))
    df = df.join(cochange, "name", "left") if cochange is not None else df.withColumn("cochange", F.lit(0.0))
    static = (
        w["semantic"] * clamp(F.coalesce("sem", F.lit(0.0)))
        + w["depth"] * depth_signal(F.col("api_depth"))
        + w["task_trace"] * clamp(F.coalesce("task_trace_weight", F.lit(0.0)))
        + w["pagerank"] * pagerank_signal(F.col("pagerank"), F.col("pr_low"), F.col("pr_high"))
    )
    df = df.withColumn("static", static)
    return df.select("name", clamp(F.col("static") + w["cochange"] * clamp(F.coalesce("cochange", F.lit(0.0)))).alias("score"), "static")


def seed(nodes: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """One row: the name to start from.  Function nodes, entry points if there are any; best similarity, else PageRank;
    ties by node_pos."""
    pool = nodes.where(F.col("node_type") == S.FUNCTION)
    if not pool.take(1):
        pool = nodes
    entries = pool.where(F.coalesce("entry_point", F.lit(False)))
    if entries.take(1):
        pool = entries
    if similarity is not None:
        pool = pool.join(similarity, "name", "left").withColumn("_k", F.coalesce("sem", F.lit(0.0)))
    else:
        pool = pool.withColumn("_k", F.coalesce("pagerank", F.lit(float("-inf"))))
    return pool.orderBy(F.desc("_k"), "node_pos", "name").limit(1).select("name")


def traverse(static: dict[str, float], cost: dict[str, int], out: dict[str, list[str]], cochange: dict[str, list[tuple[str, float]]], start: str, start_cost: int, budget: int = S.BUDGET, min_relevance: float = S.MIN_RELEVANCE, max_nodes: int = S.MAX_NODES, cochange_weight: float = S.WEIGHTS["cochange"]) -> list[tuple[str, float, int]]:
    """The nodes taken, in order, with score and tokens; the start comes first with score 1.

    Each round scores the frontier, sorts it (ties keep their order), and takes the first node that is relevant enough
    and whose compressed form fits the budget; its neighbours join the frontier.
    """
    used = min(start_cost, budget)
    hits, visited, frontier = [(start, 1.0, used)], {start}, [n for n in out.get(start, []) if n != start]
    added = 0
    while used < budget and frontier and added < max_nodes:
        scored = []
        for n in frontier:
            near = [w for m, w in cochange.get(n, []) if m in visited]
            signal = min(1.0, max(0.0, sum(near) / len(near))) if near else 0.0
            scored.append((min(1.0, max(0.0, static.get(n, 0.0) + cochange_weight * signal)), n))
        scored.sort(key=lambda x: -x[0])
        frontier = [n for _, n in scored]
        taken = None
        for value, n in scored:
            if value < min_relevance:
                break
            if used + cost.get(n, 0) <= budget:
                taken = (n, value, cost.get(n, 0))
                break
        if taken is None:
            break
        hits.append(taken)
        used += taken[2]
        added += 1
        visited.add(taken[0])
        frontier = list(dict.fromkeys([n for n in frontier if n != taken[0]] + [n for n in out.get(taken[0], []) if n not in visited]))
    return hits


ROW = pa.schema([("query_id", pa.string()), ("rank", pa.int32()), ("name", pa.string()), ("score", pa.float64()), ("tokens", pa.int32())])
RESULT = "query_id string, rank int, name string, score double, tokens int"


def query_contexts(queries: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int | None = None, **options) -> DataFrame:
    """queries(query_id, start): the nodes of each query's context (RESULT).

    nodes(name, static, cost, full_cost, node_pos) and edges are cut to what can be reached from each start within `hops`
    (as many as nodes may be added), so a query's group holds its neighbourhood; queries run in parallel.
    """
    hops = options.get("max_nodes", S.MAX_NODES) if hops is None else hops
    front = queries.select("query_id", F.col("start").alias("name"))
    edges = written(usable(edges, front), "usable")
    steps = edges.where(F.col("edge_type") != S.SEMANTIC) if "edge_type" in edges.columns else edges
    steps = written(steps.select("src", "dst").distinct(), "steps")
    fronts = [front]
    for _ in range(hops):
        new = front.join(steps, F.col("name") == F.col("src")).select("query_id", F.col("dst").alias("name")).distinct()
        front = written(new.join(union_all(fronts), ["query_id", "name"], "left_anti"), "reach")
        if not front.take(1):
            break
        fronts.append(front)
    reach = union_all(fronts)
    node_rows = reach.join(nodes, "name").select("query_id", F.lit("n").alias("kind"), F.col("name").alias("a"), F.lit(None).cast("string").alias("b"), F.col("static").alias("x"), F.col("cost").cast("double").alias("y"), F.col("full_cost").cast("double").alias("z"), "node_pos")
    inner = reach.select("query_id", F.col("name").alias("src")).join(edges, "src").select("query_id", F.when(F.col("edge_type") == S.CO_CHANGES, "c").otherwise("e").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0).cast("long").alias("node_pos"))
    starts = queries.select("query_id", F.lit("s").alias("kind"), F.col("start").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0).cast("long").alias("node_pos"))

    def run(table: pa.Table) -> pa.Table:
        static: dict[str, float] = {}
        cost: dict[str, int] = {}
        full: dict[str, float] = {}
        pos: dict[str, int] = {}
        found: list[tuple[str, str, str, float]] = []
        start = None
        names = ("kind", "a", "b", "x", "y", "z", "node_pos")
        for kind, a, b, x, y, z, at in zip(*(table.column(c).to_pylist() for c in names)):
            if kind == "n":
                if a not in pos:
                    static[a], cost[a], full[a], pos[a] = x, int(y), z, at
            elif kind == "s":
                start = a if start is None else start
            else:
                found.append((kind, a, b, math.nan if x is None else x))
        out: dict[str, set[str]] = {}
        co: dict[str, list[tuple[str, float]]] = {}
        for kind, a, b, x in found:
            if b in pos:
                out.setdefault(a, set()).add(b)
                if kind == "c":
                    co.setdefault(a, []).append((b, x))
                    co.setdefault(b, []).append((a, x))
        hits = []
        if start in pos:
            ordered = {k: sorted(v, key=lambda n: (pos[n], n)) for k, v in out.items()}
            hits = traverse(static, cost, ordered, co, start, int(math.ceil(full[start])), **options)
        query = table.column("query_id")[0].as_py()
        columns = zip(*((query, i, n, s, t) for i, (n, s, t) in enumerate(hits))) if hits else [[]] * 5
        return pa.table({c.name: pa.array(list(v), c.type) for c, v in zip(ROW, columns)}, ROW)

    return node_rows.union(inner).union(starts).groupBy("query_id").applyInArrow(run, RESULT)
