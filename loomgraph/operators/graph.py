"""Graph algorithms over nodes(name, ...) and edges(src, dst, weight, edge_type)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.session import forget, written

#: Edges up to which one task ranks a graph in memory (24 bytes an edge).
SMALL = 500_000


def _combined(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    kept = edges.where(F.col("edge_type") != S.SEMANTIC) if "edge_type" in edges.columns else edges
    names = nodes.select("name")
    kept = kept.join(names, F.col("src") == names["name"], "left_semi").join(names, F.col("dst") == names["name"], "left_semi")
    return kept.groupBy("src", "dst").agg(F.sum("weight").alias("w"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-10, small: int = SMALL) -> DataFrame:
    """name, pagerank.  Parallel edges add up, the mass of nodes without out-edges is spread evenly, the sum is 1.

    SEMANTIC edges are left out.  Stops when the sum of changes is under tolerance (0: never before `iterations`).
    Small graphs are ranked in one task; others by a join and a sum a round, each round a table in the shared folder.
    """
    names = nodes.select("name").distinct()
    flows = _combined(edges, names)
    totals = flows.groupBy("src").agg(F.sum("w").alias("total"))
    shares = written(flows.join(totals, "src").where("total > 0").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "shares")
    if shares.count() <= small:
        both = shares.select("src", "dst", "share").unionByName(names.select(F.col("name").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("share")))

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            ids = np.sort(frame[frame.dst.isna()].src.to_numpy().astype(object))
            e = frame[~frame.dst.isna()].sort_values(["src", "dst"])
            a, b, w = np.searchsorted(ids, e.src.to_numpy().astype(object)), np.searchsorted(ids, e.dst.to_numpy().astype(object)), e.share.to_numpy()
            n = len(ids)
            p = np.full(n, 1.0 / n)
            sink = np.ones(n, bool)
            sink[a] = False
            for _ in range(iterations):
                q = (1 - damping) / n + damping * (np.bincount(b, weights=p[a] * w, minlength=n) + p[sink].sum() / n)
                change = np.abs(q - p).sum()
                p = q
                if change < tolerance:
                    break
            return pd.DataFrame({"name": ids, "pagerank": p})

        return both.groupBy().applyInPandas(solve, "name string, pagerank double")
    n = names.count()
    sinks = names.join(shares.select("src").distinct(), F.col("name") == F.col("src"), "left_anti")
    base = written(names.join(sinks.withColumn("sink", F.lit(True)), "name", "left").select("name", F.coalesce("sink", F.lit(False)).alias("sink"), F.lit(1.0 / n).alias("p")), "ranks")
    for _ in range(iterations):
        lost = base.where("sink").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("lost"))
        gained = shares.join(base, F.col("src") == F.col("name")).groupBy("dst").agg(F.sum(F.col("p") * F.col("share")).alias("gained"))
        after = base.join(gained, F.col("name") == F.col("dst"), "left").crossJoin(F.broadcast(lost))
        after = written(after.select("name", "sink", ((1 - damping) / n + damping * (F.coalesce("gained", F.lit(0.0)) + F.col("lost") / n)).alias("q"), F.col("p").alias("before")), "ranks")
        change = after.agg(F.sum(F.abs(F.col("q") - F.col("before")))).first()[0]
        forget(base)
        base = after.select("name", "sink", F.col("q").alias("p"))
        base.loomgraph_path = after.loomgraph_path
        if change is None or change < tolerance:
            break
    return base.select("name", F.col("p").alias("pagerank"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def usable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The edges that a walk from starts(name) may take: others have a source that is no start and that no edge leads to."""
    live = starts.select(F.col("name").alias("src")).unionAll(edges.select(F.col("dst").alias("src"))).distinct()
    return edges.join(live, "src", "left_semi")


def depths(nodes: DataFrame, edges: DataFrame, entries: DataFrame, edge_types: Sequence[str] | None = None) -> DataFrame:
    """name, api_depth: fewest hops from an entry (name) along edges other than SEMANTIC; 99 where there is no way.

    The distinct edges among the nodes that a way may take are written once; a hop writes its front only, and goes on from that.  Fronts are put
    together now and then, so that plans stay short on deep graphs.
    """
    kept = edges
    if "edge_type" in edges.columns:
        kept = kept.where(F.col("edge_type").isin(*edge_types)) if edge_types else kept.where(F.col("edge_type") != S.SEMANTIC)
    names = nodes.select("name").distinct()
    kept = usable(kept.select("src", "dst"), entries)
    kept = written(kept.distinct().join(names, F.col("dst") == F.col("name"), "left_semi"), "steps")
    front = written(names.join(entries.select("name").distinct(), "name", "left_semi").select("name", F.lit(0).alias("api_depth")), "front")
    fronts, hop = [front], 0
    while front.take(1):
        hop += 1
        new = kept.join(front, F.col("src") == F.col("name")).select(F.col("dst").alias("name")).distinct().join(union_all(fronts), "name", "left_anti")
        front = written(new.select("name", F.lit(hop).alias("api_depth")), "front")
        fronts.append(front)
        if len(fronts) > 16:
            fronts, old = [written(union_all(fronts), "seen")], fronts
            forget(*old[:-1])
    forget(kept)
    return names.join(union_all(fronts), "name", "left").select("name", F.coalesce("api_depth", F.lit(S.UNREACHABLE)).alias("api_depth"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node of the edges (src, dst), but for the least ones.

    Large-star: each node's greater neighbours are linked to its least neighbour; small-star: its lesser ones and itself.
    Each round is a table in the shared folder; the rounds end when one changes nothing (they number as the logarithm of
    the nodes, squared at most).
    """
    edges, state = written(edges.where("src <> dst").distinct(), "edges"), None
    while True:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("least"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst").union(low.select("src", F.col("least").alias("dst"))).distinct()
        after = written(small, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        forget(edges)
        edges = after
        if now == state or not now[0]:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        state = now


def candidates(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("node_type") == S.FUNCTION) & (F.coalesce(F.col("scope_level"), F.lit(0)) == 0))


def entry_points(nodes: DataFrame, edges: DataFrame, project_type: str = "script", exported: DataFrame | None = None) -> DataFrame:
    """name of the entry points: exported names of a package, else nodes that no CALLS edge leads to, else all."""
    found = candidates(nodes).select("name")
    if project_type == "package" and exported is not None:
        named = found.withColumn("bare", F.regexp_replace("name", "^.*::", ""))
        hit = named.join(exported.select(F.col("name").alias("bare")).distinct(), "bare", "left_semi").select("name")
        if hit.take(1):
            return hit
    called = edges.where(F.col("edge_type") == S.CALLS).select(F.col("dst").alias("name")).distinct()
    roots = found.join(called, "name", "left_anti")
    return roots if roots.take(1) else found


def in_degree(nodes: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    """name, n: edges of a type that lead to each node, 0 included."""
    counts = edges.where(F.col("edge_type") == edge_type).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n"))
    return nodes.select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def neighbours(edges: DataFrame, names: Sequence[str], direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """name, neighbour: distinct ends of the edges of some nodes."""
    if edge_type:
        edges = edges.where(F.col("edge_type") == edge_type)
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.where(F.col(a).isin(*names)).select(F.col(a).alias("name"), F.col(b).alias("neighbour")).distinct()


def hub_subgraph(nodes: DataFrame, edges: DataFrame, n_hubs: int = 15) -> tuple[DataFrame, DataFrame]:
    """The function nodes of highest PageRank, their neighbours either way, and the edges among these."""
    hubs = nodes.where(F.col("node_type") == S.FUNCTION).orderBy(F.desc_nulls_last("pagerank"), "name").limit(n_hubs).select("name")
    out = edges.join(F.broadcast(hubs), F.col("src") == F.col("name"), "left_semi").select(F.col("dst").alias("name"))
    into = edges.join(F.broadcast(hubs), F.col("dst") == F.col("name"), "left_semi").select(F.col("src").alias("name"))
    kept = hubs.union(out).union(into).distinct()
    inner = edges.join(kept, F.col("src") == F.col("name"), "left_semi").join(kept, F.col("dst") == F.col("name"), "left_semi")
    return nodes.join(kept, "name", "left_semi"), inner


def without_files(nodes: DataFrame, edges: DataFrame, files: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of some files and the edges at them."""
    gone = nodes.where(F.col("file").isin(*files)).select("name")
    left = edges.join(gone, F.col("src") == F.col("name"), "left_anti").join(gone, F.col("dst") == F.col("name"), "left_anti")
    return nodes.where(~F.coalesce(F.col("file").isin(*files), F.lit(False))), left


def with_nodes(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with nodes and edges added; edges without both ends are left out, a name that is there already wins."""
    fresh = new_nodes.join(nodes.select("name"), "name", "left_anti")
    every = nodes.unionByName(fresh, allowMissingColumns=True)
    names = every.select("name")
    ok = new_edges.join(names, F.col("src") == names["name"], "left_semi").join(names, F.col("dst") == names["name"], "left_semi")
    return every, edges.unionByName(ok, allowMissingColumns=True)
