"""From a project's files to its graph, kept up to date and asked for contexts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph import schema as S
from loomgraph.functions import embedders
from loomgraph.functions import text as X
from loomgraph.functions.embedders import Embedder
from loomgraph.operators import context, edges, graph, relevance, semantic, tfidf
from loomgraph.session import ship, written
from loomgraph.sources import files, rparser

RECORD = "id string, name string, file string, line_start int, line_end int, signature string, body_text string, roxygen_text string, complexity int, calls_list array<string>, scope_level int"


@dataclass
class Graph:
    """parts: what was found in each file, by name (extracted()), for updates."""

    nodes: DataFrame
    edges: DataFrame
    meta: dict[str, str] = field(default_factory=dict)
    parts: dict[str, DataFrame] = field(default_factory=dict)

    def summary(self) -> dict:
        return {
            "nodes": {r.node_type: r.n for r in context.counts(self.nodes, "node_type").collect()},
            "edges": {r.edge_type: r.n for r in context.counts(self.edges, "edge_type").collect()},
            "top": [(r["name"], r.pagerank) for r in context.top_functions(self.nodes, 5).collect()],
            "meta": dict(self.meta),
        }

    def __str__(self) -> str:
        return f"<graph {self.meta.get('project_name', '')}: {self.nodes.count()} nodes, {self.edges.count()} edges>"


def function_records(sources: DataFrame) -> DataFrame:
    """sources(path, text): RECORD of each definition; files that can't be parsed have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for frame in batches:
            rows = [r for p, t in zip(frame.path, frame.text) for r in rparser.extract(p, t)]
            yield pd.DataFrame(rows, columns=names)

    return sources.mapInPandas(run, RECORD)


def called_symbols(sources: DataFrame) -> DataFrame:
    """sources(path, text): path, and all names called in each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"path": frame.path, "symbols": [rparser.symbols_called(t) for t in frame.text]})

    return sources.mapInPandas(run, "path string, symbols array<string>")


def numbered(records: DataFrame) -> DataFrame:
    """The records in order of files and lines with node_pos; of several with one id, the first."""
    ranked = records.withColumn("node_pos", F.row_number().over(Window.orderBy("file", "line_start", "name")).cast("long"))  # definitions of one project
    first = ranked.groupBy("id").agg(F.min("node_pos").alias("node_pos"))
    return ranked.join(first, ["id", "node_pos"], "left_semi")


#: The column of each part that has the file.
PART_PATH = {"records": "file", "imports": "path", "symbols": "path", "methods": "path", "classes": "path"}


def extracted(spark: SparkSession, paths: Sequence[str], tests: Sequence[str]) -> dict[str, DataFrame]:
    """What the files hold, a table a kind, each row with its file: definitions, imported packages, names that tests call,
    methods and classes with parents.  A file's rows depend on that file only."""
    sources = written(files.texts(spark, list(paths)), "sources")
    lines = sources.select(F.col("path").alias("stem"), F.explode(F.split("text", "\n")).alias("line"))
    tested = sources.where(F.col("path").isin(*tests)) if tests else sources.where("1 = 0")
    return {
        "records": function_records(sources),
        "imports": edges.import_edges(lines).select(F.col("src").alias("path"), "dst", "source"),
        "symbols": called_symbols(tested),
        "methods": sources.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"""setMethod\s*\(\s*["']([^"']+)["']"""), F.lit(1))).alias("name")),
        "classes": edges.extends_pairs(sources, "path"),
    }


def build(spark: SparkSession, path: str = ".", package_nodes: bool = True, threshold: float = S.SEMANTIC_THRESHOLD, cap: int = S.SEMANTIC_CAP, min_cochanges: int = S.MIN_COCHANGES, embedder: Embedder | None = None, cache: str | None = None) -> Graph:
    """Definitions, imports, tests, co-changes, dispatch and inheritance as a graph with PageRank, entry points, depths and
    similarities.  PageRank leaves SEMANTIC edges out.

    Similarities are those of the embedder's vectors (kept in the folder `cache`, if one is given), which also stand in the
    nodes; without an embedder, or if its service doesn't answer, those of TF-IDF.
    """
    ship(spark)
    project = files.detect(path)
    parts = {name: written(df, name) for name, df in extracted(spark, project.r_files, project.test_files).items()}
    return assembled(spark, project, parts, package_nodes, threshold, cap, min_cochanges, embedder, cache)


def assembled(spark: SparkSession, project: files.Project, parts: dict[str, DataFrame], package_nodes: bool, threshold: float, cap: int, min_cochanges: int, embedder: Embedder | None = None, cache: str | None = None) -> Graph:
    """The graph of what was found in the files."""
    functions = written(numbered(parts["records"]), "functions")
    named = functions.select("id", "name", "node_pos", "calls_list", "file")
    short = named.select("id", "name", "node_pos")
    calls = edges.call_edges(named)
    fields = [(os.path.splitext(os.path.basename(d))[0], v) for d in [files.find_description(project.root)] if d for k, v in files.read_dcf(d).items() if k in ("Imports", "Depends")]
    imports = parts["imports"].select(files.stem(F.col("path")).alias("src"), "dst", F.lit(1.0).alias("weight"), "source")
    if fields:
        deps = edges.dependency_field(spark.createDataFrame(fields, "stem string, value string"))
        imports = imports.union(deps.select("stem", "package", F.lit(1.0), F.lit("description")))
    imports = imports.distinct()
    tested = edges.test_edges(short, parts["symbols"].select(files.stem(F.col("path")).alias("stem"), "symbols"))
    relative = named.select("id", F.regexp_replace("file", "^" + re.escape(project.root.rstrip("/") + "/"), "").alias("file"))
    together = edges.cochange_edges(files.git_log(spark, project.root), relative, min_cochanges)
    dispatch = edges.dispatch_edges(short, parts["methods"].select("name"))
    extends = edges.extends_of(parts["classes"], short)
    node = functions.withColumnRenamed("id", "node_id").drop("name").withColumnRenamed("node_id", "name").withColumn("node_type", F.lit(S.FUNCTION))
    nodes = S.normalize(node, S.NODE_SCHEMA)
    for found, kind in ((imports.select(F.col("dst").alias("name")) if package_nodes else None, S.PACKAGE), (tested.select(F.col("src").alias("name")), S.TESTFILE)):
        if found is not None:
            new = found.distinct().join(nodes.select("name"), "name", "left_anti").withColumn("node_type", F.lit(kind)).withColumn("node_pos", F.lit(10**12 if kind == S.PACKAGE else 2 * 10**12).cast("long"))
            nodes = nodes.unionByName(S.normalize(new, S.NODE_SCHEMA))
    nodes = written(nodes, "nodes")
    kept = written(edges.assemble(nodes, **{S.CALLS: calls, S.IMPORTS: imports, S.TESTS: tested, S.CO_CHANGES: together, S.DISPATCHES_ON: dispatch, S.EXTENDS: extends}), "edges")
    embedder = embedders.usable(embedder)
    meta = {"project_name": project.description.get("Package", os.path.basename(project.root)), "project_root": project.root, "project_type": project.type, "build_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "embed_method": embedder.name if embedder else "tfidf"}
    meta |= {"package_nodes": str(package_nodes), "threshold": str(threshold), "cap": str(cap), "min_cochanges": str(min_cochanges)}
    g = Graph(nodes, kept, meta, parts)
    return finish(embedded(g, embedder, cache) if embedder else g, threshold, cap)


def embedded(g: Graph, embedder: Embedder, cache: str | None = None) -> Graph:
    """The graph with the vectors of its functions; texts that the cache has aren't sent."""
    docs = _docs(g.nodes.where(F.col("node_type") == S.FUNCTION)).withColumnRenamed("doc_id", "id")
    vectors, new = embedders.embed(docs, embedder, embedders.load_cache(g.nodes.sparkSession, cache) if cache else None)
    if cache:
        embedders.save_cache(new, cache)
    of = F.when(F.col("node_type") == S.FUNCTION, F.col("node_pos"))
    nodes = g.nodes.drop("embedding").join(vectors, of == F.col("id"), "left").drop("id")
    return Graph(written(S.normalize(nodes, S.NODE_SCHEMA), "nodes"), g.edges, g.meta, g.parts)


def finish(g: Graph, threshold: float = S.SEMANTIC_THRESHOLD, cap: int = S.SEMANTIC_CAP) -> Graph:
    """The columns and edges that follow from the others: PageRank, entry points, depths, SEMANTIC edges."""
    spark = g.nodes.sparkSession
    kept = g.edges.where(F.col("edge_type") != S.SEMANTIC)
    ranks = graph.pagerank(g.nodes, kept)
    names = files.exported(g.meta.get("project_root", "")) if g.meta.get("project_type") == "package" else None
    exported = spark.createDataFrame([(n,) for n in names], "name string") if names else None
    entries = written(graph.entry_points(g.nodes, kept, g.meta.get("project_type", "script"), exported), "entries")
    depth = graph.depths(g.nodes, kept, entries)
    nodes = g.nodes.drop("pagerank", "entry_point", "api_depth").join(ranks, "name", "left").join(depth, "name", "left").join(entries.withColumn("entry_point", F.lit(True)), "name", "left")
    nodes = nodes.withColumn("entry_point", F.coalesce("entry_point", F.lit(False))).withColumn("task_trace_weight", F.coalesce("task_trace_weight", F.lit(0.0)))
    nodes = written(S.normalize(nodes, S.NODE_SCHEMA), "nodes")
    every = kept.select("src", "dst", "weight", "edge_type")
    pool = nodes.where(F.col("node_type") == S.FUNCTION)
    dense = pool.where("embedding IS NOT NULL")
    pairs = written(semantic.pairs(dense, threshold, "node_pos") if dense.take(1) else text_pairs(pool, threshold), "pairs")
    if pairs.take(1):
        ids = pool.select("name", "node_pos")
        found = semantic.capped(pairs, cap).join(ids.select(F.col("node_pos").alias("src"), F.col("name").alias("a")), "src").join(ids.select(F.col("node_pos").alias("dst"), F.col("name").alias("b")), "dst")
        every = every.union(found.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight", F.lit(S.SEMANTIC).alias("edge_type")))
    return Graph(nodes, written(every, "edges"), dict(g.meta), g.parts)


def _docs(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_pos").alias("doc_id"), X.node_text(F.col("signature"), F.col("body_text"), F.col("roxygen_text")).alias("text"))


def text_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """a < b (node_pos), score: TF-IDF cosines over the threshold, by a join on shared terms."""
    docs = _docs(nodes)
    posts = tfidf.postings(docs)
    w = tfidf.weighted(posts, tfidf.vocabulary(posts, docs.count()))
    norm = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))
    both = w.alias("x").join(w.alias("y"), F.expr("x.term = y.term AND x.doc < y.doc"))
    return both.groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("score")).where(F.col("score") >= threshold)


def update(g: Graph, spark: SparkSession, changed: Sequence[str], embedder: Embedder | None = None, cache: str | None = None) -> Graph:
    """The graph after files changed, came or went: the same as a new build, but only these files are read and parsed (and, with
    a cache, only new texts embedded).  A graph without parts, as of an older cache, is built anew."""
    if not changed:
        raise ValueError("names of changed files are needed")
    meta = g.meta
    options = {"package_nodes": meta.get("package_nodes", "True") == "True", "threshold": float(meta.get("threshold", S.SEMANTIC_THRESHOLD)), "cap": int(meta.get("cap", S.SEMANTIC_CAP)), "min_cochanges": int(meta.get("min_cochanges", S.MIN_COCHANGES))}
    if not g.parts:
        return build(spark, meta["project_root"], embedder=embedder, cache=cache, **options)
    project = files.detect(meta["project_root"])
    touched = {os.path.abspath(os.path.join(project.root, p)) for p in changed}
    again = [p for p in project.r_files if p in touched]
    found = extracted(spark, again, [p for p in project.test_files if p in touched])
    parts = {name: written(old.where(~F.col(PART_PATH[name]).isin(*touched)).unionByName(found[name]), name) for name, old in g.parts.items()}
    return assembled(spark, project, parts, embedder=embedder, cache=cache, **options)


def similarities(g: Graph, pool: DataFrame, query: str, embedder: Embedder | None = None) -> DataFrame:
    """name, sem of the nodes: by the vectors of the embedder the graph was built with, else by TF-IDF."""
    if embedder is not None and embedder.name == g.meta.get("embed_method"):
        (vector,) = embedder([query])
        asked = F.array(*[F.lit(float(x)) for x in vector])
        return pool.where(F.col("embedding").isNotNull()).select("name", X.cosine(F.col("embedding"), asked).alias("sem"))
    found = tfidf.similar(_docs(pool), query).select(F.col("doc").alias("node_pos"), F.col("score").alias("sem"))
    return found.join(pool.select("name", "node_pos"), "node_pos").select("name", "sem")


def ask(g: Graph, query: str, start: str | None = None, budget: int = S.BUDGET, min_relevance: float = S.MIN_RELEVANCE, max_nodes: int = S.MAX_NODES, embedder: Embedder | None = None) -> dict:
    """The context of a query: seed, nodes with scores and tokens, and the document."""
    spark = g.nodes.sparkSession
    if not g.nodes.take(1):
        return {"nodes": [], "context_string": context.assemble(g.meta.get("project_name", ""), query, ("", ""), []), "tokens_used": 0, "budget_tokens": budget, "seed_node": None}
    pool = g.nodes.where(F.col("node_type") == S.FUNCTION)
    sims = written(similarities(g, pool, query, embedder), "similar")
    if start is None:
        start = relevance.seed(g.nodes, sims).first()["name"]
    elif not g.nodes.where(F.col("name") == start).take(1):
        raise ValueError(f"no node {start}")
    static = relevance.scores(g.nodes, sims).select("name", "static")
    full, short = context.full_context(g.nodes), context.compressed_context(g.nodes, g.edges)
    priced = g.nodes.select("name", "node_pos", "node_type").join(static, "name").join(short.withColumnRenamed("context", "short"), "name").join(full.withColumnRenamed("context", "full"), "name")
    priced = written(priced.select("*", X.token_count(F.col("short")).alias("cost"), X.token_count(F.col("full")).alias("full_cost")), "priced")
    asked = spark.createDataFrame([("q", start)], "query_id string, start string")
    hits = relevance.query_contexts(asked, priced, g.edges, max_nodes=max_nodes, budget=budget, min_relevance=min_relevance).orderBy("rank").collect()
    texts = {r["name"]: r for r in priced.join(F.broadcast(spark.createDataFrame([(h["name"],) for h in hits], "name string")), "name").collect()}
    seed_text = texts[start].full
    if texts[start].full_cost > budget:
        seed_text = seed_text[: -(-7 * budget // 2)]
    document = context.assemble(g.meta.get("project_name", ""), query, (start, seed_text), [(h["name"], texts[h["name"]].node_type, texts[h["name"]].short) for h in hits[1:]])
    used = spark.createDataFrame([(document,)], "t string").select(X.token_count(F.col("t"))).first()[0]
    if used > budget:
        document, used = context.truncated(document, budget), budget
    return {"nodes": [(h["name"], h.score, h.tokens) for h in hits], "context_string": document, "tokens_used": used, "budget_tokens": budget, "seed_node": start}
