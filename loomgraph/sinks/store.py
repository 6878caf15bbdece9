"""Graphs as Parquet with metadata, and as a relational file; trace logs."""

from __future__ import annotations

import json
import os
import re
import sqlite3
import time
import uuid
import warnings
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import schema as S
from loomgraph.operators import feedback
from loomgraph.plans.build import PART_PATH, Graph
from loomgraph.session import written

VERSION = "2"
FOLDER = ".loomgraph"


# --- the cache ---


def cache_dir(g: Graph | None = None, folder: str | None = None) -> str:
    """The folder given; else that of the graph's project; else one in the working folder."""
    if folder:
        return folder
    root = (g.meta.get("project_root") or "").strip() if g is not None else ""
    return os.path.join(root or os.getcwd(), FOLDER)


def yaml_lines(values: dict) -> list[str]:
    """One 'key: "value"' a pair; None is ~, of a list its first value."""
    out = []
    for key, value in values.items():
        if isinstance(value, (list, tuple)):
            value = value[0] if value else None
        quoted = "~" if value is None else '"' + str(value).replace('"', '\\"') + '"'
        out.append(f"{key}: {quoted}")
    return out


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """Writes a small file to any file system that Spark knows."""
    target, fs = _path(spark, path)
    if not overwrite and fs.exists(target):
        return
    fs.setWriteChecksum(False)  # people edit these files
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str | None:
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return None
    fs.setVerifyChecksum(False)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def metadata(g: Graph, n_nodes: int, n_edges: int) -> dict[str, str]:
    own = {"package_version": VERSION, "node_count": str(n_nodes), "edge_count": str(n_edges), "created_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
    return own | {k: str(v) for k, v in g.meta.items() if isinstance(v, (str, int, float, bool))}


def save(g: Graph, folder: str | None = None) -> str:
    """Parquet tables of nodes and edges, meta.json and config.yml; overwrites them, and adds a .gitignore if there is none."""
    folder = cache_dir(g, folder)
    spark = g.nodes.sparkSession
    tables = {"nodes": g.nodes, "edges": g.edges, **{f"parts/{name}": df for name, df in g.parts.items()}}
    # what is read from this very folder is copied before it is overwritten
    tables = {name: written(df, "copy") if any(f"{folder}/" in f for f in df.inputFiles()) else df for name, df in tables.items()}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    meta = metadata(g, spark.read.parquet(f"{folder}/nodes").count(), spark.read.parquet(f"{folder}/edges").count())
    _put(spark, f"{folder}/meta.json", json.dumps(g.meta | {"version": VERSION}, indent=1))
    _put(spark, f"{folder}/config.yml", "\n".join(yaml_lines(meta)) + "\n")
    _put(spark, f"{folder}/.gitignore", "nodes/\nedges/\nparts/\n!config.yml\n!traces.jsonl\n", overwrite=False)
    return folder


def cached_version(spark: SparkSession, folder: str) -> str | None:
    """The version that config.yml tells; a warning if it isn't this one."""
    text = _get(spark, f"{folder}/config.yml")
    found = re.search(r'^package_version:\s*"?([^"\n]+)"?', text or "", re.M)
    if not found:
        return None
    if found.group(1).strip() != VERSION:
        warnings.warn(f"the cache is of version {found.group(1)}, this is {VERSION}: build it anew", stacklevel=3)
    return found.group(1).strip()


def load(spark: SparkSession, folder: str) -> Graph | None:
    """The saved graph with weights of its traces brought up to date; None, with a warning, without a cache; an error if its
    parts don't make a graph."""
    text = _get(spark, f"{folder}/meta.json")
    if text is None:
        warnings.warn(f"no cache in {folder}", stacklevel=2)
        return None
    try:
        meta = json.loads(text)
        nodes, edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    except Exception as e:
        raise ValueError(f"the cache in {folder} can't be read: {e}") from e
    if not isinstance(meta, dict) or "name" not in nodes.columns or not {"src", "dst", "edge_type"} <= set(edges.columns):
        raise ValueError(f"what is in {folder} isn't a graph")
    meta["version_matches"] = str(cached_version(spark, folder) == VERSION)
    meta.pop("version", None)
    there = [name for name in PART_PATH if _path(spark, f"{folder}/parts/{name}")[1].exists(_path(spark, f"{folder}/parts/{name}")[0])]
    parts = {name: spark.read.parquet(f"{folder}/parts/{name}") for name in there} if len(there) == len(PART_PATH) else {}
    g = Graph(S.normalize(nodes, S.NODE_SCHEMA), edges, meta, parts)
    log = f"{folder}/traces.jsonl"
    return with_trace_weights(g, read_traces(spark, log)) if _path(spark, log)[1].exists(_path(spark, log)[0]) else g


def with_trace_weights(g: Graph, traces: DataFrame, now: str | None = None) -> Graph:
    """The graph with its nodes' task_trace_weight from a log; without rows in it as it was."""
    if not traces.take(1):
        return g
    rows = traces.withColumn("line", F.monotonically_increasing_id())
    rows = feedback.keep_first(rows, ["session_id", "ts"], ["line"]).withColumn("created_at", feedback.parse_time(F.col("ts")))
    found = feedback.trace_weights(g.nodes, rows, now or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"))
    nodes = g.nodes.drop("task_trace_weight").join(found.withColumnRenamed("weight", "task_trace_weight"), "name", "left")
    return Graph(S.normalize(nodes, S.NODE_SCHEMA), g.edges, g.meta, g.parts)


# --- the relational export ---

#: Table: its columns (name, kind), and its further clauses.
TABLES = {
    "nodes": ([("node_id", "TEXT PRIMARY KEY"), *[(c, "TEXT") for c in ("name", "file", "node_type", "signature", "body_text", "roxygen_text")], *[(c, "REAL") for c in ("complexity", "pagerank", "task_weight")], *[(c, "TEXT") for c in ("embedding", "pkg_name", "pkg_version")], ("entry_point", "INTEGER NOT NULL DEFAULT 0"), ("api_depth", "INTEGER NOT NULL DEFAULT 99")], ""),
    "edges": ([("edge_id", "INTEGER PRIMARY KEY AUTOINCREMENT"), ("source_id", "TEXT NOT NULL"), ("target_id", "TEXT NOT NULL"), ("edge_type", "TEXT"), ("weight", "REAL"), ("metadata", "TEXT")], ", UNIQUE (source_id, target_id, edge_type)"),
    "task_traces": ([("trace_id", "INTEGER PRIMARY KEY AUTOINCREMENT"), ("query", "TEXT"), ("nodes_json", "TEXT"), ("polarity", "REAL DEFAULT 0.0"), ("session_id", "TEXT"), ("created_at", "TEXT")], ""),
    "graph_metadata": ([("key", "TEXT PRIMARY KEY"), ("value", "TEXT")], ""),
    "tfidf_vocab": ([("term", "TEXT PRIMARY KEY"), ("idf", "REAL"), ("doc_count", "INTEGER"), ("term_count", "INTEGER")], ""),
}
INDEXES = {"edges_of_source": "edges (source_id)", "edges_to_target": "edges (target_id)", "edges_of_type": "edges (edge_type)", "nodes_of_name": "nodes (name)"}
ONCE = ("trace_once", "task_traces (query, session_id, created_at)")


def ddl() -> str:
    made = [f"CREATE TABLE IF NOT EXISTS {t} ({', '.join(f'{c} {k}' for c, k in columns)}{more});" for t, (columns, more) in TABLES.items()]
    made += [f"CREATE INDEX IF NOT EXISTS {name} ON {on};" for name, on in INDEXES.items()]
    return "\n".join([*made, f"CREATE UNIQUE INDEX IF NOT EXISTS {ONCE[0]} ON {ONCE[1]};"])


def relational_nodes(nodes: DataFrame) -> DataFrame:
    """The rows of the table nodes; columns that the graph hasn't are null."""
    extra = {c: F.col(c).cast("string") if c in nodes.columns else F.lit(None).cast("string") for c in ("pkg_name", "pkg_version")}
    n = S.normalize(nodes.withColumns(extra), T.StructType([*S.NODE_SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in extra]]))
    number = lambda c: F.col(c).cast("double").alias(c)
    return n.select(
        F.col("name").alias("node_id"), "name", "file", "node_type", "signature", "body_text", "roxygen_text", number("complexity"), number("pagerank"), F.col("task_trace_weight").cast("double").alias("task_weight"), F.to_json("embedding").alias("embedding"),
        *extra, F.coalesce(F.col("entry_point").cast("int"), F.lit(0)).alias("entry_point"), F.coalesce("api_depth", F.lit(S.UNREACHABLE)).alias("api_depth"),
    )


def relational_edges(edges: DataFrame) -> DataFrame:
    """One row a (source_id, target_id, edge_type), of the greatest weight; other columns are packed as JSON."""
    extra = [c for c in edges.columns if c not in ("src", "dst", "weight", "edge_type")]
    packed = F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")
    rows = edges.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "edge_type", "weight", packed.alias("metadata"))
    return rows.groupBy("source_id", "target_id", "edge_type").agg(F.max("weight").alias("weight"), F.max_by("metadata", "weight").alias("metadata"))


def relational_vocabulary(terms: DataFrame) -> DataFrame:
    """terms(term, doc_count, term_count, and idf if there is one).  Without an idf column, or where all are null:
    ln(1 + N / max(doc_count, 1)), N the sum of all doc_counts (or the number of terms, if that is 0)."""
    have = "idf" in terms.columns and terms.where("idf IS NOT NULL").take(1)
    if have:
        return terms.select("term", F.col("idf").cast("double").alias("idf"), "doc_count", "term_count")
    n = terms.agg(F.sum("doc_count").alias("s"), F.count("*").alias("c")).select(F.when(F.coalesce("s", F.lit(0)) > 0, F.col("s")).otherwise(F.col("c")).alias("n"))
    idf = F.log(1 + F.col("n") / F.greatest(F.coalesce("doc_count", F.lit(0)), F.lit(1)))
    return terms.crossJoin(F.broadcast(n)).select("term", idf.alias("idf"), "doc_count", "term_count")


def relational_traces(traces: DataFrame) -> DataFrame:
    return traces.select("query", F.to_json("nodes").alias("nodes_json"), F.coalesce("polarity", F.lit(0.0)).alias("polarity"), "session_id", F.col("ts").alias("created_at"))


def relational(g: Graph, vocabulary: DataFrame | None = None, traces: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of the export as DataFrames: for clients that read Parquet or SQL through Spark."""
    out = {"nodes": relational_nodes(g.nodes), "edges": relational_edges(g.edges)}
    if vocabulary is not None:
        out["tfidf_vocab"] = relational_vocabulary(vocabulary)
    if traces is not None:
        out["task_traces"] = relational_traces(traces)
    return out


def views(g: Graph, **more: DataFrame) -> None:
    """The tables of the export as temporary views, for spark.sql."""
    for name, df in relational(g, **more).items():
        df.createOrReplaceTempView(name)


def export_sqlite(g: Graph, path: str, vocabulary: DataFrame | None = None, traces: DataFrame | None = None) -> str:
    """Replaces nodes, edges, metadata and vocabulary (an empty table replaces nothing), adds traces that aren't there.

    Rows come to the driver one at a time: the file is for clients of one machine, not for large graphs.
    """
    con = sqlite3.connect(path)
    with con:
        con.executescript(ddl())

        def put(table: str, df: DataFrame, replace: bool = True) -> int:
            columns = df.columns
            rows = iter(df.toLocalIterator(prefetchPartitions=False))
            first = next(rows, None)
            if first is None:
                return 0
            if replace:
                con.execute(f"DELETE FROM {table}")
            sql = f"INSERT OR IGNORE INTO {table} ({', '.join(columns)}) VALUES ({', '.join('?' * len(columns))})"
            n = 1
            con.execute(sql, tuple(first))
            for row in rows:
                con.execute(sql, tuple(row))
                n += 1
            return n

        counts = {t: put(t, df, t != "task_traces") for t, df in relational(g, vocabulary, traces).items()}
        con.execute("DELETE FROM graph_metadata")
        con.executemany("INSERT INTO graph_metadata VALUES (?, ?)", sorted(metadata(g, counts["nodes"], counts["edges"]).items()))
    con.close()
    return path


# --- traces ---


def trace_root(g: Graph) -> str | None:
    return (g.meta.get("project_root") or "").strip() or None


def trace_file(root: str | None) -> str | None:
    """The log of a project (its folder is made); None without a project."""
    if root is None:
        return None
    os.makedirs(os.path.join(root, FOLDER), exist_ok=True)
    return os.path.join(root, FOLDER, "traces.jsonl")


def session_id() -> str:
    """That of the environment, or else the time that the process has run."""
    return os.environ.get("LOOMGRAPH_SESSION_ID") or f"{time.process_time():.6f}-{uuid.uuid4().hex[:8]}"


def _names(text: str | None) -> list[str]:
    try:
        found = json.loads(text or "[]")
    except ValueError:
        return []
    return [str(x) for x in found] if isinstance(found, list) else [str(found)]


def read_sqlite_traces(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Traces by time; None if there is no such file or table.  Names that aren't JSON are none."""
    if not path or not os.path.exists(path):
        return None
    try:
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        rows = con.execute("SELECT created_at, query, nodes_json, polarity, session_id FROM task_traces ORDER BY created_at").fetchall()
        con.close()
    except sqlite3.Error:
        return None
    return spark.createDataFrame([(a, b, _names(c), d, e) for a, b, c, d, e in rows], S.TRACE_SCHEMA)


def append_line(path: str, entry: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a") as f:
        f.write(json.dumps(entry) + "\n")


def log_trace(path: str, query: str, nodes: list[str], polarity: float = 0.0, session: str | None = None, now: str | None = None) -> None:
    """Appends a JSON line."""
    if not isinstance(query, str) or not query or not -1 <= polarity <= 1:
        raise ValueError("a query and a polarity from -1 to 1 are needed")
    ts = now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    append_line(path, {"ts": ts, "query": query, "nodes": nodes, "polarity": polarity, "session_id": session or session_id()})


def log_answer(g: Graph, query: str, answer: str) -> str | None:
    """Appends the question and the first 500 characters of the answer to the project's log; its path, None without a project."""
    path = trace_file(trace_root(g))
    if path is not None:
        append_line(path, {"ts": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "query": query, "nodes": [], "response": answer[:500], "session_id": session_id()})
    return path


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of a log; lines that aren't JSON are dropped."""
    if "://" not in path:
        if not os.path.exists(path):
            return spark.createDataFrame([], S.TRACE_SCHEMA)
        path = "file://" + os.path.abspath(path)
    lines = spark.read.text(path)
    return lines.where("trim(value) <> ''").select(F.from_json("value", S.TRACE_SCHEMA).alias("t")).select("t.*").where("ts IS NOT NULL OR query IS NOT NULL")
