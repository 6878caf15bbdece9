"""Rendering of nodes and contexts, reports and graph drawings as text."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph import schema as S
from loomgraph.functions.text import one_liner


def full_context(nodes: DataFrame) -> DataFrame:
    """name, context: the doc block, then the signature with the body in braces; without a signature the body."""
    doc = F.regexp_replace(F.coalesce("roxygen_text", F.lit("")), r"^\s+|\s+$", "")
    body, sig = F.coalesce("body_text", F.lit("")), F.coalesce("signature", F.lit(""))
    code = F.when(sig == "", body).when(body == "", F.concat(sig, F.lit(" {}"))).otherwise(F.concat(sig, F.lit(" {\n"), body, F.lit("\n}")))
    return nodes.select("name", F.concat_ws("\n", F.when(doc != "", doc), F.when(code != "", code)).alias("context"))


def compressed_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, context: signature (or name), the doc's first line, the names it calls and that call it, in order of names."""
    calls = edges.where(F.col("edge_type") == S.CALLS).select("src", "dst")  # the sets leave out what is there twice
    bare_dst, bare_src = F.regexp_replace("dst", "^.*::", ""), F.regexp_replace("src", "^.*::", "")
    out = calls.groupBy(F.col("src").alias("name")).agg(F.array_join(F.sort_array(F.collect_set(bare_dst)), ", ").alias("callees"))
    into = calls.groupBy(F.col("dst").alias("name")).agg(F.array_join(F.sort_array(F.collect_set(bare_src)), ", ").alias("callers"))
    line = one_liner(F.coalesce("roxygen_text", F.lit("")))
    sig = F.when(F.coalesce("signature", F.lit("")) != "", F.col("signature")).otherwise(F.col("name"))
    text = F.concat_ws("\n", sig, F.when(line != "", line), F.when(F.col("callees").isNotNull(), F.concat(F.lit("Calls: "), "callees")), F.when(F.col("callers").isNotNull(), F.concat(F.lit("Called by: "), "callers")))
    return nodes.join(out, "name", "left").join(into, "name", "left").select("name", text.alias("context"))


def assemble(project: str, query: str, seed: tuple[str, str], hits: Sequence[tuple[str, str, str]], history: Sequence[str] = (), version: str = "") -> str:
    """The context document: seed (name, full text), hits (name, node type, compressed text), the last three of history."""
    if not seed[0]:
        return f"# {project}: no relevant code found for: {query}\n"
    parts = [("CORE FUNCTIONS", [seed[1]])]
    parts.append(("SUPPORTING FUNCTIONS", [t for _, kind, t in hits if kind in (S.FUNCTION, S.TESTFILE, None)]))
    parts.append(("PACKAGES", [t for _, kind, t in hits if kind == S.PACKAGE]))
    last = list(history)[-3:]
    parts.append(("RECENT TASKS", [f"{i}. {t}" for i, t in enumerate(last, 1)]))
    body = "\n\n".join(f"## {title}\n" + "\n\n".join(texts) for title, texts in parts if texts)
    rules = "## CONSTRAINTS\nUse the functions above where they do what is needed; don't invent others."
    tokens = math.ceil(len(body) / 3.5)
    return f"# Project: {project}\n# Version: {version}\n# Tokens: ~{tokens}\n# Query: {query}\n\n{body}\n\n{rules}\n"


def truncated(text: str, budget: int) -> str:
    cut = text[: math.ceil(3.5 * budget)]
    at = cut.rfind("\n")
    return cut[: at + 1] if at >= 0 else cut


def recent(rows: DataFrame, key: str, order: str, text: str, k: int = 3) -> DataFrame:
    """key, no (from 1), text of the last k rows of each key: rows are numbered by key, none is gathered."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    n = F.count("*").over(Window.partitionBy(key))
    last = rows.select(key, F.col(text).alias("text"), back.alias("back"), n.alias("n")).where(F.col("back") <= k)
    return last.select(key, (F.least("n", F.lit(k)) - F.col("back") + 1).cast("int").alias("no"), "text")


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def top_functions(nodes: DataFrame, k: int = 15) -> DataFrame:
    """name, pagerank of the function nodes (a null type counts as one) of highest PageRank (null as 0); ties by name."""
    pool = nodes.where(F.col("node_type").isNull() | (F.col("node_type") == S.FUNCTION))
    return pool.select("name", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")).orderBy(F.desc("pagerank"), "name").limit(k)


def conventions(names: DataFrame) -> DataFrame:
    """One row: n names(name), the shares of those with an underscore, a dot and a hump within, and the style they show.

    Of more than five names, over 40 per cent with an underscore or over 20 with a hump show snake case or camel case if the
    other doesn't hold; else over 40 with a dot show dotted names.
    """
    shown = names.where("name <> ''")
    parts = {kind: F.coalesce(F.avg(F.col("name").rlike(p).cast("int")), F.lit(0.0)).alias(kind) for kind, p in (("snake", "_"), ("dot", r"\."), ("camel", "[a-z][A-Z]"))}
    out = shown.agg(F.count("*").alias("n"), *parts.values())
    snake, dot, camel = F.col("snake") > 0.4, F.col("dot") > 0.4, F.col("camel") > 0.2
    return out.withColumn("style", F.when(F.col("n") <= 5, "unknown").when(snake & ~camel, "snake_case").when(camel & ~snake, "camelCase").when(dot, "dot.case").otherwise("mixed"))


def pipe_counts(lines: DataFrame) -> DataFrame:
    """One row: how many lines(line) have each pipe, and the one that is used more ('none' without any)."""
    native, magrittr = (F.coalesce(F.sum(F.col("line").contains(p).cast("long")), F.lit(0)) for p in ("|>", "%>%"))
    out = lines.agg(native.alias("native"), magrittr.alias("magrittr"))
    return out.withColumn("style", F.when(F.col("native") + F.col("magrittr") == 0, "none").when(F.col("native") >= F.col("magrittr"), "native |>").otherwise("magrittr %>%"))


def instructions(project: str, kind: str, nodes: DataFrame, edges: DataFrame, packages: Sequence[tuple[str, str]] = (), max_tokens: int = 2000, pipe: str = "none", tested: bool = False) -> str:
    """A Markdown report on the project, cut to max_tokens; packages are (name, version)."""
    if max_tokens < 100:
        raise ValueError("max_tokens must be 100 at least")
    n_nodes, n_edges = nodes.count(), edges.count()
    top = top_functions(nodes).collect()  # fifteen rows
    style = conventions(nodes.select(F.regexp_replace("name", "^.*::", "").alias("name"))).first().style
    habits = [f"Names: {style}"] if style not in ("unknown", "mixed") else []
    habits += ["Tests: testthat"] if tested else []
    habits += [f"Pipe: {pipe}"] if pipe != "none" else []
    lines = [f"# Instructions for {project}", "", "## Overview", f"- Type: {kind}", f"- Nodes: {n_nodes}, edges: {n_edges}", "", "## Main functions"]
    lines += [f"- `{r['name']}` ({round(r.pagerank, 6)})" for r in top] or ["None."]
    lines += ["", "## Conventions", *([f"- {h}" for h in habits] or ["- None that stand out."]), "", "## Dependencies", *([f"- {p}: {v}" for p, v in packages] or ["None."])]
    text = "\n".join(lines) + "\n"
    if len(text) > math.ceil(3.5 * max_tokens):
        text = truncated(text, max_tokens) + "\n_Cut to the token budget._\n"
    return text


def shown_context(found: dict) -> str:
    """Seed, first nodes and tokens of a context (build.ask()'s result)."""
    names = [n for n, _, _ in found["nodes"]]
    few = ", ".join(names[:5]) + (", ..." if len(names) > 5 else "")
    return f"<context of {found['seed_node']}: {len(names)} nodes ({few}), {found['tokens_used']} of {found['budget_tokens']} tokens>"


def context_summary(found: dict) -> dict:
    """Tokens, the share of the budget that is used (per cent), and the five nodes of highest score."""
    ranked = sorted(((n, s) for n, s, _ in found["nodes"]), key=lambda x: -x[1])[:5]
    used, budget = found["tokens_used"], found["budget_tokens"]
    return {"tokens_used": used, "budget_tokens": budget, "utilisation": round(100 * used / max(budget, 1), 1), "seed_node": found["seed_node"], "top": [(n, round(s, 4)) for n, s in ranked]}


def node_context(name: str, nodes: DataFrame, edges: DataFrame, mode: str = "auto") -> str:
    """A node's text: compressed for packages or if asked for, else in full ('auto', 'full'); a warning and '' without it."""
    if mode not in ("auto", "full", "compressed"):
        raise ValueError(mode)
    one = nodes.where(F.col("name") == name)
    row = one.select("node_type").first()
    if row is None:
        warnings.warn(f"no node {name}", stacklevel=2)
        return ""
    short = mode == "compressed" or row.node_type == S.PACKAGE
    return (compressed_context(one, edges) if short else full_context(one)).first().context


COLOURS = {S.FUNCTION: "#4C78A8", S.PACKAGE: "#F58518", S.TESTFILE: "#54A24B"}
EDGE_COLOURS = {S.IMPORTS: "#F58518", S.TESTS: "#54A24B"}


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line_no order: a Graphviz drawing; width by PageRank from 0.4 to 2 (0.8 if all are equal, 0.3 for packages and tests);
    functions are put together by the part of their name before '::'; edges are coloured by type."""
    span = nodes.agg(F.min("pagerank").alias("low"), F.max("pagerank").alias("high"))
    width = F.when(F.col("node_type") != S.FUNCTION, 0.3).when(F.col("high") > F.col("low"), 0.4 + 1.6 * (F.col("pagerank") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.8)

    def of(colours: dict, column: str, other: str) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for kv in colours.items() for x in kv])[F.col(column)], F.lit(other))

    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '["\\\\]', "_"), F.lit('"'))
    a = nodes.crossJoin(F.broadcast(span)).select(F.concat(F.lit("  "), quoted(F.col("name")), F.lit(" [label="), quoted(F.regexp_replace("name", "^.*::", "")), F.format_string(", width=%.2f, fillcolor=\"%s\"];", width, of(COLOURS, "node_type", "#999999"))).alias("line"), F.lit(1).alias("k"), F.col("name").alias("key"))
    group = F.when(F.col("name").contains("::"), F.regexp_extract("name", "^(.*?)::", 1)).otherwise("other")
    members = nodes.where(F.col("node_type") == S.FUNCTION).groupBy(group.alias("key")).agg(F.array_join(F.sort_array(F.collect_list(quoted(F.col("name")))), "; ").alias("names"))
    c = members.select(F.concat(F.lit("  subgraph "), quoted(F.concat(F.lit("cluster_"), "key")), F.lit(" { label="), quoted(F.col("key")), F.lit("; "), "names", F.lit("; }")).alias("line"), F.lit(2).alias("k"), "key")
    b = edges.select(F.concat(F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.format_string(" [label=\"%s\", color=\"%s\"];", F.col("edge_type"), of(EDGE_COLOURS, "edge_type", "#888888"))).alias("line"), F.lit(3).alias("k"), F.concat_ws(" ", "src", "dst", "edge_type").alias("key"))
    ends = nodes.sparkSession.createDataFrame([("digraph project {", 0, ""), ("}", 4, "")], "line string, k int, key string")
    return a.union(c).union(b).union(ends).orderBy("k", "key")
