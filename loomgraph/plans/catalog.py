"""Queries over the driver's tables and their SQL, for the operators outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.functions import text as X
from loomgraph.operators import context, edges, feedback, graph, relevance, semantic, tfidf
from loomgraph.plans.build import Graph
from loomgraph.session import read, written
from loomgraph.sinks import store
from loomgraph.sources.tables import FK_SQL, fk_edges, fk_nodes
from loomgraph.streaming import traces as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: len(x) >= 2)"
POSTS = f"""t AS (SELECT doc_id AS doc, {TOKENS} AS ts FROM documents), l AS (SELECT doc, len(ts) AS doc_len, unnest(ts) AS term FROM t),
p AS (SELECT doc, term, count(*) AS cnt, first(doc_len) AS doc_len FROM l GROUP BY doc, term),
v AS (SELECT term, count(*) AS doc_count, sum(cnt) AS term_count, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM p GROUP BY term),
w AS (SELECT p.doc, p.term, p.cnt / p.doc_len::DOUBLE * v.idf AS w FROM p JOIN v ON p.term = v.term)"""
SEARCH = "the relation of erning and tion hand"


def _docs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text")


# --- text and similarity ---


@query(f"WITH {POSTS} SELECT term, CAST(doc_count AS BIGINT) AS doc_count, CAST(term_count AS BIGINT) AS term_count FROM v")
def tokenize_counts(spark, sf):
    return tfidf.term_counts(_docs(spark, sf)).select("term", "doc_count", "term_count")


@query(f"WITH {POSTS} SELECT term, CAST(doc_count AS BIGINT) AS doc_count, CAST(term_count AS BIGINT) AS term_count, round(idf, 6) AS idf FROM v WHERE term_count >= 2 AND doc_count >= 2")
def tfidf_vocab(spark, sf):
    d = _docs(spark, sf)
    return tfidf.with_idf(tfidf.term_counts(d), d.count(), 2, 2).withColumn("idf", F.round("idf", 6)).select("term", "doc_count", "term_count", "idf")


@query(f"WITH {POSTS}, r AS (SELECT doc AS doc_id, term, round(w, 9) AS w FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank FROM r) SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, round(w, 6) AS w FROM k WHERE rank <= 3")
def tfidf_topk_terms(spark, sf):
    return tfidf.top_terms(_docs(spark, sf), 3).select(F.col("doc").alias("doc_id"), "rank", "term", F.round("w", 6).alias("w"))


@query(
    f"""WITH {POSTS}, q0 AS (SELECT list_filter(string_split_regex('{SEARCH}', '[^a-z0-9]+'), lambda x: len(x) >= 2) AS ts), q1 AS (SELECT unnest(ts) AS term, len(ts) AS n FROM q0),
q AS (SELECT q1.term, count(*) / first(n)::DOUBLE * first(idf) AS qw FROM q1 JOIN v ON q1.term = v.term GROUP BY q1.term),
s AS (SELECT doc, sum(w * coalesce(qw, 0)) AS dot, sqrt(sum(w * w)) AS norm FROM w LEFT JOIN q ON w.term = q.term GROUP BY doc)
SELECT doc AS doc_id, round(dot / (norm * (SELECT sqrt(sum(qw * qw)) FROM q)), 6) AS score FROM s WHERE dot > 0 ORDER BY 2 DESC, 1 LIMIT 10"""
)
def query_similarity_topk(spark, sf):
    s = tfidf.similar(_docs(spark, sf), SEARCH).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), "doc_id").limit(10)


PAIRS = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id < b.vec_id)"


@query(f"WITH {PAIRS} SELECT a, b, round(score, 6) AS score FROM c WHERE score >= 0.3")
def semantic_pairs(spark, sf):
    return semantic.pairs(read(spark, sf, "embeddings"), 0.3).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {PAIRS}, d AS (SELECT a AS id, b AS partner, round(score, 6) AS score FROM c WHERE score >= 0.3 UNION ALL SELECT b, a, round(score, 6) FROM c WHERE score >= 0.3),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, partner) AS rank FROM d) SELECT id, CAST(rank AS INTEGER) AS rank, partner, score FROM k WHERE rank <= 3"""
)
def semantic_topk_per_node(spark, sf):
    return semantic.nearest(read(spark, sf, "embeddings"), 0.3, 3)


@query()
def semantic_edges_capped(spark, sf):
    return semantic.semantic_edges(read(spark, sf, "embeddings"), 0.3, 5).withColumn("weight", F.round("weight", 6))


@query("SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS header_tokens FROM documents")
def token_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", X.header_tokens(F.col("text")).alias("header_tokens"))


@query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(\p{L})[.'':](\p{L})', '\1\2', 'g'), '(\p{L})[.'':](\p{L})', '\1\2', 'g') AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(\p{N})[.,;''](\p{N})', '\1\2', 'g'), '(\p{N})[.,;''](\p{N})', '\1\2', 'g') AS x FROM a)
SELECT doc_id, CAST(ceil(len(regexp_extract_all(x, '[\p{L}\p{N}_]+')) * 1.3) AS BIGINT) AS tokens FROM b"""
)
def word_token_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query("WITH s AS (SELECT doc_id, substring(text, 1, 350) AS s FROM documents), c AS (SELECT doc_id, s, regexp_extract(s, '^([\\s\\S]*\\n)', 1) AS h FROM s) SELECT doc_id, CASE WHEN h <> '' THEN h ELSE s END AS cut FROM c")
def truncate_to_budget(spark, sf):
    return _docs(spark, sf).select("doc_id", X.truncate(F.col("text"), 100).alias("cut"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'thing|nation|error')) AS INTEGER) AS score FROM documents WHERE len(regexp_extract_all(lower(text), 'thing|nation|error')) > 0 ORDER BY score DESC, doc_id LIMIT 50")
def keyword_search(spark, sf):
    d = _docs(spark, sf).select("doc_id", X.search_score("thing nation error", F.col("text")).alias("score"))
    return d.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


@query("SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '\\b(if|for|while|repeat|tryCatch|switch)\\b', 1)) AS INTEGER) AS complexity FROM documents")
def complexity(spark, sf):
    return _docs(spark, sf).select("doc_id", X.complexity(F.col("text")).alias("complexity"))


@query(
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^#''\\s?', ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '@')) AS g FROM documents)
SELECT doc_id, coalesce(g[1], '') AS line FROM l"""
)
def one_liner(spark, sf):
    return _docs(spark, sf).select("doc_id", X.one_liner(F.col("text")).alias("line"))


# --- edges ---

CALL_NODES = """cn AS (SELECT 'customer/' || c_custkey || '::' || c_name AS id, c_name AS name, n_name AS called FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'supplier/' || s_suppkey || '::' || s_name, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'nation/' || n_nationkey || '::' || n_name, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'region/' || r_regionkey || '::' || r_name, r_name, NULL FROM region)"""


def _call_nodes(spark, sf):
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")

    def part(df, table, k, name, called, pos):
        return df.select(F.concat(F.lit(f"{table}/"), F.col(k).cast("string"), F.lit("::"), F.col(name)).alias("id"), F.col(name).alias("name"), called.alias("calls_list"), (F.lit(pos * 10**12) + F.col(k).cast("long")).alias("node_pos"))

    twice = F.array(F.concat(F.lit("geo::"), F.col("n_name")), F.concat(F.lit("geo::"), F.col("n_name")), F.lit("base::print"))
    out = part(read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "customer", "c_custkey", "c_name", twice, 2)
    out = out.union(part(read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "s_suppkey", "s_name", twice, 3))
    out = out.union(part(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "nation", "n_nationkey", "n_name", F.array(F.concat(F.lit("geo:::"), F.col("r_name"))), 1))
    return out.union(part(region, "region", "r_regionkey", "r_name", F.array().cast("array<string>"), 0))


@query(f"WITH {CALL_NODES} SELECT DISTINCT a.id AS src, b.id AS dst, 1.0::DOUBLE AS weight FROM cn a JOIN cn b ON a.called = b.name")
def call_edges(spark, sf):
    return edges.call_edges(_call_nodes(spark, sf))


@query(
    """WITH n AS (SELECT 'part:' || p_partkey AS id, p_brand AS name, p_partkey AS pos FROM part), f AS (SELECT name, arg_min(id, pos) AS id FROM n GROUP BY name)
SELECT DISTINCT 'supplier_' || l_suppkey AS src, f.id AS dst, 1.0::DOUBLE AS weight FROM lineitem JOIN part ON l_partkey = p_partkey JOIN f ON p_brand = f.name"""
)
def first_match_edges(spark, sf):
    part = read(spark, sf, "part")
    nodes = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("node_pos"))
    used = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    tests = used.groupBy("l_suppkey").agg(F.array_union(F.collect_set("p_brand"), F.array(F.lit("expect_equal"))).alias("symbols"))
    return edges.test_edges(nodes, tests.select(F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("stem"), "symbols"))


@query(
    """WITH p AS (SELECT 'supplier_' || s_suppkey AS src, replace(n_name, ' ', '.') AS n, replace(r_name, ' ', '_') AS r, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT src, n AS dst, 1.0::DOUBLE AS weight, 'library' AS source FROM p WHERE s_suppkey % 3 <> 0 UNION ALL SELECT DISTINCT src, r, 1.0, 'qualified' FROM p
UNION ALL SELECT DISTINCT 'DESCRIPTION', replace(n_name, ' ', '.'), 1.0, 'description' FROM nation"""
)
def import_edges(spark, sf):
    """A source a supplier, with library and require calls (every third has a second argument, and doesn't count) and qualified
    names; a metadata field with versions."""
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    s = read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    name, far = F.regexp_replace("n_name", " ", "."), F.regexp_replace("r_name", " ", "_")
    call = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("library("), name, F.lit(", quietly = TRUE)"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit('x <- require( "'), name, F.lit('" )'))).otherwise(F.concat(F.lit("library("), name, F.lit(")")))
    lines = s.select(F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("stem"), F.explode(F.array(call, F.concat(F.lit("f("), far, F.lit(":::run(1), "), far, F.lit("::stop)")), F.lit("no packages: here"))).alias("line"))
    field = nation.agg(F.concat_ws(",", F.lit("R (>= 4.1)"), F.array_join(F.collect_list(F.concat(name, F.lit(" (>= 1.0)"))), ",\n")).alias("value")).select(F.lit("DESCRIPTION").alias("stem"), "value")
    return edges.import_edges(lines, edges.dependency_field(field))


@query("SELECT 'nation:' || n_nationkey AS src, 'region:' || r_regionkey AS dst, 1.0::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey")
def extends_edges(spark, sf):
    """A class a nation, by one of three ways of definition, of the class of its region."""
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    key, name = F.col("n_nationkey") % 3, F.concat(F.lit('"'), F.col("n_name"), F.lit('"'))
    child, parent = F.regexp_replace("r_name", " ", "_"), F.concat(F.lit('"'), F.regexp_replace("r_name", " ", "_"), F.lit('"'))
    text = F.when(key == 0, F.concat(F.lit("setClass("), name, F.lit(", representation(x = 'numeric'),\n contains = c("), parent, F.lit("))"))).when(key == 1, F.concat(F.lit("R6Class("), name, F.lit(",\n inherit = "), child, F.lit(")"))).otherwise(F.concat(F.lit("setRefClass("), name, F.lit(", contains = "), parent, F.lit(")")))
    sources = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).agg(F.array_join(F.collect_list(text), "\n").alias("text"))
    nodes = nation.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("node_pos"))
    return edges.extends_edges(sources, nodes.union(region.select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")), F.regexp_replace("r_name", " ", "_"), F.col("r_regionkey").cast("long") + 1000)))


COCHANGE = """c AS (SELECT DISTINCT l_orderkey AS k, p_brand AS f FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT count(DISTINCT k) AS total FROM c),
p AS (SELECT a.f AS f1, b.f AS f2, count(*) AS n FROM c a JOIN c b ON a.k = b.k AND a.f < b.f GROUP BY 1, 2),
m AS (SELECT avg(n) AS lim FROM p), co AS (SELECT f1 AS src, f2 AS dst, least(1.0, n / total::DOUBLE) AS weight FROM p, t, m WHERE n >= ceil(lim) UNION ALL SELECT f2, f1, least(1.0, n / total::DOUBLE) FROM p, t, m WHERE n >= ceil(lim))"""


def _cochange(spark, sf):
    part = read(spark, sf, "part")
    commits = read(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("commit_id"), F.col("p_brand").alias("file"))
    nodes = part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("file")).distinct()
    pairs = written(edges.cochange_pairs(commits, nodes), "pairs")
    least = int(-(-pairs.agg(F.avg("n")).first()[0] // 1))  # one number: the mean count, so that the threshold follows the data
    return edges.edges_of_pairs(pairs, nodes, least)


@query(f"WITH {COCHANGE} SELECT src, dst, round(weight, 6) AS weight FROM co")
def cochange_edges(spark, sf):
    return _cochange(spark, sf).withColumn("weight", F.round("weight", 6))


@query(f"WITH {COCHANGE}, v(b) AS (VALUES ('Brand#11'), ('Brand#22'), ('Brand#33')), u AS (SELECT src AS name, weight FROM co WHERE dst IN (SELECT b FROM v) UNION ALL SELECT dst, weight FROM co WHERE src IN (SELECT b FROM v)) SELECT name, round(avg(weight), 6) AS cochange FROM u GROUP BY name")
def cochange_score(spark, sf):
    e = _cochange(spark, sf).withColumn("edge_type", F.lit(S.CO_CHANGES))
    return relevance.cochange_scores(e, ["Brand#11", "Brand#22", "Brand#33"]).withColumn("cochange", F.round("cochange", 6))


@query("WITH n AS (SELECT 'part:' || p_partkey AS id, p_type AS name, p_partkey AS pos FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS rn, first_value(id) OVER (PARTITION BY name ORDER BY pos) AS dst FROM n) SELECT id AS src, dst, 1.0::DOUBLE AS weight FROM r WHERE rn > 1")
def dispatch_edges(spark, sf):
    nodes = read(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("name"), F.col("p_partkey").alias("node_pos"))
    return edges.dispatch_edges(nodes, nodes.select("name"))


@query(f"WITH {FK_SQL}, n AS (SELECT name FROM fk_nodes WHERE file <> 'part') SELECT src, dst, weight, 'CALLS' AS edge_type FROM fk_edges WHERE src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n)")
def assemble_edges(spark, sf):
    nodes = fk_nodes(spark, sf).where("file <> 'part'")
    return edges.assemble(nodes, CALLS=fk_edges(spark, sf))


@query(f"WITH {FK_SQL} SELECT file AS kind, count(*) AS n FROM fk_nodes GROUP BY file")
def node_type_counts(spark, sf):
    return context.counts(fk_nodes(spark, sf), "file").withColumnRenamed("file", "kind")


@query(f"WITH {FK_SQL} SELECT 'CALLS' AS edge_type, count(*) AS n FROM fk_edges")
def edge_type_counts(spark, sf):
    return context.counts(fk_edges(spark, sf), "edge_type")


# --- graph algorithms ---

TRADE = """tr AS (SELECT c_nationkey AS s, s_nationkey AS d, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
sh AS (SELECT s, d, w / sum(w) OVER (PARTITION BY s) AS share FROM tr), nn AS (SELECT n_nationkey AS k, k IN (SELECT s FROM tr) AS has FROM nation), p0 AS MATERIALIZED (SELECT k, has, 1.0 / count(*) OVER () AS p FROM nn)"""


def _rank_sql(rounds: int) -> str:
    steps = ", ".join(f"p{i} AS MATERIALIZED (SELECT n.k, n.has, 0.15 / (SELECT count(*) FROM nn) + 0.85 * (coalesce(g.x, 0) + (SELECT coalesce(sum(p), 0) FROM p{i - 1} WHERE NOT has) / (SELECT count(*) FROM nn)) AS p FROM nn n LEFT JOIN (SELECT d, sum(p * share) AS x FROM sh JOIN p{i - 1} ON s = k GROUP BY d) g ON g.d = n.k)" for i in range(1, rounds + 1))
    return f"WITH {TRADE}, {steps} SELECT 'nation:' || k AS name, round(p, 8) AS pagerank FROM p{rounds}"


def _trade(spark, sf):
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    nation = lambda c: F.concat(F.lit("nation:"), F.col(c).cast("string"))
    return lines.groupBy(nation("c_nationkey").alias("src"), nation("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("weight")).withColumn("edge_type", F.lit(S.CALLS))


@query(_rank_sql(20))
def pagerank(spark, sf):
    nodes = read(spark, sf, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("name"))
    return graph.pagerank(nodes, _trade(spark, sf), iterations=20, tolerance=0.0).withColumn("pagerank", F.round("pagerank", 8))


@query(_rank_sql(5))
def pagerank_distributed(spark, sf):
    nodes = read(spark, sf, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("name"))
    return graph.pagerank(nodes, _trade(spark, sf), iterations=5, tolerance=0.0, small=-1).withColumn("pagerank", F.round("pagerank", 8))


@query(
    f"""WITH RECURSIVE {FK_SQL}, walk(name, d) AS (SELECT name, 0 FROM fk_nodes WHERE file = 'supplier' UNION SELECT dst, d + 1 FROM walk JOIN fk_edges ON src = walk.name WHERE d < 6), m AS (SELECT name, min(d) AS d FROM walk GROUP BY name)
SELECT n.name, CAST(coalesce(m.d, 99) AS INTEGER) AS api_depth FROM fk_nodes n LEFT JOIN m ON n.name = m.name"""
)
def api_depth(spark, sf):
    nodes = fk_nodes(spark, sf)
    return graph.depths(nodes, fk_edges(spark, sf), nodes.where("file = 'supplier'"))


@query(f"WITH {FK_SQL} SELECT name FROM fk_nodes WHERE name NOT IN (SELECT dst FROM fk_edges)")
def entry_points_zero_indegree(spark, sf):
    return graph.entry_points(fk_nodes(spark, sf).withColumn("scope_level", F.lit(0)), fk_edges(spark, sf))


@query(f"WITH {FK_SQL} SELECT name FROM fk_nodes WHERE regexp_replace(name, '^.*::', '') IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 2)")
def entry_points_exported(spark, sf):
    exported = read(spark, sf, "nation").where("n_regionkey = 2").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("name"))
    return graph.entry_points(fk_nodes(spark, sf).withColumn("scope_level", F.lit(0)), fk_edges(spark, sf), "package", exported)


@query(f"WITH {FK_SQL}, d AS (SELECT dst, count(*) AS n FROM fk_edges GROUP BY dst) SELECT name, CAST(coalesce(n, 0) AS BIGINT) AS n FROM fk_nodes LEFT JOIN d ON name = dst")
def in_degrees(spark, sf):
    return graph.in_degree(fk_nodes(spark, sf), fk_edges(spark, sf), S.CALLS)


@query(f"WITH {FK_SQL} SELECT DISTINCT dst AS name, src AS neighbour FROM fk_edges WHERE dst IN ('nation:3', 'supplier:7')")
def callers(spark, sf):
    return graph.neighbours(fk_edges(spark, sf), ["nation:3", "supplier:7"], "in")


@query(f"WITH {FK_SQL} SELECT DISTINCT src AS name, dst AS neighbour FROM fk_edges WHERE src IN ('orders:7', 'customer:12')")
def callees(spark, sf):
    return graph.neighbours(fk_edges(spark, sf), ["orders:7", "customer:12"])


@query(
    f"""WITH {FK_SQL}, r AS (SELECT 'customer:' || c_custkey AS name, c_acctbal AS pr FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_acctbal FROM supplier),
h AS (SELECT name FROM r ORDER BY pr DESC, name LIMIT 15), k AS (SELECT name FROM h UNION SELECT dst FROM fk_edges WHERE src IN (SELECT name FROM h) UNION SELECT src FROM fk_edges WHERE dst IN (SELECT name FROM h))
SELECT src, dst, weight FROM fk_edges WHERE src IN (SELECT name FROM k) AND dst IN (SELECT name FROM k)"""
)
def neighborhood_subgraph(spark, sf):
    ranks = read(spark, sf, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_acctbal").alias("pagerank")).union(read(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")), "s_acctbal"))
    nodes = fk_nodes(spark, sf).join(ranks, "name", "left")
    return graph.hub_subgraph(nodes, fk_edges(spark, sf))[1].select("src", "dst", "weight")


# --- relevance, traversal, rendering ---

SUPPLIER_NODES = "sn AS (SELECT 'supplier:' || s_suppkey AS name, s_acctbal AS pr, CASE WHEN s_nationkey % 5 = 0 THEN 99 ELSE s_nationkey % 5 END AS depth, (s_suppkey % 10) / 10.0::DOUBLE AS tw, s_suppkey AS pos FROM supplier)"


def _supplier_nodes(spark, sf):
    d = F.col("s_nationkey") % 5
    return read(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("name"), F.lit(S.FUNCTION).alias("node_type"), F.col("s_acctbal").alias("pagerank"), F.when(d == 0, 99).otherwise(d).alias("api_depth"), ((F.col("s_suppkey") % 10) / 10).alias("task_trace_weight"), (d == 1).alias("entry_point"), F.col("s_suppkey").alias("node_pos"))


@query(
    f"""WITH {SUPPLIER_NODES}, m AS (SELECT min(pr) AS lo, max(pr) AS hi FROM sn) SELECT name, round(0.15 * CASE WHEN depth >= 99 THEN 0.5 ELSE 1 / (1 + 0.2 * depth) END + 0.15 * tw + 0.10 * CASE WHEN hi > lo THEN (pr - lo) / (hi - lo) ELSE 0.5 END, 6) AS score FROM sn, m"""
)
def relevance_scores(spark, sf):
    return relevance.scores(_supplier_nodes(spark, sf)).select("name", F.round("score", 6).alias("score"))


@query(
    f"""WITH {SUPPLIER_NODES}, m AS (SELECT min(pr) AS lo, max(pr) AS hi FROM sn), sc AS (SELECT name, static, static + 0.10 * CASE WHEN pos % 4 = 0 THEN 0 WHEN pos % 4 = 3 THEN 1 ELSE (pos % 4) / 3.0 END AS score FROM (
SELECT name, pos, 0.5 * greatest(0.0, least(1.0, CASE WHEN pos % 7 = 0 THEN 0 ELSE (pos % 7 - 2) / 4.0 END)) + 0.15 * CASE WHEN depth >= 99 THEN 0.5 ELSE 1 / (1 + 0.2 * depth) END + 0.15 * tw + 0.10 * CASE WHEN hi > lo THEN (pr - lo) / (hi - lo) ELSE 0.5 END AS static FROM sn, m))
SELECT name, round(least(1.0, score), 6) AS score, round(static, 6) AS static FROM sc"""
)
def relevance_scores_full(spark, sf):
    """All five signals: similarities from -0.25 to 1 (none for every seventh node), co-changes to over 1 (none for every fourth)."""
    nodes = _supplier_nodes(spark, sf)
    pos = F.col("node_pos")
    sims = nodes.where(pos % 7 != 0).select("name", ((pos % 7 - 2) / 4).alias("sem"))
    together = nodes.where(pos % 4 != 0).select("name", F.when(pos % 4 == 3, 1.5).otherwise((pos % 4) / 3).alias("cochange"))
    return relevance.scores(nodes, sims, together).select("name", F.round("score", 6).alias("score"), F.round("static", 6).alias("static"))


@query("WITH m AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT s_suppkey, round(CASE WHEN hi > lo THEN (s_acctbal - lo) / (hi - lo) ELSE 0.5 END, 6) AS signal FROM supplier, m")
def minmax_pagerank(spark, sf):
    s = read(spark, sf, "supplier")
    m = s.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    return s.crossJoin(F.broadcast(m)).select("s_suppkey", F.round(relevance.pagerank_signal(F.col("s_acctbal"), F.col("lo"), F.col("hi")), 6).alias("signal"))


@query(f"WITH {SUPPLIER_NODES} SELECT name FROM sn WHERE depth = 1 ORDER BY pr DESC, pos LIMIT 1")
def seed_selection(spark, sf):
    return relevance.seed(_supplier_nodes(spark, sf))


def context_nodes(spark, sf):
    """All keys as nodes with scores and costs, and all foreign keys as edges."""
    text = F.concat("name", "signature")
    nodes = fk_nodes(spark, sf).select("name", (F.lit(0.15) + F.pmod(F.xxhash64("name"), F.lit(100)) / 200).alias("static"), X.header_tokens(text).alias("cost"), (X.header_tokens(text) * 3).alias("full_cost"), "node_pos")
    return nodes, fk_edges(spark, sf)


@query()
def query_context_nodes(spark, sf):
    """The contexts of the orders whose key is divisible by 100, in the graph of all keys."""
    nodes, e = context_nodes(spark, sf)
    name = F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string"))
    starts = read(spark, sf, "orders").where("o_orderkey % 100 = 0").select(name.alias("query_id"), name.alias("start"))
    return relevance.query_contexts(starts, nodes, e, budget=120, max_nodes=8)


@query(
    f"""WITH {FK_SQL}, e AS (SELECT DISTINCT src, dst FROM fk_edges), o AS (SELECT src AS name, string_agg(dst, ', ' ORDER BY dst) AS c FROM e GROUP BY src), i AS (SELECT dst AS name, string_agg(src, ', ' ORDER BY src) AS c FROM e GROUP BY dst)
SELECT n.name, concat_ws(chr(10), n.signature, 'Calls: ' || o.c, 'Called by: ' || i.c) AS context FROM fk_nodes n LEFT JOIN o ON n.name = o.name LEFT JOIN i ON n.name = i.name"""
)
def node_context_compressed(spark, sf):
    return context.compressed_context(fk_nodes(spark, sf).withColumn("roxygen_text", F.lit(None).cast("string")), fk_edges(spark, sf))


@query("SELECT 'supplier:' || s_suppkey AS name, s_acctbal AS pagerank FROM supplier ORDER BY s_acctbal DESC, name LIMIT 15")
def top_functions_report(spark, sf):
    return context.top_functions(_supplier_nodes(spark, sf))


@query(
    r"""WITH n AS (SELECT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '.') ELSE replace(p_name, ' ', '_') END AS name FROM part), a AS (SELECT count(*) AS n, avg(CASE WHEN contains(name, '_') THEN 1 ELSE 0 END) AS snake, avg(CASE WHEN contains(name, '.') THEN 1 ELSE 0 END) AS dot, avg(CASE WHEN regexp_matches(name, '[a-z][A-Z]') THEN 1 ELSE 0 END) AS camel FROM n WHERE name <> '')
SELECT n, round(snake, 6) AS snake, round(dot, 6) AS dot, round(camel, 6) AS camel, CASE WHEN n <= 5 THEN 'unknown' WHEN snake > 0.4 AND camel <= 0.2 THEN 'snake_case' WHEN camel > 0.2 AND snake <= 0.4 THEN 'camelCase' WHEN dot > 0.4 THEN 'dot.case' ELSE 'mixed' END AS style FROM a"""
)
def naming_conventions(spark, sf):
    key = F.col("p_partkey") % 4
    names = read(spark, sf, "part").select(F.when(key == 0, F.col("p_name")).when(key == 1, F.replace("p_name", F.lit(" "), F.lit("."))).otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"))
    return context.conventions(names).select("n", F.round("snake", 6).alias("snake"), F.round("dot", 6).alias("dot"), F.round("camel", 6).alias("camel"), "style")


@query(
    """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT CAST(count(*) FILTER (WHERE contains(line, '|>')) AS BIGINT) AS native, CAST(count(*) FILTER (WHERE contains(line, '%>%')) AS BIGINT) AS magrittr FROM l)
SELECT *, CASE WHEN native + magrittr = 0 THEN 'none' WHEN native >= magrittr THEN 'native |>' ELSE 'magrittr %>%' END AS style FROM c"""
)
def pipe_style(spark, sf):
    return context.pipe_counts(_docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("line")))


# --- feedback ---

NOW = "2024-01-31 00:00:00"


def _traces(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("line_no"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("created_at"), F.array("event_type").alias("nodes"), (F.col("value") / 250 - 1).alias("polarity"))


@query(
    f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS k FROM events), s AS (SELECT event_type AS name, sum(pow(2.0, -greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400e6) / 30) * (1 + least(1.0, greatest(-1.0, value / 250 - 1)))) AS acc FROM d WHERE k = 1 GROUP BY event_type)
SELECT name, round(acc / max(acc) OVER (), 6) AS weight FROM s"""
)
def task_trace_weights(spark, sf):
    t = feedback.keep_first(_traces(spark, sf), ["session_id", "created_at"], ["line_no"])
    nodes = read(spark, sf, "events").select(F.col("event_type").alias("name")).distinct()
    return feedback.trace_weights(nodes, t, NOW).withColumn("weight", F.round("weight", 6))


@query("SELECT c_custkey, round(least(1.0, greatest(0.0, CASE WHEN c_mktsegment = 'BUILDING' THEN (c_acctbal / 10000 * 0.99) * (1 - 0.3) + 0.3 ELSE c_acctbal / 10000 * 0.99 END)), 6) AS weight FROM customer")
def ema_weights(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.round(feedback.ema(F.col("c_acctbal") / 10000, F.col("c_mktsegment") == "BUILDING"), 6).alias("weight"))


@query("WITH h AS (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'click') SELECT e.event_id AS line_no, round(CASE WHEN k <= 3 THEN 0.75 ELSE value / 250 - 1 END, 6) AS polarity FROM events e LEFT JOIN h ON e.event_id = h.event_id")
def polarity_rewrite(spark, sf):
    return feedback.rewrite_polarity(_traces(spark, sf), ["click"], 0.75).select("line_no", F.round("polarity", 6).alias("polarity"))


@query("WITH u AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id FROM events UNION ALL SELECT user_id, CAST(ts AS DATE), event_id + 1000000 FROM events) SELECT user_id, min(event_id) AS event_id, CAST(count(*) AS BIGINT) AS copies FROM u GROUP BY user_id, d")
def trace_dedup(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.to_date("ts").alias("d"), "event_id")
    u = e.union(e.select("user_id", "d", F.col("event_id") + 1000000))
    first = feedback.keep_first(u, ["user_id", "d"], ["event_id"])
    return first.join(u.groupBy("user_id", "d").agg(F.count("*").alias("copies")), ["user_id", "d"]).select("user_id", "event_id", "copies")


@query("SELECT md5(CAST(o_orderkey AS VARCHAR)) || '00000000' AS commit_id, 'R/f' || CAST(l_partkey % 50 AS VARCHAR) || '.R' AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def commit_log_parse(spark, sf):
    commit = F.concat(F.md5(F.col("o_orderkey").cast("string")), F.lit("00000000"))
    o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    head = o.select(F.pmod("o_orderkey", F.lit(64)).alias("log"), F.posexplode(F.array(commit, F.lit(""))).alias("i", "line"), F.col("o_orderkey").alias("o")).select("log", (F.col("o") * 100 + F.col("i")).alias("line_no"), "line")
    body = li.select(F.pmod("l_orderkey", F.lit(64)).alias("log"), (F.col("l_orderkey") * 100 + 10 + F.col("l_linenumber")).alias("line_no"), F.concat(F.lit("R/f"), (F.col("l_partkey") % 50).cast("string"), F.lit(".R")).alias("line"))
    return edges.parse_log(head.union(body.join(o.select(F.col("o_orderkey").alias("ok")), F.expr("cast((line_no - 10) / 100 as bigint) = ok"), "left_semi")))


@query("SELECT event_type AS name, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events GROUP BY event_type")
def session_stream_counts(spark, sf):
    return stream.replayed_counts(spark, f"{sf}/events.parquet")


# --- incremental maintenance, export ---


@query(f"WITH {FK_SQL} SELECT src, dst, weight FROM fk_edges WHERE src NOT LIKE 'part:%'")
def incremental_update(spark, sf):
    nodes, e = fk_nodes(spark, sf), fk_edges(spark, sf)
    left_nodes, left_edges = graph.without_files(nodes, e, ["nation"])
    back = nodes.where("file = 'nation'")
    new = e.where("src LIKE 'nation:%' OR dst LIKE 'nation:%'")
    return graph.with_nodes(left_nodes, left_edges, back, new)[1].select("src", "dst", "weight")


@query()
def export_nodes_json(spark, sf):
    """The nodes table of the export, each with its whole vector as JSON (number formats keep SQL from matching it)."""
    e = read(spark, sf, "embeddings")
    return store.relational_nodes(e.select(F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("name"), F.lit(S.FUNCTION).alias("node_type"), F.col("embedding").cast("array<double>").alias("embedding")))


@query(
    f"""WITH {FK_SQL}, t AS (SELECT src, dst, weight, 'a' AS note FROM fk_edges UNION ALL SELECT src, dst, weight + 1, 'b' FROM fk_edges WHERE dst LIKE 'nation:%')
SELECT src AS source_id, dst AS target_id, 'CALLS' AS edge_type, max(weight) AS weight, '{{"note":"' || arg_max(note, weight) || '"}}' AS metadata FROM t GROUP BY src, dst"""
)
def export_edges(spark, sf):
    """The edges table of the export: of edges of one type between two nodes the heaviest, further columns as JSON."""
    e = fk_edges(spark, sf)
    twice = e.where("dst LIKE 'nation:%'").select("src", "dst", (F.col("weight") + 1).alias("weight"), "edge_type", F.lit("b").alias("note"))
    return store.relational_edges(e.withColumn("note", F.lit("a")).unionByName(twice))


@query(f"WITH {POSTS}, n AS (SELECT sum(doc_count) AS n FROM v) SELECT term, round(ln(1 + n / greatest(doc_count, 1)::DOUBLE), 6) AS idf, CAST(doc_count AS BIGINT) AS doc_count, CAST(term_count AS BIGINT) AS term_count FROM v, n")
def export_vocabulary(spark, sf):
    """The vocabulary table of the export where no idf is known."""
    return store.relational_vocabulary(tfidf.term_counts(_docs(spark, sf))).withColumn("idf", F.round("idf", 6))


SURFACE = "SELECT a.name AS caller, b.name AS callee, CAST(sum(weight) AS BIGINT) AS n FROM edges e JOIN nodes a ON e.source_id = a.node_id JOIN nodes b ON e.target_id = b.node_id WHERE e.edge_type = 'CALLS' AND b.file = 'region' GROUP BY 1, 2 ORDER BY n DESC, caller LIMIT 20"


@query(f"WITH {FK_SQL}, nodes AS (SELECT name AS node_id, name, file FROM fk_nodes), edges AS (SELECT src AS source_id, dst AS target_id, 'CALLS' AS edge_type, weight FROM fk_edges) {SURFACE}")
def sql_surface(spark, sf):
    """A client's SQL over the export's tables."""
    store.views(Graph(fk_nodes(spark, sf), fk_edges(spark, sf)))
    return spark.sql(SURFACE)


@query("WITH h AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, CAST(least(n, 3) - k + 1 AS INTEGER) AS no, text FROM h WHERE k <= 3")
def recent_history(spark, sf):
    return context.recent(read(spark, sf, "conversations"), "conv_id", "turn", "text", 3)
