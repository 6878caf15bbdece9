"""Edge builders: joins and set operations over node, file and commit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph import schema as S
from loomgraph.functions.text import captures2

LIBRARY = r"""(?:library|require)\s*\(\s*["']?([A-Za-z][\w.]*)["']?\s*\)"""
QUALIFIED = r"([A-Za-z][\w.]*):::?[A-Za-z._]"


def bare(symbol):
    return F.regexp_replace(symbol, "^.*:::?", "")


def call_edges(nodes: DataFrame) -> DataFrame:
    """nodes(id, name, calls_list): each called name goes to all nodes of that name; distinct; weight 1."""
    calls = nodes.select(F.col("id").alias("src"), F.explode(F.array_distinct("calls_list")).alias("symbol")).select("src", bare(F.col("symbol")).alias("name"))
    return calls.join(nodes.select("name", F.col("id").alias("dst")), "name").select("src", "dst").distinct().withColumn("weight", F.lit(1.0))


def first_by_name(nodes: DataFrame) -> DataFrame:
    """name, id of the node of least node_pos of each name."""
    return nodes.groupBy("name").agg(F.min_by("id", F.struct("node_pos", "id")).alias("id"))


def test_edges(nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """tests(stem, symbols): called names other than test helpers, each to the first node of that name."""
    symbols = tests.select(F.col("stem").alias("src"), F.explode(F.array_distinct("symbols")).alias("symbol")).where(~F.col("symbol").isin(*sorted(S.TEST_HELPERS)))
    named = symbols.select("src", bare(F.col("symbol")).alias("name"))
    return named.join(first_by_name(nodes).withColumnRenamed("id", "dst"), "name").select("src", "dst").distinct().withColumn("weight", F.lit(1.0))


def import_edges(lines: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """lines(stem, line) of sources; dependencies(stem, package) of metadata: src, dst, weight, source; distinct, in order.

    A library call counts if the name is its only argument."""

    def found(pattern: str, source: str) -> DataFrame:
        return lines.select(F.col("stem").alias("src"), F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("dst")).where("dst <> ''").withColumn("source", F.lit(source))

    out = found(LIBRARY, "library").unionByName(found(QUALIFIED, "qualified"))
    if dependencies is not None:
        out = out.unionByName(dependencies.select(F.col("stem").alias("src"), F.col("package").alias("dst"), F.lit("description").alias("source")))
    return out.select("src", "dst", F.lit(1.0).alias("weight"), "source").distinct().orderBy("src", "dst", "source")


def dependency_field(fields: DataFrame) -> DataFrame:
    """fields(stem, value): the packages of a comma-separated field, without versions, blanks and the language itself."""
    each = fields.select("stem", F.explode(F.split("value", ",")).alias("p"))
    each = each.select("stem", F.trim(F.regexp_replace(F.regexp_replace("p", r"\s*\(.*\)\s*$", ""), r"\s+", " ")).alias("package"))
    return each.where("package <> '' AND package <> 'R'").distinct()


def cochange_pairs(commits: DataFrame, nodes: DataFrame) -> DataFrame:
    """commits(commit_id, file), nodes(file): f1 < f2, n commits with both, total commits.  n is combined before its shuffle."""
    rows = commits.where("file IS NOT NULL").select("commit_id", "file").distinct()
    total = rows.agg(F.greatest(F.countDistinct("commit_id"), F.lit(1)).alias("total"))
    known = rows.join(nodes.select("file").distinct(), "file", "left_semi")
    a, b = known.select("commit_id", F.col("file").alias("f1")), known.select("commit_id", F.col("file").alias("f2"))
    return a.join(b, "commit_id").where("f1 < f2").groupBy("f1", "f2").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))


def edges_of_pairs(pairs: DataFrame, nodes: DataFrame, min_cochanges: int) -> DataFrame:
    """Both directions between the nodes(id, file) of the pairs that are frequent enough; weight = min(1, n / total)."""
    pairs = pairs.where(F.col("n") >= min_cochanges).select("f1", "f2", F.least(F.lit(1.0), F.col("n") / F.col("total")).alias("weight"))
    one = nodes.select(F.col("id").alias("src"), F.col("file").alias("f1"))
    two = nodes.select(F.col("id").alias("dst"), F.col("file").alias("f2"))
    there = pairs.join(one, "f1").join(two, "f2").select("src", "dst", "weight")
    return there.union(there.select("dst", "src", "weight")).distinct()


def cochange_edges(commits: DataFrame, nodes: DataFrame, min_cochanges: int = S.MIN_COCHANGES) -> DataFrame:
    """commits(commit_id, file), nodes(id, file): both directions between the nodes of files that change together."""
    return edges_of_pairs(cochange_pairs(commits, nodes), nodes, min_cochanges)


def dispatch_edges(nodes: DataFrame, methods: DataFrame) -> DataFrame:
    """nodes(id, name, node_pos), methods(name): homonyms of a dispatched name point to the first of them."""
    by = Window.partitionBy("name").orderBy("node_pos", "id")
    ranked = nodes.join(methods.select("name").distinct(), "name", "left_semi").withColumn("rn", F.row_number().over(by)).withColumn("dst", F.first("id").over(by))
    return ranked.where("rn > 1").select(F.col("id").alias("src"), "dst").distinct().withColumn("weight", F.lit(1.0))


EXTENDS_PATTERNS = (
    r"""setClass\s*\(\s*["']([^"']+)["'](?:(?!setClass|R6Class|setRefClass)[\s\S]){0,500}?contains\s*=\s*(?:c\s*\(\s*)?["']([^"']+)["']""",
    r"""R6Class\s*\(\s*["']([^"']+)["'](?:(?!setClass|R6Class|setRefClass)[\s\S]){0,500}?inherit\s*=\s*([A-Za-z][A-Za-z0-9._]*)""",
    r"""setRefClass\s*\(\s*["']([^"']+)["'](?:(?!setClass|R6Class|setRefClass)[\s\S]){0,500}?contains\s*=\s*(?:c\s*\(\s*)?["']([^"']+)["']""",
)


def extends_pairs(sources: DataFrame, *keep: str) -> DataFrame:
    """sources(text, and columns to keep): child and parent of each class definition."""
    pairs = None
    for pattern in EXTENDS_PATTERNS:
        part = sources.select(*keep, F.explode(captures2(F.col("text"), pattern)).alias("p")).select(*keep, F.col("p.first").alias("child"), F.col("p.second").alias("parent"))
        pairs = part if pairs is None else pairs.union(part)
    return pairs.distinct()


def extends_of(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Child class to parent class, by name to the first node; names without a node are dropped."""
    dim = first_by_name(nodes)
    out = pairs.select("child", "parent").distinct().join(dim.select(F.col("name").alias("child"), F.col("id").alias("src")), "child").join(dim.select(F.col("name").alias("parent"), F.col("id").alias("dst")), "parent")
    return out.where("src <> dst").select("src", "dst").distinct().withColumn("weight", F.lit(1.0))


def extends_edges(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """sources(text): child class to parent class."""
    return extends_of(extends_pairs(sources), nodes)


def assemble(nodes: DataFrame, **by_type: DataFrame) -> DataFrame:
    """Edges of all types (keyword: type) whose ends are both nodes(name); parallel edges stay.  The type's name is put in
    after the shuffles."""
    out = None
    for i, edges in enumerate(by_type.values()):
        part = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"), F.lit(i).cast("byte").alias("kind"))
        out = part if out is None else out.unionByName(part)
    names = nodes.select("name")
    kept = out.join(names, F.col("dst") == names["name"], "left_semi").join(names, F.col("src") == names["name"], "left_semi")
    return kept.select("src", "dst", "weight", F.element_at(F.array(*map(F.lit, by_type)), F.col("kind") + 1).alias("edge_type"))


def parse_log(lines: DataFrame) -> DataFrame:
    """lines(log, line_no, line): commit_id, file.  A line of 40 hex digits begins a commit; after the next blank line
    its files follow; commits without files have no row."""
    by = Window.partitionBy("log").orderBy("line_no")
    marked = lines.withColumn("is_hash", F.col("line").rlike("^[0-9a-f]{40}$")).withColumn("commit", F.sum(F.col("is_hash").cast("int")).over(by))
    marked = marked.withColumn("commit_id", F.last(F.when(F.col("is_hash"), F.col("line")), True).over(by))
    of = Window.partitionBy("log", "commit").orderBy("line_no")
    marked = marked.withColumn("past", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(of))
    return marked.where("commit > 0 AND past > 0 AND trim(line) <> '' AND NOT is_hash").select("commit_id", F.trim("line").alias("file"))
