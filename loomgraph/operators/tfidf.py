"""TF-IDF over documents (doc_id, text): vocabulary, weights, and similarity through an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.text import tokenize
from loomgraph.session import written


def postings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc, term, count, doc_len: one shuffle on (doc, term), with counts combined before it."""
    words = docs.select(F.col(id_column).alias("doc"), tokenize(F.col(text_column)).alias("ts"))
    long = words.select("doc", F.size("ts").alias("doc_len"), F.explode("ts").alias("term"))
    return long.groupBy("doc", "term").agg(F.count("*").alias("count"), F.first("doc_len").alias("doc_len"))


def term_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """term, doc_count, term_count in one pass: each text sends its words and its distinct words, which are combined by term
    before the only shuffle."""
    words = docs.select(tokenize(F.col(text_column)).alias("ts"))

    def marked(ts, one: int):
        return F.transform(ts, lambda t: F.struct(t.alias("term"), F.lit(one).alias("first")))

    long = words.select(F.explode(F.concat(marked(F.col("ts"), 0), marked(F.array_distinct("ts"), 1))).alias("e"))
    return long.groupBy("e.term").agg(F.sum("e.first").alias("doc_count"), F.sum(1 - F.col("e.first")).alias("term_count"))


def with_idf(counts: DataFrame, n_docs: int, min_term_count: int = 1, min_doc_count: int = 1) -> DataFrame:
    """The terms of counts(term, doc_count, term_count) that are frequent enough, with idf = ln(1 + N / doc_count)."""
    found = counts.where((F.col("term_count") >= min_term_count) & (F.col("doc_count") >= min_doc_count))
    return found.withColumn("idf", F.log(1 + F.lit(float(n_docs)) / F.col("doc_count")))


def vocabulary(posts: DataFrame, n_docs: int, min_term_count: int = 1, min_doc_count: int = 1) -> DataFrame:
    """term, doc_count, term_count, idf, of postings."""
    found = posts.groupBy("term").agg(F.count("*").alias("doc_count"), F.sum("count").alias("term_count"))
    return with_idf(found, n_docs, min_term_count, min_doc_count)


def weighted(posts: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc, term, w = count / doc_len * idf."""
    return posts.join(vocab.select("term", "idf"), "term").select("doc", "term", (F.col("count") / F.col("doc_len") * F.col("idf")).alias("w"))


def similar(docs: DataFrame, query: str, n_docs: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc, score: cosine of each document that shares a term with the query; terms out of the vocabulary are ignored.

    Texts are tokenized once: the postings are written, and the vocabulary, the query's weights, norms and dot products
    are made of them (norms and dot products by the same grouping).
    """
    n = docs.count() if n_docs is None else n_docs
    posts = written(postings(docs, id_column, text_column), "postings")
    vocab = vocabulary(posts, n)
    asked = docs.sparkSession.createDataFrame([(query,)], "text string").select(tokenize(F.col("text")).alias("ts"))
    asked = asked.select(F.explode("ts").alias("term"), F.size("ts").alias("n")).groupBy("term").agg((F.count("*") / F.first("n")).alias("qtf"))
    # every term's idf, and the query's weight of those in it (the query's terms are few)
    terms = vocab.join(F.broadcast(asked), "term", "left").select("term", "idf", (F.col("qtf") * F.col("idf")).alias("qw"))
    w = posts.join(terms, "term").select("doc", (F.col("count") / F.col("doc_len") * F.col("idf")).alias("w"), "qw")
    sums = w.groupBy("doc").agg(F.sum(F.coalesce(F.col("w") * F.col("qw"), F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("dot > 0")
    q_norm = vocab.join(F.broadcast(asked), "term").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2))).alias("q_norm"))
    return sums.crossJoin(F.broadcast(q_norm)).select("doc", (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("score"))


def top_terms(docs: DataFrame, k: int, n_docs: int | None = None) -> DataFrame:
    """doc, rank, term, w: the k terms of greatest weight of each document; ties by term.  Texts are tokenized once."""
    n = docs.count() if n_docs is None else n_docs
    posts = written(postings(docs), "postings")
    w = weighted(posts, vocabulary(posts, n)).withColumn("w", F.round("w", 9))
    by = Window.partitionBy("doc").orderBy(F.desc("w"), "term")
    return w.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
