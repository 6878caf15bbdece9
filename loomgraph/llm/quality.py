"""Operator 4, quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Each text has a vector of transformed statistics: the shares of symbols, upper case and punctuation (arc sines), the mean
length of words (logarithm) and the share of distinct words (logarithm, per length).  Shares and mean length are drawn to
those of the whole corpus by the weight of PRIOR bytes or words, so that short texts don't stand out by chance.

For each (lang, source) the covariance of least determinant over the share H of its documents is sought as FAST-MCD does:
from STARTS starts (the medians and their deviations; the mean and covariance of 3 * D of the group's vectors, drawn by
hash, for each other one) two concentration steps are taken over all documents; the start that has come to the least
determinant goes on until a step makes it less than one part in a thousand smaller.  A step: distances of all documents
are taken, those up to the H quantile give the next mean and covariance.  At last distances are scaled so that their
median is that of chi-square.  A document is rejected if its squared Mahalanobis distance is over the quantile of
chi-square with D degrees that TAIL of normal documents exceed (one of 10^11), or if it has no word.

Plan: one scan makes the vectors, which are written to the shared folder.  A step is one aggregation over them: distances
are put in buckets of 2 per cent, counts and moments are summed by group, start and bucket (combined before the shuffle,
so a hot source is no skew), and the buckets up to the quantile make up the subset, whole buckets at a time.  Draws are
combined by task.  Only estimates meet in Python, one row a group and start.  Documents are never collected.

Groups of fewer than `least` documents use their language's estimate over all its sources, or if it has too few too, that
of all documents.  Covariances get FLOOR added to their diagonal, so constant statistics don't make them singular.

Defined cases: null texts are empty; null lang or source is a value of its own; each row is scored by itself (repeated rows
count as often as they are there, rows with a null doc_id too); an empty table gives no rows; scores() returns doc_id,
lang, source, distance and keep; kept() returns the rows kept with all their columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomgraph.llm import textscan
from loomgraph.llm.shared import chunks, forget, give_back, unused, utf8_buffers, written

H, STARTS, GAIN, LEAST, TAIL = 0.75, 4, 1e-3, 50, 1e-11
D = 5
#: Bytes (or words) with which shares are drawn to the corpus', and the variance that is added to each statistic.
PRIOR = (300.0, 300.0, 300.0, 40.0, 40.0)
FLOOR = (4e-4, 4e-4, 4e-4, 1e-3, 4e-3)
X = [f"x{i}" for i in range(D)]
#: What is counted in a text.
RAW = ("bytes", "words", "symbol", "upper", "mark", "letters", "distinct")
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _table(keep: bytes) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(keep)] = 1
    return out


SYMBOL, UPPER, MARK = _table(b"#$%&*|@^~<>{}[]\\/_=+`"), _table(bytes(range(65, 91))), _table(b".,;:!?\"'()-")


def counted(texts: pa.Array) -> np.ndarray:
    """RAW of each text: bytes, words, bytes of the three classes, bytes of words, distinct words."""
    data, off = utf8_buffers(texts)
    starts, ends, word_off, h = textscan.scan(data, off)
    words = np.diff(word_off)
    row = np.repeat(np.arange(len(words)), words)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    classes = [np.diff(np.r_[0, np.cumsum(t[data], dtype=np.int64)][off]) for t in (SYMBOL, UPPER, MARK)]
    length = np.diff(np.r_[0, np.cumsum(ends - starts)][word_off])
    return np.column_stack([np.diff(off), words, *classes, length, np.bincount(row[order][new], minlength=len(words))]).astype(np.int64)


def _counts(names: list[str], kept: list[int]):
    """The columns at `kept`, and RAW of the text, which is the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column=batches_text):
            raw = counted(batch.column(batches_text))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *[pa.array(raw[:, i]) for i in range(len(RAW))]], names=names)
        give_back()

    batches_text = len(kept)
    return run


def with_counts(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with columns `names` for RAW of the column text."""
    fields = [*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]]
    (text,) = unused(docs, "as_text")
    made = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    return made.mapInArrow(_counts([f.name for f in fields], list(range(len(docs.columns)))), T.StructType(fields))


def centre(raw: DataFrame, names: list[str]) -> list[float]:
    """The corpus' shares of the three classes, and its mean length of words."""
    n_bytes, n_words, *sums = (float(x or 0) for x in raw.agg(*[F.sum(n) for n in names[:6]]).first())
    return [*[s / max(1.0, n_bytes) for s in sums[:3]], sums[3] / max(1.0, n_words)]


def vector(names: list[str], centre: list[float]) -> list[Column]:
    """The D statistics, of columns that have RAW."""
    n, words, *classes, length, distinct = (F.col(x).cast("double") for x in names)
    shares = [F.asin(F.sqrt((c + PRIOR[i] * centre[i]) / (n + PRIOR[i]))) for i, c in enumerate(classes)]
    mean = F.log((length + PRIOR[3] * max(centre[3], 1.0)) / (words + PRIOR[3]))
    # texts repeat more words the longer they are: the share is compared by its power of the length
    variety = F.log((distinct + PRIOR[4]) / (words + PRIOR[4])) / F.log(words + PRIOR[4])
    return [*shares, mean, 10 * variety]


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def chi_square(x: float, d: int) -> float:
    """The distribution function, by the series of the incomplete gamma function."""
    a, x = d / 2, x / 2
    term = total = 1 / a
    k = a
    while term > 1e-17 * total:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_quantile(p: float, d: int) -> float:
    low, high = 1e-9, 1000.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, d) < p else (low, mid)
    return low


CUTOFF = chi_quantile(1 - TAIL, D)


def consistency(h: float) -> float:
    """What the covariance of the inner share h of a normal distribution is to be multiplied by."""
    return 1.0 if h >= 1 else h / chi_square(chi_quantile(h, D), D + 2)


def estimate(n: float, s: np.ndarray, p: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """From count, sums and sums of products (upper triangle): the mean, the upper triangle of the inverse covariance, and
    the logarithm of the covariance's determinant."""
    mean, second = s / n, np.zeros((D, D))
    second[np.triu_indices(D)] = p / n
    second = np.triu(second) + np.triu(second, 1).T
    cov = scale * (second - np.outer(mean, mean)) + np.diag(FLOOR)
    return mean, np.linalg.inv(cov)[np.triu_indices(D)], float(np.linalg.slogdet(cov)[1])


KEYS = ["use_lang", "use_source", "start"]
ESTIMATE = "use_lang string, use_source string, start int, mu array<double>, inv array<double>, det double"


def _estimates(scale: float):
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            out = []
            for r in frame.itertuples(index=False):
                mean, inverse, det = estimate(r.n, np.array(r.s), np.array(r.p), scale)
                out.append((r.use_lang, r.use_source, r.start, mean.tolist(), inverse.tolist(), det))
            yield pd.DataFrame(out, columns=[*KEYS, "mu", "inv", "det"])

    return run


def lots(x: np.ndarray, start: int) -> np.ndarray:
    """A hash of each vector (to six places), for a draw."""
    h = np.full(len(x), start, np.uint64)
    for i in range(D):
        h = textscan.mix(h ^ np.rint(x[:, i] * 1e6).astype(np.int64).view(np.uint64))
    return h


def _drawn(starts: int):
    """The 3 * D distinct vectors of least lot of each group and start, among those of a task."""

    def least(held: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(held).drop_duplicates(["use_lang", "use_source", "start", "lot"]).sort_values("lot", kind="stable")
        return frame[frame.groupby(["use_lang", "use_source", "start"]).cumcount() < 3 * D]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            for s in range(1, starts):
                held.append(frame.assign(start=np.int32(s), lot=lots(frame[X].to_numpy(), s).view(np.int64)))
            held = [least(held)]
        yield from held

    return run


def _draw(starts: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("lot").sort_values("lot", kind="stable").head(3 * D)
        x = frame[X].to_numpy()
        mean, inverse, _ = estimate(len(x), x.sum(axis=0), (x.T @ x)[np.triu_indices(D)], 1.0)
        return pd.DataFrame([(*frame.iloc[0][KEYS], mean.tolist(), inverse.tolist(), math.inf)], columns=[*KEYS, "mu", "inv", "det"])

    return run


def _distance(x: list[str], mu: str = "mu", inv: str = "inv") -> Column:
    d = [F.col(x[i]) - F.col(mu)[i] for i in range(D)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        out = out + d[i] * d[j] * F.col(inv)[k] * (1.0 if i == j else 2.0)
    return F.greatest(out, F.lit(0.0))


def _starts(fit: DataFrame, starts: int) -> DataFrame:
    """ESTIMATE of each group and start."""
    by = ["use_lang", "use_source"]
    mid = fit.groupBy(*by).agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}") for i, x in enumerate(X)])
    off = fit.join(mid, by).groupBy(*by).agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(D)], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10000).alias(f"d{i}") for i, x in enumerate(X)])
    flat = [1.0 / (F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOOR[i]) if i == j else F.lit(0.0) for i, j in PAIRS]
    out = off.select(*by, F.lit(0).alias("start"), F.array(*[f"m{i}" for i in range(D)]).alias("mu"), F.array(*flat).alias("inv"), F.lit(math.inf).alias("det"))
    if starts > 1:
        rows = f"use_lang string, use_source string, {', '.join(f'{x} double' for x in X)}, start int, lot long"
        out = out.union(fit.mapInPandas(_drawn(starts), rows).groupBy(*KEYS).applyInPandas(_draw(starts), ESTIMATE))
    return out


def _step(fit: DataFrame, at: DataFrame, h: float) -> DataFrame:
    """ESTIMATE after a concentration step from each row of `at`."""
    bucket = F.floor(F.log(_distance(X) + 1e-9) * 50).cast("int").alias("b")
    sums = [F.sum(x).alias(f"s_{x}") for x in X] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p_{i}_{j}") for i, j in PAIRS]
    s, p = [f"s_{x}" for x in X], [f"p_{i}_{j}" for i, j in PAIRS]
    parts = fit.join(at, ["use_lang", "use_source"]).groupBy(*KEYS, bucket).agg(F.count("*").alias("n"), *sums)
    by = Window.partitionBy(*KEYS)
    parts = parts.withColumn("before", F.sum("n").over(by.orderBy("b")) - F.col("n")).withColumn("all", F.sum("n").over(by))
    inner = parts.where(F.col("before") < F.ceil(F.col("all") * h)).groupBy(*KEYS).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in s + p])
    return inner.select(*KEYS, "n", F.array(*s).alias("s"), F.array(*p).alias("p")).mapInPandas(_estimates(consistency(h)), ESTIMATE)


def estimates(vectors: DataFrame, h: float = H, starts: int = STARTS, least: int = LEAST) -> DataFrame:
    """key_lang, key_source, mu, inv (upper triangle) of each group of vectors(key_lang, key_source, x0, ...)."""
    groups = vectors.groupBy("key_lang", "key_source").agg(F.count("*").alias("n"))
    groups = groups.withColumn("n_lang", F.sum("n").over(Window.partitionBy("key_lang")))
    use_lang = F.when((F.col("n") >= least) | (F.col("n_lang") >= least), F.col("key_lang")).otherwise("*")
    use_source = F.when(F.col("n") >= least, F.col("key_source")).otherwise("*")
    groups = written(groups.select("key_lang", "key_source", use_lang.alias("use_lang"), use_source.alias("use_source")), "groups")
    # a vector goes to each estimate in use that covers it
    used = groups.select("use_lang", "use_source").distinct()
    same = groups.select("key_lang", "key_source")
    levels = F.array(F.struct(F.col("key_lang").alias("use_lang"), F.col("key_source").alias("use_source")), F.struct(F.col("key_lang").alias("use_lang"), F.lit("*").alias("use_source")), F.struct(F.lit("*").alias("use_lang"), F.lit("*").alias("use_source")))
    to = same.select("key_lang", "key_source", F.explode(levels).alias("k")).select("key_lang", "key_source", "k.*").join(used, ["use_lang", "use_source"], "left_semi")
    fit = written(vectors.join(to, ["key_lang", "key_source"]).select("use_lang", "use_source", *X), "vectors")
    at = written(_starts(fit, starts), "estimates")
    for _ in range(2):
        at, old = written(_step(fit, at, h), "estimates"), at
        forget(old)
    best = at.groupBy("use_lang", "use_source").agg(F.min_by(F.struct("start", "mu", "inv", "det"), F.struct("det", "start")).alias("e"))
    at, old = written(best.select("use_lang", "use_source", "e.*", F.lit(True).alias("moves")), "estimates"), at
    forget(old)
    while at.where("moves").take(1):
        new = _step(fit, at.where("moves").drop("moves"), h).select("use_lang", "use_source", F.struct("start", "mu", "inv", "det").alias("new"))
        both = at.join(new, ["use_lang", "use_source"], "left")
        better = F.coalesce(F.col("new.det") < F.col("det") - GAIN, F.lit(False))
        chosen = F.when(better, F.col("new")).otherwise(F.struct("start", "mu", "inv", "det"))
        at, old = written(both.select("use_lang", "use_source", chosen.alias("e"), better.alias("moves")).select("use_lang", "use_source", "e.*", "moves"), "estimates"), at
        forget(old)
    median = fit.join(at, ["use_lang", "use_source"]).groupBy("use_lang", "use_source").agg(F.percentile_approx(_distance(X), 0.5, 10000).alias("median"))
    scale = F.when(F.col("median") > 0, chi_quantile(0.5, D) / F.col("median")).otherwise(1.0)
    last = at.join(median, ["use_lang", "use_source"]).select("use_lang", "use_source", "mu", F.transform("inv", lambda v: v * scale).alias("inv"))
    last = written(last, "estimates")
    forget(fit)
    return groups.join(last, ["use_lang", "use_source"]).select("key_lang", "key_source", "mu", "inv")


def _scored(full: DataFrame, raw: list[str], vectors_of: DataFrame, raw_of: list[str], h: float, starts: int, least: int) -> tuple[DataFrame, str]:
    """`full`, which has RAW in columns `raw`, with a column for the distance (null without words), and its name; the
    estimates are those of `vectors_of`, which has them in columns `raw_of`."""
    mid = centre(vectors_of, raw_of)
    x = vector(raw_of, mid)
    vectors = vectors_of.where(F.col(raw_of[1]) > 0).select(_key("lang").alias("key_lang"), _key("source").alias("key_source"), *[c.alias(n) for c, n in zip(x, X)])
    lang, source, mu, inv, distance, *xs = unused(full, "key_lang", "key_source", "mu", "inv", "distance", *X)
    at = estimates(vectors, h, starts, least).select(F.col("key_lang").alias(lang), F.col("key_source").alias(source), F.col("mu").alias(mu), F.col("inv").alias(inv))
    full = full.withColumns({lang: _key("lang"), source: _key("source")}).join(at, [lang, source], "left")
    full = full.withColumns(dict(zip(xs, vector(raw, mid))))
    return full.withColumn(distance, F.when(F.col(raw[1]) > 0, _distance(xs, mu, inv))), distance


def scores(docs: DataFrame, cutoff: float = CUTOFF, h: float = H, starts: int = STARTS, least: int = LEAST) -> DataFrame:
    """doc_id, lang, source, distance (squared; null without words), keep, for each row."""
    plain = docs.select("doc_id", "lang", "source", "text")
    raw = [f"raw_{n}" for n in RAW]
    made = written(with_counts(plain, raw).drop("text"), "counts")
    full, distance = _scored(made, raw, made, raw, h, starts, least)
    return full.select("doc_id", "lang", "source", F.round(distance, 4).alias("distance"), F.coalesce(F.col(distance) <= cutoff, F.lit(False)).alias("keep"))


def kept(docs: DataFrame, cutoff: float = CUTOFF, h: float = H, starts: int = STARTS, least: int = LEAST) -> DataFrame:
    """The rows that are not rejected, with the columns of docs.  Texts are scanned twice: first for the estimates."""
    of = [f"raw_{n}" for n in RAW]
    first = written(with_counts(docs.select("lang", "source", "text"), of).drop("text"), "counts")
    raw = unused(docs, *of)
    full, distance = _scored(with_counts(docs, raw), raw, first, of, h, starts, least)
    return full.where(F.col(distance) <= cutoff).select(*[F.col(f"`{c}`") for c in docs.columns])
