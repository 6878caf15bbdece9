"""Similarity edges between vectors: all pairs over a threshold, top partners, and the greedy degree cap."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomgraph.session import forget, written

#: Vectors of a block at most, and at least if there are fewer than SPLIT blocks; a task multiplies two blocks.
BLOCK, LEAST, SPLIT = 32_768, 1024, 8
#: Rows and columns of a product at a time, and pairs of it, which bound a task's memory; pairs kept for a choice; rows of a batch.
TILE, PART, KEPT, ROWS = (512, 4096), 1 << 16, 1 << 19, 1 << 17
#: Pairs of a vector, as a multiple of the cap, that are sent to the fold; rows that a fold reads.
DEPTH, FOLD = 8, 4_000_000


def rounded(x: np.ndarray) -> np.ndarray:
    """Millionths, as Spark's round() has them: half up of the shortest decimal."""
    at = x * 1e6 + 0.5
    out = np.floor(at)
    near = np.abs(at - np.rint(at)) < 1e-6
    if near.any():
        values, where = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP)) for v in values])[where]
    return out


class Best:
    """The k first partners of each id by (key descending, partner), of pairs that come in any order; `cut` are the ids that
    had more."""

    def __init__(self, k: int):
        self.k, self.parts, self.n, self.cut = k, [], 0, np.empty(0, np.int64)
        self.full, self.least = np.empty(0, np.int64), np.empty(0)

    def add(self, ids: np.ndarray, partners: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        if len(self.full):  # what is worse than the k of an id so far needs no sorting
            at = np.minimum(np.searchsorted(self.full, ids), len(self.full) - 1)
            worse = (self.full[at] == ids) & (keys < self.least[at])
            self.cut = np.union1d(self.cut, ids[worse])
            ids, partners, keys, scores = ids[~worse], partners[~worse], keys[~worse], scores[~worse]
        self.parts.append((ids, partners, keys, scores))
        self.n += len(ids)
        if self.n > KEPT + (len(self.parts[0][0]) if len(self.parts) > 1 else 0):
            self.fold()

    def fold(self) -> None:
        if not self.parts:
            return
        ids, partners, keys, scores = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((partners, -keys, ids))
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
        rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
        self.cut = np.union1d(self.cut, ids[rank == self.k])
        order = order[rank < self.k]
        self.parts = [(ids[rank < self.k], partners[order], keys[order], scores[order])]
        self.n = len(order)
        kth = rank[rank < self.k] == self.k - 1
        self.full, self.least = self.parts[0][0][kth], self.parts[0][2][kth]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """id, partner, score, more: on the last row of an id that had more."""
        self.fold()
        for ids, partners, _, scores in self.parts:
            last = np.r_[ids[1:] != ids[:-1], True] if len(ids) else np.empty(0, bool)
            more = last & np.isin(ids, self.cut)
            yield from _batches(id=ids, partner=partners, score=scores, more=more)


def _batches(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, ROWS):
        yield pa.record_batch({k: pa.array(v[at : at + ROWS]) for k, v in columns.items()})


def _tiles(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a < b, score of the pairs over the threshold of two blocks, tile by tile."""
    table = pa.Table.from_batches(list(batches))
    block, ids = table.column("block").to_numpy(), table.column("id").to_numpy()
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()

    def part(k: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(block == k)
        at = at[np.argsort(ids[at], kind="stable")]
        u = v[at].astype(np.float64)
        norm = np.sqrt((u * u).sum(axis=1))
        return ids[at], np.divide(u, norm[:, None], out=np.zeros_like(u), where=norm[:, None] > 0)

    one = part(i)
    two = one if i == j else part(j)
    # products of four bytes, which are faster, find the pairs, with a margin over their error; their cosines have eight
    short = [u.astype(np.float32) for _, u in (one, two)]
    low = np.float32(threshold - 1e-6 * (8 + v.shape[1]))
    for x in range(0, len(one[0]), TILE[0]):
        for y in range(x if i == j else 0, len(two[0]), TILE[1]):
            sim = short[0][x : x + TILE[0]] @ short[1][y : y + TILE[1]].T
            flat = np.flatnonzero(sim >= low)
            for at in range(0, len(flat), PART):
                r, c = np.divmod(flat[at : at + PART], sim.shape[1])
                s = np.einsum("ij,ij->i", one[1][x + r], two[1][y + c])
                p, q = one[0][x + r], two[0][y + c]
                keep = (s >= threshold) & ((p < q) | (i != j))
                p, q, s = p[keep], q[keep], s[keep]
                yield np.minimum(p, q), np.maximum(p, q), s


def _blocks(vectors: DataFrame, id_column: str, vector_column: str, block: int) -> DataFrame:
    """id, v, block, i, j: each vector goes to the pairs of blocks that its block is in."""
    kept = vectors.where(F.col(vector_column).isNotNull())
    rows = kept.count()
    n = max(1, math.ceil(rows / block), min(SPLIT, math.ceil(rows / LEAST)))
    b = F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int")
    plain = isinstance(kept.schema[vector_column].dataType.elementType, (T.FloatType, T.DoubleType))
    v = F.col(vector_column) if plain else F.col(vector_column).cast("array<double>")
    at = kept.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), b.alias("block"))
    sent = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    sent = sent.select("id", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return sent.repartition(n * (n + 1), "i", "j")


def pairs(vectors: DataFrame, threshold: float, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """a < b, score >= threshold: cosines of all pairs, exact.  A vector without length has cosine 0.

    Each vector goes to the pairs of blocks that its block is in; a pair of blocks is multiplied tile by tile, and the pairs
    of a tile are sent on before the next.  The number of products is quadratic, which all-pairs is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, s in _tiles(batches, threshold):
            yield from _batches(a=a, b=b, score=s)

    return _blocks(vectors, id_column, vector_column, block).groupBy("i", "j").applyInArrow(run, "a long, b long, score double")


def top_partners(found: DataFrame, k: int) -> DataFrame:
    """id, rank, partner, score: the k best partners of each vector; ties by partner."""
    both = found.select(F.col("a").alias("id"), F.col("b").alias("partner"), "score").union(found.select(F.col("b").alias("id"), F.col("a").alias("partner"), "score"))
    return _ranked(both, k)


def _ranked(both: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("id").orderBy(F.desc("score"), "partner")
    return both.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("id", "rank", "partner", "score")


def nearest(vectors: DataFrame, threshold: float, k: int, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """top_partners() of pairs(): each pair of blocks sends the k best of a vector, not all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for a, b, s in _tiles(batches, threshold):
            key = rounded(s)
            best.add(np.r_[a, b], np.r_[b, a], np.r_[key, key], np.r_[s, s])
        yield from best.batches()

    sent = _blocks(vectors, id_column, vector_column, block).groupBy("i", "j").applyInArrow(run, "id long, partner long, score double, more boolean")
    return _ranked(sent.select("id", "partner", "score"), k)


def _heads(lists: DataFrame, depth: int, by_score: bool) -> DataFrame:
    """a, b, score, more: the first `depth` pairs of each a in order, no further than a list that was cut; more: there are others."""
    order = [F.desc("score"), F.col("b")] if by_score else [F.col("b")]
    by = Window.partitionBy("a").orderBy(*order)
    cut = F.coalesce(F.max(F.col("more").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = lists.select("*", F.row_number().over(by).alias("rank"), cut.alias("past"), F.lead("b").over(by).isNotNull().alias("next"))
    ranked = ranked.where((F.col("rank") <= depth) & (F.col("past") == 0))
    return ranked.select("a", "b", "score", (F.col("more") | ((F.col("rank") == depth) & F.col("next"))).alias("more"))


def _fold(cap: int, by_score: bool):
    """Rows (a, b, score, more) in order, after those of degrees (a, degree): the pairs taken; src alone where a list ended
    too early, with which the fold stops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        degree: dict[int, int] = {}
        stop = None
        for batch in batches:
            if stop is not None:
                continue
            src, dst, weight = [], [], []
            for a, b, s, more, d in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "score", "more", "degree"))):
                if d is not None:
                    degree[a] = d
                    continue
                if degree.get(a, 0) >= cap:
                    continue
                if degree.get(b, 0) < cap:
                    degree[a] = degree.get(a, 0) + 1
                    degree[b] = degree.get(b, 0) + 1
                    src.append(a), dst.append(b), weight.append(s)
                if more and degree.get(a, 0) < cap:
                    stop = a
                    src.append(a), dst.append(None), weight.append(None)
                    break
            yield pa.record_batch({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "weight": pa.array(weight, pa.float64())})

    return run


def _ends(taken: DataFrame) -> DataFrame:
    """a, degree."""
    return taken.select(F.col("src").alias("a")).unionAll(taken.select("dst")).groupBy("a").agg(F.count("*").cast("int").alias("degree"))


def _greedy(lists: Callable[[DataFrame | None, int | None, int], DataFrame], cap: int, by_score: bool, depth: int | None, rows: int) -> DataFrame:
    """The greedy rule over lists(full, start, depth): a, b, score, more of the pairs with a >= start and no end in full(a).

    Only the first pairs of each a are needed, as a rule, and are folded in order, `rows` or so at a time, in one task that
    holds the degrees.  Where a list ends before its vector is served, the lists from there on are made anew without what is
    full, twice as deep, and the fold goes on.
    """
    depth = DEPTH * cap if depth is None else depth
    order = [F.col("degree").isNull(), "a", *([F.desc("score")] if by_score else []), "b"]
    full = start = taken = None
    while True:
        heads = written(_heads(lists(full, start, depth), depth, by_score), "heads")
        parts = math.ceil(heads.count() / rows)
        cuts = sorted(set(heads.approxQuantile("a", [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
        start = None
        for low, high in zip([None, *cuts], [*cuts, None]):
            part = heads if low is None else heads.where(F.col("a") > low)
            part = (part if high is None else part.where(F.col("a") <= high)).withColumn("degree", F.lit(None).cast("int"))
            if taken is not None:
                part = part.unionByName(_ends(taken).where("degree > 0" if low is None else F.col("a") > low), allowMissingColumns=True)
            new = written(part.repartition(1).sortWithinPartitions(*order).mapInArrow(_fold(cap, by_score), "src long, dst long, weight double"), "capped")
            end = new.where("dst IS NULL").first()
            start = None if end is None else end.src
            new = new if start is None else new.where(F.col("src") < start)
            taken = new if taken is None else taken.unionAll(new)
            if start is not None:
                break
        if start is None:
            return taken
        forget(heads)
        full = written(_ends(taken).where(F.col("degree") >= cap).select("a"), "full")
        depth *= 2


def capped(found: DataFrame, cap: int, by_score: bool = True, depth: int | None = None, rows: int = FOLD) -> DataFrame:
    """src, dst, weight: pairs taken in the order (a, score descending, b) while both ends have fewer than cap."""

    def lists(full: DataFrame | None, start: int | None, depth: int) -> DataFrame:
        left = found.select("a", "b", "score", F.lit(False).alias("more"))
        if full is not None:
            left = left.where(F.col("a") >= start).join(full, "a", "left_anti").join(full.select(F.col("a").alias("b")), "b", "left_anti")
        return left

    return _greedy(lists, cap, by_score, depth, rows)


def semantic_edges(vectors: DataFrame, threshold: float, cap: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK, depth: int | None = None, rows: int = FOLD) -> DataFrame:
    """src, dst, weight: capped() of pairs(): each pair of blocks sends the first pairs of a vector, not all."""

    def lists(full: DataFrame | None, start: int | None, depth: int) -> DataFrame:
        left = vectors.select(F.col(id_column).cast("long").alias("a"), vector_column)
        if full is not None:
            left = left.where(F.col("a") >= start).join(full, "a", "left_anti")
        k = max(2, depth // 4)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k)
            for a, b, s in _tiles(batches, threshold):
                best.add(a, b, s, s)
            yield from best.batches()

        sent = _blocks(left, "a", vector_column, block).groupBy("i", "j").applyInArrow(run, "id long, partner long, score double, more boolean")
        return sent.select(F.col("id").alias("a"), F.col("partner").alias("b"), "score", "more")

    return _greedy(lists, cap, True, depth, rows)
