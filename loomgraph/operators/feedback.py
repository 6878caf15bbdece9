"""Learning from a log of traces: decayed weights, moving averages, polarity, deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph import schema as S


def keep_first(traces: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by `order`, of each combination of keys; null keys are empty strings."""
    by = Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).orderBy(*order)
    return traces.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def parse_time(ts: Column) -> Column:
    """Null where it can't be parsed."""
    return F.coalesce(F.try_to_timestamp(ts, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]X")), F.try_to_timestamp(ts))


def trace_weights(nodes: DataFrame, traces: DataFrame, now: str, half_life: float = S.HALF_LIFE_DAYS) -> DataFrame:
    """nodes(name), traces(created_at timestamp, nodes array, polarity): name, weight.

    Each mention adds 2^(-days / half_life) * (1 + polarity in [-1, 1]); sums are divided by the greatest, if over 0.  A
    null time counts as now, a null polarity as 0; nodes without a mention have 0.
    """
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(86400e6))
    value = F.pow(F.lit(2.0), -F.coalesce(days, F.lit(0.0)) / half_life) * (1 + F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce("polarity", F.lit(0.0)))))
    sums = traces.select(F.explode("nodes").alias("name"), value.alias("v")).groupBy("name").agg(F.sum("v").alias("acc"))
    acc = nodes.select("name").join(sums, "name", "left").select("name", F.coalesce("acc", F.lit(0.0)).alias("acc"))
    top = acc.agg(F.max("acc").alias("top"))
    return acc.crossJoin(F.broadcast(top)).select("name", F.when(F.col("top") > 0, F.col("acc") / F.col("top")).otherwise(F.col("acc")).alias("weight"))


def ema(weight: Column, useful: Column, alpha: float = S.ALPHA, decay: float = S.DECAY) -> Column:
    """decay * w, then towards 1 for useful nodes; null begins at 0.5; within [0, 1]."""
    w = F.coalesce(weight, F.lit(0.5)) * decay
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(useful, w * (1 - alpha) + alpha).otherwise(w)))


def rewrite_polarity(traces: DataFrame, names: Sequence[str], polarity: float, n_recent: int = 3, order: str = "line_no") -> DataFrame:
    """The last n_recent traces that mention one of the names get the polarity."""
    hit = F.arrays_overlap("nodes", F.array(*[F.lit(n) for n in names]))
    by = Window.partitionBy(hit).orderBy(F.desc(order))
    return traces.withColumn("_k", F.row_number().over(by)).withColumn("polarity", F.when(hit & (F.col("_k") <= n_recent), F.lit(float(polarity))).otherwise(F.col("polarity"))).drop("_k")


def import_traces(new: DataFrame, old: DataFrame) -> DataFrame:
    """old and the new rows whose (query, session_id, created_at) isn't there; a null polarity is 0."""
    keys = ["query", "session_id", "created_at"]
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").withColumn("polarity", F.coalesce("polarity", F.lit(0.0)))
    return old.unionByName(fresh)
