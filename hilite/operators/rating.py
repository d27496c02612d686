"""How concentrated the topics of a window are, and which windows are highlights."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilite.operators.skew import join_by_frequency


def rate_windows(counts: DataFrame, window: list[str], n: str, dimension: Column) -> DataFrame:
    """(window, rating) of long counts, a row for each window and topic with its count in n: popvar(f) / (1 - sum p ln p).

    In closed form, with k topics in all (dimension, constant within a window) and n = sum f: (sum f^2 / k - (n/k)^2) /
    (1 + ln n - (sum f ln f) / n). Topics that a window lacks need no row. Windows without any count have rating 0.
    """
    f = F.col(n).cast("double")
    total = F.sum(f)
    spread = F.sum(f * f) / F.max(dimension) - (total / F.max(dimension)) ** 2
    entropy = 1 + F.ln(total) - F.sum(F.when(f > 0, f * F.ln(f))) / total
    return counts.groupBy(*window).agg(F.coalesce(F.when(total > 0, spread / entropy), F.lit(0.0)).alias("rating"))


def rating_bounds(rated: DataFrame, cid: str) -> DataFrame:
    """(cid, low, high): the least and greatest rating of each video; windows without rating don't count."""
    return rated.groupBy(cid).agg(F.min("rating").alias("low"), F.max("rating").alias("high"))


def highlights(rated: DataFrame, cid: str, left: float = 0.3, right: float = 0.7) -> DataFrame:
    """The windows rated above left * least + right * greatest of their video; windows without rating are none.

    The bounds, an aggregate, are joined back by the number of a video's windows, so a video with very many is not one
    task. rated is read twice.
    """
    there = rated.where(F.col("rating").isNotNull() & F.col(cid).isNotNull())
    cut = there.groupBy(cid).agg((left * F.min("rating") + right * F.max("rating")).alias("__cut"), F.count(F.lit(1)).alias("__n"))
    joined = join_by_frequency(there, cid, cut, "__n", ["rating"], how="inner", merge=True)
    return joined.where(F.col("rating") > F.col("__cut")).select(*rated.columns)
