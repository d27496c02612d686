"""Clips from windows, and how well they meet labelled ones."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_clips(windows: DataFrame, cid: str, index: str, start: str, end: str, label: str) -> DataFrame:
    """(cid, start, end, label): consecutive windows of one label as one clip. Null labels are a label of their own."""
    island = F.col(index) - F.row_number().over(Window.partitionBy(cid, label).orderBy(index))
    return windows.withColumn("__island", island).groupBy(cid, label, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).select(cid, "start", "end", F.col(label).alias("label"))


def overlaps(predicted: DataFrame, base: DataFrame, cid: str, *, bin_width: int) -> DataFrame:
    """(cid, start, end, label, base_label): the common part of every two clips of a video that meet; clips that touch have one of length 0.

    Both have cid, start, end, label. Clips go to all bins of bin_width that they meet and are joined by bin; each two
    meet in the bin in which their common part begins and nowhere else, so none is found twice.
    """
    def binned(df: DataFrame, p: str) -> DataFrame:
        rows = df.where(F.col("end") >= F.col("start")).select(*(F.col(c).alias(f"{p}{c}") for c in (cid, "start", "end", "label")))
        return rows.withColumn(f"{p}bin", F.explode(F.sequence(F.expr(f"{p}start div {bin_width}"), F.expr(f"{p}end div {bin_width}"))))

    a, b = binned(predicted, "a_"), binned(base, "b_")
    first = F.greatest("a_start", "b_start")
    met = a.join(b, (F.col(f"a_{cid}") == F.col(f"b_{cid}")) & (F.col("a_bin") == F.col("b_bin")) & (F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start")))
    met = met.withColumn("__first", first).where(F.col("a_bin") == F.expr(f"__first div {bin_width}"))
    return met.select(F.col(f"a_{cid}").alias(cid), F.col("__first").alias("start"), F.least("a_end", "b_end").alias("end"), F.col("a_label").alias("label"), F.col("b_label").alias("base_label"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def precision_recall(met: DataFrame, predicted: DataFrame, base: DataFrame, cid: str) -> DataFrame:
    """(cid, time_p, time_r, time_f1, label_p, label_r, label_f1) of each video with clips on either side.

    Time: the sum of common parts of equal labels over the sum of lengths, where clips that overlap count twice. Label:
    the number of different such parts over the number of clips, which may exceed 1. 0 over 0 is 0.
    """
    length = (F.col("end") - F.col("start")).cast("double")
    right = met.where(F.col("label") == F.col("base_label")).groupBy(cid).agg(F.sum(length).alias("t"), F.countDistinct("start", "end", "label").alias("n"))
    side = lambda df, p: df.groupBy(cid).agg(F.sum(length).alias(f"{p}t"), F.count(F.lit(1)).alias(f"{p}n"))
    all_ = side(predicted, "p").join(side(base, "b"), cid, "full").join(right, cid, "left")
    got = all_.select(cid, _ratio(F.col("t"), F.col("pt")).alias("time_p"), _ratio(F.col("t"), F.col("bt")).alias("time_r"), _ratio(F.col("n"), F.col("pn")).alias("label_p"), _ratio(F.col("n"), F.col("bn")).alias("label_r"))
    return got.select(cid, "time_p", "time_r", _f1(F.col("time_p"), F.col("time_r")).alias("time_f1"), "label_p", "label_r", _f1(F.col("label_p"), F.col("label_r")).alias("label_f1"))


def threshold_grid(rated: DataFrame, cid: str, lefts: list[float], rights: list[float]) -> DataFrame:
    """(cid, left, right, kept): for each pair of thresholds the number of windows that highlights would keep.

    The ratings are read once: each video's windows are one array of ratings, summed up by value before, and the pairs
    are columns of its row.
    """
    by = Window.partitionBy(cid)
    levels = rated.where(F.col("rating").isNotNull()).groupBy(cid, "rating").agg(F.count(F.lit(1)).alias("n")).withColumns({"low": F.min("rating").over(by), "high": F.max("rating").over(by)})
    pairs = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a in lefts for b in rights))
    kept = F.sum(F.when(F.col("rating") > F.col("p.left") * F.col("low") + F.col("p.right") * F.col("high"), F.col("n")).otherwise(0))
    return levels.withColumn("p", F.explode(pairs)).groupBy(cid, F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(kept.cast("bigint").alias("kept"))
