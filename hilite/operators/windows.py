"""Windows over play time. Times and widths are whole microseconds; a window's index is integer division, never a rounded quotient."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilite.operators.skew import join_by_frequency

#: Windows of a video from which its edges are cut, and how many at each end.
TRIM_ABOVE, TRIM = 180, 6


def _spine(df: DataFrame, cid: str, last: Column) -> DataFrame:
    return df.groupBy(cid).agg(last.alias("__last")).where(F.col("__last") >= 0).select(cid, F.explode(F.sequence(F.lit(0).cast("bigint"), "__last")).alias("window_index"))


def tumbling(comments: DataFrame, cid: str, time: str, width: int, words: str | None = None) -> DataFrame:
    """(cid, window_index, start, end, comments, words): half-open windows of a video from 0 to its last comment, empty ones as well.

    words: a column with the number of words of a comment. Comments without cid or time, or before 0, are in no window.
    """
    n = F.sum(words) if words else F.lit(0).cast("bigint")
    rows = comments.where((F.col(time) >= 0) & F.col(cid).isNotNull())
    counts = rows.groupBy(cid, F.expr(f"`{time}` div {width}").alias("window_index")).agg(F.count(F.lit(1)).alias("comments"), n.alias("words"))
    spine = _spine(counts, cid, F.max("window_index"))
    filled = spine.join(counts, [cid, "window_index"], "left")
    return filled.select(cid, "window_index", (F.col("window_index") * width).alias("start"), ((F.col("window_index") + 1) * width).alias("end"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("comments", "words")))


def sliding(comments: DataFrame, cid: str, time: str, width: int, slide: int) -> DataFrame:
    """(cid, window_index, start, end, comments): windows of width that begin at every multiple of slide up to the last comment, without empty ones."""
    rows = comments.where((F.col(time) >= 0) & F.col(cid).isNotNull())
    last = F.expr(f"`{time}` div {slide}")
    first = F.greatest(F.lit(0).cast("bigint"), F.when(F.col(time) < width, F.lit(0).cast("bigint")).otherwise(F.expr(f"(`{time}` - {width}) div {slide}") + 1))
    exploded = rows.where(first <= last).select(cid, F.explode(F.sequence(first, last)).alias("window_index"))
    return exploded.groupBy(cid, "window_index").agg(F.count(F.lit(1)).alias("comments")).select(cid, "window_index", (F.col("window_index") * slide).alias("start"), (F.col("window_index") * slide + width).alias("end"), "comments")


def _labelled(intervals: DataFrame, rows: DataFrame, cid: str, time: str, width: int, made: Callable[[DataFrame, list[str]], DataFrame], start: str, end: str, label: str) -> DataFrame:
    """(cid, start, end, label, window_index, and what made gives for each window's rows): the windows of labelled."""
    w = intervals.where((F.col(end) > F.col(start)) & (F.col(start) >= 0)).select(cid, F.col(label).alias("label"), F.col(start).alias("__first"), F.col(end).alias("__last"), F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(width).cast("bigint"))).alias("start"))
    w = w.withColumn("end", F.col("start") + width)
    key = [cid, "label", "__first", "__last", "start", "end"]
    bins = w.distinct().withColumn("__bin", F.explode(F.array(F.expr(f"start div {width}"), F.expr(f"end div {width}"))))
    c = rows.withColumns({"__cid": F.col(cid), "__time": F.col(time), "__at": F.expr(f"`{time}` div {width}")}).select(*(F.col(x).alias(x if x.startswith("__") else f"__row_{x}") for x in ("__cid", "__time", "__at", *rows.columns)))
    # merged: bins are many more than the intervals by whose size they would be broadcast
    met = bins.join(c.hint("merge"), (F.col(cid) == F.col("__cid")) & (F.col("__bin") == F.col("__at")) & F.col("__time").between(F.col("start"), F.col("end")))
    got = made(met, key)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    more = [x for x in got.columns if x not in key]
    joined = w.join(got.select(*(F.col(k).alias(f"_{k}") for k in key), *more).hint("merge"), same, "left")
    return joined.select(cid, "start", "end", "label", F.expr(f"start div {width}").alias("window_index"), *more)


def labelled(intervals: DataFrame, comments: DataFrame, cid: str, time: str, width: int, *, start: str = "start", end: str = "end", label: str = "label") -> DataFrame:
    """(cid, start, end, label, window_index, comments): training windows of width from an interval's start while they begin before its end.

    They are closed at both ends: a comment at a common edge is in both. Bounds and times are in the same unit. The
    join is by cid and window-sized bins, a window meets two of them; its bounds are checked after that. A window
    without comments has 0.
    """
    counts = lambda met, key: met.groupBy(*key).agg(F.count(F.lit(1)).alias("comments"))
    return _labelled(intervals, comments.select(cid, time), cid, time, width, counts, start, end, label).withColumn("comments", F.coalesce("comments", F.lit(0)))


def labelled_items(intervals: DataFrame, items: DataFrame, cid: str, time: str, topic: str, width: int, *, start: str = "start", end: str = "end", label: str = "label") -> DataFrame:
    """(cid, start, end, label, window_index, n): the windows of labelled, each with the map of its own items' topics to their counts, null without any.

    An item at a common edge of two windows is in both, as comments are there. Items without a topic don't count.
    """

    def counts(met: DataFrame, key: list[str]) -> DataFrame:
        n = met.groupBy(*key, f"__row_{topic}").agg(F.count(F.lit(1)).cast("double").alias("n"))
        return n.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(f"__row_{topic}", "n"))).alias("n"))

    return _labelled(intervals, items.where(F.col(topic).isNotNull()).select(cid, time, topic), cid, time, width, counts, start, end, label)


def trim_edges(windows: DataFrame, cid: str, index: str = "window_index", *, above: int = TRIM_ABOVE, cut: int = TRIM) -> DataFrame:
    """windows without the first and last cut ones of each video that has more than above of them.

    Windows are numbered without holes, as tumbling gives them, so a video's first and last number, an aggregate that
    is joined back, tell which are its edges.
    """
    ends = windows.groupBy(cid).agg(F.min(index).alias("__first"), F.max(index).alias("__last"), F.count(F.lit(1)).alias("__n"))
    joined = join_by_frequency(windows.where(F.col(cid).isNotNull()), cid, ends, "__n", [index], how="inner", merge=True)
    inside = F.col(index).between(F.col("__first") + cut, F.col("__last") - cut)
    return joined.where((F.col("__n") <= above) | inside).select(*windows.columns)
