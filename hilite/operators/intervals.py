"""Covered periods and gaps of intervals."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hilite.operators.order import carried, sliced
from hilite.session import written


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, kind, start_sec, end_sec): the longest stretches that the intervals of a key cover, and the gaps between them.

    Sweep line: each interval becomes +1 at its start and -1 at its end, events of one key and second are summed
    before the shuffle, and the prefix sum of the rest is the number of active intervals. A stretch begins where it
    leaves zero and ends where it is zero again; intervals that share an end point leave no event behind there.

    The input is read once, for the summed events, which are written. They are put into one order of all keys, cut into
    slices by range, so that no task sweeps a whole key; as the events of a key sum up to 0, the prefix sum over all
    keys is that of each. The sums of earlier slices and the first edge of the next, as many as there are slices, are
    broadcast. start and end are whole numbers.

    Intervals without key, start or end, or not ending after they start, do not count. A key with one stretch has no gap.
    """
    events = (
        df.where(F.col(key).isNotNull() & (F.col(end) > F.col(start)))
        .select(F.col(key).alias("k"), F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("by")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("by")))).alias("e"))
        .groupBy("k", F.col("e.at").alias("at"))
        .agg(F.sum("e.by").alias("by"))
        .where(F.col("by") != 0)
    )
    placed = sliced(written(events, "events"), ["k", "at"])
    inside, across = Window.partitionBy("slice").orderBy("k", "at"), Window.orderBy("slice")
    sums = carried(placed, F.sum("by").alias("sum")).select(F.col("slice").alias("s"), (F.sum("sum").over(across) - F.col("sum")).alias("before"))
    swept = placed.join(F.broadcast(sums), F.col("slice") == F.col("s")).withColumn("active", F.col("before") + F.sum("by").over(inside))
    edges = swept.where((F.col("active") == 0) | (F.col("active") == F.col("by"))).select("slice", "k", "at", "active")
    edge = F.struct("k", "at")
    following = Window.orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    firsts = carried(edges, F.min(edge).alias("first")).select(F.col("slice").alias("s"), F.first("first", ignorenulls=True).over(following).alias("next_slice"))
    ended = edges.withColumn("next", F.lead(edge).over(inside)).join(F.broadcast(firsts), F.col("slice") == F.col("s")).withColumn("next", F.coalesce("next", "next_slice"))
    return ended.where(F.col("next.k") == F.col("k")).select(
        F.col("k").alias(key), F.when(F.col("active") == 0, "gap").otherwise("period").alias("kind"), F.col("at").alias("start_sec"), F.col("next.at").alias("end_sec")
    )
