"""Order, refresh and admission of comments, and what an insert must satisfy."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hilite.operators.features import vocabulary


def sort_comments(df: DataFrame, play: str, position: str, *, descending: bool = False) -> DataFrame:
    """df by the number in play, ties by position, in either direction stable."""
    number = F.col(play).try_cast("decimal(38,18)")
    return df.orderBy(number.desc() if descending else number.asc(), position)


def refresh(fetched: DataFrame, stored: DataFrame, position: str, same: list[str], *, tail: int = 5) -> DataFrame:
    """The fetched rows behind the last one that equals, in the columns same, one of the last tail stored rows; all if none does.

    Nulls equal nulls. Both sides are ordered by position; the tail is a bounded, broadcast table.
    """
    last = stored.orderBy(F.desc(position)).limit(tail).select(*(F.col(c).alias(f"__{c}") for c in same)).distinct()
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"__{c}"))
    seen = fetched.join(F.broadcast(last), equal, "left_semi").select(F.coalesce(F.max(position), F.lit(-1)).alias("__seen"))
    return fetched.where(F.col(position) > seen.scalar())


def admitted(comments: DataFrame, cid: str, play: str, *, least: int = 100, per: int = 10) -> DataFrame:
    """(cid, comments, last_play): videos with at least least comments, and one for every per seconds up to the last."""
    by = comments.groupBy(cid).agg(F.count(F.lit(1)).alias("comments"), F.max(F.col(play)).alias("last_play"))
    return by.where((F.col("comments") >= least) & (F.col("last_play") / per <= F.col("comments")))


def valid_inserts(new: DataFrame, parents: DataFrame, stored: DataFrame, foreign: str, parent_key: str, key: str) -> DataFrame:
    """new with reason: why a row can't be inserted (no parent, key stored, key twice in new), or null.

    A batch is written as a whole only if no row has a reason; see hilite.sources.sinks.insert.
    """
    p = parents.select(F.col(parent_key).alias("__parent")).distinct()
    s = stored.select(F.col(key).alias("__stored")).distinct()
    twice = new.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select(F.col(key).alias("__twice"))
    joined = new.join(p, F.col(foreign) == F.col("__parent"), "left").join(s, F.col(key) == F.col("__stored"), "left").join(twice, F.col(key) == F.col("__twice"), "left")
    reason = F.when(F.col("__parent").isNull(), "no parent").when(F.col("__stored").isNotNull(), "stored").when(F.col("__twice").isNotNull(), "twice")
    return joined.withColumn("reason", reason).drop("__parent", "__stored", "__twice")


def video_comments(barrage: DataFrame, video: DataFrame, season: DataFrame) -> DataFrame:
    """Comments with their video's and season's title; comments without a video are left out, videos may lack a season."""
    v = video.dropDuplicates(["aid"]).select(F.col("aid").alias("video_aid"), F.col("title").alias("video_title"), "xinfan_season_id")
    s = season.dropDuplicates(["season_id"]).select(F.col("season_id").alias("xinfan_season_id"), F.col("title").alias("season_title"))
    return barrage.join(v, "video_aid").join(s, "xinfan_season_id", "left")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key: a point lookup, pushed down to the scan."""
    return df.where(F.col(key) == value)


def dense_codes(df: DataFrame, name: str, code: str = "code") -> DataFrame:
    """df with an integer for each different name, in order of the names."""
    names = vocabulary(df, name).withColumnRenamed("token_id", code)
    return df.join(names, name, "left")
