"""The same windows, deliveries and highlights over streams."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hilite.operators.dedupe import first_of_each
from hilite.operators.rating import highlights, rate_windows
from hilite.session import exists
from hilite.sources.live import parsed


def tumbling(stream: DataFrame, time: str, width: str, by: list[str], *, late: str | None = None) -> DataFrame:
    """(start, end, by, comments) of a stream; late: how long rows may be late, later ones are dropped and windows closed."""
    rows = stream.withWatermark(time, late) if late else stream
    return rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("comments")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "comments")


def sliding(stream: DataFrame, time: str, width: str, slide: str, by: list[str], *, late: str | None = None) -> DataFrame:
    rows = stream.withWatermark(time, late) if late else stream
    return rows.groupBy(F.window(time, width, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("comments")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "comments")


def once(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """A stream with one delivery of each message, of those at most late apart; state older than that goes. For copies that come any time later see new_only."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def first_deliveries(stream: DataFrame, key: str) -> DataFrame:
    """A stream with the first delivery of each message however late others come: the keys of all messages are its state, in the stream's own state store, and no stored rows are read again."""
    return stream.dropDuplicates([key])


def new_only(path: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the first delivery of each message that the table at path doesn't have, however late it comes.

    For tables that others write to as well, whose keys each batch reads; first_deliveries keeps them itself. A batch
    that runs again after a failure finds its keys stored and adds nothing.
    """
    def write(batch: DataFrame, _: int) -> None:
        first = first_of_each(batch, key, order)
        if exists(batch.sparkSession, path):
            first = first.join(batch.sparkSession.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        first.write.mode("append").parquet(path)

    return write


def rated(path: str, cid: str, topic: str, topics: int, left: float, right: float) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in complete mode over counts (cid, start, topic, comments): writes the highlights of all windows so far; the thresholds need them all."""
    def write(batch: DataFrame, _: int) -> None:
        r = rate_windows(batch, [cid, "start"], "comments", F.lit(topics))
        highlights(r, cid, left, right).write.mode("overwrite").parquet(path)

    return write


def chat(stream: DataFrame) -> DataFrame:
    """Parsed messages of the livechat source."""
    return parsed(stream, "raw", "recv_time")
