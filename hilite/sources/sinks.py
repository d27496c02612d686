"""Sinks: comment files by video, checked inserts, and readable tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilite.functions.timefmt import clock_text, play_time_text
from hilite.operators.comments import admitted, valid_inserts
from hilite.session import exists


def append_comments(df: DataFrame, path: str, *, corpus: bool = False) -> None:
    """Append comments to tab-separated files in a folder for each video; corpus: those of admitted videos only."""
    if corpus:
        play = F.col("play_timestamp").try_cast("double")
        df = df.join(admitted(df.withColumn("__play", play), "cid", "__play").select("cid"), "cid", "left_semi")
    df.write.mode("append").partitionBy("cid").option("sep", "\t").option("quote", "").csv(path)


def insert(new: DataFrame, parents: DataFrame, path: str, foreign: str, parent_key: str, key: str) -> bool:
    """Write new to the table at path in one commit if every row has a parent and a key of its own; otherwise write nothing. Whether it was written."""
    spark = new.sparkSession
    stored = spark.read.schema(new.schema).parquet(path).select(key) if exists(spark, path) else new.limit(0).select(key)
    if valid_inserts(new, parents, stored, foreign, parent_key, key).where(F.col("reason").isNotNull()).limit(1).count():
        return False
    new.write.mode("append").parquet(path)
    return True


def write_sorted(df: DataFrame, path: str, play: str) -> None:
    """Comments in order of play time as tab-separated text with the time to read in front."""
    seconds = F.col(play).try_cast("decimal(38,18)")
    rows = df.orderBy(seconds)
    rows.select(play_time_text(F.col(play).try_cast("double")).alias("time"), *rows.columns).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def flat(df: DataFrame) -> DataFrame:
    """df with arrays and structs as JSON, for text files."""
    def text(c: str, kind: str) -> Column:
        return F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c)
    return df.select(*(text(c, k) for c, k in df.dtypes))


def write_table(df: DataFrame, path: str) -> None:
    """Windows, tokens, clips, metrics or clusters as tab-separated text."""
    flat(df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_clips(clips: DataFrame, path: str) -> None:
    """Clips in seconds with their bounds as minutes and seconds."""
    clips.select("cid", clock_text(F.col("start")).alias("start"), clock_text(F.col("end")).alias("end"), "label").write.mode("overwrite").option("sep", "\t").csv(path)


def write_corpus(tokens: DataFrame, path: str) -> None:
    """A training corpus: the words of each text (id, pos, word) in a line, divided by tabs. Partitions are its files."""
    lines = tokens.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    lines.select(F.array_join(F.transform("w", lambda w: w.word), "\t").alias("value")).write.mode("overwrite").text(path)


def write_segments(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("cid").json(path)
