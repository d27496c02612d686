"""Joins with keys of very uneven frequency."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def join_by_frequency(df: DataFrame, key: str, table: DataFrame, rows: str, spread: list[str], *, hot_rows: int = 1_000_000, how: str = "left", salt: str = "__salt", merge: bool = False) -> DataFrame:
    """df joined with table on key, where table has one row a key and in its column rows the number of rows of df that have it.

    Keys of more than hot_rows rows are cut into SALTS parts by a hash of the columns spread, and their row of table is
    repeated for each part; all others have part 0. Only the hot keys are broadcast, at most (rows of df) / hot_rows.
    The result has the part as column salt. key must not be null in df. merge: neither side is broadcast, however small
    its files are; of a table that is read again they are much smaller than its rows.
    """
    hot = table.where(F.col(rows) > hot_rows).select(F.col(key).alias("__hot"))
    # without coalesce it may be null to the optimizer, whose filter against that keeps exchanges from being reused
    part = F.coalesce(F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")), F.lit(0))
    left = df.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn(salt, part).drop("__hot")
    parts = F.when(F.col(rows) > hot_rows, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.withColumnRenamed(key, "__key").withColumn("__part", F.explode(parts))
    return left.join(right.hint("merge") if merge else right, (F.col(key) == F.col("__key")) & (F.col(salt) == F.col("__part")), how).drop("__key", "__part")
