"""Places in an order, without a task for each entity."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hilite.session import written


def sliced(df: DataFrame, order: list[str], name: str = "slice") -> DataFrame:
    """df with name: the slices of its order by range, as many as partitions. Written to the shared folder, as ranges are sampled and would differ where df is read again."""
    return written(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "slices")


def carried(placed: DataFrame, *what: Column) -> DataFrame:
    """(slice, what): an aggregate of each slice, to be carried on to later ones in one small task: a row for each slice that has any."""
    return placed.groupBy("slice").agg(*what)


def positions(df: DataFrame, entity: list[str], order: list[str], name: str) -> DataFrame:
    """df with name, each row's place from 0 among those of its entity by order; ties in any order, nulls first. No entity: the place among all rows.

    The rows are cut into slices by range of entity and order, written once to the shared folder, and numbered in each
    slice; the rows of the entity in earlier slices are added. A large entity spans many slices.
    """
    placed = sliced(df, [*entity, *order], "__slice")
    key = [*entity, "__slice"]
    before = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    running = F.sum("__n").over(Window.partitionBy(*entity).orderBy("__slice")) - F.col("__n")
    before = before.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(key)), running.alias("__before"))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    within = placed.withColumn("__at", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return within.join(before, same).select(*df.columns, (F.col("__before") + F.col("__at") - 1).alias(name))
