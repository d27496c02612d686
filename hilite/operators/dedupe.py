"""One copy of each message that was delivered at least once."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hilite.operators.skew import join_by_frequency


def flag_first(df: DataFrame, key: str, order: Sequence[str], *, flag: str = "is_first", hot_rows: int = 1_000_000) -> DataFrame:
    """df with the boolean column flag: true for exactly one row of each key, the first by order.

    Keys are split by their aggregated frequency. Those seen once pass without a rank. Rows of repeated keys are
    ranked; a key of more than hot_rows rows is ranked in parts first, and then once more among the parts'
    first rows, so that no task gets a whole hot key. The broadcast table holds the hot keys only: at most
    (rows of df) / hot_rows.

    Rows without a key are no copies of anything: all are true. Rows equal in key and order: one of them is true,
    whichever comes first. Other columns, of any name but flag and those beginning with ``__``, stay as they are.
    """
    n, salt, rank = "__n", "__salt", "__rank"
    whole = df.where(F.col(key).isNull()).withColumn(flag, F.lit(True))
    df = df.where(F.col(key).isNotNull())
    often = df.groupBy(key).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    tagged = join_by_frequency(df, key, often, n, [*order], hot_rows=hot_rows, salt=salt)
    helpers = (n, salt)

    once = tagged.where(F.col(n).isNull()).drop(*helpers).withColumn(flag, F.lit(True))
    repeated = tagged.where(F.col(n).isNotNull())
    within = repeated.withColumn(rank, F.row_number().over(Window.partitionBy(key, salt).orderBy(*order)))
    leaders = (F.col(n) > hot_rows) & (F.col(rank) == 1)
    settled = within.where(~leaders).withColumn(flag, F.col(rank) == 1).drop(*helpers, rank)
    top = within.where(leaders).withColumn(flag, F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1).drop(*helpers, rank)
    return once.unionByName(settled).unionByName(top).unionByName(whole)


def first_of_each(df: DataFrame, key: str, order: Sequence[str], *, hot_rows: int = 1_000_000) -> DataFrame:
    """Exactly one row of each key, the first by order; see flag_first."""
    return flag_first(df, key, order, flag="__first", hot_rows=hot_rows).where("__first").drop("__first")


def without_copies(df: DataFrame, key: str, order: Sequence[str], row: str, *, hot_rows: int = 1_000_000) -> DataFrame:
    """As first_of_each, for wide rows that have an identifier of their own, row: copies are found on key, order and row
    alone, and their rows left out by an anti join, so that the other columns are shuffled once and filters on them
    reach the scan."""
    narrow = df.select(*dict.fromkeys([key, *order, row]))
    copies = flag_first(narrow, key, order, flag="__first", hot_rows=hot_rows).where(~F.col("__first")).select(row)
    return df.join(copies, row, "left_anti").select(*df.columns)


def merge_deliveries(stored: DataFrame, new: DataFrame, key: str, order: Sequence[str], *, hot_rows: int = 1_000_000) -> DataFrame:
    """What the store holds after a new batch: one row for each key of both, stored rows before new ones.

    Both have the same columns. stored may hold copies itself. An empty side is no special case.
    """
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_of_each(both, key, ["__new", *order], hot_rows=hot_rows).drop("__new")
