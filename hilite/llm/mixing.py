"""Mixing sources to target weights."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of a source in one cell of the prefix sum, on average at most.
CELL = 50_000


@dataclass(frozen=True)
class Target:
    source: str
    weight: float
    repeats: int


def targets_of(table: DataFrame) -> list[Target]:
    """The rows (source, target_weight, max_repeats) of a table of targets, a row for each source; without nulls and weights of 0."""
    return [Target(r.source, r.target_weight, r.max_repeats) for r in table.dropna().collect() if r.target_weight > 0 and r.max_repeats > 0]


def draw_mixture(items: DataFrame, item: str, source: str, size: str, targets: list[Target], *, total: float | None = None, seed: int = 1, cell: int = CELL) -> DataFrame:
    """(item, source, size, copy): the items of a mixture in which each source has its target share of the total size.

    total is the size of the mixture; by default the largest that reaches every target within the repeats of its
    source, sources without any size left out. Each item of a source is expected equally often, and the running sum of
    these expectations, begun at one random offset, emits an item once for every whole number it crosses: as often as
    expected, rounded up or down, never more than the source's repeats. The order is by size and then at random, so
    sizes are drawn evenly.

    The running sum is a rank within cells of at most about cell items, by size and a hash of the item, plus the number of items in
    earlier cells: no task gets a whole source. Items with a null id, source or size, and sources that aren't targets,
    are not drawn. items is read twice: give a written table if it is costly.
    """
    rows = items.select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size")).dropna().where(F.col("source").isin([t.source for t in targets]))
    there = {r.source: r for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    own = [t for t in targets if t.source in there and there[t.source].size > 0]
    weights = sum(t.weight for t in own)
    if total is None:
        total = min((t.repeats * there[t.source].size / (t.weight / weights) for t in own), default=0)
    plan = [(t.source, min(float(t.repeats), t.weight / weights * total / there[t.source].size), max(1, -(-there[t.source].n // cell))) for t in own]
    expected = items.sparkSession.createDataFrame(plan, "s string, each double, cells int")

    key = ["source", "step", "cell"]
    placed = (
        rows.join(F.broadcast(expected), F.col("source") == F.col("s"))
        .withColumns({"step": F.floor(F.log2(F.col("size") + 1)), "hash": F.xxhash64("item", F.lit(seed))})
        .withColumn("cell", F.floor((F.col("hash") / 2.0**64 + 0.5) * F.col("cells")))
    )
    earlier = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*(F.col(k).alias(f"_{k}") for k in key), (F.sum("n").over(Window.partitionBy("source").orderBy("step", "cell")) - F.col("n")).alias("earlier"))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    place = F.col("earlier") + F.row_number().over(Window.partitionBy(*key).orderBy("size", "hash", "item"))
    crossed = F.floor(place * F.col("each") + offset) - F.floor((place - 1) * F.col("each") + offset)
    return (
        placed.join(earlier, same).select("item", "source", "size", crossed.alias("copies")).where(F.col("copies") > 0)
        .select(F.col("item").alias(item), F.col("source").alias(source), F.col("size").alias(size), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    )


def reached_shares(mixture: DataFrame, source: str, size: str, targets: list[Target]) -> DataFrame:
    """(source, target, items, most_copies, size, share): what each target got of the mixture; 0 for a source without items."""
    got = mixture.groupBy(source).agg(F.count(F.lit(1)).alias("items"), F.max("copy").alias("most_copies"), F.sum(size).alias(size))
    wanted = mixture.sparkSession.createDataFrame([(t.source, t.weight) for t in targets], "source string, target double")
    all_ = F.sum(F.coalesce(F.col(size), F.lit(0))).over(Window.partitionBy(F.lit(1)))
    return wanted.join(got.withColumnRenamed(source, "source"), "source", "left").select(
        "source", "target", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(size, F.lit(0)).alias(size), F.coalesce(F.try_divide(F.col(size), all_), F.lit(0.0)).alias("share")
    )
