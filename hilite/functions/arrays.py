"""Arrays as column expressions that don't copy what is done for each element."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements in a block of a running sum.
BLOCK = 128
#: Elements of arrays that are summed from the start for each place.
SHORT = 32


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use has it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)


def running_sum(a: Column) -> Column:
    """ARRAY<BIGINT>: at each place the sum of an array of whole numbers up to there; null for null.

    Sums are made within blocks and over the blocks before, so that no place goes through all that is before it.
    """

    def blocks(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / BLOCK).cast("int")
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK))))

    def placed(b: Column) -> Column:
        before = lambda sums: F.transform(sums, lambda _, k: F.when(k == 0, F.lit(0).cast("bigint")).otherwise(total(F.slice(sums, F.lit(1), k))))
        inside = lambda x, first: F.transform(x, lambda _, i: first + total(F.slice(x, F.lit(1), i + 1)))
        starts = bound(F.transform(b, total), before)
        return bound(starts, lambda s: F.flatten(F.transform(b, lambda x, k: inside(x, F.get(s, k)))))

    def short(x: Column) -> Column:
        return F.transform(x, lambda _, i: total(F.slice(x, F.lit(1), i + 1)))

    none = F.array().cast("array<bigint>")
    return bound(a, lambda x: F.when(F.size(x) == 0, none).when(F.size(x) <= SHORT, short(x)).when(F.size(x) > SHORT, bound(blocks(x), placed)))
