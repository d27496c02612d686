"""Runs of the same or almost the same event in ordered sequences."""

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from hilite.llm.canonical import SIZE, canonical_points, chunks, decode, kept, kindred, rows_of, tables, texts_of, to_arrow
from hilite.session import written


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Every code point in lower case, and whether it is a letter, digit or mark."""
    lower, keep = np.arange(SIZE, dtype=np.int32), np.zeros(SIZE, bool)
    for cp in (*range(0xD800), *range(0xE000, 0x32000)):
        ch = chr(cp)
        keep[cp] = unicodedata.category(ch)[0] in "LNM"
        low = ch.lower()
        if low != ch:
            lower[cp] = ord(low[0])
    return lower, keep


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts in order of their row; a part: row numbers, code points, starts."""
    size = np.zeros(rows, np.int64)
    for row, _, starts in parts:
        size[row] = np.diff(starts)
    out_starts = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(out_starts[-1], np.int32)
    for row, cp, starts in parts:
        out[np.repeat(out_starts[row] - starts[:-1], np.diff(starts)) + np.arange(len(cp))] = cp
    return out, out_starts


def _pass(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, ids, parts, period = len(starts) - 1, np.arange(len(starts) - 1), [], 1
    while len(cp) > period:
        if period & (period - 1) == 0:  # texts that are too short leave at each power of two
            size = np.diff(starts)
            stay = size >= 2 * period
            if not stay.all():
                by_char = np.repeat(stay, size)
                parts.append((ids[~stay], cp[~by_char], np.concatenate([[0], np.cumsum(size[~stay])])))
                ids, cp, starts = ids[stay], cp[by_char], np.concatenate([[0], np.cumsum(size[stay])])
                if not len(ids):
                    break
        elif 2 * period > np.diff(starts).max():
            break
        row = rows_of(starts)
        same = (cp[:-period] == cp[period:]) & (row[:-period] == row[period:])
        edge = np.diff(same.view(np.int8), prepend=0, append=0)
        first = np.flatnonzero(edge == 1)
        length = np.flatnonzero(edge == -1) - first
        enough = length >= period
        if enough.any():
            first, length = first[enough], length[enough]
            change = np.zeros(len(cp) + 1, np.int32)
            change[first + period] += 1
            np.add.at(change, first + (length + period) // period * period, -1)
            cp, starts = kept(cp, starts, np.cumsum(change[:-1]) == 0)
        period += 1
    if len(ids):
        parts.append((ids, cp, starts))
    return _merged(parts, rows)


def collapse_repeats(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with every character or group that is repeated on the spot there once, shorter groups first, until nothing repeats. Each pass takes time with the square of the longest text that is left."""
    rows, parts = len(starts) - 1, []
    ids = np.arange(rows)
    while len(ids):
        out, out_starts = _pass(cp, starts)
        size = np.diff(out_starts)
        stay = size == np.diff(starts)
        by_char = np.repeat(stay, size)
        parts.append((ids[stay], out[by_char], np.concatenate([[0], np.cumsum(size[stay])])))
        ids, cp, starts = ids[~stay], out[~by_char], np.concatenate([[0], np.cumsum(size[~stay])])
    return _merged(parts, rows)


def near_array(array: pa.Array) -> pa.Array:
    """The near form of each text of a string array."""
    out, (lower, keep) = [], letters()
    for part in chunks(array):
        data, offsets = texts_of(part)
        if not len(data):
            out.append(part)
            continue
        cp, before = decode(data)
        cp, starts = canonical_points(cp, before[offsets], tables())
        cp = lower[kindred()[0][cp]]
        out.append(to_arrow(*collapse_repeats(*kept(cp, starts, keep[cp])), part))
    return pa.concat_arrays([x.cast(pa.string()) for x in out]) if out else array


@arrow_udf(StringType())
def _near(text: pa.Array) -> pa.Array:
    return near_array(text)


def near_form(text: Column) -> Column:
    """text in canonical form and lower case, Han and kana that look alike as one, without punctuation, symbols and blanks, and with everything repeated on the spot there once."""
    return _near(text)


def near_identical(a: Column, b: Column, *, least: int = 6) -> Column:
    """Whether two near forms are equal, or differ in one character if the longer one has at least least characters."""
    return (a == b) | ((F.greatest(F.length(a), F.length(b)) >= least) & (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) >= 0))


def collapse_runs(df: DataFrame, entity: list[str], time: str, tie: str, form: str, alike: Callable[[Column, Column], Column] = near_identical) -> DataFrame:
    """(entity, first_tie, last_tie, first_time, last_time, events, duration): a row for each longest run of events.

    The events of an entity are ordered by time and tie; an event continues the run if alike(form of the one before, its
    own form). Events alone are runs of one. Rows with a null in any of these columns are in no sequence; rows equal in
    all are events of their own.

    All sequences are one global order in slices by range, so that no task gets a whole long sequence: the order is
    written once to the shared folder, and only the first and last rows of slices, as many as there are partitions, are
    broadcast to carry on from slice to slice. Then boundary rows only remain, those that differ from their
    predecessor; the next boundary gives the number of events by its position and the run's end by its predecessor.
    """
    names = [f"e{i}" for i in range(len(entity))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(entity, names, strict=True)), F.col(time).alias("time"), F.col(tie).alias("tie"), F.col(form).alias("form")).dropna()
    order = [*names, "time", "tie"]
    table = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id()), "runs").repartitionByRange("slice")
    row = F.struct(*order, "form")
    inside, across = Window.partitionBy("slice").orderBy(*order), Window.orderBy("slice")
    edges = table.groupBy("slice").agg(F.max(row).alias("last"), F.count(F.lit(1)).alias("n"))
    edges = edges.select(F.col("slice").alias("s"), F.lag("last").over(across).alias("last_before"), (F.sum("n").over(across) - F.col("n")).alias("n_before"),
                         F.max("last").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("very_last"),
                         F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_all"))
    placed = (
        table.withColumns({"before": F.lag(row).over(inside), "at": F.row_number().over(inside)})
        .join(F.broadcast(edges), F.col("slice") == F.col("s"))
        .withColumns({"before": F.coalesce("before", "last_before"), "at": F.col("at") + F.col("n_before")})
    )
    same = alike(F.col("before.form"), F.col("form"))
    for n in names:
        same = (F.col(f"before.{n}") == F.col(n)) & same
    boundary = F.struct("at", F.col("before.time").alias("time"), F.col("before.tie").alias("tie"))
    starts = placed.where(F.col("before").isNull() | ~same).select("slice", *order, "at", boundary.alias("boundary"), F.struct((F.col("n_all") + 1).alias("at"), F.col("very_last.time").alias("time"), F.col("very_last.tie").alias("tie")).alias("end"))
    firsts = starts.groupBy("slice").agg(F.min_by("boundary", "at").alias("b")).select(F.col("slice").alias("s"), F.lead("b").over(across).alias("next_slice"))
    ended = starts.withColumn("next", F.lead("boundary").over(inside)).join(F.broadcast(firsts), F.col("slice") == F.col("s")).withColumn("next", F.coalesce("next", "next_slice", "end"))
    return ended.select(
        *(F.col(n).alias(c) for n, c in zip(names, entity, strict=True)),
        F.col("tie").alias("first_tie"), F.col("next.tie").alias("last_tie"), F.col("time").alias("first_time"), F.col("next.time").alias("last_time"),
        (F.col("next.at") - F.col("at")).alias("events"), (F.col("next.time") - F.col("time")).alias("duration"),
    )
