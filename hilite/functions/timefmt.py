"""Play times and clock positions as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def play_time_text(seconds: Column) -> Column:
    """``"2 minutes 5 seconds"``, rounded down."""
    return F.format_string("%d minutes %d seconds", F.floor(seconds / 60), F.floor(F.pmod(seconds, F.lit(60))))


def clock_text(seconds: Column) -> Column:
    """Minutes and seconds without padding, ``"75:3"``."""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.pmod(seconds, F.lit(60)).cast("string"))


def now_text(pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.current_timestamp(), pattern)


def cid_of_path(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)
