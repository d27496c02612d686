"""Numbers, play times and clock positions written in many ways, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every blank that Unicode knows, and characters without width.
BLANK = r"[\s\p{Z}\p{Cf}\p{Cc}]"

FULL_WIDTH_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def stripped(text: Column) -> Column:
    """text without blanks of any kind around it; blanks inside stay."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def whole_number(text: Column) -> Column:
    """The whole number that text names, as BIGINT; null where it names none or one beyond BIGINT.

    ``42``, ``" 042"``, ``"42.0"``, ``"+42"``, ``"4.2E1"`` and full-width digits name the same number.
    Most rows are plain digits and leave at the first cast; only the rest is cleaned by patterns.
    """
    plain = F.when(text.rlike(r"^[0-9]{1,18}$"), text.try_cast("bigint"))
    exact = F.translate(stripped(text), FULL_WIDTH_DIGITS, DIGITS).try_cast("decimal(38,9)")
    return F.coalesce(plain, F.when(exact == F.floor(exact), exact.try_cast("bigint")))


def identifier(text: Column) -> Column:
    """A key that is equal for two spellings of one number, and for other texts equal without outer blanks.

    Null for null and blank texts: these identify nothing.
    """
    rest = stripped(text)
    return F.coalesce(whole_number(text).cast("string"), F.when(rest != "", F.concat(F.lit("="), rest)))


def play_micros(text: Column) -> Column:
    """Decimal seconds as whole microseconds (BIGINT), half up; null where text is no number."""
    return (F.round(F.translate(stripped(text), FULL_WIDTH_DIGITS, DIGITS).try_cast("decimal(38,14)") * 1_000_000, 0)).try_cast("bigint")


def clock_seconds(text: Column) -> Column:
    """A position in a video as whole seconds (INT); null where the text has no plain reading.

    Read are ``MM:SS`` (minutes may pass 59), ``H:MM:SS``, full-width digits and colons, unit forms such as
    ``63m43s``, ``12分9秒``, ``1小时2分`` or ``716 s``, and a bare number of seconds.
    """
    t = F.lower(F.regexp_replace(F.translate(text, FULL_WIDTH_DIGITS + "：", DIGITS + ":"), BLANK, ""))
    colons = F.split(t, ":")
    units = r"^(?:(\d+)(?:h|hr|hrs|hours?|小时|小時|時間|时|時))?(?:(\d+)(?:m|min|mins|minutes?|分钟|分鐘|分))?(?:(\d+)(?:\.0*)?(?:s|sec|secs|seconds?|秒)?)?$"

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(t, units, i), F.lit("")).try_cast("bigint"), F.lit(0))

    long = (
        F.when(t.rlike(r"^\d+:\d{1,2}$"), colons[0].try_cast("bigint") * 60 + colons[1].try_cast("bigint"))
        .when(t.rlike(r"^\d+:\d{1,2}:\d{1,2}$"), colons[0].try_cast("bigint") * 3600 + F.get(colons, F.lit(1)).try_cast("bigint") * 60 + F.get(colons, F.lit(2)).try_cast("bigint"))
        .when(t.rlike(r"\d") & t.rlike(units), part(1) * 3600 + part(2) * 60 + part(3))
    )
    return long.try_cast("int")
