"""Several values packed in one field."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilite.functions.numbers import BLANK, stripped

#: Characters that separate values; the two-character spellings of a tab and a line break do as well.
SEPARATORS = r"\t\n\r|｜,，、;；/／>＞"
SPELLED = r"\\[tn]"
#: Placeholders are OPEN number CLOSE. OPEN in the text itself becomes OPEN ESCAPE, so that none can be mistaken.
OPEN, CLOSE, ESCAPE = "\ue000", "\ue001", "_"

_STRAIGHT = r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"'
_CURLY = r"“[^”]*+”"
#: Blanks that separate nothing, and separators that are no blanks.
_SOFT, _HARD = rf"[\s\p{{Z}}\p{{Cf}}\p{{Cc}}&&[^\t\n\r]]", r"[|｜，,、;；/／>＞]"
#: What is before a quoted span: a separator or the start, with any number of blanks. A run of blanks is only looked at from its first.
_BEFORE = rf"(?:^{BLANK}*+|(?:{_HARD}|{SPELLED}){BLANK}*+|(?<!{BLANK})(?={_SOFT}*+[\t\n\r]){BLANK}++)"
#: A quoted span is a whole value: a separator or an end, with blanks at most, is on either side.
QUOTED = rf"(?s){_BEFORE}({_STRAIGHT}|{_CURLY})(?={BLANK}*(?:$|[{SEPARATORS}]|{SPELLED}))"
LIST = rf"(?s)^{BLANK}*\[({BLANK}*(?:[\"“].*|))\]{BLANK}*$"


def unquoted(span: Column) -> Column:
    """A quoted span without its quotes and quote escapes."""
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    return F.when(span.startswith('"'), F.regexp_replace(inner, r'\\(["\\/])|"(")', "$1$2")).otherwise(inner)


def packed_values(text: Column) -> Column:
    """ARRAY<STRING> of the values packed in text, in order, without empty ones; null and blank texts give an empty array.

    Quoted spans become numbered placeholders, what is left is split at separators, and each placeholder is looked up
    in the array of spans. Brackets around a list of quoted values are dropped. A quote that is not closed before a
    separator or the end is an ordinary character; any number of blanks may be around values. The patterns are
    possessive: very long texts need no deep stack.
    """
    body = F.when(text.rlike(LIST), F.regexp_extract(text, LIST, 1)).otherwise(text)
    spans = F.regexp_extract_all(body, F.lit(QUOTED), F.lit(1))
    between = F.transform(F.split(body, QUOTED, -1), lambda x: F.replace(x, F.lit(OPEN), F.lit(OPEN + ESCAPE)))
    marked = F.array_join(F.transform(between, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("\t" + OPEN), i.cast("string"), F.lit(CLOSE), x))), "")
    pieces = F.transform(F.split(marked, rf"[{SEPARATORS}]|{SPELLED}", -1), stripped)

    def restored(piece: Column) -> Column:
        number = F.regexp_extract(piece, f"^{OPEN}([0-9]+){CLOSE}$", 1).try_cast("int")
        return F.when(number.isNull(), F.replace(piece, F.lit(OPEN + ESCAPE), F.lit(OPEN))).otherwise(stripped(unquoted(F.get(spans, number - 1))))

    values = F.filter(F.transform(pieces, restored), lambda x: x != "")
    return F.when(text.isNotNull(), values).otherwise(F.array().cast("array<string>"))


def explode_packed(df: DataFrame, fields: dict[str, str], key: str) -> DataFrame:
    """(field, rec_key, pos, val): a row for every value that the columns of df hold packed; fields: column to its name in the result.

    Rows of df that are equal in all columns count once: only the key, the packed columns and 128 bits of a hash of the
    whole row are shuffled to find them. pos counts from 1 over the values that are not empty. Null or empty columns
    give no rows, a null key is kept.
    """
    nulls = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in df.columns))
    row = [F.xxhash64(F.lit(seed), nulls, *df.columns).alias(f"__hash{seed}") for seed in (1, 2)]
    own = [F.col(key).alias("rec_key"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(fields))]
    packed = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), packed_values(F.col(f"__{i}")).alias("vals")) for i, name in enumerate(fields.values())))).alias("p")
    return (
        df.select(*own, *row).distinct()
        .select("rec_key", packed)
        .select(F.col("p.field").alias("field"), "rec_key", F.posexplode("p.vals").alias("at", "val"))
        .select("field", "rec_key", (F.col("at") + 1).cast("int").alias("pos"), "val")
    )
