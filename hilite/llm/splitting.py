"""Splitting oversized items at natural boundaries."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilite.functions.arrays import bound, running_sum
from hilite.llm.tokens import BLANK, BROKEN, CLAUSE, LINE, PARAGRAPH, SENTENCE, VOCABULARY, token_map


@dataclass(frozen=True)
class Limit:
    tokens: int
    overlap: int = 0

    def __post_init__(self):
        if not 0 <= self.overlap < self.tokens:
            raise ValueError("the overlap must be less than the limit")


def piece_pattern(n: int) -> str:
    """A pattern that takes up to n tokens from a row of boundary classes: all that is left, or as much as ends at the
    strongest boundary beyond half of n, or as much as ends with a character."""
    least = (n - 1) // 2
    strong = "|".join(f".{{{least},{n - 1}}}{c}" for c in (PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK))
    return rf".{{1,{n}}}\z|{strong}|.{{0,{n - 1}}}[^{BROKEN}]|.*?[^{BROKEN}]"


def pieces(text: Column, classes: Column, ends: Column, limit: Limit) -> Column:
    """ARRAY<STRUCT<max_tokens, piece, start_token, tokens, text>> of one text, by its tokens' boundary classes and ends in bytes.

    What a piece needs of text and classes is cut out of their bytes, which takes no longer far behind in the text.
    """
    fresh = limit.tokens - limit.overlap
    pattern = piece_pattern(fresh) if not limit.overlap else rf"\A(?:{piece_pattern(limit.tokens)})|{piece_pattern(fresh)}"
    stops = running_sum(F.transform(F.regexp_extract_all(classes, F.lit(pattern), F.lit(0)), F.length))

    def piece(x: Column, stop: Column, i: Column) -> Column:
        before = F.coalesce(F.get(x["stops"], i - 1), F.lit(0)).cast("int")
        back = F.greatest(before - F.when(i > 0, limit.overlap).otherwise(0), F.lit(0))
        broken = F.when(back == 0, 0).otherwise(F.length(F.regexp_extract(F.substring(x["classes"], back, F.lit(8)).cast("string"), f"^{BROKEN}*", 0)))
        return bound(F.struct(before.alias("before"), F.least(back + broken, before).alias("start"), stop.cast("int").alias("stop")), lambda y: cut(x, y, i))

    def cut(x: Column, y: Column, i: Column) -> Column:
        first = F.coalesce(F.get(ends, y["start"] - 1), F.lit(0))
        return F.struct(
            F.lit(limit.tokens).alias("max_tokens"), (i + 1).cast("int").alias("piece"), y["start"].alias("start_token"), (y["stop"] - y["start"]).alias("tokens"),
            F.substring(x["data"], first + 1, F.get(ends, y["stop"] - 1) - first).cast("string").alias("text"),
        )

    whole = F.struct(text.cast("binary").alias("data"), classes.cast("binary").alias("classes"), stops.alias("stops"))
    return bound(whole, lambda x: F.transform(x["stops"], lambda stop, i: piece(x, stop, i)))


def split_items(df: DataFrame, item: str, text: str, limits: list[Limit], *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(item, max_tokens, piece, start_token, tokens, text): the pieces of each text for each limit, none of more tokens.

    A text within the limit is one piece. A larger one is cut behind a paragraph, else a line, a sentence, a clause or a
    blank, where one ends in the second half of what fits, else behind a character. From the second on, a piece begins
    overlap tokens before the end of the one before it, up to three less where that is within a character; without that
    overlap the pieces make up the text. Tokens are those of the whole text; a piece by itself never has more.

    Null and empty texts have no piece. A limit below the tokens of one character (4) may be exceeded by that
    character. Nothing is shuffled, and a text's pieces are made in the task that reads it.
    """
    rows = df.where(F.col(text) != "").select(F.col(item).alias("item"), F.col(text).alias("text")).withColumn("map", token_map(df.sparkSession, F.col("text"), vocabulary))
    every = F.flatten(F.array(*(pieces(F.col("text"), F.col("map.classes"), F.col("map.ends"), x) for x in limits)))
    return rows.select(F.col("item").alias(item), F.inline(every))
