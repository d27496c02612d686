"""The token pipeline, one function for each rule, to be applied in this order.

Tokens are rows (id, pos, word, flag); rules that look at a token's neighbours work on the array of a text's tokens
before it becomes rows, so that no text is put together again by a shuffle.
"""

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from hilite.functions.arrays import bound, running_sum
from hilite.operators.order import positions
from hilite.session import written

WORDS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]"
TOKEN = rf"(?s)[A-Za-z]+|[0-9]+|{WORDS}+|\s+|."


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _token(word: Column, pos: Column) -> Column:
    flag = F.when(word.rlike("^[A-Za-z]"), "eng").when(word.rlike("^[0-9]"), "m").when(word.rlike(f"^{WORDS}"), "n").when(word.rlike(r"^\s"), "w").otherwise("x")
    return F.struct(pos.alias("pos"), word.alias("word"), flag.alias("flag"))


def token_array(text: Column) -> Column:
    """ARRAY<STRUCT<pos, word, flag>> of a text cut where the kind of character changes: eng, m for digits, n for Han and kana, w for blanks, x for each other character; empty for null and empty texts."""
    return F.transform(_words(text), _token)


def token_rows(df: DataFrame, id_: str, tokens: Column) -> DataFrame:
    """(id, and the fields of tokens): a row for each token of an array of them."""
    return df.select(F.col(id_).alias("id"), F.inline(tokens))


def tokenize(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, pos, word, flag) of a text, see token_array; the flags are found after the explode, where they are compiled."""
    rows = df.where(F.col(text) != "").select(F.col(id_).alias("id"), F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("pos", "word"))
    flag = F.when(F.col("word").rlike("^[A-Za-z]"), "eng").when(F.col("word").rlike("^[0-9]"), "m").when(F.col("word").rlike(f"^{WORDS}"), "n").when(F.col("word").rlike(r"^\s"), "w").otherwise("x")
    return rows.withColumn("flag", flag)


def cut(text: str, words: dict[str, tuple[float, str]], longest: int) -> list[tuple[str, str]]:
    """The most probable cut of text into words of a dictionary and runs of Latin letters or digits; other characters are words of their own.

    words: a word to its log probability and flag. Of cuts equally probable the one with the longest first word.
    """
    floor = min((p for p, _ in words.values()), default=0.0) - 10.0
    n = len(text)
    best: list[tuple[float, int, str]] = [(0.0, n, "")] * (n + 1)
    for i in range(n - 1, -1, -1):
        c = text[i]
        found = [(floor + best[i + 1][0], i + 1, "x")]
        if c.isascii() and c.isalnum():
            kind = str.isdigit if c.isdigit() else str.isalpha
            j = i + 1
            while j < n and text[j].isascii() and kind(text[j]):
                j += 1
            found.append((floor + best[j][0], j, "m" if c.isdigit() else "eng"))
        for j in range(i + 1, min(n, i + longest) + 1):
            if hit := words.get(text[i:j]):
                found.append((hit[0] + best[j][0], j, hit[1]))
        best[i] = max(found, key=lambda x: (x[0], x[1]))
    out, i = [], 0
    while i < n:
        _, j, flag = best[i]
        out.append((text[i:j], flag))
        i = j
    return out


def segmenter(dictionary: Iterable[tuple[str, float, str]]):
    """A function of a text column to ARRAY<STRUCT<word, flag>>, with the cut by a dictionary of (word, frequency, flag)."""
    from math import log

    entries = {w: (max(f, 1.0), flag) for w, f, flag in dictionary}
    total = sum(f for f, _ in entries.values()) or 1.0
    words = {w: (log(f / total), flag) for w, (f, flag) in entries.items()}
    longest = max(map(len, words), default=1)

    @arrow_udf(ArrayType(StructType([StructField("word", StringType()), StructField("flag", StringType())])))
    def segment(texts: pa.Array) -> pa.Array:
        once = cache(lambda t: [{"word": w, "flag": f} for w, f in cut(t, words, longest)])
        kind = pa.list_(pa.struct([("word", pa.string()), ("flag", pa.string())]))
        return pa.array([None if t is None else once(t) for t in texts.to_pylist()], kind)

    return segment


def exploded(df: DataFrame, id_: str, segments: str) -> DataFrame:
    return df.select(F.col(id_).alias("id"), F.posexplode(segments).alias("pos", "s")).select("id", "pos", "s.word", "s.flag")


def with_offsets(tokens: Column) -> Column:
    """An array of tokens with the first and last character of each, counted from 0 over all of them, as start_position and end_position. All work is in the text's row."""
    place = lambda t, end: F.struct(t["pos"].alias("pos"), t["word"].alias("word"), t["flag"].alias("flag"), (end - F.length(t["word"])).alias("start_position"), (end - 1).alias("end_position"))
    return bound(tokens, lambda x: F.zip_with(x, running_sum(F.transform(x, lambda t: F.length(t["word"]))), place))


def with_emoji_runs(tokens: Column) -> Column:
    """An array of tokens with each unbroken run of two or more tokens of flag x as one token of flag emoji, at the place of its first. All work is in the text's row."""

    def merged(x: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (i == 0) | (i == F.size(x)) | (F.get(x, i)["flag"] != "x") | (F.get(x, i - 1)["flag"] != "x"))
        return bound(begins, lambda b: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda i, k: token(x, i, F.get(b, k + 1) - i)))

    def token(x: Column, i: Column, n: Column) -> Column:
        one = F.get(x, i)
        word = F.when(n == 1, one["word"]).otherwise(F.array_join(F.transform(F.slice(x, i + 1, n), lambda t: t["word"]), ""))
        return F.struct(one["pos"].alias("pos"), word.alias("word"), F.when(n > 1, "emoji").otherwise(one["flag"]).alias("flag"))

    return bound(tokens, merged)


def lower_english(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("word", F.when(F.col("flag") == "eng", F.lower("word")).otherwise(F.col("word")))


def without_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """tokens without those whose word is in the column word of words, such as stopwords or rejected punctuation."""
    return tokens.join(words.select("word").distinct(), "word", "left_anti").select(*tokens.columns)


@dataclass(frozen=True)
class Rule:
    pattern: str
    word: str
    flag: str


def rewritten(word: Column, rules: Sequence[Rule]) -> Column:
    """STRUCT<word, flag> of the first rule whose pattern matches at word's start, wherever it ends; null where none does.

    All rules as one pattern tell first whether any matches: most words are tried once.
    """
    chain = F.lit(None)
    for r in reversed(rules):
        chain = F.when(word.rlike(f"^(?:{r.pattern})"), F.struct(F.lit(r.word).alias("word"), F.lit(r.flag).alias("flag"))).otherwise(chain)
    # a rule that counts its groups or switches modes must be tried by itself
    together = not any(re.search(r"\\\d|\(\?[a-zA-Z<]", r.pattern) for r in rules)
    return F.when(word.rlike("^(?:" + "|".join(f"(?:{r.pattern})" for r in rules) + ")"), chain) if together else chain


def rewrite(tokens: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """tokens with word and flag of the first rule that matches, see rewritten. Nothing is shuffled: a blank or particle that is everywhere is nobody's key."""
    if not rules:
        return tokens
    made = tokens.withColumn("__to", rewritten(F.col("word"), rules))
    return made.withColumns({"word": F.coalesce("__to.word", "word"), "flag": F.coalesce("__to.flag", "flag")}).select(*tokens.columns)


def emoji_words(word: Column, flag: Column, table: dict[str, str]) -> Column:
    """ARRAY<STRUCT<word, flag>>: the tokens that stand for a token by a table of emoji to word.

    A known emoji is its word. Otherwise known emojis are taken off the front, the longest first, each for its word; if
    there is none in front, off the end. What is left then goes. An unknown token of flag emoji goes, others stay.
    """
    keys = sorted((k for k in table if k), key=lambda k: (-len(k), k))
    token = lambda w, f: F.struct(w.alias("word"), f.alias("flag"))
    none = F.array().cast("array<struct<word: string, flag: string>>")
    rest = F.when(flag == "emoji", none).otherwise(F.array(token(word, flag)))
    if not keys:
        return rest
    words = F.create_map(*(F.lit(x) for k in keys for x in (k, table[k])))
    one = "|".join(map(re.escape, keys))
    backwards = "|".join(re.escape(k[::-1]) for k in keys)
    front = F.regexp_extract(word, f"^(?:{one})+", 0)
    end = F.regexp_extract(F.reverse(word), f"^(?:{backwards})+", 0)
    found = F.regexp_extract_all(front, F.lit(one), F.lit(0))
    behind = F.transform(F.reverse(F.regexp_extract_all(end, F.lit(backwards), F.lit(0))), F.reverse)
    known = F.transform(F.when(front != "", found).otherwise(behind), lambda k: token(F.try_element_at(words, k), F.lit("emoji")))
    whole = F.array(token(F.try_element_at(words, word), F.when(F.length(word) > 1, flag).otherwise("emoji")))
    return F.when(F.try_element_at(words, word).isNotNull(), whole).when((front != "") | (end != ""), known).otherwise(rest)


def substitute_emojis(tokens: DataFrame, table: dict[str, str]) -> DataFrame:
    """tokens with emojis replaced by words, see emoji_words; pos stays that of the token replaced, with the place in it as sub."""
    made = tokens.select("id", "pos", F.posexplode(emoji_words(F.col("word"), F.col("flag"), table)).alias("sub", "s"))
    return made.select("id", "pos", "s.word", "s.flag", "sub")


def without_numbers(tokens: DataFrame, rejected: DataFrame) -> DataFrame:
    """tokens without flags w and m and without rejected punctuation."""
    return without_words(tokens.where(~F.col("flag").isin("w", "m")), rejected)


def _made(token: Column, rules: Sequence[Rule]) -> Column:
    """A token in lower case if it is English, then rewritten."""
    lower = F.when(token["flag"] == "eng", F.lower(token["word"])).otherwise(token["word"])
    to = lambda w: rewritten(w, rules) if rules else F.lit(None).cast("struct<word: string, flag: string>")
    struct = lambda w, x: F.struct(token["pos"].alias("pos"), F.coalesce(x["word"], w).alias("word"), F.coalesce(x["flag"], token["flag"]).alias("flag"))
    return bound(lower, lambda w: bound(to(w), lambda x: struct(w, x)))


def _stays(token: Column, rejected: Sequence[str]) -> Column:
    return ~token["flag"].isin("w", "m") & (~token["word"].isin(*rejected) if rejected else F.lit(True))


def kept_tokens(tokens: Column, rules: Sequence[Rule], rejected: Sequence[str]) -> Column:
    """An array of tokens in lower case, rewritten, and without flags w and m and without rejected punctuation: lower_english, rewrite and without_numbers in the text's row."""
    return F.filter(F.transform(tokens, lambda t: _made(t, rules)), lambda t: _stays(t, rejected))


def has_kept(text: Column, rules: Sequence[Rule], rejected: Sequence[str]) -> Column:
    """Whether kept_tokens of a text's token_array has any; words behind the first that stays are not looked at."""
    return F.exists(_words(text), lambda w: bound(_token(w, F.lit(0)), lambda t: _stays(_made(t, rules), rejected)))


def survivors(comments: DataFrame, kept: Column, cid: str, order: list[str]) -> DataFrame:
    """comments for which kept is true, such as has_kept, with index, their place among these in their video from 0.

    They are written first, as the order by range samples its rows and would look at the texts twice.
    """
    return positions(written(comments.where(kept), "survivors"), [cid], order, "index")


def word_list(segments: Column) -> Column:
    return F.transform(segments, lambda s: s.word)


def accepted(flag: Column, accept: Sequence[str]) -> Column:
    """Whether flag begins with one of the accepted flags."""
    return F.exists(F.array(*map(F.lit, accept)), lambda a: F.startswith(flag, a)) if accept else F.lit(False)


def valid_words(tokens: DataFrame, emotions: DataFrame, negatives: DataFrame, adverbs: DataFrame) -> DataFrame:
    """tokens with valid: the category of an emotion word (category, word), else the word if it is a negative or an adverb, else null."""
    e = emotions.groupBy("word").agg(F.min("category").alias("category"))
    own = negatives.select("word").unionByName(adverbs.select("word")).distinct().withColumn("own", F.col("word"))
    return tokens.join(e, "word", "left").join(own, "word", "left").select(*(tokens[c] if c != "word" else F.col("word") for c in tokens.columns), F.coalesce("category", "own").alias("valid"))


def emotion_sets(emotions: DataFrame) -> DataFrame:
    """(category, words): the different (word, degree, polarity) of each category, in order."""
    return emotions.groupBy("category").agg(F.array_sort(F.collect_set(F.struct("word", "degree", "polarity"))).alias("words"))
