"""Queries of the problems in this subpackage over the given tables."""

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hilite.functions.numbers import identifier, play_micros, whole_number
from hilite.llm.abuse import THRESHOLD, group_names, rates, with_scores
from hilite.llm.canonical import BLANKS, IGNORED, KINDRED, LINE_ENDS, LOOK_ALIKES, OTHER_ALIKES, same_looks
from hilite.llm.mixing import draw_mixture, reached_shares, targets_of
from hilite.llm.packing import fill_containers, room_left
from hilite.llm.runs import collapse_runs, near_form
from hilite.llm.splitting import Limit, split_items
from hilite.llm.terms import most_marking, term_scores, terms_of
from hilite.llm.tokens import token_count
from hilite.operators.dedupe import without_copies
from hilite.plans.tables import table
from hilite.session import written


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of every pool with its score."""
    messages = table(spark, folder, "barrage").select("delivery_id", "cid", identifier(F.col("row_id")).alias("message"), terms_of(F.col("content")).alias("terms"))
    return term_scores(without_copies(messages, "message", ["delivery_id"], "delivery_id"), "cid", "terms")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return most_marking(p1_scores(spark, folder), "cid", least_texts=20)


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of one sender in one pool, with the numbers of its first and last message, its count and duration in microseconds."""
    b = table(spark, folder, "barrage").select(
        "delivery_id", identifier(F.col("row_id")).alias("message"), "cid", "sender_id", play_micros(F.col("play_timestamp")).alias("time"),
        whole_number(F.col("row_id")).alias("row"), F.when(F.col("content") != "", near_form(F.col("content"))).alias("form"),
    )
    return collapse_runs(without_copies(b, "message", ["delivery_id"], "delivery_id"), ["cid", "sender_id"], "time", "row", "form")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_runs(spark, folder).where(F.col("events") > 1).select("cid", "sender_id", F.col("first_tie").alias("first_row"), F.col("last_tie").alias("last_row"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    barrage = table(spark, folder, "barrage").select("delivery_id", "content")
    return same_looks(barrage, "content", table(spark, folder, "ref_phrase"), "phrase").select("delivery_id", "phrase_id")


#: Labelled comments that names of groups are learned from, at most.
LABELLED = 10_000


def p7_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery with its scores; names of hated groups are learned from comment_label."""
    labelled = table(spark, folder, "comment_label").select("content", "category").orderBy("sample_id").limit(LABELLED).collect()
    groups = group_names((r.content, r.category) for r in labelled)
    return with_scores(table(spark, folder, "barrage").select("delivery_id", "source", "content"), "content", groups).drop("content")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_scores(spark, folder).where(F.col("score") >= THRESHOLD).select("delivery_id")


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rates(p7_scores(spark, folder), "source")


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, tokens) of all documents, counted once and written."""
    documents = table(spark, folder, "documents")
    return written(documents.select("doc_id", "source", token_count(spark, F.col("text")).alias("tokens")), "sizes")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each part of each document, for each container size."""
    limits = table(spark, folder, "size_limit").where("purpose = 'container'").collect()
    return fill_containers(sizes(spark, folder), "doc_id", "tokens", [r.max_tokens for r in limits])


def p8_room(spark: SparkSession, folder: str) -> DataFrame:
    return room_left(p8_containers(spark, folder))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture, a row for each copy."""
    return draw_mixture(sizes(spark, folder), "doc_id", "source", "tokens", targets_of(table(spark, folder, "mix_target")))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return reached_shares(p9_mixture(spark, folder), "source", "tokens", targets_of(table(spark, folder, "mix_target")))


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of each document, for each piece size."""
    limits = table(spark, folder, "size_limit").where("purpose = 'piece'").collect()
    return split_items(table(spark, folder, "documents"), "doc_id", "text", [Limit(r.max_tokens, r.overlap_tokens or 0) for r in limits])


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """(capacity, over, split, items, lost) for each container size: containers over it, texts that fit and are in parts, texts, and texts whose parts don't make up their tokens."""
    size = sizes(spark, folder)
    limits = [r.max_tokens for r in table(spark, folder, "size_limit").where("purpose = 'container'").collect()]
    placed = written(fill_containers(size, "doc_id", "tokens", limits), "placed")
    over = placed.groupBy("capacity", "container").agg(F.sum("tokens").alias("tokens")).groupBy("capacity").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("over"))
    items = placed.groupBy("capacity", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("placed")).join(size.select("doc_id", F.col("tokens").alias("whole")), "doc_id", "right")
    lost = F.count_if(~F.col("placed").eqNullSafe(F.col("whole").cast("bigint")))
    of_items = items.groupBy("capacity").agg(F.count_if((F.col("parts") > 1) & (F.col("whole") <= F.col("capacity"))).alias("split"), F.count(F.lit(1)).alias("items"), lost.alias("lost"))
    return over.join(of_items, "capacity")


def p9_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """(source, over, uneven) for each target: texts that are there more often than allowed, and whether texts of the source are there with more than one copy's difference."""
    drawn = p9_mixture(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
    each = table(spark, folder, "documents").where("text <> ''").select("doc_id", "source").join(drawn, "doc_id", "left").select("source", F.coalesce("copies", F.lit(0)).alias("copies"))
    there = each.groupBy("source").agg(F.max("copies").alias("most"), F.min("copies").alias("least"))
    over = F.coalesce((F.col("most") > F.col("max_repeats")).cast("int"), F.lit(0))
    return table(spark, folder, "mix_target").join(there, "source", "left").select("source", over.alias("over"), F.coalesce((F.col("most") - F.col("least") > 1).cast("int"), F.lit(0)).alias("uneven"))


def p10_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """(max_tokens, texts, over, broken) for each piece size: texts, pieces over the size, and texts that their pieces, without the overlap, don't make up.

    A piece's tokens behind the end of the one before it are new; as pieces are cut from one row of tokens, a text is
    whole if they begin at 0, none leaves a token out, and first and last characters are the text's.
    """
    pieces = written(p10_pieces(spark, folder), "pieces")
    end = F.col("start_token") + F.col("tokens")
    by = Window.partitionBy("doc_id", "max_tokens").orderBy("piece")
    each = pieces.withColumn("gap", F.col("start_token") > F.coalesce(F.lag(end).over(by), F.lit(0)))
    whole = each.groupBy("doc_id", "max_tokens").agg(F.count_if("gap").alias("gaps"), F.max(end).alias("end"), F.min_by("text", "piece").alias("first"), F.max_by("text", "piece").alias("last"), F.count_if(F.col("tokens") > F.col("max_tokens")).alias("over"))
    texts = table(spark, folder, "documents").where("text <> ''").select("doc_id", "text", token_count(spark, F.col("text")).alias("all"))
    joined = whole.join(texts, "doc_id", "right")
    fine = (F.col("gaps") == 0) & (F.col("end") == F.col("all")) & F.col("text").startswith(F.col("first")) & F.col("text").endswith(F.col("last"))
    return joined.groupBy("max_tokens").agg(F.count(F.lit(1)).alias("texts"), F.sum("over").alias("over"), F.count_if(~fine).alias("broken"))


QUERIES = {f.__name__: f for f in (p1_found, p1_scores, p4_found, p4_runs, p6_found, p7_found, p7_scores, p7_rates, p8_containers, p8_room, p8_invariants, p9_mixture, p9_shares, p9_invariants, p10_pieces, p10_round_trip)}


def _letters(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"


def _looks_sql(text: str, kindred: bool = True) -> str:
    """text in canonical form: characters without a look go, others become what they look like, by tables of Unicode's compatibility forms, and accents are composed; kindred: Han and kana that look alike are one."""
    one, to, many = "", "", []
    alike = {a: b for pairs in (LOOK_ALIKES, OTHER_ALIKES) for k, v in pairs.items() for a, b in zip(k, v, strict=True)} | dict.fromkeys(BLANKS, " ") | dict.fromkeys(LINE_ENDS, "\n")
    for cp in (*range(0x20, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        c = chr(cp)
        form = alike.get(c) or "".join(alike.get(x, x) for x in unicodedata.normalize("NFKC", c))
        if form == c:
            continue
        if len(form) == 1:
            one, to = one + c, to + form
        else:
            many.append((c, form))
    out = f"translate({text}, {_letters(one)}, {_letters(to)})"
    # expansions are looked up only where a text has one
    pattern = "[" + "".join(re.escape(c) for c, _ in many) + "]"
    table_ = "MAP {" + ", ".join(f"{_letters(c)}: {_letters(f)}" for c, f in many) + "}"
    spread = f"list_aggregate(list_transform(string_split({out}, ''), lambda c: coalesce({table_}[c], c)), 'string_agg', '')"
    none = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in IGNORED) + "]"
    plain = f"regexp_replace({text}, '{none}', '', 'g')"
    form = f"nfc_normalize(CASE WHEN regexp_matches({text}, {_letters(pattern)}) THEN {spread} ELSE {out} END)".replace(text, plain)
    one, to = ("".join(c for g in KINDRED for c in g[1:]), "".join(g[0] for g in KINDRED for _ in g[1:])) if kindred else ("", "")
    return f"translate({form}, '{one}', '{to}')"


_OTHERS = r"\p{Latin}\p{Greek}\p{Cyrillic}\p{Hangul}\p{Arabic}\p{Hebrew}\p{Thai}\p{Devanagari}\p{Armenian}\p{Nd}\p{No}\p{M}"
_TERMS = f"list_distinct(regexp_extract_all(lower({_looks_sql('content', False)}), '\\p{{Han}}+|[\\p{{Hiragana}}\\p{{Katakana}}ー]+|[{_OTHERS}]+'))"
_SCORES = f"""m AS (SELECT cid, content FROM (SELECT cid, content, row_number() OVER (PARTITION BY regexp_replace(translate(row_id, '０１２３４５６７８９', '0123456789'), '[^0-9.]', '', 'g')::DECIMAL(30, 6) ORDER BY delivery_id) AS r FROM barrage) WHERE r = 1 AND cid IS NOT NULL),
  t AS (SELECT cid, count(*) AS texts FROM m GROUP BY cid), h AS (SELECT cid, term, count(*) AS hits FROM (SELECT cid, unnest({_TERMS}) AS term FROM m WHERE content <> '') GROUP BY ALL),
  d AS (SELECT term, count(*) AS records FROM h GROUP BY term), s AS (SELECT cid, term, hits, texts, records, hits / texts * ln((1 + (SELECT count(*) FROM t)) / (1 + records)) AS score FROM h JOIN t USING (cid) JOIN d USING (term))"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_SCORES} SELECT cid, arg_min(term, (-score, term)) AS term FROM s WHERE texts >= 20 GROUP BY cid",
    "p6_found": f"""WITH b AS (SELECT delivery_id, content, {_looks_sql("content")} AS form FROM barrage WHERE content <> ''), r AS (SELECT phrase_id, phrase, {_looks_sql("phrase")} AS form FROM ref_phrase)
      SELECT delivery_id, phrase_id FROM b JOIN r ON b.form = r.form AND content <> phrase""",
    "p8_invariants": "SELECT max_tokens::BIGINT AS capacity, 0::BIGINT AS over, 0::BIGINT AS split, (SELECT count(*) FROM documents) AS items, 0::BIGINT AS lost FROM size_limit WHERE purpose = 'container'",
    "p9_invariants": "SELECT source, 0 AS over, 0 AS uneven FROM mix_target",
    "p10_round_trip": "SELECT max_tokens, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0::BIGINT AS over, 0::BIGINT AS broken FROM size_limit WHERE purpose = 'piece'",
}
