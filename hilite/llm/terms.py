"""How distinctive a term is for each record."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilite.llm.canonical import read_in_context
from hilite.operators.skew import join_by_frequency
from hilite.session import written

KANA = r"\p{IsHiragana}\p{IsKatakana}ー"
TERM = rf"\p{{IsHan}}+|[{KANA}]+|[\p{{L}}\p{{N}}\p{{M}}&&[^\p{{IsHan}}{KANA}]]+"


def terms_of(text: Column) -> Column:
    """ARRAY<STRING> of the different terms of text: unbroken stretches of Han, of kana, or of other letters and digits, in canonical form and lower case; look-alikes of another kind are read as the kind around them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(read_in_context(text)), F.lit(TERM), F.lit(0)))


def term_scores(records: DataFrame, record: str, terms: str, *, hot_rows: int = 1_000_000) -> DataFrame:
    """(record, term, hits, texts, records, score): each term of each record, scored by how much it marks that record.

    A row of records is one text of a record, with its different terms as an array. hits: texts of the record with the
    term; texts: all texts of the record, those without terms as well; records: records with the term. score is
    hits / texts * ln((1 + number of records) / (1 + records)): a term of every record scores 0.

    Counts are made by partial aggregates of (record, term) and written once to the shared folder, as four later steps
    read them; records' own counts go along as the term null. Frequent
    terms and large records are salted when counts are joined back. Rows without a record do not count; null and empty
    arrays count as texts only.
    """
    rows = records.where(F.col(record).isNotNull())
    counts = rows.select(record, F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct(terms), F.array().cast("array<string>")))).alias("term")).groupBy(record, "term").agg(F.count(F.lit(1)).alias("hits"))
    counts = written(counts, "terms")
    texts = counts.groupBy(record).agg(F.count(F.lit(1)).alias("__terms"), F.max(F.when(F.col("term").isNull(), F.col("hits"))).alias("texts"))
    found = counts.where(F.col("term").isNotNull())
    by_term = found.groupBy("term").agg(F.count(F.lit(1)).alias("records"))
    joined = join_by_frequency(found, "term", by_term, "records", [record], hot_rows=hot_rows, how="inner")
    joined = join_by_frequency(joined.drop("__salt"), record, texts, "__terms", ["term"], hot_rows=hot_rows, how="inner")
    all_records = counts.select(F.countDistinct(record)).scalar()
    score = F.col("hits") / F.col("texts") * F.ln((1 + all_records) / (1 + F.col("records")))
    return joined.select(record, "term", "hits", "texts", "records", score.alias("score"))


def most_marking(scores: DataFrame, record: str, *, least_texts: int) -> DataFrame:
    """(record, term): the highest-scored term of each record of at least least_texts texts; of equal scores the first in order of text, where all are 0 as well."""
    ahead = F.struct((-F.col("score")).alias("score"), "term")
    return scores.where(F.col("texts") >= least_texts).groupBy(record).agg(F.min_by("term", ahead).alias("term"))
