"""Readers of comment files, labels, dictionaries and cached segments, with explicit schemas."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hilite.functions.timefmt import cid_of_path

FIELDS = ("play_timestamp", "type", "font_size", "font_color", "unix_timestamp", "pool", "sender_id", "row_id", "content")
SEGMENTS = "array<struct<play_timestamp: double, row_id: string, sender_id: string, index: int, sentence_seg_list: array<struct<word: string, flag: string, start_position: int, end_position: int>>>>"


def outer_blanks_off(line: Column) -> Column:
    """A line without any white space around it, tabs as well: an empty last field goes with its tab."""
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def comment_fields(lines: DataFrame, line: str) -> DataFrame:
    """The nine fields of tab-separated comment lines, all text; lines with fewer are dropped, more than nine are cut off."""
    parts = F.split(outer_blanks_off(F.col(line)), "\t", -1)
    return lines.withColumn("__parts", parts).where(F.size("__parts") >= len(FIELDS)).select(*(c for c in lines.columns if c != line), *(F.get("__parts", F.lit(i)).alias(f) for i, f in enumerate(FIELDS)))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """(cid, position, fields): comment files, the video being the file's name; position rises along a file."""
    lines = spark.read.text(path).select(cid_of_path(F.input_file_name()).alias("cid"), F.monotonically_increasing_id().alias("position"), "value")
    return comment_fields(lines, "value")


# Fixed value: a comment of an XML document, its eight attributes and its text.
XML_COMMENT = r'(?s)<d p="([^,"]*),([^,"]*),([^,"]*),([^,"]*),([^,"]*),([^,"]*),([^,"]*),([^,"]*)">(.*?)</d>'


def xml_comments(documents: DataFrame, id_: str, xml: str) -> DataFrame:
    """(id, position, fields) of the comments of XML documents; a comment may span lines, entities stay as they are. A document without any gives no row."""
    fields = [F.regexp_extract_all(xml, F.lit(XML_COMMENT), F.lit(i + 1)) for i in range(len(FIELDS))]
    return documents.select(id_, F.posexplode(F.arrays_zip(*(f.alias(n) for f, n in zip(fields, FIELDS, strict=True)))).alias("position", "c")).select(id_, "position", *(F.col("c").getField(n).alias(n) for n in FIELDS))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(cid_of_path(F.input_file_name()).alias("cid"), "value")
    return xml_comments(files, "cid", "value")


def dated_log(lines: DataFrame, line: str, date: Column) -> DataFrame:
    """(time, offset, sender_name, content) of the live log of a date: the seconds since its noon; lines of fewer than three fields, without a time or before noon are dropped."""
    parts = F.split(outer_blanks_off(F.col(line)), "\t", -1)
    noon = F.to_timestamp_ntz(F.concat(date.cast("string"), F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    time = F.try_to_timestamp(F.get(parts, F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    rows = lines.where(F.size(parts) >= 3).select(time.alias("time"), noon.alias("noon"), F.get(parts, F.lit(1)).alias("sender_name"), F.get(parts, F.lit(2)).alias("content"))
    return rows.where(F.col("time") >= F.col("noon")).select("time", F.timestamp_diff("MICROSECOND", F.col("noon"), F.col("time")).cast("double").alias("micros"), "sender_name", "content").select("time", (F.col("micros") / 1e6).alias("offset"), "sender_name", "content")


def read_dated_logs(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("date", cid_of_path(F.input_file_name()))
    return dated_log(lines, "value", F.col("date"))


def label_intervals(lines: DataFrame, line: str) -> DataFrame:
    """(start, end, label) in seconds of tab-separated lines of MM:SS pairs, minutes beyond 59 as well; lines of fewer than three fields or without numbers are dropped."""
    parts = F.split(outer_blanks_off(F.col(line)), "\t", -1)
    def seconds(i: int) -> Column:
        t = F.split(F.get(parts, F.lit(i)), ":")
        return F.get(t, F.lit(0)).try_cast("int") * 60 + F.get(t, F.lit(1)).try_cast("int")
    return lines.where(F.size(parts) >= 3).select(*(c for c in lines.columns if c != line), seconds(0).alias("start"), seconds(1).alias("end"), F.get(parts, F.lit(2)).alias("label")).where(F.col("start").isNotNull() & F.col("end").isNotNull())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/_.]*)[^/]*$", 1).alias("cid"), "value")
    return label_intervals(lines, "value").orderBy("cid", "start")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), outer_blanks_off(F.col("value")).alias("value")).where(F.col("value") != "")


def read_words(spark: SparkSession, *paths: str, always: tuple[str, ...] = ()) -> DataFrame:
    """(word): the different words of word lists, one a line, and those that always belong to them."""
    words = _numbered(spark, [*paths]).select(F.split("value", "\t")[0].alias("word"))
    return (words.unionByName(spark.createDataFrame([(w,) for w in always], "word string")) if always else words).distinct()


def read_table(spark: SparkSession, path: str, columns: list[str], *, separator: str = "\t", keep: str | None = None) -> DataFrame:
    """A dictionary of columns with its line numbers; shorter lines are dropped. keep: first or last line of each first column."""
    parts = F.split("value", separator, -1)
    rows = _numbered(spark, path).where(F.size(parts) >= len(columns)).select("line", *(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))
    if not keep:
        return rows
    order = F.col("line").asc() if keep == "first" else F.col("line").desc()
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(columns[0]).orderBy(order))).where(F.col("__r") == 1).drop("__r")


def read_rules(spark: SparkSession, path: str) -> list:
    """The rewrite rules of a file in order: pattern, word and flag."""
    from hilite.operators.tokens import Rule

    return [Rule(r.pattern, r.word, r.flag) for r in read_table(spark, path, ["pattern", "word", "flag"]).orderBy("line").collect()]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Cached segments of comments, a JSON array a file."""
    files = spark.read.text(path, wholetext=True).select(cid_of_path(F.input_file_name()).alias("cid"), F.from_json("value", SEGMENTS).alias("s"))
    return files.select("cid", F.inline("s"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files below a path whose names fit a pattern; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
