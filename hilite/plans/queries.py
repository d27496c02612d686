"""Queries of the general problems over the given tables, with the same in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hilite.functions.numbers import clock_seconds, identifier
from hilite.operators.dedupe import merge_deliveries
from hilite.operators.intervals import periods_and_gaps
from hilite.operators.packed import explode_packed
from hilite.plans.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    video = explode_packed(table(spark, folder, "video"), {"tags": "video.tags", "metakeywords": "video.metakeywords"}, "aid")
    return video.unionByName(explode_packed(table(spark, folder, "xinfan"), {"tags": "xinfan.tags"}, "season_id"))


def p3_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The deliveries that a store holds once the last batch has come to all earlier ones: one of each message."""
    rows = table(spark, folder, "barrage").select("delivery_id", "batch_id", identifier(F.col("row_id")).alias("message"))
    # one row for the driver; as a number it reaches the scans of both sides
    first_of_last = rows.select(F.min(F.struct((-F.coalesce("batch_id", F.lit(-1))).alias("b"), F.col("delivery_id").alias("d"))).alias("x")).first().x
    new = F.col("delivery_id") >= F.lit(first_of_last.d if first_of_last else None).cast("bigint")
    rows = rows.drop("batch_id")
    return merge_deliveries(rows.where(~new | new.isNull()), rows.where(new), "message", ["delivery_id"]).select("delivery_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The deliveries that are not kept."""
    return table(spark, folder, "barrage").select("delivery_id").join(p3_kept(spark, folder), "delivery_id", "left_anti")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "label_interval").select("cid", clock_seconds(F.col("start_time")).alias("start"), clock_seconds(F.col("end_time")).alias("end"))
    return periods_and_gaps(labels, "cid", "start", "end").select("cid", "kind", "start_sec", "end_sec")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_kept, p5_found)}

_NUMBER = "regexp_replace(translate(row_id, '０１２３４５６７８９', '0123456789'), '[^0-9.]', '', 'g')::DECIMAL(30, 6)"


def _packed_sql(source: str, key: str, column: str) -> str:
    body = f"replace(regexp_replace(regexp_replace(trim(\"{column}\"), '^\\[', ''), '\\]$', ''), '\\t', chr(9))"
    values = f"""regexp_extract_all({body}, '"(?:[^"\\\\]|\\\\.|"")*"|“[^”]*”|[^\t\r\n|,，、;；/>"“]+')"""
    plain = """trim(CASE WHEN x[1] = '"' THEN replace(replace(x[2:-2], '\\"', '"'), '""', '"') WHEN x[1] = '“' THEN x[2:-2] ELSE x END)"""
    return f"""SELECT '{source}.{column}' AS field, {key} AS rec_key, list_filter(list_transform({values}, lambda x: {plain}), lambda x: x <> '') AS vals
      FROM (SELECT DISTINCT * FROM {source}) WHERE "{column}" IS NOT NULL"""


def _clock_sql(column: str) -> str:
    t = f"regexp_replace(replace(replace(replace({column}, '：', ':'), '分', 'm'), '秒', 's'), '[^0-9:ms]', '', 'g')"
    part = lambda k: f"split_part({t}, ':', {k})::INT"
    return f"""CASE WHEN regexp_full_match({t}, '\\d+:\\d+') THEN {part(1)} * 60 + {part(2)}
      WHEN regexp_full_match({t}, '\\d+:\\d+:\\d+') THEN {part(1)} * 3600 + {part(2)} * 60 + {part(3)}
      WHEN regexp_full_match({t}, '\\d+m\\d+s') THEN regexp_extract({t}, '(\\d+)m', 1)::INT * 60 + regexp_extract({t}, '(\\d+)s', 1)::INT
      WHEN regexp_full_match({t}, '\\d+s?') THEN regexp_extract({t}, '\\d+')::INT END"""


SQL: dict[str, str] = {
    "p2_found": f"""SELECT field, rec_key, pos::INT AS pos, val FROM (SELECT field, rec_key, unnest(vals) AS val, generate_subscripts(vals, 1) AS pos FROM (
      {_packed_sql("video", "aid", "tags")} UNION ALL {_packed_sql("video", "aid", "metakeywords")} UNION ALL {_packed_sql("xinfan", "season_id", "tags")}))""",
    "p3_found": f"""SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY {_NUMBER} ORDER BY delivery_id) AS r FROM barrage) WHERE r > 1""",
    "p3_kept": f"""SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY {_NUMBER} ORDER BY delivery_id) AS r FROM barrage) WHERE r = 1""",
    "p5_found": f"""WITH t AS (SELECT cid, {_clock_sql("start_time")} AS s, {_clock_sql("end_time")} AS e FROM label_interval),
      new AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY cid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM t WHERE e > s),
      numbered AS (SELECT *, sum(n) OVER (PARTITION BY cid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM new),
      periods AS (SELECT cid, i, min(s) AS s, max(e) AS e FROM numbered GROUP BY cid, i)
      SELECT cid, 'period' AS kind, s AS start_sec, e AS end_sec FROM periods
      UNION ALL SELECT * FROM (SELECT cid, 'gap', e, lead(s) OVER (PARTITION BY cid ORDER BY s) AS f FROM periods) WHERE f IS NOT NULL""",
}
