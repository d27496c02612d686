"""Queries of the engine's own operators over the given tables, each with the same in SQL.

The rows of events are the comments of one video (e), those of barrage the comments of many (b).
"""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hilite.functions.numbers import clock_seconds, play_micros
from hilite.functions.timefmt import cid_of_path, clock_text, play_time_text
from hilite.operators import classify, clips, cluster, comments, features, rating, tokens, windows
from hilite.operators.order import positions
from hilite.plans import pipeline
from hilite.plans.tables import table
from hilite.session import own_folder, written
from hilite.sources import live, readers, sinks, web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR, TEN = 3_600_000_000, 10_000_000
TOPICS = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """(cid, row_id, sender_id, topic, us, k): events as the comments of one video, us from the first."""
    e = table(spark, folder, "events")
    first = e.select(F.min(micros(F.col("ts")))).scalar()
    return e.select(F.lit("events").alias("cid"), F.col("event_id").alias("row_id"), F.col("user_id").alias("sender_id"), F.col("event_type").alias("topic"), (micros(F.col("ts")) - first).alias("us"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


E = "e AS (SELECT 'events' AS cid, event_id AS row_id, user_id AS sender_id, event_type AS topic, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS us, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def pools(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "barrage").withColumn("us", play_micros(F.col("play_timestamp")))


B = "b AS (SELECT *, round(translate(trim(play_timestamp), '０１２３４５６７８９', '0123456789')::DECIMAL(30, 14) * 1000000)::BIGINT AS us FROM barrage)"


# windows ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {E}, s AS (SELECT unnest(range(0, max(us) // {HOUR} + 1)) AS window_index FROM e),
  c AS (SELECT us // {HOUR} AS window_index, count(*) AS comments, sum(k)::BIGINT AS words FROM e GROUP BY 1)
  SELECT 'events' AS cid, window_index, window_index * {HOUR} AS "start", (window_index + 1) * {HOUR} AS "end", coalesce(comments, 0) AS comments, coalesce(words, 0) AS words FROM s LEFT JOIN c USING (window_index)""")
def window_tumbling_dense(spark, folder):
    return windows.tumbling(events(spark, folder), "cid", "us", HOUR, "k")


@query(f"""WITH {B}, m AS (SELECT cid, max(us) // {TEN} AS last FROM b WHERE us >= 0 GROUP BY cid), s AS (SELECT cid, unnest(range(0, last + 1)) AS window_index FROM m),
  c AS (SELECT cid, us // {TEN} AS window_index, count(*) AS comments FROM b WHERE us >= 0 GROUP BY ALL)
  SELECT cid, window_index, window_index * {TEN} AS "start", (window_index + 1) * {TEN} AS "end", coalesce(comments, 0) AS comments, 0::BIGINT AS words FROM s LEFT JOIN c USING (cid, window_index)""")
def window_tumbling_pools(spark, folder):
    return windows.tumbling(pools(spark, folder), "cid", "us", TEN)


@query(f"""WITH {E}, x AS (SELECT unnest(range(CASE WHEN us < {2 * HOUR} THEN 0 ELSE (us - {2 * HOUR}) // {HOUR} + 1 END, us // {HOUR} + 1)) AS window_index FROM e)
  SELECT 'events' AS cid, window_index, window_index * {HOUR} AS "start", window_index * {HOUR} + {2 * HOUR} AS "end", count(*) AS comments FROM x GROUP BY window_index""")
def window_sliding(spark, folder):
    return windows.sliding(events(spark, folder), "cid", "us", 2 * HOUR, HOUR)


LABELLED = "i AS (SELECT unnest([0, 50, 100]) * {h} AS f, unnest([20, 55, 130]) * {h} AS l, unnest(['a', 'b', 'a']) AS label)".format(h=HOUR)


def intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("events", a * HOUR, b * HOUR, x) for a, b, x in ((0, 20, "a"), (50, 55, "b"), (100, 130, "a"))], "cid string, start bigint, end bigint, label string")


@query(f"""WITH {E}, {LABELLED}, w AS (SELECT unnest(range(f, l, {HOUR})) AS s, label FROM i)
  SELECT 'events' AS cid, s AS "start", s + {HOUR} AS "end", label, s // {HOUR} AS window_index, (SELECT count(*) FROM e WHERE us BETWEEN s AND s + {HOUR}) AS comments FROM w""")
def window_training_closed(spark, folder):
    return windows.labelled(intervals(spark), events(spark, folder), "cid", "us", HOUR)


@query(f"""WITH {E}, s AS (SELECT unnest(range(0, max(us) // {HOUR} + 1)) AS window_index, max(us) // {HOUR} + 1 AS n FROM e)
  SELECT window_index FROM s WHERE n <= 180 OR window_index BETWEEN 6 AND n - 7""")
def window_edge_trim(spark, folder):
    return windows.trim_edges(windows.tumbling(events(spark, folder), "cid", "us", HOUR), "cid").select("window_index")


# vectors and ratings ------------------------------------------------------------------------------------------------


def topic_counts(spark: SparkSession, folder: str, width: int = HOUR) -> DataFrame:
    return events(spark, folder).groupBy("cid", F.expr(f"us div {width}").alias("window_index"), "topic").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E} SELECT cid, us // {HOUR} AS window_index, {", ".join(f"count(*) FILTER (topic = '{t}') AS {t}" for t in TOPICS)} FROM e GROUP BY cid, us // {HOUR}""")
def topic_vector(spark, folder):
    return features.topic_vector(topic_counts(spark, folder), ["cid", "window_index"], "topic", "n", TOPICS)


def event_words(spark: SparkSession, folder: str, width: int = HOUR) -> DataFrame:
    e = events(spark, folder)
    return e.select("cid", F.expr(f"us div {width}").alias("window_index"), F.explode(F.array("topic", F.concat(F.lit("k"), F.coalesce(F.col("k").cast("string"), F.lit(""))))).alias("word"))


WORDS_SQL = f"w AS (SELECT cid, us // {HOUR} AS window_index, unnest([topic, 'k' || coalesce(k::VARCHAR, '')]) AS word FROM e)"


@query(f"""WITH {E}, {WORDS_SQL} SELECT cid, window_index, word, count(*) AS n FROM w GROUP BY ALL""")
def wordbase_vector(spark, folder):
    return features.word_counts(event_words(spark, folder), ["cid", "window_index"], "word")


def _rating_sql(k: str, width: int = HOUR) -> str:
    return f"""r AS (SELECT cid, window_index, ((sum(n * n) / {k} - (sum(n) / {k}) ** 2) / (1 + ln(sum(n)) - sum(n * ln(n)) / sum(n))) AS rating
      FROM (SELECT cid, us // {width} AS window_index, topic, count(*)::DOUBLE AS n FROM e GROUP BY ALL) GROUP BY cid, window_index)"""


@query(f"""WITH {E}, {_rating_sql("5")} SELECT cid, window_index, round(rating, 6) AS rating FROM r""")
def window_rating(spark, folder):
    rated = rating.rate_windows(topic_counts(spark, folder), ["cid", "window_index"], "n", F.lit(5))
    return rated.withColumn("rating", F.round("rating", 6))


@query(f"""WITH {E}, {WORDS_SQL}, c AS (SELECT cid, window_index, word, count(*)::DOUBLE AS n FROM w GROUP BY ALL), d AS (SELECT count(DISTINCT word)::DOUBLE AS k FROM w)
  SELECT cid, window_index, round((sum(n * n) / any_value(k) - (sum(n) / any_value(k)) ** 2) / (1 + ln(sum(n)) - sum(n * ln(n)) / sum(n)), 6) AS rating FROM c, d GROUP BY cid, window_index""")
def wordbase_rating(spark, folder):
    words = event_words(spark, folder)
    counts = features.word_counts(words, ["cid", "window_index"], "word").withColumn("k", words.select(F.countDistinct("word")).scalar())
    return rating.rate_windows(counts, ["cid", "window_index"], "n", F.col("k")).withColumn("rating", F.round("rating", 6))


@query(f"""WITH {E}, {_rating_sql("5")} SELECT cid, round(min(rating), 6) AS low, round(max(rating), 6) AS high FROM r GROUP BY cid""")
def rating_bounds(spark, folder):
    rated = rating.rate_windows(topic_counts(spark, folder), ["cid", "window_index"], "n", F.lit(5))
    return rating.rating_bounds(rated, "cid").select("cid", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _rated(spark: SparkSession, folder: str, width: int) -> DataFrame:
    return rating.rate_windows(topic_counts(spark, folder, width), ["cid", "window_index"], "n", F.lit(5))


@query(f"""WITH {E}, {_rating_sql("5")} SELECT cid, window_index FROM r, (SELECT min(rating) AS lo, max(rating) AS hi FROM r) WHERE rating > 0.3 * lo + 0.7 * hi""")
def highlight_filter(spark, folder):
    return rating.highlights(_rated(spark, folder, HOUR), "cid").select("cid", "window_index")


SIX = 6 * HOUR
CLIPS = f"""{_rating_sql("5", SIX)}, h AS (SELECT window_index AS i FROM r, (SELECT min(rating) AS lo, max(rating) AS hi FROM r) WHERE rating > 0.7 * lo + 0.3 * hi),
  clips AS (SELECT min(i) * {SIX} AS s, (max(i) + 1) * {SIX} AS f FROM (SELECT i, i - row_number() OVER (ORDER BY i) AS g FROM h) GROUP BY g)"""


def six_hour_clips(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    return pipeline.highlight_clips(e, e, "cid", "us", "topic", F.lit(5), pipeline.Settings(SIX, 0.7, 0.3, False))


@query(f"""WITH {E}, {CLIPS} SELECT 'events' AS cid, s AS "start", f AS "end", 'highlight' AS label FROM clips""")
def merge_clips(spark, folder):
    return six_hour_clips(spark, folder)


@query(f"""WITH {E}, {_rating_sql("5")}, g AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) / 10 AS x), m AS (SELECT min(rating) AS lo, max(rating) AS hi FROM r)
  SELECT 'events' AS cid, a.x AS "left", c.x AS "right", count(*) FILTER (rating > a.x * lo + c.x * hi) AS kept FROM r, m, g AS a, g AS c GROUP BY ALL""")
def threshold_grid(spark, folder):
    steps = [i / 10 for i in range(1, 10)]
    return clips.threshold_grid(_rated(spark, folder, HOUR), "cid", steps, steps)


# clips and measures -------------------------------------------------------------------------------------------------


def topic_clips(spark: SparkSession, folder: str, topic: str) -> DataFrame:
    """Clips of consecutive hours in which a topic is the first of the most frequent ones, labelled by whether it has over two comments."""
    w = topic_counts(spark, folder).where(F.col("topic") == topic).select("cid", "window_index", F.when(F.col("n") > 2, "many").otherwise("few").alias("label"), (F.col("window_index") * HOUR).alias("start"), ((F.col("window_index") + 1) * HOUR).alias("end"))
    return clips.merge_clips(w, "cid", "window_index", "start", "end", "label")


def _clips_sql(name: str, topic: str) -> str:
    return f"""{name}w AS (SELECT us // {HOUR} AS i, CASE WHEN count(*) > 2 THEN 'many' ELSE 'few' END AS label FROM e WHERE topic = '{topic}' GROUP BY 1),
      {name} AS (SELECT min(i) * {HOUR} AS s, (max(i) + 1) * {HOUR} AS f, label FROM (SELECT *, i - row_number() OVER (PARTITION BY label ORDER BY i) AS g FROM {name}w) GROUP BY label, g)"""


BOTH = f"{_clips_sql('p', 'view')}, {_clips_sql('q', 'click')}, m AS (SELECT greatest(p.s, q.s) AS s, least(p.f, q.f) AS f, p.label AS label, q.label AS base_label FROM p, q WHERE p.s <= q.f AND p.f >= q.s)"


@query(f"""WITH {E}, {_clips_sql("p", "view")} SELECT 'events' AS cid, s AS "start", f AS "end", label FROM p""")
def merge_labelled_clips(spark, folder):
    return topic_clips(spark, folder, "view")


@query(f"""WITH {E}, {BOTH} SELECT 'events' AS cid, s AS "start", f AS "end", label, base_label FROM m""")
def clip_overlap_join(spark, folder):
    return clips.overlaps(topic_clips(spark, folder, "view"), topic_clips(spark, folder, "click"), "cid", bin_width=HOUR * 24)


def _measures(spark: SparkSession, folder: str) -> DataFrame:
    a, b = topic_clips(spark, folder, "view"), topic_clips(spark, folder, "click")
    return clips.precision_recall(clips.overlaps(a, b, "cid", bin_width=HOUR * 24), a, b, "cid")


_TIME = "t AS (SELECT coalesce(sum(f - s) FILTER (label = base_label), 0)::DOUBLE AS x, count(DISTINCT (s, f, label)) FILTER (label = base_label)::DOUBLE AS n FROM m), pp AS (SELECT sum(f - s)::DOUBLE AS x, count(*)::DOUBLE AS n FROM p), qq AS (SELECT sum(f - s)::DOUBLE AS x, count(*)::DOUBLE AS n FROM q)"


def _measure_sql(kind: str, c: str) -> str:
    return f"""WITH {E}, {BOTH}, {_TIME}, pr AS (SELECT t.{c} / pp.{c} AS a, t.{c} / qq.{c} AS b FROM t, pp, qq)
      SELECT round(a, 6) AS {kind}_p, round(b, 6) AS {kind}_r, round(coalesce(2 * a * b / nullif(a + b, 0), 0), 6) AS {kind}_f1 FROM pr"""


@query(_measure_sql("time", "x"))
def clip_prf_time(spark, folder):
    return _measures(spark, folder).select(*(F.round(f"time_{x}", 6).alias(f"time_{x}") for x in ("p", "r", "f1")))


@query(_measure_sql("label", "n"))
def clip_prf_label(spark, folder):
    return _measures(spark, folder).select(*(F.round(f"label_{x}", 6).alias(f"label_{x}") for x in ("p", "r", "f1")))


GRID = [i / 10 for i in range(1, 10)]


@query(f"""WITH {E}, {_rating_sql("5", SIX)}, {LABELLED}, g AS (SELECT unnest(range(1, 10)) / 10 AS x), m AS (SELECT min(rating) AS lo, max(rating) AS hi FROM r),
  h AS (SELECT a.x AS x, c.x AS y, window_index AS i FROM r, m, g AS a, g AS c WHERE rating > a.x * lo + c.x * hi), k AS (SELECT x, y, min(i) * {SIX} AS s, (max(i) + 1) * {SIX} AS f FROM (SELECT *, i - row_number() OVER (PARTITION BY x, y ORDER BY i) AS d FROM h) GROUP BY x, y, d),
  p AS (SELECT x, y, sum(f - s)::DOUBLE AS p FROM k GROUP BY x, y), t AS (SELECT x, y, sum(least(k.f, i.l) - greatest(k.s, i.f))::DOUBLE AS t FROM k JOIN i ON k.s <= i.l AND k.f >= i.f AND i.label = 'a' GROUP BY x, y), b AS (SELECT sum(l - f)::DOUBLE AS b FROM i)
  SELECT a.x AS "left", c.x AS "right", round(coalesce(t / p, 0), 6) AS time_p, round(coalesce(t / b, 0), 6) AS time_r FROM g AS a, g AS c LEFT JOIN p ON p.x = a.x AND p.y = c.x LEFT JOIN t ON t.x = a.x AND t.y = c.x, b""")
def grid_search(spark, folder):
    e = events(spark, folder)
    w = pipeline.rated_windows(e, e, "cid", "us", "topic", F.lit(5), pipeline.Settings(SIX, trim=False)).withColumn("label", F.lit("a"))
    got = pipeline.grid_search(w, intervals(spark), "cid", "label", GRID, GRID, bin_width=SIX)
    return got.select("left", "right", F.round("time_p", 6).alias("time_p"), F.round("time_r", 6).alias("time_r"))


# tokens -------------------------------------------------------------------------------------------------------------


def comment_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.tokenize(table(spark, folder, "barrage"), "delivery_id", "content")


KIND = r"[\p{Han}\p{Hiragana}\p{Katakana}ー]"
TOK = rf"""tok AS (SELECT id, pos::INT AS pos, word, CASE WHEN regexp_matches(word, '^[A-Za-z]') THEN 'eng' WHEN regexp_matches(word, '^[0-9]') THEN 'm' WHEN regexp_matches(word, '^{KIND}') THEN 'n' WHEN regexp_matches(word, '^\s') THEN 'w' ELSE 'x' END AS flag
  FROM (SELECT delivery_id AS id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT delivery_id, regexp_extract_all(content, '(?s)[A-Za-z]+|[0-9]+|{KIND}+|\s+|.') AS w FROM barrage WHERE content <> '')))"""


@query(f"""WITH {TOK} SELECT id, pos, word, flag, (sum(length(word)) OVER (PARTITION BY id ORDER BY pos) - length(word))::BIGINT AS start_position, (sum(length(word)) OVER (PARTITION BY id ORDER BY pos) - 1)::BIGINT AS end_position FROM tok""")
def tokenize_offsets(spark, folder):
    return tokens.token_rows(table(spark, folder, "barrage"), "delivery_id", tokens.with_offsets(tokens.token_array(F.col("content"))))


RUNS = """g AS (SELECT id, min(pos) AS pos, string_agg(word, '' ORDER BY pos) AS word, CASE WHEN flag = 'x' AND count(*) > 1 THEN 'emoji' ELSE flag END AS flag
  FROM (SELECT *, CASE WHEN flag = 'x' THEN pos - row_number() OVER (PARTITION BY id, flag ORDER BY pos) ELSE pos + 1000000 END AS k FROM tok) GROUP BY id, flag, k)"""


def run_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_rows(table(spark, folder, "barrage"), "delivery_id", tokens.with_emoji_runs(tokens.token_array(F.col("content"))))


@query(f"WITH {TOK}, {RUNS} SELECT * FROM g")
def emoji_runs(spark, folder):
    return run_tokens(spark, folder)


@query(f"WITH {TOK} SELECT id, pos, CASE WHEN flag = 'eng' THEN lower(word) ELSE word END AS word, flag FROM tok")
def lower_by_flag(spark, folder):
    return tokens.lower_english(comment_tokens(spark, folder))


STOP = ["the", "a", "is", "and", "it", "at", "of", "so", " ", "\t", "\n"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@query(f"WITH {TOK} SELECT id, pos, word, flag FROM (SELECT id, pos, CASE WHEN flag = 'eng' THEN lower(word) ELSE word END AS word, flag FROM tok) WHERE word NOT IN ({STOP_SQL})")
def stopword_filter(spark, folder):
    return tokens.without_words(tokens.lower_english(comment_tokens(spark, folder)), spark.createDataFrame([(w,) for w in STOP], "word string"))


RULES = [("66", "awesome", "zan"), ("666", "never", "zan"), ("23+", "laugh", "n"), ("[hH]a", "laugh", "n"), ("omg+", "surprise", "n"), ("o", "oh", "y"), ("哈{2,}", "laugh", "n"), ("[!！]", "!", "w"), ("8{2,}", "clap", "v"), ("\\.", "", "m")]


def rewritten(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.rewrite(tokens.lower_english(comment_tokens(spark, folder)), [tokens.Rule(*r) for r in RULES])


def _case(i: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lw, '^(?:{r[0]})') THEN '{r[i]}'" for r in RULES) + f" ELSE {'lw' if i == 1 else 'flag'} END"


REWRITTEN = f"rw AS (SELECT id, pos, {_case(1)} AS word, {_case(2)} AS flag FROM (SELECT *, CASE WHEN flag = 'eng' THEN lower(word) ELSE word END AS lw FROM tok))"


@query(f"WITH {TOK}, {REWRITTEN} SELECT * FROM rw")
def ordered_rewrite(spark, folder):
    return rewritten(spark, folder)


REJECT = list("，。、：；？…~～\"'()（）【】「」『』,:;?-·*")
REJECT_SQL = ", ".join("'" + c.replace("'", "''") + "'" for c in REJECT)
CLEAN = f"cl AS (SELECT * FROM rw WHERE flag NOT IN ('w', 'm') AND word NOT IN ({REJECT_SQL}))"


def clean_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.without_numbers(rewritten(spark, folder), spark.createDataFrame([(c,) for c in REJECT], "word string"))


@query(f"WITH {TOK}, {REWRITTEN}, {CLEAN} SELECT * FROM cl")
def punct_num_filter(spark, folder):
    return clean_tokens(spark, folder)


@query(f"""WITH {TOK}, {REWRITTEN}, {CLEAN}, {B} SELECT cid, delivery_id, (row_number() OVER (PARTITION BY cid ORDER BY us NULLS FIRST, delivery_id) - 1)::BIGINT AS "index" FROM b WHERE delivery_id IN (SELECT id FROM cl)""")
def survivor_index(spark, folder):
    kept = tokens.has_kept(F.col("content"), [tokens.Rule(*r) for r in RULES], REJECT)
    b = pools(spark, folder).where(kept).select("delivery_id", "cid", "us")
    return tokens.survivors(b, F.lit(True), "cid", ["us", "delivery_id"]).select("cid", "delivery_id", "index")


EMOTIONS = [("joy", "laugh", 2.0, 1), ("joy", "awesome", 3.0, 1), ("surprise", "surprise", 2.0, 0), ("joy", "cry", 1.0, 1), ("sad", "cry", 2.0, -1), ("joy", "laugh", 2.0, 1)]
EMO = "emo AS (SELECT unnest(['joy','joy','surprise','joy','sad','joy']) AS category, unnest(['laugh','awesome','surprise','cry','cry','laugh']) AS word, unnest([2.0,3.0,2.0,1.0,2.0,2.0])::DOUBLE AS degree, unnest([1,1,0,1,-1,1])::INT AS polarity)"


def emotions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMOTIONS, "category string, word string, degree double, polarity int")


@query(f"""WITH {TOK}, {REWRITTEN}, {EMO}, o AS (SELECT word, min(category) AS category FROM emo GROUP BY word)
  SELECT id, pos, rw.word, flag, coalesce(category, CASE WHEN rw.word IN ('not', 'never', 'so', '太') THEN rw.word END) AS valid FROM rw LEFT JOIN o USING (word)""")
def valid_word_map(spark, folder):
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    return tokens.valid_words(rewritten(spark, folder), emotions(spark), words("not", "never"), words("so", "太"))


@query(f"WITH {EMO} SELECT category, count(DISTINCT (word, degree, polarity)) AS words, string_agg(DISTINCT word, ',' ORDER BY word) AS list FROM emo GROUP BY category")
def emotion_sets(spark, folder):
    sets = tokens.emotion_sets(emotions(spark))
    return sets.select("category", F.size("words").cast("bigint").alias("words"), F.array_join(F.array_distinct(F.transform("words", lambda w: w.word)), ",").alias("list"))


@query(f"WITH {TOK} SELECT flag, count(*) AS n FROM tok WHERE flag LIKE 'n%' OR flag LIKE 'en%' GROUP BY flag")
def accept_pos(spark, folder):
    return comment_tokens(spark, folder).where(tokens.accepted(F.col("flag"), ["n", "en"])).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOK} SELECT id, string_agg(word, '|' ORDER BY pos) AS words FROM tok GROUP BY id")
def word_lists(spark, folder):
    segments = comment_tokens(spark, folder).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "flag"))).alias("s"))
    return segments.select("id", F.array_join(tokens.word_list(F.col("s")), "|").alias("words"))


EMOJIS = {"😂": "laugh", "❤": "love", "❤️": "love", "orz": "bow", "!": "shout"}


_KEYS = sorted(EMOJIS, key=lambda k: (-len(k), k))
_ANY, _BACK = "|".join(_KEYS), "|".join(k[::-1] for k in _KEYS)
_OF = lambda k: "CASE " + k + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EMOJIS.items()) + " END"


@query(f"""WITH {TOK}, {RUNS}, s AS (SELECT id, pos, CASE WHEN {_OF("word")} IS NOT NULL THEN [{{'w': {_OF("word")}, 'f': CASE WHEN length(word) > 1 THEN flag ELSE 'emoji' END}}]
  WHEN regexp_matches(word, '^(?:{_ANY})') THEN list_transform(regexp_extract_all(regexp_extract(word, '^(?:{_ANY})+'), '{_ANY}'), lambda k: {{'w': {_OF("k")}, 'f': 'emoji'}})
  WHEN regexp_matches(word, '(?:{_ANY})$') THEN list_transform(list_reverse(regexp_extract_all(regexp_extract(reverse(word), '^(?:{_BACK})+'), '{_BACK}')), lambda k: {{'w': {_OF("reverse(k)")}, 'f': 'emoji'}})
  WHEN flag = 'emoji' THEN [] ELSE [{{'w': word, 'f': flag}}] END AS x FROM g)
  SELECT id, pos, u.w AS word, u.f AS flag, sub FROM (SELECT id, pos, unnest(x) AS u, (generate_subscripts(x, 1) - 1)::INT AS sub FROM s)""")
def emoji_substitute(spark, folder):
    return tokens.substitute_emojis(run_tokens(spark, folder), EMOJIS)


DICTIONARY = [(w, 10.0, "n") for w in "名场面 头皮 发麻 弹幕 护体 空降 成功 片头曲 长镜头 旧书店 学生会长 怀表 烟火 高能 预警 从头 惊艳 浪漫 温柔 粗糙 最后 十分钟".split()] + [(w, 50.0, "d") for w in "简直 居然 果然 终于 有点 特别 太".split()]


@query()
def segment_dictionary(spark, folder):
    segment = tokens.segmenter(DICTIONARY)
    return tokens.exploded(table(spark, folder, "barrage").where("content <> ''").select("delivery_id", segment(F.col("content")).alias("s")), "delivery_id", "s")


# time as text -------------------------------------------------------------------------------------------------------


@query(f"""WITH {E} SELECT row_id, (us // 60000000)::VARCHAR || ' minutes ' || ((us // 1000000) % 60)::VARCHAR || ' seconds' AS play FROM e""")
def format_play_time(spark, folder):
    return events(spark, folder).select("row_id", play_time_text(F.col("us") / 1e6).alias("play"))


@query(f"""WITH {E}, s AS (SELECT row_id, (us // 1000000)::BIGINT AS s FROM e) SELECT row_id, (s // 60)::VARCHAR || ':' || (s % 60)::VARCHAR AS clock, s AS seconds FROM s""")
def mmss_roundtrip(spark, folder):
    s = events(spark, folder).select("row_id", clock_text(F.expr("us div 1000000")).alias("clock"))
    line = F.concat("clock", F.lit("\t"), "clock", F.lit("\tx")).alias("line")
    return readers.label_intervals(s.select("row_id", "clock", line), "line").select("row_id", "clock", F.col("start").cast("bigint").alias("seconds"))


@query("SELECT aid, 'x' || aid AS cid FROM video")
def cid_from_path(spark, folder):
    return table(spark, folder, "video").select("aid", cid_of_path(F.concat(F.lit("/data/local/x"), "aid", F.lit(".tsv.gz"))).alias("cid"))


# bags of words ------------------------------------------------------------------------------------------------------

DOC = rf"d AS (SELECT cid AS doc, word FROM (SELECT cid, unnest(regexp_extract_all(lower(content), '[a-z0-9]+|{KIND}+')) AS word FROM barrage WHERE content <> '' AND cid IS NOT NULL))"


def pool_words(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "barrage").where("content <> '' AND cid IS NOT NULL")
    return b.select(F.col("cid").alias("doc"), F.explode(F.regexp_extract_all(F.lower("content"), F.lit(rf"[a-z0-9]+|{tokens.WORDS}+"), F.lit(0))).alias("word"))


@query(f"""WITH {DOC}, v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS token_id FROM (SELECT DISTINCT word FROM d)) SELECT doc, token_id, count(*) AS n FROM d JOIN v USING (word) GROUP BY ALL""")
def vocabulary_bow(spark, folder):
    words = pool_words(spark, folder)
    return features.word_counts(words.join(features.vocabulary(words, "word"), "word"), ["doc"], "token_id")


@query(f"""WITH {DOC}, tf AS (SELECT doc, word, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), n AS (SELECT count(DISTINCT doc) AS n FROM d),
  raw AS (SELECT doc, word, tf * log2(n / df) AS w FROM tf JOIN df USING (word), n), norm AS (SELECT doc, sqrt(sum(w * w)) AS l FROM raw GROUP BY doc)
  SELECT doc, word, round(w / l, 6) AS weight FROM raw JOIN norm USING (doc) WHERE w > 0""")
def tfidf(spark, folder):
    return features.tfidf(pool_words(spark, folder), "doc", "word").withColumn("weight", F.round("weight", 6))


# vectors ------------------------------------------------------------------------------------------------------------


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
LONG = "l AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM v)"


@query(f"WITH {V}, {LONG}, s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS d FROM l GROUP BY pos) SELECT vec_id, pos::INT AS pos, round((x - m) / d, 6) AS z FROM l JOIN s USING (pos)")
def zscore_columns(spark, folder):
    return features.zscore_columns(embeddings(spark, folder), "vec_id", "v").withColumn("z", F.round("z", 6))


@query(f"WITH {V}, {LONG}, s AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS d FROM l GROUP BY vec_id) SELECT vec_id, pos::INT AS pos, round((x - m) / d, 5) AS z FROM l JOIN s USING (vec_id)")
def zscore_rows(spark, folder):
    e = embeddings(spark, folder)
    return e.select("vec_id", F.posexplode(features.zscore_row(F.col("v"))).alias("pos", "z")).withColumn("z", F.round("z", 5))


PAIRS = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d FROM v AS a, v AS b WHERE a.vec_id <> b.vec_id)"
ASKED = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d FROM v AS a, v AS b WHERE a.vec_id <> b.vec_id AND a.vec_id % 50 = 0)"
EPS = 1.15


def nearest_of_asked(spark: SparkSession, folder: str, k: int, within: float = 0.0) -> DataFrame:
    """The density estimates ask for every row whose id is divisible by 50 against all rows."""
    e = embeddings(spark, folder)
    return cluster.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "v", k, within=within)


@query(f"WITH {V}, {ASKED} SELECT a AS vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p) WHERE r = 4")
def knn_kdist(spark, folder):
    return nearest_of_asked(spark, folder, 4).where("rank = 4").select(F.col("a").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(f"WITH {V}, {PAIRS} SELECT v.vec_id, 1 + count(d) AS n FROM v LEFT JOIN p ON v.vec_id = p.a AND d <= {EPS} GROUP BY v.vec_id")
def eps_neighbours(spark, folder):
    return cluster.eps_counts(embeddings(spark, folder), "vec_id", "v", EPS)


@query(f"WITH {V}, {ASKED} SELECT round((SELECT count(*) FROM p WHERE d < {EPS}) / (SELECT count(*) FROM v WHERE vec_id % 50 = 0), 6) AS min_pts")
def min_pts(spark, folder):
    return nearest_of_asked(spark, folder, 1, EPS).agg(F.round(F.sum("near") / F.count_if(F.col("rank") == 1), 6).alias("min_pts"))


# the quartic's least squares in orthogonal polynomials of the places: moments of t, then the inflection
@query(f"""WITH {V}, {ASKED}, k AS (SELECT d AS y, row_number() OVER (ORDER BY d) - 1 AS pl, count(*) OVER () AS n FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p) WHERE r = 4),
  p0 AS (SELECT y, pl, n, 2.0 * pl / (n - 1) - 1 AS t FROM k),
  q1 AS (SELECT *, t - avg(t) OVER () AS f1 FROM p0), q2a AS (SELECT *, t * f1 AS g FROM q1),
  q2 AS (SELECT *, g - avg(g) OVER () - f1 * (sum(g * f1) OVER () / sum(f1 * f1) OVER ()) AS f2 FROM q2a), q3a AS (SELECT *, t * f2 AS h FROM q2),
  q3 AS (SELECT *, h - avg(h) OVER () - f1 * (sum(h * f1) OVER () / sum(f1 * f1) OVER ()) - f2 * (sum(h * f2) OVER () / sum(f2 * f2) OVER ()) AS f3 FROM q3a), q4a AS (SELECT *, t * f3 AS u FROM q3),
  q4 AS (SELECT *, u - avg(u) OVER () - f1 * (sum(u * f1) OVER () / sum(f1 * f1) OVER ()) - f2 * (sum(u * f2) OVER () / sum(f2 * f2) OVER ()) - f3 * (sum(u * f3) OVER () / sum(f3 * f3) OVER ()) AS f4 FROM q4a),
  fit AS (SELECT *, avg(y) OVER () + f1 * (sum(y * f1) OVER () / sum(f1 * f1) OVER ()) + f2 * (sum(y * f2) OVER () / sum(f2 * f2) OVER ()) + f3 * (sum(y * f3) OVER () / sum(f3 * f3) OVER ()) + f4 * (sum(y * f4) OVER () / sum(f4 * f4) OVER ()) AS z FROM q4),
  s AS (SELECT array_agg(z ORDER BY pl) AS z, array_agg(y ORDER BY pl) AS y, any_value(n) AS n FROM fit),
  d AS (SELECT y, n, z[1] AS z0, z[2] - z[1] AS d1, z[3] - 2 * z[2] + z[1] AS d2, z[4] - 3 * z[3] + 3 * z[2] - z[1] AS d3, z[5] - 4 * z[4] + 6 * z[3] - 4 * z[2] + z[1] AS d4 FROM s),
  c AS (SELECT y, n, d4 / 24 AS a, d3 / 6 - d4 / 4 AS b, d2 / 2 - d3 / 2 + 11 * d4 / 24 AS c FROM d)
  SELECT round(CASE WHEN 36 * b * b - 96 * a * c < 0 THEN y[-1] ELSE y[least(greatest(trunc((-6 * b + sqrt(36 * b * b - 96 * a * c)) / (24 * a))::BIGINT, 0), n - 1) + 1] END, 6) AS eps FROM c""")
def fitted_eps(spark, folder):
    distances = nearest_of_asked(spark, folder, 4).where("rank = 4")
    return spark.createDataFrame([(round(cluster.fitted_eps(distances, "distance"), 6),)], "eps double")


@query(f"""WITH RECURSIVE {V}, p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a, v AS b WHERE list_distance(a.v, b.v) <= {EPS}), core AS MATERIALIZED (SELECT a FROM p GROUP BY a HAVING count(*) >= 4),
  edges AS MATERIALIZED (SELECT a, b FROM p WHERE a IN (FROM core) AND b IN (FROM core)), reach AS (SELECT a AS a, a AS b FROM core UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
  comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), num AS (SELECT a, dense_rank() OVER (ORDER BY c) - 1 AS k FROM comp)
  SELECT v.vec_id, coalesce(any_value(n.k), min(m.k), -1)::INT AS cluster FROM v LEFT JOIN num AS n ON v.vec_id = n.a LEFT JOIN p ON v.vec_id = p.a LEFT JOIN num AS m ON p.b = m.a GROUP BY v.vec_id""")
def dbscan_labels(spark, folder):
    return cluster.dbscan(embeddings(spark, folder), "vec_id", "v", EPS, 4)


CLUSTERS = SQL["dbscan_labels"]


@query(CLUSTERS.rsplit("SELECT v.vec_id", 1)[0] + ", lab AS (SELECT v.vec_id" + CLUSTERS.rsplit("SELECT v.vec_id", 1)[1] + ") SELECT cluster, count(*) OVER (PARTITION BY cluster) AS members, vec_id FROM lab")
def dbscan_members(spark, folder):
    return cluster.members(cluster.dbscan(embeddings(spark, folder), "vec_id", "v", EPS, 4), "vec_id")


CENTRES = [(i, [((i * 7 + j * 3) % 11 - 5) / 20 for j in range(64)]) for i in range(10)]


@query(f"WITH {V}, c AS (SELECT i, list_transform(range(64), lambda j: ((i * 7 + j * 3) % 11 - 5) / 20) AS c FROM range(10) t(i)), d AS (SELECT vec_id, i, list_distance(v, c::DOUBLE[]) AS d FROM v, c) SELECT vec_id, arg_min(i, (round(d, 12), i))::INT AS cluster, round(min(d), 6) AS distance FROM d GROUP BY vec_id")
def kmeans_assign(spark, folder):
    return cluster.nearest_centre(embeddings(spark, folder), "vec_id", "v", CENTRES).withColumn("distance", F.round("distance", 6))


@query()
def kmeans_fit(spark, folder):
    z = embeddings(spark, folder)
    return cluster.kmeans(z, "vec_id", "v", 10)


@query(f"""WITH {V}, x AS (SELECT vec_id % 7 AS c, label AS l FROM v), n AS (SELECT count(*)::DOUBLE AS n FROM x), h AS (SELECT sum(k * (k - 1) / 2) AS s FROM (SELECT count(*)::DOUBLE AS k FROM x GROUP BY c, l)), a AS (SELECT sum(k * (k - 1) / 2) AS s FROM (SELECT count(*)::DOUBLE AS k FROM x GROUP BY c)), b AS (SELECT sum(k * (k - 1) / 2) AS s FROM (SELECT count(*)::DOUBLE AS k FROM x GROUP BY l)),
  q AS (SELECT h.s AS ss, a.s - h.s AS sd, b.s - h.s AS ds, n * (n - 1) / 2 - a.s - b.s + h.s AS dd FROM n, h, a, b)
  SELECT ss, sd, ds, dd, round(ss / (ss + sd + ds), 6) AS jaccard, round(sqrt(ss / (ss + sd) * ss / (ss + ds)), 6) AS fmi, round((ss + dd) / (ss + sd + ds + dd), 6) AS rand FROM q""")
def cluster_pair_indices(spark, folder):
    rows = embeddings(spark, folder).select((F.col("vec_id") % 7).alias("c"), F.col("label").alias("l"))
    return cluster.pair_indices(rows, "c", "l").select("ss", "sd", "ds", "dd", *(F.round(x, 6).alias(x) for x in ("jaccard", "fmi", "rand")))


@query(f"WITH {V}, z AS (SELECT v AS zero FROM v ORDER BY vec_id LIMIT 1) SELECT vec_id, round(exp(-list_sum(list_transform(list_zip(v, zero), lambda x: (x[1] - x[2]) ** 2)) / (2 * 1.3 * 1.3)), 6) AS k FROM v, z")
def kernel_rbf(spark, folder):
    e = embeddings(spark, folder)
    first = e.select(F.min_by("v", "vec_id")).scalar()
    return e.withColumn("first", first).select("vec_id", F.round(features.rbf(F.col("v"), F.col("first"), 1.3), 6).alias("k"))


@query(f"WITH {V} SELECT label, arg_min(vec_id, (-v[1], vec_id)) AS vec_id FROM v GROUP BY label")
def argmax_label(spark, folder):
    return classify.highest_score(embeddings(spark, folder).select("label", "vec_id", F.get("v", F.lit(0)).alias("s")), "label", "vec_id", "s")


@query()
def svm_predict(spark, folder):
    """Every other vector trains, all are predicted; vectors of four groups as those of four videos."""
    e = embeddings(spark, folder).withColumn("cid", F.col("vec_id") % 4)
    train = e.where((F.col("vec_id") / 4).cast("bigint") % 2 == 0)
    return classify.svm_predict(train, e, "cid", "v", "label").select("vec_id", "label", "predict_label")


@query()
def svm_one_vs_rest(spark, folder):
    e = embeddings(spark, folder).withColumn("cid", F.col("vec_id") % 4)
    train = e.where((F.col("vec_id") / 4).cast("bigint") % 2 == 0)
    return classify.svm_predict(train, e, "cid", "v", "label", c=200.0, one_vs_rest=True).select("vec_id", "label", "predict_label")


def window_docs(spark: SparkSession, folder: str) -> DataFrame:
    return event_words(spark, folder).groupBy("cid", "window_index").agg(F.array_sort(F.collect_list("word")).alias("words"))


@query()
def lda_topics(spark, folder):
    return features.lda_topics(window_docs(spark, folder), "window_index", "words")


@query()
def word2vec_vectors(spark, folder):
    from pyspark.ml.functions import vector_to_array

    docs = window_docs(spark, folder)
    return features.word_vectors(docs, "words").transform(docs).select("window_index", vector_to_array("vector").alias("vector"))


# order, refresh, admission, parsing ---------------------------------------------------------------------------------


@query(f"""WITH {B} SELECT cid, delivery_id, row_number() OVER (PARTITION BY cid ORDER BY us, delivery_id) AS place FROM b WHERE us IS NOT NULL AND cid IS NOT NULL""")
def sort_comments(spark, folder):
    b = pools(spark, folder).where("us IS NOT NULL AND cid IS NOT NULL")
    return positions(b.select("cid", "delivery_id", "us"), ["cid"], ["us", "delivery_id"], "place").select("cid", "delivery_id", (F.col("place") + 1).alias("place"))


SAME = ["type", "font_size", "font_color", "unix_timestamp", "pool", "sender_id", "row_id", "content"]


@query(f"""WITH m AS (SELECT max(delivery_id) // 2 AS h FROM barrage), s AS (SELECT * FROM barrage, m WHERE delivery_id <= h ORDER BY delivery_id DESC LIMIT 5)
  SELECT delivery_id FROM barrage WHERE delivery_id > coalesce((SELECT max(f.delivery_id) FROM barrage AS f JOIN s ON {" AND ".join(f"f.{c} IS NOT DISTINCT FROM s.{c}" for c in SAME)}), -1)""")
def delta_refresh(spark, folder):
    b = table(spark, folder, "barrage")
    half = b.select(F.expr("max(delivery_id) div 2")).scalar()
    return comments.refresh(b, b.where(F.col("delivery_id") <= half), "delivery_id", SAME).select("delivery_id")


@query(f"""WITH {B} SELECT cid, count(*) AS comments, max(us) AS last_play FROM b GROUP BY cid HAVING count(*) >= 100 AND max(us) / 10000000 <= count(*)""")
def corpus_admission(spark, folder):
    return comments.admitted(pools(spark, folder), "cid", "us", per=10_000_000)


XML = "'<d p=\"' || us || ',1,25,16777215,' || us // 1000000 || ',0,' || sender_id || ',' || row_id || '\">' || topic || chr(10) || coalesce(k, 0) || '</d>'"


@query(f"""WITH {E} SELECT row_id AS doc, x[1] AS play_timestamp, x[7] AS sender_id, x[8] AS row_id, x[9] AS content FROM (SELECT row_id, regexp_extract_all({XML}, '(?s)<d p="([^,"]*),.*', 0) AS t,
  [us::VARCHAR, '1', '25', '16777215', (us // 1000000)::VARCHAR, '0', sender_id::VARCHAR, row_id::VARCHAR, topic || chr(10) || coalesce(k, 0)] AS x FROM e)""")
def parse_xml_comments(spark, folder):
    e = events(spark, folder)
    xml = F.format_string('<d p="%d,1,25,16777215,%d,0,%d,%d">%s\n%d</d>', "us", F.expr("us div 1000000"), "sender_id", "row_id", "topic", F.coalesce("k", F.lit(0)))
    doc = e.select(F.col("row_id").alias("doc"), F.concat(F.lit("<i>"), xml, F.lit("\n</i>")).alias("xml"))
    return readers.xml_comments(doc, "doc", "xml").select("doc", "play_timestamp", "sender_id", "row_id", "content")


@query(r"""SELECT doc_id, 'T' || doc_id AS title, 'a' || chr(9) || source AS metakeywords, 'x' || chr(9) || coalesce(lang, '') AS tags, coalesce(CASE WHEN doc_id % 3 = 0 THEN cid END, '-1') AS cid, doc_id::VARCHAR AS aid FROM documents""")
def html_fields(spark, folder):
    d = table(spark, folder, "documents")
    html = F.concat(
        F.lit("<html><title>T"), "doc_id", F.lit('</title><meta name="keywords" content="a,'), "source", F.lit("\"><span property='v:title'>x</span><span property='v:title'>"), F.coalesce("lang", F.lit("")), F.lit("</span>"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<a href="?cid='), F.coalesce("cid", F.lit("")), F.lit('">'))).otherwise(F.lit("")),
    )
    pages = d.select("doc_id", html.alias("html"), F.concat(F.lit("http://video.example/av"), "doc_id", F.lit("/")).alias("url"))
    return pages.select("doc_id", *(c.alias(n) for n, c in web.html_fields(F.col("html"), F.col("url")).items()))


@query("""SELECT doc_id, 'v' || doc_id AS url, n_chars::INT AS comments FROM documents WHERE n_chars >= 100 AND n_chars < 100000000""")
def listing_filter(spark, folder):
    d = table(spark, folder, "documents")
    html = F.concat(F.lit('<li><a href="v'), "doc_id", F.lit('" class="t">x</a> <i class="dm" number="'), "n_chars", F.lit('"></i></li><a href="none">y</a> <i class="dm" number="99"></i>'))
    return d.select("doc_id", F.inline(web.listing(html)))


@query("""SELECT aid, 'http://x.example/av' || (CASE WHEN i.s = 0 THEN '-' ELSE '_' END) || p || '.html' AS url FROM (SELECT aid, any_value(coalesce(season_index, 0)) % 5 AS n, aid::BIGINT % 3 AS s FROM video GROUP BY aid) AS i, range(1, 5) AS r(p) WHERE s < 2 AND p <= n""")
def page_urls(spark, folder):
    v = table(spark, folder, "video").groupBy("aid").agg((F.coalesce(F.first("season_index"), F.lit(0)) % 5).alias("n"))
    tail = F.when(F.col("aid").cast("bigint") % 3 == 0, "-1.html").when(F.col("aid").cast("bigint") % 3 == 1, "_1.html").otherwise("/1/")
    return v.select("aid", F.explode(web.page_urls(F.concat(F.lit("http://x.example/av"), tail), F.col("n"))).alias("url"))


@query("SELECT season_id, title, is_finish, total_count FROM (SELECT DISTINCT * FROM xinfan) WHERE season_id::BIGINT % 2 = 0")
def season_api(spark, folder):
    x = table(spark, folder, "xinfan").distinct()
    answer = F.to_json(F.struct(F.when(F.col("season_id").cast("bigint") % 2 == 0, 0).otherwise(1).alias("code"), F.lit("success").alias("message"), F.struct(F.array(F.struct("season_id", "title", "is_finish", "total_count")).alias("list")).alias("result")))
    return web.season_rows(x.select(answer.alias("json")), "json").select("season_id", "title", "is_finish", "total_count")


@query(f"WITH {E} SELECT row_id, k FROM e")
def json_props(spark, folder):
    props = table(spark, folder, "events").select(F.col("event_id").alias("row_id"), F.from_json("props", "struct<k: bigint>").alias("p"))
    return props.select("row_id", "p.k")


@query(f"""WITH {E} SELECT us / 1e6 AS recv_time, '1' AS rid, sender_id::VARCHAR AS uid, 'n/@' || sender_id AS nn, topic AS txt, row_id::VARCHAR AS cid, '3' AS level FROM e WHERE row_id % 3 <> 0""")
def live_parse(spark, folder):
    e = events(spark, folder)
    kind = F.when(F.col("row_id") % 3 == 0, "keeplive").when(F.col("row_id") % 3 == 1, "chatmsg").otherwise("chatmessage")
    keys = lambda k: F.concat(F.lit("rid@=1/"), F.lit(k[1] + "@="), F.col("sender_id"), F.lit(f"/{k[2]}@=n@S@A"), F.col("sender_id"), F.lit(f"/{k[3]}@="), F.col("topic"), F.lit(f"/{k[4]}@="), F.col("row_id"), F.lit("/level@=3/"))
    raw = F.concat(F.lit("type@="), kind, F.lit("/"), F.when(kind == "chatmsg", keys(live.KEYS["chatmsg"])).otherwise(keys(live.KEYS["chatmessage"])))
    return live.parsed(e.select((F.col("us") / 1e6).alias("t"), raw.alias("raw")), "raw", "t")


@query("""WITH x AS (SELECT event_id, date_trunc('second', ts) AS t, user_id % 50 AS u FROM events), y AS (SELECT event_id, epoch(t) - epoch(date_trunc('day', t)) - 43200 AS "offset", 'u' || lpad(u::VARCHAR, 3, '0') AS sender_name FROM x)
  SELECT event_id, "offset"::DOUBLE AS "offset", sender_name, (dense_rank() OVER (ORDER BY sender_name) - 1)::BIGINT AS code FROM y WHERE "offset" >= 0""")
def live_offset_sender(spark, folder):
    e = table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    line = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("u"), F.lpad((F.col("user_id") % 50).cast("string"), 3, "0")), F.col("event_id").cast("string"))
    log = readers.dated_log(e.select(line.alias("line"), "day"), "line", F.col("day"))
    return comments.dense_codes(log, "sender_name").select(F.col("content").cast("bigint").alias("event_id"), "offset", "sender_name", "code")


@query("""SELECT delivery_id, v.title AS video_title, x.title AS season_title FROM barrage AS b JOIN (SELECT DISTINCT aid, title, xinfan_season_id FROM video) AS v ON b.video_aid = v.aid LEFT JOIN (SELECT DISTINCT season_id, title FROM xinfan) AS x ON v.xinfan_season_id = x.season_id""")
def comment_video_season_join(spark, folder):
    joined = comments.video_comments(table(spark, folder, "barrage"), table(spark, folder, "video"), table(spark, folder, "xinfan"))
    return joined.select("delivery_id", "video_title", "season_title")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def foreign_key_chain(spark, folder):
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT delivery_id, content FROM barrage WHERE video_aid = (SELECT min(aid) FROM video)")
def point_lookup(spark, folder):
    first = table(spark, folder, "video").select(F.min("aid")).scalar()
    return comments.by_key(table(spark, folder, "barrage"), "video_aid", first).select("delivery_id", "content")


@query("""WITH n AS (SELECT delivery_id, row_id, video_aid FROM barrage WHERE batch_id > (SELECT max(batch_id) // 2 FROM barrage)), s AS (SELECT DISTINCT row_id FROM barrage WHERE batch_id <= (SELECT max(batch_id) // 2 FROM barrage)), t AS (SELECT row_id FROM n GROUP BY row_id HAVING count(*) > 1)
  SELECT delivery_id, CASE WHEN video_aid IS NULL OR video_aid NOT IN (SELECT aid FROM video) THEN 'no parent' WHEN row_id IN (FROM s) THEN 'stored' WHEN row_id IN (FROM t) THEN 'twice' END AS reason FROM n""")
def insert_validate(spark, folder):
    b = table(spark, folder, "barrage").select("delivery_id", "batch_id", "row_id", "video_aid")
    half = b.select(F.expr("max(batch_id) div 2")).scalar()
    new, stored = b.where(F.col("batch_id") > half), b.where(F.col("batch_id") <= half)
    return comments.valid_inserts(new, table(spark, folder, "video"), stored, "video_aid", "aid", "row_id").select("delivery_id", "reason")


def through_files(spark: SparkSession, name: str) -> str:
    """A folder for what a query writes and reads again."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"



@query(f"""WITH {E} SELECT row_id, us::VARCHAR AS play_timestamp, sender_id::VARCHAR AS sender_id, topic || ' #' || coalesce(k, 0) AS content FROM e WHERE row_id % 4 <> 0""")
def tsv_comments(spark, folder):
    """Comments as lines of nine fields and more, read again; every fourth line lacks one and is dropped."""
    e = events(spark, folder)
    fields = [F.col("us").cast("string"), *(F.lit(x) for x in ("1", "25", "16777215", "0", "0")), F.col("sender_id").cast("string"), F.col("row_id").cast("string"), F.concat(F.col("topic"), F.lit(" #"), F.coalesce("k", F.lit(0)))]
    line = F.when(F.col("row_id") % 4 == 0, F.concat_ws("\t", *fields[:8])).when(F.col("row_id") % 4 == 1, F.concat_ws("\t", *fields, F.lit("tail"))).otherwise(F.concat(F.lit("  "), F.concat_ws("\t", *fields), F.lit(" \t")))
    return readers.comment_fields(e.select(line.alias("line")), "line").select(F.col("row_id").cast("bigint").alias("row_id"), "play_timestamp", "sender_id", "content")


@query("""SELECT aid, 'r' || aid AS room_id, title AS room_name, 'h' || (aid::BIGINT % 7) AS ip, '80' AS port FROM (SELECT DISTINCT * FROM video) WHERE aid::BIGINT % 5 <> 0""")
def room_servers(spark, folder):
    """Rooms and servers in pages; a page whose record is no JSON has neither."""
    v = table(spark, folder, "video").distinct()
    record = F.when(F.col("aid").cast("bigint") % 5 == 0, "{no json}").otherwise(F.to_json(F.struct(F.concat(F.lit("r"), "aid").alias("room_id"), F.col("title").alias("room_name"))))
    servers = F.url_encode(F.to_json(F.array(F.struct(F.concat(F.lit("h"), (F.col("aid").cast("bigint") % 7).cast("string")).alias("ip"), F.lit("80").alias("port")))))
    html = F.concat(F.lit("<script>var $ROOM = "), record, F.lit(';</script>{"server_config":"'), servers, F.lit('"}'))
    pages = v.select("aid", web.room_json(html).alias("room"), web.server_list(html).alias("servers"))
    return pages.where("room.room_id IS NOT NULL").select("aid", "room.room_id", "room.room_name", F.inline("servers"))


@query(f"""WITH {B} SELECT cid, delivery_id, us FROM b WHERE us IS NOT NULL AND cid IS NOT NULL AND cid IN (SELECT cid FROM b GROUP BY cid HAVING count(*) >= 100 AND max(us) / 10000000 <= count(*))""")
def append_corpus(spark, folder):
    """Comments of admitted videos appended to files by video, in two batches, and read again."""
    path = through_files(spark, "appended")
    b = pools(spark, folder).where("cid IS NOT NULL")
    good = b.join(comments.admitted(b, "cid", "us", per=10_000_000).select("cid"), "cid", "left_semi").where("us IS NOT NULL").select("cid", "delivery_id", "us")
    for half in (0, 1):
        sinks.append_comments(good.where(F.col("delivery_id") % 2 == half), path)
    return spark.read.schema("delivery_id bigint, us bigint, cid string").option("sep", "\t").csv(path).select("cid", "delivery_id", "us")


@query(f"""WITH {E}, {CLIPS} SELECT (s // 60000000)::VARCHAR || ':' || ((s // 1000000) % 60)::VARCHAR AS "start", (f // 60000000)::VARCHAR || ':' || ((f // 1000000) % 60)::VARCHAR AS "end", 'highlight' AS label FROM clips""")
def clips_as_text(spark, folder):
    """Clips written as text with minutes and seconds, read again."""
    path = through_files(spark, "clips")
    sinks.write_clips(six_hour_clips(spark, folder).select("cid", *(F.expr(f"{x} div 1000000").alias(x) for x in ("start", "end")), "label"), path)
    return spark.read.schema("cid string, start string, end string, label string").option("sep", "\t").csv(path).drop("cid")


@query(f"""WITH {TOK} SELECT string_agg(word, chr(9) ORDER BY pos) AS value FROM (SELECT * FROM tok WHERE flag IN ('n', 'eng', 'm')) GROUP BY id""")
def corpus_lines(spark, folder):
    """The words of each comment as a line of a training corpus, written and read again."""
    path = through_files(spark, "corpus")
    sinks.write_corpus(comment_tokens(spark, folder).where("flag IN ('n', 'eng', 'm')"), path)
    return spark.read.text(path)


@query(f"""WITH {B}, s AS (SELECT delivery_id, row_number() OVER (ORDER BY us NULLS FIRST, delivery_id) AS place FROM b) SELECT place::BIGINT AS place, delivery_id FROM s""")
def sorted_comments(spark, folder):
    """sort_comments over all pools; the place of each row in the sorted files."""
    ordered = comments.sort_comments(pools(spark, folder).select("play_timestamp", "delivery_id", (F.col("us") / 1_000_000).cast("decimal(38,18)").cast("string").alias("seconds")), "seconds", "delivery_id")
    kept = written(ordered.withColumn("slice", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).select("delivery_id", "slice", "at"), "sorted")
    return positions(kept, [], ["at"], "place").select((F.col("place") + 1).alias("place"), "delivery_id")


@query(f"WITH {V}, z AS (SELECT v AS zero FROM v ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_distance(v, zero), 6) AS d FROM v, z")
def euclidean_distance(spark, folder):
    e = embeddings(spark, folder)
    first = e.select(F.min_by("v", "vec_id")).scalar()
    return e.withColumn("first", first).select("vec_id", F.round(features.euclidean(F.col("v"), F.col("first")), 6).alias("d"))


@query("""SELECT doc_id, n_chars::VARCHAR AS views, (n_chars % 97)::VARCHAR AS comments, (doc_id % 7)::VARCHAR AS coins, '--' AS favourites, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 40 + 1)::INT END AS pages FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 40 + 1)::INT END FROM documents WHERE doc_id % 3 = 0""")
def page_counters(spark, folder):
    """The counters of a video's page, all or none, and the number of pages of a listing."""
    d = table(spark, folder, "documents").select("doc_id", "n_chars")
    counter = lambda name, value: F.concat(F.lit(f'<span id="{name}">'), value, F.lit("</span>\n"))
    block = F.concat(F.lit('<div class="v-title-info">'), counter("dianji", F.col("n_chars")), counter("dm_count", F.col("n_chars") % 97), counter("v_ctimes", F.col("doc_id") % 7), F.when(F.col("doc_id") % 3 != 0, counter("stow_count", F.lit("--"))).otherwise(F.lit("")), F.lit("</div>"))
    list_ = F.concat(F.lit('<div class="pagelistbox"><a class="p">1</a>'), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<a class="p endPage" href="x">'), F.col("doc_id") % 40 + 1, F.lit("</a>"))).otherwise(F.lit("")), F.lit("</div>"))
    pages = d.select("doc_id", web.counters(block).alias("c"), web.listed_pages(list_).alias("pages"))
    return pages.select("doc_id", *(F.col(f"c.{x}").alias(x) for x in ("views", "comments", "coins", "favourites")), "pages")


@query("SELECT season_id, tag, pos::INT AS pos FROM (SELECT season_id, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM (SELECT DISTINCT season_id, ['a' || season_id, 'b'] AS t FROM xinfan)) WHERE season_id::BIGINT % 3 = 0")
def season_details(spark, folder):
    """Tags of seasons whose answer is a success, in order."""
    x = table(spark, folder, "xinfan").select("season_id").distinct()
    tags = F.array(F.struct(F.concat(F.lit("a"), "season_id").alias("tag_name")), F.struct(F.lit("b").alias("tag_name")))
    number = F.col("season_id").cast("bigint") % 3
    answer = F.to_json(F.struct(F.when(number == 1, 1).otherwise(0).alias("code"), F.when(number == 2, "denied").otherwise("success").alias("message"), F.struct(tags.alias("tags")).alias("result")))
    packed = x.select("season_id", web.season_tags(answer).alias("t")).where("t IS NOT NULL")
    return packed.select("season_id", F.posexplode(F.split("t", "\t")).alias("pos", "tag")).withColumn("pos", F.col("pos") + 1)


@query("SELECT folder, count(*) AS files FROM (VALUES ('p'), ('p'), ('q')) AS t(folder) GROUP BY folder")
def listed_files(spark, folder):
    """The files of folders below a path."""
    path = through_files(spark, "listed")
    for name, n in (("p", 2), ("q", 1)):
        spark.range(n).select(F.col("id").cast("string")).repartitionByRange(n, "id").write.text(f"{path}/{name}")
    files = readers.list_files(spark, path, "*.txt")
    return files.groupBy(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


# whole runs ---------------------------------------------------------------------------------------------------------


F5 = pipeline.Method("f", 5)


@query()
def pipeline_full(spark, folder):
    e = events(spark, folder)
    found, _ = pipeline.train_and_evaluate(e, e, intervals(spark), "cid", "us", "topic", F5, pipeline.Settings(HOUR, 0.7, 0.3, False))
    return found


@query()
def pipeline_measures(spark, folder):
    e = events(spark, folder)
    _, measures = pipeline.train_and_evaluate(e, e, intervals(spark), "cid", "us", "topic", F5, pipeline.Settings(HOUR, 0.7, 0.3, False))
    return measures


QUARTER = HOUR // 4
UNALIGNED = [(1, 78, "a"), (203, 221, "a"), (399, 523, "a")]  # quarters of an hour


def unaligned(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("events", a * QUARTER, b * QUARTER, x) for a, b, x in UNALIGNED], "cid string, start bigint, end bigint, label string")


UNALIGNED_SQL = f"i AS (SELECT unnest({[a * QUARTER for a, *_ in UNALIGNED]}) AS f, unnest({[b * QUARTER for _, b, _ in UNALIGNED]}) AS l)"


@query(f"""WITH {E}, {UNALIGNED_SQL}, w AS (SELECT unnest(range(f, l, {HOUR})) AS s FROM i)
  SELECT s AS "start", topic, count(*)::DOUBLE AS n FROM w JOIN e ON us BETWEEN s AND s + {HOUR} GROUP BY ALL""")
def training_vectors(spark, folder):
    """The vectors that windows of intervals train with; the intervals begin at any quarter of an hour."""
    own = windows.labelled_items(unaligned(spark), events(spark, folder), "cid", "us", "topic", HOUR)
    return own.select("start", F.explode("n").alias("topic", "n"))


@query(f"""WITH {E}, {UNALIGNED_SQL}, {CLIPS}, p AS (SELECT s, f, 'a' AS label FROM clips), q AS (SELECT f AS s, l AS f, 'a' AS label FROM i), m AS (SELECT greatest(p.s, q.s) AS s, least(p.f, q.f) AS f, 'a' AS label, 'a' AS base_label FROM p, q WHERE p.s <= q.f AND p.f >= q.s), {_TIME}, pr AS (SELECT t.x / pp.x AS a, t.x / qq.x AS b, t.n / pp.n AS c, t.n / qq.n AS d FROM t, pp, qq)
  SELECT round(a, 6) AS time_p, round(b, 6) AS time_r, round(coalesce(2 * a * b / nullif(a + b, 0), 0), 6) AS time_f1, round(c, 6) AS label_p, round(d, 6) AS label_r FROM pr""")
def pipeline_measures_unaligned(spark, folder):
    """The whole run with intervals of one label, which every highlight gets then, so that SQL can tell the measures."""
    e = events(spark, folder)
    _, m = pipeline.train_and_evaluate(e, e, unaligned(spark), "cid", "us", "topic", F5, pipeline.Settings(SIX, 0.7, 0.3, False))
    return m.select(*(F.round(c, 6).alias(c) for c in ("time_p", "time_r", "time_f1", "label_p", "label_r")))


def pool_run(spark: SparkSession, folder: str, method: pipeline.Method, **more) -> tuple[DataFrame, DataFrame]:
    """The whole run over the pools of barrage, with the words of their comments and all labelled intervals."""
    b = pools(spark, folder).where("us >= 0 AND cid IS NOT NULL").select("cid", "us", "content")
    words = b.select("cid", "us", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(rf"[a-z0-9]+|{tokens.WORDS}+"), F.lit(0))).alias("word"))
    l = table(spark, folder, "label_interval").select("cid", *((clock_seconds(F.col(f"{x}_time")).cast("bigint") * 1_000_000).alias(x) for x in ("start", "end")), "label").where("cid IS NOT NULL AND label IS NOT NULL AND end > start")
    return pipeline.train_and_evaluate(b, words, l, "cid", "us", "word", method, pipeline.Settings(TEN, 0.4, 0.6, True), **more)


@query()
def pipeline_wordbase(spark, folder):
    """Clips of windows rated and labelled by the words that are in them."""
    return pool_run(spark, folder, pipeline.Method("wordbase"))[0]


@query()
def pipeline_lda(spark, folder):
    """Clips of windows rated and labelled by the topics of their words."""
    return pool_run(spark, folder, pipeline.Method("lda", 8))[0]


@query()
def pipeline_held_out(spark, folder):
    """Measures of every fourth video, by machines trained on the others."""
    return pool_run(spark, folder, pipeline.Method("lda", 8), held_out=F.pmod(F.xxhash64("cid"), F.lit(4)) == 0)[1]


def event_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """events with the mean vector of their words."""
    from pyspark.ml.functions import vector_to_array

    docs = events(spark, folder).withColumn("words", F.array_compact(F.array("topic", F.concat(F.lit("k"), F.col("k").cast("string")))))
    model = features.word_vectors(docs, "words", size=100, least=1)
    return model.transform(docs).select("cid", "us", vector_to_array("vector").alias("v"))


@query()
def pipeline_clusters(spark, folder):
    """The whole run with topics that are clusters of comment vectors."""
    e = event_vectors(spark, folder)
    items = written(cluster.clusterings(e, "cid", "v", [20]).select("cid", "us", "topic"), "items")
    found, _ = pipeline.train_and_evaluate(e, items, intervals(spark), "cid", "us", "topic", pipeline.Method("f", 20), pipeline.Settings(HOUR, 0.4, 0.6, False))
    return found


@query()
def grid_search_clusters(spark, folder):
    """Thresholds by thresholds by cluster numbers: 7,371 runs."""
    return pipeline.parameter_search(event_vectors(spark, folder), intervals(spark), "cid", "us", "v", [*range(10, 101)], GRID, GRID, pipeline.Settings(SIX, trim=False))
