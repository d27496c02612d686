import random

import pytest
from pyspark.sql import functions as F

from hilite.functions.numbers import clock_seconds, identifier, play_micros, whole_number
from hilite.operators.dedupe import first_of_each, flag_first, merge_deliveries, without_copies
from hilite.operators.intervals import periods_and_gaps
from hilite.operators.packed import explode_packed, packed_values
from hilite.session import exists, own_folder, release, shared_folder, written


def values(spark, column, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_whole_numbers(spark):
    texts = ["42", " 042", "42.0", "４２", "+42\xa0", "4.2E1", "42.5", "x", "", None, "99999999999999999999", "-7"]
    assert values(spark, whole_number, texts) == [42] * 6 + [None] * 5 + [-7]
    assert values(spark, identifier, ["007", "7.0", " a ", "a", "  ", None, "=7"]) == ["7", "7", "=a", "=a", None, None, "==7"]


def test_play_times(spark):
    assert values(spark, play_micros, ["0.33799999952316", "10", " 1.5 ", "１.5", "x", None, "-1", "1e2", "0.0000005"]) == [338000, 10_000_000, 1_500_000, 1_500_000, None, None, -1_000_000, 100_000_000, 1]


def test_clock_positions(spark):
    texts = ["01:57", "75:03", "0:05:38", "12：42", "12分9秒", "63m43s", "716 s", "　04:54 ", "2m", "1h2m3s", "１:０2", "5:61:0:1", "m", "", "  ", None, "1:2:3:4", "abc", "99999999999:1", "42"]
    assert values(spark, clock_seconds, texts) == [117, 4503, 338, 762, 729, 3823, 716, 294, 120, 3723, 62] + [None] * 8 + [42]


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_one_copy_of_each(spark, hot):
    rng = random.Random(1)
    keys = [rng.choice(["a", "a", "a", None, *map(str, range(40))]) for _ in range(500)]
    rows = [(k, i, f"x{i}", "n", "s") for i, k in enumerate(keys)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n bigint, flag string, __x string, salt string").withColumnRenamed("__x", "rank").repartition(5)
    first = {}
    for k, n, *_ in sorted(rows, key=lambda r: r[1]):
        if k is not None:
            first.setdefault(k, n)
    want = sorted([n for k, n, *_ in rows if k is None] + [*first.values()])
    assert sorted(r.n for r in first_of_each(df, "k", ["n"], hot_rows=hot).collect()) == want
    flagged = flag_first(df, "k", ["n"], hot_rows=hot)
    assert flagged.count() == len(rows) and sorted(r.n for r in flagged.where("is_first").collect()) == want
    assert first_of_each(df, "k", ["n"]).columns == df.columns
    assert sorted(r.n for r in without_copies(df, "k", ["n"], "n", hot_rows=hot).collect()) == want
    assert first_of_each(df.limit(0), "k", ["n"]).collect() == []


def test_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", None), ("b", None)], "k string, n int")
    assert sorted(r.k for r in first_of_each(df, "k", ["n"]).collect()) == ["a", "b"]


def test_stored_messages_come_first(spark):
    stored = spark.createDataFrame([("a", 9), ("b", 2), ("b", 3)], "k string, n int")
    new = spark.createDataFrame([("a", 1), ("c", 5), ("c", 4)], "k string, n int")
    assert sorted(map(tuple, merge_deliveries(stored, new, "k", ["n"]).collect())) == [("a", 9), ("b", 2), ("c", 4)]
    assert sorted(map(tuple, merge_deliveries(stored.limit(0), new, "k", ["n"]).collect())) == [("a", 1), ("c", 4)]


def test_packed_values(spark):
    cases = {
        "a\tb\t\t c ": ["a", "b", "c"],
        "a|b， c、d;e；f/g > h\ni": list("abcdefghi"),
        '["x", "say \\"hi\\"", "Paper, Comet"]': ["x", 'say "hi"', "Paper, Comet"],
        '["AM|PM"]': ["AM|PM"],
        "[]": [],
        '"say ""hi""", plain': ['say "hi"', "plain"],
        "“一、二”、\"三,四\"": ["一、二", "三,四"],
        "恋爱\\t冒险\\n美食": ["恋爱", "冒险", "美食"],
        "Kaya's diary|C++ 教程·原创&B-side": ["Kaya's diary", "C++ 教程·原创&B-side"],
        'a "b" c, d': ['a "b" c', "d"],
        '"open, end': ['"open', "end"],
        "_x,1, \"q,r\"": ["_x", "1", "q,r"],
        ' , ,"", “ ”': [],
        "": [],
        "  ": [],
        None: [],
        "[补档]番外, b": ["[补档]番外", "b"],
    }
    assert values(spark, packed_values, list(cases)) == list(cases.values())


def test_very_long_packed_values(spark):
    long = '"' + 'x""' * 100_000 + '",' + "y" * 300_000 + "," * 100_000 + "z"
    blanks = "a" + "\t" * 300_000 + " " * 300_000 + '"x,y"' + " " * 300_000 + "\t,b"
    assert [list(map(len, v)) for v in values(spark, packed_values, [long, blanks])] == [[200_000, 300_000, 1], [1, 3, 1]]


def test_packed_rows(spark):
    rows = [("1", "a,a", None), ("1", "a,a", None), ("2", "b", "c;d"), (None, "e", ""), ("3", "f", None), ("3", "f", "g")]
    df = spark.createDataFrame(rows, "pos string, val string, field string")
    got = sorted(map(tuple, explode_packed(df, {"val": "t.val", "field": "t.field"}, "pos").collect()), key=repr)
    assert got == sorted([("t.val", "1", 1, "a"), ("t.val", "1", 2, "a"), ("t.val", "2", 1, "b"), ("t.field", "2", 1, "c"), ("t.field", "2", 2, "d"), ("t.val", None, 1, "e"), ("t.val", "3", 1, "f"), ("t.val", "3", 1, "f"), ("t.field", "3", 1, "g")], key=repr)
    assert explode_packed(df.limit(0), {"val": "t.val"}, "pos").collect() == []


def brute(rows):
    out = []
    for key in sorted({k for k, *_ in rows if k is not None}):
        spans = sorted((a, b) for k, a, b in rows if k == key and a is not None and b is not None and b > a)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(key, "period", a, b) for a, b in merged] + [(key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_periods_and_gaps(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        a = rng.randrange(0, 20_000)
        rows.append((rng.choice(["p", "q", "r", None]), rng.choice([a, a, a, None]), a + rng.randrange(-20, [60, 3000][seed % 2])))
    rows += rows[:20] + [("p", 5, 5), ("p", 7, 3), ("only", -10, -4), ("touch", 1, 5), ("touch", 5, 9)]
    df = spark.createDataFrame(rows, "kind string, start_sec int, end_sec int").withColumnRenamed("kind", "cid")
    assert sorted(map(tuple, periods_and_gaps(df, "cid", "start_sec", "end_sec").collect())) == brute(rows)
    assert periods_and_gaps(df.limit(0), "cid", "start_sec", "end_sec").collect() == []


class Elsewhere:
    """A session of a cluster with nothing set."""

    conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
    sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Elsewhere.conf)})


def test_no_local_folder_on_a_cluster(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere)
    assert shared_folder(spark)


def test_tables_go(spark):
    assert written(spark.range(3), "t").count() == 3 and exists(spark, own_folder(spark))
    release(spark)
    assert not exists(spark, own_folder(spark))
