"""The small cases that fix each operator's rules."""

import math
import random
import re
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from hilite.functions.arrays import running_sum
from hilite.functions.timefmt import cid_of_path, clock_text, play_time_text
from hilite.operators import classify, clips, cluster, comments, features, rating, tokens, topics, windows
from hilite.plans import pipeline
from hilite.session import written

S = 1_000_000


def comments_at(spark, *seconds, cid="v"):
    return spark.createDataFrame([(cid, int(round(s * S)), 2) for s in seconds], "cid string, us bigint, words int")


def test_window_edges(spark):
    c = comments_at(spark, 0, 9.999999, 10.0, 20.0)
    assert [(r.window_index, r.comments, r.words) for r in windows.tumbling(c, "cid", "us", 10 * S, "words").orderBy("window_index").collect()] == [(0, 2, 4), (1, 1, 2), (2, 1, 2)]
    i = spark.createDataFrame([("v", 0, 20 * S, "x"), ("v", 0, 20 * S, None), ("w", 0, 15 * S, "y"), ("v", 5, 5, "z")], "cid string, start bigint, end bigint, label string")
    got = windows.labelled(i, c, "cid", "us", 10 * S).collect()
    assert sorted((r.cid, r.window_index, str(r.label), r.comments) for r in got) == [("v", 0, "None", 3), ("v", 0, "x", 3), ("v", 1, "None", 2), ("v", 1, "x", 2), ("w", 0, "y", 0), ("w", 1, "y", 0)]


def test_training_windows_have_their_own_items(spark):
    at = [(0, "x"), (4, "x"), (5, "y"), (14, "y"), (15, "z"), (16, "z"), (24, "x"), (26, "x")]
    c = spark.createDataFrame([("v", s * S, t) for s, t in at], "cid string, us bigint, topic string")
    i = spark.createDataFrame([("v", 5 * S, 25 * S, "a"), ("v", 5 * S, 25 * S, None), ("v", 16 * S, 17 * S, "b"), ("v", 40 * S, 41 * S, "b"), ("v", 4 * S, 5 * S, "a"), ("v", 4 * S, 5 * S, "a")], "cid string, start bigint, end bigint, label string")
    got = windows.labelled_items(i, c, "cid", "us", "topic", 10 * S).collect()
    first, second = {"y": 2, "z": 1}, {"z": 2, "x": 1}
    want = [(4, "a", {"x": 1, "y": 2})] * 2 + [(5, "a", first), (5, "None", first), (15, "a", second), (15, "None", second), (16, "b", {"z": 1, "x": 2}), (40, "b", None)]
    assert sorted((r.start // S, str(r.label), str(r.n and sorted(r.n.items()))) for r in got) == sorted((a, b, str(n and sorted((k, float(v)) for k, v in n.items()))) for a, b, n in want)


def test_training_uses_these_windows(spark):
    """Each label has one topic in its own closed windows; the half-open windows of the same index have the other label's."""
    at = [(1, "x"), (2, "x"), (3, "x"), (10, "x"), (11, "y"), (12, "y"), (13, "y"), (20, "y"), (31, "x"), (32, "x"), (33, "x"), (34, "x"), (42, "y"), (43, "y"), (44, "y"), (46, "y")]
    c = spark.createDataFrame([("v", s * S, t) for s, t in at], "cid string, us bigint, topic string")
    i = spark.createDataFrame([("v", 9 * S + 500_000, 10 * S + 500_000, "y"), ("v", 29 * S, 30 * S, "x")], "cid string, start bigint, end bigint, label string")
    clips_, _ = pipeline.train_and_evaluate(c, c, i, "cid", "us", "topic", pipeline.Method("f", 2), pipeline.Settings(10 * S, 0.0, 0.1, False))
    assert {(r.start // S, r.end // S, r.label) for r in clips_.collect()} >= {(30, 40, "x"), (40, 50, "y")}


def test_lloyd():
    x = np.array([[0.0, 0], [0, 1], [9, 9], [9, 10], [-9, 0]])
    for seed in range(5):
        own = cluster.lloyd(x, np.array([5.0, 1, 1, 4, 1]), 5, seed=seed)
        assert sorted(own) == [0, 1, 2, 3, 4]
        assert len(set(cluster.lloyd(x, np.ones(5), 9, seed=seed))) == 5
    own = cluster.lloyd(x[:4], np.ones(4), 2, seed=1)
    assert own[0] == own[1] != own[2] == own[3]


def test_clusters_without_vectors(spark):
    """Rows meet their clusters by a key of their vectors, not by the vectors; equal vectors are one, whatever their zeros and nulls."""
    rows = [("p", 1, [0.0, 1.0]), ("p", 2, [-0.0, 1.0]), ("p", 3, [9.0, float("nan")]), ("p", 4, None), (None, 5, [1.0, 2.0]), ("q", 6, [None, 1.0]), ("q", 7, [1.0, None])]
    c = spark.createDataFrame(rows, "cid string, us bigint, v array<double>")
    found = cluster.clusterings(c, "cid", "v", [2, 3]).select("cid", "us", "cluster_num", "topic")
    by = re.findall("Join Inner, (.*)", found._jdf.queryExecution().optimizedPlan().toString())
    assert by and not any("__v" in x for x in by)
    got = {(r.us, r.cluster_num): r.topic for r in found.collect()}
    assert sorted(got) == [(us, n) for us in (1, 2, 3, 6, 7) for n in (2, 3)] and found.count() == len(got)
    assert got[1, 2] == got[2, 2]
    keys = [r.k for r in c.select(cluster.vector_key(F.col("v")).alias("k")).collect()]
    assert keys[0] == keys[1] and keys[3] is None and len(set(keys)) == 6


def test_parameter_search(spark):
    """Each cell of the search is the run of train_and_evaluate with these clusters and thresholds."""
    rng = np.random.default_rng(4)
    rows = [(v, int(s * S), [float(x) for x in rng.normal(0, 0.2, 2) + (3 * (s // 50 % 2), s // 30 % 3)]) for v in (7, 8) for s in rng.integers(0, 200, 150)]
    c = spark.createDataFrame(rows, "cid int, us bigint, v array<double>").cache()
    i = spark.createDataFrame([(7, 3 * S, 43 * S, "a"), (7, 55 * S, 90 * S, "b"), (8, 101 * S, 133 * S, "a"), (8, 58 * S, 90 * S, "b")], "cid int, start bigint, end bigint, label string")
    got = pipeline.parameter_search(c, i, "cid", "us", "v", [2, 3, 5], [0.3, 0.5], [0.2, 0.7], pipeline.Settings(10 * S, trim=False)).collect()
    assert len(got) == 2 * 3 * 4 and [r.time_f1 for r in got] == sorted((r.time_f1 for r in got), reverse=True) and got[0].time_f1 > 0
    for number, left, right in ((2, 0.3, 0.2), (3, 0.5, 0.2), (5, 0.3, 0.7)):
        items = cluster.clusterings(c, "cid", "v", [number])
        assert items.count() == 300 and items.select("topic").distinct().count() == number
        _, m = pipeline.train_and_evaluate(c, items, i, "cid", "us", "topic", pipeline.Method("f", number), pipeline.Settings(10 * S, left, right, False))
        want = {r.cid: tuple(r)[1:] for r in m.collect()}
        assert {r.cid: tuple(r)[4:] for r in got if (r.cluster_num, r.left, r.right) == (number, left, right)} == want


def test_parameter_search_joins_counts(spark, monkeypatch):
    """Comments are counted before they are clustered: not each comment is joined with its cluster for each number, nor any vector."""
    plans = []
    monkeypatch.setattr(pipeline, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or written(df, name))
    c = spark.createDataFrame([("p", s * S, [float(s // 40 % 2), float(s // 60)]) for s in range(0, 200, 2)], "cid string, us bigint, v array<double>")
    i = spark.createDataFrame([("p", 3 * S, 43 * S, "a"), ("p", 55 * S, 90 * S, "b")], "cid string, start bigint, end bigint, label string")
    assert pipeline.parameter_search(c, i, "cid", "us", "v", [2, 3], [0.3], [0.2], pipeline.Settings(10 * S, trim=False)).count() == 2
    clusters = [p for name, p in plans if name == "clusters"]
    by = [x for p in clusters for x in re.findall("Join Inner, (.*)", p)]
    assert clusters and by and not any("__v#" in x for x in by)
    assert all(re.search(r"Join Inner.*\n *:-.*Aggregate", p) for p in clusters)


def test_topics_without_driver(spark, monkeypatch):
    """Where words are many, topics are fitted without MLlib's model, which the driver holds; they part what differs as that does."""
    rng = np.random.default_rng(3)
    rows = [("p" if d % 2 else "q", d, f"{'ab'[d % 2]}{w}", float(n)) for d in range(400) for w, n in zip(range(20), rng.integers(0, 4, 20), strict=True) if n]
    c = spark.createDataFrame(rows, "cid string, window_index bigint, topic string, n double")
    model = topics.fit_topics(c, ["cid", "window_index"], "topic", "n", topics=2, iterations=40)
    got = {(r.window_index, r.topic): r.weight for r in model.weights(c, ["cid", "window_index"], "topic", "n").collect()}
    main = [max((0, 1), key=lambda t: got.get((d, t), 0)) for d in range(400)]
    assert len(set(main[::2])) == len(set(main[1::2])) == 1 and main[0] != main[1]
    assert all(abs(sum(got.get((d, t), 0) for t in (0, 1)) - 1) < 0.02 for d in range(400))
    # digamma(1), trigamma(1)
    assert abs(topics.digamma(np.ones(1))[0] + 0.5772156649) < 1e-9 and abs(topics.trigamma(np.ones(1))[0] - math.pi**2 / 6) < 1e-8
    monkeypatch.setattr(topics, "WHOLE", 10)
    monkeypatch.setattr(pipeline, "fit_lda", lambda *a, **k: pytest.fail("a model that the driver holds"))
    own = spark.createDataFrame([("p", "x", {"b1": 3.0, "b2": 1.0}), ("q", "y", None)], "cid string, label string, n map<string,double>")
    weighed, own, _ = pipeline.Method("lda", 2).apply(c, own, "cid")
    assert weighed.columns == ["cid", "window_index", "topic", "n"] and weighed.select("window_index").distinct().count() == 400
    found = {r.cid: r.n for r in own.collect()}
    assert found["q"] is None and abs(sum(found["p"].values()) - 1) < 0.02


def test_no_broadcast_of_windows(spark):
    """Tables read again are small as files, so that they would be broadcast: the runs over words merge them instead."""
    c = spark.createDataFrame([(v, s * S, "xyx"[s // 30 % 3]) for v in "pq" for s in range(0, 120, 2)], "cid string, us bigint, topic string")
    i = spark.createDataFrame([(v, a * S, b * S, t) for v in "pq" for a, b, t in ((0, 28, "x"), (31, 58, "y"))], "cid string, start bigint, end bigint, label string")
    counts, _, _ = pipeline.Method("wordbase").apply(pipeline.window_counts(c, "cid", "us", "topic", 10 * S), i, "cid")
    best = rating.highlights(written(rating.rate_windows(counts, ["cid", "window_index"], "n", F.col("__words")), "rated"), "cid", 0.3, 0.2)
    for df in (counts, best):
        joined = re.findall(r"(?:SortMerge|BroadcastHash)Join [^\n]*", df._jdf.queryExecution().executedPlan().toString())
        assert any("SortMerge" in x for x in joined)
        # only the keys over hot_rows are broadcast
        assert all("__hot" in x for x in joined if "BroadcastHash" in x)
    assert best.count() > 0


def test_empty_windows(spark):
    c = comments_at(spark, 1, 35)
    w = windows.tumbling(c, "cid", "us", 10 * S).orderBy("window_index")
    assert [r.comments for r in w.collect()] == [1, 0, 0, 1]
    assert windows.tumbling(c.limit(0), "cid", "us", 10 * S).collect() == []
    rated = spark.createDataFrame([("v", 0, 1.0), ("v", 1, None), ("v", 2, 9.0)], "cid string, window_index int, rating double")
    assert [r.window_index for r in rating.highlights(rated, "cid").collect()] == [2]


def test_sliding(spark):
    got = windows.sliding(comments_at(spark, 0, 4, 5, 12), "cid", "us", 10 * S, 5 * S).orderBy("window_index").collect()
    assert [(r.window_index, r.comments) for r in got] == [(0, 3), (1, 2), (2, 1)]


@pytest.mark.parametrize(("n", "kept"), [(180, 180), (181, 169)])
def test_trim(spark, n, kept):
    w = spark.range(n).select(F.lit("v").alias("cid"), F.col("id").alias("window_index"))
    assert windows.trim_edges(w, "cid").count() == kept


@pytest.mark.parametrize(("f", "want"), [([4, 0], 4.0), ([2, 2], 0.0), ([1, 3], 1 / (1 + 0.5623351446188083)), ([0, 0], 0.0)])
def test_rating(spark, f, want):
    counts = spark.createDataFrame([("v", i, x) for i, x in enumerate(f)], "cid string, topic int, n int")
    assert math.isclose(rating.rate_windows(counts, ["cid"], "n", F.lit(len(f))).collect()[0].rating, want, abs_tol=1e-9)


def test_rating_by_loop(spark):
    rng = np.random.default_rng(0)
    f = rng.integers(0, 9, (50, 6))
    counts = spark.createDataFrame([(int(w), int(t), int(x)) for w, row in enumerate(f) for t, x in enumerate(row) if x], "w int, topic int, n int")
    got = {r.w: r.rating for r in rating.rate_windows(counts, ["w"], "n", F.lit(6)).collect()}
    for w, row in enumerate(f):
        p = row[row > 0] / row.sum()
        assert math.isclose(got[w], row.var() / (1 - (p * np.log(p)).sum()), rel_tol=1e-9)


def test_clips(spark):
    w = spark.createDataFrame([("v", i, i * 10, i * 10 + 10, x) for i, x in [(1, "a"), (2, "a"), (3, "b"), (5, "b"), (6, "b")]], "cid string, i int, start int, end int, label string")
    assert sorted(tuple(r) for r in clips.merge_clips(w, "cid", "i", "start", "end", "label").collect()) == [("v", 10, 30, "a"), ("v", 30, 40, "b"), ("v", 50, 70, "b")]


@pytest.mark.parametrize("width", [1, 4, 100])
def test_overlap(spark, width):
    schema = "cid string, start bigint, end bigint, label string"
    p = spark.createDataFrame([("v", 0, 10, "a")], schema)
    b = spark.createDataFrame([("v", 10, 20, "a"), ("v", 5, 8, "a"), ("w", 0, 10, "a")], schema)
    met = clips.overlaps(p, b, "cid", bin_width=width)
    assert sorted((r.start, r.end) for r in met.collect()) == [(5, 8), (10, 10)]
    m = {r.cid: r for r in clips.precision_recall(met, p, b, "cid").collect()}
    assert (m["v"].time_p, m["v"].time_r, m["v"].label_p, m["v"].label_r) == (0.3, 3 / 13, 2.0, 1.0)
    assert m["w"].time_f1 == 0


def test_refresh(spark):
    f = spark.createDataFrame([(i, f"c{i}", None) for i in range(6)], "pos int, content string, sender string")
    tail = lambda *c: spark.createDataFrame([(i, x, None) for i, x in enumerate(c)], "pos int, content string, sender string")
    go = lambda s: sorted(r.pos for r in comments.refresh(f, s, "pos", ["content", "sender"]).collect())
    assert go(tail("x", "c2")) == [3, 4, 5]
    assert go(tail("c5")) == []
    assert go(tail("y")) == [0, 1, 2, 3, 4, 5]
    assert go(tail("c4", *"abcde")) == [0, 1, 2, 3, 4, 5]


def test_admission(spark):
    rows = lambda cid, last: [(cid, 0.0)] * 99 + [(cid, last)]
    df = spark.createDataFrame(rows("a", 1000.0) + rows("b", 1000.1) + rows("c", 1.0)[1:], "cid string, play double")
    assert [r.cid for r in comments.admitted(df, "cid", "play").collect()] == ["a"]


def test_sort_by_number(spark):
    df = spark.createDataFrame([("10.0", 0), ("9.5", 1), ("9.50", 2), ("x", 3)], "play string, pos int")
    assert [r.pos for r in comments.sort_comments(df, "play", "pos").collect()] == [3, 1, 2, 0]
    assert [r.pos for r in comments.sort_comments(df, "play", "pos", descending=True).collect()] == [0, 1, 2, 3]


def token_rows(spark, *words):
    return spark.createDataFrame([(1, i, w, f) for i, (w, f) in enumerate(words)], "id int, pos int, word string, flag string")


def test_rewrite_and_runs(spark):
    t = token_rows(spark, ("886", "m"), ("x88", "eng"), ("hello", "eng"), ("awww", "eng"))
    rules = [tokens.Rule("88", "A", "n"), tokens.Rule("886", "B", "n"), tokens.Rule("h+", "laugh", "n")]
    assert [r.word for r in tokens.rewrite(t, rules).orderBy("pos").collect()] == ["A", "x88", "laugh", "awww"]
    assert tokens.rewrite(t, []).count() == 4
    counted = [tokens.Rule("(h)\\1", "twice", "n"), tokens.Rule("h", "once", "n")]
    assert [r.word for r in tokens.rewrite(token_rows(spark, ("hh", "n"), ("ha", "n")), counted).orderBy("pos").collect()] == ["twice", "once"]


def arrays(spark, *lists):
    kind = "array<struct<pos: int, word: string, flag: string>>"
    return spark.createDataFrame([(i, t and [(k, *x) for k, x in enumerate(t)]) for i, t in enumerate(lists)], f"id int, t {kind}")


def test_rules_within_a_text(spark):
    df = arrays(spark, [(":", "x"), (")", "x"), ("a", "n"), ("!", "x")], [("ab", "n"), ("c", "n"), ("def", "n")], [("x", "x")] * 500, [], None)
    runs = [[tuple(t) for t in r.t] if r.t is not None else None for r in df.orderBy("id").select(tokens.with_emoji_runs(F.col("t")).alias("t")).collect()]
    assert runs == [[(0, ":)", "emoji"), (2, "a", "n"), (3, "!", "x")], [(0, "ab", "n"), (1, "c", "n"), (2, "def", "n")], [(0, "x" * 500, "emoji")], [], None]
    places = [r.t and [(t.start_position, t.end_position) for t in r.t] for r in df.orderBy("id").select(tokens.with_offsets(F.col("t")).alias("t")).collect()]
    assert places[1] == [(0, 1), (2, 2), (3, 5)] and places[2] == [(i, i) for i in range(500)] and places[3:] == [[], None]
    assert [tuple(r) for r in tokens.token_rows(df, "id", tokens.with_emoji_runs(F.col("t"))).where("id = 0").collect()][0] == (0, 0, ":)", "emoji")
    kept = tokens.kept_tokens(F.col("t"), [tokens.Rule("b+", "bee", "n")], ["!"])
    rows = arrays(spark, [("BB", "eng"), (" ", "w"), ("12", "m"), ("!", "x")], [("!", "x")])
    assert [[tuple(t) for t in r.t] for r in rows.orderBy("id").select(kept.alias("t")).collect()] == [[(0, "bee", "n")], []]
    texts = spark.createDataFrame([("BB 12!",), ("12!",), (" ! !x",), ("",), (None,)], "t string")
    assert [r.k for r in texts.select(tokens.has_kept(F.col("t"), [tokens.Rule("b+", "bee", "n")], ["!"]).alias("k")).collect()] == [True, False, True, False, False]


def test_running_sums(spark):
    lists = [[(i * 7) % 5 for i in range(n)] for n in (0, 1, 127, 128, 129, 3000)] + [None]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(lists)], "i int, a array<int>").orderBy("i").select(running_sum(F.col("a")).alias("s")).collect()
    assert [r.s for r in got] == [None if a is None else list(accumulate(a)) for a in lists]


def test_emoji_words(spark):
    table = {"^_^": "smile", "^": "up", "T": "cry", "": "nothing"}
    cases = {("^_^", "emoji"): [("smile", "emoji")], ("T", "eng"): [("cry", "emoji")], ("^_^^xx", "x"): [("smile", "emoji"), ("up", "emoji")], ("ab^_^T", "x"): [("smile", "emoji"), ("cry", "emoji")],
             ("ab^^_^", "x"): [("up", "emoji"), ("smile", "emoji")], ("??", "emoji"): [], ("word", "n"): [("word", "n")]}
    got = tokens.substitute_emojis(token_rows(spark, *cases), table).orderBy("pos", "sub").collect()
    assert [(r.pos, r.word, r.flag, r.sub) for r in got] == [(i, *x, k) for i, c in enumerate(cases.values()) for k, x in enumerate(c)]
    assert [r.word for r in tokens.substitute_emojis(token_rows(spark, ("a", "n"), (":)", "emoji")), {}).collect()] == ["a"]


def test_segmenter(spark):
    segment = tokens.segmenter([("北京", 10, "ns"), ("北京大学", 5, "nt"), ("大学", 8, "n"), ("学生", 9, "n")])
    df = spark.createDataFrame([("北京大学生hello12!",), (None,), ("",)], "t string")
    got = [r.s and [(x.word, x.flag) for x in r.s] for r in df.select(segment(df.t).alias("s")).collect()]
    assert got == [[("北京", "ns"), ("大", "x"), ("学生", "n"), ("hello", "eng"), ("12", "m"), ("!", "x")], None, []] or got[0][0] == ("北京大学", "nt")
    assert "".join(w for w, _ in tokens.cut("北" * 5000, {}, 1)) == "北" * 5000


def test_pair_indices(spark):
    df = spark.createDataFrame([(0, "p"), (0, "p"), (1, "p")], "c int, l string")
    r = cluster.pair_indices(df, "c", "l").collect()[0]
    assert (r.ss, r.sd, r.ds, r.dd) == (1, 0, 2, 0)
    assert math.isclose(r.jaccard, 1 / 3) and math.isclose(r.fmi, math.sqrt(1 / 3)) and math.isclose(r.rand, 1 / 3)


def test_zscores_and_distance(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0])], "id int, v array<double>")
    z = {(r.id, r.pos): r.z for r in features.zscore_columns(df, "id", "v").collect()}
    assert math.isclose(z[3, 0], (4 - 7 / 3) / 1.247219128924647) and z[1, 1] == 0
    row = spark.createDataFrame([([1.0, 2.0, 4.0],)], "v array<double>").select(features.zscore_row(F.col("v")).alias("z"), features.euclidean(F.col("v"), F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0))).alias("d")).collect()[0]
    assert math.isclose(row.z[0], (1 - 7 / 3) / 1.247219128924647) and row.d == 4.0


def test_tfidf(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "doc string, word string")
    assert [(r.doc, r.word, r.weight) for r in features.tfidf(df, "doc", "word").collect()] == [("a", "y", 1.0)]


def dbscan_loop(points, eps, least):
    n = len(points)
    near = [[j for j in range(n) if math.dist(points[i], points[j]) <= eps] for i in range(n)]
    out, k = [None] * n, 0
    for i in range(n):
        if out[i] is not None or len(near[i]) < least:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if out[x] is None:
                out[x] = k
                if len(near[x]) >= least:
                    todo += near[x]
        k += 1
    return [-1 if x is None else x for x in out]


@pytest.mark.parametrize("seed", range(2))
def test_dbscan(spark, seed):
    rng = random.Random(seed)
    points = [[rng.uniform(0, 6), rng.uniform(0, 6)] for _ in range(120)] + [[50.0, 50.0], [51.0, 50.0]]
    df = spark.createDataFrame(list(enumerate(points)), "id int, v array<double>")
    got = {r.id: r.cluster for r in cluster.dbscan(df, "id", "v", 0.7, 4).collect()}
    assert [got[i] for i in range(len(points))] == dbscan_loop(points, 0.7, 4)


def test_dbscan_of_dense_and_empty_tables(spark):
    rng = random.Random(3)
    points = [[rng.uniform(0, 1), rng.uniform(0, 9), 0.0] for _ in range(300)] + [[0.5, 4.0, 0.0]] * 40 + [None]
    df = spark.createDataFrame([(i + 5, p) for i, p in enumerate(points)], "vec int, v array<double>")
    got = {r.vec: r.cluster for r in cluster.dbscan(df, "vec", "v", 0.4, 7, block=32, dimensions=2).collect()}
    assert [got[i + 5] for i in range(340)] == dbscan_loop(points[:340], 0.4, 7) and len(got) == 340
    assert cluster.dbscan(df.limit(0), "vec", "v", 0.4, 7).collect() == []
    two = spark.createDataFrame([(1, [0.0]), (2, [0.5]), (3, [9.0])], "id int, v array<double>")
    assert sorted((r.cluster, r.members, r.id) for r in cluster.members(cluster.dbscan(two, "id", "v", 0.5, 2), "id").collect()) == [(-1, 1, 3), (0, 2, 1), (0, 2, 2)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.id: r.c for r in cluster.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = cluster.nearest(df.where("id % 10 = 0"), df, "id", "v", 3, within=1.0, query_block=2, row_block=16).collect()
    for q in range(0, 60, 10):
        d = [(math.dist(x[q], x[j]), j) for j in range(60) if j != q]
        own = sorted((r.rank, r.b, r.near) for r in got if r.a == q)
        assert own == [(k + 1, j, sum(a < 1 for a, _ in d) if k == 0 else 0) for k, (_, j) in enumerate(sorted(d)[:3])]


def test_eps_fit(spark):
    fit = lambda x: cluster.fitted_eps(spark.createDataFrame([(float(a),) for a in x], "d double"), "d")
    assert fit([1.0] * 3) == 1.0
    rng = np.random.default_rng(1)
    for x in ([i / 10 for i in range(100)] + [20, 40, 80], rng.gamma(2, 1, 200)):
        x = sorted(x)
        a, b, c, _, _ = np.polyfit(np.arange(len(x)), x, 4)
        at = int((-6 * b + np.sqrt(36 * b * b - 96 * a * c)) / (24 * a))
        assert fit(x) == x[min(max(at, 0), len(x) - 1)]


def test_svm(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i % 2}", i, (rng.normal(0, 0.4, 3) + (i % 3) * np.array([2, -2, 1])).tolist(), "abc"[i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "cid string, i int, v array<double>, label string")
    windows_ = df.unionByName(spark.createDataFrame([("c0", 900, None, None), ("none", 901, [0.0, 0.0, 0.0], None)], df.schema))
    for rest in (False, True):
        got = classify.svm_predict(df.where("i < 90"), windows_, "cid", "v", "label", one_vs_rest=rest).collect()
        held = [r for r in got if 90 <= r.i < 900]
        assert len(held) == 60 and sum(r.predict_label == r.label for r in held) >= 57
        assert all(r.predict_label is None for r in got if r.i >= 900) and len(got) == 152


def test_solver():
    """Two points apart by d: both multipliers are 1 / (1 - exp(-gamma d^2)), up to c, and the threshold is in the middle. Four in a cross: equal multipliers by symmetry."""
    for d in (0.5, 2.0):
        k = np.array([[1, np.exp(-d * d)], [np.exp(-d * d), 1]])
        w, b = classify.fit_binary(k, np.array([1.0, -1.0]), 100.0, tolerance=1e-9)
        assert np.allclose(w, [1 / (1 - k[0, 1]), -1 / (1 - k[0, 1])]) and abs(b) < 1e-9
        assert np.allclose(classify.fit_binary(k, np.array([1.0, -1.0]), 0.25)[0], [0.25, -0.25])
    x = classify.Points.of([[0, 0], [1, 1], [0, 1], [1, 0]])
    k = classify.kernel(x, x, 1.0)
    w, b = classify.fit_binary(k, np.array([1.0, 1, -1, -1]), 1e6, tolerance=1e-10)
    assert np.allclose(np.abs(w), 1 / (1 + np.exp(-2) - 2 * np.exp(-1))) and abs(b) < 1e-6


def test_svm_of_maps(spark):
    """Maps give what the same vectors as arrays give, for one video and for many at once."""
    rng = np.random.default_rng(6)
    rows = [(f"c{i % 2}", i, [float(x) for x in rng.integers(0, 4, 5) * (rng.random(5) < 0.6) + (i % 3 == np.arange(5)) * 3], "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "cid string, i int, v array<double>, label string")
    maps = df.withColumn("v", F.map_filter(F.map_from_arrays(F.array(*map(F.lit, "pqrst")), "v"), lambda k, x: x > 0))
    by = lambda d: {r.i: r.predict_label for r in d.collect()}
    assert by(classify.svm_predict(df.where("i < 60"), df, "cid", "v", "label")) == by(classify.svm_predict(maps.where("i < 60"), maps, "cid", "v", "label", dimension=5))
    pooled = by(classify.svm_predict_pooled(df.where("i < 60"), df, "v", "label"))
    assert pooled == by(classify.svm_predict_pooled(maps.where("i < 60"), maps, "v", "label", dimension=5))
    assert sum(pooled[i] == "abc"[i % 3] for i in range(60, 90)) >= 24
    assert set(by(classify.svm_predict_pooled(df.limit(0), df, "v", "label")).values()) == {None}
    with pytest.raises(ValueError, match="more than 5"):
        classify.svm_predict_pooled(df, df, "v", "label", most=5)


def test_svm_of_many(spark, monkeypatch):
    """Machines fitted in tasks give the labels of those that have the whole kernel matrix; over 20,000 rows are no error."""
    rng = np.random.default_rng(7)
    x = rng.dirichlet([0.3] * 4, 1500)
    y = np.where(x[:, 0] + rng.normal(0, 0.2, 1500) > 0.3, 1.0, -1.0)
    p = classify.Points.of(x)
    w, b = classify.fit_binary(classify.kernel(p, p, 2.0), y, 1.0)
    own, v, a = classify.fit_many(p, y, 1.0, 2.0, block=400, kept=0)
    score, many = classify.kernel(p, p, 2.0) @ w + b, classify.kernel(p, p.some(own), 2.0) @ v + a
    assert np.abs(score - many).max() < 0.05 and len(own) < 1500
    df = spark.createDataFrame([(i, [float(z) for z in r], "abc"[int(r.argmax() % 3)]) for i, r in enumerate(x)], "i int, v array<double>, label string")
    maps = df.withColumn("v", F.map_from_arrays(F.array(*map(F.lit, "pqrs")), "v"))
    by = lambda d: {r.i: r.predict_label for r in d.collect()}
    for more in ({}, {"one_vs_rest": True}):
        whole = by(classify.svm_predict_pooled(df, df, "v", "label", **more))
        with monkeypatch.context() as few:
            few.setattr(classify, "WHOLE", 100)
            for rows in (df, maps):
                got = by(classify.svm_predict_pooled(rows, rows, "v", "label", **more))
                assert sum(got[i] != whole[i] for i in whole) <= 5
    centres = df.where("i < 3").select(F.lit(0.0).alias("z"), F.col("i").cast("double").alias("at"), F.element_at(F.array(*map(F.lit, "abc")), F.col("i") + 1).alias("label"))
    crowd = centres.crossJoin(spark.range(7000)).select(F.array("at", (F.col("id") % 7) / 100).alias("v"), "label")
    got = classify.svm_predict_pooled(crowd, crowd.distinct(), "v", "label").collect()
    assert len(got) == 21 and all(r.predict_label == r.label for r in got)


def test_held_out_videos(spark):
    at = [(v, s, "xyx"[s // 30 % 3]) for v in ("p", "q", "r") for s in range(0, 120, 2)]
    c = spark.createDataFrame([(v, s * S, t) for v, s, t in at], "cid string, us bigint, topic string")
    i = spark.createDataFrame([(v, a * S, b * S, t) for v in ("p", "q", "r") for a, b, t in ((0, 28, "x"), (31, 58, "y"))], "cid string, start bigint, end bigint, label string")
    for method in (pipeline.Method("f", 2), pipeline.Method("wordbase"), pipeline.Method("lda", 2)):
        found, measures = pipeline.train_and_evaluate(c, c, i, "cid", "us", "topic", method, pipeline.Settings(10 * S, 0.0, 0.0, False), held_out=F.col("cid") == "r")
        assert {r.cid for r in found.collect()} <= {"r"} and [r.cid for r in measures.collect()] == ["r"]
    with pytest.raises(ValueError, match="no method"):
        pipeline.Method("g")


def test_times_as_text(spark):
    df = spark.createDataFrame([(125, "/x/y/935527_train.txt"), (4503, "9.txt.gz")], "s int, p string")
    got = df.select(play_time_text(F.col("s")), clock_text(F.col("s")), cid_of_path(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("2 minutes 5 seconds", "2:5", "935527_train"), ("75 minutes 3 seconds", "75:3", "9")]
