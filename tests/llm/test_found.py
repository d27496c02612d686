import math
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hilite.llm.abuse import THRESHOLD, content_scores, group_names, rates, score_array, with_scores
from hilite.llm.canonical import same_looks
from hilite.llm.runs import collapse_runs, near_array
from hilite.llm.terms import most_marking, term_scores, terms_of


def test_terms(spark):
    df = spark.createDataFrame([("Ｈello 世界ABC カタカナー混ぜる, 12 Éa", ), ("",), (None,), ("!!",)], "t string")
    assert [r[0] for r in df.select(terms_of(df.t)).collect()] == [["hello", "世界", "abc", "カタカナー", "混", "ぜる", "12", "éa"], [], None, []]


@pytest.mark.parametrize("hot", [1_000_000, 2])
def test_scores(spark, hot):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"r{int(rng.integers(0, 6))}", [words[int(x)] for x in rng.integers(0, 30, rng.integers(0, 5))]) for _ in range(200)] + [("r0", None), (None, ["w1"]), ("r1", [])]
    df = spark.createDataFrame(rows, "texts string, terms array<string>").withColumnRenamed("texts", "rec")
    got = {(r.rec, r.term): r for r in term_scores(df, "rec", "terms", hot_rows=hot).collect()}
    texts, hits, where = {}, {}, {}
    for rec, terms in rows:
        if rec is not None:
            texts[rec] = texts.get(rec, 0) + 1
            for t in set(terms or []):
                hits[rec, t] = hits.get((rec, t), 0) + 1
                where.setdefault(t, set()).add(rec)
    assert got.keys() == hits.keys()
    for (rec, t), r in got.items():
        assert (r.hits, r.texts, r.records) == (hits[rec, t], texts[rec], len(where[t]))
        assert math.isclose(r.score, hits[rec, t] / texts[rec] * math.log((1 + len(texts)) / (1 + len(where[t]))), abs_tol=1e-12)
    best = {r.rec: r.term for r in most_marking(term_scores(df, "rec", "terms"), "rec", least_texts=30).collect()}
    for rec, term in best.items():
        assert texts[rec] >= 30 and term == min((-r.score, t) for (x, t), r in got.items() if x == rec)[1]
    assert term_scores(df.limit(0), "rec", "terms").collect() == []


def test_records_whose_terms_are_everywhere_have_a_term(spark):
    df = spark.createDataFrame([(r, [t]) for r in "pq" for t in "ba"], "rec string, terms array<string>")
    for rows, want in ((df, {"p": "a", "q": "a"}), (df.where("rec = 'p'"), {"p": "a"})):
        assert {r.rec: r.term for r in most_marking(term_scores(rows, "rec", "terms"), "rec", least_texts=2).collect()} == want


def collapsed(text):
    while True:
        out, p = text, 1
        while 2 * p <= len(out):
            out = re.sub(rf"(.{{{p}}})\1+", r"\1", out, flags=re.S)
            p += 1
        if out == text:
            return out
        text = out


def test_near_forms():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab哈c"), int(n))) for n in rng.integers(0, 40, 500)]
    assert near_array(pa.array(texts)).to_pylist() == [collapsed(t) for t in texts]
    assert near_array(pa.array(["好耶！！ 好耶", "Ｋｋｓｋkkk~", None, "", "...", "ab" * 40_000])).to_pylist() == ["好耶", "ksk", None, "", "", "ab"]


def alike(a, b):
    if a == b:
        return True
    if max(len(a), len(b)) < 6 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, l = sorted((a, b), key=len)
    return any(l[:i] + l[i + 1 :] == s for i in range(len(l)))


def test_runs(spark):
    rng = np.random.default_rng(7)
    forms = ["abcdefg", "abcdefx", "abcdef", "short", "shore", "", None]
    rows = [(["p", "q", None][int(rng.integers(0, 3))], ["s", "t"][int(rng.integers(0, 2))], int(rng.integers(0, 60)), i, forms[int(rng.choice(7, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]))]) for i in range(400)]
    df = spark.createDataFrame(rows, "events string, tie string, slice bigint, row bigint, form string").toDF("cid", "who", "slice", "row", "form").repartition(4)
    got = sorted(tuple(r) for r in collapse_runs(df, ["cid", "who"], "slice", "row", "form").collect())
    want = []
    for key in sorted({r[:2] for r in rows if r[0]}):
        seq = sorted(r[2:] for r in rows if r[:2] == key and r[4] is not None)
        cut = [0, *(i + 1 for i, (a, b) in enumerate(pairwise(seq)) if not alike(a[2], b[2])), len(seq)]
        want += [(*key, seq[i][1], seq[j - 1][1], seq[i][0], seq[j - 1][0], j - i, seq[j - 1][0] - seq[i][0]) for i, j in pairwise(cut)]
    assert got == sorted(want)
    assert collapse_runs(df.limit(0), ["cid", "who"], "slice", "row", "form").collect() == []


def test_same_looks(spark):
    left = spark.createDataFrame([(1, "ＯＫ"), (2, "OK"), (3, None), (4, "O​K"), (5, "")], "id int, content string")
    right = spark.createDataFrame([(7, "OK"), (8, None), (9, "OK")], "k int, phrase string")
    assert sorted((r.id, r.k) for r in same_looks(left, "content", right, "phrase").collect()) == [(1, 7), (1, 9), (4, 7), (4, 9)]


def test_clashing_names(spark):
    left = spark.createDataFrame([(1, "ＯＫ", "x")], "id int, content string, phrase string")
    right = spark.createDataFrame([(7, "OK")], "id int, phrase string")
    assert [r.asDict() for r in same_looks(left, "content", right, "phrase").collect()] == [{"id": 1, "content": "ＯＫ", "phrase": "x", "id_phrase": 7, "phrase_phrase": "OK"}]
    scored = with_scores(left.withColumn("score", F.lit("old")).withColumn("abuse", F.lit(9)), "content").collect()[0]
    assert scored.score == 0.0 and scored.abuse == 0.0 and scored.phrase == "x"


def test_kindred_characters(spark):
    left = spark.createDataFrame([(1, "卜口ッコ大作戦"), (2, "トロッコ大作戦"), (3, "トロッコ大昨戦")], "id int, content string")
    assert [(r.id, r.k) for r in same_looks(left, "content", spark.createDataFrame([(7, "トロッコ大作戦")], "k int, phrase string"), "phrase").collect()] == [(1, 7)]
    assert len(set(near_array(left.select("content").limit(2).toArrow()["content"].combine_chunks()).to_pylist())) == 1
    assert left.select(terms_of(left.content)).first()[0] == ["トロッコ", "大作戦"]


LABELLED = "/root/testdata/sf0.01/comment_label.parquet"


def test_labelled_comments(spark):
    """Names of groups come from one half; the other half is held out."""
    rows = spark.read.parquet(LABELLED)
    groups = group_names([(r.content, r.category) for r in rows.where("sample_id % 2 = 0").collect()])
    got = rows.where("sample_id % 2 = 1").withColumn("s", content_scores(rows.content, groups)).collect()
    right = sum((max(r.s) >= THRESHOLD) == (r.category != "none") for r in got)
    assert right / len(got) > 0.98


def test_group_names():
    said = ["Zorblans都该死", "我说Zorblans滚回去", "z0rblans 就是低等", "看见桥西户就想吐", "桥西户都该死！", "把桥西户全赶出去", "橘猫都该死", None, "wipe out every Zorblans"]
    assert group_names([(t, "hate") for t in said] + [("甲乙丙都该死", "none")] * 5) == ("zorbians", "桥西户")
    assert group_names([]) == () == group_names([("", "hate"), ("早", "hate")])
    scores = score_array(pa.array(["Zorblans都该死", "Zorblans的衣服好看"]), ("zorblans",)).to_pylist()
    assert scores[0]["hate"] == 1.0 and max(scores[1].values()) == 0


@pytest.mark.parametrize(
    ("text", "bad"),
    [("kill yourself", True), ("kys", True), ("I'm going to kill you", True), ("操你妈", True), ("rape her", True), ("all immigrants should leave", True), ("faggot", True), ("you are trash", True), ("you absolute clown", True), ("people like you are trash", True),
     ("你就是条狗", True), ("你们这群猪", True), ("外地人滚回去", True), ("女人没一个好东西", True), ("deport all refugees", True), ("muslims are vermin", True),
     ("你出生在哪里", False), ("作者出生于上海", False), ("作者去四川旅游", False), ("你去四楼等我", False), ("楼主白吃白喝", False), ("胸有成竹想摸鱼", False), ("you took the trash out", False), ("he asked you about trash day", False),
     ("你不是白痴", False), ("don't kill yourself", False), ("我想添加你的微信", False), ("女人的衣服好看", False), ("wipe out every boss", False), ("what a waste", False), ("you saw the clown", False), ("他的家族都很厉害", False), ("他不是说你是白痴", False)],
)
def test_general_language(text, bad):
    assert (max(score_array(pa.array(["x", text, "y"])).to_pylist()[1].values()) >= THRESHOLD) == bad


@pytest.mark.parametrize(
    ("text", "label"),
    [("you are an idiot", "abuse"), ("don't call people idiots", None), ("这个垃圾分类的梗", None), ("滚,傻-逼", "abuse"), ("an assassin passes the class", None), ("把灰塔佬杀光", "hate"),
     ("s e n d n u d e s please", "sexual"), ("whoever made this is a c·l·o·w·n·-·b·r·a·i·n", "abuse"), ("别说自己是废物", None), ("你别这样说", None), ("", None), (None, None), ("!" * 1000, None), ("你是" + "真" * 50_000 + "好人", None)],
)
def test_clauses(text, label):
    scores = score_array(pa.array(["x", text, "y"], pa.string())).to_pylist()[1]
    assert (max(scores, key=scores.get) if max(scores.values()) >= THRESHOLD else None) == label


@pytest.mark.parametrize(
    ("text", "bad"),
    [("I will kill you", True), ("i'll k*ll you", True), ("im gonna murder you", True), ("弄死你", True), ("我要打死你", True), ("砍死你", True), ("ぶっ殺す", True), ("殺してやる", True), ("I'm going to slit your throat", True),
     ("this boss will kill you", False), ("i will kill the boss", False), ("kill it with fire", False), ("别说弄死你", False), ("don't say i will kill you", False), ("i will watch you", False),
     ("you are such a worthless idiot", True), ("you really are quite simply a very big idiot", True), ("i saw you then we went home and after some other long days there he met some idiot", False)],
)
def test_threats_and_gaps_in_words(text, bad):
    assert (max(score_array(pa.array(["x", text, "y"])).to_pylist()[1].values()) >= THRESHOLD) == bad


def test_rates(spark):
    df = spark.createDataFrame([("a", "滚，蠢货"), ("a", "好看"), (None, None)], "source string, content string")
    assert {r.source: (r.texts, r.flagged, r.rate) for r in rates(with_scores(df, "content"), "source").collect()} == {"a": (2, 1, 0.5), None: (1, 0, 0.0)}
    assert with_scores(df.limit(0), "content").collect() == []
