import numpy as np
import pytest

from hilite.llm.mixing import Target, draw_mixture, reached_shares
from hilite.llm.packing import difference, fill_containers, pack
from hilite.llm.splitting import Limit, split_items
from hilite.llm.tokens import VOCABULARY, boundary_classes, content_of, encoding, token_count

TEXTS = [
    (1, "第一句。第二句！\n\n新的一段，" + "很长的句子，没有句号" * 60 + "。"),
    (2, "Mr. A. Smith came, e.g. today. Then he left. " * 80),
    (3, "無" * 5000),
    (4, "a" * 9000 + " " + "😂" * 300),
    (5, ""),
    (6, None),
    (7, "short"),
    (8, "- 一\n- 二\n\n| a | b |\n|---|---|\n" * 50),
    (9, "he said \"stop.\" and 'left'   \n \t\r\n  " * 100),
]


def count(text):
    return len(encoding(content_of(VOCABULARY))[0].encode_ordinary(text))


@pytest.mark.parametrize("limit", [Limit(64, 16), Limit(100), Limit(8, 3)])
def test_pieces(spark, limit):
    df = spark.createDataFrame(TEXTS, "id int, text string").withColumnsRenamed({"text": "body"}).selectExpr("id", "body", "1 as piece", "2 as map")
    rows = split_items(df, "id", "body", [limit, Limit(100_000)]).orderBy("max_tokens", "piece").collect()
    for i, text in TEXTS:
        own = [r for r in rows if r.id == i and r.max_tokens == limit.tokens]
        whole = [r for r in rows if r.id == i and r.max_tokens == 100_000]
        assert [r.text for r in whole] == ([text] if text else [])
        if not text:
            assert own == []
            continue
        assert [r.piece for r in own] == [*range(1, len(own) + 1)]
        joined, end = "", 0
        for r in own:
            assert r.tokens <= limit.tokens and count(r.text) <= limit.tokens
            overlap = end - r.start_token
            assert (r.piece == 1 and overlap == 0) or limit.overlap - 3 <= overlap <= limit.overlap
            tail = next(k for k in range(len(r.text) + 1) if overlap == 0 or joined.endswith(r.text[:k]) and count(joined[: len(joined) - k]) <= r.start_token) if overlap else 0
            joined += r.text[tail:]
            end = r.start_token + r.tokens
        assert joined == text and end == count(text)


def test_boundaries_are_natural(spark):
    text = "第一句话在这里结束。第二句话，也在这里结束。" * 20
    df = spark.createDataFrame([(1, text)], "id int, text string")
    for r in split_items(df, "id", "text", [Limit(64)]).collect():
        assert r.text.endswith("。")


def classes(text):
    e, size = encoding(content_of(VOCABULARY))
    ends = np.cumsum(size[e.encode_ordinary(text)])
    return dict(zip(ends.tolist(), boundary_classes(text.encode(), ends).tobytes().decode(), strict=True))


def test_boundary_classes():
    c = classes("He left. Then, e.g. this\n\nnext")
    assert c[8] == "s" and c[len("He left. Then, ")-1] == "c"
    assert "s" not in [c.get(k) for k in range(15, 20)]
    assert c[len("He left. Then, e.g. this\n\n")] == "p"


def test_differencing():
    window, sums = difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(window, weights=[8, 7, 6, 5, 4]).tolist()) == sorted(sums.tolist()) == [14, 16]


@pytest.mark.parametrize("seed", range(6))
def test_packing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 101, rng.integers(0, 400))
    window = pack(sizes, 100)
    assert len(window) == len(sizes)
    if len(sizes):
        assert np.bincount(window, weights=sizes).max() <= 100
        assert len(set(window.tolist())) <= -(-sizes.sum() // 90) + (sizes == 0).sum() + 2


def test_ties_and_empty_items():
    assert sorted(pack(np.array([5, 5, 5, 5]), 10).tolist()) == [0, 0, 1, 1]
    assert set(pack(np.zeros(50, np.int64), 10).tolist()) <= {0}
    assert pack(np.array([10, 10]), 10).tolist() in ([0, 1], [1, 0])


def test_containers(spark):
    rows = [(i, s) for i, s in enumerate([0, 3, 10, 25, 7, 7, 3, 10, 1, 0])] + [(None, 4), (99, None)]
    placed = fill_containers(spark.createDataFrame(rows, "part int, tokens int"), "part", "tokens", [10, 20], windows=2).collect
    rows_out = fill_containers(spark.createDataFrame([(f"d{i}" if i is not None else None, s) for i, s in rows], "doc string, size int"), "doc", "size", [10, 20], windows=2).collect()
    del placed
    for capacity in (10, 20):
        own = [r for r in rows_out if r.capacity == capacity]
        by = {}
        for r in own:
            by[r.container] = by.get(r.container, 0) + r.tokens
        assert max(by.values()) <= capacity
        for i, s in rows:
            if i is None or s is None:
                continue
            parts = sorted((r.start, r.tokens) for r in own if r.doc == f"d{i}")
            assert sum(t for _, t in parts) == s and len(parts) == max(1, -(-s // capacity))
            assert [a for a, _ in parts] == [k * capacity for k in range(len(parts))]
    empty = spark.createDataFrame([], "doc string, size int")
    assert fill_containers(empty, "doc", "size", [10]).collect() == []


def test_token_count(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    got = {r.id: r.n for r in df.select("id", token_count(spark, df.text).alias("n")).collect()}
    assert got == {i: count(t or "") for i, t in TEXTS}


def test_mixture(spark):
    rng = np.random.default_rng(0)
    rows = [(i, ["a", "b", "c", "d", None][min(4, int(rng.exponential(1.0)))], int(rng.integers(0, 400))) for i in range(6000)]
    targets = [Target("a", 0.3, 1), Target("b", 0.5, 3), Target("c", 0.2, 9), Target("missing", 0.1, 2)]
    df = spark.createDataFrame(rows, "copies int, source string, size int").withColumnRenamed("copies", "id")
    mixture = draw_mixture(df, "id", "source", "size", targets, cell=300)
    shares = {r.source: r for r in reached_shares(mixture, "source", "size", targets).collect()}
    for t in targets[:3]:
        assert abs(shares[t.source].share - t.weight) < 0.01
        assert shares[t.source].most_copies <= t.repeats
    assert shares["missing"].share == 0
    got = mixture.collect()
    copies = {}
    for r in got:
        copies[r.id] = copies.get(r.id, 0) + 1
    for s in "abc":
        counts = [copies.get(i, 0) for i, x, _ in rows if x == s]
        assert max(counts) - min(counts) <= 1
    assert {r.source for r in got} == {"a", "b", "c"}
    assert sorted(got) == sorted(draw_mixture(df, "id", "source", "size", targets, cell=300).collect())
    limited = reached_shares(draw_mixture(df, "id", "source", "size", targets, total=10.0**9), "source", "size", targets).collect()
    assert all(r.most_copies <= {t.source: t.repeats for t in targets}[r.source] for r in limited)
    assert draw_mixture(df.limit(0), "id", "source", "size", targets).collect() == []
