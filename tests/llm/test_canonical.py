import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hilite.llm.canonical import canonical_array, in_context, looks_array

ALPHABET = "aeEoOАе̧̣́̈̀がﾊﾞﾟ각각①ｶﾞＡ…ﬁཱིোÅשּׁ가"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(ALPHABET), st.characters(blacklist_categories=("Cs",)))), max_size=12))
def test_without_look_alikes_it_is_nfkc(texts):
    assert canonical_array(pa.array(texts, pa.string()), alike=False).to_pylist() == [unicodedata.normalize("NFKC", x) for x in texts]


def test_long_runs_of_marks():
    text = ["a" + "".join(random.Random(1).choices("̧̣́̈", k=500)), "́x", "", "y"]
    assert canonical_array(pa.array(text), alike=False).to_pylist() == [unicodedata.normalize("NFKC", x) for x in text]


@pytest.mark.parametrize(
    ("text", "form"),
    [("Ｃａｆｅ́", "Café"), ("Саf​е́", "Café"), ("ﾎﾟｹｯﾄ", "ポケット"), ("風　a b\xa0", "風 a b "), ("⽉见⼭", "月见山"), ("e‍́", "é"),
     ("❤️", "❤"), ("👨‍👩", "👨‍👩"), ("a‍b", "ab"), ("a\r\nb", "a\nb"), ("﻿", ""), (None, None), ("", ""), ("Äa", "Äa")],
)
def test_forms(text, form):
    assert canonical_array(pa.array(["x", text, None, "y"], pa.string())).to_pylist() == ["x", form, None, "y"]


def test_slices_and_long_texts():
    texts = ["ａ" * 3_000_000, None, "", "é" * 10] * 2
    want = ["a" * 3_000_000, None, "", "é" * 10] * 2
    assert canonical_array(pa.array(texts)).to_pylist() == want
    assert canonical_array(pa.array(texts).slice(3, 3)).to_pylist() == want[3:6]


@pytest.mark.parametrize(
    ("text", "phrase"),
    [("二ャンコ工房", "ニャンコ工房"), ("ドラム缶口ケッ卜", "ドラム缶ロケット"), ("夕コと力二の休日", "タコとカニの休日"), ("へリオス便り", "ヘリオス便り"), ("卜口ッコ大作戦", "トロッコ大作戦"), ("工コバッグ戦記", "エコバッグ戦記"),
     ("ハ百屋", "八百屋"), ("力口リ一", "カロリー"), ("べーグル", "ベーグル"), ("ﾍﾟン", "ぺン"), ("とりリと", "とりりと")],
)
def test_han_and_kana_that_look_alike(text, phrase):
    forms = looks_array(pa.array([text, None, phrase])).to_pylist()
    assert forms[0] == forms[2] and forms[1] is None
    assert looks_array(pa.array(["ガ", "ポ"])).to_pylist() == ["ガ", "ポ"]


@pytest.mark.parametrize(
    ("text", "read"),
    [("二ャンコ工房", "ニャンコ工房"), ("夕コ", "タコ"), ("卜口ッコ大作戦", "トロッコ大作戦"), ("へリオス便り", "ヘリオス便り"), ("人ロ密度", "人口密度"), ("カロリー爆弾", "カロリー爆弾"), ("人口ケーキ", "人口ケーキ"),
     ("努力の力", "努力の力"), ("友達へメール", "友達へメール"), ("ここヘの", "ここへの"), ("第ー回", "第一回"), ("ab口", "ab口")],
)
def test_read_in_context(text, read):
    assert canonical_array(pa.array(["ロ", text, "ャ", None]), then=in_context).to_pylist() == ["ロ", read, "ャ", None]
