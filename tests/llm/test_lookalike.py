import itertools
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm.lookalike import CYRILLIC, GREEK, INVISIBLE, SPACES, classes, confusables, form, forms, lookalike_pairs, suspects
from latticework.llm.lookalike import skeleton as skeleton_of


def skeleton(text):
    """The plain statement: what a text looks like, with every look-alike as Latin."""
    out = []
    for ch in text:
        c = ord(ch)
        if any(lo <= c <= hi for lo, hi in INVISIBLE):
            continue
        out.append(" " if any(lo <= c <= hi for lo, hi in SPACES) else chr(c - 0xFEE0) if 0xFF01 <= c <= 0xFF5E else ch)
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFC", "".join(out)))
    return unicodedata.normalize("NFC", "".join(CYRILLIC.get(ch) or GREEK.get(ch) or ch for ch in text))


LETTERS = st.text(alphabet="aeoвлοπc лоѐéе́̀̈ｏ0O​  \tXХΧ_1²", max_size=8)


@given(LETTERS, LETTERS)
@settings(max_examples=1500, deadline=None)
def test_equal_forms_for_equal_looks(a, b):
    assert (form(a) == form(b)) == (skeleton(a) == skeleton(b))


def test_every_pair_of_short_texts():
    texts = ["".join(x) for x in itertools.product("cсloо́л", repeat=3)]
    by = {}
    for t in texts:
        by.setdefault(form(t), set()).add(skeleton(t))
    assert all(len(s) == 1 for s in by.values()) and len(by) == len({skeleton(t) for t in texts})


@pytest.mark.parametrize("text,want", [
    ("раypal", "paypal"), ("ѕсоре", "scope"), ("cловo", "слово"), ("κοινo", "κοινο"), ("лz", "лz"), ("лw", "лԝ"), ("е́te", "éte"), ("ａ＋ｂ ​c", "a+b c"),
    ("x²", "x²"), ("plain", "plain"), ("\t\r\n", "\t\r\n"), ("", ""), ("мoре x cop", "море x cop"), ("が", "が"),
])
def test_forms(text, want):
    assert form(text) == want
    assert form(want) == want


def test_long_words_are_fast():
    assert form("a" * 300_000 + " é " + "b" * 300_000).startswith("aaa")
    assert form("о" * 300_000) == "o" * 300_000


ROWS = [(1, "scope"), (2, "ѕсоре"), (3, "scope"), (4, "ｓcope"), (5, "Scope"), (6, None), (7, ""), (8, "​"), (9, "⁠"), (10, "x")]


def test_pairs_and_classes(spark):
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in ROWS], "doc_id long, text string, c1 int, r1 int")
    got = sorted(map(tuple, lookalike_pairs(df, "doc_id", "text").collect()))
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (8, 9)]
    assert sorted(map(tuple, classes(df, "doc_id", "text").collect())) == [(1, 4, 3), (5, 1, 1), (8, 2, 2), (10, 1, 1)]
    assert {r.doc_id: r.form for r in forms(df, "doc_id", "text").collect()} == {1: "scope", 2: "scope", 3: "scope", 4: "scope", 5: "Scope", 6: None, 7: "", 8: "", 9: "", 10: "x"}
    assert lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0


# Written by name, apart from the module's tables.
NAMED = {
    "CYRILLIC": {"A": "A", "VE": "B", "IE": "E", "DZE": "S", "BYELORUSSIAN-UKRAINIAN I": "I", "JE": "J", "KA": "K", "EM": "M", "EN": "H", "O": "O", "ER": "P", "ES": "C", "TE": "T", "U": "Y", "HA": "X", "QA": "Q", "WE": "W", "STRAIGHT U": "Y", "KOMI SJE": "G", "IZHITSA": "V"},
    "GREEK": {"ALPHA": "A", "BETA": "B", "EPSILON": "E", "ZETA": "Z", "ETA": "H", "IOTA": "I", "KAPPA": "K", "MU": "M", "NU": "N", "OMICRON": "O", "RHO": "P", "TAU": "T", "UPSILON": "Y", "CHI": "X", "YOT": "J"},
}


@pytest.mark.parametrize("script", NAMED)
def test_capitals_by_name(script):
    for name, latin in NAMED[script].items():
        ch = unicodedata.lookup(f"{script} CAPITAL LETTER {name}")
        assert form(ch) == latin and form(f"z{ch}z") == f"z{latin}z"
    assert form("Ӏ") == "I" and form("Ϲ") == "C"


@pytest.mark.parametrize("capital,small", ["Ѕѕ", "Іі", "Јј", "Оо", "Рр", "Сс", "Ее", "Хх", "Ԛԛ", "Ԝԝ", "Ѵѵ", "Ϲϲ", "Ϳϳ", "Οο", "Аа"])
def test_capitals_and_small_letters_alike(capital, small):
    assert form(capital).isascii() and form(small) == form(capital).lower()


def test_confusables(spark):
    assert confusables("paypal раураl слово сор сop лz") == (3, 1)
    assert confusables("plain") == confusables("") == (0, 0)
    assert confusables("é ñ ΑΒΕ λόγος") == (0, 1)
    rows = spark.createDataFrame([(1, "plain", 0), (2, "сop", 0), (3, None, 0), (4, "слово", 0), (5, "", 0)], "doc_id long, text string, n_mixed int")
    assert [tuple(r) for r in suspects(rows, "doc_id", "text").collect()] == [(2, 1, 0)]
    assert suspects(rows.limit(0), "doc_id", "text").count() == 0


@given(LETTERS)
@settings(max_examples=300, deadline=None)
def test_skeletons_of_forms(text):
    assert skeleton_of(form(text)) == skeleton(text)
