import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenar.llm.lookalikes import canonical, canonical_cluster, canonical_column, look_alike_table, same_reading_classes, same_reading_pairs

PAIRS = [
    ("ｃｏｏｐ １２３！", "coop 123!"), ("асоrԁо", "acordo"), ("a​b‌r⁠i\xadu﻿", "abriu"), ("gravaс̧а̃о", "gravação"), ("pόdcast", "pódcast"),
    ("ⅰⅼⅿⅴⅽⅾ", "ilmvcd"), ("a\xa0b c d　e", "a b c d e"), ("café", "café"), ("ﬁn", "fin"), ("Ｎｏ", "No"), ("ﾅ", "ナ"),
]


def test_pairs_and_kept():
    for given_, want in PAIRS:
        assert canonical(given_) == want, given_
    for text in ("№ 3", "👨‍👩‍👧", "§4, «acta» nº 12", "x² ª", "a  b\n\nc", "…—–“”", "ñ ã ç"):
        assert canonical(text) == text
    assert canonical(None) is None and canonical("") == "" and canonical("​") == ""
    assert len({canonical(x) for x in ("Sao", "São", "SAO", "sao", "Sa0")}) == 5
    assert canonical("👨‍👩") != canonical("👨👩")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", categories=("L", "M", "N", "P", "Z", "Cf", "S")), max_size=30))
def test_a_canonical_form_is_its_own(text):
    once = canonical(text)
    assert canonical(once) == once


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeiounçãéÓ .,12", max_size=40), st.randoms(use_true_random=False))
def test_disguises_are_undone(text, rnd):
    text = unicodedata.normalize("NFC", text)
    wide = lambda c: chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c
    forms = [wide, lambda c: unicodedata.normalize("NFD", c), lambda c: c + "​", lambda c: {"a": "а", "e": "е", "o": "ο", "i": "і", " ": "\xa0"}.get(c, c), lambda c: c]
    assert canonical("".join(rnd.choice(forms)(c) for c in text)) == text


def test_cluster():
    assert canonical_cluster("с̧") == "ç"


def brute(rows):
    latest = {}
    for i, v, lang, text in rows:
        if i is not None and (v, text or "") >= latest.get((i, lang), ((-1, ""), None))[0]:
            latest[(i, lang)] = ((v, text or ""), text)
    out = set()
    for (a, la), (_, x) in latest.items():
        for (b, lb), (_, y) in latest.items():
            if a < b and la == lb and x and y and x.strip() and y.strip() and x != y and canonical(x) == canonical(y):
                out.add((a, b, la))
    return out


def test_pairs_of_posts(spark):
    rows = [
        (1, 1, "s", "sentença"), (2, 1, "s", "sentença"), (3, 1, "s", "ｓentença"), (4, 1, "s", "sentença"), (5, 1, "p", "sentença"), (6, 1, "s", None), (7, 1, "s", ""), (8, 1, "s", "\xa0"),
        (9, 1, "s", "sentenca"), (10, 1, "s", "Sentença"), (11, 1, "s", "x"), (11, 2, "s", "sentenç​a"), (1, 1, "s", "sentença"), (None, 1, "s", "sentença"), (12, 1, "s", "é" * 5000), (13, 1, "s", "é" * 5000),
    ]
    df = spark.createDataFrame(rows, "id bigint, version int, lang string, text string")
    assert {tuple(r) for r in same_reading_pairs(df).collect()} == brute(rows)
    assert same_reading_pairs(df.limit(0)).count() == 0


def test_column(spark):
    df = spark.createDataFrame([(1, "café", None)], "id int, a string, b string")
    assert [tuple(r) for r in canonical_column(df, ["a", "b"]).collect()] == [(1, "café", None, "café", None)]


def test_micro_sign_and_far_invisible_characters():
    assert canonical("5 µm") == canonical("5 µ\u200bm") == canonical("5 μm") == "5 μm"
    assert canonical("a\U000e0100b\U000e0041\U000e01efc") == "abc"
    england, scotland = ("\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in name) + "\U000e007f" for name in ("gbeng", "gbsct"))
    assert canonical(england) == england and canonical(scotland) == scotland


def test_letters_of_the_public_data():
    assert canonical("ıӏѵᎪꓐ℮") == "iivABe" and canonical("ІꓲӀ") == "IlI"
    assert canonical("º ª ß ñ ω ж א ه") == "º ª ß ñ ω ж א ه"
    assert len(look_alike_table()) > 300 and all(canonical(x) == x for x in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def test_classes(spark):
    rows = [(1, 1, "s", "caso"), (2, 1, "s", "caѕo"), (3, 1, "s", "caso"), (4, 1, "s", "otro"), (5, 1, "s", "otro"), (6, 1, "p", "caso")]
    found = same_reading_classes(spark.createDataFrame(rows, "id bigint, version int, lang string, text string")).collect()
    assert sorted(r.id for r in found) == [1, 2, 3] and len({r.reading for r in found}) == 1 and len({r.spelling for r in found}) == 2
