import random
import unicodedata

import pytest

from trendloom.llm.lookalike import Canonical, SpellingTrie, canonical_texts, look_classes, look_pairs, public_looks, skeleton, vocabulary

SAME = [
    ("paypal", "раураl"), ("ABC 12", "ＡＢＣ　１２"), ("café", "café"), ("office", "oﬃce"), ("25 °C", "25 ℃"), ("co-op", "co‐op"), ("a b", "a b"), ("word", "w​o­r⁠d﻿"),
    ("5 µm", "5 μm"), ("ёлка", "ëлкa"), ("だ", "だ"), ("wait...", "wait…"), ("Å", "Å"), ("ë", "ё"),
]
DIFFERENT = [("cafe", "café"), ("m2", "m²"), ("Ab", "ab"), ("a.b", "a b"), ("a\nb", "a b"), ("a\nb", "a\r\nb"), ("a  b", "a b"), ("½", "1/2"), ("strasse", "straße"), ("a\tb", "a b"), ("k", "к"), ("👩‍💻", "👩💻"), ("0", "O"), ("l", "1"), ("a-b", "a—b")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    form = Canonical(["paypal", "office", "word"])
    assert skeleton(a) == skeleton(b) and form.text(a) == form.text(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look(a, b):
    form = Canonical(["cafe", "a", "strasse"])
    assert skeleton(a) != skeleton(b) and form.text(a) != form.text(b)


def test_canonical_text_equals_iff_the_skeleton_does():
    rng = random.Random(1)
    alphabet = "aе\u0301eé о o\u200b \u2260≠ﬁfi\u00adｆ‐-Кс℀/ц\u0323"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 7))) for _ in range(4000)]
    form = Canonical(["fi", "oe", "é", "ea", "сец", "цо", "ц", "оц"], cache=50)
    by_form, by_skeleton = {}, {}
    for t in texts:
        by_form.setdefault(form.text(t), set()).add(t)
        by_skeleton.setdefault(skeleton(t), set()).add(t)
    assert sorted(map(sorted, by_form.values())) == sorted(map(sorted, by_skeleton.values()))
    assert all(unicodedata.is_normalized("NFC", t) for t in by_form)


def test_spellings_are_those_of_the_vocabulary():
    form = Canonical(["сок", "рост", "sale"])
    # Russian words keep their alphabet, however they are disguised; what ASCII can write is written so
    assert form.text("coк и pост, ѕаlе") == "сок и рост, sale"
    assert Canonical([]).text("рост") == "pocт"


def test_letters_that_look_like_several_need_the_vocabulary():
    form = Canonical(["IBM", "mail", "bill", "Ill"])
    assert form.text("\u04c0BM mai\u04c0s mai\u04c0 bi\u04c0\u04cf \u04cfll") == "IBM maiIs mail bill Ill"
    without = Canonical([])
    assert without.text("mai\u04c0") != "mail" and without.text("\u04c0BM") == "IBM"
    # of readings that both make spellings the more frequent one counts
    assert Canonical(["Al", "AI"]).text("A\u04c0") == "Al" and Canonical(["AI", "Al"]).text("A\u04c0") == "AI"
    assert Canonical(["mai\u04c0"]).text("mai\u04c0") == "maiI"  # a spelling in such letters settles nothing


def test_rows_that_need_the_automaton(spark):
    texts = ["send the mail to IBM", "send the mai\u04c0 to \u04c0BM", "send the mai\ua4f2 to \ua4f2\ua4d0\ua4df", "mail IBM", "mail IBM", "send the maiI to lBM"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pairs = lambda **o: sorted(tuple(r) for r in look_pairs(canonical_texts(df, **o)).collect())
    assert pairs() == [(0, 1), (0, 2), (1, 2)]
    # without the vocabulary all strokes are read alike, and the rows are lost
    assert pairs(spellings=[]) == [(1, 2)]


def test_public_table(spark):
    looks = public_looks(spark)
    assert 100 < len(looks) < 1_000 and looks[0x2C82 + 0x22] == ("C",) and looks[0xA4D0] == ("B",) and looks[0xA4F2] == ("I", "l")
    assert ord("α") not in looks and ord("ו") not in looks and all(ord(x) not in looks for x in "АаІіΙσ")


def test_trie_with_weights():
    trie = SpellingTrie(["kitten", "sitting", "mitten", "kit"])
    assert trie.find("kіttеn") == ("kitten", 0)
    assert trie.find("kitte") is None and trie.find("kitte", 1) == ("kitten", 1)
    assert trie.find("kittenn", 1) == ("kitten", 1) and trie.find("xitten", 1) == ("kitten", 1)
    assert trie.find("sittin​ng", 2) == ("sitting", 1) and trie.find("zzzzzz", 2) is None
    assert SpellingTrie().find("a", 3) is None


def test_pairs(spark):
    texts = {1: "same text", 2: "ѕame text", 3: "same  text", 4: "same text", 5: None, 6: " ", 7: "​", 8: " ", 9: "", 10: "ｓame text", 11: "copy", 12: "copy", 13: "long " * 5000 + "е", 14: "long " * 5000 + "e"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "1 AS look", "2 AS stored")
    shown = {i: skeleton(t) for i, t in texts.items() if t and skeleton(t).strip()}
    expected = sorted((a, b) for a in shown for b in shown if a < b and shown[a] == shown[b] and texts[a] != texts[b])
    forms = canonical_texts(df)
    assert sorted(tuple(r) for r in look_pairs(forms).collect()) == expected
    assert sorted(tuple(r) for r in look_pairs(forms, part_rows=1).collect()) == expected
    links = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in look_classes(forms).collect()}
    count = {i: sum(i in p for p in expected) for i in {x for p in expected for x in p}}
    assert {i: n for i, (_, n) in links.items()} == count and len({c for c, _ in links.values()}) == 2
    assert look_pairs(canonical_texts(df.limit(0))).count() == 0
    kept = canonical_texts(df, spellings=[], keep_text=True).where("doc_id = 2").first()
    assert kept["canonical"] == "same text" and not kept["blank"]


def test_vocabulary_is_bounded_by_frequency(spark):
    df = spark.createDataFrame([(1, "a a a b b c с"), (2, None), (3, "")], "doc_id bigint, text string")
    assert vocabulary(df) == ["a", "b"]
    assert vocabulary(df, size=1) == ["a"] and vocabulary(df, size=0) == [] and vocabulary(df, least=1) == ["a", "b", "c", "с"]
    assert vocabulary(df.limit(0)) == []
