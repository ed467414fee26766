import random
import unicodedata as ud

import pytest
from pyspark.sql import functions as F

from conceptmill.llm.lookalikes import spread
from conceptmill.llm.normalize import folds, normalized

SAME = [
    ["café", "café", "ｃａｆé", "ca​f­é", "сafé"],
    ["a b", "a b", "a　b", "a b", "a\tb"],
    ["ガイド", "ｶﾞｲﾄﾞ", "ガイド"],
    ["한글", "한글", ud.normalize("NFD", "한글")],
    ["ậ", "ậ", "ậ", "ậ"],
    ["reﬁned", "refined"],
    ["x-y", "x‑y", "x‐y", "x－y"],
    ["ՏОՍР", "SOUP"],
]
APART = ["cafe", "café", "cafē", "m2", "m²", "⑨", "9", "ø", "o", "ő", "ö", "ofﬁce x", "office  x", "A", "a"]


def forms(spark, texts):
    df = spark.createDataFrame([(t, i, "row") for i, t in enumerate(texts)], "text string, rid int, t string")
    got = normalized(df, "text").collect()
    assert len(got) == len(texts) and all(r["t"] == "row" for r in got)
    by = {r["rid"]: r["form"] for r in got}
    return [by[i] for i in range(len(texts))]


def brute(t):
    return ud.normalize("NFC", ud.normalize("NFD", "".join(spread(c) for c in t)))


def test_same_and_apart(spark):
    flat = [t for g in SAME for t in g]
    got = dict(zip(flat, forms(spark, flat)))
    for g in SAME:
        assert len({got[t] for t in g}) == 1, g
    apart = forms(spark, APART)
    assert len(set(apart)) == len(APART)


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    pool = "aeoAn Ọ̧́̂̈ͅéñüÅẤｶﾞ한한의Ж𝄞é​ﬁ̈́ʹ;क़োཱི"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 14))) for _ in range(600)]
    texts += ["e" + "̣́" * 50, "́start", "​", "", " ", "x" * 30_000 + "é"]
    for t, f in zip(texts, forms(spark, texts)):
        assert f == brute(t), (t.encode("unicode-escape"), f.encode("unicode-escape"), brute(t).encode("unicode-escape"))


def test_nulls_and_empty(spark):
    assert forms(spark, [None, "", "a", "a"]) == [None, "", "a", "a"]
    assert normalized(spark.createDataFrame([], "t string, f string"), "t").collect() == []


@pytest.mark.parametrize(("label", "folded", "same"), [("НARBOUR", "harbour", True), ("ОБЩИЙ ФОНД", "общий фонд", True), ("ФОНДS", "фонд", False), ("m²", "m2", False)])
def test_folds(spark, label, folded, same):
    df = spark.createDataFrame([(0, label), (1, folded)], "i int, fold_ string")
    got = folds(df, "fold_").groupBy("fold").agg(F.count_distinct("i").alias("n")).filter("n = 2").count()
    assert (got > 0) == same
