"""Consistent characters, leaked passages, mixtures and pieces."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.llm.codepoints import consistent_names, consistent_texts
from tamis.llm.leakage import leaked_items
from tamis.llm.mixing import actual_shares, mixture, share_out, sized_documents
from tamis.llm.splitting import pieces, split_documents
from tamis.llm.tokens import VOCABULARY, encoding, token_count
from tamis.llm.words import Words

CASES = {
    "Ｗａｌｉｄ": ("Walid", "width"), "ﬁrst": ("first", "width"), "\u212a": ("K", "width"), "Édouard": ("Édouard", "accent"), "A​b": ("Ab", "invisible"), "a­b": ("ab", "invisible"),
    "a b": ("a b", "blank"), "a b‎": ("a b", "blank,invisible"), "Rаfael": ("Rafael", "foreign"), "Αl-Sad": ("Al-Sad", "foreign"), "Foods 29 ЅА": ("Foods 29 SA", "foreign"),
    "Иванов": ("Иванов", ""), "Μακαρ Νεωρ": ("Μακαρ Νεωρ", ""), "Веин (WEIN SA)": ("Веин (WEIN SA)", ""), "Ćirić": ("Ćirić", ""), "plain": ("plain", ""), "": ("", ""), "宁海（中国）": ("宁海（中国）", ""),
    "ệ": ("ệ", "accent"), "q̇": ("q̇", ""), "Сoра": ("Сора", "foreign"), "ĭ́x": ("ĭ́x".replace("ĭ", "ĭ"), "accent"),
}


def test_consistent_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(99, None)], "key int, text string")
    got = {r.key: (r.consistent, ",".join(r.reasons)) for r in consistent_texts(df).collect()}
    assert {t: got[i] for i, t in enumerate(CASES)} == CASES
    assert got[99] == (None, "")


def test_consistent_names(spark):
    rows = [(1, "a b", "x"), (2, "a b", "x"), (3, None, "x"), (4, "ok", "x"), (5, "é" * 20000, "x")]
    df = spark.createDataFrame(rows, "id int, name string, key string")
    got = {r.id: (r.consistent, list(r.reasons)) for r in consistent_names(df, "name").collect()}
    assert got == {1: ("a b", ["blank"]), 2: ("a b", ["blank"]), 4: ("ok", []), 5: ("é" * 20000, [])}
    assert consistent_names(df.limit(0), "name").count() == 0


def words_of(text):
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).casefold())
    return re.findall(r"[^\W_]+", "".join(c for c in plain if unicodedata.category(c) != "Mn"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBé ß́İﬁ,.\n1x中", max_size=40), max_size=5))
def test_words(texts):
    w = Words(texts)
    got = [[] for _ in texts]
    for i, t in enumerate(w.text):
        got[t].append(w.word(i))
    assert got == [words_of(t) for t in texts]


def test_leaked_items(spark):
    r = random.Random(5)
    vocabulary = ["été", "Bank", "register", "of", "the", "naïve", "x1", "Straße", "rare", "alpha", "beta", "gamma"]
    passages = [" ".join(r.choices(vocabulary, k=40)) for _ in range(6)] + ["too short " * 4, None, ""]
    texts = []
    for i in range(60):
        p = passages[r.randrange(6)].split()
        a, n = r.randrange(28), r.randrange(8, 20)
        middle = " ; ".join(p[a : a + n])
        texts.append(" ".join(r.choices(vocabulary, k=30)) + "\n" + (middle.upper() if i % 2 else unicodedata.normalize("NFD", middle)) + "  " + " ".join(r.choices(vocabulary, k=5)))
    texts += [None, "", passages[0], passages[0]]
    items = spark.createDataFrame([(i, p, "t") for i, p in enumerate(passages)], "item_id long, passage string, text string")
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, item_id int")
    want = set()
    for i, t in enumerate(texts):
        w = words_of(t or "")
        runs = {tuple(w[j : j + 12]) for j in range(len(w) - 11)}
        for k, p in enumerate(passages):
            q = words_of(p or "")
            if any(tuple(q[j : j + 12]) in runs for j in range(len(q) - 11)):
                want.add((i, k))
    assert want and {tuple(x) for x in leaked_items(docs, items).collect()} == want
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0


def test_share_out(spark):
    rows = spark.createDataFrame([("a", 1, 0.5, 10.0, 100.0), ("a", 2, 0.25, 100.0, 100.0), ("a", 3, 0.25, 100.0, 100.0), ("b", 1, 1.0, 5.0, 50.0)], "g string, i int, weight double, capacity double, budget double")
    got = {(r.g, r.i): r.allotted for r in share_out(rows, ["g"]).collect()}
    assert got == pytest.approx({("a", 1): 10, ("a", 2): 45, ("a", 3): 45, ("b", 1): 5})


def documents(spark, n=600):
    r = random.Random(6)
    rows = [(i, r.choice(["big"] * 8 + ["mid", "mid", "small"]), r.choice(["en", "fr", None]), r.randrange(1, 40)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long").na.fill("und", ["lang"])


TARGETS = "mix_name string, source_name string, target_share double, max_repeats int"


def test_mixture(spark):
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.25, 3), ("m", "small", 0.25, 4), ("gone", "big", 0.6, 1), ("gone", "absent", 0.4, 9), ("null", None, 1.0, None)], TARGETS)
    docs = documents(spark)
    mixed = mixture(docs, targets).cache()
    shares = {(r.mix_name, r.source_name): r for r in actual_shares(mixed, targets).collect()}
    for (mix, source), share in {("m", "big"): 0.5, ("m", "mid"): 0.25, ("m", "small"): 0.25, ("gone", "big"): 1.0}.items():
        assert shares[mix, source].actual_share == pytest.approx(share, abs=0.02)
    assert shares["m", "mid"].most_times <= 3 and shares["m", "small"].most_times <= 4 and shares["gone", "absent"].tokens == 0
    assert mixed.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0
    assert {tuple(r) for r in mixture(docs.repartition(7), targets).collect()} == {tuple(r) for r in mixed.collect()}  # the seed alone decides
    small = mixture(docs, targets, total=F.lit(400)).groupBy("mix_name").agg(F.sum(F.col("tokens") * F.col("times")).alias("n")).collect()
    assert all(abs(r.n - 400) < 80 for r in small)
    clashing = docs.withColumn("slice", F.lit(1)).withColumn("before", F.lit(1)).withColumn("rest", F.lit(1))
    assert mixture(clashing, targets).count() == mixed.count()
    assert mixture(docs.limit(0), targets).count() == 0 and mixture(docs, targets.limit(0)).count() == 0


def test_redistribution_stays_among_siblings(spark):
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "absent", 0.25, 1), ("m", "mid", 0.25, 9)], TARGETS)
    domains = spark.createDataFrame([("big", "news"), ("absent", "law"), ("mid", "law")], "source string, domain string")
    mixed = mixture(documents(spark), targets, total=F.lit(1000), domains=domains)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("n")).collect()}
    assert got["big"] + got["mid"] == pytest.approx(1000, abs=60)


def test_token_count(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("<|endoftext|>",)], "t string")
    got = [r[0] for r in df.select(token_count("t")).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1
    assert sized_documents(spark.createDataFrame([(1, "a b", None, "s"), (2, "x", "EN", None), (3, "", "en", "s"), (4, "c", "EN", "s")], "doc_id int, text string, lang string, source string")).select("doc_id", "lang").collect() == [(1, "und"), (4, "en")]


TEXTS = [
    "One sentence here. Another one follows! " * 40, "word " * 900, "x" * 5000, "中文句子。还有一句，更长的一句！" * 60, "a\n\nb\r\nc " * 300, "é" * 700 + " " + "Para one.\n\n" * 80, "deadbeef0123456789" * 200, "🙂" * 400, " \n" * 600,
]


@pytest.mark.parametrize("limit,overlap", [(64, 0), (64, 16), (16, 8), (5, 2)])
@pytest.mark.parametrize("text", TEXTS)
def test_pieces(text, limit, overlap):
    encode = encoding(VOCABULARY)[0].encode_ordinary
    found = list(pieces(text, limit, overlap))
    assert found[0][0] == 0 and found[-1][1] == len(encode(text))
    for a, b in zip(found, found[1:]):
        assert a[0] < b[0] <= a[1] < b[1]
        if not overlap:
            assert b[0] == a[1]
    assert all(len(encode(p[4])) <= limit for p in found)
    if not overlap:
        assert "".join(p[4] for p in found) == text
    assert list(pieces("short", limit, overlap)) == []


def test_natural_places():
    cuts = [p[3] for p in pieces(TEXTS[0], 64, 16)]
    assert set(cuts) == {"sentence", "end"}
    assert all(p[4].startswith((" ", "One")) for p in pieces(TEXTS[0], 64, 16))
    assert {p[3] for p in pieces(TEXTS[2], 64, 0)} == {"hard", "end"}


def test_split_documents(spark):
    docs = spark.createDataFrame([(1, TEXTS[0], "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (1, TEXTS[0], "x")], "doc_id int, text string, piece string")
    limits = spark.createDataFrame([("p", 64, 16), ("none", None, 1), ("all", 10_000, 5), ("full", 32, 40)], "profile_name string, max_tokens int, overlap_tokens int")
    got = split_documents(docs, limits).collect()
    assert {(r.profile_name, r.doc_id) for r in got} == {("p", 1), ("full", 1)}
    assert split_documents(docs, limits.limit(0)).count() == 0 and split_documents(docs.limit(0), limits).count() == 0
