"""Candidate pairs are only those whose words may be spellings of one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm.parties import ASKS, FILTER_BITS, GRAM_COUNTERS, HEAVY, PARTY, Keys, Spans, alike, asked_keys, candidate_pairs, mixed, party_classes
from tamis.llm.spelling import shape_mask, sound
from tamis.session import CLEANUP, checkpointed


def met(spark, people, across):
    """Pairs of refs of (ref, universe, name, date) that become candidates."""
    rows = [(ref, u, "P", [name], [f"{shape_mask(name):x}"], [date] if date else [], ["BG"], []) for ref, u, name, date in people]
    classes, members = party_classes(spark.createDataFrame(rows, f"ref string, {PARTY}"))
    a, b = (members.select(F.col("class").alias(c), F.col("ref").alias(f"ref_{c}")) for c in "ab")
    return {frozenset((r.ref_a, r.ref_b)) for r in candidate_pairs(classes, across).join(a, "a").join(b, "b").collect()}


@pytest.mark.parametrize("across", [True, False])
def test_unlike_words_are_no_candidates(spark, across):
    listed = "L" if across else "C"
    people = [("u", "C", "polina barvolenko", None)]
    people += [(f"n{i}", listed, f"polina {word}", "19800102") for i, word in enumerate(["gronakhorenko", "zhurmaslenko", "tikuzimenko", "strudyarenko"])]
    people += [("slip", listed, "polina barvlenko", "19800102"), ("start", listed, "polina garvolenko", "19800102"), ("blank", listed, "poli nabarvolenko", "19800102")]
    assert {pair for pair in met(spark, people, across) if "u" in pair} == {frozenset(("u", r)) for r in ("slip", "start", "blank")}


def test_middle_words_and_blanks(spark):
    people = [("a", "C", "anatoki paniya rchuk", None), ("b", "L", "anatoli fyodor paniyarchuk", "19700304")]
    assert met(spark, people, True) == {frozenset("ab")}


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("wilhelm", "wlihlem", True), ("christopher", "chris", True), ("christopher", "chrsi", True), ("gronakhorsky", "voresvolsky", False), ("fourelpereau", "fuorelpereau", True), (None, "x", True)],
)
def test_alike(spark, a, b, expected):
    row = spark.createDataFrame([(a and sound(a), sound(b))], "p string, q string")
    assert row.select(F.expr(alike("p", "q")) & F.expr(alike("q", "p"))).first()[0] is expected


def test_codes_are_listed_once():
    """However many dates and countries a person has; mixed in arrays, the keys are those that `mixed` gives."""
    make, names, places, world = Keys(np.zeros(GRAM_COUNTERS, np.int64), set()), ["polina barvolenko", "polina ana garvolenko"], ["BG", "RS", "UA", "MD"], 12345678901
    for dates in ([], ["19800000", "19810000"], ["19800102", "19910304"]):
        few, many = Spans(), Spans()
        make.person(names, dates[:1], places[:1], few)
        many.party = (7, world, 5)
        make.person(names, dates, places, many)
        assert len(few.codes) == len(many.codes) > 0
        wanted = sorted((((mixed(first, many.codes[at]) ^ world) << 2) | HEAVY, asks, many.beside[at]) for first, begin, size, asks, *_ in many.spans for at in range(begin, begin + size))
        keys, rows, tags, beside = many.mixed(np.full(FILTER_BITS // 8, 255, np.uint8))
        assert sorted(zip(keys.tolist(), (tags >> ASKS == 1).tolist(), beside.tolist())) == wanted and set(rows.tolist()) == {7} and set((tags & 31).tolist()) == {5}
        asking = [k for k, asks, _ in wanted if asks]
        assert sorted(many.mixed(None)[0].tolist()) == sorted(many.mixed(np.zeros(FILTER_BITS // 8, np.uint8))[0].tolist()) == asking and 0 < len(asking) < len(wanted)


def test_letter_pairs_are_made_by_word():
    sound.cache_clear()
    words = [[f"{begin}{end}" for begin in ("khrosto", "schalba", "tchirou", "wezzo", "quick")] for end in ("vin", "lloc")]
    masks = {f"{x} {y}": shape_mask(f"{x} {y}") for x in words[0] for y in words[1]}
    assert sound.cache_info().misses <= 10 and shape_mask("tchirouvin wezzolloc") == shape_mask("wezolok chiruvin")
    assert all((m & shape_mask(x)) == shape_mask(x) for name, m in masks.items() for x in name.split())
    assert shape_mask("x") == shape_mask("ks") != shape_mask("a b") == 1 << 97 | 1 << 98
    assert [sound(x) for x in ("schwarzkopf", "tchaikhovsky", "mcckhee", "queeck", "xylophone")] == ["shvarskopf", "kaikovski", "mki", "kik", "ksilofone"]


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    counted = checkpointed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffle_files(spark) - before and spark.conf.get(CLEANUP) == setting and counted.count() == 7


def test_pairs_do_not_wait_for_the_shuffle_of_their_keys(spark):
    """Whoever joins the pairs further holds no files of the keys any more."""
    rows = [(ref, u, "P", ["polina barvolenko"], [f"{shape_mask('polina barvolenko'):x}"], ["19800102"], ["BG"], []) for ref, u in (("a", "C"), ("b", "L"))]
    pairs = candidate_pairs(party_classes(spark.createDataFrame(rows, f"ref string, {PARTY}"))[0], True)
    before = shuffle_files(spark)
    assert len(pairs.collect()) == 1 and not shuffle_files(spark) - before


def test_the_filter_uses_all_its_bits(spark):
    """Keys carry their weight in the lowest bits, so these must not choose the bit."""
    bits = asked_keys(spark.range(40).select((F.col("id") * 4 + HEAVY).alias("key")))
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == set(range(40))
