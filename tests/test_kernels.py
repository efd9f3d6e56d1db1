"""Phonetic codes name by name, string measures, linked nodes."""

import pytest

from tamis.functions.phonetics import phonetic_keys
from tamis.functions.similarity import jaro, jaro_winkler, token_sort
from tamis.operators.history import merge_history, opening_versions
from tamis.operators.nested import node_table

CODES = {
    "MULLER": ("MLR", "MLR"), "JEAN": ("JN", "AN"), "SMITH": ("SM0", "SMT"), "GARCIA": ("KRX", "KRX"), "AGNES": ("AKNS", "AKNS"), "GLORIA": ("KLR", "LR"), "CAMPBELL": ("KMPP", "KMPP"),
    "KNUTH": ("N0", "NT"), "XAVIER": ("SFR", "SFR"), "CAESAR": ("SSR", "SSR"), "CHARIS": ("KRS", "KRS"), "WRIGHT": ("RT", "RT"), "DODGE": ("TJ", "TJ"), "PHILIP": ("FLP", "FLP"), "NATION": ("NXN", "NXN"),
    "ACQUA": ("AK", "AK"), "MAX": ("MKS", "MKS"), "BORDEAUX": ("PRT", "PRT"), "SUGAR": ("XKR", "SKR"), "": ("", ""), "123": ("", ""),
}


@pytest.mark.parametrize("name", CODES)
def test_phonetic_codes(name):
    assert phonetic_keys(name) == CODES[name]


def test_measures():
    assert round(jaro("MARTHA", "MARHTA"), 4) == 94.4444 and round(jaro_winkler("MARTHA", "MARHTA"), 4) == 96.1111 and token_sort("ANNA ROCHE", "ROCHE ANNA") == 100


def test_opening_versions_take_the_merge(spark):
    rows = [("E", "f", "2024-01-02 00:00:00", "a", "b"), ("E", "f", "2024-01-01 00:00:00", "z", "a"), ("E", "g", "2024-01-01 00:00:00", None, None)]
    changes = spark.createDataFrame(rows, "entity_id string, field string, changed_at string, old_value string, new_value string").selectExpr("* except (changed_at)", "cast(changed_at as timestamp) changed_at")
    key = lambda r: (r.entity_id, r.field, r.version_no)
    merged, whole = (sorted(h.collect(), key=key) for h in (merge_history(changes, opening_versions(changes)), merge_history(changes)))
    assert [r.asDict() for r in merged] == [r.asDict() for r in whole] and [r.value for r in merged] == ["z", "a", "b", None]
    assert merge_history(changes.limit(0), opening_versions(changes.limit(0))).count() == 0


def test_intervals_link_as_parents_do(spark):
    nodes = node_table(spark.createDataFrame([(1, '{"a": [{"b": "x"}, "y"], "c": null}'), (2, "[]"), (3, None)], "id long, j string"), ["j"]).collect()
    for n in nodes:
        around = [p for p in nodes if (p.id, p.column, p.depth) == (n.id, n.column, n.depth - 1) and p.pre < n.pre and p.post >= n.post]
        assert [p.pre for p in around] == ([] if n.parent < 0 else [n.parent])
