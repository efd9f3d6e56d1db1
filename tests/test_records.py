"""Snapshot cells, type-two history and nested records."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tamis.operators.history import journal_changes, merge_history, stamped
from tamis.operators.nested import labelled, node_table, text_items
from tamis.operators.snapshot_cells import delivery_chain, snapshot_changes

SNAPSHOTS = "snapshot_id string, file_type string, uploaded_at timestamp_ntz, status string"
ROWS = "id bigint, snapshot_id string, entity_id string, entity_checksum string, key string, field string"


def changes(spark, snapshots, rows):
    chain = delivery_chain(spark.createDataFrame(snapshots, SNAPSHOTS))
    found = snapshot_changes(spark.createDataFrame(rows, ROWS), chain, {"sum": F.lower("entity_checksum")})
    return {(r.snapshot_id, r.entity_id): (r.change_kind, r.changed_fields) for r in found.collect()}


def test_snapshot_changes(spark):
    t = datetime(2024, 1, 1)
    snapshots = [("S1", "WATCHLIST_A", t, "READY"), ("SX", "WATCHLIST_A", t + timedelta(1), "ERROR"), ("S2", "WATCHLIST_A", t + timedelta(2), None), ("B1", "WATCHLIST_B", t, "READY"), ("C", "CLIENT_BASE", t, "READY")]
    rows = [
        (1, "S1", "a", "AA", "clash", None), (2, "S1", "a\t", "bb", None, None), (3, "S1", "gone", "x", None, None), (4, "S1", "null", None, None, None), (5, "S1", "case", "Ab", None, None),
        (6, "SX", "a", "zz", None, None), (7, "S2", " a", "aa", None, None), (8, "S2", " a", "aa", None, None), (9, "S2", "new", "n", None, None), (10, "S2", "null", "n", None, None), (11, "S2", "case", "aB", None, None),
        (12, "S2", None, "n", None, None), (13, None, "lost", "n", None, None), (14, "B1", "first", "n", None, None), (15, "S2", " ", "n", None, None),
    ]
    assert changes(spark, snapshots, rows) == {
        ("S2", "a"): ("changed", "sum"), ("S2", "gone"): ("removed", None), ("S2", "new"): ("added", None), ("S2", "null"): ("changed", "sum"),
    }
    assert changes(spark, snapshots, []) == {}
    assert changes(spark, [], rows) == {}


JOURNAL = "id bigint, entity_id string, field string, old_value string, new_value string, changed_at timestamp_ntz, version_no int, value string"


def plain_history(rows):
    """Brute force over the definition."""
    by = {}
    for i, e, f, old, new, at in rows:
        if e and e.strip() and f is not None and at is not None:
            by.setdefault((e.strip(), f), {}).setdefault(at, []).append((i, old, new))
    out = set()
    for (e, f), times in by.items():
        ordered = [(t, *max(v, key=lambda x: x[0])[1:]) for t, v in sorted(times.items())]
        versions = [(None, ordered[0][1])]
        for t, _, new in ordered:
            if new != versions[-1][1]:
                versions.append((t, new))
        text = [("" if t is None else t.strftime("%Y-%m-%d %H:%M:%S")) for t, _ in versions] + [""]
        out |= {(e, f, n + 1, v, text[n], text[n + 1]) for n, (_, v) in enumerate(versions)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_history_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [
        (i, r.choice(["e1", "e1 ", "busy", "busy", "busy", None]), r.choice(["f", "g"]), r.choice([None, "", "a"]), r.choice([None, "", "a", "b"]), r.choice([None] + [datetime(2024, 1, 1) + timedelta(hours=7 * k) for k in range(30)]))
        for i in range(300)
    ]
    table = spark.createDataFrame([(*x, 9, "clash") for x in rows], JOURNAL)
    journal = journal_changes(table)
    want = plain_history(rows)
    assert {tuple(x) for x in stamped(merge_history(journal)).collect()} == want
    cut = F.lit("2024-01-04 12:00:00").cast("timestamp_ntz")
    first = merge_history(journal.where(F.col("changed_at") < cut))
    assert {tuple(x) for x in stamped(merge_history(journal.where(F.col("changed_at") >= cut), first)).collect()} == want
    assert merge_history(journal.limit(0)).count() == 0


def test_labels_are_intervals():
    nodes = labelled(json.dumps({"a": [1, {"b": "x"}], "c": None}))
    for pre, post, parent, depth, *_ in nodes:
        if parent >= 0:
            assert nodes[parent][0] < pre <= post <= nodes[parent][1] and depth == nodes[parent][3] + 1
    assert labelled("{broken") is None and labelled(None) is None and labelled("[NaN]") is None
    deep = labelled("[" * 300 + "]" * 300)
    assert len(deep) == 300 and deep[0][1] == 299


NESTED = "id bigint, aliases string, countries string, individual_name_parsed string, branch string"


def test_text_items(spark):
    rows = [
        (1, '{"high_priority": ["A", " ", null, {"name": "B", "variants": ["C", "D "], "script": "Latn"}], "low_priority": "E", "rev": 1}', None, None, "clash"),
        (2, json.dumps(json.dumps(["x", ["y"], {"name": "z", "quality": "weak"}])), '{"citizenship": [{"code": "FR", "since": "1990"}], "residence": [["DE"]], "other": {"birth_country": "XX"}}', None, None),
        (3, "not json", '{"citizenship": "FR"', '[{"first_name": "P", "last_name": "Q"}, {"last_name": "R"}]', None),
        (4, '"only"', '"FR"', "null", None),
        (5, "", "[]", "{}", None),
    ]
    table = spark.createDataFrame(rows, NESTED)
    got = {tuple(r) for r in text_items(table).collect()}
    assert got == {
        (1, "aliases.high_priority", 1, "A"), (1, "aliases.high_priority", 2, "B"), (1, "aliases.high_priority", 3, "C"), (1, "aliases.high_priority", 4, "D "), (1, "aliases.low_priority", 1, "E"),
        (2, "aliases", 1, "x"), (2, "aliases", 2, "y"), (2, "aliases", 3, "z"), (2, "countries.citizenship", 1, "FR"), (2, "countries.residence", 1, "DE"),
        (3, "individual_name_parsed.first_name", 1, "P"), (3, "individual_name_parsed.last_name", 1, "Q"), (3, "individual_name_parsed.last_name", 2, "R"), (4, "aliases", 1, "only"),
    }
    assert text_items(table.limit(0)).count() == 0
    long = spark.createDataFrame([(1, json.dumps(["w" * 100_000] * 3), None, None, None)], NESTED)
    assert [len(r.item_value) for r in text_items(long).collect()] == [100_000] * 3
    assert node_table(table, ["aliases"]).where("kind = 'object'").count() == 3
