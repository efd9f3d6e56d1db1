"""Deltas, quality, mining, names and desk on small fixtures."""

from pyspark.sql import functions as F

from tamis.operators import desk, flows
from tamis.operators.deltas import added_removed, changed_rows, delta_status, field_differences
from tamis.operators.quality import client_quality
from tamis.operators.rarity import document_frequency
from tamis.operators.screening import EngineConfig, cut_off, merged_alerts, party_hits, product_keys, without_whitelisted
from tamis.sources import payments


def test_deltas(spark):
    kind = "entity_id string, name string, entity_checksum string"
    old = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2"), ("n", None, None)], kind)
    new = spark.createDataFrame([("b", "z", "3"), ("c", "x", "1"), ("n", None, None)], kind)
    assert {tuple(r) for r in delta_status(old, new, "entity_id").collect()} == {("a", "REMOVED"), ("b", "MODIFIED"), ("c", "ADDED"), ("n", "UNCHANGED")}
    assert {tuple(r) for r in added_removed(old, new, "entity_id").collect()} == {("a", "REMOVED"), ("c", "ADDED")}
    assert {tuple(r) for r in field_differences(old, new, "entity_id", ["name"]).collect()} == {("b", "name", "y", "z")}
    assert {r.entity_id for r in changed_rows(old, new).collect()} == {"b", "n"}  # by checksum: c has one that is known, a null is never known


def test_names(spark):
    df = spark.createDataFrame([("ROUX, Anne",), ("Anne ROUX",), ("Anne Roux",), ("DE LA TOUR Jean",), ("Solo",), (None,)], "n string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(flows.parsed_name(F.col("n"))).collect()]
    assert got[:5] == [("ROUX", "Anne"), ("ROUX", "Anne"), ("Roux", "Anne"), ("DE LA TOUR", "Jean"), ("Solo", "")]
    pairs = spark.createDataFrame([("A B", "A C", "e1"), ("Z B", "Z C", "e2"), ("A B", "A B", "e3"), ("A", "B", "e4"), ("A B", "C D", "e5")], "a string, b string, e string")
    assert [tuple(r) for r in flows.mined_variants(pairs, "a", "b", "e").collect()] == [("B", "C", 2, "e1,e2")]
    classes = spark.createDataFrame([("ANNE", 7)], "term string, class_id int")
    assert flows.canonical_words(spark.createDataFrame([(1, "Anné Roux")], "k int, n string"), "k", "n", classes).first().canonical == "#7 ROUX"


def test_payment_parties_are_screened(spark):
    """A party is found by any of its words, whatever its kind, beside listings without country."""
    message = "<D><GrpHdr><MsgId>{}</MsgId></GrpHdr><CdtTrfTxInf><Dbtr><Nm>{}</Nm><PstlAdr><Ctry>FR</Ctry></PstlAdr></Dbtr></CdtTrfTxInf></D>"
    names = {"M1": "Mr Konstantin Papadopoulos", "M2": "Konstantin Papadopulos", "M3": "Harren Shipping", "M4": "Amelie Durand", "M5": "M. Boris Papadopoulos"}
    parties = payments.payment_parties(spark.createDataFrame([(message.format(k, v),) for k, v in names.items()], "xml string"))
    kind = "entity_id string, listed_type string, listed_names array<string>, listed_countries array<string>, list_type string, perimeter string"
    rows = [("E1", "PP", ["Konstantin Papadopoulos"], ["FR"], "EU", "SANCTION"), ("E2", "PM", ["Haren Shipping"], [], "EU", "SANCTION"), ("E3", "PP", ["Amelie Durand"], ["DE"], "EU", "SANCTION")]
    hits = party_hits(payments.distinct_parties(parties), spark.createDataFrame(rows, kind))
    assert {(r.name, r.entity_id) for r in hits.collect()} == {("MR KONSTANTIN PAPADOPOULOS", "E1"), ("KONSTANTIN PAPADOPULOS", "E1"), ("HARREN SHIPPING", "E2")}
    assert {r.message_id for r in payments.message_verdicts(parties, hits).where("verdict = 'HIT'").collect()} == {"M1", "M2", "M3"}


def test_quality(spark):
    kind = "client_type string, client_first_name string, client_last_name string, client_company_name string, nationality string, residence string, birth_country string, registration_country string, client_dob string, client_is_deceased boolean"
    rows = [("PP", "Anne", None, None, "FR", None, None, None, "1980-01-01", None), ("PM", None, None, "Ж", None, None, None, None, None, None), ("X", "a", "b", None, None, None, None, "DE", "01/01/1980", None), ("PP", "A", "B", None, "FR", None, None, None, None, True)]
    got = [(r.errors, r.warnings) for r in client_quality(spark.createDataFrame(rows, kind)).collect()]
    assert got == [(["B01"], []), (["B05"], ["M01", "M03"]), (["B02"], ["M05"]), ([], [])]


def test_desk_and_alerts(spark):
    hits = spark.createDataFrame([("c", "a", 80.0), ("c", "b", 90.0), ("c", "b", 70.0), ("d", "z", 75.0)], "client_id string, entity_id string, final_score double")
    alerts = spark.createDataFrame([("c", "a", "OPEN", 85.0, 1), ("c", "x", "OPEN", 60.0, 0), ("d", "z", "CLOSED_CONFIRMED", 99.0, 2)], "client_id string, entity_id string, status string, max_score double, redetections int")
    assert {tuple(r) for r in merged_alerts(alerts, hits).collect()} == {("c", "a", "OPEN", 85.0, 2), ("c", "b", "OPEN", 90.0, 0), ("c", "x", "OPEN", 60.0, 0), ("d", "z", "CLOSED_CONFIRMED", 99.0, 2), ("d", "z", "OPEN", 75.0, 0)}
    listed = spark.createDataFrame([("c", "a", None, None), ("c", "b", "2020-01-01", None), ("d", "z", None, "2020-01-01")], "client_id string, entity_id string, expires_at string, revoked_at string")
    assert {r.entity_id for r in without_whitelisted(hits, listed, F.lit("2024-01-01")).collect()} == {"b", "z"}
    one = spark.range(1)
    config = EngineConfig(cut_off_by_list={"EU": 90}, cut_off_by_perimeter={"P": 80})
    assert [tuple(r) for r in one.select(cut_off(config, F.lit("EU"), F.lit("P")), cut_off(config, F.lit("UN"), F.lit("P")), cut_off(config, F.lit("UN"), F.lit(None))).collect()] == [(90.0, 80.0, 75.0)]
    keys = one.select(product_keys(F.array(F.lit("FR"), F.lit("DE")), F.array().cast("array<string>"), F.array(F.lit("A")))).first()[0]
    assert keys == ["FR_XX_A", "DE_XX_A"]
    graph = spark.createDataFrame([("a", "b", 60), ("b", "c", 60), ("d", "a", 10)], "target string, owner string, pct int")
    assert {tuple(r) for r in desk.neighbours(graph, "a", 1).collect()} == {("a", 0), ("b", 1), ("d", 1)}
    names = spark.createDataFrame([(i, "MOHAMMED ALI") for i in range(3)] + [(9, "RARE Ali")], "k int, n string")
    assert {tuple(r) for r in document_frequency(names, "n", "k").collect()} == {("MOHAMMED", 3), ("ALI", 4)}
