"""Similarities, phonetics, screening, sources and streams."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tamis.functions.phonetics import phonetic_keys
from tamis.functions.similarity import assigned, edit_distance, edit_similarity, jaro, jaro_winkler, token_set, token_sort
from tamis.functions.text import cleansed, iso_date, rotations, scripts_of, spreadsheet_safe, without_accents
from tamis.operators import desk
from tamis.operators import screening as S
from tamis.sources import payments, tables
from tamis.streaming import surveillance


def slow_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance():
    r = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(r.choices("abc", k=r.randrange(8))) for _ in "xy")
        assert edit_distance(a, b) == slow_distance(a, b)
        assert edit_distance(a, b, 2) == min(slow_distance(a, b), 3)


@pytest.mark.parametrize("columns", [4, 12])
def test_assignment(columns):
    r = random.Random(4)
    for _ in range(20):
        costs = [[r.randrange(20) for _ in range(columns)] for _ in range(3)]
        assert assigned(costs) == min(sum(costs[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(columns), 3))


def test_similarities():
    assert jaro("", "") == 100 and jaro("a", "") == 0 and jaro_winkler("MARTHA", "MARHTA") == pytest.approx(96.11, abs=0.01)
    assert jaro("AB", "BA") == pytest.approx(100 * (1 + 1 + 0.5) / 3)
    assert edit_similarity("CA", "AC") == 50 and edit_similarity("", "A") == 0
    assert token_sort("JEAN DUPONT", "DUPONT JEAN") == 100 and token_set("JEAN DUPONT", "DUPONT") == 100 and token_set("AB", "CD") == 0


def test_phonetics():
    assert phonetic_keys("MULLER") == ("MLR", "MLR") and phonetic_keys("JEAN") == ("JN", "AN") and phonetic_keys("SMITH") == ("SM0", "SMT")
    assert phonetic_keys("KNIGHT X")[0][0] == "N" and phonetic_keys("") == ("", "") and phonetic_keys(None) == ("", "") and phonetic_keys("XAVIER")[0][0] == "S"
    assert len(phonetic_keys("BARTHOLOMEUS")[0]) == 4


def test_text_columns(spark):
    df = spark.createDataFrame([("Éléonore  d'Été-S.A.", "31/12/2001"), (None, "1999"), ("=1+1", "x"), ("Иван", "2001/02/03")], "n string, d string")
    rows = df.select(without_accents("n").alias("w"), cleansed("n", True).alias("c"), iso_date("d").cast("string").alias("d"), spreadsheet_safe("n").alias("s"), scripts_of("n").alias("x"), rotations("n").alias("r")).collect()
    assert rows[0].w == "Eleonore  d'Ete-S.A." and rows[0].c == "ELEONORE DETE S A" and rows[0].r[1].startswith("d'Été-S.A.")
    assert [r.d for r in rows] == ["2001-12-31", "1999-01-01", None, "2001-02-03"] and rows[2].s == "'=1+1" and rows[3].x == ["Cyrillic"]


def test_screening(spark):
    config = S.EngineConfig()
    pairs = spark.createDataFrame(
        [("c", "w1", ["ANNE ROUX", "ROUX ANNE"], ["ROUX ANNE"], ["1980-01-01"], ["1980"], "F", ["M"], ["FR"], ["FR"], None, "EU", "SANCTION"), ("c", "w2", ["ANNE ROUX"], ["XY"], [], [], "F", [], [], ["FR"], "lei", "EU", "SANCTION")],
        "client_id string, entity_id string, client_names array<string>, listed_names array<string>, client_dates array<string>, listed_dates array<string>, client_gender string, listed_genders array<string>,"
        "client_countries array<string>, listed_countries array<string>, hard string, list_type string, perimeter string",
    )
    got = {r.entity_id: r for r in S.decided(pairs, config).collect()}
    assert (got["w1"].base_score, got["w1"].dob_adjustment, got["w1"].gender_adjustment, got["w1"].country_adjustment, got["w1"].final_score) == (100, 15, -20, 10, 100)
    assert got["w2"].final_score == 100 and got["w2"].country_adjustment == -10 and got["w2"].decision == "ALERT"
    off = S.decided(pairs, S.EngineConfig(off=frozenset({"adjust"}), cut_off_by_list={"EU": 101.0})).collect()
    assert all(r.dob_adjustment == 0 and r.decision == "NO_MATCH" for r in off)
    ranked = S.ranked_hits(S.decided(pairs, config)).orderBy("hit_rank").collect()
    assert [(r.entity_id, r.hit_rank, r.hits_count) for r in ranked] == [("w1", 1, 2), ("w2", 2, 2)]
    closed = S.closed_by_rule(S.ranked_hits(S.decided(pairs, config)), [S.Rule("B", "hit_rank = 2", 2), S.Rule("N", "null", 1), S.Rule("P", "true", 0, ("OTHER",))]).collect()
    assert {r.entity_id: r.rule for r in closed} == {"w1": None, "w2": "B"}


def test_hard_match(spark):
    df = spark.createDataFrame([("5299 00T8BM49AURSDO55", "ABCDEFGH", "ABCDEFGHXXX", ["x"], ["X"]), ("short", None, None, ["k"], ["k"])], "lei string, bic string, other string, a array<string>, b array<string>")
    c, w = ({"lei": F.col("lei"), "bic": F.col(bic), "crypto": F.col(k)} for bic, k in (("bic", "a"), ("other", "b")))
    assert [r[0] for r in df.select(S.hard_match(c, w, S.EngineConfig())).collect()] == ["lei", "crypto"]
    assert [r[0] for r in df.select(S.hard_match(c, w, S.EngineConfig(off=frozenset({"hard.lei"})))).collect()] == ["bic", "crypto"]


def test_ownership(spark):
    edges = spark.createDataFrame([("t1", "d1", 25), ("t1", "d2", 25), ("t1", "d2", 10), ("t2", "t1", 60), ("t3", "x", 100), ("t4", "d1", None), ("t5", "d1", 49)], "target string, owner string, pct int")
    got = {r.target: (r.total_pct, r.level) for r in desk.inherited_risk(edges, spark.createDataFrame([("d1",), ("d2",)], "owner string")).collect()}
    assert got == {"t1": (50, 1), "t4": (100, 1), "t2": (60, 2)}
    assert desk.inherited_risk(edges.limit(0), spark.createDataFrame([], "owner string")).count() == 0


MESSAGE = """<Document xmlns="urn:x"><CstmrCdtTrfInitn><GrpHdr><MsgId>M1</MsgId><InitgPty><Nm>Init</Nm></InitgPty></GrpHdr><PmtInf><Dbtr><Nm>Ann Roux</Nm><PstlAdr><Ctry>FR</Ctry></PstlAdr></Dbtr>
<DbtrAgt><FinInstnId><BICFI>BNPAFRPP</BICFI></FinInstnId></DbtrAgt><CdtTrfTxInf><PmtId><EndToEndId>E1</EndToEndId></PmtId><Amt><InstdAmt Ccy="EUR">12.50</InstdAmt></Amt><Cdtr><Nm>Bob</Nm></Cdtr></CdtTrfTxInf>
<CdtTrfTxInf><Amt><InstdAmt Ccy="USD">x</InstdAmt></Amt><Cdtr><Nm>ann roux</Nm><PstlAdr><Ctry>FR</Ctry></PstlAdr></Cdtr></CdtTrfTxInf></PmtInf></CstmrCdtTrfInitn></Document>"""


def test_payments(spark):
    parties = payments.payment_parties(spark.createDataFrame([(MESSAGE,), ("<broken",), (None,)], "xml string"))
    rows = parties.collect()
    assert len(rows) == 8 and {(r.role, r.name, r.country) for r in rows if r.transaction_no == 1} == {("initiating_party", "Init", None), ("debtor", "Ann Roux", "FR"), ("debtor_agent", "BNPAFRPP", "FR"), ("creditor", "Bob", None)}
    assert {str(r.amount) for r in rows} == {"12.50", "None"}
    distinct = {r.name: r for r in payments.distinct_parties(parties).collect()}
    assert distinct["ANN ROUX"].roles == ["creditor", "debtor"] and distinct["ANN ROUX"].probes == ["ANN ROUX", "ROUX ANN"]
    hits = spark.createDataFrame([("BOB", "", "", "w")], "name string, country string, bic string, entity_id string")
    assert [tuple(r) for r in payments.message_verdicts(parties, hits).collect()] == [("M1", "HIT", 1)]


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Client ID;Nom ;dob\n1; Ann ;2000\n2;;\n")
    got = tables.csv_table(spark, str(tmp_path / "a.csv"), {"client_id": ["client_id"], "name": ["name", "NOM"], "city": ["city"]}).collect()
    assert [tuple(r) for r in got] == [("1", "Ann", None), ("2", None, None)]
    html = "<table><tr><td>layout</td></tr></table><table><tr><th>Name</th><th>Type</th></tr><tr><td>A<b>b</b></td><td>x</td></tr></table>"
    rows = tables.html_rows(spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "k int, html string"), "k", "html").collect()
    assert [(r.k, r.row_no, r.cells) for r in rows] == [(1, 0, ["Name", "Type"]), (1, 1, ["Ab", "x"])]
    (tmp_path / "l.xml").write_text("<list><entity><name>A</name><alias>x</alias><alias>y</alias></entity><entity><name>B</name></entity></list>")
    xml = tables.xml_records(spark, str(tmp_path / "l.xml"), "entity", "name string, alias array<string>").orderBy("name").collect()
    assert [(r.name, r.alias) for r in xml] == [("A", ["x", "y"]), ("B", None)]
    formats = {r.path.rpartition("/")[2]: r.format for r in tables.sniffed_format(spark, str(tmp_path / "*.*")).collect()}
    assert formats == {"a.csv": "text", "l.xml": "text"} or formats["a.csv"] == "text"
    group = spark.createDataFrame([(1, "Main", True), (1, "Alt", False), (1, "", False), (2, "Only", False)], "g int, n string, p boolean")
    assert {(r.g, r.primary_name, tuple(r.aliases)) for r in tables.grouped_list(group, "g", "n", F.col("p")).collect()} == {(1, "Main", ("Alt",)), (2, "Only", ())}
    ids = tables.stable_ids(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "row int, x string"), "CA-", ["x"], "row").orderBy("row").collect()
    assert ids[1].entity_id == f"{ids[0].entity_id}.2" and ids[2].entity_id != ids[0].entity_id
    alerts = tables.alert_list(spark.createDataFrame([("Good Firm", "u"), ("good firm", "v"), ("x " * 30, "w")], "Name string, Site string"), "AMF", {"name": ["name"], "website": ["site"]})
    assert alerts.count() == 1
    tables.write_csv(group.withColumn("n", F.lit("=x")), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep=";", header=True).first().n == "'=x"


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.unionByName(events).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = surveillance.inbox(spark, str(tmp_path / "in"), events.schema)
    deduped = surveillance.idempotent(stream, "event_id", "ts", "40 days")
    seen = []
    q = surveillance.merging(deduped, lambda df, n: seen.append(df.count()), str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == events.count()
    q = surveillance.endpoint_windows(stream, "ts", "1 day", "40 days").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(calls) from windows").first()[0] == 2 * events.count()
    burst = surveillance.with_burst_cap(spark.createDataFrame([("a", str(i)) for i in range(11)] + [("b", "x")], "kind string, message string"))
    assert {(r.kind, r.events) for r in burst.collect()} == {("a", 11), ("b", 1)}
