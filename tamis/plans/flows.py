"""Queries over payments, names, dates, digests and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.text import content_checksum, iso_date
from tamis.operators import flows
from tamis.operators.screening import party_hits
from tamis.plans import views as V
from tamis.plans.screening import _listed_side
from tamis.sources import payments
from tamis.streaming import surveillance
from tamis.session import table

NOW = "1998-06-15"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """One credit transfer for each order: the customer pays by one bank of its nation."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    xml = F.format_string(
        '<Document xmlns="urn:iso"><FIToFICstmrCdtTrf><GrpHdr><MsgId>M%d</MsgId></GrpHdr><CdtTrfTxInf><PmtId><EndToEndId>E%d</EndToEndId></PmtId><IntrBkSttlmAmt Ccy="EUR">%d</IntrBkSttlmAmt>'
        "<Dbtr><Nm>%s</Nm><PstlAdr><Ctry>%s</Ctry></PstlAdr></Dbtr><CdtrAgt><FinInstnId><BICFI>BANK%sXX</BICFI></FinInstnId></CdtrAgt></CdtTrfTxInf></FIToFICstmrCdtTrf></Document>",
        "o_orderkey", "o_orderkey", F.floor("o_totalprice"), "c_name", V.pick(V.CC, F.col("c_nationkey")), V.pick(V.CC, F.col("c_nationkey")),
    )
    return o.select(xml.alias("xml"))


def payment_parties(spark: SparkSession, d: str) -> DataFrame:
    p = payments.payment_parties(_messages(spark, d))
    return p.groupBy("role", "country").agg(F.count("*").alias("parties"), F.countDistinct("name").alias("names"), F.sum("amount").cast("double").alias("amount"))


def distinct_payment_parties(spark: SparkSession, d: str) -> DataFrame:
    parties = payments.distinct_parties(payments.payment_parties(_messages(spark, d)))
    return parties.select("name", "country", "bic", F.array_join("roles", ",").alias("roles"), "transactions")


def payment_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Messages of customers whose number ends with 7 are hits."""
    p = payments.payment_parties(_messages(spark, d))
    hits = table(spark, d, "customer").where("c_custkey % 10 = 7").select(F.upper("c_name").alias("name"), V.pick(V.CC, F.col("c_nationkey")).alias("country"), F.lit("").alias("bic"), F.lit("w").alias("entity_id"))
    return payments.message_verdicts(p, hits).groupBy("verdict").agg(F.count("*").alias("messages"), F.sum("hits").alias("hits"))


def payment_screening(spark: SparkSession, d: str) -> DataFrame:
    """Messages paid by the persons of the client book, with the list entities that their parties hit."""
    c = V.clients(spark, d).where("client_type = 'PP'").select("k", F.concat_ws(" ", "last_name", "first_name").alias("name"), F.coalesce("nationality", F.lit("")).alias("country"))
    xml = F.format_string('<Document><GrpHdr><MsgId>P%d</MsgId></GrpHdr><CdtTrfTxInf><Dbtr><Nm>%s</Nm><PstlAdr><Ctry>%s</Ctry></PstlAdr></Dbtr></CdtTrfTxInf></Document>', "k", "name", "country")
    parties = payments.payment_parties(c.select(xml.alias("xml")))
    listed = _listed_side(spark, d).withColumn("perimeter", F.when(F.col("list_type") == "PEP", "HORS_SANCTION").otherwise("SANCTION"))
    return payments.message_verdicts(parties, party_hits(payments.distinct_parties(parties), listed))


def variant_mining(spark: SparkSession, d: str) -> DataFrame:
    """Words that replace one another in pairs that agree in the first word and the beginning of the last."""
    c = V.clients(spark, d).where("client_type = 'PP'").select("client_id", F.concat_ws(" ", "first_name", "last_name").alias("a"), "first_name", F.substring("last_name", 1, 4).alias("begins"))
    w = V.watchlist(spark, d).select("primary_name", F.substring_index("primary_name", " ", 1).alias("first_name"), F.substring(F.substring_index("primary_name", " ", -1), 1, 4).alias("begins"))
    return flows.mined_variants_by_name(c, w, ["first_name", "begins"], "a", "primary_name", "client_id")


def parsed_names(spark: SparkSession, d: str) -> DataFrame:
    """Family and given names of the listed names with a comma."""
    e = table(spark, d, "watchlist_entities").where("entity_type = 'I' and primary_name like '%,%'").select("id", flows.parsed_name(F.col("primary_name")).alias("n"))
    return e.select("id", "n.family", "n.given")


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with regions of first names as classes."""
    classes = spark.createDataFrame([(w, i % 5) for i, w in enumerate(V.FIRST)], "term string, class_id int")
    return flows.canonical_words(V.watchlist(spark, d), "entity_id", "primary_name", classes).groupBy("canonical").agg(F.count("*").alias("entities"))


def birth_dates(spark: SparkSession, d: str) -> DataFrame:
    """Clients by year of birth after all written forms are read; null for unreadable ones."""
    return table(spark, d, "client_entities").groupBy(F.year(iso_date("client_dob")).alias("year")).agg(F.count("*").alias("clients"))


def client_countries(spark: SparkSession, d: str) -> DataFrame:
    """Values of the multi-value nationality cell."""
    values = F.explode(F.filter(F.transform(F.split("nationality", "[,;]"), lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    return table(spark, d, "client_entities").select(values.alias("value")).groupBy("value").agg(F.count("*").alias("clients"))


def daily_digests(spark: SparkSession, d: str) -> DataFrame:
    who = F.array(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")), F.lit("desk"))
    r = flows.digests(table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), who, "at")
    return r.select("recipient", F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events")


def escalated(spark: SparkSession, d: str) -> DataFrame:
    r = flows.escalations(V.alerts(spark, d), F.lit(NOW).cast("date"), 2)
    return r.groupBy("reason", "priority").agg(F.count("*").alias("alerts"), F.min("days_left").alias("least"))


def client_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Clients with repeated contents, whatever their row id."""
    names = [c for c in table(spark, d, "client_entities").columns if c not in ("id", "snapshot_id", "entity_checksum")]
    rows = table(spark, d, "client_entities").select(content_checksum(*names).alias("sum"))
    return rows.groupBy("sum").count().groupBy(F.col("count").alias("copies")).agg(F.count("*").alias("contents"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: calls by day and endpoint, counted by a stream over the events; the sink holds one row for each."""
    schema = table(spark, d, "events").schema
    calls = surveillance.inbox(spark, f"{d}/events.parque[t]", schema)
    windows = surveillance.endpoint_windows(calls, "ts", "1 day", "40 days")
    name = f"stream_windows_{abs(hash(d)) % 10**8}"
    query = windows.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "calls", F.round("value", 2).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (payment_parties, distinct_payment_parties, payment_verdicts, payment_screening, variant_mining, parsed_names, canonical_names, birth_dates, client_countries, daily_digests, escalated, client_checksums, stream_windows)
}

_PAYMENTS = f"""paid AS (SELECT o_orderkey, c_custkey, c_name, floor(o_totalprice) AS amount, {V._pick(V.CC, 'c_nationkey')} AS country FROM orders JOIN customer ON o_custkey = c_custkey),
  parties AS (SELECT 'debtor' AS role, c_name AS name, country, NULL AS bic, amount, o_orderkey FROM paid UNION ALL SELECT 'creditor_agent', 'BANK' || country || 'XX', country, 'BANK' || country || 'XX', amount, o_orderkey FROM paid)"""
_DOB = "trim(client_dob)"
_CONTENT = "client_id, client_type, client_first_name, client_last_name, client_maiden_name, client_aliases, client_company_name, client_dob, client_gender, client_is_deceased, nationality, residence, birth_country, registration_country, client_city, client_country, client_risk_rating, client_segment, client_relationship_start, client_status"
SQL = {
    "payment_parties": f"WITH {_PAYMENTS} SELECT role, country, count(*) AS parties, count(DISTINCT name) AS names, CAST(sum(amount) AS DOUBLE) AS amount FROM parties GROUP BY ALL",
    "distinct_payment_parties": f"WITH {_PAYMENTS} SELECT upper(name) AS name, country, coalesce(bic, '') AS bic, role AS roles, count(*) AS transactions FROM parties GROUP BY ALL",
    "payment_verdicts": f"WITH {_PAYMENTS} SELECT CASE WHEN c_custkey % 10 = 7 THEN 'HIT' ELSE 'PASS' END AS verdict, count(*) AS messages, count(*) FILTER (c_custkey % 10 = 7) AS hits FROM paid GROUP BY ALL",
    "variant_mining": f"""WITH {V.CLIENTS_SQL}, {V.WATCHLIST_SQL}, p AS (SELECT client_id, last_name AS a, split_part(primary_name, ' ', 2) AS b FROM clients JOIN watchlist
          ON first_name = split_part(primary_name, ' ', 1) AND substr(last_name, 1, 4) = substr(split_part(primary_name, ' ', 2), 1, 4) WHERE client_type = 'PP')
        SELECT least(a, b) AS low, greatest(a, b) AS high, count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT client_id))[1:5], ',') AS evidence FROM p WHERE a <> b GROUP BY ALL HAVING count(*) >= 2""",
    "parsed_names": r"""SELECT id, trim(split_part(n, ',', 1)) AS family, trim(regexp_extract(n, '^[^,]*,(.*)$', 1)) AS given FROM (
        SELECT id, trim(regexp_replace(primary_name, '[ \t\n\r\f]+', ' ', 'g')) AS n FROM watchlist_entities WHERE entity_type = 'I' AND primary_name LIKE '%,%')""",
    "canonical_names": f"""WITH {V.WATCHLIST_SQL}, c AS (SELECT unnest({V._list(V.FIRST)}) AS term, generate_subscripts({V._list(V.FIRST)}, 1) - 1 AS i)
        SELECT '#' || CAST(i % 5 AS VARCHAR) || ' ' || split_part(primary_name, ' ', 2) AS canonical, count(*) AS entities FROM watchlist JOIN c ON term = split_part(primary_name, ' ', 1) GROUP BY ALL""",
    "birth_dates": f"""SELECT CAST(year(coalesce(try_strptime({_DOB}, '%Y-%m-%d'), try_strptime({_DOB}, '%Y/%m/%d'), try_strptime({_DOB}, '%d/%m/%Y'), try_strptime({_DOB}, '%d.%m.%Y'),
        CASE WHEN regexp_matches({_DOB}, '^[0-9]{{4}}') THEN try_strptime(substr({_DOB}, 1, 4) || '-01-01', '%Y-%m-%d') END)) AS INTEGER) AS year, count(*) AS clients FROM client_entities GROUP BY ALL""",
    "client_countries": "SELECT value, count(*) AS clients FROM (SELECT upper(trim(unnest(regexp_split_to_array(nationality, '[,;]')))) AS value FROM client_entities) WHERE value <> '' GROUP BY ALL",
    "daily_digests": """SELECT recipient, strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM (SELECT ts, event_type, unnest(['u' || CAST(user_id % 7 AS VARCHAR), 'desk']) AS recipient FROM events) GROUP BY ALL""",
    "escalated": f"""WITH {V.ALERTS_SQL} SELECT CASE WHEN due_at < DATE '{NOW}' THEN 'OVERDUE' ELSE 'DUE_SOON' END AS reason, priority, count(*) AS alerts, min(due_at - DATE '{NOW}') AS least FROM alerts
        WHERE status IN ('OPEN', 'PENDING_VALIDATION') AND due_at - DATE '{NOW}' <= 2 GROUP BY ALL""",
    "client_checksums": f"SELECT copies, count(*) AS contents FROM (SELECT count(*) AS copies FROM client_entities GROUP BY {_CONTENT}) GROUP BY ALL",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls, round(sum(value), 2) AS value FROM events GROUP BY ALL",
}
