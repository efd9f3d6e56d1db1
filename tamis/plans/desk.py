"""Queries over alerts, decisions, owners, clients and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import desk
from tamis.operators.quality import client_quality
from tamis.operators.rarity import document_frequency, rarity_profile
from tamis.plans import views as V
from tamis.session import clean_id, table

NOW = "1998-06-15"


def _now():
    return F.lit(NOW).cast("date")


def alert_counters(spark: SparkSession, d: str) -> DataFrame:
    return desk.counters(V.alerts(spark, d), _now())


def kpi_by_status(spark: SparkSession, d: str) -> DataFrame:
    return V.alerts(spark, d).groupBy("status", "priority").agg(F.count("*").alias("alerts"), F.countDistinct("client_id").alias("clients"))


def fp_rate_by_analyst(spark: SparkSession, d: str) -> DataFrame:
    return desk.false_positive_rate(V.alerts(spark, d), ["analyst"])


def daily_created(spark: SparkSession, d: str) -> DataFrame:
    return desk.daily_series(V.alerts(spark, d), "2001-07-10", "2001-08-08")


def analyst_workload(spark: SparkSession, d: str) -> DataFrame:
    return desk.workload(V.alerts(spark, d), _now())


def analyst_delay(spark: SparkSession, d: str) -> DataFrame:
    return desk.recent_delay(V.decisions(spark, d), V.alerts(spark, d).select("alert_id", "analyst"))


def overdue_by_priority(spark: SparkSession, d: str) -> DataFrame:
    a = V.alerts(spark, d).where(F.col("status").isin(*desk.OPEN) & (F.col("due_at") < _now()))
    return a.groupBy("priority").agg(F.count("*").alias("overdue"), F.max(F.datediff(_now(), "due_at")).alias("most_days"))


def activity_report(spark: SparkSession, d: str) -> DataFrame:
    """Sections of one period as (section, indicator, value)."""
    period = lambda c: F.col(c).between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    created = V.alerts(spark, d).where(period("created_at"))
    part = lambda df, s, i: df.groupBy(F.col(i).alias("indicator")).agg(F.count("*").alias("value")).select(F.lit(s).alias("section"), "indicator", "value")
    decided = V.decisions(spark, d).where(period("decided_at")).withColumn("band", F.when(F.col("score") >= 95, "HIGH").when(F.col("score") >= 80, "MEDIUM").otherwise("LOW"))
    return part(created, "alerts", "status").unionByName(part(created, "priorities", "priority")).unionByName(part(decided, "decisions", "band"))


def oldest_open(spark: SparkSession, d: str) -> DataFrame:
    a = V.alerts(spark, d).where("status = 'OPEN'")
    return a.orderBy("created_at", "alert_id").limit(5).select("alert_id", "priority", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def work_queue(spark: SparkSession, d: str) -> DataFrame:
    """Third page of the open alerts, by priority, then age."""
    rank = F.when(F.col("priority") == "CRITICAL", 0).when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2).otherwise(3)
    rows = V.alerts(spark, d).where(F.col("status").isin(*desk.OPEN))
    return desk.page(rows, [rank, F.col("created_at"), F.col("alert_id")], 3, 50).select("alert_id", "priority", F.date_format("due_at", "yyyy-MM-dd").alias("due"))


def cursor_chunk(spark: SparkSession, d: str) -> DataFrame:
    return desk.keyset(V.watchlist(spark, d).select("k", "entity_id", "primary_name"), "k", 120, 100)


def quick_search(spark: SparkSession, d: str) -> DataFrame:
    return desk.search(V.watchlist(spark, d).select("primary_name", "entity_id"), "primary_name", "ma", 40)


def webhook_stats(spark: SparkSession, d: str) -> DataFrame:
    """Calls by endpoint: distinct callers, errors, repeated idempotency keys."""
    e = table(spark, d, "events").withColumn("token", F.get_json_object("props", "$.k"))
    return e.groupBy(F.col("event_type").alias("endpoint")).agg(
        F.count("*").alias("calls"), F.countDistinct("user_id").alias("callers"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("token").alias("tokens")
    )


def webhook_daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("value"), F.count_if(F.col("event_type") == "error").alias("errors"))


def retention_preview(spark: SparkSession, d: str) -> DataFrame:
    """Decisions beyond retention by family; those that open alerts refer to stay. Null alert ids hide nothing."""
    limit = F.lit("1999-01-01").cast("date")
    open_alerts = V.alerts(spark, d).where(F.col("status").isin(*desk.OPEN)).select("alert_id")
    old = V.decisions(spark, d).where(F.col("decided_at") < limit)
    purge = old.join(open_alerts, "alert_id", "left_anti")
    return purge.groupBy(F.when(F.col("score") >= 75, "alert").otherwise("no_match").alias("family")).agg(F.count("*").alias("purgeable"), F.min("decision_id").alias("first_id"))


def client_overview(spark: SparkSession, d: str) -> DataFrame:
    """Alerts and decisions of every client, clients without any included."""
    a = V.alerts(spark, d)
    by_client = a.groupBy("client_id").agg(F.count("*").alias("alerts"), F.count_if(F.col("status").isin(*desk.OPEN)).alias("open"))
    made = V.decisions(spark, d).join(a.select("alert_id", "client_id"), "alert_id").groupBy("client_id").agg(F.count("*").alias("decisions"), F.max("score").alias("top_score"))
    c = V.clients(spark, d).select(F.col("k").alias("client_id"), "segment")
    return c.join(by_client, "client_id", "left").join(made, "client_id", "left").select("client_id", "segment", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("decisions", F.lit(0)).alias("decisions"), "top_score")


def kpi_cube(spark: SparkSession, d: str) -> DataFrame:
    """Extension: alerts by every combination of status and priority with subtotals."""
    return V.alerts(spark, d).cube("status", "priority").agg(F.count("*").alias("alerts")).select(F.coalesce("status", F.lit("ALL")).alias("status"), F.coalesce("priority", F.lit("ALL")).alias("priority"), "alerts")


def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return V.decisions(spark, d).groupBy((F.floor(F.col("score") / 5) * 5).cast("int").alias("band")).agg(F.count("*").alias("decisions"), F.round(F.avg("hours"), 4).alias("mean_hours"))


def ownership_risk(spark: SparkSession, d: str) -> DataFrame:
    edges, stakes, members = V.owners(spark, d)
    listed = edges.select("owner").unionByName(members.select("owner")).where(F.col("owner").rlike("^W[0-9]*[05]$"))
    return desk.inherited_risk(edges, listed, circles=(stakes, members))


def ownership_graph(spark: SparkSession, d: str) -> DataFrame:
    edges, stakes, members = V.owners(spark, d)
    return desk.neighbours(edges, "C10", 2, (stakes, members))


def client_fill_rates(spark: SparkSession, d: str) -> DataFrame:
    fields = ["client_dob", "nationality", "residence", "birth_country", "client_city", "client_risk_rating"]
    return desk.fill_rates(table(spark, d, "client_entities").where("client_type is not null"), fields, "client_type")


def client_quality_codes(spark: SparkSession, d: str) -> DataFrame:
    """How many client rows have each error and warning."""
    q = client_quality(table(spark, d, "client_entities"))
    return q.select(F.explode(F.concat("errors", "warnings")).alias("code")).groupBy("code").agg(F.count("*").alias("rows"))


def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return document_frequency(V.watchlist(spark, d), "primary_name", "entity_id")


def name_rarity(spark: SparkSession, d: str) -> DataFrame:
    listed = V.watchlist(spark, d)
    return rarity_profile(listed, document_frequency(listed, "primary_name", "entity_id"), listed.count(), "entity_id", "primary_name")


def deliveries_by_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snapshots").groupBy("file_type", "status").agg(F.count("*").alias("deliveries"), F.sum("record_count").alias("records"))


def latest_ready(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snapshots").where("status = 'READY'").groupBy("file_type").agg(F.max_by("snapshot_id", F.struct("uploaded_at", "snapshot_id")).alias("snapshot_id"))


def entities_by_type(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "watchlist_entities").withColumn("sid", clean_id("snapshot_id"))
    s = table(spark, d, "snapshots").select(clean_id("snapshot_id").alias("sid"), "file_type", "status")
    return e.join(s, "sid").where(~F.coalesce("excluded", F.lit(False))).groupBy("file_type", "status", "entity_type").agg(F.count("*").alias("rows"), F.countDistinct(clean_id("entity_id")).alias("entities"))


def country_lens(spark: SparkSession, d: str) -> DataFrame:
    """Highest tier of any listed country by list; tiers by region of the nation table."""
    tiers = table(spark, d, "nation").select(V.pick(V.CC, F.col("n_nationkey")).alias("citizenship"), (F.col("n_regionkey") % 3).alias("tier"))
    return V.watchlist(spark, d).join(tiers, "citizenship", "left").groupBy("list_type").agg(F.max("tier").alias("highest"), F.count_if(F.col("tier") == 2).alias("high"), F.count_if(F.col("tier").isNull()).alias("unknown"))


def alert_state_fold(spark: SparkSession, d: str) -> DataFrame:
    """Status of each alert folded from its decisions as events."""
    e = V.decisions(spark, d).select(F.col("alert_id").alias("key"), F.col("decision_id").alias("seq"), F.when(F.col("score") > 90, "CLOSED_CONFIRMED").when(F.col("score") > 60, "IN_PROGRESS").otherwise("OPEN").alias("status"))
    return desk.states(e).groupBy("status").agg(F.count("*").alias("alerts"), F.sum("events").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        alert_counters, kpi_by_status, fp_rate_by_analyst, daily_created, analyst_workload, analyst_delay, overdue_by_priority, activity_report, oldest_open, work_queue, cursor_chunk, quick_search,
        webhook_stats, webhook_daily, retention_preview, client_overview, kpi_cube, score_bands, ownership_risk, ownership_graph, client_fill_rates, client_quality_codes, token_frequency, name_rarity,
        deliveries_by_state, latest_ready, entities_by_type, country_lens, alert_state_fold,
    )
}

_OPEN = "status IN ('OPEN', 'IN_PROGRESS', 'PENDING_VALIDATION')"
_W = f"WITH {V.ALERTS_SQL}"
_FILL = ["client_dob", "nationality", "residence", "birth_country", "client_city", "client_risk_rating"]
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_PERSON_NAME = "concat_ws(' ', client_first_name, client_last_name)"
_QUALITY = {
    "B01": "(client_type = 'PP' AND coalesce(trim(client_last_name), '') = '') OR (client_type = 'PM' AND coalesce(trim(client_company_name), '') = '')",
    "B02": "coalesce(client_type, '') NOT IN ('PP', 'PM')",
    "B04": "client_type = 'PP' AND coalesce(trim(client_first_name), '') = '' AND coalesce(trim(client_last_name), '') = ''",
    "B05": r"coalesce(trim(name), '') <> '' AND length(regexp_replace(name, '[^\p{L}\p{N}]', '', 'g')) < 2",
    "M01": " AND ".join(f"coalesce(trim({c}), '') = ''" for c in ("nationality", "residence", "birth_country", "registration_country")),
    "M02": "client_type = 'PP' AND NOT coalesce(client_is_deceased, false) AND coalesce(trim(client_dob), '') = ''",
    "M03": r"regexp_matches(name, '[\p{Cyrillic}\p{Greek}\p{Arabic}\p{Han}]')",
    "M05": r"coalesce(trim(client_dob), '') <> '' AND NOT regexp_matches(client_dob, '^\d{4}-\d{2}-\d{2}$')",
}
_TOKENS = f"""tokens AS (SELECT DISTINCT entity_id, unnest(string_split(trim(regexp_replace(upper(primary_name), '[^A-Z0-9]+', ' ', 'g')), ' ')) AS token FROM watchlist),
df AS (SELECT token, count(*) AS df FROM tokens WHERE length(token) >= 2 GROUP BY token HAVING count(*) >= 3 ORDER BY df DESC, token LIMIT 20000)"""
_RISK_LEVELS = "\n".join(
    f""", l{i} AS (SELECT target, sum(pct) AS total_pct, {i} AS level FROM best WHERE owner IN (SELECT owner FROM k{i - 1}) GROUP BY target
      HAVING sum(pct) >= 50 AND target NOT IN (SELECT owner FROM k{i - 1})),
    k{i} AS (SELECT owner FROM k{i - 1} UNION SELECT target FROM l{i})"""
    for i in range(1, 7)
)
SQL = {
    "alert_counters": f"""{_W} SELECT count(*) FILTER ({_OPEN}) AS open_total, count(*) FILTER ({_OPEN} AND coalesce(channel, 'SCREENING') = 'SCREENING') AS open_screening,
        count(*) FILTER ({_OPEN} AND channel = 'FILTERING') AS open_filtering, count(*) FILTER (status = 'PENDING_VALIDATION') AS pending, count(*) FILTER ({_OPEN} AND due_at < DATE '{NOW}') AS overdue FROM alerts""",
    "kpi_by_status": f"{_W} SELECT status, priority, count(*) AS alerts, count(DISTINCT client_id) AS clients FROM alerts GROUP BY ALL",
    "fp_rate_by_analyst": f"""{_W} SELECT analyst, count(*) FILTER (status IN ('CLOSED_CONFIRMED', 'CLOSED_FALSE_POSITIVE')) AS closed,
        round(100.0 * count(*) FILTER (status = 'CLOSED_FALSE_POSITIVE') / nullif(count(*) FILTER (status IN ('CLOSED_CONFIRMED', 'CLOSED_FALSE_POSITIVE')), 0), 2) AS fp_rate FROM alerts GROUP BY analyst""",
    "daily_created": f"""{_W}, days AS (SELECT unnest(generate_series(DATE '2001-07-10', DATE '2001-08-08', INTERVAL 1 DAY)) AS day)
        SELECT strftime(day, '%Y-%m-%d') AS day, count(alert_id) AS created, count(*) FILTER (channel = 'FILTERING') AS filtering FROM days LEFT JOIN alerts ON created_at = day GROUP BY ALL""",
    "analyst_workload": f"""{_W} SELECT analyst, {', '.join(f"count(*) FILTER (priority = '{p}') AS {p.lower()}" for p in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'))},
        count(*) FILTER (due_at < DATE '{NOW}') AS overdue, strftime(min(due_at), '%Y-%m-%d') AS next_due FROM alerts WHERE {_OPEN} GROUP BY analyst""",
    "analyst_delay": f"""{_W}, {V.DECISIONS_SQL}, ranked AS (SELECT analyst, hours, row_number() OVER (PARTITION BY analyst ORDER BY decided_at DESC, decision_id DESC) AS n FROM decisions JOIN alerts USING (alert_id))
        SELECT analyst, count(*) AS decisions, round(avg(hours), 1) AS mean_hours FROM ranked WHERE n <= 200 GROUP BY analyst""",
    "overdue_by_priority": f"{_W} SELECT priority, count(*) AS overdue, max(DATE '{NOW}' - due_at) AS most_days FROM alerts WHERE {_OPEN} AND due_at < DATE '{NOW}' GROUP BY priority",
    "activity_report": f"""{_W}, {V.DECISIONS_SQL}, made AS (SELECT * FROM alerts WHERE created_at BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')
        SELECT 'alerts' AS section, status AS indicator, count(*) AS value FROM made GROUP BY ALL UNION ALL SELECT 'priorities', priority, count(*) FROM made GROUP BY ALL
        UNION ALL SELECT 'decisions', CASE WHEN score >= 95 THEN 'HIGH' WHEN score >= 80 THEN 'MEDIUM' ELSE 'LOW' END, count(*) FROM decisions WHERE decided_at BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY ALL""",
    "oldest_open": f"{_W} SELECT alert_id, priority, strftime(created_at, '%Y-%m-%d') AS created FROM (SELECT * FROM alerts WHERE status = 'OPEN' ORDER BY created_at, alert_id LIMIT 5)",
    "work_queue": f"""{_W} SELECT alert_id, priority, strftime(due_at, '%Y-%m-%d') AS due FROM (SELECT * FROM alerts WHERE {_OPEN}
        ORDER BY CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, created_at, alert_id LIMIT 50 OFFSET 100)""",
    "cursor_chunk": f"WITH {V.WATCHLIST_SQL} SELECT k, entity_id, primary_name FROM watchlist WHERE k > 120 ORDER BY k LIMIT 100",
    "quick_search": f"""WITH {V.WATCHLIST_SQL} SELECT primary_name, entity_id FROM watchlist WHERE contains(lower(primary_name), 'ma')
        ORDER BY CASE WHEN starts_with(lower(primary_name), 'ma') THEN 0 ELSE 1 END, primary_name, entity_id LIMIT 40""",
    "webhook_stats": """SELECT event_type AS endpoint, count(*) AS calls, count(DISTINCT user_id) AS callers, count(*) FILTER (event_type = 'error') AS errors,
        count(DISTINCT json_extract_string(props, '$.k')) AS tokens FROM events GROUP BY ALL""",
    "webhook_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(value), 2) AS value, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL",
    "retention_preview": f"""{_W}, {V.DECISIONS_SQL} SELECT CASE WHEN score >= 75 THEN 'alert' ELSE 'no_match' END AS family, count(*) AS purgeable, min(decision_id) AS first_id FROM decisions o
        WHERE decided_at < DATE '1999-01-01' AND NOT EXISTS (SELECT 1 FROM alerts a WHERE {_OPEN} AND a.alert_id = o.alert_id) GROUP BY ALL""",
    "client_overview": f"""{_W}, {V.DECISIONS_SQL}, a AS (SELECT client_id, count(*) AS alerts, count(*) FILTER ({_OPEN}) AS open FROM alerts GROUP BY ALL),
        m AS (SELECT client_id, count(*) AS decisions, max(score) AS top_score FROM decisions JOIN alerts USING (alert_id) GROUP BY ALL)
        SELECT c_custkey AS client_id, c_mktsegment AS segment, coalesce(alerts, 0) AS alerts, coalesce(open, 0) AS open, coalesce(decisions, 0) AS decisions, top_score
        FROM customer LEFT JOIN a ON a.client_id = c_custkey LEFT JOIN m ON m.client_id = c_custkey""",
    "kpi_cube": f"{_W} SELECT coalesce(status, 'ALL') AS status, coalesce(priority, 'ALL') AS priority, count(*) AS alerts FROM alerts GROUP BY CUBE (alerts.status, alerts.priority)",
    "score_bands": f"WITH {V.DECISIONS_SQL} SELECT CAST(floor(score / 5) * 5 AS INTEGER) AS band, count(*) AS decisions, round(avg(hours), 4) AS mean_hours FROM decisions GROUP BY ALL",
    "ownership_risk": f"""WITH {V.OWNERS_SQL}, best AS (SELECT target, owner, max(coalesce(pct, 100)) AS pct FROM owners GROUP BY ALL),
        k0 AS (SELECT DISTINCT owner FROM owners WHERE regexp_matches(owner, '^W[0-9]*[05]$')) {_RISK_LEVELS}
        {' UNION ALL '.join(f'SELECT target, CAST(total_pct AS BIGINT) AS total_pct, level FROM l{i}' for i in range(1, 7))}""",
    "ownership_graph": f"""WITH RECURSIVE {V.OWNERS_SQL}, both_ways AS (SELECT target AS a, owner AS b FROM owners UNION SELECT owner, target FROM owners),
        reached AS (SELECT 'C10' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM reached JOIN both_ways ON a = node WHERE depth < 2) SELECT node, min(depth) AS depth FROM reached GROUP BY node""",
    "client_fill_rates": " UNION ALL ".join(
        f"SELECT client_type, '{f}' AS field, round(count(*) FILTER (trim({f}) <> '') * 100.0 / count(*), 2) AS fill_rate FROM client_entities WHERE client_type IS NOT NULL GROUP BY client_type" for f in _FILL
    ),
    "client_quality_codes": f"WITH named AS (SELECT *, CASE WHEN client_type = 'PM' THEN client_company_name ELSE {_PERSON_NAME} END AS name FROM client_entities) "
    + " UNION ALL ".join(f"SELECT '{code}' AS code, count(*) AS rows FROM named WHERE {test} HAVING count(*) > 0" for code, test in _QUALITY.items()),
    "token_frequency": f"WITH {V.WATCHLIST_SQL}, {_TOKENS} SELECT * FROM df",
    "name_rarity": f"""WITH {V.WATCHLIST_SQL}, {_TOKENS}, n AS (SELECT count(*) AS n FROM watchlist)
        SELECT entity_id, round(sum(ln(n / coalesce(df, greatest(1, (SELECT min(df) FROM df) - 1)))), 6) AS idf_sum, max(coalesce(df, greatest(1, (SELECT min(df) FROM df) - 1))) AS most_common,
          min(coalesce(df, greatest(1, (SELECT min(df) FROM df) - 1))) AS least_common, bool_and(coalesce(df, greatest(1, (SELECT min(df) FROM df) - 1)) >= greatest(25, floor(n * 0.0025))) AS common
        FROM tokens LEFT JOIN df USING (token), n WHERE length(token) >= 2 GROUP BY entity_id""",
    "deliveries_by_state": "SELECT file_type, status, count(*) AS deliveries, CAST(sum(record_count) AS BIGINT) AS records FROM snapshots GROUP BY ALL",
    "latest_ready": "SELECT file_type, max_by(snapshot_id, (uploaded_at, snapshot_id)) AS snapshot_id FROM snapshots WHERE status = 'READY' GROUP BY ALL",
    "entities_by_type": f"""SELECT file_type, status, entity_type, count(*) AS rows, count(DISTINCT {_TRIM.format('entity_id')}) AS entities FROM watchlist_entities e
        JOIN snapshots s ON {_TRIM.format('e.snapshot_id')} = {_TRIM.format('s.snapshot_id')} WHERE NOT coalesce(excluded, false) GROUP BY ALL""",
    "country_lens": f"""WITH {V.WATCHLIST_SQL}, tiers AS (SELECT {V._pick(V.CC, 'n_nationkey')} AS citizenship, n_regionkey % 3 AS tier FROM nation)
        SELECT list_type, max(tier) AS highest, count(*) FILTER (tier = 2) AS high, count(*) FILTER (tier IS NULL) AS unknown FROM watchlist LEFT JOIN tiers USING (citizenship) GROUP BY ALL""",
    "alert_state_fold": "WITH " + V.DECISIONS_SQL + """, f AS (SELECT alert_id, struct_extract(max({'q': decision_id, 's': CASE WHEN score > 90 THEN 'CLOSED_CONFIRMED' WHEN score > 60 THEN 'IN_PROGRESS' ELSE 'OPEN' END}), 's') AS status, count(*) AS events FROM decisions GROUP BY ALL)
        SELECT status, count(*) AS alerts, CAST(sum(events) AS BIGINT) AS events FROM f GROUP BY ALL""",
}
