"""The alert desk: counters, indicators, series, work lists, searches and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import checkpointed

OPEN = ("OPEN", "IN_PROGRESS", "PENDING_VALIDATION")
CLOSED = ("CLOSED_CONFIRMED", "CLOSED_FALSE_POSITIVE", "CLOSED_BY_RULE")


def counters(alerts: DataFrame, now: Column) -> DataFrame:
    """Five counts in one pass; an alert without channel belongs to screening."""
    is_open, channel = F.col("status").isin(*OPEN), F.coalesce("channel", F.lit("SCREENING"))
    return alerts.agg(
        F.count_if(is_open).alias("open_total"),
        F.count_if(is_open & (channel == "SCREENING")).alias("open_screening"),
        F.count_if(is_open & (channel == "FILTERING")).alias("open_filtering"),
        F.count_if(F.col("status") == "PENDING_VALIDATION").alias("pending"),
        F.count_if(is_open & (F.col("due_at") < now)).alias("overdue"),
    )


def false_positive_rate(alerts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Closed alerts and the part of them that were false positives, in percent."""
    closed = F.col("status").isin("CLOSED_CONFIRMED", "CLOSED_FALSE_POSITIVE")
    return alerts.groupBy(*by).agg(
        F.count_if(closed).alias("closed"),
        F.round(100.0 * F.count_if(F.col("status") == "CLOSED_FALSE_POSITIVE") / F.nullif(F.count_if(closed), F.lit(0)), 2).alias("fp_rate"),
    )


def daily_series(alerts: DataFrame, first: str, last: str) -> DataFrame:
    """Alerts created by day and channel between two days; days without any show 0. The days are generated, not collected."""
    days = alerts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    made = alerts.where(F.col("created_at").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy(F.col("created_at").alias("day")).agg(
        F.count("*").alias("created"), F.count_if(F.col("channel") == "FILTERING").alias("filtering")
    )
    return days.join(made, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("filtering", F.lit(0)).alias("filtering"))


def workload(alerts: DataFrame, now: Column) -> DataFrame:
    """Open alerts of each analyst by priority, how many are overdue, and the next day due."""
    by = {p: F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("CRITICAL", "HIGH", "MEDIUM", "LOW")}
    return alerts.where(F.col("status").isin(*OPEN)).groupBy("analyst").agg(
        *by.values(), F.count_if(F.col("due_at") < now).alias("overdue"), F.date_format(F.min("due_at"), "yyyy-MM-dd").alias("next_due")
    )


def recent_delay(decisions: DataFrame, analysts: DataFrame, last: int = 200) -> DataFrame:
    """Mean hours of each analyst's last decisions, to one decimal. Windows keep only the rows they rank (no sort of full history)."""
    latest = Window.partitionBy("analyst").orderBy(F.desc("decided_at"), F.desc("decision_id"))
    ranked = decisions.join(analysts, "alert_id").withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= last)
    return ranked.groupBy("analyst").agg(F.count("*").alias("decisions"), F.round(F.avg("hours"), 1).alias("mean_hours"))


def page(rows: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """One page of an ordered listing, the first being 1."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def keyset(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next rows after a key; the key condition reaches the scan."""
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def search(rows: DataFrame, name: str, text: str, size: int) -> DataFrame:
    """Rows whose name contains a text, those that begin with it first."""
    low = F.lower(F.col(name))
    begins = F.when(low.startswith(text.lower()), 0).otherwise(1)
    return rows.where(low.contains(text.lower())).orderBy(begins, name, *[c for c in rows.columns if c != name]).limit(size)


def fill_rates(rows: DataFrame, fields: Sequence[str], by: str) -> DataFrame:
    """Percent of non-blank values of each field by group, one row per group and field."""
    rates = rows.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.trim(F.col(f).cast("string")) != "").alias(f) for f in fields))
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return rates.selectExpr(by, "n", f"stack({len(fields)}, {pairs}) as (field, filled)").select(by, "field", F.round(F.col("filled") * 100.0 / F.col("n"), 2).alias("fill_rate"))


def gained_lost(before: DataFrame, after: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Pairs gained and lost between two runs, by group."""
    b, a = before.withColumn("was", F.lit(1)), after.withColumn("isnow", F.lit(1))
    both = b.join(a, [*keys, by], "full_outer")
    return both.groupBy(by).agg(F.count_if(F.col("was").isNull()).alias("gained"), F.count_if(F.col("isnow").isNull()).alias("lost"), F.count_if(F.col("was").isNotNull() & F.col("isnow").isNotNull()).alias("kept"))


def inherited_risk(edges: DataFrame, designated: DataFrame, threshold: int = 50, depth: int = 6, circles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(target, total_pct, level): parties owned to at least `threshold` percent by designated ones, directly, together or through others.

    edges: target, owner, pct (null counts as full, as the source asserts it); repeated edges count once with their highest share. designated: owner.
    circles: stakes (target, circle, pct) and members (circle, owner) stand for edges from each target of a circle to each of its members, which are counted and
    never listed; an owner is in one circle, and no edge repeats one of them.
    Each level adds targets whose owners designated so far hold enough; it ends when none is added, at most `depth` times. Only ids move.
    """
    best = edges.groupBy("target", "owner").agg(F.max(F.coalesce("pct", F.lit(100))).alias("pct"))
    stakes = circles[0].groupBy("target", "circle").agg(F.max(F.coalesce("pct", F.lit(100))).alias("pct")) if circles else None
    members = circles[1].distinct() if circles else None
    known = designated.select("owner").distinct()
    found = None
    for level in range(1, depth + 1):
        shares = best.join(known, "owner", "left_semi").select("target", F.col("pct").cast("bigint").alias("pct"))
        if circles:
            inside = members.join(known, "owner", "left_semi").groupBy("circle").agg(F.count("*").alias("n"))
            shares = shares.unionByName(stakes.join(inside, "circle").select("target", (F.col("pct") * F.col("n")).alias("pct")))
        held = shares.groupBy("target").agg(F.sum("pct").alias("total_pct")).where(F.col("total_pct") >= threshold)
        new = held.join(known.select(F.col("owner").alias("target")), "target", "left_anti").withColumn("level", F.lit(level))
        new = checkpointed(new)
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        known = known.unionByName(new.select(F.col("target").alias("owner")))
    return found if found is not None else checkpointed(best.limit(0).select("target", F.col("pct").cast("bigint").alias("total_pct"), F.lit(0).alias("level")))


def neighbours(edges: DataFrame, start: str, depth: int, circles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(node, depth): what is within `depth` edges of a node, in both directions.

    circles: stakes (target, circle) and members (circle, owner) stand for edges from each target of a circle to each of its members; the step from one side to the other goes by circle.
    """
    both = edges.select(F.col("target").alias("from"), F.col("owner").alias("to")).unionByName(edges.select(F.col("owner").alias("from"), F.col("target").alias("to"))).distinct()
    reached = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("depth"))
    for i in range(1, depth + 1):
        front = reached.where(F.col("depth") == i - 1)
        step = both.join(front, both["from"] == front["node"]).select(F.col("to").alias("node"))
        if circles:
            targets, owners = circles[0].select("circle", F.col("target").alias("node")), circles[1].select("circle", F.col("owner").alias("node"))
            for this, other in ((targets, owners), (owners, targets)):
                step = step.unionByName(other.join(this.join(front, "node", "left_semi").select("circle").distinct(), "circle").select("node"))
        reached = reached.unionByName(step.distinct().withColumn("depth", F.lit(i))).groupBy("node").agg(F.min("depth").alias("depth"))
    return reached


def states(events: DataFrame) -> DataFrame:
    """Last status of each alert from its history of events (key, seq, status), and how many there were; ties by status."""
    return events.groupBy("key").agg(F.max(F.struct("seq", "status"))["status"].alias("status"), F.count("*").alias("events"))
