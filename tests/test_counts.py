"""Counts over pairs that are too many to list."""

import itertools
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tamis.operators import desk
from tamis.operators import flows as op_flows
from tamis.operators import screening as S
from tamis.plans import flows, screening
from tamis.plans import views as V


def test_candidates_are_counted_without_listing_them(spark):
    r = random.Random(8)
    sides = [[(i, r.sample("abcde", r.randrange(4))) for i in range(60)] for _ in "xy"]
    clients = spark.createDataFrame([*sides[0], sides[0][0]], "client_id int, keys array<string>")
    listed = spark.createDataFrame([(i, k, "EU" if i % 3 else "UN") for i, k in sides[1]], "entity_id int, keys array<string>, list_type string")
    met = [(c, "EU" if e % 3 else "UN") for (c, x), (e, y) in itertools.product(*sides) if set(x) & set(y)]
    want = {(t, sum(u == t for _, u in met), len({c for c, u in met if u == t})) for t in ("EU", "UN")}
    assert {tuple(x) for x in S.counted_candidates(clients, listed, ["list_type"]).collect()} == want
    many = spark.range(200_000)
    clients, listed = many.select(F.col("id").alias("client_id"), F.array(F.lit("k")).alias("keys")), many.select(F.col("id").alias("entity_id"), F.array(F.lit("k")).alias("keys"), F.lit("EU").alias("list_type"))
    assert tuple(S.counted_candidates(clients, listed, ["list_type"]).first()) == ("EU", 200_000**2, 200_000)


def test_adjustments_are_counted_without_listing_pairs(spark):
    r = random.Random(9)
    day = lambda: r.choice([None, "1960", "1960-01-01", "1961-12-31", "1962-01-01", "1958-01-01", "1990-05-05"])
    some = lambda x: [] if x is None else [x]
    ours = [(i, r.sample("abc", r.randrange(4)), some(day()), r.choice("MFU"), some(r.choice([None, "FR", "DE"]))) for i in range(70)]
    theirs = [(i, r.sample("abc", r.randrange(4)), some(day()), some(r.choice([None, *"MFU"])), some(r.choice([None, "FR", "DE"]))) for i in range(50)]
    c = spark.createDataFrame(ours, "client_id int, keys array<string>, client_dates array<string>, client_gender string, client_countries array<string>")
    w = spark.createDataFrame(theirs, "entity_id int, keys array<string>, listed_dates array<string>, listed_genders array<string>, listed_countries array<string>")
    for config in (S.EngineConfig(), S.EngineConfig(dob_years=1.0, missing_country_is_neutral=True), S.EngineConfig(off=frozenset({"adjust.gender"}))):
        p = S.candidates(c, w).join(c.drop("keys"), "client_id").join(w.drop("keys"), "entity_id")
        rows = p.select(
            S.dob_adjustment(F.col("client_dates"), F.col("listed_dates"), config), S.gender_adjustment(F.col("client_gender"), F.col("listed_genders"), config),
            S.country_adjustment(F.col("client_countries"), F.col("listed_countries"), config),
        )
        want = Counter(tuple(x) for x in rows.collect())
        assert {tuple(x)[:3]: x.pairs for x in S.counted_adjustments(c, w, config).collect()} == want


@pytest.fixture(scope="module")
def few_names(tmp_path_factory):
    """Tables of 80,000 clients and 80,000 listed parties with two names each: 3.2 billion pairs of them are alike."""
    d = tmp_path_factory.mktemp("few")
    for t, rows in {
        "customer": "select 744 * (i // 2) + i % 2 as c_custkey, cast(i % 25 as int) as c_nationkey, 'S' as c_mktsegment from range(80000) r(i)",
        "part": "select 744 * (i // 2) + 341 * (i % 2) as p_partkey from range(80000) r(i)",
        "supplier": "select i as s_suppkey from range(0) r(i)",
    }.items():
        duckdb.execute(f"copy ({rows}) to '{d}/{t}.parquet' (format parquet)")
    return str(d)


OURS = [k for i in range(80000) if (k := 744 * (i // 2) + i % 2) % 10 != 9]
ODD, EVEN = [k for k in OURS if k % 744], [k for k in OURS if k % 744 == 0]
THEIRS = [744 * i + 341 for i in range(40000)]


def test_whitelist_is_counted_by_name(spark, few_names):
    """ODD clients are called like THEIRS; the others miss their X."""
    want, ours = Counter(), Counter(k % 420 for k in ODD)
    for (w, t), m in Counter((k % 420, k % 5) for k in THEIRS).items():
        want[V.LISTS[t]] += sum(n * m for c, n in ours.items() if not ((c + w) % 20 == 0 and (c + w) % 7 and (c + w) % 3))
    assert {r.list_type: r.pairs for r in screening.whitelist_pairs(spark, few_names).collect()} == want


def test_alerts_are_merged_by_name(spark, few_names):
    want, top = Counter(), {}
    for k in THEIRS:
        old, new = k % 3 != 0, k % 5 != 0
        status = ("CLOSED_FALSE_POSITIVE", "CLOSED_BY_RULE", "OPEN", "OPEN")[k % 4] if old else None
        score = 80 + k % 20
        rows = [(status, 0, score - 5)] if status == "CLOSED_FALSE_POSITIVE" else []
        if new:
            live = old and not rows
            rows.append((status if live else "OPEN", int(live), score))
        elif old and not rows:
            rows.append((status, 0, score - 5))
        for s, n, best in rows:
            want[s, n] += len(ODD)
            top[s, n] = max(top.get((s, n), 0), best)
    assert {(r.status, r.redetections): (r.alerts, r.top) for r in screening.alert_merge(spark, few_names).collect()} == {x: (want[x], top[x]) for x in want}


def test_variants_are_mined_by_name(spark, few_names):
    (r,) = flows.variant_mining(spark, few_names).collect()
    assert (r.low, r.high, r.occurrences) == ("ALMEIDA", "ALMEIDAX", len(EVEN) * 40000)
    assert r.evidence == ",".join(sorted("C" + str(k).rjust(7, "0")[:7] for k in EVEN)[:5])


def test_variants_by_name_are_those_of_all_pairs(spark):
    r = random.Random(10)
    word = lambda: "".join(r.choices("ab", k=2))
    left = spark.createDataFrame([(f"X {word()}", r.choice([None, f"e{i % 40}"]), "k") for i in range(90)], "a string, e string, k string")
    right = spark.createDataFrame([(f"X {word()}", "k") for i in range(50)], "b string, k string")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    assert rows(op_flows.mined_variants_by_name(left, right, ["k"], "a", "b", "e")) == rows(op_flows.mined_variants(left.join(right, "k"), "a", "b", "e"))


@pytest.fixture(scope="module")
def owned(spark):
    """Edges, stakes, members, and all of them as edges."""
    r = random.Random(11)
    edges = spark.createDataFrame([(f"c{r.randrange(30)}", f"c{r.randrange(30)}", r.choice([None, 20, 60])) for _ in range(12)], "target string, owner string, pct int")
    stakes = spark.createDataFrame([(f"c{r.randrange(30)}", r.randrange(6), r.choice([None, 15, 25, 30])) for _ in range(25)], "target string, circle int, pct int")
    members = spark.createDataFrame([(i % 5, f"w{i}") for i in range(20)], "circle int, owner string")
    return edges, stakes, members, edges.unionByName(stakes.join(members, "circle").select("target", "owner", "pct"))


def test_steps_through_circles(spark, owned):
    edges, stakes, members, listed = owned
    for start, depth in (("c1", 1), ("c1", 2), ("w3", 1), ("w3", 3), ("none", 2)):
        assert set(desk.neighbours(edges, start, depth, (stakes, members)).collect()) == set(desk.neighbours(listed, start, depth).collect())
    many = spark.range(200_000)
    stakes, members = many.select(F.concat(F.lit("c"), "id").alias("target"), F.lit(1).alias("circle")), many.select(F.lit(1).alias("circle"), F.concat(F.lit("w"), "id").alias("owner"))
    assert desk.neighbours(edges, "c7", 1, (stakes, members)).where("node like 'w%'").count() == 200_000


def test_shares_held_through_circles(spark, owned):
    edges, stakes, members, listed = owned
    stakes = stakes.groupBy("target", "circle").agg(F.max(F.coalesce("pct", F.lit(100))).alias("pct"))
    some = members.select("owner").where("owner in ('w0', 'w1', 'w5', 'w6', 'w12')")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    want = rows(desk.inherited_risk(listed, some))
    assert len({r[2] for r in want}) > 1 and rows(desk.inherited_risk(edges, some, circles=(stakes, members))) == want


@pytest.mark.parametrize("config", [S.EngineConfig(), S.EngineConfig(dob_years=1.0, cut_off=40.0, cut_off_by_list={"EU": 90.0, "UN": 101.0}), S.EngineConfig(missing_country_is_neutral=True, off=frozenset({"adjust.dob", "hard.passport"}))])
def test_summaries_are_those_of_all_pairs(spark, config, monkeypatch):
    """Several clients of a set, keys in common more than once, equal scores, shared papers, rows without id, and keys in several blocks."""
    monkeypatch.setattr(S, "BLOCK", 20)
    r = random.Random(12)
    some = lambda x: [] if x is None else [x]
    day = lambda: r.choice([None, "x", "1960", "1960-01-01", "1961-12-31", "1962-01-01", "1958-01-01", "1990-05-05", f"19{r.randrange(58, 64)}-03-04"])
    names = lambda: r.sample(["ADA ROSSI", "ADA ROSSY", "HUGO CHEN", "ROSSI ADA", "CHEN"], r.randrange(3))
    papers = lambda: [(r.choice("123"), "FR")] if r.random() < 0.3 else []
    ours = [(r.choice([None, f"c{i // 2}", f"c{i}"]), r.sample("abc", r.randrange(4)), names(), some(day()), r.choice([None, *"MFU"]), some(r.choice([None, "FR", "DE"])), papers()) for i in range(150)]
    theirs = [(r.choice([None, f"w{i}", f"w{i}"]), r.sample("abc", r.randrange(4)), names(), some(day()), some(r.choice([None, *"MFU"])), some(r.choice([None, "FR", "DE"])), papers(), r.choice(["EU", "UN", "PEP"]), "SANCTION") for i in range(90)]
    paper = "array<struct<number:string,scope:string>>"
    c = spark.createDataFrame(ours, f"client_id string, keys array<string>, client_names array<string>, client_dates array<string>, client_gender string, client_countries array<string>, client_papers {paper}")
    w = spark.createDataFrame(theirs, f"entity_id string, keys array<string>, listed_names array<string>, listed_dates array<string>, listed_genders array<string>, listed_countries array<string>, listed_papers {paper}, list_type string, perimeter string")
    rows = lambda df: sorted(map(repr, (tuple(x) for x in df.collect())))
    want, got = S.screening_summary(S.decided_candidates(c, w, config)), S.summarised_candidates(c, w, config)
    assert got.dtypes == want.dtypes and len(rows(want)) > 40 and rows(got) == rows(want)


def test_clients_are_summarised_without_listing_pairs(spark):
    """90 million pairs of one key."""
    side = lambda n, p, i: spark.range(n).select(F.concat(F.lit(i[0]), "id").alias(i), F.array(F.lit("k")).alias("keys"), F.array(F.lit("ADA ROSSI")).alias(f"{p}_names"), F.array(F.date_add(F.lit("1950-01-01").cast("date"), (F.col("id") * 7 % 18000).cast("int")).cast("string")).alias(f"{p}_dates"), F.array().cast("array<struct<number:string,scope:string>>").alias(f"{p}_papers"))
    c = side(9000, "client", "client_id").withColumns({"client_gender": F.lit("M"), "client_countries": F.array(F.lit("FR"))})
    w = side(10000, "listed", "entity_id").withColumns({"listed_genders": F.array(F.lit("F")), "listed_countries": F.array(F.lit("DE")), "list_type": F.lit("EU"), "perimeter": F.lit("SANCTION")})
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    size = lambda: sum(f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(tracker.getAllFiles()))
    before = size()
    got = S.summarised_candidates(c, w, S.EngineConfig()).collect()
    assert len(got) == 9000 and {r.candidates for r in got} == {10000} and size() - before < 20e6
