"""Matching clients and listed individuals without a common key.

Candidate pairs get odds from their names, birth dates and countries. A list names a person once, and a listed
person is one client person; these one-to-one factors exchange messages with the pairs by loopy belief
propagation, as joins of the pairs with sums over their factors, until no message changes any more.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.parties import EQUAL, PARTLY, SLIP, UNKNOWN, candidate_pairs, client_parties, compared, listed_parties, party_classes
from tamis.llm.variants import PROOF, SAME
from tamis.session import checkpointed

#: Log odds of a pair: by agreement of the dates, by a common country or none stated, and for each point of name
#: similarity above or below the middle. Without a common date they are at most the evidence of the names beyond PROOF.
DATE_ODDS = {EQUAL: 3.0, PARTLY: 0.2, UNKNOWN: -1.4, SLIP: -0.4}
COUNTRY_ODDS = {1: 1.2, 0: -0.3}
NAME_MIDDLE, NAME_SLOPE = 0.86, 22.0
BOUND = 20.0
#: Messages are exchanged until none changes by more than the tolerance; `rounds` only stops a run that never settles, which is
#: logged and shows in the residual.
ROUNDS, TOLERANCE, DAMPING = 100, 1e-3, 0.3
MATCH = 0.5
LOG = logging.getLogger(__name__)


def prior_log_odds() -> Column:
    dates = F.coalesce(*(F.when(F.col("dates") == k, F.lit(v)) for k, v in DATE_ODDS.items()))
    countries = F.coalesce(*(F.when(F.col("countries") == k, F.lit(v)) for k, v in COUNTRY_ODDS.items()))
    odds = dates + countries + NAME_SLOPE * (F.col("name") - NAME_MIDDLE)
    proven = F.col("evidence") - F.when(F.col("countries") > 0, F.lit(PROOF[1])).otherwise(F.lit(PROOF[0]))
    unknown = F.when(F.col("name") >= SAME, odds).otherwise(F.least(odds, proven))
    return F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.when(F.col("dates") == UNKNOWN, unknown).otherwise(odds)))


def propagate(pairs: DataFrame, factors: list[tuple[list[str], str]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """pairs with `probability`, `rounds` and `residual`: marginal match probabilities under at-most-one factors.

    pairs: (pair, odds, ...), pair unique. factors: (columns that name a factor, column of its option). At most one option
    of a factor is true; pairs of one option do not compete (an option counts with its best pair). Pairs without a rival in any
    factor keep their odds and take no part in the rounds (rounds 0). Among the others messages are damped and exchanged
    until the largest change, the residual, is within the tolerance. Sums over factors are aggregated before they are joined
    back, so a factor with very many pairs is no hot group.
    """
    names = [f"m{i}" for i in range(len(factors))]
    rivals = pairs
    for i, (group, option) in enumerate(factors):
        several = pairs.groupBy(*group).agg((F.min(option) != F.max(option)).alias(f"r{i}"))
        rivals = rivals.join(several, group)
    contested = F.lit(False)
    for i in range(len(factors)):
        contested = contested | F.col(f"r{i}")
    keys = {c for group, option in factors for c in (*group, option)}
    # A factor without rivals sends 1 whoever is in it, so the rounds need only the contested pairs.
    state = checkpointed(rivals.where(contested).select("pair", "odds", *keys, *(F.lit(1.0).alias(m) for m in names)))
    done, change = 0, 0.0
    while not state.isEmpty():
        before = state
        for i, (group, option) in enumerate(factors):
            incoming = F.col("odds")
            for j, m in enumerate(names):
                if j != i:
                    incoming = incoming * F.col(m)
            sent = state.withColumn("sent", incoming)
            options = sent.groupBy(*group, option).agg(F.max("sent").alias("best"))
            totals = options.groupBy(*group).agg(F.sum("best").alias("total"))
            state = (
                sent.join(options, [*group, option]).join(totals, group)
                .withColumn(names[i], F.lit(DAMPING) * F.col(names[i]) + F.lit(1 - DAMPING) / (1 + F.greatest(F.col("total") - F.col("best"), F.lit(0.0))))
                .drop("sent", "best", "total")
            )
        state = checkpointed(state)
        old = before.select("pair", *(F.col(m).alias(f"old_{m}") for m in names))
        change = state.join(old, "pair").select(F.max(F.greatest(F.lit(0.0), *(F.abs(F.col(m) - F.col(f"old_{m}")) for m in names)))).first()[0]
        done += 1
        if change <= tolerance:
            break
        if done >= rounds:
            LOG.warning("messages still change by %g after %d rounds", change, done)
            break
    LOG.info("%d rounds, residual %g", done, change)
    belief = F.col("odds")
    for m in names:
        belief = belief * F.coalesce(F.col(m), F.lit(1.0))
    found = pairs.join(state.select("pair", *names), "pair", "left")
    met = F.col(names[0]).isNotNull()
    return found.withColumn("probability", belief / (1 + belief)).withColumn("rounds", F.when(met, done).otherwise(0)).withColumn("residual", F.when(met, F.lit(float(change))).otherwise(0.0)).drop(*names)


def options(side: str, other: str) -> Column:
    """Which person a party would be, seen from the other side of its pair: parties with one option are no rivals there.

    Parties whose date agrees with the other side's, or whose name is the same and no date contradicts, would be one person
    under several ids. A slip in a date, a different date, and an undated name that is only alike, are persons of their own.
    """
    own = F.coalesce(F.col(f"{side}_date"), F.col(side).cast("string"))
    agrees = F.col("dates").isin(EQUAL, PARTLY) | ((F.col("dates") == UNKNOWN) & F.col(f"{side}_date").isNull() & (F.col("name") >= SAME))
    return F.when(agrees & F.col(f"{other}_date").isNotNull(), F.lit("same")).when(agrees, F.lit("undated")).otherwise(own)


def same_persons(clients: DataFrame, entities: DataFrame, nicknames: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """(client_id, entity_id, probability, ...) of every candidate pair of a person client and a listed individual.

    Names (maiden names and aliases included) must be spellings of one name; birth dates, countries and numbers that contradict
    each other exclude a pair, slips in a date lower its odds, what is not stated leaves it open. Within one list
    (the letters an entity_id begins with) a client is at most one person, and an entity is at most one person of the
    book: a pair whose date has a slip, or none, competes with one whose date agrees (see `options`). `rounds` and `residual` tell
    how the messages settled. Rows without id or usable name give nothing; repeated rows and other columns change nothing; empty
    tables give no rows.
    """
    parties = client_parties(clients).unionByName(listed_parties(entities, individuals=True))
    classes, members = party_classes(parties)
    facts = compared(candidate_pairs(classes, True, nicknames), classes, nicknames)
    date = F.nullif(F.array_min(F.split(F.get(F.split("facts", r"\|"), F.lit(3)), ";")), F.lit(""))
    dates = classes.select("class", date.alias("date"))
    lists = members.select("class", F.regexp_extract("ref", "^[A-Za-z]*", 0).alias("list")).distinct()
    pairs = facts.join(dates.select(F.col("class").alias("a"), F.col("date").alias("a_date")), "a").join(dates.select(F.col("class").alias("b"), F.col("date").alias("b_date")), "b")
    pairs = pairs.join(lists.withColumnRenamed("class", "b"), "b").select(
        "a", "b", "name", "evidence", "dates", "countries", "list", F.concat_ws("-", "a", "b", "list").alias("pair"), F.exp(prior_log_odds()).alias("odds"),
        options("a", "b").alias("a_option"), options("b", "a").alias("b_option"),
    )
    found = propagate(checkpointed(pairs), [(["a", "list"], "b_option"), (["b", "list"], "a_option")])
    found = found.groupBy("a", "b").agg(F.max("probability").alias("probability"), *(F.max(c).alias(c) for c in ("name", "dates", "countries", "rounds", "residual")))
    x = members.select(F.col("class").alias("a"), F.col("ref").alias("client_id"))
    y = members.select(F.col("class").alias("b"), F.col("ref").alias("entity_id"))
    return found.join(x, "a").join(y, "b").select("client_id", "entity_id", "probability", "name", "dates", "countries", "rounds", "residual")
