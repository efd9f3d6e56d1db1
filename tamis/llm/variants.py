"""Variant spellings of names: which ids mean one party."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.parties import EQUAL, PARTLY, SLIP, UNKNOWN, candidate_pairs, client_parties, compared, listed_parties, party_classes

#: Least name similarity by what the birth dates say; least evidence (see `compared`) where one country is common, or where one
#: side states none. Equal names (SAME) need no evidence if a country is common or both state none; without a date, all others do.
LEAST = {EQUAL: 0.7, PARTLY: 0.82, UNKNOWN: 0.84, SLIP: 0.8}
PROOF = {1: 2.2, 0: 3.2}
SAME = 0.98
#: A slip in a date agrees with fewer dates than no date at all; it lowers the evidence that is needed.
SLIP_PROOF = -3.0
LEAST_COMPANY = 0.85


def spelling_of_one(least: dict[int, float] = LEAST, proof: dict[int, float] = PROOF, least_company: float = LEAST_COMPANY) -> Column:
    """Whether a compared pair is one party: names are spellings of one name and no stated fact shows two."""
    dates, name, evidence = F.col("dates"), F.col("name"), F.col("evidence")
    proven = evidence >= F.when(F.col("countries") > 0, F.lit(proof[1])).otherwise(F.lit(proof[0]))
    person = (
        ((dates == EQUAL) & (name >= least[EQUAL]))
        | ((dates == PARTLY) & (name >= least[PARTLY]) & ((F.col("countries") > 0) | (name >= SAME) | proven))
        | ((dates == UNKNOWN) & (name >= least[UNKNOWN]) & (proven | (name >= SAME)))
        | ((dates == SLIP) & (name >= least[SLIP]) & (F.col("countries") > 0) & (evidence >= proof[1] + SLIP_PROOF))
    )
    return F.when(F.col("numbers") > 0, name >= least[EQUAL]).when(F.col("kind") == "P", person).otherwise(name >= least_company)


def name_variants(clients: DataFrame, entities: DataFrame, nicknames: dict[str, frozenset[str]] | None = None, decide: Column | None = None) -> DataFrame:
    """(ref_small, ref_large): pairs of client_id of persons, and pairs of entity_id, that mean one party.

    All names of an id count: first and last name in any order, maiden name, aliases of high or no priority,
    aliases of low priority with several words. Blank and one-letter names give nothing, ids without a usable
    name no pairs. Birth dates, countries and identity numbers that show two different parties exclude a pair; what is
    not stated excludes nothing. Ids with equal contents are compared once, as a class, and paired in the last join.
    Names without a date on one side are one party only if they are equal, or if what they share is rare enough that no
    other of all parties shares it by chance. Rows without an id are ignored, repeated rows and other columns change nothing.
    nicknames: short names with the full names they may stand for; decide: another rule over the columns of `compared`.
    """
    parties = client_parties(clients).unionByName(listed_parties(entities))
    classes, members = party_classes(parties)
    links = compared(candidate_pairs(classes, False, nicknames), classes, nicknames).where(spelling_of_one() if decide is None else decide).select("a", "b")
    same = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"))
    x = members.select(F.col("class").alias("a"), F.col("ref").alias("x"))
    y = members.select(F.col("class").alias("b"), F.col("ref").alias("y"))
    pairs = links.unionByName(same).join(x, "a").join(y, "b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("ref_small"), F.greatest("x", "y").alias("ref_large")).distinct()
