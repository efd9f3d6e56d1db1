"""Payment messages: transactions and their parties, by XPath over whole messages."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.text import rotations

# Elements that hold a party or an agent, with its role.
ROLES = {
    "Dbtr": "debtor", "Cdtr": "creditor", "UltmtDbtr": "ultimate_debtor", "UltmtCdtr": "ultimate_creditor", "InitgPty": "initiating_party",
    "DbtrAgt": "debtor_agent", "CdtrAgt": "creditor_agent", "IntrmyAgt1": "intermediary_agent", "InstgAgt": "instructing_agent", "InstdAgt": "instructed_agent",
}
TRANSACTION = ("CdtTrfTxInf",)
NAME_LENGTH = 1000
FIELDS = ("message_id", "transaction_no", "end_to_end_id", "amount", "currency", "role", "name", "country", "bic")


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _find(e: ET.Element, *path: str) -> ET.Element | None:
    for step in path:
        e = next((c for c in e if _local(c) == step), None) if e is not None else None
    return e


def _text(e: ET.Element | None) -> str | None:
    return (e.text or "").strip() or None if e is not None else None


def _parties(e: ET.Element) -> list[tuple]:
    found = []
    for child in e:
        role = ROLES.get(_local(child))
        if role is None:
            continue
        agent = role.endswith("agent")
        body = _find(child, "FinInstnId") if agent else child
        if body is None:
            continue
        bic = next((_text(x) for x in child.iter() if _local(x) in ("BIC", "BICFI", "AnyBIC")), None)
        name = _text(_find(body, "Nm"))
        country = _text(_find(body, "PstlAdr", "Ctry")) or (bic[4:6] if agent and bic and len(bic) >= 6 else None)
        if name or bic:
            found.append((role, (name or bic)[:NAME_LENGTH], country, bic))
    return found


def payment_rows(message: str | None) -> list[tuple]:
    """Rows of one message; parties of the header and of a payment block belong to each of its transactions. Broken XML gives none."""
    try:
        root = ET.fromstring(message or "")
    except (ET.ParseError, ValueError):
        return []
    header = next((x for x in root.iter() if _local(x) == "GrpHdr"), None)
    message_id = _text(_find(header, "MsgId")) if header is not None else None
    above = _parties(header) if header is not None else []
    parent = {c: p for p in root.iter() for c in p}
    rows = []
    for no, t in enumerate((x for x in root.iter() if _local(x) in TRANSACTION), 1):
        block = parent.get(t)
        inherited = above + (_parties(block) if block is not None and _local(block) == "PmtInf" else [])
        amount = next((x for path in (("Amt", "InstdAmt"), ("IntrBkSttlmAmt",), ("Amt", "EqvtAmt", "Amt"), ("InstdAmt",)) if (x := _find(t, *path)) is not None), None)
        base = (message_id, no, _text(_find(t, "PmtId", "EndToEndId")), _text(amount), amount.get("Ccy") if amount is not None else None)
        rows += [(*base, *p) for p in dict.fromkeys(inherited + _parties(t))]
    return rows


def payment_parties(messages: DataFrame, xml: str = "xml") -> DataFrame:
    """One row for each party of each transaction, with the columns of FIELDS; amounts as decimals."""
    kinds = [pa.int32() if n == "transaction_no" else pa.string() for n in FIELDS]
    arrow = pa.list_(pa.struct(list(zip(FIELDS, kinds))))
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n == "transaction_no" else T.StringType()) for n in FIELDS]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([payment_rows(x) for x in batch.to_pylist()], arrow)

    rows = messages.select(F.inline(F.arrow_udf(run, kind)(xml)))
    return rows.withColumn("amount", F.expr("try_cast(amount as decimal(18,2))"))


def distinct_parties(parties: DataFrame) -> DataFrame:
    """Parties to screen, each once with all its roles, and the rotations of its name for probing."""
    key = [F.upper("name").alias("name"), F.coalesce("country", F.lit("")).alias("country"), F.coalesce("bic", F.lit("")).alias("bic")]
    return parties.groupBy(*key).agg(F.array_sort(F.collect_set("role")).alias("roles"), F.countDistinct("message_id", "transaction_no").alias("transactions")).withColumn("probes", rotations("name"))


def message_verdicts(parties: DataFrame, hits: DataFrame) -> DataFrame:
    """(message_id, verdict, hits): HIT if any party of the message has one. hits: (name, country, bic, entity_id), names upper case."""
    keyed = parties.select("message_id", F.upper("name").alias("name"), F.coalesce("country", F.lit("")).alias("country"), F.coalesce("bic", F.lit("")).alias("bic")).distinct()
    found = keyed.join(hits, ["name", "country", "bic"], "left").groupBy("message_id").agg(F.count("entity_id").alias("hits"))
    return found.select("message_id", F.when(F.col("hits") > 0, "HIT").otherwise("PASS").alias("verdict"), "hits")
