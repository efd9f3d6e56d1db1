"""Delimited, XML and HTML tables, read whatever their labels and delimiters are, and the sinks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.text import normal_term, spreadsheet_safe, values_of

DELIMITERS = (";", ",", "\t", "|")


def sniffed_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that occurs most in the first line; one row reaches the driver."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(DELIMITERS, key=lambda x: (line.count(x), -DELIMITERS.index(x)))


def sniffed_format(spark: SparkSession, path: str) -> DataFrame:
    """(path, format) of files by their first bytes: zip (xlsx), xml, html, json or text."""
    head = F.lower(F.trim(F.decode(F.substring("content", 1, 64), "ISO-8859-1")))
    zipped = F.hex(F.substring("content", 1, 2)) == "504B"
    kind = F.when(zipped, "xlsx").when(head.rlike(r"^(\W{3})?<\?xml"), "xml").when(head.rlike("^<(!doctype html|html)"), "html").when(head.rlike(r"^(\W{3})?[\[{]"), "json").otherwise("text")
    return spark.read.format("binaryFile").load(path).select("path", kind.alias("format"))


def label_key(label: str) -> str:
    """A column label as it is looked up: letters and digits only, lower case."""
    return "".join(c for c in label.lower() if c.isalnum())


def looked_up(rows: DataFrame, labels: Sequence[str]) -> Column:
    """The first non-blank value among columns with one of the labels, however they are written; null without such a column."""
    known = {label_key(c): c for c in rows.columns}
    found = [F.nullif(F.trim(F.col(f"`{known[k]}`")), F.lit("")) for k in map(label_key, labels) if k in known]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def csv_table(spark: SparkSession, path: str, mapping: Mapping[str, Sequence[str]], delimiter: str | None = None) -> DataFrame:
    """A delimited file as the target columns of mapping: target -> labels it may have. Broken lines keep what they have."""
    rows = spark.read.csv(path, header=True, sep=delimiter or sniffed_delimiter(spark, path), multiLine=True, escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=True)
    return rows.select(*(looked_up(rows, labels).alias(target) for target, labels in mapping.items()))


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One row for each element named row_tag; the reader splits large files."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").option("attributePrefix", "_")
    return (reader.schema(schema) if schema else reader).load(path)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.tables.append(self.open.pop())
        elif tag in ("td", "th") and self.cell is not None:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def largest_table(html: str | None) -> list[list[str]]:
    """Cells of the table with the most filled rows of at least two cells; an empty list without any."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return max(([r for r in t if len(r) > 1] for t in parser.tables + parser.open), key=len, default=[])


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_no, cells) of the largest table of each page."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([largest_table(x) for x in batch.to_pylist()], pa.list_(pa.list_(pa.string())))

    return pages.select(F.col(key), F.posexplode(F.arrow_udf(run, "array<array<string>>")(html)).alias("row_no", "cells"))


def plausible_name(c: Column) -> Column:
    """Not longer than a name can be."""
    return (F.char_length(c) <= 200) & (F.size(F.split(F.trim(c), r"\s+")) <= 24) & c.rlike(r"\p{L}{2}")


def alert_list(rows: DataFrame, list_type: str, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """A regulator's warning list: stable ids from the names, implausible names left out, repeated names once."""
    name = looked_up(rows, labels["name"])
    listed = rows.select(name.alias("primary_name"), *(looked_up(rows, v).alias(k) for k, v in labels.items() if k != "name")).where(plausible_name(F.col("primary_name")))
    stable = F.concat(F.lit(f"{list_type}-"), F.substring(F.sha1(normal_term("primary_name")), 1, 12))
    return listed.withColumn("entity_id", stable).withColumn("list_type", F.lit(list_type)).dropDuplicates(["entity_id"])


def grouped_list(rows: DataFrame, group: str, name: str, primary: Column) -> DataFrame:
    """One record of several rows of a group: the primary name and the others as aliases."""
    ranked = rows.where(F.trim(F.coalesce(F.col(name), F.lit(""))) != "").withColumn("rank_", F.when(primary, 0).otherwise(1))
    grouped = ranked.groupBy(group).agg(F.min(F.struct("rank_", F.col(name).alias("name")))["name"].alias("primary_name"), F.array_sort(F.collect_set(name)).alias("names"))
    return grouped.select(group, "primary_name", F.array_remove(F.col("names"), F.col("primary_name")).alias("aliases"))


def simple_targets(rows: DataFrame, prefix: str) -> DataFrame:
    """A flat list of targets with multi-value cells as the pivot columns."""
    kind = F.when(F.col("schema") == "Person", "I").when(F.col("schema") == "Vessel", "V").otherwise("E")
    return rows.select(
        F.concat(F.lit(prefix), "id").alias("entity_id"), kind.alias("entity_type"), F.col("name").alias("primary_name"), values_of("aliases").alias("aliases"),
        values_of("birth_date").alias("dates_of_birth"), F.transform(values_of("countries"), F.upper).alias("countries"), values_of("sanctions").alias("sanction_programs"),
    )


def stable_ids(rows: DataFrame, prefix: str, content: Sequence[str], order: str) -> DataFrame:
    """rows with entity_id from a digest of the content; repeated content gets '.2', '.3' in row order."""
    base = F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(F.trim(F.col(c)), F.lit("")) for c in content))), 1, 12))
    numbered = rows.withColumn("base_", base).withColumn("n_", F.row_number().over(Window.partitionBy("base_").orderBy(order)))
    return numbered.withColumn("entity_id", F.when(F.col("n_") == 1, F.col("base_")).otherwise(F.concat_ws(".", "base_", "n_"))).drop("base_", "n_")


def register_records(rows: DataFrame) -> DataFrame:
    """A freezing register of publications and typed details, one row each party.

    rows: Publications struct<PublicationDetail array<struct<IdRegistre, Nature, Nom, RegistreDetail array<struct<TypeChamp, Valeur array<struct<...>>>>>>>,
    as the JSON reader gives it. Every type of detail becomes a member of a map of texts.
    """
    parties = rows.select(F.explode("Publications.PublicationDetail").alias("p"))
    details = F.map_from_entries(F.transform("p.RegistreDetail", lambda r: F.struct(r["TypeChamp"], F.to_json(r["Valeur"]))))
    kind = F.when(F.col("p.Nature") == "Personne physique", "I").when(F.col("p.Nature") == "Navire", "V").otherwise("E")
    return parties.select(F.col("p.IdRegistre").cast("string").alias("entity_id"), kind.alias("entity_type"), F.col("p.Nom").alias("primary_name"), details.alias("details"))


def party_records(parties: DataFrame, references: DataFrame, key: str, reference: str) -> DataFrame:
    """Parties whose feature types are resolved by a reference table: (key, features map type -> values).

    parties: (key, features array<struct<type_id, value>>); references: (reference id, label). Reference tables are joined, not looked up on the driver.
    """
    features = parties.select(key, F.explode_outer("features").alias("f")).select(key, F.col("f.type_id").alias(reference), F.col("f.value").alias("value"))
    named = features.join(references, reference, "left").where("value is not null").groupBy(key, F.coalesce("label", F.concat(F.lit("?"), F.col(reference).cast("string"))).alias("label")).agg(F.array_sort(F.collect_set("value")).alias("values"))
    return named.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "values"))).alias("features"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Semicolon-separated export in which no cell is a formula."""
    safe = rows.select(*(spreadsheet_safe(F.col(c).cast("string")).alias(c) for c in rows.columns))
    safe.write.mode("overwrite").csv(path, header=True, sep=";", encoding="UTF-8")


def write_archive(rows: DataFrame, path: str) -> None:
    """JSON lines, appended, before rows are purged."""
    rows.write.mode("append").json(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Entity rows by delivery, so that a delivery is read and replaced alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)
