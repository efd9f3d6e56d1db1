"""Data quality gate: what rejects a record, what degrades it, and its cleansed name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import cleansed


def _codes(tests: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests.items())))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def client_quality(clients: DataFrame) -> DataFrame:
    """clients with errors (any rejects the record), warnings, and a cleansed name.

    B01 no principal name, B02 unknown type, B04 person without any name, B05 fewer than two letters or digits; M01 no country,
    M02 living person without birth date, M03 letters of other scripts, M05 a birth date in another form than ISO.
    """
    c = F.col
    person, company = c("client_type") == "PP", c("client_type") == "PM"
    name = F.when(company, c("client_company_name")).otherwise(F.concat_ws(" ", "client_first_name", "client_last_name"))
    signs = F.char_length(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))
    errors = {
        "B01": (person & blank(c("client_last_name"))) | (company & blank(c("client_company_name"))),
        "B02": ~F.coalesce(c("client_type"), F.lit("")).isin("PP", "PM"),
        "B04": person & blank(c("client_first_name")) & blank(c("client_last_name")),
        "B05": ~blank(name) & (signs < 2),
    }
    countries = ("nationality", "residence", "birth_country", "registration_country")
    none = blank(c(countries[0]))
    for other in countries[1:]:
        none = none & blank(c(other))
    warnings = {
        "M01": none,
        "M02": person & ~F.coalesce(c("client_is_deceased"), F.lit(False)) & blank(c("client_dob")),
        "M03": name.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArabic}\p{IsHan}]"),
        "M05": ~blank(c("client_dob")) & ~c("client_dob").rlike(r"^\d{4}-\d{2}-\d{2}$"),
    }
    return clients.withColumn("errors", _codes(errors)).withColumn("warnings", _codes(warnings)).withColumn("clean_name", cleansed(name, company))
