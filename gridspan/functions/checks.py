"""Validation as arrays of error codes: an empty array is a valid row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import TYPE_ORDER

TEXT = r"^[A-Za-z0-9\s.,:'&()\-]+$"
# An id is letters, digits and dashes, or such with a kind and a # (or its escape) before.
ID = r"^([A-Z]+(#|%23))?[A-Za-z0-9\-]+$"


def errors(*rules: tuple[str, Column]) -> Column:
    """The codes of the rules that a row breaks; a rule that is null counts as kept."""
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules]), lambda x: x.isNotNull())


def clean_text(text: Column, most: int = 100) -> Column:
    """Trimmed text of allowed characters, blank as null; struct(value, ok)."""
    value = F.nullif(F.trim(text), F.lit(""))
    return F.struct(value.alias("value"), (value.isNull() | ((F.length(value) <= most) & value.rlike(TEXT))).alias("ok"))


def id_errors(id_: Column, most: int = 100) -> Column:
    """The rules for an id that comes from outside."""
    bare = F.trim(id_)
    return errors(("id_missing", id_.isNull() | (bare == "")), ("id_long", F.length(bare) > most), ("id", (bare != "") & ~bare.rlike(ID)))


def district_errors() -> Column:
    towns = F.filter(F.coalesce("towns", F.array().cast("array<string>")), lambda t: F.trim(t) != "")
    return errors(
        ("name_missing", F.col("name").isNull() | (F.trim("name") == "")),
        ("name_long", F.length("name") > 255),
        ("address_long", F.length("main_address") > 500),
        ("url", (F.col("district_url") != "") & ~F.lower("district_url").rlike(r"^https?://[^\s]+$")),
        ("many_towns", F.size(towns) > 50),
        ("town_long", F.exists(towns, lambda t: F.length(t) > 100)),
        ("type", ~F.lower("district_type").isin(*TYPE_ORDER)),
    )


def record_errors() -> Column:
    """The rules for records that are applied by hand."""
    return errors(
        ("key", F.col("school_year").isNull() | F.col("period").isNull() | F.col("education").isNull() | F.col("credits").isNull() | F.col("step").isNull()),
        ("education", ~F.col("education").isin("B", "M", "D")),
        ("salary", F.coalesce(~(F.col("salary").cast("double") > 0), F.lit(True))),
    )


def known_education(education: Column) -> Column:
    """The education itself; a row of any other than B, M and D, or of none, fails the job that loads it."""
    return F.when(education.isin("B", "M", "D"), education).otherwise(F.raise_error(F.concat(F.lit("no such education: "), F.coalesce(education, F.lit("none")))))


def edit_errors(text: Column) -> Column:
    """The rules for an edited cell: a number with two decimals at most, in range."""
    value = text.try_cast("decimal(14,2)")
    return errors(("number", ~text.rlike(r"^\d+(\.\d{1,2})?$")), ("low", value < 1000), ("high", value > 500000))
