"""Rows from the JSON that a model answers with, whatever its shape, by Spark's variant type.

An answer is a list, an object that has the list under one of some names, or either in a fence or amid other words; what
is none of these is an empty list. Fields that are missing or of another kind are given defaults or leave their row out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which an object holds its list, in order. Fixed values.
OBLIGATION_NAMES = ("results", "financial_obligations", "obligations")
EVENT_NAMES = ("results", "lifecycle_events", "events")
#: Ways of writing a date.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm[:ss][.SSS][.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy")


def variant_of(raw: Column) -> Column:
    """JSON in an answer: as it stands, in a fence, or the widest brackets or braces; null if none of them reads.

    What follows a whole value is passed over."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    widest = F.regexp_extract(raw, r"(?s)(\{.*\}|\[.*\])", 1)
    some = lambda c: F.try_parse_json(F.nullif(F.trim(c), F.lit("")))
    return F.coalesce(some(raw), some(fenced), some(widest))


def listed(raw: Column, names: tuple[str, ...]) -> Column:
    """The entries of an answer's list, as an array of variants; empty where there is none."""
    v = variant_of(raw)
    found = [F.try_variant_get(v, path, "array<variant>") for path in ("$", *(f"$.{n}" for n in names))]
    return F.coalesce(*found, F.array().cast("array<variant>"))


def field(entry: Column | str, name: str) -> Column:
    """A field as text; null if it is missing, null, empty or not one value."""
    kind = F.schema_of_variant(F.try_variant_get(entry, f"$.{name}", "variant"))
    value = F.try_variant_get(entry, f"$.{name}", "string")
    return F.when(~F.coalesce(kind.rlike("^(ARRAY|OBJECT)"), F.lit(True)), F.nullif(value, F.lit("")))


def number(text: Column) -> Column:
    """A number, 0 for what is none; digits in groups are none."""
    plain = F.trim(text)
    return F.coalesce(F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double")), F.lit(0.0))


def date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date in the first format that reads it; null where none does, as for a day that no month has."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats)).cast("date")


def _entries(df: DataFrame, keys: list[str], raw_col: str, names: tuple[str, ...]) -> DataFrame:
    # The answer is parsed once, in a column of its own.
    rows = df.select(*keys, F.explode(F.array(listed(F.col(raw_col), names))).alias("_list"))
    return rows.select(*keys, F.posexplode("_list").alias("ord", "_entry"))


def obligations(df: DataFrame, keys: list[str], raw_col: str, clause_id: str = r"^[0-9a-fA-F]{24}$") -> DataFrame:
    """Payments that an answer lists: keys, ord, amount, currency (INR if none is said), description, clause_id (null unless it
    has the form of one). An amount that is no number is 0."""
    at = field("_entry", "clause_id")
    return _entries(df, keys, raw_col, OBLIGATION_NAMES).select(
        *keys, "ord", number(field("_entry", "amount")).alias("amount"), F.coalesce(field("_entry", "currency"), F.lit("INR")).alias("currency"),
        F.coalesce(field("_entry", "description"), F.lit("Financial Obligation")).alias("description"), F.when(at.rlike(clause_id), at).alias("clause_id"),
    )


def exposure(found: DataFrame, keys: list[str]) -> DataFrame:
    """What obligations come to, a currency: keys, currency, n, total. Amounts of different currencies are not added."""
    return found.groupBy(*keys, "currency").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


def events(df: DataFrame, keys: list[str], raw_col: str) -> DataFrame:
    """Dated events that an answer lists: keys, ord, event_type, date, description, notified (false). Entries without a type or
    a date that reads are left out."""
    kind = field("_entry", "event_type")
    rows = _entries(df, keys, raw_col, EVENT_NAMES).select(*keys, "ord", kind.alias("event_type"), date(field("_entry", "date")).alias("date"), field("_entry", "description").alias("description"))
    rows = rows.filter("event_type IS NOT NULL AND date IS NOT NULL")
    return rows.withColumn("description", F.coalesce("description", F.concat(F.lit("Contract "), F.col("event_type"), F.lit(" event")))).withColumn("notified", F.lit(False))
