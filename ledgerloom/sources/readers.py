"""Readers that give the library's tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import collapse, first_match, html_text

MAX_UPLOAD = 10 * 1024 * 1024
#: Subject of an act by words that its name contains, in order; general_contract_law otherwise. Fixed values.
DOMAINS = (
    ("labor_law", "wages|industrial disputes|industrial relations|maternity benefit|sexual harassment|epfscheme"),
    ("data_privacy", "digital personal data|intermediary guidelines|it rules|it act|cert-in|telecommunications"),
    ("intellectual_property", "copyright|trade marks|patents|spacepolicy"),
    ("real_estate_law", "real estate|transfer of property|transferofproperty"),
    ("consumer_protection", "consumer protection"),
    ("dispute_resolution", "specific relief|dispute"),
)


def uploads(spark: SparkSession, path: str, largest: int = MAX_UPLOAD) -> DataFrame:
    """Files of allowed kinds and size: path, length, modificationTime, content, kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter((F.col("length") <= largest) & F.col("path").rlike(r"(?i)\.(pdf|docx)$")).withColumn("kind", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)))


def within_quota(uploads: DataFrame, users: DataFrame) -> DataFrame:
    """Uploads (user_id, ...) of users with quota left."""
    return uploads.join(users.filter("used < quota").select("user_id"), "user_id", "left_semi")


def best_text(df: DataFrame, tiers: list[str], least: int = 100) -> DataFrame:
    """text: the first of several extractions of enough characters, else the last that has any; rows of none have null."""
    enough = [F.when(F.length(F.trim(c)) >= least, F.col(c)) for c in tiers]
    any_ = [F.when(F.length(F.trim(c)) > 0, F.col(c)) for c in reversed(tiers)]
    return df.withColumn("text", F.coalesce(*enough, *any_))


def case_law_csv(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Case law from CSV with header (caseName, citation, ...): rows with both, of citations not known yet, the first of each."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.drop(subset=["caseName", "citation"])
    rows = rows.filter((F.trim("caseName") != "") & (F.trim("citation") != "")).dropDuplicates(["citation"])
    rows = rows.withColumnRenamed("caseName", "case_title")
    return rows.join(known.select("citation"), "citation", "left_anti") if known is not None else rows


def statutes_json(spark: SparkSession, path: str, act_name: str, least: int = 10) -> DataFrame:
    """Sections from JSON arrays of (Section, section_title, section_desc)."""
    rows = spark.read.schema("Section string, section_title string, section_desc string").option("multiLine", True).json(path)
    content = F.concat_ws(": ", F.nullif(F.trim("section_title"), F.lit("")), F.trim("section_desc"))
    return rows.select(F.lit(act_name).alias("act_name"), F.concat(F.lit("Section "), "Section").alias("section_number"), content.alias("content")).filter(F.length("content") >= least)


def domain_of(act):
    """Subject of an act by its name."""
    return first_match([(F.lower(act).rlike(p), F.lit(d)) for d, p in DOMAINS], F.lit("general_contract_law"))


def scraped(pages: DataFrame, key: str = "url") -> DataFrame:
    """Pages with their text, the first of each key by page_id."""
    first = pages.groupBy(key).agg(F.min_by("page_id", "page_id").alias("_first"))
    kept = pages.join(first.select("_first"), pages["page_id"] == F.col("_first"), "left_semi")
    return kept.select("page_id", key, html_text(F.col("html")).alias("text"))


def canonical_acts(statutes: DataFrame, names: DataFrame) -> DataFrame:
    """Statutes with act names as a map (raw, canonical; acts.act_names) has them, then the first row of each act and section by id.
    Rows without an act's name are dropped; letters and runs of blanks do not matter."""
    statutes = statutes.filter(F.length(F.trim("act_name")) > 0)
    rows = statutes.join(names.withColumn("raw", F.lower(collapse(F.col("raw")))), F.lower(collapse(F.col("act_name"))) == F.col("raw"), "left").withColumn("act_name", F.coalesce("canonical", "act_name"))
    key = [F.lower(F.trim("act_name")).alias("_a"), F.col("section_number").alias("_s")]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*statutes.columns), "id").alias("r"))
    return first.select("r.*")
