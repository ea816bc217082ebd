"""Admission of uploads: a verdict for each, with quotas that one batch cannot overdraw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.readers import MAX_UPLOAD

#: Kinds of file that are taken: extension and MIME type. Fixed values.
KINDS = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
#: Categories of a contract. Fixed values.
CATEGORIES = ("employment", "saas", "freelance", "tos", "privacy", "real_estate", "partnership", "vendor", "franchise", "other")
#: Status of each verdict. Fixed values.
STATUS = {"admitted": 201, "no_file": 400, "kind": 400, "too_large": 413, "user": 401, "quota": 429, "category": 400}


def file_verdict(name: Column, mime: Column, length: Column, largest: int = MAX_UPLOAD) -> Column:
    """What is wrong with a file by itself: no_file, kind (extension or MIME type is none of KINDS) or too_large; else null."""
    kind = F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1)).isin(*KINDS) & F.coalesce(mime.isin(*KINDS.values()), F.lit(False))
    return F.when(name.isNull() | length.isNull(), "no_file").when(~kind, "kind").when(length > largest, "too_large")


def admit(uploads: DataFrame, users: DataFrame, band: Column | None = None, largest: int = MAX_UPLOAD, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """uploads with verdict and status; users (user_id, used, quota) as they are before the batch.

    uploads: upload_id, user_id, uploaded_at, name, mime, length, category. Checks are in this order: the file by itself, the user
    (unknown: 401), the quota (429), the category (400). An upload has quota left if what its user used and the user's admitted
    uploads before it, in order of uploaded_at and upload_id, are below the quota. As long as there is quota every sound
    upload is admitted, so that is a count of sound uploads before it, whatever became of them.

    The count runs in two steps, over bands of time (by default hours) and within a band, so that a user with very many
    uploads is no single group. band is a column that rises with uploaded_at. Rows without a time come first."""
    band = F.date_trunc("hour", F.col("uploaded_at")) if band is None else band
    file = file_verdict(F.col("name"), F.col("mime"), F.col("length"), largest)
    fits = F.coalesce(F.col("category").isin(*categories), F.lit(False))
    rows = uploads.withColumn("_band", band).withColumn("_file", file).withColumn("_sound", (F.col("_file").isNull() & fits).cast("long"))
    per = rows.groupBy(F.col("user_id").alias("_u"), F.col("_band").alias("_b")).agg(F.sum("_sound").alias("_n"))
    earlier = Window.partitionBy("_u").orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    rows = rows.join(per, rows["user_id"].eqNullSafe(per["_u"]) & rows["_band"].eqNullSafe(per["_b"])).drop("_u", "_b")
    within = Window.partitionBy("user_id", "_band").orderBy(F.col("uploaded_at").asc_nulls_first(), "upload_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_sound").over(within), F.lit(0)))
    known = users.select(F.col("user_id").alias("_user"), F.col("used").alias("_used"), F.col("quota").alias("_quota"))
    rows = rows.join(known, F.col("user_id") == F.col("_user"), "left")
    over = F.coalesce("_used", F.lit(0)) + F.col("_before") >= F.coalesce("_quota", F.lit(0))
    verdict = F.coalesce("_file", F.when(F.col("_user").isNull(), "user").when(over, "quota").when(~fits, "category").otherwise("admitted"))
    status = F.element_at(F.create_map(*(F.lit(x) for p in STATUS.items() for x in p)), F.col("verdict"))
    return rows.withColumn("verdict", verdict).withColumn("status", status).drop("_band", "_file", "_sound", "_before", "_user", "_used", "_quota")


def charge(users: DataFrame, admitted: DataFrame) -> DataFrame:
    """users with what a batch with verdicts used of their quotas."""
    took = admitted.filter("verdict = 'admitted'").groupBy(F.col("user_id").alias("_u")).agg(F.count(F.lit(1)).alias("_n"))
    return users.join(took, users["user_id"] == F.col("_u"), "left").withColumn("used", F.coalesce("used", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_u", "_n")
