"""Checking citations against a corpus of statutes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.functions.text import CHUNK, cited_section, overlap_pct, word_set
from ledgerloom.session import shared_path

#: Verdicts that are broadcast.
MAX_BROADCAST = 10_000

#: References that meet the claims at once, and claims whose pairs are counted at once.
REF_BLOCK, CLAIM_SLICE = 1024, 16


def overlaps(claims: DataFrame, refs: DataFrame, claim_id: str, claim_text: str, ref_id: str, ref_text: str, upto: int = 2000, least: int = 0) -> DataFrame:
    """Overlap of every claim, whole, with every reference's first characters: claim_id, ref_id, overlap, as overlap_pct.

    References go to the claims in blocks of about REF_BLOCK, one block after the other, as lists of the references of a word, so
    that a pair costs its common words only and the driver holds one block. Pairs of an overlap below least are left out."""
    known = refs.select(ref_id, word_set(F.substring(ref_text, 1, upto)).alias("_b"))
    words = claims.select(claim_id, word_set(F.col(claim_text)).alias("_a"))
    kinds = f"{claim_id} {claims.schema[claim_id].dataType.simpleString()}, {ref_id} {refs.schema[ref_id].dataType.simpleString()}, overlap int"
    n = max(1, -(-known.count() // REF_BLOCK))
    dealt = known.withColumn("_k", F.pmod(F.xxhash64(ref_id, "_b"), F.lit(n))) if n > 1 else known.withColumn("_k", F.lit(0))
    made = None
    for k in range(n):
        block = dealt.filter(F.col("_k") == k).drop("_k").collect()
        part = words.mapInArrow(_counted(block, to_arrow_type(refs.schema[ref_id].dataType), [claim_id, ref_id, "overlap"]), kinds)
        made = part if made is None else made.unionByName(part)
    return made.filter(F.col("overlap") >= least) if least else made


def _counted(known: list, kind: pa.DataType, names: list[str]):
    """A map from batches of (id, words) to their pairs with the references (id, words) in known."""
    ids, size = [r[0] for r in known], len(known)
    of: dict[str, list[int]] = {}
    for k, r in enumerate(known):
        for w in r[1] or ():
            of.setdefault(w, []).append(k)
    lens = np.array([len(v) for v in of.values()], np.int64)
    starts, items = np.cumsum(lens) - lens, np.array([k for v in of.values() for k in v], np.int64)
    vocabulary = list(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.array(vocabulary, pa.string())
        for batch in batches:
            for at in range(0, len(batch), CLAIM_SLICE):
                part = batch.slice(at, CLAIM_SLICE)
                column, n = part.column(1), len(part)
                total = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                code = pc.fill_null(pc.index_in(pc.cast(column.flatten(), pa.string()), keys), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(n), total)
                row, code = row[code >= 0], code[code >= 0]
                each = lens[code]
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[code], each)
                common = np.bincount(np.repeat(row, each) * size + items[place], minlength=n * size).reshape(n, size)
                share = np.floor(100 * common / np.maximum(total, 1)[:, None] + 0.5).astype(np.int32)
                left = part.column(0).take(pa.array(np.repeat(np.arange(n), size)))
                yield pa.RecordBatch.from_arrays([left, pa.array(ids * n, kind), pa.array(share.ravel())], names)

    return run


def plain_act(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[,.\s]+", " "))


def extract(refs: DataFrame) -> DataFrame:
    """refs (ref_id, act_name, section_hint, reason, ...) with section ("Section 27") and keywords for a search without one."""
    words = word_set(F.concat_ws(" ", "section_hint", "reason"), 3)
    return refs.withColumn("section", cited_section(F.col("section_hint"), F.col("reason"), F.col("act_name"))).withColumn("keywords", words)


def lookup(refs: DataFrame, statutes: DataFrame) -> DataFrame:
    """refs that name a section, with the statute they cite: ref_id, act_found, section_found, content.

    An equi-join on the section without its chunk mark, then act names that hold one another (an empty one holds any), then
    the chunk that shares most words with the claim, the first of equals by act and section number."""
    side = statutes.select(F.lower(F.trim(F.regexp_replace("section_number", CHUNK, ""))).alias("_s"), F.col("act_name").alias("act_found"), F.col("section_number").alias("section_found"), "content")
    pairs = refs.filter("section IS NOT NULL").join(side, F.lower("section") == F.col("_s"))
    a, b = plain_act(F.coalesce("act_name", F.lit(""))), plain_act(F.col("act_found"))
    pairs = pairs.filter((a == "") | F.contains(a, b) | F.contains(b, a)).withColumn("_score", overlap_pct(F.col("reason"), F.col("content")))
    order = Window.partitionBy("ref_id").orderBy(F.col("_score").desc(), "act_found", "section_found")
    return pairs.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("ref_id", "act_found", "section_found", "content")


def lookup_by_keywords(refs: DataFrame, statutes: DataFrame, terms: DataFrame, per_term: int = 20) -> DataFrame:
    """refs without a section: by the search terms (act_key, term_ord, term) of their act, the first term that an act's name
    has; among its first rows the one with most keywords in its text.

    A term's first rows are the same for all refs, so terms meet acts alone, and refs meet at most per_term rows a term."""
    acts = statutes.select(F.col("act_name").alias("act_found")).distinct().join(F.broadcast(terms), F.contains(F.lower("act_found"), F.lower("term"))).drop("term")
    rows = acts.join(statutes.select(F.col("act_name").alias("act_found"), F.col("section_number").alias("section_found"), "content"), "act_found")
    place = Window.partitionBy("act_key", "term_ord").orderBy("act_found", "section_found")
    first = rows.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= per_term)
    near = refs.filter("section IS NULL").join(first, "act_key")
    hits = F.size(F.filter("keywords", lambda k: F.contains(F.lower(F.col("content")), k)))
    best = Window.partitionBy("ref_id").orderBy("term_ord", hits.desc(), "_n")
    return near.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("ref_id", "act_found", "section_found", "content")


#: What a reference says; those that say the same have one verdict.
CLAIM = ["act_key", "act_name", "section_hint", "reason"]


def verify(refs: DataFrame, statutes: DataFrame, terms: DataFrame, least_overlap: int = 25) -> DataFrame:
    """refs (ref_id, act_key, act_name, section_hint, reason) with status and grade.

    Case law and others are not_applicable; a statute found is verified if the claim shares enough words with it, else
    misquoted; none found is not_found. What is said many times is looked up once: the distinct claims go to a table of the
    shared store, and their verdicts are joined to all refs, in a broadcast where they are few."""
    spark = refs.sparkSession
    path = shared_path(spark, "claims")
    refs.select(*CLAIM).distinct().withColumn("ref_id", F.monotonically_increasing_id()).write.parquet(path)
    claims = spark.read.parquet(path)
    few = claims.count() <= MAX_BROADCAST
    claims = extract(claims)
    found = lookup(claims, statutes).unionByName(lookup_by_keywords(claims, statutes, terms))
    rows = claims.join(found, "ref_id", "left").drop("ref_id")
    status = (
        F.when(F.col("act_key").isin("CASE_LAW", "OTHER"), "not_applicable")
        .when(F.col("content").isNull(), "not_found")
        .when(overlap_pct(F.col("reason"), F.col("content")) >= least_overlap, "verified")
        .otherwise("misquoted")
    )
    judged = rows.withColumn("status", status).withColumn("grade", grade(F.col("status")))
    judged = judged.select(*(F.col(c).alias(f"_c_{c}") for c in CLAIM), *(c for c in judged.columns if c not in CLAIM))
    same = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in CLAIM]
    return refs.join(F.broadcast(judged) if few else judged, same, "left").drop(*(f"_c_{c}" for c in CLAIM))


def grade(status: Column) -> Column:
    return F.when(status == "verified", "strong").when(status == "misquoted", "hallucinated").when(status == "not_applicable", "weak").otherwise("unverifiable")


#: What a citation of each grade adds to a clause's accuracy, in percent. Fixed values.
WEIGHTS = {"strong": 100, "weak": 75, "unverifiable": 15, "hallucinated": -50}


def accuracy(grades: Column) -> Column:
    """Accuracy in percent of an array of grades, clamped to 0..100; 100 of an empty one."""
    weight = F.create_map(*(F.lit(x) for p in WEIGHTS.items() for x in p))
    total = F.aggregate(F.transform(grades, lambda g: F.try_element_at(weight, g)), F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return F.when(F.size(grades) > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.floor(total / F.size(grades) + 0.5)))).otherwise(100).cast("int")


def clause_accuracy(verified: DataFrame, key: list[str]) -> DataFrame:
    """citation_accuracy, statuses and grades of each clause, by a sum of weights before the shuffle."""
    rows = verified.groupBy(*key).agg(F.array_sort(F.collect_list("grade")).alias("grades"), F.array_sort(F.collect_list("status")).alias("statuses"))
    return rows.withColumn("citation_accuracy", accuracy(F.col("grades")))


def stats(verified: DataFrame, per_clause: DataFrame, key: str = "contract_id") -> DataFrame:
    """Counts of statuses and grades, mean accuracy over clauses and rate of misquotations, of each contract."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    counts = verified.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), count("status", "verified").alias("verified"), count("status", "not_found").alias("not_found"),
        *(count("grade", g).alias(g) for g in WEIGHTS),
    )
    means = per_clause.groupBy(key).agg(F.floor(F.avg("citation_accuracy") + 0.5).cast("int").alias("avg_accuracy"))
    return counts.join(means, key).withColumn("hallucination_rate", F.floor(100 * F.col("hallucinated") / F.col("total") + 0.5).cast("int"))
