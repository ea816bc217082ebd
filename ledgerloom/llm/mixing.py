"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every source gets a target number of words (targets). Its documents, in a shuffled order that only the document decides,
receive a virtual finish time: the source's words up to and including the document, divided by the source's target. A
source whose target exceeds its size goes round again, so a document stands in the queue up to max_repeats times. The
whole queue is then sorted by finish time, range by range, and truncated where the total budget is spent: what the queue
holds up to there is the mix, whole documents, and never more words than the budget. Each source falls behind its target by
less than a document, and what all of them fall behind lets the queue run on a little past time 1 for all.

Both sums, of a source's words and of the queue's, come from range sorts (running): ranges are cut by sampling, so a source
with a third of all rows is just more ranges, and no window spans a source or the corpus. One row a range is added up in
one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, Scratch

#: Weights of the sources in code-point order, null last, repeating. Fixed values.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """Words each source is to give.

    sizes has a row a source: source, source_size. The sources share share * (sum of sizes) by weight; a target stops at
    max_repeats times its source's size and the excess goes to the others by weight until none is above. In closed form:
    with sources ordered by size / weight, the level at which the rest share what is left is found by running sums.
    Sources of size 0 get 0. There is one row a source, so windows over all of them are small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    filling = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    return (
        sizes.withColumn("weight", weight)
        .withColumn("_ratio", cap / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()) * share)
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after))
        # The first source in filling order whose ratio is above its level fixes the level of all that follow; theirs are lower.
        .withColumn("_level", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("_level").isNull() | (F.col("_ratio") <= F.col("_level")), cap.cast("double")).otherwise(F.col("_level") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def running(df: DataFrame, order: list[str], size: str, out: str, scratch: Scratch) -> DataFrame:
    """df with out: the running sum of size over all rows in the given order; rows equal in it share one sum."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = scratch.keep(ranged, "sorted")
    sums = ranged.groupBy("_range").agg(F.sum(size).alias("_sum"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.keep(sums.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start")), "starts", 0)
    inside = F.sum(size).over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_in", inside).join(starts, F.col("_range") == F.col("_of")).withColumn(out, F.col("_in") + F.col("_start")).drop("_in", "_start", "_range", "_of")


def queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """One row a document: _id, size, source, source_size, target, rounds (times that the mix takes it). See the module.

    Repeated rows of one id and source share one place in the order and are taken together or not at all; a null or blank
    text has size 0 and is taken 0 times; null sources form a source of their own, null ids an id; an empty table gives no
    rows. Other columns of docs are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    # The place in the shuffled order is 60 bits of a digest of the id.
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("_id").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("_place", place)
    sized = scratch.keep(sized, "sizes")  # texts are read and counted once; from here on rows are short
    counted = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source, written, so that Spark knows its size and broadcasts it below the session's threshold only.
    before = F.coalesce(F.sum("source_size").over(Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goal = scratch.keep(targets(counted, share=share, max_repeats=max_repeats).withColumn("_before", before), "targets", 0)
    budget = float(goal.agg(F.sum("source_size")).first()[0] or 0) * share

    # Words up to a document in the order (source, place), less those of the sources before its own.
    upto = running(sized, ["source", "_place"], "size", "_all", scratch)
    placed = upto.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    placed = scratch.keep(placed.select("_id", "source", "size", "_place", "source_size", "target", (F.col("_all") - F.col("_before")).alias("_upto")), "placed")

    # The queue of all rounds, in order of virtual finish time, and its last place within the budget.
    finish = [(F.col("_upto") + k * F.col("source_size")) / F.col("target") for k in range(max_repeats)]
    waiting = placed.filter("size > 0 AND target > 0").select(F.explode(F.array(*finish)).alias("_finish"), "_place", "size")
    spent = running(waiting, ["_finish", "_place"], "size", "_spent", scratch)
    last = spent.filter(F.col("_spent") <= budget).agg(F.max(F.struct("_finish", "_place")).alias("last")).select("last.*").first()

    def taken(f: Column) -> Column:
        if last["_finish"] is None:
            return F.lit(0)
        at, place = F.lit(last["_finish"]), F.lit(last["_place"])
        return F.when((f < at) | ((f == at) & (F.col("_place") <= place)), 1).otherwise(0)

    rounds = reduce(Column.__add__, map(taken, finish))
    return placed.select("_id", "source", "size", "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), rounds).otherwise(0).cast("long").alias("rounds"))


def op7_mixing(spark, sf_dir):
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return queue(docs).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("rounds") * F.col("size")).alias("taken"))


#: The same with plain windows over whole sources.
OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':7'), 1, 15) AS BIGINT) AS place FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM src),
ratios AS (SELECT *, 2 * source_size / weight AS ratio FROM weighed),
levels AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
    - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM ratios),
levelled AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS water FROM levels),
goals AS (SELECT source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN CAST(2 * source_size AS DOUBLE) ELSE water * weight END AS target FROM levelled),
placed AS (SELECT s.doc_id, s.size, s.place, g.source_size, g.target, CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place) AS BIGINT) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
entries AS (SELECT doc_id, size, place, (upto + k * source_size) / target AS finish FROM placed, (VALUES (0), (1)) r(k) WHERE size > 0 AND target > 0),
spent AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place) AS spent FROM entries),
mix AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM spent WHERE spent <= 1.5::DOUBLE * (SELECT sum(source_size) FROM src) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN mix USING (doc_id)
"""
