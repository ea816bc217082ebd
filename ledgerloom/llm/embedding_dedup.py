"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

1. Equal vectors of one label are collapsed to the one of least id, with their number.
2. Every vector gets a key in each of several tables: the signs of its products with the table's random hyperplanes.
   Vectors at the least cosine agree in a sign with a known probability, so the number of tables follows from the number
   of bits and the recall wanted (plan_tables); the number of bits follows from the size of the largest label.
3. Vectors alone under their key leave. The others meet under (label, key): cosines are computed in double precision, a
   block of rows against a block of rows. A key with many rows is dealt over pairs of blocks of about BLOCK rows. A pair
   that meets in several tables counts in the first of them only. Blocks give sums: links a vector, and for each vector
   the least vector of its component within the block. Pairs are never written out.
4. Components are joined up over all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, map_arrow, table
from ledgerloom.llm.components import connected_components

MIN_COSINE = 0.98
#: Least probability that two vectors at the least cosine meet in a table. Pairs above it meet more surely.
RECALL = 0.99995
#: Unrelated rows of one label wanted under a key: so few that most rows are alone under most keys, and only ids and keys, not
#: vectors, are exchanged for them.
PER_KEY = 1 / 32
#: Rows of a block.
BLOCK = 512
SEED = 17


def plan_tables(n: int, min_cosine: float = MIN_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors of a label."""
    bits = min(60, max(4, math.ceil(math.log2(max(n, 2) / PER_KEY))))
    meet = (1 - math.acos(min_cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def signatures(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(id, label, copies, embedding) to (id, label, copies, dim, vec, sig): vec as bytes of doubles, scaled so that the largest component is 1 or -1; sig the keys of all tables."""
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        column = batch.column(3)
        lengths = np.diff(column.offsets.to_numpy())
        flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
        at = np.concatenate([[0], np.cumsum(lengths)])
        if len(flat):  # so that products neither over- nor underflow
            flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), at[:-1]), lengths)
        keys = np.zeros((len(lengths), tables), np.int64)
        for dim in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dim)
            if dim not in planes:
                planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))
            signs = flat[at[rows][:, None] + np.arange(dim)] @ planes[dim] > 0
            keys[rows] = signs.reshape(len(rows), tables, bits) @ weights
        vec = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        sig = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths, pa.int32()), pa.array(vec, pa.binary()), sig], ["id", "label", "copies", "dim", "vec", "sig"])


def compare(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, sigs: np.ndarray, side: np.ndarray, table_no: int, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, least id of its component) within one block pair.

    side is 0 for the rows of the first block and 1 for those of the second; of two different blocks only pairs across count.
    """
    norm = np.sqrt((x * x).sum(1))
    linked = x @ x.T >= min_cosine * (norm[:, None] * norm)  # x is scaled, so norms lie between 1 and the root of its length
    if side.any():
        linked &= side[:, None] != side
    np.fill_diagonal(linked, False)
    fresh = linked.copy()
    for t in range(table_no):  # pairs that an earlier table has counted
        fresh &= sigs[:, t][:, None] != sigs[:, t]
    links = fresh @ copies
    least = ids.copy()
    while True:
        around = np.where(linked, least, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        new = np.minimum(least, around)
        if (new == least).all():
            return links, least
        least = new


def _blocks(batches: Iterator[pa.RecordBatch], min_cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group to (id, links, least), a row for each row that links."""

    def done(rows: list[dict]) -> pa.RecordBatch:
        ids, copies = np.array([r["id"] for r in rows]), np.array([r["copies"] for r in rows])
        x = np.frombuffer(b"".join(r["vec"] for r in rows)).reshape(len(rows), -1)
        sigs = np.array([r["sig"] for r in rows])
        links, least = compare(ids, copies, x, sigs, np.array([r["side"] for r in rows]), rows[0]["table_no"], min_cosine)
        some = (links > 0) | (least != ids)
        return pa.RecordBatch.from_arrays([pa.array(c[some].astype(np.int64)) for c in (ids, links, least)], ["id", "links", "least"])

    held: list[dict] = []
    group = None
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[c] for c in ("label", "dim", "table_no", "key", "first", "second"))
            if own != group:
                if len(held) > 1:
                    yield done(held)
                held, group = [], own
            held.append(row)
    if len(held) > 1:
        yield done(held)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row a vector: _id, n_links, component_id.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine, in double precision,
    is min_cosine or more. Null and empty vectors, zero ones, and those with null or non-finite components link with
    nothing. Rows that repeat an id and its vector count as copies of it; an id with two different vectors of one label is
    compared by one of them. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("label"), v.alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("label").isNotNull(), F.lit(False)))
    digest = [F.when(F.col("sound"), F.xxhash64(F.lit(s), "v")).alias(f"d{s}") for s in (1, 2)]
    # Copies meet by label and a digest of 128 bits.
    whole = rows.filter("sound").select("_id", "label", "v", *digest)
    unique = whole.groupBy("label", "d1", "d2").agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    unique = scratch.keep(unique, "unique")
    most = unique.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(most, min_cosine)

    of = whole.join(unique.select("id", F.col("label").alias("_l"), F.col("d1").alias("_d1"), "copies"), (F.col("_id") == F.col("id")) & (F.col("d1") == F.col("_d1")) & (F.col("label") == F.col("_l"))).select("id", "label", "copies", "v")
    of = of.dropDuplicates(["id", "label"])  # an id that stands twice with one vector
    label_type = vectors.schema[label_col].dataType.simpleString()
    signed = map_arrow(of, lambda b: signatures(b, bits, tables), f"id long, label {label_type}, copies long, dim int, vec binary, sig array<long>")
    signed = scratch.keep(signed, "signed")

    # Who meets: keys with two rows or more, without the vectors at first.
    group = ["label", "dim", "table_no", "key"]
    keyed = signed.select("id", "label", "dim", F.posexplode("sig").alias("table_no", "key"))
    counts = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = keyed.join(counts, group).withColumn("n", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("id", "table_no"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("id", *group, F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    carried = met.join(signed.select("id", F.col("label").alias("_l"), "copies", "vec", "sig"), "id").filter(F.col("label") == F.col("_l")).drop("_l")
    blocks = [*group, "first", "second"]
    dealt = carried.repartition(*blocks).sortWithinPartitions(*blocks)
    found = scratch.keep(map_arrow(dealt, lambda b: _blocks(b, min_cosine), "id long, links long, least long"), "found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("least").alias("b")), scratch)
    known = unique.join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    known = known.select(F.col("label").alias("_l"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("_id", "label", *digest).join(known, (F.col("label") == F.col("_l")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    return out.select("_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_id").alias("component_id"))


def op6_embedding_dedup(spark, sf_dir):
    """Links and components of all vectors: vec_id, n_links, component_id, kept."""
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("_id").alias("vec_id"), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))


#: The same by comparing all pairs of a label.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp
"""
