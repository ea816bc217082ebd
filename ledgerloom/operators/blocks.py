"""Cosines of many vectors against many, a block of rows by a block of rows in one matrix product.

One side streams through the tasks in Arrow batches, the other is sent to them in blocks of at most BLOCK_ENTRIES numbers: one
block where it fits, else one after the other, so that what is broadcast has a bound at any size. best() needs no shuffle
with one block; nearest() shuffles what each task found, k rows a query.

Vectors are compared if they have one length; a zero vector has cosine 0 with any, and null vectors, and those whose
cosine is no number, meet nothing. A product in blocks only proposes: the cosines that are kept are summed again pair by
pair, in the order of the entries, so that equal vectors have equal cosines wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a block of vectors, 32 MB of them.
BLOCK_ENTRIES = 1 << 22
#: Rows of the streaming side in one product.
STEP = 1024
#: Most cosines of one product, and candidates of nearest() that wait to be merged.
PRODUCT = 1 << 21
MERGE = 1 << 16
#: Cosines this close to the least that counts are summed again.
SLACK = 1e-9


class Matrix:
    """Vectors by length, with their row numbers."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.list_(pa.float64()))
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        size, sound = np.diff(offsets), column.is_valid().to_numpy(zero_copy_only=False)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for d in np.unique(size[sound]).tolist():
            rows = np.flatnonzero(sound & (size == d))
            vectors = flat[offsets[rows][:, None] + np.arange(d)]
            self.by_length[d] = rows, vectors, np.sqrt((vectors * vectors).sum(1))


def cosines(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """All cosines of two blocks; minus infinity where there is none."""
    with np.errstate(all="ignore"):
        size = nx[:, None] * ny
        found = np.where(size > 0, (x @ y.T) / size, 0.0)
        return np.where(np.isnan(found) | np.isnan(size), -np.inf, found)


def again(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with the same row of y."""
    with np.errstate(all="ignore"):
        size = nx * ny
        return np.where(size > 0, (x * y).sum(1) / size, 0.0)


def sent_blocks(df: DataFrame, columns: list[str], vec: str) -> list:
    """df's columns, the vector last, as broadcasts of at most about BLOCK_ENTRIES numbers each. One small job counts them."""
    rows = df.select(*columns, vec).filter(F.col(vec).isNotNull())
    total = rows.agg(F.sum(F.size(vec).cast("long"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_ENTRIES))
    # The hash deals by all columns, so that equal vectors of different rows do not gather in one block.
    banded = rows if n == 1 else rows.withColumn("_band", F.pmod(F.xxhash64(*columns, vec), F.lit(n)))
    for k in range(n):
        part = rows if n == 1 else banded.filter(F.col("_band") == k).drop("_band")
        yield df.sparkSession.sparkContext.broadcast(part.toArrow().combine_chunks().to_batches())


def _kinds(df: DataFrame, **names: str) -> str:
    return ", ".join(f"`{out}` {df.schema[c].dataType.simpleString()}" for out, c in names.items())


def best(rows: DataFrame, targets: DataFrame, r_id: str, r_vec: str, t_id: str, t_vec: str, k: int = 1) -> DataFrame:
    """(r_id, t_id, score): for each row the k targets of greatest cosine, of equal ones those of least id. Ids of rows are distinct."""
    kinds = f"{_kinds(rows, **{r_id: r_id})}, {_kinds(targets, **{t_id: t_id})}, score double"
    made = []
    for sent in sent_blocks(targets, [t_id], t_vec):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = [b for b in sent.value if b.num_rows]
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
            if block is None:
                return
            # In order of id, so that the first of equal ones is the least.
            block = block.take(pa.compute.sort_indices(block.column(0)))
            other = Matrix(block.column(1))
            step = max(1, min(STEP, PRODUCT // block.num_rows))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    for d, (at, x, nx) in Matrix(part.column(1)).by_length.items():
                        if d not in other.by_length:
                            continue
                        to, y, ny = other.by_length[d]
                        found = cosines(x, nx, y, ny)
                        floor = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] > k else np.full(len(at), -np.inf)
                        row, col = np.nonzero((found >= floor[:, None] - SLACK) & (found > -np.inf))
                        score = again(x[row], nx[row], y[col], ny[col])
                        order = np.lexsort((col, -score, row))
                        row, col, score = row[order], col[order], score[order]
                        first = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) < k)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at[row[first]])), block.column(0).take(pa.array(to[col[first]])), pa.array(score[first])], [r_id, t_id, "score"])

        made.append(rows.select(r_id, r_vec).filter(F.col(r_vec).isNotNull()).mapInArrow(run, kinds))
    if len(made) == 1:
        return made[0]
    every = made[0]
    for m in made[1:]:
        every = every.unionByName(m)
    if k == 1:
        first = every.groupBy(r_id).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(t_id).alias("t"))).alias("b"))
        return first.select(r_id, F.col("b.t").alias(t_id), (-F.col("b.s")).alias("score"))
    order = Window.partitionBy(r_id).orderBy(F.desc("score"), t_id)
    return every.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def nearest(queries: DataFrame, corpus: DataFrame, q_id: str, q_vec: str, c_id: str, c_vec: str, k: int, keys: tuple[str, str] | None = None, apart: bool = False) -> DataFrame:
    """(q_id, c_id, score): for each query, in each task over the corpus, the k rows of greatest cosine, then least id.

    The k best over all are among them. Query ids are distinct. With keys (an array column of the queries, a column of the
    corpus of the elements' type) a query meets the rows whose key its array has; with apart, none of its own id. The corpus
    is dealt over all cores, as a file of few row groups would keep it in few tasks."""
    kinds = f"{_kinds(queries, **{q_id: q_id})}, {_kinds(corpus, **{c_id: c_id})}, score double"
    asked_key, key = keys or (None, None)
    side = corpus.select(c_id, c_vec, *([F.col(key).alias("_key")] if keys else [])).filter(F.col(c_vec).isNotNull())
    side = side.repartition(2 * corpus.sparkSession.sparkContext.defaultParallelism, c_id)
    made = None
    for sent in sent_blocks(queries, [q_id, *([asked_key] if keys else [])], q_vec):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = [b for b in sent.value if b.num_rows]
            if not held:
                return
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            asked = Matrix(block.column(block.num_columns - 1))
            names = block.column(0).to_pandas().to_numpy()
            # Of each key (None where there are none) and length, the queries that ask for it.
            wanted: dict[object, dict[int, tuple]] = {None: asked.by_length}
            if keys:
                lists = block.column(1).to_pylist()
                wanted = {}
                for d, (rows, x, nx) in asked.by_length.items():
                    places: dict[object, list[int]] = {}
                    for n, row in enumerate(rows.tolist()):
                        for value in set(lists[row] or ()) - {None}:
                            places.setdefault(value, []).append(n)
                    for value, at in places.items():
                        wanted.setdefault(value, {})[d] = rows[at], x[at], nx[at]
            least = np.full(block.num_rows, -np.inf)  # the k-th best so far
            best_ = pd.DataFrame({"q": np.zeros(0, np.int64), "c": [], "score": np.zeros(0)})
            new: list[pd.DataFrame] = []

            def merged() -> pd.DataFrame:
                every = pd.concat([b for b in (best_, *new) if len(b)]).sort_values(["q", "score", "c"], ascending=[True, False, True])
                out = every.groupby("q", sort=False).head(k)
                full = out.groupby("q")["score"].agg(["size", "min"])
                full = full[full["size"] == k]
                least[full.index.to_numpy()] = full["min"].to_numpy()
                new.clear()
                return out

            for batch in batches:
                ids = batch.column(0).to_pandas().to_numpy()
                values = batch.column(2).to_pylist() if keys else None
                for d, (at, y, ny) in Matrix(batch.column(1)).by_length.items():
                    parts: dict[object, list[int]] = {}
                    for n, row in enumerate(at.tolist() if keys else ()):
                        parts.setdefault(values[row], []).append(n)
                    for value, chosen in parts.items() if keys else [(None, np.arange(len(at)))]:
                        if d not in wanted.get(value, {}):
                            continue
                        rows, x, nx = wanted[value][d]
                        step = max(1, min(STEP, PRODUCT // len(rows)))
                        for a in range(0, len(chosen), step):
                            here = np.asarray(chosen[a : a + step])
                            found = cosines(x, nx, y[here], ny[here])
                            if apart:
                                found[names[rows][:, None] == ids[at[here]]] = -np.inf
                            good = (found >= least[rows][:, None] - SLACK) & (found > -np.inf)
                            if found.shape[1] > k and np.count_nonzero(good) > 2 * k * len(rows):
                                good &= found >= np.partition(found, -k, axis=1)[:, -k, None] - SLACK
                            i, j = np.nonzero(good)
                            if len(i):
                                new.append(pd.DataFrame({"q": rows[i], "c": ids[at[here[j]]], "score": again(x[i], nx[i], y[here[j]], ny[here[j]])}))
                                if sum(map(len, new)) > max(len(best_), MERGE):
                                    best_ = merged()
            if new:
                best_ = merged()
            if len(best_):
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(best_["q"].to_numpy())), pa.array(best_["c"].tolist(), batch.column(0).type), pa.array(best_["score"].to_numpy())], [q_id, c_id, "score"])

        one = side.mapInArrow(run, kinds)
        made = one if made is None else made.unionByName(one)
    return made


#: Rows of one side of a block of a group.
GROUP_ROWS = 512


def within_groups(rows: DataFrame, group: str, r_id: str, vec: str, k: int) -> DataFrame:
    """(group, query_id, other_id, score): for each row, from each block of its group, the k rows of greatest cosine, then least id, itself
    among them. The k best of the group are among these.

    A group of many rows is dealt over pairs of blocks of about GROUP_ROWS rows, so that no task holds more. Ids are distinct."""
    sound = rows.filter(F.col(vec).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(r_id).alias("_id"), F.col(vec).cast("array<double>").alias("_v"))
    sizes = sound.groupBy(F.col("_g").alias("_h")).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("_n"))
    dealt = sound.join(sizes, F.col("_g") == F.col("_h")).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # A row asks in the cells of its own block's row and answers in those of its column; in the cell on the diagonal it does both.
    asks = dealt.select("_g", F.col("_own").alias("_a"), F.col("_other").alias("_b"), F.lit(0).alias("_side"), "_id", "_v")
    told = dealt.select("_g", F.col("_other").alias("_a"), F.col("_own").alias("_b"), F.lit(1).alias("_side"), "_id", "_v")
    cells = asks.unionByName(told).repartition("_g", "_a", "_b").sortWithinPartitions("_g", "_a", "_b", "_side")
    kind = rows.schema[r_id].dataType.simpleString()

    def cell(batch: pa.Table) -> pa.RecordBatch:
        side = batch.column("_side").to_numpy()
        x, y = (batch.filter(pa.array(side == n)).combine_chunks() for n in (0, 1))
        of, to = (Matrix(t.column("_v").combine_chunks()) for t in (x, y))
        ids = y.column("_id").to_pandas().to_numpy()
        found = []
        for d, (at, vectors, norms) in of.by_length.items():
            if d in to.by_length:
                there, others, sizes_ = to.by_length[d]
                score = cosines(vectors, norms, others, sizes_)
                floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(at), -np.inf)
                i, j = np.nonzero((score >= floor[:, None] - SLACK) & (score > -np.inf))
                found.append(pd.DataFrame({"q": at[i], "j": there[j], "c": ids[there[j]], "score": again(vectors[i], norms[i], others[j], sizes_[j])}))
        best_ = pd.concat(found).sort_values(["q", "score", "c"], ascending=[True, False, True]).groupby("q", sort=False).head(k) if found else pd.DataFrame({"q": np.zeros(0, int), "j": np.zeros(0, int), "score": np.zeros(0)})
        take = lambda t, c, rows_: t.column(c).combine_chunks().take(pa.array(rows_.to_numpy(), pa.int64()))
        return pa.RecordBatch.from_arrays([take(x, "_g", best_["q"]), take(x, "_id", best_["q"]), take(y, "_id", best_["j"]), pa.array(best_["score"].to_numpy())], ["group", "query_id", "other_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("_g", "_a", "_b")), strict=True))
            start = 0
            for n in range(1, len(keys) + 1):
                if n == len(keys) or keys[n] != keys[start]:
                    if last is not None and keys[start] != last:
                        yield cell(pa.Table.from_batches(held))
                        held = []
                    last = keys[start]
                    held.append(batch.slice(start, n - start))
                    start = n
        if held:
            yield cell(pa.Table.from_batches(held))

    return cells.mapInArrow(run, f"group {rows.schema[group].dataType.simpleString()}, query_id {kind}, other_id {kind}, score double")
