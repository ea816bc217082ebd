"""Embedding whitening by a tall-skinny QR decomposition (TSQR).

1. Exact sums a dimension centre the rows: entries are integers, so n*x - S is exact and is rounded once, by the division.
2. Each partition keeps one triangular factor: the QR of the factor so far on top of the next chunk of centred rows.
3. Factors merge in a tree, FAN_IN of them stacked and decomposed again at each node, until one is left.
4. The singular values and right vectors of that factor are those of all centred rows: no covariance is formed. A row's
   product with a right vector, over the root of the variance along it, is its whitened entry.
5. The covariance of the whitened rows is checked against the identity: partitions give centred moments, merged likewise.

Entries become integers floor(SCALE * c) + SHIFT. Vectors of different lengths are fitted apart, each length by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, map_arrow, table

SCALE, SHIFT = 1024, 100_000
#: Components of the result.
COMPONENTS = 8
#: Factors that meet at one node of the tree.
FAN_IN = 8
#: Entries of the rows that one numpy step holds.
STEP_ENTRIES = 1 << 18
#: A vector with an entry of this size or more has no integers and is dropped as those with non-finite entries are.
LIMIT = float(1 << 62)


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, their integers) of the sound vectors of column 1, some rows at a time."""
    column = batch.column(1)
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)  # null entries are not a number
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(flat * SCALE)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < LIMIT))])
    lengths = np.diff(offsets)
    sound = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    for dim in np.unique(lengths[sound]).tolist():
        rows = np.flatnonzero(sound & (lengths == dim))
        step = max(1, STEP_ENTRIES // dim)
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            yield dim, part, scaled[offsets[part][:, None] + np.arange(dim)].astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exact: 64-bit integers where they suffice, else Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums.tolist())) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(diff: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if diff.dtype != object:
        most = int(np.abs(diff).max(initial=0))
        if most * most * max(1, diff.shape[1]) < 1 << 62:
            return (diff * diff).sum(1).tolist()
    return (diff.astype(object) ** 2).sum(1).tolist()


# --- trees of partial results ---------------------------------------------------------------------


_PARTIAL = "slot long, dim int, n long, data binary"
_NAMES = ["slot", "dim", "n", "data"]


def partials(states: dict[int, tuple[int, np.ndarray]], slot: int) -> Iterator[pa.RecordBatch]:
    for dim, (n, data) in states.items():
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([data.tobytes()], pa.binary())], _NAMES)


def reduce_tree(made: DataFrame, merge: Callable[[int, tuple, tuple], tuple], scratch: Scratch) -> DataFrame:
    """Partial results (_PARTIAL), one a task and length, merged FAN_IN at a time until each length has one; slots count tasks from 0."""
    made = scratch.keep(made, "partial")

    def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for slot, dim, n, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                one = n, np.frombuffer(data)
                if key == (slot, dim):
                    state = merge(dim, state, one)
                else:
                    if key:
                        yield from partials({key[1]: state}, key[0])
                    key, state = (slot, dim), one
        if key:
            yield from partials({key[1]: state}, key[0])

    most = made.agg(F.max("slot")).first()[0] or 0
    while most:
        up = made.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).repartition("slot", "dim").sortWithinPartitions("slot", "dim")
        old, made = made, scratch.keep(map_arrow(up, node, _PARTIAL), "partial")
        scratch.drop(old)
        most //= FAN_IN
    return made


def add_rows(factor: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of the rows so far and these."""
    return np.linalg.qr(rows if factor is None else np.vstack([factor, rows]), mode="r")


def merge_factors(dim: int, a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], add_rows(a[1].reshape(-1, dim), b[1].reshape(-1, dim))


def moments(rows: np.ndarray) -> tuple[int, np.ndarray]:
    """(n, mean and centred products) of rows."""
    mean = rows.mean(0)
    apart = rows - mean
    return len(rows), np.concatenate([mean, (apart.T @ apart).ravel()])


def merge_moments(_: int, a: tuple, b: tuple) -> tuple:
    n, k = a[0] + b[0], int((np.sqrt(4 * len(a[1]) + 1) - 1) / 2)
    apart = b[1][:k] - a[1][:k]
    mean = a[1][:k] + apart * (b[0] / n)
    return n, np.concatenate([mean, a[1][k:] + b[1][k:] + (np.outer(apart, apart) * (a[0] * b[0] / n)).ravel()])


# --- the model ------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What the vectors of one length are whitened with."""

    n: int
    sums: np.ndarray  # Python integers
    directions: np.ndarray  # a row a component, in falling variance
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    def project(self, diff: np.ndarray) -> np.ndarray:
        """Whitened rows of n*x - S; not a number along a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.variances > 0, 1 / np.sqrt(self.variances), np.nan)
        return (diff.astype(float) / self.n) @ self.directions.T * scale


def _read(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(vectors[id_col].alias("_id"), vectors[vec_col].cast("array<double>").alias("_v"))


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of vector, from all sound vectors of that length, repeated rows included.

    What comes to the driver is, a length, its sums and the factor of dimension by dimension. A component whose variance is
    0 to rounding has variance 0."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = _read(vectors, id_col, vec_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for dim, part, x in chunks(batch):
                # High and low halves are summed apart, so that no sum overflows.
                own = sums.setdefault(dim, [0, np.zeros(dim, object)])
                own[0] += len(part)
                own[1] = own[1] + (x >> 31).sum(0).astype(object) * (1 << 31) + (x & 0x7FFFFFFF).sum(0).astype(object)
        for dim, (n, total) in sums.items():
            digits = pa.array([str(s) for s in total.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), digits], ["dim", "at", "n", "total"])

    total = map_arrow(rows, add, "dim int, at int, n long, total string").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s"))
    known: dict[int, tuple[int, np.ndarray]] = {}
    for r in total.groupBy("dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("s")).toLocalIterator():
        known[r["dim"]] = r["n"], np.array([int(s["s"]) for s in r["s"]], object)
    if not known:
        return {}
    sent = vectors.sparkSession.sparkContext.broadcast(known)

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: dict[int, tuple[int, np.ndarray | None]] = {}
        for batch in batches:
            for dim, part, x in chunks(batch):
                n, sums = sent.value[dim]
                done, factor = factors.get(dim, (0, None))
                factors[dim] = done + len(part), add_rows(factor, centred(x, n, sums).astype(float) / n)
        yield from partials(factors, TaskContext.get().partitionId())

    out = {}
    for r in reduce_tree(map_arrow(rows, decompose, _PARTIAL), merge_factors, scratch).toLocalIterator():
        dim = r["dim"]
        n, sums = known[dim]
        _, s, right = np.linalg.svd(np.frombuffer(r["data"]).reshape(-1, dim))
        s = np.concatenate([s, np.zeros(dim - len(s))])
        # Rounding of the centred entries and of the decomposition leaves no more than this of a direction without variance.
        s[s <= max(n, dim) ** 0.5 * dim * np.finfo(float).eps * s[0]] = 0
        out[dim] = Whitening(n, sums, right[:components], (s * s / n)[:components], float((s * s).sum() / n))
    return out


def check(vectors: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vec_col: str = "embedding") -> dict[int, Whitening]:
    """models with identity_error: how far the covariance of the whitened vectors is from the identity, over components with variance."""
    if not models:
        return models
    sent = vectors.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for dim, _, x in chunks(batch):
                m = sent.value[dim]
                one = moments(m.project(centred(x, m.n, m.sums))[:, m.variances > 0])
                states[dim] = merge_moments(dim, states[dim], one) if dim in states else one
        yield from partials(states, TaskContext.get().partitionId())

    made = map_arrow(_read(vectors, id_col, vec_col), measure, _PARTIAL)
    for r in reduce_tree(made, merge_moments, Scratch(vectors.sparkSession, "whitening")).toLocalIterator():
        model = models[r["dim"]]
        k = int((model.variances > 0).sum())
        covariance = np.frombuffer(r["data"])[k:].reshape(k, k) / r["n"]
        model.identity_error = float(np.abs(covariance - np.eye(k)).max()) if k else None
    return models


def transform(vectors: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(_id, dim, n, deviation, whitened array) of each sound vector of a length that models have; deviation is exact, null beyond 38 digits.

    Dropped are vectors that are null or empty or hold null, non-finite or too large entries (LIMIT). Repeated rows give
    repeated rows; a whitened entry is null along a component without variance."""
    kind = vectors.schema[id_col].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in chunks(batch):
                if dim not in sent.value:
                    continue
                m = sent.value[dim]
                diff = centred(x, m.n, m.sums)
                white = m.project(diff)
                k, many = white.shape[1], len(rows)
                entries = pa.array(white.ravel(), mask=np.isnan(white).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array(np.full(many, dim), pa.int32()),
                        pa.array(np.full(many, m.n), pa.int64()),
                        pa.array([Decimal(d) if d < 10**38 else None for d in deviations(diff)], pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * k, pa.int32()), entries),
                    ],
                    ["_id", "dim", "n", "deviation", "whitened"],
                )

    return map_arrow(_read(vectors, id_col, vec_col), run, f"_id {kind}, dim int, n long, deviation decimal(38,0), whitened array<double>")


def op13_whitening(spark, sf_dir):
    """All vectors along the first components, with the variance that each explains."""
    vectors = table(spark, sf_dir, "embeddings")
    models = check(vectors, fit(vectors))
    rows = [(d, float(v / m.trace) if m.trace else None, k, m.identity_error) for d, m in models.items() for k, v in enumerate(m.variances.tolist(), 1)]
    explained = spark.createDataFrame(rows, "_dim int, explained double, component int, identity_error double")
    out = transform(vectors, models).select("_id", "dim", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    out = out.join(explained, (F.col("dim") == F.col("_dim")) & (F.col("at") + 1 == F.col("component")))
    return out.select(F.col("_id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")
