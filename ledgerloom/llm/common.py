"""What several operators share: table access, scratch tables, text batches and word hashing in numpy."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that one numpy step holds at a time, in bytes; a longer text is a step of its own.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scratch tables -------------------------------------------------------------------------------


_UNSET: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share, with its scheme.

    Where it is unset a folder of this machine, the same for the whole application, if driver and executors are one
    process, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _UNSET[app] = _UNSET.get(app) or "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return re.sub(r"^file:/(?!/)", "file:///", whole)


#: Short rows (ids, links, labels) that one file of a scratch table holds, about, where their number is known.
FILE_ROWS = 200_000


class Scratch:
    """Tables below the shared folder that cut lineage; keep() writes and rereads, drop() deletes one early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex[:12]}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """df written and reread; rows says how many short rows it has at most, so that few rows make few tasks."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        df.write.parquet(path := self.path(name))
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *kept: DataFrame | str) -> None:
        for x in kept:
            delete(self.spark, x if isinstance(x, str) else x._scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete path in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# --- Arrow text batches ---------------------------------------------------------------------------


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch of texts, in place of the session's default of 64 MB, which a core may hold several times over.
BATCH_BYTES = "4m"


def give_back() -> None:
    """Return what a task freed to the machine: its worker waits for other tasks and would hold it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run, ddl: str) -> DataFrame:
    """df.mapInArrow(run, ddl) in batches of BATCH_BYTES, unless the session has set a size of its own.

    Spark reads the size when it plans the map, which is when the result is run, so it is the session's from here on."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) in (None, "64m", "64MB", "67108864", "67108864b"):
        conf.set(_BATCH_BYTES, BATCH_BYTES)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, ddl)


def slices(batches: Iterator[pa.RecordBatch], column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column holds about step bytes in each; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.asarray(text_buffers(batch.column(batch.schema.get_field_index(column)))[1])[1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- word hashing ---------------------------------------------------------------------------------

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier modulo 2**64 and their inverses."""
    global _powers
    if len(_powers[0]) <= n:
        with np.errstate(over="ignore"):
            made = []
            for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 2**64)):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
        _powers = tuple(made)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span raw[start:end]; equal bytes hash alike wherever they stand."""
    up, down = powers(len(raw))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * up[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of the rows of a text column."""
    inside = ~blank[raw]
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cuts = offsets[(offsets < n)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cuts] = inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:-1]
    last = last[last > 0] - 1
    stops[last] = inside[last]
    stops[-1] = inside[-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def pieces(raw: np.ndarray, step: int, cut: np.ndarray = BLANK) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of about step bytes of one text that begin after a byte of cut; a stretch without such a byte goes on to the next one."""
    at, n = 0, len(raw)
    while at < n:
        to = min(at + step, n)
        if to < n:
            back = np.flatnonzero(cut[raw[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                while to < n:
                    ahead = np.flatnonzero(cut[raw[to : to + step]])
                    if len(ahead):
                        to += int(ahead[0]) + 1
                        break
                    to = min(to + step, n)
        yield at, to
        at = to


def span_hash(raw: np.ndarray, step: int) -> np.ndarray:
    """What spans_hash gives of one span that is all of raw, summed in steps, so that its length does not matter."""
    up = powers(step)[0]
    total, scale = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for a in range(0, len(raw), step):
            part = raw[a : a + step]
            total += (_TABLE[part] * up[: len(part)]).sum(dtype=np.uint64) * scale
            scale *= up[step]
        return mix(np.array([total + np.uint64(len(raw))], np.uint64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each row); bytes go through fold first. A single text of any length is done in steps."""
    if len(offsets) == 2 and len(raw) > 2 * STEP_BYTES:
        found = []
        for a, b in pieces(raw, STEP_BYTES):
            part = raw[a:b] if fold is None else fold[raw[a:b]]
            if b - a > 2 * STEP_BYTES:  # one word, with the blank after it or without
                found.append(span_hash(part[: b - a - int(BLANK[part[-1]])], STEP_BYTES))
            else:
                starts, ends, _ = word_spans(part, np.array([0, b - a]))
                found.append(spans_hash(part, starts, ends))
        every = np.concatenate(found)
        return every, np.array([len(every)])
    raw = raw if fold is None else fold[raw]
    starts, ends, rows = word_spans(raw, offsets)
    return spans_hash(raw, starts, ends), np.bincount(rows, minlength=len(offsets) - 1)


def windows_hash(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries; the caller drops windows that cross rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, STEP_BYTES):
            total = np.zeros(min(STEP_BYTES, n - a), np.uint64)
            for j in range(k):
                total += words[a + j : a + j + len(total)]
                total *= np.uint64(0xD6E8FEB86659FD93)
            out[a : a + len(total)] = mix(total)
    return out
