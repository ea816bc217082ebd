"""Continuous versions: a job queue with claims, progress, reminders, rate limits, retention, scoring on arrival."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MAX_ATTEMPTS = 3
LOCK_MS = 5 * 60 * 1000


def arrivals(spark: SparkSession, path: str, schema: str, per_trigger: int = 3) -> DataFrame:
    """Files of JSON jobs as a stream; per_trigger is how many are taken at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def claimable(jobs: DataFrame, now: Column, lock_minutes: int = 5) -> DataFrame:
    """Jobs that a worker may claim, with what becomes of them: queued ones, and running ones whose lock is stale; those that
    have been tried too often fail. In order of creation."""
    stale = (F.col("status") == "processing") & (F.col("locked_at") < now - F.expr(f"INTERVAL {lock_minutes} MINUTES"))
    rows = jobs.filter((F.col("status") == "queued") | stale)
    tried = F.coalesce("attempts", F.lit(0)) + 1
    return rows.withColumns({"attempts": tried, "status": F.when(tried > MAX_ATTEMPTS, "failed").otherwise("processing")}).orderBy("created_at", "contract_id")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts = state.get if state.exists else ("queued", 0)
    if state.hasTimedOut:
        status = "queued"
    for frame in frames:
        for event in frame.sort_values("ts")["event"]:
            if event == "claim" and status == "queued":
                attempts += 1
                status = "failed" if attempts > MAX_ATTEMPTS else "processing"
            elif event in ("done", "failed") and status == "processing":
                status = event
            elif event == "enqueue" and status in ("done", "failed"):
                status, attempts = "queued", 0
    state.update((status, attempts))
    if status == "processing":
        state.setTimeoutDuration(LOCK_MS)
    yield pd.DataFrame([(key[0], status, attempts)], columns=["contract_id", "status", "attempts"])


def job_states(events: DataFrame) -> DataFrame:
    """State of each job from a stream of events (contract_id long, event, ts): a claim holds until it is done, failed, or its lock
    times out; there is one writer a job, so two claims never both hold."""
    return events.groupBy("contract_id").applyInPandasWithState(
        _advance, "contract_id long, status string, attempts long", "status string, attempts long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


#: How long a job that ended is remembered, so that late and repeated events do not open it again, in milliseconds.
LINGER_MS = 10 * 60 * 1000
PROGRESS = "contract_id long, status string, progress int, step string, terminal boolean"


class Progress(StatefulProcessor):
    """What a follower of a job is told: the newest progress of each batch, then one terminal row, then nothing."""

    def __init__(self, linger_ms: int = LINGER_MS):
        self.linger_ms = linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        newest, ended = self.seen.get() if self.seen.exists() else (-1, False)
        if ended:
            return
        at = frame["ts"].astype("datetime64[ms]").astype("int64")
        fresh = frame[at > newest]
        over = fresh[fresh["status"].isin(["completed", "failed"])]
        if not len(fresh):
            return
        last = (over if len(over) else fresh).iloc[-1 if not len(over) else 0]
        now = int(pd.Timestamp(last["ts"]).value // 1_000_000)
        self.seen.update((now, bool(len(over))))
        if len(over):
            self.handle.registerTimer(now + self.linger_ms)
        status = "done" if last["status"] == "completed" else last["status"]
        yield pd.DataFrame({"contract_id": [key[0]], "status": [status], "progress": [int(last["progress"])], "step": [last["step"]], "terminal": [bool(len(over))]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())


def progress(events: DataFrame, late: str = "1 minute", linger_ms: int = LINGER_MS) -> DataFrame:
    """Progress of each job (PROGRESS) from a stream of events (contract_id long, ts, status, progress int, step).

    A batch of events of a job gives its newest one, if that is newer than what was told; completed (told as done) or failed ends the
    job with one terminal row, whatever comes after or again. A timer on the watermark then drops what is kept of the job. Needs
    the RocksDB state store (session.STREAMING)."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy("contract_id").transformWithStateInPandas(Progress(linger_ms), PROGRESS, "Append", "EventTime")


def upcoming(events: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The first event not told yet of each contract within the next days: contract_id, event_type, date, days_remaining.

    events: contract_id, event_type, date, notified."""
    near = events.filter(~F.coalesce("notified", F.lit(False)) & (F.col("date") >= now) & (F.col("date") <= now + F.expr(f"INTERVAL {days} DAYS")))
    first = near.groupBy("contract_id").agg(F.min(F.struct("date", "event_type")).alias("e"))
    left = F.ceil((F.unix_millis(F.col("e.date").cast("timestamp")) - F.unix_millis(now.cast("timestamp"))) / 86_400_000).cast("int")
    return first.select("contract_id", F.col("e.event_type").alias("event_type"), F.col("e.date").alias("date"), left.alias("days_remaining"))


def once(events: DataFrame, key: list[str], ts: str, late: str = "30 days") -> DataFrame:
    """A stream without repeats of a key, as long as the watermark reaches back."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def rate_limited(requests: DataFrame, by: str, ts: str = "ts", window: str = "15 minutes", limit: int = 1000, late: str | None = None) -> DataFrame:
    """Windows in which a caller made more than limit requests; with late, over a stream."""
    rows = requests.withWatermark(ts, late) if late else requests
    counted = rows.groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("requests"))
    return counted.filter(F.col("requests") > limit).select(by, F.col("w.start").alias("window_start"), "requests")


def retained(metrics: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Metrics young enough to keep."""
    return metrics.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


#: Patterns of repealed acts that one expression takes.
MOST_PATTERNS = 1000


def repeal_sweep(statutes: DataFrame, repealed: DataFrame, most: int = MOST_PATTERNS) -> DataFrame:
    """Statutes with is_repealed and repealed_by set where an act's name matches (pattern, repealed_by), the least of several.

    One pass over the statutes, which may have nulls in any column, if the patterns are a short list, whose length is checked. With
    more of them the distinct names of acts are matched with blocks of patterns, and what they match is joined back."""
    patterns = repealed.select("pattern", "repealed_by").filter(F.col("pattern").isNotNull())
    found = patterns.limit(most + 1).collect()
    act = lambda rows: F.array_min(F.array(*(F.when(F.col("act_name").rlike("(?i)" + r["pattern"]), F.lit(r["repealed_by"])).cast("string") for r in rows)))
    if len(found) <= most:
        rows = statutes.withColumn("_by", act(found) if found else F.lit(None).cast("string"))
    else:
        names = statutes.select("act_name").filter(F.col("act_name").isNotNull()).distinct()
        blocks = -(-patterns.count() // max(1, most // 2))
        dealt = patterns.withColumn("_b", F.pmod(F.xxhash64("pattern", "repealed_by"), F.lit(blocks)))
        parts = [names.withColumn("_by", act(dealt.filter(F.col("_b") == k).collect() or [{"pattern": r"[^\s\S]", "repealed_by": None}])) for k in range(blocks)]
        least = reduce(DataFrame.unionByName, parts).filter("_by IS NOT NULL").groupBy(F.col("act_name").alias("_act")).agg(F.min("_by").alias("_by"))
        rows = statutes.join(least, F.col("act_name") == F.col("_act"), "left").drop("_act")
    return rows.withColumns({"is_repealed": F.col("_by").isNotNull() | F.coalesce("is_repealed", F.lit(False)), "repealed_by": F.coalesce("_by", "repealed_by")}).drop("_by")


def reset_quotas(users: DataFrame, now: Column, days: int = 30) -> DataFrame:
    due = F.col("reset_at") <= now
    return users.withColumns({"used": F.when(due, 0).otherwise(F.col("used")), "reset_at": F.when(due, now + F.expr(f"INTERVAL {days} DAYS")).otherwise(F.col("reset_at"))})


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once_only: bool = False):
    """Start a stream whose batches go to sink, which must allow for a batch given twice."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once_only else writer).start()
