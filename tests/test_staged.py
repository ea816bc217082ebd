"""Stages that stop and go on, appends that count once, progress that ends once, sweeps with many patterns."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import enrich, upsert
from ledgerloom.operators.staged import Stages
from ledgerloom.session import STREAMING
from ledgerloom.streaming import jobs


def flaky(frame: pd.DataFrame) -> pd.DataFrame:
    """Fails on every third row the first time, and leaves out every fifth; always fails on row 11."""
    if ((frame["k"] % 3 == 0) & (frame["_attempt"] == 1)).any() or (frame["k"] == 11).any():
        raise RuntimeError("no answer today")
    said = frame[(frame["k"] % 5 != 0) | (frame["_attempt"] > 1)]
    return said[["k"]].assign(level=said["text"].str.upper(), score=said["_attempt"].astype(float))


def test_stages_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}", k % 7) for k in range(40)], "k long, body string, score int").repartition(3)
    where = F.col("score") != 6
    stages = Stages(spark, f"file://{tmp_path}/s", ["k"])
    kinds = "level string, score double"
    asked = {k for k in range(40) if k % 7 != 6}
    assert stages.answered("a") is None and stages.open_rows(rows, "a", where).count() == len(asked)
    left = stages.run(rows, "a", "body", flaky, kinds, where, batch=4)
    first = {r["k"] for r in stages.answered("a").collect()}
    assert first == {k for k in asked if k % 3 and k % 5 and k != 11} and left == len(asked) - len(first)
    # Another object over the same path is what a later process sees.
    later = Stages(spark, f"file://{tmp_path}/s", ["k"])
    assert later.complete(rows, "a", "body", flaky, kinds, where) == 2
    answers = later.answered("a").collect()
    assert sorted(r["k"] for r in answers) == sorted(asked - {11}) and all(r["score"] == (1 if r["k"] in first else 2) for r in answers)
    tried = spark.read.parquet(f"file://{tmp_path}/s/a").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in tried} == {k: 1 if k in first else 3 if k == 11 else 2 for k in asked}
    assert later.complete(rows, "a", "body", flaky, kinds, where) == 0
    out = {r["k"]: r for r in later.result(rows, "a", {"level": "standard"}).collect()}
    assert len(out) == 40 and out[1]["level"] == "T1" and out[11]["level"] == out[6]["level"] == "standard" and out[6]["score"] == 6
    # A second stage asks only what the first one's answers lead to.
    again = later.result(rows, "a").filter("level IS NOT NULL")
    assert later.complete(again, "b", "level", lambda f: f[["k"]].assign(better="yes"), "better string", F.col("score") > 1) == 1
    assert {r["k"] for r in later.answered("b").collect()} == asked - first - {11}
    empty = Stages(spark, f"file://{tmp_path}/e", ["k"])
    assert empty.complete(rows.limit(0), "a", "body", flaky, kinds) == 0 and empty.result(rows, "a", {"level": "x"}).filter("level = 'x'").count() == 40


def test_batches_count_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    batch = lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    assert upsert.append_once(batch(1, 2), 0, path) and not upsert.append_once(batch(1, 2), 0, path)
    # A batch that died after its rows and before the ledger is seen only when it is written again.
    batch(7, 8).write.parquet(f"{path}/rows/batch=1")
    assert sorted(r["x"] for r in upsert.appended(spark, path).collect()) == [1, 2]
    assert upsert.append_once(batch(3), 1, path)
    assert sorted((r["batch"], r["x"]) for r in upsert.appended(spark, path).collect()) == [(0, 1), (0, 2), (1, 3)]


def test_a_stream_replayed_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"contract_id": k}))
    path = f"file://{tmp_path}/out"
    for n in range(2):  # the second stream has lost its checkpoint and starts again
        stream = jobs.arrivals(spark, f"file://{tmp_path}/in", "contract_id long", 2)
        q = jobs.run(stream, lambda df, i: upsert.append_once(df, i, path), f"{tmp_path}/checkpoint{n}", once_only=True)
        q.awaitTermination(120)
        assert sorted(r["contract_id"] for r in upsert.appended(spark, path).collect()) == [0, 1, 2, 3]


def test_progress_ends_once(spark, tmp_path):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, STREAMING[store])
    try:
        check = f"file://{tmp_path}/check"
        schema = "contract_id long, ts timestamp, status string, progress int, step string"

        def feed(name, *events):
            (tmp_path / "in").mkdir(exist_ok=True)
            rows = [dict(zip(["contract_id", "ts", "status", "progress", "step"], (c, f"2024-01-01 {t}", s, p, "x"), strict=True)) for c, t, s, p in events]
            (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))
            stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
            told = []
            q = jobs.run(jobs.progress(stream, "1 minute", 600_000), lambda df, i: told.extend(tuple(r) for r in df.collect()), check, once_only=True)
            q.awaitTermination(180)
            return sorted(t[:3] + t[4:] for t in told)

        assert feed("1", (1, "10:00:00", "processing", 10), (1, "10:00:05", "processing", 20), (2, "10:00:00", "processing", 5)) == [(1, "processing", 20, False), (2, "processing", 5, False)]
        # An older event tells nothing new; the end is told once, before what comes after it.
        assert feed("2", (2, "09:59:59", "processing", 1), (1, "10:00:20", "completed", 100), (1, "10:00:25", "processing", 30)) == [(1, "done", 100, True)]
        assert feed("3", (1, "10:00:20", "completed", 100), (1, "10:00:40", "failed", 0), (2, "10:00:41", "failed", 5)) == [(2, "failed", 5, True)]
        # Long after, the timers have dropped both jobs, and a job that starts anew is followed again.
        feed("4", (3, "11:00:00", "processing", 1))
        feed("5", (3, "11:10:00", "processing", 2))
        assert feed("6", (1, "11:10:30", "processing", 3)) == [(1, "processing", 3, False)]
    finally:
        spark.conf.set(store, before)


@pytest.mark.parametrize("most", [1000, 4])
def test_sweeps_with_many_patterns(spark, most):
    statutes = spark.createDataFrame([(f"Act {k} of 19{k:02}" if k % 9 else None, k % 2 == 0, None) for k in range(40)], "act_name string, is_repealed boolean, repealed_by string")
    patterns = spark.createDataFrame([(f"act {k}\\b", f"new {k % 3}") for k in range(0, 30, 3)] + [("19[01]", "early"), (None, "x")], "pattern string, repealed_by string")
    got = {r["act_name"]: (r["is_repealed"], r["repealed_by"]) for r in jobs.repeal_sweep(statutes, patterns, most).collect() if r["act_name"]}
    for k in range(40):
        if k % 9:
            by = ([f"new {k % 3}"] if k % 3 == 0 and k < 30 else []) + (["early"] if k < 20 else [])
            assert got[f"Act {k} of 19{k:02}"] == (bool(by) or k % 2 == 0, min(by) if by else None)


def test_first_look_asks_tails_only_where_needed(spark):
    def provider(frame):
        return frame[["k"]].assign(a=frame["text"].str[:3], b=frame["text"].str.contains("LAW").map({True: "law", False: None}), n=frame["text"].str.len().astype(str))

    long = "head " + "x" * 100
    rows = [(1, long), (2, long + " LAW"), (3, "LAW" + long + " LAW"), (4, "short"), (5, ""), (6, None), (7, "   "), (8, " " * 60 + "tail LAW")]
    frame = spark.createDataFrame([(k, t, "z") for k, t in rows], "k long, body string, a string")
    got = {r["k"]: (tuple(r["metadata"]), r["steps"]) for r in enrich.preflight(frame, ["k"], "body", provider, ("a", "b", "n"), ("b",), 50, 20).collect()}
    assert got[1] == (("hea", None, "50"), 2) and got[2] == (("hea", "law", "50"), 2) and got[3] == (("LAW", "law", "50"), 1) and got[4] == (("sho", None, "5"), 1)
    assert got[5] == got[6] == got[7] == ((None, None, None), 0) and got[8] == ((None, "law", None), 2)
