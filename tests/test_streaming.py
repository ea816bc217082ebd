"""Readers and continuous jobs."""

import json

from pyspark.sql import functions as F

from ledgerloom.sources import readers
from ledgerloom.streaming import jobs


def drain(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_job_states(spark, tmp_path):
    inbox = tmp_path / "in"
    at = lambda m: f"2024-01-01T00:{m:02d}:00"
    write(inbox, "1.json", [{"contract_id": 1, "event": "claim", "ts": at(1)}, {"contract_id": 1, "event": "claim", "ts": at(2)}, {"contract_id": 2, "event": "claim", "ts": at(1)}])
    write(inbox, "2.json", [{"contract_id": 1, "event": "done", "ts": at(3)}, {"contract_id": 2, "event": "failed", "ts": at(3)}, {"contract_id": 2, "event": "enqueue", "ts": at(4)}])
    events = jobs.arrivals(spark, str(inbox), "contract_id long, event string, ts timestamp", per_trigger=10)
    last = drain(jobs.job_states(events), tmp_path, "states", "update")
    assert {r["contract_id"]: (r["status"], r["attempts"]) for r in last.collect()} == {1: ("done", 1), 2: ("queued", 0)}


def test_rate_limit_and_repeats_over_a_stream(spark, tmp_path):
    inbox = tmp_path / "req"
    write(inbox, "1.json", [{"ip": "a", "id": k % 3, "ts": f"2024-01-01T00:0{k}:00"} for k in range(5)] + [{"ip": "b", "id": 9, "ts": "2024-01-01T02:00:00"}])
    stream = jobs.arrivals(spark, str(inbox), "ip string, id long, ts timestamp")
    assert [r["ip"] for r in drain(jobs.rate_limited(stream, "ip", limit=4, late="10 minutes"), tmp_path, "limits").collect()] == ["a"]
    assert drain(jobs.once(stream, ["id"], "ts"), tmp_path, "once").count() == 4


def test_sink_runs_once_a_batch(spark, tmp_path):
    inbox, seen = tmp_path / "s", []
    write(inbox, "1.json", [{"id": 1}])
    jobs.run(jobs.arrivals(spark, str(inbox), "id long"), lambda df, n: seen.append((n, df.count())), f"{tmp_path}/ck", once_only=True).awaitTermination(60)
    assert seen == [(0, 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text('caseName,citation,year\n"A, v. B",1 X 1,2001\n,2 X 2,2002\nC v. D,1 X 1,2003\nE v. F,3 X 3,2004\n')
    known = spark.createDataFrame([("3 X 3",)], "citation string")
    assert [(r["case_title"], r["citation"]) for r in readers.case_law_csv(spark, f"{tmp_path}/c.csv", known).collect()] == [("A, v. B", "1 X 1")]
    (tmp_path / "s.json").write_text(json.dumps([{"Section": "3", "section_title": "Title", "section_desc": "Described at length"}, {"Section": "4", "section_title": "", "section_desc": "short"}]))
    assert [tuple(r) for r in readers.statutes_json(spark, f"{tmp_path}/s.json", "Act").collect()] == [("Act", "Section 3", "Title: Described at length")]
    for name, size in (("a.PDF", 10), ("b.docx", 10), ("c.exe", 10), ("d.pdf", 50)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = readers.uploads(spark, str(tmp_path), largest=20)
    assert sorted(r["kind"] for r in files.select("kind").collect()) == ["docx", "pdf"]
    users = spark.createDataFrame([(1, 0, 2), (2, 2, 2)], "user_id long, used int, quota int")
    assert readers.within_quota(spark.createDataFrame([(1,), (2,)], "user_id long"), users).count() == 1
    texts = spark.createDataFrame([("x" * 120, "y"), ("x", "y" * 200), ("x", ""), (" ", None)], "a string, b string")
    assert [(r["text"] or "")[:1] for r in readers.best_text(texts, ["a", "b"]).collect()] == ["x", "y", "x", ""]
    acts = spark.createDataFrame([(1, "rent act", "1"), (2, "Rent  Act", "1"), (3, "Other", "1")], "id long, act_name string, section_number string")
    names = spark.createDataFrame([("rent act", "Rent Control Act")], "raw string, canonical string")
    assert sorted((r["id"], r["act_name"]) for r in readers.canonical_acts(acts, names).collect()) == [(1, "Rent Control Act"), (3, "Other")]
    now = F.lit("2024-01-01").cast("timestamp")
    assert jobs.reset_quotas(users.withColumn("reset_at", now), now).agg(F.sum("used")).first()[0] == 0
