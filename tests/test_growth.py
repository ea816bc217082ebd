"""Work that is to grow no faster than the tables: what plans send around, and results against plain versions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import blocks, citations, retrieval, scoring, upsert
from ledgerloom.operators.staged import Stages
from ledgerloom.plans import tables


def below(df, top: str) -> list[str]:
    """The parts of a plan that hang below nodes whose line contains top."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
    found = []
    for n, line in enumerate(lines):
        if top in line:
            end = next((m for m in range(n + 1, len(lines)) if depth(lines[m]) <= depth(line)), len(lines))
            found.append("\n".join(lines[n:end]))
    return found


def test_hints_send_no_exploded_names(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abB") for _ in range(n))
    names = [(k, word(rng.randrange(30, 60))) for k in range(40)]
    names += [(k + 40, n.upper()) for k, n in names[:10]]
    hints = []
    for k in range(60):
        name, size = rng.choice(names)[1], rng.choice([1, 2, 3, 15, 16, 17, 18, 25])
        at = rng.randrange(len(name) - size)
        hints.append((f"s{k}", "EXCEPTS", name[at : at + size] if k % 6 else word(size)))
    want = set()
    for src, rel, hint in hints:
        met = [i for i, n in names if hint.lower() in n.lower()]
        if met:
            want.add((src, min(met), rel))
    got = retrieval.edges_from_triples(spark.createDataFrame(hints, "src string, rel string, hint string"), spark.createDataFrame(names, "id long, name string"))
    assert {tuple(r) for r in got.collect()} == want
    small = spark.createDataFrame(hints, "src string, rel string, hint string").limit(50), spark.createDataFrame(names, "id long, name string").limit(50)
    assert not [p for p in below(retrieval.edges_from_triples(*small), "BroadcastExchange") if "Generate explode" in p]


def test_what_is_said_twice_is_looked_up_once(spark):
    statutes = spark.createDataFrame([("Wages Act", f"Section {k}", f"Wages are paid before day {k}.") for k in range(30)], "act_name string, section_number string, content string")
    said = [
        ("WAGES", "Wages Act", "Sec. 3", "Wages are paid before day"), ("WAGES", None, None, "something of day 7."), ("WAGES", None, "", "something else"),
        ("CASE_LAW", "A v. B", None, None), ("OTHER", None, None, None), ("WAGES", "Wages Act", "Section 99", "Wages"), ("RENT", None, None, "wages"),
    ]
    want = [("verified", "Section 3"), ("verified", "Section 0"), ("misquoted", "Section 0"), ("not_applicable", None), ("not_applicable", None), ("not_found", None), ("not_found", None)]
    refs = spark.createDataFrame([(n, *said[n % 7]) for n in range(70)], "ref_id long, act_key string, act_name string, section_hint string, reason string")
    terms = spark.createDataFrame([("WAGES", 1, "Payment"), ("WAGES", 2, "Wages")], "act_key string, term_ord int, term string")
    got = citations.verify(refs, statutes, terms)
    assert sorted((r["ref_id"], r["status"], r["section_found"]) for r in got.collect()) == [(n, *want[n % 7]) for n in range(70)]
    # No reference meets every statute: only terms and acts are compared by their letters.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString() and plan.count("Contains(lower(act_found") == 1


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("apart", [False, True])
def test_blocks_keep_keys_and_ids_apart(spark, monkeypatch, small, apart):
    if small:
        for name, n in (("BLOCK_ENTRIES", 40), ("PRODUCT", 12), ("MERGE", 3)):
            monkeypatch.setattr(blocks, name, n)
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], k % 4 if k % 9 else None) for k in range(90)]
    rows[3], rows[5] = (3, rows[4][1], 0), (5, None, 1)
    asked = [(k, v, [None, key, ((key or 0) + 1) % 4] if k % 7 else None) for k, v, key in rows[::3]]

    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    want = set()
    for i, v, keys in asked:
        met = sorted((-round(cosine(v, w), 9), j) for j, w, key in rows if w and v and key is not None and key in (keys or ()) and not (apart and i == j))
        want |= {(i, j, -s) for s, j in met[:5]}
    q = spark.createDataFrame(asked, "q long, qv array<double>, qk array<long>")
    c = spark.createDataFrame(rows, "c long, cv array<double>, ck long")
    got = retrieval._top(blocks.nearest(q, c, "q", "qv", "c", "cv", 5, ("qk", "ck"), apart), "q", "c", 5)
    assert {(r["q"], r["c"], round(r["score"], 9)) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["argmax_zone", "argmax_zone_all", "knn_filtered", "chat_retrieval"])
def test_vectors_meet_in_blocks(spark, name):
    """No pair of vectors is a row of a join, and what is ranked is no join of questions and clauses."""
    df = getattr(tables, name)(spark, "/root/testdata/sf0.001")
    assert not [p for p in below(df, "Window [") + below(df, "Aggregate(") if "Join" in p]


def test_suppression_settles_in_rounds(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abB") for _ in range(n))
    rows = [(rng.choice([1, 2, None]), n, word(rng.randrange(3, 30)) if n % 40 else None, n % 11 == 0) for n in range(300)]
    # A chain in which each repeats the one before only.
    rows += [(3, n, f"{n:020}{n - 1:020}", False) for n in range(1, 9)]
    want = set()
    for group in (1, 2, 3, None):
        kept = []
        for g, n, title, sure in sorted((r for r in rows if r[0] == group), key=lambda r: (not r[3], r[1])):
            low = (title or "").lower()
            if sure or not any(low[:20] in t or t[:20] in low for t in kept):
                kept.append(low)
                want.add((g, n))
    frame = spark.createDataFrame(rows, "c long, n int, title string, sure boolean")
    got = scoring.unsuppressed(frame, "c", ["n"], sure="sure")
    assert {(r["c"], r["n"]) for r in got.collect()} == want and got.count() == len(want)
    assert {n for c, n in want if c == 3} == {1, 3, 5, 7}
    # No group is folded as one row.
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stages_look_for_open_rows_once_a_run(spark, tmp_path, monkeypatch):
    """Each look joins all rows with all answers: one before the first run, and two in each run."""
    looks, open_rows = [], Stages.open_rows
    monkeypatch.setattr(Stages, "open_rows", lambda self, *a: looks.append(1) or open_rows(self, *a))
    rows = spark.createDataFrame([(k, f"t{k % 30}") for k in range(100)], "k long, body string")

    def once_odd(frame):
        if (frame["k"] == 50).any():
            raise ValueError("fifty")
        said = frame[(frame["k"] % 2 == 0) | (frame["_attempt"] > 1)]
        # Answers given twice, and of a row that another request asks for.
        return pd.concat([said, said, frame.assign(k=99)])[["k"]].assign(n=lambda x: x["k"] * 2)

    stages = Stages(spark, f"file://{tmp_path}/s", ["k"])
    assert stages.complete(rows, "a", "body", once_odd, "n long", batch=10) == 3 and len(looks) == 7
    tried = spark.read.parquet(f"file://{tmp_path}/s/a").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in tried} == {k: 3 if k == 50 else 1 if k % 2 == 0 or k == 99 else 2 for k in range(100)}
    assert {r["k"]: r["n"] for r in stages.answered("a").collect()} == {k: 2 * k for k in range(100) if k != 50}
    assert [r["_error"] for r in spark.read.parquet(f"file://{tmp_path}/s/a").filter("k = 50").collect()] == ["fifty"] * 3


def test_fan_out_writes_little_a_pair(spark, tmp_path):
    rng = random.Random(4)
    hooks = spark.createDataFrame([(rng.randrange(10), k, True, ["x"]) for k in range(3000)], "user_id long, hook long, active boolean, events array<string>")
    contracts = spark.createDataFrame([(k, rng.randrange(10)) for k in range(5000)], "contract long, user_id long")
    upsert.fan_out(contracts, hooks, "x").select("contract", "hook").write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert rows > 1_000_000 and size < 0.5 * rows


def test_fan_out_deals_an_owner_over_tasks(spark, monkeypatch):
    for name, n in {"CONTRACTS": 8, "HOOKS": 5, "DEALT": 50, "TASK_ROWS": 500}.items():
        monkeypatch.setattr(upsert, name, n)
    told = [(1, k % 90, None if k % 7 == 0 else {"k": str(k % 90)}) for k in range(120)] + [(2, 200, None), (None, 201, None), (3, 202, None), (4, None, {})]
    hooked = [(1, k % 60, k % 4 != 0, ["x", "y"] if k % 3 else ["y"]) for k in range(99)] + [(2, 70, True, ["x", None]), (2, 71, None, ["x"]), (None, 72, True, ["x"]), (5, 73, True, ["x"]), (4, 74, True, None), (4, None, True, ["x"])]
    contracts = spark.createDataFrame(told, "user_id long, contract long, more map<string,string>").coalesce(1)
    hooks = spark.createDataFrame(hooked, "user_id long, hook long, active boolean, events array<string>")
    got = upsert.fan_out(contracts, hooks, "x")
    assert got.columns == ["user_id", "contract", "more", "hook", "active", "events"]
    want = sorted(repr((*c, *h[1:])) for c in told for h in hooked if c[0] is not None and c[0] == h[0] and h[2] and "x" in (h[3] or []))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    sizes = [r["count"] for r in got.filter("user_id = 1").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < len(want) / 4
    assert upsert.fan_out(contracts, hooks, "z").count() == upsert.fan_out(contracts.limit(0), hooks, "x").count() == 0
