"""Verdicts, answers, suppression, hints and block cosines against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import answers, blocks, retrieval, scoring
from ledgerloom.sources import admission

PDF = admission.KINDS["pdf"]


def test_quotas_are_not_overdrawn(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        user = rng.choice([1, 1, 1, 2, 3, 9, None])
        at = None if k % 97 == 0 else f"2024-01-0{rng.randrange(1, 4)} 0{rng.randrange(9)}:00:00"
        rows.append((k, user, at, rng.choice(["a.pdf", "a.PDF", "b.docx", "c.txt", None, "pdf"]) if k % 3 == 0 else "x.pdf", rng.choice([PDF, PDF, PDF, "text/plain", None]), rng.choice([5, 5, 5, 20_000_000, None]), rng.choice(["saas", "saas", "nothing", None])))
    frame = spark.createDataFrame(rows, "upload_id long, user_id long, uploaded_at string, name string, mime string, length long, category string").withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp")).withColumn("used", F.lit("x"))
    users = spark.createDataFrame([(1, 0, 40), (2, 3, 6), (3, 5, 5)], "user_id long, used int, quota int")
    want, used = {}, {1: 0, 2: 3, 3: 5}
    for k, user, at, name, mime, length, category in sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0])):
        ext = name is not None and "." in name and name.rsplit(".", 1)[1].lower() in ("pdf", "docx")
        if name is None or length is None:
            want[k] = "no_file"
        elif not ext or mime not in admission.KINDS.values():
            want[k] = "kind"
        elif length > admission.MAX_UPLOAD:
            want[k] = "too_large"
        elif user not in used:
            want[k] = "user"
        elif used[user] >= {1: 40, 2: 6, 3: 5}[user]:
            want[k] = "quota"
        elif category != "saas":
            want[k] = "category"
        else:
            want[k] = "admitted"
            used[user] += 1
    out = admission.admit(frame, users)
    got = {r["upload_id"]: r for r in out.collect()}
    assert {k: r["verdict"] for k, r in got.items()} == want and set(want.values()) == set(admission.STATUS)
    assert all(r["status"] == admission.STATUS[r["verdict"]] and r["used"] == "x" for r in got.values())
    assert {r["user_id"]: r["used"] for r in admission.charge(users, out).collect()} == used
    assert admission.admit(frame.limit(0), users).collect() == []


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('[{"amount": "12.5", "currency": "USD", "description": "d"}, {"amount": 3}]', [(12.5, "USD", "d"), (3.0, "INR", "Financial Obligation")]),
        ('{"results": [{"amount": "1,000"}]}', [(0.0, "INR", "Financial Obligation")]),
        ('{"obligations": [{"amount": null, "currency": ""}]}', [(0.0, "INR", "Financial Obligation")]),
        ('{"financial_obligations": [{"amount": [1], "currency": {"a": 1}}]}', [(0.0, "INR", "Financial Obligation")]),
        ('Well:\n```json\n{"results": [{"amount": 7, "currency": "EUR"}]}\n```', [(7.0, "EUR", "Financial Obligation")]),
        ('{"results": "none", "obligations": [{"amount": 1e2}]}', [(100.0, "INR", "Financial Obligation")]),
        ('{"other": [{"amount": 1}]}', []), ("no JSON", []), ("", []), (None, []), ("[]", []), ("5", []),
    ],
)
def test_obligations(spark, raw, want):
    rows = spark.createDataFrame([(1, raw)], "k long, raw string")
    got = answers.obligations(rows, ["k"], "raw").orderBy("ord").collect()
    assert [(r["amount"], r["currency"], r["description"]) for r in got] == want


def test_events_need_a_type_and_a_date(spark):
    said = '[{"event_type": "expiry", "date": "2026-03-05"}, {"event_type": "x", "date": "2026-02-30"}, {"event_type": "", "date": "2026-01-01"}, {"date": "2026-01-01"}, {"event_type": "renewal", "date": "March 7, 2026", "description": "d"}, 5]'
    got = answers.events(spark.createDataFrame([(1, said)], "k long, raw string"), ["k"], "raw").orderBy("ord").collect()
    assert [(r["event_type"], str(r["date"]), r["description"]) for r in got] == [("expiry", "2026-03-05", "Contract expiry event"), ("renewal", "2026-03-07", "d")]


def test_suppression_is_in_order(spark):
    rows = [(1, 0, "Alpha beta gamma delta epsilon", True), (1, 1, "alpha beta gamma delta other", False), (1, 2, "Zeta", False), (1, 3, "More of zeta here", False), (1, 4, "Here", False), (1, 5, None, False), (2, 0, None, False), (2, 1, "Anything", False), (None, 3, "q", False)]
    frame = spark.createDataFrame(rows, "c long, n int, title string, sure boolean")
    # The fourth of contract 1 repeats the third and is dropped, so what repeats only it stays.
    assert sorted(((r["c"], r["n"]) for r in scoring.unsuppressed(frame, "c", ["n"], sure="sure").collect()), key=repr) == [(1, 0), (1, 2), (1, 4), (2, 0), (None, 3)]


def test_stated_numbers_and_relations(spark):
    rows = [("INR 5k", 5000.0), ("2.5 million", 2_500_000.0), ("12,000", 12000.0), ("none", 0.0), ("1-2", 0.0), ("-3", -3.0), (None, 0.0)]
    frame = spark.createDataFrame(rows, "raw string, want double")
    assert all(r["got"] == r["want"] for r in frame.select("want", scoring.clean_number(F.col("raw")).alias("got")).collect())
    kinds = spark.createDataFrame([("Sum check", "sum_equals"), ("multiplier", "product_equals"), ("timeline", "at_most"), ("greater than", "above"), ("odd", "odd")], "raw string, want string")
    assert all(r["got"] == r["want"] for r in kinds.select("want", scoring.relation_of(F.col("raw")).alias("got")).collect())


def test_hints_of_any_length(spark):
    rng = random.Random(4)
    names = [(k, None if k == 7 else "".join(rng.choice("abcA ") for _ in range(rng.randrange(12)))) for k in range(60)]
    hints = [(f"s{k}", rng.choice(["EXCEPTS", "DEFINED_BY"]), None if k == 3 else "".join(rng.choice("abC ") for _ in range(rng.randrange(6)))) for k in range(80)]
    want = set()
    for src, rel, hint in hints:
        met = [i for i, n in names if n is not None and hint and hint.lower() in n.lower()]
        if met:
            want.add((src, min(met), rel))
    got = retrieval.edges_from_triples(spark.createDataFrame(hints, "src string, rel string, hint string"), spark.createDataFrame(names, "id long, name string"))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("entries", [blocks.BLOCK_ENTRIES, 60])
def test_blocks_against_all_pairs(spark, monkeypatch, entries):
    monkeypatch.setattr(blocks, "BLOCK_ENTRIES", entries)
    rng = random.Random(1)
    vector = lambda d: [rng.gauss(0, 1) for _ in range(d)]
    left = [(k, vector(4)) for k in range(30)] + [(30, None), (31, []), (32, [0.0] * 4), (33, vector(3)), (34, [float("nan")] * 4)]
    right = [(f"t{k:02}", vector(4)) for k in range(40)] + [("x", None), ("y", [0.0] * 4), ("z", vector(3))]
    right[5], right[9] = ("t05", left[2][1]), ("t09", left[2][1])

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size > 0 else 0.0

    pairs = {i: sorted((-round(cosine(v, w), 9), j) for j, w in right if w is not None and len(v) == len(w)) for i, v in left if v and v[0] == v[0]}
    a = spark.createDataFrame(left, "a long, av array<double>").repartition(3)
    b = spark.createDataFrame(right, "b string, bv array<double>").repartition(3)
    best = {r["a"]: (r["b"], round(r["score"], 9)) for r in blocks.best(a, b, "a", "av", "b", "bv").collect()}
    assert best == {i: (p[0][1], -p[0][0]) for i, p in pairs.items() if p}
    near = {}
    for r in retrieval.knn(a, b, "a", "av", "b", "bv", k=3, fetch=3).collect():
        near.setdefault(r["a"], []).append((r["rank"], r["b"], round(r["score"], 9)))
    assert {i: sorted(v) for i, v in near.items()} == {i: [(n, j, -s) for n, (s, j) in enumerate(p[:3], 1)] for i, p in pairs.items() if p}
    assert blocks.best(a, b.limit(0), "a", "av", "b", "bv").collect() == []


def test_vector_traps_leave_the_rest_alone(spark):
    text = "t" * 60
    rows = [(1, "low", 2, text, [1.0, 0.0]), (2, "critical", 9, text, [1.0, 0.0]), (3, None, None, text, [0.8, 0.6]), (4, "low", 1, "short", [1.0, 0.0]), (5, "low", 1, text, None), (6, "medium", 4, text, [0.0, -1.0]), (7, "high", 10, text, [0.6, 0.8])]
    clauses = spark.createDataFrame([(*r, ["old"]) for r in rows], "k long, risk_level string, risk_score int, raw_text string, embedding array<double>, risk_reasons array<string>")
    traps = spark.createDataFrame([(1, "grab", "critical", [1.0, 0.0]), (2, "lure", "high", [0.0, 1.0])], "trap_id long, trap_type string, severity string, vec array<double>")
    said = spark.createDataFrame([(3, "model's", "critical", "because"), (1, "no", "high", "not asked")], "k long, trap_type string, severity string, reasoning string")
    got = {r["k"]: (r["risk_level"], r["risk_score"], r["ask_model"], len(r["risk_reasons"])) for r in scoring.vector_traps(clauses, traps, "k", answers=said).collect()}
    assert got == {1: ("critical", 9, False, 2), 2: ("critical", 9, False, 1), 3: ("critical", 9, False, 2), 4: ("low", 1, False, 1), 5: ("low", 1, False, 1), 6: ("medium", 4, False, 1), 7: ("high", 10, True, 1)}
    without = {r["k"]: r["ask_model"] for r in scoring.vector_traps(clauses, traps, "k").collect()}
    assert without[3] and without[7] and not without[1]


@pytest.mark.parametrize("rows_a_block", [512, 7])
def test_siblings_of_groups_of_any_size(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(blocks, "GROUP_ROWS", rows_a_block)
    rng = random.Random(8)
    rows = [(k, rng.choice("aab") if k % 11 else None, [rng.gauss(0, 1) for _ in range(3)] if k % 13 else None) for k in range(70)]
    rows[5], rows[6] = (5, "a", rows[1][2]), (6, "a", rows[1][2])
    frame = spark.createDataFrame(rows, "id long, g string, v array<double>").repartition(3)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    want = set()
    for i, g, v in rows:
        if g and v:
            near = sorted((-round(cosine(v, w), 9), j) for j, h, w in rows if h == g and w)[:4]
            want |= {(i, j, -s) for s, j in near if j != i}
    assert {(r["query_id"], r["sibling_id"], round(r["score"], 9)) for r in retrieval.siblings(frame, "g", "id", "v", 4).collect()} == want
    assert retrieval.siblings(frame.limit(0), "g", "id", "v").collect() == []
