"""Facts, contradictions, folds and enrichment on literals."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import contradictions, enrich, facts, lexicon, retrieval, scoring, summaries, upsert


def facts_of(spark, *texts):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "contract_id long, segment_index int, raw_text string")
    return facts.extract_facts(rows).orderBy("segment_index", "ord").collect(), rows


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The total contract value is INR 50,00,000.", [("INR", 5000000.0)]),
        ("Fees of $120,000 are due.", [("USD", 120000.0)]),
        ("A budget of $1.5M applies.", [("USD", 1.5), ("USD", 1500000.0)]),
        ("In rupees: 10,00,000 now, later and after a long while 2,50,000.", [("INR", 1000000.0), ("INR", 250000.0)]),
        ("A count of 10,00,000 items.", []),
    ],
)
def test_currency(spark, text, want):
    got, _ = facts_of(spark, text)
    assert [(f["unit"], f["value"]) for f in got if f["type"] == "currency"] == want


def test_durations(spark):
    got, _ = facts_of(spark, "Pay within 30 days or seventy-two hours.", "Within twenty-four (24) hours.")
    assert [(f["segment_index"], f["value"], f["days"]) for f in got if f["type"] == "duration"] == [(0, 30.0, 30.0), (0, 72.0, 3.0)]


def test_places_need_a_context_and_ownership_a_subject(spark):
    got, _ = facts_of(spark, "The office is in Mumbai.", "Courts of Mumbai have jurisdiction.", "Deliverables are the property of the Client.", "Vendor retains its pre-existing tools.")
    assert [f["segment_index"] for f in got if f["type"] == "jurisdiction"] == [1]
    assert [(f["party"], f["subject"]) for f in got if f["type"] == "ownership"] == [("client", "deliverables"), ("vendor", "general")]


@pytest.mark.parametrize(
    ("texts", "rules"),
    [
        (["A single payment clause: pay USD 500."], []),
        (["The aggregate fee is USD 100.", "The vendor keeps underlying tools and all title in prior work."], []),
        (["Schedule A shall prevail for pricing.", "This agreement shall prevail for all other matters."], []),
        (["Refund all fees that are unearned.", "The client shall pay for services performed."], []),
        (["Financial records shall be retained for 3 years.", "Email logs shall be retained for 9 years."], []),
    ],
)
def test_no_contradiction(spark, texts, rules):
    _, rows = facts_of(spark, *texts)
    assert [r["rule"] for r in contradictions.detect(facts.extract_facts(rows), rows).collect()] == rules


def test_broad_fee_rule(spark):
    _, rows = facts_of(spark, "The contract amount is $900.", "Stage one brings $100.", "Stage two brings $200.")
    found = contradictions.detect(facts.extract_facts(rows), rows).collect()
    assert [(r["rule"], r["clause_refs"]) for r in found] == [("FEE_SUM_MISMATCH", [0, 1, 2])]


def test_alignment_table(spark):
    rows = [(lv, s) for lv in ("low", "medium", "high", "critical", "odd") for s in (0.0, 5.0, 6.0, 7.0, 8.0, 12.0, None)]
    frame = spark.createDataFrame(rows, "risk_level string, risk_score double").withColumns({"judge_level": F.lit(None).cast("string"), "judge_score": F.lit(None).cast("double"), "was": F.concat_ws("/", "risk_level", F.col("risk_score").cast("int").cast("string"))})
    got = {r["was"]: (r["risk_level"], r["risk_score"]) for r in scoring.align(scoring.base_scores(frame)).collect()}
    assert got["low/6"] == ("high", 6) and got["high/8"] == ("critical", 8) and got["critical/0"] == ("critical", 8) and got["high/0"] == ("high", 6)
    assert got["odd/5"] == ("medium", 5) and got["low/12"] == ("critical", 10) and got["medium"] == ("medium", 5)


def test_lexicon_groups_negation_and_patterns(spark):
    rules = lexicon.table(spark, [("x", "high", [["alpha", "beta"]], [["gamma"]]), ("y", "critical", [[lexicon.Pattern("d[0-9]+")]])])
    rows = spark.createDataFrame([(1, "ALPHA " + "." * 50), (2, "beta gamma " + "." * 50), (3, "d12 alpha " + "." * 50), (4, "alpha")], "id long, t string")
    assert sorted((r["id"], r["trap_type"]) for r in lexicon.match(rows, "t", rules).collect()) == [(1, "x"), (3, "x"), (3, "y")]
    assert lexicon.match(rows, "t", rules.limit(0)).collect() == []


def test_neighbours_and_filters(spark, monkeypatch):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q long, qv array<double>")
    c = spark.createDataFrame([(k, [1.0, 0.1 * k], k % 2 == 0) for k in range(8)] + [(50, [1.0], True), (51, [0.0, 0.0], True)], "c long, cv array<double>, ok boolean")
    want = retrieval.knn(q, c, "q", "qv", "c", "cv", k=3).orderBy("rank").collect()
    assert [r["c"] for r in want] == [0, 1, 2]
    near = retrieval.knn_filtered(q, c, "q", "qv", "c", "cv", F.lit(True), F.col("ok"), fetch=5, k=2, min_score=0.9).orderBy("rank").collect()
    assert [(r["c"], r["confidence"]) for r in near] == [(0, "High"), (2, "High")]
    monkeypatch.setattr(retrieval, "MAX_BROADCAST", 0)
    assert [r["c"] for r in retrieval.knn(q, c, "q", "qv", "c", "cv", k=3).orderBy("rank").collect()] == [0, 1, 2]


def test_graph(spark):
    triples = spark.createDataFrame([("a", "EXCEPTS", "wages"), ("b", "EXCEPTS", "wages"), ("b", "EXCEPTS", "none")], "src string, rel string, hint string")
    vertices = spark.createDataFrame([("w1", "Payment of Wages"), ("w2", "Minimum Wages")], "id string, name string")
    assert sorted(tuple(r) for r in retrieval.edges_from_triples(triples, vertices).collect()) == [("a", "w1", "EXCEPTS"), ("b", "w1", "EXCEPTS")]


def test_halving():
    batch = pd.DataFrame({"t": ["x" * 40] * 4})
    assert [len(b) for b in enrich.halves(batch, "t", 20)] == [2, 2] and [len(b) for b in enrich.halves(batch, "t", 1)] == [1] * 4


def test_word_diff_rebuilds_both_sides(spark):
    rows = enrich.word_diff(spark.createDataFrame([(1, "a b c d", "a x c d e"), (2, None, "n")], "id long, a string, b string"), "id", "a", "b").orderBy("id", "ord").collect()
    one = [r for r in rows if r["id"] == 1]
    assert " ".join(r["words"] for r in one if r["op"] != "added") == "a b c d" and " ".join(r["words"] for r in one if r["op"] != "removed") == "a x c d e"


def test_page_arguments(spark):
    df = spark.range(45)
    assert summaries.page(df, ["id"], "x", None).count() == 20 and summaries.page(df, ["id"], 3, "20").count() == 5
    assert summaries.page(df, ["id"], -4, 1000).first()["pages"] == 1


def test_upsert_null_keys_and_fan_out(spark):
    now = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(None, "m"), (2, "b")], "k long, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in upsert.upsert(now, new, ["k"], "v").collect()) == [(0, "m"), (1, "a"), (2, "b")]
    hooks = spark.createDataFrame([(1, True, ["x"]), (1, False, ["x"]), (1, True, ["y"])], "user_id long, active boolean, events array<string>")
    assert upsert.fan_out(spark.createDataFrame([(9, 1)], "contract_id long, user_id long"), hooks, "x").count() == 1
    assert upsert.delete_where(now, F.col("k") == 1).count() == 1


def test_embedding_fills_gaps_with_unit_vectors(spark):
    rows = spark.createDataFrame([(1, "a  b", [1.0, 0.0]), (2, "c  d", None)], "id long, t string, embedding array<double>")
    made = enrich.embed(rows, ["id"], "t", lambda f: f.assign(embedding=[[3.0, 4.0] if t == "c d" else [0.0, 0.0] for t in f["t"]])[["id", "embedding"]])
    assert {r["id"]: r["embedding"] for r in made.collect()} == {1: [1.0, 0.0], 2: [0.6, 0.8]}
