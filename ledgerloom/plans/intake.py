"""Queries over what comes in: verdicts on uploads, answers of models, vector traps, suppressed findings, hints as edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import answers, contradictions, enrich, facts, retrieval, scoring, summaries, upsert
from ledgerloom.operators.staged import Stages
from ledgerloom.plans.registry import pick, query, values
from ledgerloom.session import shared_path, table
from ledgerloom.sources import acts, admission, readers


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
c AS (SELECT vec_id, e, CASE vec_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN NULL ELSE 'medium' END AS risk_level, CAST(vec_id % 11 AS INT) AS risk_score, vec_id % 60 + 20 AS n FROM v WHERE vec_id % 50 <> 0),
t AS (SELECT vec_id AS trap_id, e AS te, CASE WHEN label % 2 = 0 THEN 'critical' ELSE 'high' END AS severity FROM v WHERE vec_id % 50 = 0),
s AS (SELECT vec_id, max(list_cosine_similarity(e, te)) AS score, arg_max(severity, (list_cosine_similarity(e, te), -trap_id)) AS severity FROM c, t WHERE n >= 50 AND coalesce(risk_level <> 'critical', true) GROUP BY 1),
h AS (SELECT vec_id, CASE WHEN score >= 0.4 THEN severity WHEN score >= 0.25 AND vec_id % 3 = 0 THEN 'high' END AS up, score BETWEEN 0.25 AND 0.4 AND score < 0.4 AND vec_id % 3 <> 0 AS ask FROM s)
SELECT vec_id, CASE WHEN up = 'critical' THEN 'critical' WHEN up = 'high' THEN 'high' ELSE risk_level END AS risk_level, CASE WHEN up = 'critical' THEN 9 WHEN up = 'high' THEN 8 ELSE risk_score END AS risk_score,
coalesce(ask, false) AS ask_model, CASE WHEN up IS NULL THEN 0 ELSE 1 END AS reasons FROM c LEFT JOIN h USING (vec_id)""")
def vector_traps(spark, sf):
    """Every vector as a clause, every fiftieth as a trap; a model's answers to every third that is asked about."""
    e = table(spark, sf, "embeddings")
    level = F.when(F.col("vec_id") % 4 == 0, "critical").when(F.col("vec_id") % 4 == 1, "low").when(F.col("vec_id") % 4 == 3, "medium")
    rows = e.filter("vec_id % 50 <> 0").select("vec_id", "embedding", level.alias("risk_level"), (F.col("vec_id") % 11).cast("int").alias("risk_score"), F.repeat(F.lit("x"), (F.col("vec_id") % 60 + 20).cast("int")).alias("raw_text"), F.array().cast("array<string>").alias("risk_reasons"))
    traps = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("trap_id"), F.concat(F.lit("trap "), F.col("label").cast("string")).alias("trap_type"), F.when(F.col("label") % 2 == 0, "critical").otherwise("high").alias("severity"), F.col("embedding").alias("vec"))
    said = e.filter("vec_id % 3 = 0").select("vec_id", F.lit("said").alias("trap_type"), F.lit("high").alias("severity"), F.lit("a model said so").alias("reasoning"))
    found = scoring.vector_traps(rows, traps, "vec_id", hi=0.4, lo=0.25, answers=said)
    return found.select("vec_id", "risk_level", "risk_score", "ask_model", F.size("risk_reasons").alias("reasons"))


@query("""WITH u AS (SELECT o_orderkey AS id, o_custkey AS u, o_orderdate AS ts, o_orderstatus <> 'P' AS kind, o_totalprice * 40 <= 10485760 AS small, o_orderpriority[1] <> '4' AS fits FROM orders),
c AS (SELECT *, coalesce(sum(CAST(kind AND small AND fits AS INT)) OVER (PARTITION BY u ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT id AS upload_id, CASE WHEN NOT kind THEN 400 WHEN NOT small THEN 413 WHEN k.c_custkey IS NULL THEN 401 WHEN c_custkey % 4 + before >= 6 THEN 429 WHEN NOT fits THEN 400 ELSE 201 END AS status
FROM c LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 3) k ON u = c_custkey""")
def admitted_uploads(spark, sf):
    """Every order as an upload of its customer."""
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "application/zip").otherwise(admission.KINDS["pdf"])
    rows = o.select(
        F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("uploaded_at"), F.lit("Scan.PDF").alias("name"), kind.alias("mime"),
        (F.col("o_totalprice") * 40).alias("length"), F.when(F.substring("o_orderpriority", 1, 1) == "4", "unheard").otherwise("saas").alias("category"),
    )
    users = table(spark, sf, "customer").filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 4).alias("used"), F.lit(6).alias("quota"))
    return admission.admit(rows, users, F.date_trunc("year", F.col("uploaded_at"))).select("upload_id", "status")


def _answered(rows, key, inner, names):
    """Answers of one row a key out of its entries (column e, an array of structs), in six shapes by the key."""
    body = F.to_json(inner)
    shape = F.col(key) % 6
    wrapped = lambda name: F.concat(F.lit('{"' + name + '": '), body, F.lit("}"))
    raw = (
        F.when(shape == 0, body)
        .when(shape == 1, wrapped(names[0]))
        .when(shape == 2, F.concat(F.lit("Here you are:\n```json\n"), wrapped(names[1]), F.lit("\n```")))
        .when(shape == 3, F.concat(F.lit("Surely. "), wrapped(names[2]), F.lit(" Anything else?")))
        .when(shape == 4, wrapped("unheard"))
        .otherwise(F.left(body, F.length(body) - 2))
    )
    return rows.select(key, raw.alias("raw"))


@query("""SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'INR' ELSE l_returnflag END AS currency, count(*) AS n, round(sum(CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity / 2 ELSE 0 END), 2) AS total
FROM lineitem WHERE l_orderkey % 6 < 4 GROUP BY 1, 2""")
def financial_obligations(spark, sf):
    """Sums by currency of the obligations in an answer for each order: amounts as numbers, as text, missing or no number."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    amount = F.when(F.col("l_linenumber") % 4 == 1, F.col("l_quantity").cast("string")).when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit(" "), (F.col("l_quantity") / 2).cast("string"))).when(F.col("l_linenumber") % 4 == 3, "12,5 or so")
    entry = F.struct(amount.alias("amount"), F.when(F.col("l_returnflag") == "N", "N").when(F.col("l_returnflag") == "R", "R").when(F.col("l_linenumber") % 2 == 0, "").alias("currency"))
    rows = l.groupBy("l_orderkey").agg(F.collect_list(entry).alias("e"))
    raw = _answered(rows, "l_orderkey", F.col("e"), answers.OBLIGATION_NAMES)
    return answers.exposure(answers.obligations(raw, ["l_orderkey"], "raw"), ["l_orderkey"]).withColumn("total", F.round("total", 2))


@query("""SELECT o_orderkey, 'expiry' AS event_type, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 'Contract expiry event' ELSE o_orderstatus END AS description
FROM orders WHERE o_orderkey % 6 < 4 AND o_orderkey % 7 < 4""")
def lifecycle_dates(spark, sf):
    """Events in an answer for each order, their dates in four formats, as a day that does not exist, as text, or missing."""
    kind = F.col("o_orderkey") % 7
    said = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).when(kind == 2, F.date_format("o_orderdate", "MMMM d, yyyy"))
        .when(kind == 3, F.date_format("o_orderdate", "d MMM yyyy")).when(kind == 4, "2025-02-30").when(kind == 5, "upon renewal")
    )
    entry = F.struct(said.alias("date"), F.lit("expiry").alias("event_type"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("description"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.array(entry, F.struct(said.alias("date"), F.lit(None).cast("string").alias("event_type"), F.lit("x").alias("description"))).alias("e"))
    return answers.events(_answered(rows, "o_orderkey", F.col("e"), answers.EVENT_NAMES), ["o_orderkey"], "raw").select("o_orderkey", "event_type", "date", "description")


def _first_look(frame):
    """Words of the text itself, in place of a model."""
    low = frame["text"].str.lower()
    law = low.str.contains("licen", regex=False).map(lambda x: "licence law" if x else None)
    return frame[["doc_id"]].assign(documentType=low.str.contains("@", regex=False).map(lambda x: "letter" if x else ""), governingLaw=law)


@query("""WITH p AS (SELECT doc_id, text, trim(left(text, 20000), ' ') AS h, length(text) > 20000 AS long, trim(right(text, 5000), ' ') AS t FROM documents),
f AS (SELECT *, contains(h, '@') AS mail, contains(lower(h), 'licen') AS law FROM p)
SELECT doc_id, CASE WHEN mail THEN 'letter' END AS document_type, CASE WHEN law OR (long AND contains(lower(t), 'licen')) THEN 'licence law' END AS governing_law,
CASE WHEN coalesce(h, '') = '' THEN 0 WHEN long AND NOT law THEN 2 ELSE 1 END AS steps FROM f""")
def first_look(spark, sf):
    """Whole documents' heads, and the tails of the long ones that lack a governing law."""
    found = enrich.preflight(table(spark, sf, "documents"), ["doc_id"], "text", _first_look)
    return found.select("doc_id", F.col("metadata.documentType").alias("document_type"), F.col("metadata.governingLaw").alias("governing_law"), "steps")


_ALIKE = "contains({a}, left({b}, 20)) OR contains({b}, left({a}, 20))"


@query(f"""WITH t AS (SELECT c_nationkey, c_custkey, c_acctbal < 500 AS sure, lower(left(c_name, 18 - CAST(c_custkey % 5 AS INT) * 3) || c_mktsegment) AS t FROM customer),
o AS (SELECT c_nationkey, list([struct_pack(id := c_custkey, sure := sure, t := t)] ORDER BY sure DESC, c_custkey) AS every FROM t GROUP BY 1),
k AS (SELECT c_nationkey, unnest(list_reduce(every, lambda acc, x: CASE WHEN NOT x[1].sure AND len(list_filter(acc, lambda y: {_ALIKE.format(a="y.t", b="x[1].t")})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS f FROM o)
SELECT c_nationkey, f.id AS c_custkey FROM k""")
def unsuppressed_findings(spark, sf):
    """Customers as findings of their nation, in order, those with little money as sure ones."""
    title = F.concat(F.substring(F.col("c_name"), F.lit(1), (18 - F.col("c_custkey") % 5 * 3).cast("int")), F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") < 500).alias("sure"), title.alias("title"))
    return scoring.unsuppressed(rows, "c_nationkey", ["c_custkey"], sure="sure").select("c_nationkey", "c_custkey")


@query("""WITH t AS (SELECT p_partkey AS src, CASE WHEN p_size % 2 = 0 THEN 'EXCEPTS' ELSE 'DEFINED_BY' END AS rel, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name[3:8] WHEN 2 THEN right(CAST(p_partkey AS VARCHAR), 2) WHEN 3 THEN 'no such ' || p_name ELSE left(p_name, 1) END AS hint FROM part),
v AS (SELECT p_partkey AS id, p_name || ' of ' || p_brand AS name FROM part WHERE p_partkey % 3 = 0)
SELECT DISTINCT src, min(id) AS dst, rel FROM t JOIN v ON contains(lower(name), lower(hint)) GROUP BY src, rel, hint""")
def hinted_edges(spark, sf):
    """Parts' names, in part, as hints at every third part."""
    p = table(spark, sf, "part")
    kind = F.col("p_partkey") % 5
    hint = F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.substring("p_name", 3, 6)).when(kind == 2, F.right(F.col("p_partkey").cast("string"), F.lit(2))).when(kind == 3, F.concat(F.lit("no such "), F.col("p_name"))).otherwise(F.left("p_name", F.lit(1)))
    triples = p.select(F.col("p_partkey").alias("src"), F.when(F.col("p_size") % 2 == 0, "EXCEPTS").otherwise("DEFINED_BY").alias("rel"), hint.alias("hint"))
    vertices = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" of "), "p_brand").alias("name"))
    return retrieval.edges_from_triples(triples, vertices)


def _wavering(frame):
    """Levels by length; no answer to every third text at first, and to every seventh at all."""
    said = frame[((frame["doc_id"] % 3 != 0) | (frame["_attempt"] > 1)) & (frame["doc_id"] % 7 != 0)]
    return said[["doc_id"]].assign(level=(said["text"].str.len() % 2).map({0: "even", 1: "odd"}), attempt=said["_attempt"])


def _reflected(frame):
    return frame[["doc_id"]].assign(again=frame["text"].str.len().astype("int64"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'standard' WHEN length(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS level, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS attempt,
CASE WHEN doc_id % 7 <> 0 AND length(text) % 2 = 1 AND n_chars > 300 THEN length(text) END AS again FROM documents""")
def staged_answers(spark, sf):
    """Two stages over all documents: levels, asked anew where an answer is lacking, then a second look at some of those that have one."""
    docs = table(spark, sf, "documents")
    stages = Stages(spark, shared_path(spark, "stages"), ["doc_id"])
    stages.complete(docs, "level", "text", _wavering, "level string, attempt int")
    judged = stages.result(docs, "level", {"level": "standard"})
    stages.complete(judged, "again", "text", _reflected, "again long", (F.col("level") == "odd") & (F.col("n_chars") > 300))
    return stages.result(judged, "again").select("doc_id", "level", "attempt", "again")


@query("""SELECT CAST(CASE WHEN grouping(p_brand) = 1 THEN 1 ELSE 0 END AS INT) AS level, p_brand, count(*) AS n, CASE WHEN grouping(p_brand) = 0 THEN arg_min(p_type, p_partkey) END AS domain FROM part GROUP BY ROLLUP (p_brand)""")
def counts_with_total(spark, sf):
    return summaries.counts_with_total(table(spark, sf, "part"), "p_brand", "p_type", "p_partkey").select("level", "p_brand", "n", "domain")


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1) AS type_right, count(*) FILTER ((toxic = 1) = (quality = 0)) AS risk_right, count(*) FILTER (quality = 1 AND toxic = 1) AS false_positives, count(*) FILTER (quality = 0 AND toxic = 0) AS false_negatives,
round(avg(CASE WHEN doc_id % 4 > 0 THEN doc_id % 11 END), 2) AS mean_rewrite_score FROM labels""")
def rewrite_quality(spark, sf):
    level = lambda c, v: F.when(F.col(c) == v, "HIGH").otherwise("LOW")
    rows = table(spark, sf, "labels").select(F.lit("good").alias("expected_type"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("actual_type"), level("quality", 0).alias("expected_risk"), level("toxic", 1).alias("actual_risk"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 11).alias("rewrite_score"))
    return summaries.confusion(rows, "rewrite_score")


@query("""WITH f AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS t, repeat('issue ', 10) || o_orderpriority AS i FROM orders), n AS (SELECT c, count(*) AS n FROM f GROUP BY 1)
SELECT c AS contract_id, k AS finding_no FROM f JOIN n USING (c) QUALIFY n <= 15 OR row_number() OVER (PARTITION BY c, t, left(i, 60) ORDER BY k) = 1""")
def deduped_findings(spark, sf):
    """Orders as findings of their customers, who have as many clauses as orders."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("contract_id"), F.col("o_orderkey").alias("finding_no"), F.col("o_orderstatus").alias("type"), F.concat(F.repeat(F.lit("issue "), F.lit(10)), "o_orderpriority").alias("issue_text"))
    return summaries.dedup_findings(rows, rows).select("contract_id", "finding_no")


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 50)")
def sample_rows(spark, sf):
    return summaries.sample(table(spark, sf, "orders"), 50).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey AS contract_id, l_linenumber AS segment_index, unnest(['section', 'schedule']) AS ref_type, unnest([CAST(l_suppkey AS VARCHAR) || '.' || l_linenumber, l_returnflag]) AS ref_target FROM lineitem""")
def cross_references(spark, sf):
    """References between clauses out of the lines of all orders."""
    text = F.format_string("Subject to Section %s.%s, the goods of Schedule %s are sold as seen.", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_returnflag"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("segment_index"), F.explode(F.array(facts.cross_refs(text))).alias("_f"))
    return rows.select("contract_id", "segment_index", F.explode("_f").alias("f")).select("contract_id", "segment_index", "f.ref_type", "f.ref_target")


@query("""SELECT s_suppkey AS contract_id, 'FEE_SUM_MISMATCH' AS rule FROM supplier WHERE s_suppkey % 3 <> 0""")
def broad_fees(spark, sf):
    """Suppliers' contracts whose sentences name no total and no instalment, but whose clauses suggest them."""
    s, n = F.col("s_suppkey"), F.floor(F.abs("s_acctbal")) + 2000
    say = lambda pattern, v: F.format_string(pattern, F.format_number(v, 0))
    texts = F.array(say("The contract amount is $%s.", n), say("Stage one brings $%s.", F.floor(n / 2)), say("Stage two brings $%s.", n - F.floor(n / 2) + s % 3))
    rows = table(spark, sf, "supplier").select(s.alias("contract_id"), F.posexplode(texts).alias("segment_index", "raw_text"))
    found = contradictions.detect(facts.extract_facts(rows, contradictions.clause_flags(F.col("raw_text"))))
    return found.select("contract_id", "rule")


@query("""SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON s_suppkey % 40 = o_custkey % 40 WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0""")
def webhook_fan_out(spark, sf):
    """Orders that are done, told to the suppliers that subscribe to that, two of three being active."""
    hooks = table(spark, sf, "supplier").select((F.col("s_suppkey") % 40).alias("user_id"), "s_suppkey", (F.col("s_suppkey") % 3 != 0).alias("active"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("failed"), F.lit("done"))).otherwise(F.array(F.lit("failed"))).alias("events"))
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("user_id"))
    return upsert.fan_out(orders, hooks, "done").select("o_orderkey", "s_suppkey")


@query("""SELECT o_orderkey, CASE WHEN (o_orderpriority[1] = '5' OR o_custkey % 11 <= 2) AND o_orderstatus <> 'P' THEN 0 ELSE 2 END AS refs,
['low', 'medium', 'high', 'critical'][greatest(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 3 END, o_custkey % 4 + 1)] AS compliance FROM orders""")
def verdicts_of_clauses(spark, sf):
    """References of plain clauses dropped, and compliance levels that only rise."""
    level = F.when(F.substring("o_orderpriority", 1, 1) == "5", "low").otherwise("high")
    rows = table(spark, sf, "orders").select("o_orderkey", level.alias("risk_level"), (F.col("o_custkey") % 11).alias("risk_score"), F.when(F.col("o_orderstatus") == "P", True).alias("has_warning"), F.array(F.lit("a"), F.lit("b")).alias("refs"), F.when(F.col("o_orderstatus") == "F", "compliant").otherwise("violation").alias("status"), pick(F.col("o_custkey"), list(scoring.LEVELS)).alias("was"))
    rows = scoring.drop_boilerplate_refs(rows)
    return rows.select("o_orderkey", F.size("refs").alias("refs"), scoring.compliance_level(F.col("status"), F.col("was")).alias("compliance"))


_FOUND = ["THE CODE ON WAGES, 2019 (2)", "Indian  Penal Code", "the industrial disputes act", "MSMED2006", "Some Other Act", "Rti-Act English", "", None]
_WRITTEN = ["The Code on Wages, 2019", "Indian Penal Code, 1860", "The Industrial Disputes Act, 1947", "Micro, Small and Medium Enterprises Development Act, 2006", "Some Other Act", "Right to Information Act, 2005", None, None]


@query(f"""SELECT min(p_partkey) AS id, w.act AS act_name, CAST(p_size AS VARCHAR) AS section_number FROM part JOIN ({values(list(enumerate(_WRITTEN)), 'k BIGINT, act VARCHAR')}) w ON w.k = p_partkey % 8 WHERE w.act IS NOT NULL GROUP BY 2, 3""")
def canonical_act_names(spark, sf):
    """Parts as sections of acts whose names stand in several ways."""
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("id"), pick(F.col("p_partkey"), _FOUND).alias("act_name"), F.col("p_size").cast("string").alias("section_number"))
    return readers.canonical_acts(rows, acts.act_names(spark)).select("id", "act_name", "section_number")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT a.vec_id, b.vec_id AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS r, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE b.vec_id % 50 = 0),
p AS (SELECT vec_id, string_agg('CASE: case ' || c || ' | CITATION: AIR ' || c || ' | PRECEDENT: held', ';' ORDER BY r) AS p FROM n WHERE r <= 2 AND s >= 0.4 GROUP BY 1)
SELECT vec_id, 'Topic' || vec_id % 5 || ' of ' || label AS symbols, coalesce(p, '') AS precedents, CASE WHEN label % 4 = 1 THEN 'Ground property transfers in the Transfer of Property Act, 1882 or the Registration Act, 1908, not in the Contract Act.' END AS ground
FROM v LEFT JOIN p USING (vec_id)""")
def request_context(spark, sf):
    """Every vector as a clause of its label's contract, every fiftieth as a case; five terms a contract and one too short to count."""
    e = table(spark, sf, "embeddings")
    kind = F.when(F.col("label") % 4 == 1, "Real Estate lease").when(F.col("label") % 4 == 2, "employment")
    rows = e.select("vec_id", "label", "embedding", F.format_string("Here Topic%s applies.", (F.col("vec_id") % 5).cast("string")).alias("text"), kind.alias("kind"))
    terms = e.select("label").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("label", F.when(F.col("n") < 5, F.concat(F.lit("Topic"), F.col("n").cast("string"))).otherwise("He").alias("term"), F.col("label").cast("string").alias("definition"))
    cases = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), F.concat(F.lit("case "), F.col("vec_id").cast("string")).alias("case_title"), F.concat(F.lit("AIR "), F.col("vec_id").cast("string")).alias("citation"), F.lit("held").alias("summary"), F.col("embedding").alias("vec"))
    out = enrich.request_context(rows, "vec_id", "label", "text", terms, cases, "embedding", "kind")
    shown = F.array_join(F.transform("symbols", lambda x: F.concat(x["term"], F.lit(" of "), x["definition"])), ";")
    return out.select("vec_id", shown.alias("symbols"), F.array_join("precedents", ";").alias("precedents"), "ground")
