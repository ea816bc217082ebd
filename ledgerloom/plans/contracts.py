"""Queries over contract language, which the generated corpus lacks: written out of the given tables' rows, their numbers and
names, so that SQL can say from the columns what is to be found in the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import citations, contradictions, enrich, facts, lexicon, scoring
from ledgerloom.plans.registry import pick, pick_sql, query, values
from ledgerloom.session import table
from ledgerloom.sources import readers

PLACES = ["Mumbai", "Delhi", "Chennai", "Kolkata"]
#: Terms of a contract out of a customer: k says which of eighteen kinds it is, q and odd vary it, b is an amount.
_TERMS_SQL = """WITH t AS (SELECT c_custkey AS c, c_custkey % 18 + 1 AS k, c_custkey // 18 AS q, c_custkey // 18 % 2 AS odd, CAST(floor(abs(c_acctbal)) AS BIGINT) + 10000 AS b FROM customer),
u AS (SELECT *, b * 2 // 5 AS m1, b - b * 2 // 5 - odd * 1000 AS m2, 1 + q % 5 AS r1, 1 + q // 5 % 5 AS r2, 1 + q % 20 AS d1, 1 + q // 2 % 15 AS d2, 1 + q % 4 AS h, 1 + q // 4 % 4 AS e, 1 + q % 24 AS t1, 1 + q // 2 % 24 AS t2, 1 + q % 9 AS y1, 1 + q // 9 % 9 AS y2, q % 4 AS p1, q // 4 % 4 AS p2 FROM t)
"""
_RATIO = "greatest({0}, {1}) > 1.5 * least({0}, {1})"
_FOUND_SQL = _TERMS_SQL + f""", found AS (SELECT c AS contract_id, CASE k
WHEN 1 THEN CASE WHEN odd = 1 THEN ['FEE_SUM_MISMATCH', 'critical', '0,1,2'] END WHEN 2 THEN CASE WHEN odd = 1 THEN ['FEE_SUM_MISMATCH', 'critical', '0,1'] END
WHEN 3 THEN CASE WHEN p1 <> p2 THEN ['JURISDICTION_CONFLICT', 'high', '0,1'] END WHEN 6 THEN CASE WHEN odd = 1 THEN ['AUTO_RENEWAL_VS_FIXED', 'high', '0,1'] END
WHEN 7 THEN CASE WHEN r1 <> r2 THEN ['INTEREST_CONTRADICTION', 'high', '0,1'] END WHEN 8 THEN CASE WHEN d1 > d2 THEN ['ACCEPTANCE_WINDOW', 'high', '0,1'] END
WHEN 9 THEN CASE WHEN {_RATIO.format("h", "e")} THEN ['NOTICE_CONFLICT', 'medium', '0,1'] END WHEN 10 THEN CASE WHEN odd = 1 THEN ['LIABILITY_CONTRADICTION', 'critical', '0,1'] END
WHEN 11 THEN CASE WHEN odd = 1 THEN ['OWNERSHIP_CONTRADICTION', 'critical', '0,1'] END WHEN 12 THEN CASE WHEN odd = 1 THEN ['PRECEDENCE_CONFLICT', 'high', '0,1'] END
WHEN 13 THEN CASE WHEN odd = 1 THEN ['TERMINATION_PAYMENT', 'critical', '0,1'] END WHEN 14 THEN CASE WHEN odd = 1 THEN ['DATE_CONFLICT', 'high', '0,1'] END
WHEN 15 THEN CASE WHEN {_RATIO.format("t1", "t2")} THEN ['DURATION_CONFLICT', 'high', '0,1'] END WHEN 16 THEN CASE WHEN {_RATIO.format("y1", "y2")} THEN ['RETENTION_CONFLICT', 'high', '0,1'] END END AS f FROM u)
"""
#: Amounts, periods and rates that the clauses of each kind state: clause, type, value, days.
_FACTS_SQL = _TERMS_SQL + """, f AS (SELECT c, unnest(CASE k
WHEN 1 THEN [{'s': 0, 't': 'currency', 'v': b, 'd': NULL}, {'s': 1, 't': 'currency', 'v': m1, 'd': NULL}, {'s': 2, 't': 'currency', 'v': m2, 'd': NULL}]
WHEN 2 THEN [{'s': 0, 't': 'currency', 'v': 12 * b, 'd': NULL}, {'s': 1, 't': 'currency', 'v': b + 7 * odd, 'd': NULL}]
WHEN 7 THEN [{'s': 0, 't': 'percentage', 'v': r1, 'd': NULL}, {'s': 1, 't': 'percentage', 'v': r2, 'd': NULL}]
WHEN 8 THEN [{'s': 0, 't': 'duration', 'v': d1, 'd': d1}, {'s': 1, 't': 'duration', 'v': d2, 'd': d2}]
WHEN 9 THEN [{'s': 0, 't': 'duration', 'v': 24 * h, 'd': h}, {'s': 1, 't': 'duration', 'v': e, 'd': e}]
WHEN 10 THEN [{'s': 0, 't': 'currency', 'v': b, 'd': NULL}, {'s': 1, 't': 'currency', 'v': b + odd, 'd': NULL}]
WHEN 15 THEN [{'s': 0, 't': 'duration', 'v': t1, 'd': 30 * t1}, {'s': 1, 't': 'duration', 'v': t2, 'd': 30 * t2}]
WHEN 16 THEN [{'s': 0, 't': 'duration', 'v': y1, 'd': 365 * y1}, {'s': 1, 't': 'duration', 'v': y2, 'd': 365 * y2}]
WHEN 17 THEN [{'s': 0, 't': 'duration', 'v': 30, 'd': 30}]
WHEN 18 THEN [{'s': 0, 't': 'currency', 'v': b, 'd': NULL}, {'s': 0, 't': 'duration', 'v': d1, 'd': d1}] END) AS x FROM u)
SELECT c AS contract_id, CAST(x.s AS INT) AS segment_index, x.t AS type, CAST(x.v AS DOUBLE) AS value, CAST(x.d AS DOUBLE) AS days FROM f"""


def clauses(spark, sf):
    """A contract out of every customer: contract_id, segment_index, raw_text, with amounts, periods and places of the customer's."""
    c = F.col("c_custkey")
    k, q = (c % 18 + 1), F.floor(c / 18)
    odd = q % 2
    b = F.floor(F.abs("c_acctbal")) + 10_000
    m1 = F.floor(b * 2 / 5)
    say = lambda pattern, *values: F.format_string(pattern, *(v.cast("string") for v in values))
    money = lambda v: F.format_number(v, 0)
    if_odd = lambda yes, no: F.when(odd == 1, yes).otherwise(no)
    place = lambda v: pick(v, PLACES)
    day = F.date_add(F.lit("2020-01-01").cast("date"), (c % 1000).cast("int"))
    post = "Notices are sent by post."
    texts = [
        [say("The total contract value is INR %s.", money(b)), say("Milestone 1 payment: INR %s.", money(m1)), say("Milestone 2 payment: INR %s.", money(b - m1 - odd * 1000))],
        [say("The annual fee is USD %s.", money(12 * b)), say("A monthly installment of USD %s falls due.", money(b + 7 * odd))],
        [say("Exclusive jurisdiction lies with the courts of %s.", place(q)), say("Exclusive jurisdiction lies with the courts of %s.", place(F.floor(q / 4)))],
        [say("This agreement is governed by the laws of India, with courts located in %s.", place(q))],
        [F.lit("Courts of Bangalore have jurisdiction."), F.lit("Courts of Bengaluru have jurisdiction.")],
        [F.lit("This agreement shall automatically renew every year."), if_odd("This agreement shall expire on 31 March 2026.", post)],
        [say("Late payment interest accrues at %s%% per annum.", 1 + q % 5), say("Default interest is charged at %s%% per annum.", 1 + F.floor(q / 5) % 5)],
        [say("The client may review the deliverables within %s days.", 1 + q % 20), say("Work is deemed accepted after %s days.", 1 + F.floor(q / 2) % 15)],
        [say("The security incident must be reported within %s hours.", 24 * (1 + q % 4)), say("A security breach must be reported within %s days.", 1 + F.floor(q / 4) % 4)],
        [say("Total liability shall not exceed USD %s.", money(b)), say("The cap on liability is USD %s.", money(b + odd))],
        [F.lit("All deliverables are the property of the Client."), if_odd("Vendor retains all title to the deliverables.", "Client retains all title to the deliverables.")],
        [F.lit("Schedule A shall prevail."), if_odd("This agreement shall prevail.", "Schedule A shall prevail.")],
        [F.lit("On exit the vendor shall refund all fees."), if_odd("The client shall pay for services performed.", post)],
        [say("The project completion date is %s.", F.date_format(day, "MMMM d, yyyy")), say("The final delivery date is %s.", F.date_format(F.date_add(day, (odd * 31).cast("int")), "MMMM d, yyyy"))],
        [say("The initial term is %s months.", 1 + q % 24), say("The term of this agreement is %s months.", 1 + F.floor(q / 2) % 24)],
        [say("Invoices shall be retained for %s years.", 1 + q % 9), say("Tax records shall be retained for %s years.", 1 + F.floor(q / 9) % 9)],
        [F.lit("The client pays within thirty days of invoice.")],
        [say("Payment of INR %s is due %s days after delivery.", money(b), 1 + q % 20)],
    ]
    chosen = F.coalesce(*(F.when(k == n, F.array(*t)) for n, t in enumerate(texts, 1)))
    # Dealt by contract while rows are short, so that all cores read texts and facts are grouped where they are.
    return table(spark, sf, "customer").repartition("c_custkey").select(c.alias("contract_id"), F.posexplode(chosen).alias("segment_index", "raw_text"))


def _detected(rows):
    return contradictions.detect(facts.extract_facts(rows, contradictions.clause_flags(F.col("raw_text"))))


@query(_FACTS_SQL)
def facts_literal(spark, sf):
    """Amounts, periods and rates of all customers' contracts."""
    found = facts.extract_facts(clauses(spark, sf)).filter(F.col("type").isin("currency", "duration", "percentage"))
    return found.select("contract_id", "segment_index", "type", "value", "days")


@query(_FOUND_SQL + "SELECT contract_id, f[1] AS rule, f[2] AS severity, f[3] AS clauses FROM found WHERE f IS NOT NULL")
def contradictions_literal(spark, sf):
    return _detected(clauses(spark, sf)).select("contract_id", "rule", "severity", F.array_join(F.transform("clause_refs", lambda r: r.cast("string")), ",").alias("clauses"))


@query(_FOUND_SQL + "SELECT contract_id, CAST(unnest(string_split(f[3], ',')) AS INT) AS segment_index, f[2] AS risk_level FROM found WHERE f IS NOT NULL")
def audited_clauses(spark, sf):
    """Clauses that findings reach, with the level they get."""
    rows = clauses(spark, sf)
    base = rows.select("contract_id", "segment_index", F.lit("low").alias("risk_level"), F.lit(2).alias("risk_score"), F.array().cast("array<string>").alias("risk_reasons"), F.lit(5).alias("confidence_score"), F.lit("low").alias("compliance_risk_level"))
    return scoring.apply_findings(base, _detected(rows)).filter("risk_level <> 'low'").select("contract_id", "segment_index", "risk_level")


_KINDS = ["termination_payment", "ownership", "precedence", "auto_renewal", "fixed_end_date", "date", "jurisdiction"]


@query(_TERMS_SQL + """, f AS (SELECT c, unnest(CASE WHEN k IN (3, 4, 5) THEN [{'t': 'jurisdiction', 'n': 2}] WHEN k = 6 AND odd = 1 THEN [{'t': 'auto_renewal', 'n': 1}, {'t': 'date', 'n': 1}, {'t': 'fixed_end_date', 'n': 1}]
WHEN k = 6 THEN [{'t': 'auto_renewal', 'n': 1}] WHEN k = 11 THEN [{'t': 'ownership', 'n': 2}] WHEN k = 12 THEN [{'t': 'precedence', 'n': 2}] WHEN k = 13 THEN [{'t': 'termination_payment', 'n': 1 + odd}] WHEN k = 14 THEN [{'t': 'date', 'n': 2}] END) AS x FROM u)
SELECT c AS contract_id, x.t AS type, CAST(x.n AS BIGINT) AS n FROM f""")
def fact_kinds_literal(spark, sf):
    return facts.extract_facts(clauses(spark, sf)).filter(F.col("type").isin(*_KINDS)).groupBy("contract_id", "type").agg(F.count(F.lit(1)).alias("n"))


_CATEGORY_SQL = """, f AS (SELECT c, unnest(CASE k WHEN 1 THEN ['total_fee', 'milestone_fee', 'milestone_fee'] WHEN 2 THEN ['total_fee', 'milestone_fee'] WHEN 3 THEN ['jurisdiction', 'jurisdiction'] WHEN 4 THEN ['jurisdiction']
WHEN 5 THEN ['jurisdiction', 'jurisdiction'] WHEN 6 THEN ['auto_renewal', 'uncategorized'] WHEN 7 THEN ['interest_rate', 'interest_rate'] WHEN 8 THEN ['acceptance_period', 'deemed_acceptance'] WHEN 9 THEN ['security_notice', 'security_notice']
WHEN 10 THEN ['liability_cap', 'liability_cap'] WHEN 11 THEN ['uncategorized', 'uncategorized'] WHEN 12 THEN ['precedence', 'precedence'] WHEN 13 THEN ['refund', CASE WHEN odd = 1 THEN 'payment_on_term' ELSE 'uncategorized' END]
WHEN 14 THEN ['completion_date', 'delivery_date'] WHEN 15 THEN ['contract_term', 'contract_term'] WHEN 16 THEN ['retention_period', 'retention_period'] ELSE ['uncategorized'] END) AS category, unnest(range(CASE WHEN k = 1 THEN 3 WHEN k IN (4, 17, 18) THEN 1 ELSE 2 END)) AS s FROM u)
SELECT c AS contract_id, CAST(s AS INT) AS segment_index, category FROM f"""


@query(_TERMS_SQL + _CATEGORY_SQL)
def fact_category(spark, sf):
    """Categories of all clauses of customers' contracts."""
    return clauses(spark, sf).select("contract_id", "segment_index", F.explode(facts.categories(F.col("raw_text"))).alias("category"))


#: One text a rule, written for it, with the rule it meets; then texts that meet none, one of them too short.
_TRAPS = [
    ("In a pandemic every obligation of the vendor is suspended while the customer's duty to pay remains in force.", "predatory force majeure"),
    ("The author assigns all inventions made at any time to the publisher and keeps no right in them whatsoever.", "predatory intellectual property capture"),
    ("The customer shall indemnify the vendor even for the vendor's own gross negligence in doing the work.", "one-sided indemnification"),
    ("The employer may deduct such sums from the salary as it sees fit, and these are permanently lost to the worker.", "wage forfeiture"),
    ("After termination the worker shall not work for any rival of the firm in the same line of trade.", "post-employment non-compete"),
    ("The worker gives the firm power of attorney over each personal account that is opened during the engagement.", "irrevocable power of attorney over personal accounts"),
    ("The studio owns whatever the artist's spouse may draw, paint or write while this engagement is in force.", "overreaching intellectual property grab"),
    ("The carrier may harvest the metadata of all calls that are made through the service by its users.", "silent network data harvesting and sale"),
    ("Whoever asks for an audit of the books runs the danger of criminal prosecution by the service's owner.", "anti-audit threat of criminal prosecution"),
    ("Any downtime that follows from an economic event is left out of the promised hours of service.", "predatory sla downtime exemption"),
    ("The costs of cooling in the hall where the machines stand are borne by the subscriber alone, month by month.", "unreasonable infrastructure cost shift"),
    ("Tools that were invented after the hiring of the worker may not be used for any task under this bargain.", "post-hire technology prohibition"),
    ("The broker may retroactively change what a trade was done at, as the market moves on the same day.", "retroactive trade execution price alteration"),
    ("Money is lost to those who fail to log in for 7 consecutive days, whatever the reason for it may be.", "predatory account inactivity fund forfeiture"),
    ("The maker may deactivate the tractor from afar as soon as an instalment of the price is late by a day.", "remote hardware deactivation"),
    ("The rider shall indemnify the maker for manufacturing defects that come to light within the first year.", "hardware defect liability shift"),
    ("The firm may terminate the bargain for convenience, and the writer is then not entitled to payment for drafts.", "termination without payment"),
    ("The school may unilaterally modify the salary of its teachers at any time in the course of a year.", "unilateral contract variation"),
    ("A complaint about sexual harassment goes to private arbitration and before no judge of the land.", "illegal harassment arbitration"),
    ("Who resigns within two years of the training owes a fixed penalty regardless of the actual cost of it.", "punitive training bond"),
    ("The guard may be suspended without pay, at the sole discretion of the officer who is on duty that day.", "unpaid indefinite suspension"),
    ("Quarrels under this bargain come before courts located in Delaware, wherever the parties may live.", "foreign jurisdiction trap"),
    ("The agent shall accept business from no one anywhere in the world; they may accept business from the firm only.", "broad non-solicit restraint"),
    ("The time of probation may be made longer; the house may extend indefinitely what it thinks is needed.", "indefinite probation trap"),
    ("The firm keeps a fingerprint of every visitor and may track where each one goes; the visitor completely waives objection.", "unconscionable surveillance"),
    ("Any breach, be it trivial, brings liquidated damages irrespective of actual loss on the other side.", "excessive liquidated damages penalty"),
    ("The poet agrees to waive all moral rights in the verses that are printed under this bargain.", "moral rights waiver"),
    ("The lease shall automatically renew for successive periods of 5 years unless somebody says otherwise in time.", "predatory evergreen auto-renewal"),
    ("The members are bound by new rules of the club retroactively, from the day on which each of them joined.", "retroactive amendment"),
    ("The arbitrator is one of the senior executives of the seller, who names that person as quarrels come up.", "biased arbitration seat"),
    ("The agency may reallocate 100% of the remuneration to cover its own costs of doing business abroad.", "obfuscated wage deduction"),
    ("Who leaves early must relinquish all accrued wages and shall ask for nothing more of the employer.", "wage forfeiture on termination"),
    ("This bargain is exclusively governed by the statutes of the Cayman Islands and by nothing else.", "hostile jurisdiction"),
    ("The founder's vested shares may be taken: the board may claw back them in its absolute discretion.", "ghost equity clawback"),
    ("Staff consent to a polygraph and waives any and all rights that a statute on privacy may give to them.", "biometric dpdp waiver"),
    ("Who makes negative remarks about the founders shall forfeit all unpaid bonuses that were promised to them.", "gag order equity forfeiture"),
    ("Each party pays its own costs, and both may end the bargain by a letter sent three months ahead of time.", None),
    ("Waive all moral rights.", None),
    ("The customer shall indemnify for gross negligence, but only as far as the indemnifying party's insurance reaches.", None),
    ("The probation is over by then. Whether the work goes on for an INDEFINITE time is left to a later bargain.", None),
]

#: The text that stays too short.
_SHORT = 37


@query(f"SELECT c_custkey, t AS trap_type FROM (SELECT c_custkey, unnest({pick_sql('c_custkey', [[k] if k else [] for _, k in _TRAPS], 'VARCHAR[]')}) AS t FROM customer)")
def trap_literals(spark, sf):
    """Texts with customers' names in them, each written for one rule of the default lexicon."""
    text = F.concat(pick(F.col("c_custkey"), [t for t, _ in _TRAPS]), F.when(F.col("c_custkey") % len(_TRAPS) == _SHORT, "").otherwise(F.concat(F.lit(" "), F.col("c_name"))))
    rows = table(spark, sf, "customer").select("c_custkey", text.alias("raw_text"))
    return lexicon.match(rows, "raw_text", lexicon.table(spark, lexicon.DEFAULT_TRAPS)).select("c_custkey", "trap_type")



_ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
_TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
_TENS = ["none", "ten", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


@query("""WITH n AS (SELECT p_partkey AS k, 1 + p_partkey % 9 AS h, p_size % 90 + 10 AS n FROM part)
SELECT k AS p_partkey, CAST(CASE k % 4 WHEN 0 THEN n WHEN 1 THEN h * 100 + n WHEN 2 THEN h * 100000 + n * 1000 ELSE 0 END AS DOUBLE) AS value FROM n""")
def word_number(spark, sf):
    """Numbers of parts, written out in words and read again: below 100, with hundreds, with lakhs and thousands, and none."""
    k, n, h = F.col("p_partkey"), F.col("p_size") % 90 + 10, pick(F.col("p_partkey") % 9, _ONES[1:])
    tens, ones = pick(F.floor(n / 10), _TENS), n % 10
    spoken = F.when(n < 20, pick(ones, _TEENS)).when(ones == 0, tens).otherwise(F.concat(tens, F.lit("-"), pick(ones, _ONES)))
    phrase = F.when(k % 4 == 0, spoken).when(k % 4 == 1, F.concat(h, F.lit(" hundred "), spoken)).when(k % 4 == 2, F.concat(h, F.lit(" lakh "), spoken, F.lit(" thousand"))).otherwise("none of these")
    return table(spark, sf, "part").select("p_partkey", T.word_number(phrase).alias("value"))


_UNITS = [("weeks", 7.0), ("months", 30.0), ("hours", 1 / 24), ("Business  Days", 1.4), ("year", 365.0), ("calendar days", 1.0)]


@query(f"SELECT l_orderkey, l_linenumber, l_quantity * {pick_sql('l_partkey', [d for _, d in _UNITS], 'DOUBLE')} AS days FROM lineitem")
def duration_days(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", T.duration_days(F.col("l_quantity"), T.duration_unit(pick(F.col("l_partkey"), [u for u, _ in _UNITS]))).alias("days"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) WHEN 1 THEN 'rediss://' || regexp_extract(url, '^https?://([^/?#:]+)', 1) || ':6379' ELSE '<invalid url>' END AS redacted FROM pages""")
def redact_url(spark, sf):
    """Addresses of pages, as they are, with a login and a port, and as no address."""
    host = F.regexp_extract("url", "^https?://([^/?#:]+)", 1)
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("rediss://default:secret@"), host, F.lit(":6379"))).otherwise(F.concat(F.lit("nonsense "), host))
    return table(spark, sf, "pages").select("page_id", T.redact_url(url).alias("redacted"))


_CITED_AS = [("Sec. {}", "Section {}"), ("Art. {} (Chunk 3/9)", "Article {}"), ("Section {} of Contract Act", "Section {} of Contract Act"), (" - S. {} -", "Section {}")]


@query(f"""SELECT l_orderkey, l_linenumber, replace({pick_sql("l_linenumber", [c for _, c in _CITED_AS])}, '{{}}', CAST(l_suppkey AS VARCHAR)) || CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN ' of N Act, 1872'
ELSE CASE WHEN l_linenumber % 4 = 2 THEN '' ELSE ' of Contract Act, 1872' END END AS cited FROM lineitem""")
def normalise_citation(spark, sf):
    """Sections numbered by suppliers, of an act or of none, as four ways of citing them write them."""
    hint = F.replace(pick(F.col("l_linenumber"), [h for h, _ in _CITED_AS]), F.lit("{}"), F.col("l_suppkey").cast("string"))
    act = F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "N", "N Act, 1872").otherwise("Contract Act, 1872")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.normalise_citation(hint, act).alias("cited"))


STATUTES = [
    ("Contract Act 1872", "Section 27 (Chunk 1)", "General words about bargains."),
    ("Contract Act 1872", "Section 27 (Chunk 2)", "Every agreement in restraint of trade is void to that extent."),
    ("Rent Act", "Section 9", "Rent shall be paid monthly."),
    ("Wages Act", "Section 3", "Wages are paid by the employer before the seventh day."),
]
REFS = [
    (1, "CONTRACT", "Contract Act, 1872", "Sec. 27", "agreement in restraint of trade is void"),
    (2, "CONTRACT", "Contract Act, 1872", "Section 27", "imprisonment follows for embezzlement of public property"),
    (3, "CONTRACT", "Contract Act, 1872", "Section 99", "anything"),
    (4, "CASE_LAW", "Some v. Other", "", "precedent"),
    (5, "WAGES", "", "", "wages must be paid before seventh day"),
]


_VERIFIED = [("verified", "strong", "Section 27 (Chunk 2)"), ("misquoted", "hallucinated", "Section 27 (Chunk 1)"), ("not_found", "unverifiable", None), ("not_applicable", "weak", None), ("verified", "strong", "Section 3")]


@query(f"SELECT l_orderkey * 10 + l_linenumber AS ref_id, {', '.join(pick_sql('l_partkey', [v[k] for v in _VERIFIED]) + ' AS ' + n for k, n in enumerate(('status', 'grade', 'section_found')))} FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey)")
def verify_citations(spark, sf):
    """References of every order line, dealt over five kinds."""
    statutes = spark.createDataFrame(STATUTES, "act_name string, section_number string, content string")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    said = (pick(F.col("l_partkey"), [r[k] for r in REFS]).alias(n) for k, n in enumerate(("act_key", "act_name", "section_hint", "reason"), 1))
    refs = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), *said)
    terms = spark.createDataFrame([("WAGES", 1, "Payment of Wages"), ("WAGES", 2, "Wages")], "act_key string, term_ord int, term string")
    return citations.verify(refs, statutes, terms).select("ref_id", "status", "grade", "section_found")


@query("""WITH n AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS n FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 2 = 1 THEN '$' || format('{:,}', n) WHEN n < 100000 THEN '₹' || format('{:,}', n) ELSE '₹' || n // 100000 || ',' || lpad(CAST(n % 100000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') END AS shown FROM n""")
def money_literal(spark, sf):
    """Totals of orders in dollars and in rupees, grouped each in their way."""
    return table(spark, sf, "orders").select("o_orderkey", T.money(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 1, "USD").otherwise("INR")).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CAST(l_quantity AS BIGINT) * 1000.0 WHEN 1 THEN floor(l_extendedprice) WHEN 2 THEN CAST(l_quantity AS BIGINT) * 1000000.0 END AS value FROM lineitem""")
def tolerant_number(spark, sf):
    """Quantities and prices as loose texts: with a sign and a k, in groups, with an m, and as none."""
    whole = lambda c: F.floor(c)
    kind = F.col("l_linenumber") % 4
    raw = F.when(kind == 0, F.concat(F.lit("$"), whole("l_quantity"), F.lit("k"))).when(kind == 1, F.concat(F.lit("INR "), F.format_number(whole("l_extendedprice"), 0))).when(kind == 2, F.concat(whole("l_quantity"), F.lit("m"))).otherwise("n/a")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.tolerant_number(raw).alias("value"))


_ACTS = [
    ("Industrial Disputes Act", "labor_law"), ("Code on Wages", "labor_law"), ("Indian Contract Act", "general_contract_law"), ("Copyright Act", "intellectual_property"),
    ("Digital Personal Data Protection Act", "data_privacy"), ("IT Rules 2021", "data_privacy"), ("Transfer of Property Act", "real_estate_law"), ("Consumer Protection Act", "consumer_protection"),
    ("Specific Relief Act", "dispute_resolution"), ("Labour Code", "general_contract_law"), ("Lighthouse Act", "general_contract_law"),
]


@query(f"SELECT s_suppkey, {pick_sql('s_suppkey', [d for _, d in _ACTS])} AS domain FROM supplier")
def act_domain(spark, sf):
    """Acts named after suppliers."""
    act = F.concat("s_name", F.lit(" on "), pick(F.col("s_suppkey"), [a for a, _ in _ACTS]))
    return table(spark, sf, "supplier").select("s_suppkey", readers.domain_of(act).alias("domain"))


_CLASSES = [
    ("The employee shall not compete and the court decides.", "non_compete"),
    ("No solicitation of clients during litigation.", "non_solicitation"),
    ("Every invention under a patent.", "intellectual_property"),
    ("Proprietary notes stay secret.", "confidentiality"),
    ("A dispute on personal info.", "dispute_resolution"),
    ("Privacy ends on breach.", "privacy_data"),
    ("Either side may terminate and hold harmless.", "termination"),
    ("The vendor shall indemnify against a pandemic.", "indemnification"),
    ("An act of God excuses payment.", "force_majeure"),
    ("We may withhold what we amend.", "compensation"),
    ("They may modify it.", "amendment"),
    ("Nothing of note here.", "other"),
]


@query(f"SELECT c_custkey, {pick_sql('c_custkey', [k for _, k in _CLASSES])} AS class FROM customer")
def clause_classes(spark, sf):
    """The offline classes of clauses with customers' names in them; in each text words of a later class stand too."""
    text = F.concat("c_name", F.lit(" agrees. "), pick(F.col("c_custkey"), [c for c, _ in _CLASSES]))
    return table(spark, sf, "customer").select("c_custkey", lexicon.classify(text, lexicon.CLAUSE_CASCADE).alias("class"))


_OFFLINE = [
    ("Salary may be deferred to 2030.", "other", "wage_deferral", "high", 2),
    ("Round the clock, 24/7, with training.", "other", "availability_waiver", "high", 2),
    ("A bond of two years.", "non_compete", "training_bond", "high", 2),
    ("Work of a weekend is ours.", "ip_ownership", "ip_life_capture", "high", 2),
    ("Work of a weekend is ours.", "other", None, "low", 0),
    ("Liquidated sums fall due.", "privacy_data", "liquidated_penalty", "high", 2),
    ("No rival work.", "non_compete", None, "high", 2),
    ("One judge.", "dispute_resolution", None, "medium", 1),
    ("Secrets.", "confidentiality", None, "low", 0),
    ("We share records.", "privacy_data", None, "high", 1),
]


@query(f"SELECT c_custkey, {pick_sql('c_custkey', [o[2] for o in _OFFLINE])} AS flag, {pick_sql('c_custkey', [o[3] for o in _OFFLINE])} AS compliance, {pick_sql('c_custkey', [o[4] for o in _OFFLINE], 'INT')} AS n_issues FROM customer")
def offline_literals(spark, sf):
    """What the offline stand-in says of customers' clauses."""
    key = F.col("c_custkey")
    said = enrich.offline_advice(F.concat("c_name", F.lit(": "), pick(key, [o[0] for o in _OFFLINE])), pick(key, [o[1] for o in _OFFLINE]))
    return table(spark, sf, "customer").select("c_custkey", F.explode(F.array(said)).alias("a")).select("c_custkey", "a.flag", "a.compliance", F.size("a.issues").alias("n_issues"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS f FROM documents), h AS (SELECT *, left(f, 250) AS h, regexp_extract(left(f, 250), '(?s)^(.*)\.', 1) AS s FROM f)
SELECT doc_id, CASE WHEN length(f) <= 250 THEN f WHEN length(s) > 125 THEN s || '.' ELSE h || '...' END AS summary FROM h""")
def statute_summary(spark, sf):
    """Every document as a statute's content."""
    return table(spark, sf, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN abs(l_quantity + l_suppkey - 40) <= 0.01 WHEN 1 THEN abs(l_quantity * l_suppkey - 40) <= 0.01 WHEN 2 THEN greatest(l_quantity, l_suppkey) <= 40 WHEN 3 THEN least(l_quantity, l_suppkey) > 40 END AS holds FROM lineitem""")
def literal_checks(spark, sf):
    """Stated relations between the quantity and the supplier of each order line."""
    kind = pick(F.col("l_linenumber"), ["sum_equals", "product_equals", "at_most", "above", "odd"])
    stated = F.array(F.col("l_quantity").cast("double"), F.col("l_suppkey").cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scoring.check_literal(kind, stated, F.lit(40.0)).alias("holds"))


_JSON = ['{"a": %s}', "Here:\n```json\n{\"a\": %s}\n```", 'well {"a": %s} so', "nothing of %s"]


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_custkey AS VARCHAR) END AS a FROM orders")
def json_recovery(spark, sf):
    """Customers of orders in answers of four shapes."""
    raw = F.replace(pick(F.col("o_orderkey"), _JSON), F.lit("%s"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", enrich.parse_json(raw, "a int")["a"].cast("string").alias("a"))


_TERMS = [(1, "Loss", "direct, indirect and other harm"), (1, "Fee", "the amount paid"), (1, "Work Product", "what the consultant or a spouse makes"), (1, "Restricted Period", "12 months"), (3, "Term", "5 years from signing"), (3, "It", "unlimited losses")]
_USES = [
    (1, 0, "Pay all Loss.", 8, "high"),
    (1, 1, "Pay the Fee.", 3, "low"),
    (1, 2, "The Work Product and any Loss are ours.", 9, "critical"),
    (1, 3, "In the Restricted Period no rival work.", 3, "low"),
    (1, 4, "This Agreement is entered into for any Loss.", 3, "low"),
    (2, 0, "Pay all Loss.", 3, "low"),
    (3, 0, "During the Term it stands.", 8, "high"),
]


@query(f"SELECT c_custkey AS contract_id, segment_index, risk_score, risk_level FROM customer JOIN ({values([(c, k, n, v) for c, k, _, n, v in _USES], 'kind INT, segment_index INT, risk_score INT, risk_level VARCHAR')}) ON kind = c_custkey % 3 + 1")
def defined_terms(spark, sf):
    """Three kinds of contract dealt over the customers, each with its terms and its clauses."""
    key = F.col("c_custkey")
    per = lambda rows, *names: F.coalesce(*(F.when(key % 3 + 1 == c, F.array(*(F.struct(*(F.lit(str(v)).alias(n) for n, v in zip(names, r, strict=True))) for r in own))) for c, own in rows.items()))
    uses = {c: [(k, t) for d, k, t, _, _ in _USES if d == c] for c in (1, 2, 3)}
    said = {c: [(t, w) for d, t, w in _TERMS if d == c] for c in (1, 3)}
    customers = table(spark, sf, "customer")
    rows = customers.select(key.alias("contract_id"), F.explode(per(uses, "k", "t")).alias("u")).select("contract_id", F.col("u.k").cast("int").alias("segment_index"), F.col("u.t").alias("raw_text"))
    rows = rows.withColumns({"risk_score": F.lit(3), "risk_level": F.lit("low"), "risk_reasons": F.array().cast("array<string>")})
    terms = customers.select(key.alias("contract_id"), F.explode(per(said, "term", "definition")).alias("d")).select("contract_id", "d.*")
    return scoring.defined_terms(rows, terms, ["contract_id", "segment_index"]).select("contract_id", "segment_index", "risk_score", "risk_level")


_SAFE = [("Disputes go to mediation first.", 3), ("Pay now.", None), ("Mutually indemnify each other.", 4)]


@query(f"""WITH c AS (SELECT o_orderkey, CAST(o_custkey % 11 AS INT) AS s, {pick_sql("o_orderkey", [c for _, c in _SAFE], "INT")} AS cap FROM orders)
SELECT o_orderkey, CASE WHEN s > cap THEN CASE WHEN cap <= 3 THEN 'low' ELSE 'medium' END ELSE 'high' END AS risk_level, CASE WHEN s > cap THEN cap ELSE s END AS risk_score FROM c""")
def safe_harbours(spark, sf):
    """Clauses of orders that a safe harbour caps, or not, at scores from 0 to 10."""
    rows = table(spark, sf, "orders").select("o_orderkey", pick(F.col("o_orderkey"), [t for t, _ in _SAFE]).alias("raw_text"), F.lit("high").alias("risk_level"), (F.col("o_custkey") % 11).cast("int").alias("risk_score"))
    return scoring.safe_harbours(rows).select("o_orderkey", "risk_level", "risk_score")


@query("""WITH l AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, CAST(o_custkey % 11 AS INT) AS s, o_orderstatus AS st, coalesce(bad, false) AS bad FROM orders LEFT JOIN l ON k = o_orderkey)
SELECT o_orderkey, CASE WHEN bad AND st <> 'F' THEN 'high' WHEN st = 'F' THEN 'critical' ELSE 'low' END AS risk_level, CASE WHEN bad THEN greatest(8, s) ELSE s END AS risk_score, bad AS human_review FROM o""")
def citation_penalty(spark, sf):
    """Orders whose returned lines count as citations that were not found, or misquoted."""
    status = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") % 2 == 0, "not_found").otherwise("misquoted")).otherwise("verified")
    seen = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(status).alias("statuses"))
    orders = table(spark, sf, "orders").join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = orders.select("o_orderkey", "statuses", (F.col("o_custkey") % 11).cast("int").alias("risk_score"), F.when(F.col("o_orderstatus") == "F", "critical").otherwise("low").alias("risk_level"))
    rows = rows.withColumns({"compliance_risk_level": F.lit(None).cast("string"), "human_review": F.lit(None).cast("boolean"), "risk_reasons": F.lit(None).cast("array<string>")})
    return scoring.citation_penalty(rows).select("o_orderkey", "risk_level", "risk_score", "human_review")
