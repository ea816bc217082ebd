"""Contradictions between the clauses of a contract, from its facts, in one pass and one shuffle.

Findings: contract_id, rule, severity, title, clause_refs (sorted, distinct). What a rule needs of a fact's clause goes with the
fact; facts are then grouped by contract once, with the aggregates of all rules, and each rule is an expression over its
own. Least and greatest values stand for pairs wherever they can; where pairs themselves matter they are made within the
contract's row from the few facts of that kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity of each rule. Fixed values.
SEVERITY = {
    "FEE_SUM_MISMATCH": "critical",
    "ACCEPTANCE_WINDOW": "high",
    "NOTICE_CONFLICT": "medium",
    "RETENTION_CONFLICT": "high",
    "JURISDICTION_CONFLICT": "high",
    "LIABILITY_CONTRADICTION": "critical",
    "DATE_CONFLICT": "high",
    "AUTO_RENEWAL_VS_FIXED": "high",
    "DURATION_CONFLICT": "high",
    "OWNERSHIP_CONTRADICTION": "critical",
    "PRECEDENCE_CONFLICT": "high",
    "TERMINATION_PAYMENT": "critical",
    "INTEREST_CONTRADICTION": "high",
}
#: A place and the place it lies in; other names of a place. Fixed values.
PARENT = {
    "mumbai": "india", "delhi": "india", "bengaluru": "india", "chennai": "india", "kolkata": "india", "hyderabad": "india", "port blair": "india",
    "new york": "united states", "california": "united states", "delaware": "united states", "texas": "united states", "illinois": "united states",
    "florida": "united states", "massachusetts": "united states", "washington": "united states", "london": "england", "england": "united kingdom",
}
ALIAS = {"bangalore": "bengaluru"}
#: Payments a year of a clause that names a period. Fixed values.
PERIODS = (("monthly", 12), ("quarterly", 4), ("bi-weekly", 26))
RATIO = 1.5
CENT = 0.01


def ancestors(place: str) -> list[str]:
    up = PARENT.get(place)
    return [up, *ancestors(up)] if up else []


def _has(*names: str) -> Column:
    return F.exists("categories", lambda c: c.isin(*names))


def _is(kind: str, *names: str) -> Column:
    return (F.col("type") == kind) & (_has(*names) if names else F.lit(True))


def clause_flags(text: Column) -> Column:
    """What the rules ask of a fact's whole clause, as a struct: the column `about` of facts."""
    low = F.lower(text)
    yes = lambda pattern, of=text: F.coalesce(of.rlike(pattern), F.lit(False))
    subject = (
        F.when(F.contains(low, F.lit("confidential")), "confidentiality")
        .when(low.rlike("financial|tax|audit|accounting|invoice|billing|payment"), "financial")
        .when(low.rlike("email|correspondence|communication|message|log|chat"), "email")
        .otherwise("general")
    )
    flags = {
        "total": yes(r"(?:total|aggregate|contract)\s+(?:value|fee|price|consideration|amount)", low),
        "part": yes(r"milestone|phase|tranche|installment|stage", low),
        "yearly": reduce(lambda rest, p: F.when(F.contains(low, F.lit(p[0])), p[1]).otherwise(rest), reversed(PERIODS), F.lit(1)),
        "subject": subject,
        "earlier_work": yes(r"(?i)pre-existing|underlying|background\s+ip|prior\s+work"),
        "deliverables": yes("(?i)deliverable"),
        "ip": yes(r"(?i)intellectual\s+property"),
        "scoped": yes(r"(?i)with\s+respect\s+to|regarding|for\s+(?:purposes?\s+of|all\s+(?:other\s+)?matters?|pricing|payment|delivery|scope)"),
        "qualified": yes(r"(?i)not\s+yet\s+performed|unused|unearned|pro[- ]?rat(?:a|ed)|remaining"),
    }
    return F.struct(*(c.alias(n) for n, c in flags.items()))


def _of(condition: Column, value: str | Column = "segment_index") -> Column:
    """value where condition holds, else null, which aggregates pass over."""
    return F.when(F.coalesce(condition, F.lit(False)), F.col(value) if isinstance(value, str) else value)


def _refs(condition: Column) -> Column:
    return F.collect_set(_of(condition))


def _first(condition: Column, value: Column) -> Column:
    """value of the first fact, in order, for which condition holds."""
    return F.min_by(_of(condition, value), _of(condition, F.struct("segment_index", "ord")))


def _spread(lo: str, hi: str) -> Column:
    """Greatest by least value; a least value of 0 under a greater one counts as any spread."""
    return F.when(F.col(lo) > 0, F.col(hi) / F.col(lo)).when(F.col(hi) > 0, float("inf")).otherwise(1.0)


def aggregates() -> dict[str, Column]:
    """What all rules need of the facts of one contract."""
    about, money = F.col("about"), _is("currency")
    part = F.struct("segment_index", "value", "raw", about["yearly"].alias("yearly"))
    total = F.struct("segment_index", "value", "raw")
    made = {}
    # Totals and instalments: by the categories of sentences, and by what clauses' texts suggest.
    for how, is_total, is_part in (("narrow", _has("total_fee"), _has("milestone_fee")), ("broad", about["total"], about["part"])):
        made |= {f"{how}_total": _first(money & is_total, total), f"{how}_parts": F.collect_list(_of(money & is_part, part))}
    period = _is("duration")
    made["reviews"] = F.collect_set(_of(period & _has("acceptance_period"), F.struct("segment_index", "days")))
    made["deemed"] = F.collect_set(_of(period & _has("deemed_acceptance"), F.struct("segment_index", "days")))
    special = _has("acceptance_period", "deemed_acceptance", "security_notice", "retention_period")
    kinds = {"security": period & _has("security_notice"), "contract_term": period & ~special & _has("contract_term"), "notice_period": period & ~special & _has("notice_period")}
    for name, on in kinds.items():
        made |= {f"{name}_n": F.count(_of(on)), f"{name}_lo": F.min(_of(on, "days")), f"{name}_hi": F.max(_of(on, "days")), f"{name}_refs": _refs(on)}
    made["kept"] = F.collect_list(_of(period & _has("retention_period"), F.struct("segment_index", "ord", "days", F.coalesce(about["subject"], F.lit("general")).alias("subject"))))
    alias = F.create_map(*(F.lit(x) for p in ALIAS.items() for x in p))
    place = _is("jurisdiction")
    made |= {"places_n": F.count(_of(place)), "places": F.collect_set(_of(place, F.coalesce(F.try_element_at(alias, F.col("place")), F.col("place")))), "places_refs": _refs(place)}
    for name, on in {"cap": _is("currency", "liability_cap") | _is("percentage", "liability_cap"), "interest": _is("percentage", "interest_rate")}.items():
        made |= {f"{name}_lo": F.min(_of(on, "value")), f"{name}_hi": F.max(_of(on, "value")), f"{name}_refs": _refs(on)}
    date = F.struct("raw", "segment_index")
    made |= {"completed": _first(_is("date", "completion_date"), date), "delivered": _first(_is("date", "delivery_date"), date)}
    made |= {"renewal": F.min(_of(_is("auto_renewal"))), "end": F.min(_of(_is("fixed_end_date")))}
    for subject in SUBJECTS:
        on = _is("ownership") & (F.col("subject") == subject)
        made |= {f"{subject}_lo": F.min(_of(on, "party")), f"{subject}_hi": F.max(_of(on, "party")), f"{subject}_scoped": F.bool_or(_of(on, about["earlier_work"] & ~about[subject])), f"{subject}_refs": _refs(on)}
    first = _is("precedence")
    made |= {"first_lo": F.min(_of(first, "document")), "first_hi": F.max(_of(first, "document")), "first_scoped": F.bool_and(_of(first, F.coalesce(about["scoped"], F.lit(False)))), "first_refs": _refs(first)}
    paid, refund = _is("termination_payment"), F.col("action") == "refund_all"
    made |= {"refund": _first(paid & refund, F.coalesce(about["qualified"], F.lit(False))), "pay": F.bool_or(_of(paid, F.col("action") == "pay_for_services")), "paid_refs": _refs(paid)}
    return made


#: Subjects that two parties may not both own.
SUBJECTS = ("deliverables", "ip")
_FINDINGS = "array<struct<rule: string, severity: string, clause_refs: array<int>, title: string>>"


def _found(rule: str, title: str, when: Column, refs: Column) -> Column:
    """One finding, as an array, where when holds."""
    made = F.struct(F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"), F.array_sort(F.array_distinct(refs)).alias("clause_refs"), F.lit(title).alias("title"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(made)).otherwise(F.array().cast(_FINDINGS)).cast(_FINDINGS)


def _fees(how: str, same, least: int, by_year: bool) -> tuple[Column, Column]:
    """Whether the instalments, without what is the total itself, miss the total; the clauses of both."""
    total = F.col(f"{how}_total")
    parts = F.filter(f"{how}_parts", lambda x: ~same(x, total))
    summed = lambda value: F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + value(x))
    off = F.abs(summed(lambda x: x["value"]) - total["value"]) > CENT
    if by_year:
        off = off & (F.abs(summed(lambda x: x["value"] * x["yearly"]) - total["value"]) > CENT)
    return total.isNotNull() & (F.size(parts) >= least) & off, F.concat(F.transform(parts, lambda x: x["segment_index"]), F.array(total["segment_index"]))


def fee_sum() -> Column:
    """The first total against the sum of instalments, as they stand and by their number a year; where the categories of the
    sentences give no total or no instalment, against what the clauses' texts suggest, from two instalments on."""
    same_fact = lambda x, t: (x["segment_index"] == t["segment_index"]) & (x["value"] == t["value"]) & (x["raw"] == t["raw"])
    narrow, narrow_refs = _fees("narrow", same_fact, 1, True)
    broad, broad_refs = _fees("broad", lambda x, t: x["segment_index"] == t["segment_index"], 2, False)
    settled = F.col("narrow_total").isNotNull() & (F.size("narrow_parts") > 0)
    return _found("FEE_SUM_MISMATCH", "Contract Value vs Milestone Payment Mismatch", F.when(settled, narrow).otherwise(broad), F.when(settled, narrow_refs).otherwise(broad_refs))


def acceptance_window() -> Column:
    """Every pair of a review period and a shorter period until deemed acceptance."""
    pairs = F.flatten(F.transform("reviews", lambda a: F.transform(F.filter("deemed", lambda b: a["days"] > b["days"]), lambda b: F.array(a["segment_index"], b["segment_index"]))))
    title = "Review Period vs Deemed Acceptance Conflict"
    return F.flatten(F.transform(pairs, lambda refs: _found("ACCEPTANCE_WINDOW", title, F.lit(True), refs)))


def notice_conflict() -> Column:
    return _found("NOTICE_CONFLICT", "Conflicting Security Notification Deadlines", (F.col("security_n") >= 2) & (_spread("security_lo", "security_hi") > RATIO), F.col("security_refs"))


def retention_conflict() -> Column:
    """The first pair, in order of facts, of retention periods that differ much and concern one subject or any."""
    kept = F.array_sort("kept")

    def clash(a: Column, b: Column) -> Column:
        place = lambda x: F.struct(x["segment_index"], x["ord"])
        subject = (a["subject"] == b["subject"]) | (a["subject"] == "general") | (b["subject"] == "general")
        return (place(a) < place(b)) & (F.greatest(a["days"], b["days"]) > RATIO * F.least(a["days"], b["days"])) & subject

    pairs = F.transform(kept, lambda a: F.get(F.transform(F.filter(kept, lambda b: clash(a, b)), lambda b: F.array(a["segment_index"], b["segment_index"])), F.lit(0)))
    first = F.get(F.filter(pairs, lambda p: p.isNotNull()), F.lit(0))
    return _found("RETENTION_CONFLICT", "Conflicting Record Retention Periods", first.isNotNull(), first)


def jurisdiction_conflict() -> Column:
    """Two places or more, of which none lies in another that is named."""
    above = F.create_map(*(x for p in PARENT for x in (F.lit(p), F.array(*map(F.lit, ancestors(p))))))
    covered = F.flatten(F.transform("places", lambda p: F.coalesce(F.try_element_at(above, p), F.array().cast("array<string>"))))
    return _found("JURISDICTION_CONFLICT", "Multiple Exclusive Jurisdictions Claimed", (F.col("places_n") >= 2) & (F.size(F.array_except("places", covered)) >= 2), F.col("places_refs"))


def liability_contradiction() -> Column:
    return _found("LIABILITY_CONTRADICTION", "Conflicting Liability Cap Provisions", F.col("cap_lo") < F.col("cap_hi"), F.col("cap_refs"))


def interest_contradiction() -> Column:
    return _found("INTEREST_CONTRADICTION", "Conflicting Interest Rates for Late Payments", F.col("interest_lo") < F.col("interest_hi"), F.col("interest_refs"))


def date_conflict() -> Column:
    """The first completion date against the first delivery date, as written."""
    title = "Project Completion Date vs Final Delivery Date Inconsistency"
    return _found("DATE_CONFLICT", title, F.col("completed.raw") != F.col("delivered.raw"), F.array("completed.segment_index", "delivered.segment_index"))


def renewal_conflict() -> Column:
    return _found("AUTO_RENEWAL_VS_FIXED", "Auto-Renewal Provision Conflicts with Fixed End Date", F.col("renewal").isNotNull() & F.col("end").isNotNull(), F.array("renewal", "end"))


def duration_conflict() -> Column:
    """Terms, and notice periods, that differ much between clauses, without those of a more special kind."""
    one = lambda kind: _found("DURATION_CONFLICT", f"Conflicting {kind.replace('_', ' ')} Durations", (F.size(f"{kind}_refs") >= 2) & (_spread(f"{kind}_lo", f"{kind}_hi") > RATIO), F.col(f"{kind}_refs"))
    return F.concat(one("contract_term"), one("notice_period"))


def ownership_contradiction() -> Column:
    """Two parties own one subject, unless a clause that keeps earlier work does not speak of the subject."""
    one = lambda s: _found("OWNERSHIP_CONTRADICTION", f"Conflicting Ownership of {s.capitalize()}", (F.col(f"{s}_lo") < F.col(f"{s}_hi")) & ~F.col(f"{s}_scoped"), F.col(f"{s}_refs"))
    return F.concat(*map(one, SUBJECTS))


def precedence_conflict() -> Column:
    return _found("PRECEDENCE_CONFLICT", "Conflicting Document Precedence", (F.col("first_lo") < F.col("first_hi")) & ~F.col("first_scoped") & (F.size("first_refs") >= 2), F.col("first_refs"))


def termination_payment() -> Column:
    """A refund of everything against pay for work done, unless the first refund is a qualified one."""
    return _found("TERMINATION_PAYMENT", "Contradictory Termination Payment Provisions", F.col("pay") & ~F.col("refund"), F.col("paid_refs"))


RULES = (
    fee_sum, acceptance_window, notice_conflict, retention_conflict, jurisdiction_conflict, liability_contradiction, date_conflict,
    renewal_conflict, duration_conflict, ownership_contradiction, precedence_conflict, termination_payment, interest_contradiction,
)


def detect(facts: DataFrame, clauses: DataFrame | None = None) -> DataFrame:
    """Findings of all rules, one for each contract, rule and set of clauses (the least title of several).

    facts come from facts.extract_facts with clause_flags; without the column about, clauses (contract_id, segment_index,
    raw_text) are joined to them first."""
    if "about" not in facts.columns:
        side = clauses.select("contract_id", "segment_index", clause_flags(F.col("raw_text")).alias("about"))
        facts = facts.join(side, ["contract_id", "segment_index"], "left")
    facts = facts.withColumn("segment_index", F.col("segment_index").cast("int"))
    per = facts.groupBy("contract_id").agg(*(c.alias(n) for n, c in aggregates().items()))
    every = per.select("contract_id", F.explode(F.array(F.array_sort(F.concat(*(rule() for rule in RULES))))).alias("_all"))
    least = F.filter("_all", lambda x, i: (i == 0) | ~F.coalesce((F.get("_all", i - 1)["rule"] == x["rule"]) & (F.get("_all", i - 1)["clause_refs"] == x["clause_refs"]), F.lit(False)))
    found = every.select("contract_id", F.explode(least).alias("f"))
    return found.select("contract_id", "f.rule", "f.severity", "f.title", "f.clause_refs")
