"""Typed facts from clauses: amounts, durations, percentages, dates, references, places, ownership and the like.

A clause is cut into sentences, every extractor turns a sentence into an array of facts of one struct type, and the arrays
are concatenated and exploded: one narrow pass, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import WORD_NUMBERS, duration_days, duration_unit, sentences, word_number

FACT = "struct<type:string,value:double,unit:string,days:double,place:string,party:string,action:string,subject:string,document:string,ref_type:string,ref_target:string,raw:string>"
FIELDS = ("type", "value", "unit", "days", "place", "party", "action", "subject", "document", "ref_type", "ref_target", "raw")

#: What a sentence is about: category and patterns, any of which makes it so. Fixed values.
CATEGORIES = {
    "total_fee": r"total\s+(?:contract\s+)?(?:value|fee|price|amount|consideration)|(?:aggregate|fixed)\s+(?:fee|price|value|consideration)|contract\s+(?:value|price)|(?:annual|yearly|total)\s+(?:subscription\s+)?fee",
    "milestone_fee": r"milestone|(?:phase|stage|tranche)\s+\d|payment\s+schedule|installment|(?:monthly|quarterly|bi-weekly|weekly)\s+(?:installment|payment)",
    "acceptance_period": r"acceptance\s+(?:period|window|deadline)|(?:review|testing|inspection)\s+period|(?:review|test|inspect)\s+(?:the\s+)?deliverable|(?:review|test)\s+(?:and\s+(?:review|test)\s+)?(?:all\s+)?deliverable|(?:review|test|inspect|validate)\s+.*?deliverable",
    "deemed_acceptance": r"deemed\s+(?:accepted|acceptance)|automatically\s+(?:accepted|deemed)|(?:shall\s+be\s+)?deemed\s+to\s+(?:have\s+been\s+)?accept",
    "notice_period": r"(?:notice|notification)\s+(?:period|deadline|window)|(?:within|no\s+later\s+than)\s+.*?(?:notify|report|inform)|(?:notify|report|inform)\s+.*?(?:within|no\s+later)",
    "security_notice": r"(?:security|breach|incident)\s+(?:notification|notice|report)|(?:notify|report)\s+.*?(?:security|breach|incident)|security\s+(?:breach|incident)|(?:security|breach).*?(?:within|no\s+later)",
    "retention_period": r"(?:record|data)\s+retention|(?:retain|maintain|preserve)\s+.*?(?:records|data|documents|confidentiality|confidential\s+information)|retention\s+period|records?\s+for\s+(?:a\s+)?(?:minimum\s+)?(?:period|duration)|(?:confidential|confidentiality)\s+.*?(?:period|years?|months?)|(?:records?|data|documents?|logs?)\s+(?:shall\s+be\s+|must\s+be\s+|are\s+)?(?:retained|maintained|preserved|kept)|(?:retained|maintained|preserved|kept)\s+for\s+(?:a\s+)?(?:minimum\s+)?(?:period|duration)?\s*(?:of\s+)?\d",
    "liability_cap": r"(?:aggregate|total|cumulative)\s+liability|liability\s+(?:shall\s+)?(?:not\s+)?exceed|(?:cap|limit|ceiling)\s+(?:on\s+)?(?:liability|damages)",
    "termination": r"(?:upon|after|following)\s+termination|terminat(?:e|ion)\s+(?:for\s+)?(?:convenience|cause)",
    "refund": r"refund\s+(?:all|entire|full)|(?:return|repay)\s+(?:all\s+)?(?:fees|payments|amounts)",
    "payment_on_term": r"(?:pay|compensate)\s+.*?(?:services?\s+(?:performed|rendered|completed))|(?:payment|compensation)\s+for\s+(?:work|services)",
    "contract_term": r"(?:initial|contract)\s+term|term\s+of\s+(?:this\s+)?agreement|(?:duration|period)\s+of\s+(?:this\s+)?(?:agreement|contract)",
    "auto_renewal": r"auto(?:matically)?[- ]?renew|(?:successive|additional)\s+(?:period|term)|(?:renew|extend)\s+(?:automatically|for\s+(?:successive|additional))",
    "jurisdiction": r"(?:exclusive\s+)?jurisdiction|governed?\s+by\s+(?:the\s+)?laws?\s+of|courts?\s+(?:of|located\s+in|sitting\s+in)",
    "interest_rate": r"interest\s+(?:rate|charge|payment|accru)|(?:late\s+payments?|default|penalty)\s+interest|interest\s+at\s+(?:the\s+)?(?:rate\s+(?:of\s+)?)?\d|accru\w*\s+interest|(?:interest|penalty)\s+rate\b|\brate\s+of\s+\d+(?:\.\d+)?\s*%|\binterest\b.*?\bat\b.*?\d+(?:\.\d+)?\s*%",
    "completion_date": r"(?:project|work)\s+completion\s+(?:date|deadline)|complet(?:e|ion)\s+(?:by|on|before|no\s+later)",
    "delivery_date": r"(?:final\s+)?deliver(?:y|able)\s+(?:date|deadline)|deliver(?:y|ables?)\s+(?:by|on|before|no\s+later)",
    "precedence": r"(?:shall\s+)?(?:prevail|take\s+precedence|supersede|control)|conflict",
}
#: Places that a clause about jurisdiction may name. Fixed values.
PLACES = (
    "new york", "california", "delaware", "texas", "illinois", "florida", "massachusetts", "washington", "singapore", "london", "england",
    "mumbai", "delhi", "bangalore", "bengaluru", "chennai", "kolkata", "hyderabad", "port blair", "india", "united states", "united kingdom",
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
UNITS = r"calendar\s+days?|business\s+days?|working\s+days?|days?|hours?|weeks?|months?|years?"
CLIENT = "(?:client|customer|buyer|company|employer|licensee)"
VENDOR = "(?:vendor|provider|supplier|contractor|employee|licensor)"
#: Ways of saying that a party owns something: (action, pattern with the party left open). Fixed values.
OWNERSHIP = (
    ("owns", r"{party}\s+(?:shall\s+)?(?:own|retain|have)\s+(?:all\s+)?(?:right|title|ownership|interest)"),
    ("assigned_to", r"(?:assign|transfer|convey)\s+(?:all\s+)?(?:right|title|ownership|interest)\s+(?:to|in)\s+(?:the\s+)?{party}"),
    ("assigned_to", r"(?:assigned|belong|vest)\s+.*?(?:owned|exclusively)\s+.*?{party}"),
    ("owns", r"{party}\s+retain"),
    ("owns", r"(?:property|owned)\s+(?:of|by)\s+(?:the\s+)?{party}"),
)
SCOPED = r"pre-existing|underlying|background\s+ip|prior\s+work|personal\s+time|personal\s+resources|outside\s+(?:of\s+)?(?:working|business)\s+hours"
DOCUMENT = r"schedule\s+[a-z]|(?:this\s+)?(?:agreement|contract)|exhibit\s+[a-z]|appendix\s+[a-z]|(?:this\s+)?sow|(?:this\s+)?statement\s+of\s+work|(?:the\s+)?master\s+service\s+agreement|(?:the\s+)?msa"


def fact(**given: Column) -> Column:
    """A fact struct; what is not given is null."""
    kinds = dict(f.split(":") for f in FACT[len("struct<") : -1].split(","))
    return F.struct(*(given.get(f, F.lit(None)).cast(kinds[f]).alias(f) for f in FIELDS))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _each(matches: Column, make) -> Column:
    return F.transform(matches, make)


def _only(found: Column, keep) -> Column:
    return F.filter(found, keep)


def _amount(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(raw, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "").try_cast("double")


def _if(condition: Column, made: Column) -> Column:
    return F.when(condition, F.array(made)).otherwise(F.array().cast(f"array<{FACT}>"))


_USD = r"(?i)(?:US\$\s*|USD\s*|\$)[0-9]{1,3}(?:,?[0-9]{3})*(?:\.[0-9]{1,2})?"
_INR = r"(?i)(?:INR\s*|₹\s*)[0-9]{1,3}(?:,?[0-9]{2,3})*(?:,?[0-9]{3})(?:\.[0-9]{1,2})?"
_SHORT = r"(?i)(?:\$|USD\s*|INR\s*|₹\s*)?[0-9]+(?:\.[0-9]+)?\s*[kmb]\b"
_BARE = r"\b[0-9]{1,3},(?:[0-9]{2,3},)*[0-9]{3}(?:\.[0-9]{1,2})?\b"


def currency(text: Column, clause: Column) -> Column:
    """Amounts: with a dollar or rupee sign, with k, m or b (also counted when they carry a sign), and in a clause about rupees
    bare numbers in groups that do not begin within 30 characters after one of the others."""
    usd = _each(_all(text, _USD), lambda r: fact(type=F.lit("currency"), value=_amount(r), unit=F.lit("USD"), raw=r))
    inr = _each(_all(text, _INR), lambda r: fact(type=F.lit("currency"), value=_amount(r), unit=F.lit("INR"), raw=r))
    scale = lambda r: F.element_at(F.create_map(*map(F.lit, ("k", 1e3, "m", 1e6, "b", 1e9))), F.lower(F.right(r, F.lit(1))))
    unit = lambda r: F.when(r.rlike("(?i)inr|₹"), "INR").otherwise("USD")
    short = _each(_all(text, _SHORT), lambda r: fact(type=F.lit("currency"), value=_amount(r) * scale(r), unit=unit(r), raw=r))
    # What begins within 30 characters of an amount is masked, so that matching needs no positions.
    masked = F.regexp_replace(text, rf"(?s)(?={_USD}|{_INR}|{_SHORT}).{{1,30}}[0-9,.]*", " ")
    bare = _each(_all(masked, _BARE), lambda r: fact(type=F.lit("currency"), value=_amount(r), unit=F.lit("INR"), raw=r))
    rupees = F.when(clause.rlike("(?i)INR|₹|rupee|lakh|crore"), _only(bare, lambda f: f["value"] >= 1000)).otherwise(F.array().cast(f"array<{FACT}>"))
    return F.concat(_only(F.concat(usd, inr, short), lambda f: f["value"] > 0), rupees)


def durations(text: Column) -> Column:
    """Digits with a unit, then number words with a unit."""

    def made(r: Column, value: Column) -> Column:
        unit = duration_unit(F.regexp_extract(r, rf"(?i)({UNITS})\z", 1))
        return fact(type=F.lit("duration"), value=value, unit=unit, days=duration_days(value, unit), raw=r)

    words = "|".join(WORD_NUMBERS)
    digits = _each(_all(text, rf"(?i)\d+\s*(?:{UNITS})\b"), lambda r: made(r, F.regexp_extract(r, r"^\d+", 0).try_cast("double")))
    spelled = _each(_all(text, rf"(?i)(?:{words})(?:[- ](?:{words}))*\s+(?:{UNITS})"), lambda r: made(r, word_number(F.regexp_replace(r, rf"(?i)\s*(?:{UNITS})\z", ""))))
    return F.concat(digits, _only(spelled, lambda f: f["value"] > 0))


def percentages(text: Column) -> Column:
    return _each(_all(text, r"\d+(?:\.\d+)?\s*%"), lambda r: fact(type=F.lit("percentage"), value=F.regexp_extract(r, r"^[\d.]+", 0).try_cast("double"), raw=r))


def dates(text: Column) -> Column:
    patterns = (rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b", rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS}),?\s+\d{{4}}\b", r"\b\d{4}-\d{2}-\d{2}\b")
    return _each(F.concat(*(_all(text, p) for p in patterns)), lambda r: fact(type=F.lit("date"), raw=r))


def cross_refs(text: Column) -> Column:
    found = _all(text, r"(?i)\b(?:Section|Clause|Article|Schedule|Exhibit|Appendix|Annex)\s+[A-Z0-9][A-Z0-9.()]*\b")
    return _each(found, lambda r: fact(type=F.lit("cross_ref"), ref_type=F.lower(F.regexp_extract(r, r"^\w+", 0)), ref_target=F.regexp_extract(r, r"\s(\S+)\z", 1), raw=r))


def jurisdictions(text: Column) -> Column:
    """Places named in a sentence about jurisdiction, as parts of words too."""
    named = F.filter(F.array(*map(F.lit, PLACES)), lambda p: F.contains(F.lower(text), p))
    about = text.rlike(r"(?i)jurisdiction|governed?\s+by|courts?\s+(?:of|located|sitting)|exclusive")
    return F.when(about, _each(named, lambda p: fact(type=F.lit("jurisdiction"), place=p, raw=p))).otherwise(F.array().cast(f"array<{FACT}>"))


def ownership(text: Column) -> Column:
    scoped = text.rlike(f"(?i){SCOPED}")
    negated = text.rlike(r"(?i)(?:not|excluding|other\s+than)\s+deliverables?")
    subject = (
        F.when(scoped, "general")
        .when(text.rlike("(?i)deliverable") & ~negated, "deliverables")
        .when(text.rlike(r"(?i)intellectual\s+property"), "ip")
        .when(text.rlike(r"(?i)invention|work\s+product|customization|derivative\s+work"), "deliverables")
        .otherwise("general")
    )
    said = []
    for action, pattern in OWNERSHIP:
        for party, who in (("client", CLIENT), ("vendor", VENDOR)):
            made = fact(type=F.lit("ownership"), party=F.lit(party), action=F.lit(action), subject=subject, raw=F.substring(text, 1, 120))
            said.append(_if(text.rlike("(?i)" + pattern.format(party=who)), made))
    return F.concat(*said)


def provisions(text: Column) -> Column:
    """Precedence of documents, payment on termination, automatic renewal and fixed end."""
    head = F.substring(text, 1, 120)
    verb = r"\s+(?:shall\s+)?(?:prevail|take\s+precedence|supersede|control|override)\b"
    first = _each(_all(text, rf"(?i)\b(?:{DOCUMENT}){verb}"), lambda r: fact(type=F.lit("precedence"), document=F.lower(F.trim(F.regexp_replace(r, f"(?i){verb}", ""))), raw=r))
    refund = text.rlike(r"(?i)refund\s+(?:all|entire|full|100%)") & text.rlike("(?i)fee|payment|amount")
    pay = text.rlike(r"(?i)(?:pay|compensate|reimburse)\s+.*?(?:services?\s+(?:performed|rendered|completed)|work\s+(?:performed|completed|done))")
    fixed = text.rlike(r"(?i)(?:expire|terminate|end)\s+(?:on|in|after|during|at|within)\s+") | text.rlike(r"(?i)(?:fixed|definite)\s+(?:end|expiry|termination)\s+date")
    return F.concat(
        first,
        _if(refund, fact(type=F.lit("termination_payment"), action=F.lit("refund_all"), raw=head)),
        _if(pay, fact(type=F.lit("termination_payment"), action=F.lit("pay_for_services"), raw=head)),
        _if(text.rlike(r"(?i)auto(?:matically)?[- ]?renew"), fact(type=F.lit("auto_renewal"), raw=head)),
        _if(fixed, fact(type=F.lit("fixed_end_date"), raw=head)),
    )


def categories(text: Column) -> Column:
    """All categories of a text, in their order, or uncategorized."""
    found = F.filter(F.array(*(F.when(text.rlike(f"(?i){p}"), c) for c, p in CATEGORIES.items())), lambda c: c.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("uncategorized")))


def extract_facts(clauses: DataFrame, about: Column | None = None) -> DataFrame:
    """Clauses (contract_id, segment_index, raw_text) to facts: contract_id, segment_index, ord, the fact's fields, categories.

    ord counts facts of a clause: by sentence, extractor and match. A sentence of no category has those of its clause. about
    is a column over a clause that goes with each of its facts, under that name."""
    more = ["about"] if about is not None else []
    clauses = clauses.withColumn("about", about) if more else clauses
    rows = clauses.select("contract_id", "segment_index", "raw_text", *more, categories(F.col("raw_text")).alias("_of_clause"), F.posexplode(sentences(F.col("raw_text"))).alias("_s", "_text"))
    rows = rows.filter(F.length(F.trim("_text")) > 0)
    t = F.col("_text")
    extractors = [currency(t, F.col("raw_text")), durations(t), percentages(t), dates(t), cross_refs(t), jurisdictions(t), ownership(t), provisions(t)]
    own = categories(t)
    rows = rows.withColumn("categories", F.when(own == F.array(F.lit("uncategorized")), F.col("_of_clause")).otherwise(own))
    rows = rows.select("contract_id", "segment_index", *more, "categories", "_s", F.posexplode(reduce(F.concat, extractors)).alias("_k", "f"))
    return rows.select("contract_id", "segment_index", (F.col("_s") * 10_000 + F.col("_k")).alias("ord"), "f.*", "categories", *more)
