"""Rule lexicons as data: which rules a text satisfies.

A lexicon is a table of phrases: rule_id, ord (the order in which rules are reported), trap_type, severity, group_no, phrase,
negated, is_regex. A rule holds when every group without negation has a phrase in the lower-cased text, and no phrase of a
negated group is in it. "A or (B and C)" is written as two groups, (A or B) and (A or C).
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "rule_id int, ord int, trap_type string, severity string, group_no int, phrase string, negated boolean, is_regex boolean"


class Pattern(str):
    """A phrase that is a regular expression."""


def table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """A lexicon from (trap_type, severity, groups) and, if there are any, groups of phrases that must not be in a text."""
    return spark.createDataFrame(rows_of(rules), SCHEMA)


def rows_of(rules: list[tuple]) -> list[tuple]:
    """The rows of a lexicon."""
    rows = []
    for k, (kind, severity, groups, *without) in enumerate(rules, 1):
        signed = [(g, False) for g in groups] + [(g, True) for w in without for g in w]
        rows += [(k, k, kind, severity, no, str(p), negated, isinstance(p, Pattern)) for no, (g, negated) in enumerate(signed, 1) for p in g]
    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon from CSV with the columns of SCHEMA in a header."""
    return spark.read.schema(SCHEMA).option("header", True).csv(path)


HIT = "array<struct<rule_id: int, ord: int, trap_type: string, severity: string>>"
#: Rules of a lexicon, which is a rule book: each becomes an expression of the plan.
MOST_RULES = 5000


def hits(text: Column | str, rules: DataFrame, least: int = 50) -> Column:
    """The rules that a text satisfies, as an array of HIT; shorter texts satisfy none.

    The lexicon comes to the driver, with a check of its length; each rule becomes one expression over the text, so that texts
    are read once and are never multiplied by phrases. Beyond MOST_RULES rules apply the lexicon in parts and join the arrays."""
    text = F.col(text) if isinstance(text, str) else text
    low = F.lower(text)
    key = lambda r: (r["ord"], r["rule_id"], r["trap_type"], r["severity"])
    book = rules.limit(MOST_RULES * 100).collect()
    if len(book) >= MOST_RULES * 100 or len({r["rule_id"] for r in book}) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules in one lexicon")
    found = []
    for rule, rows in groupby(sorted(book, key=lambda r: (*key(r), r["group_no"])), key):
        groups: dict[int, list[Column]] = {}
        for r in rows:
            said = low.rlike(r["phrase"]) if r["is_regex"] else F.contains(low, F.lit(r["phrase"].lower()))
            groups.setdefault(r["group_no"] * (-1 if r["negated"] else 1), []).append(said)
        holds = [reduce(Column.__or__, g) if no >= 0 else ~reduce(Column.__or__, g) for no, g in groups.items()]
        made = F.struct(F.lit(rule[1]).alias("rule_id"), F.lit(rule[0]).alias("ord"), F.lit(rule[2]).alias("trap_type"), F.lit(rule[3]).alias("severity"))
        found.append(F.when((F.length(text) >= least) & reduce(Column.__and__, holds), made))
    return F.array_compact(F.array(*found)).cast(HIT) if found else F.array().cast(HIT)


def match(df: DataFrame, text_col: str, rules: DataFrame, least: int = 50) -> DataFrame:
    """A row a text and rule it satisfies: the columns of df, rule_id, ord, trap_type, severity."""
    return df.select("*", F.explode(hits(text_col, rules, least)).alias("_hit")).select("*", "_hit.*").drop("_hit")


def classify(text: Column, cascade: list[tuple[str, str]], default: str = "other") -> Column:
    """The class of the first pattern of an ordered list that a text has."""
    return reduce(lambda rest, case: F.when(F.lower(text).rlike(case[1]), case[0]).otherwise(rest), reversed(cascade), F.lit(default))


#: Clause classes by words that a text contains, in order: the offline stand-in for a model. Fixed values.
CLAUSE_CASCADE = [
    ("non_compete", "compete|competing|non-compete"),
    ("non_solicitation", "solicit"),
    ("intellectual_property", "intellectual|invention|patent|copyright|trademark|work product|conceive"),
    ("confidentiality", "confidential|disclosure|proprietary"),
    ("dispute_resolution", "arbitrat|dispute|resolution|court|litigat"),
    ("privacy_data", "data|privacy|personal info"),
    ("termination", "terminate|expiration|breach"),
    ("indemnification", "indemnify|indemnification|hold harmless"),
    ("force_majeure", "force majeure|pandemic|strike|act of god"),
    ("compensation", "payment|fee|compensation|salary|defer|withhold"),
    ("amendment", "amend|modify"),
]

#: One-sided provisions: trap type, severity, groups of phrases, of each of which one must be in the text, and groups of which
#: none may be. "A or (B and C)" stands as (A or B) and (A or C). Fixed values.
DEFAULT_TRAPS = [
    ("predatory force majeure", "critical", [["force majeure", "pandemic", "act of god"], ["obligation", "deliver"], ["suspended", "not liable"], ["remains", "absolute", "unmodified"]]),
    ("predatory intellectual property capture", "critical", [["intellectual property", "inventions", "rights, title"], ["assigns", "assignment", "belongs to the company"], ["prior to", "before the commencement", "outside of company time", "at any time"]]),
    ("one-sided indemnification", "critical", [["indemnify", "indemnification"], ["gross negligence", "willful misconduct"]], [["indemnifying party's", "each party agrees to indemnify"]]),
    ("wage forfeiture", "critical", [["withhold", "forfeit", "deduct"], ["compensation", "salary", "paycheck", "bonus", "commissions"], ["permanently", "forfeited", "reserve", "not entitled to payment"]]),
    ("post-employment non-compete", "critical", [["upon separation", "post-employment", "after termination", "after separation", "following termination", "leaves the company", "leaving the company"], ["non-compete", "barred from working", "not work for", "not engage", "restricted from", "shall not compete"]]),
    ("irrevocable power of attorney over personal accounts", "critical", [["power of attorney"], ["social media", "personal account"]]),
    ("overreaching intellectual property grab", "critical", [["future business ideas", "unrelated to the project", "children", "spouse"], ["owns", "property"]]),
    ("silent network data harvesting and sale", "critical", [["harvest", "sell"], ["metadata", "network"]]),
    ("anti-audit threat of criminal prosecution", "critical", [["audit"], ["criminal prosecution", "breach"]]),
    ("predatory sla downtime exemption", "critical", [["downtime"], ["exempt", "economic event"]]),
    ("unreasonable infrastructure cost shift", "critical", [["electricity", "cooling", "data center"], ["subscriber", "responsible"]]),
    ("post-hire technology prohibition", "critical", [["invented after", "technology"], ["invented after", "prohibited"]]),
    ("retroactive trade execution price alteration", "critical", [["retroactively change", "execution price"], ["retroactively change", "trade"]]),
    ("predatory account inactivity fund forfeiture", "critical", [["waives the right", "funds", "fail to log in"], ["7 consecutive days"]]),
    ("remote hardware deactivation", "critical", [["deactivate"]]),
    ("hardware defect liability shift", "critical", [["indemnify"], ["physical harm", "manufacturing defects"]]),
    ("termination without payment", "high", [["terminate", "termination"], ["at any time", "for any reason", "for no reason", "for convenience"], ["not be entitled to payment", "not entitled to payment", "shall not be paid", "without payment for"]]),
    ("unilateral contract variation", "critical", [["unilaterally modify", "unilaterally alter", "absolute right to modify", "reserve the right to modify"], ["salary", "benefits", "compensation"], ["at any time", "with or without notice", "without prior notice"]]),
    ("illegal harassment arbitration", "critical", [["sexual harassment", "posh", "discrimination"], ["subject exclusively to", "binding arbitration", "private arbitration"]]),
    ("punitive training bond", "critical", [["training", "incur substantial costs", "resigns within"], ["fixed penalty", "liquidated damages", "pay a penalty"], ["regardless of the actual", "irrespective of", "without proof of actual"]]),
    ("unpaid indefinite suspension", "critical", [["unpaid disciplinary suspension", "suspended without pay"], ["indefinite duration", "sole discretion", "pending any"]]),
    ("foreign jurisdiction trap", "high", [["delaware", "new york", "singapore"], ["exclusive jurisdiction", "courts located in", "governed by the laws"]]),
    ("broad non-solicit restraint", "critical", [["not directly or indirectly solicit", "accept business from"], ["anywhere in the world", "any client, customer, or prospect"]]),
    ("indefinite probation trap", "high", [["probation"], ["extend indefinitely", Pattern("probation[^.]{0,120}indefinite"), Pattern("indefinite[^.]{0,40}probation")]]),
    ("unconscionable surveillance", "critical", [["monitor, record, and store", "surveillance", "track"], ["personal devices", "biometric", "fingerprint", "facial recognition", "digital personal data protection", "dpdp"], ["waives all rights", "absolute right to monitor", "completely waives"]]),
    ("excessive liquidated damages penalty", "critical", [["penalty", "liquidated damages"], ["irrespective of the actual damages", "regardless of actual loss", "irrespective of actual loss"], ["trivial", "any breach", "minor breach"]]),
    ("moral rights waiver", "critical", [["waive all moral rights", "waive moral rights", "waives any and all moral rights", "derogatory modification", "section 57", "relinquish moral rights"]]),
    ("predatory evergreen auto-renewal", "critical", [["automatically renew", "auto-renew"], ["365 days", "12 months in advance", "successive periods of 5 years", "successive 5-year terms"]]),
    ("retroactive amendment", "critical", [["amend", "modify", "alter", "bound by"], ["retroactively"]]),
    ("biased arbitration seat", "high", [["arbitral tribunal", "arbitrator", "arbitration"], ["senior executives", "directors of the company", "solely appointed by the company"]]),
    ("obfuscated wage deduction", "critical", [["reallocate", "withhold", "deduct", "escrow account"], ["100%", "entirety of"], ["remuneration", "salary", "wages"]]),
    ("wage forfeiture on termination", "critical", [["forfeit", "relinquish"], ["payment for work completed", "accrued wages", "earned salary"]]),
    ("hostile jurisdiction", "critical", [["cayman islands", "delaware", "laws of england", "singapore", "new york"], ["exclusively governed by", "exclusive jurisdiction", "solely governed by"]]),
    ("ghost equity clawback", "critical", [["claw back", "cancel, revoke", "forfeit"], ["vested", "stock options", "equity"], ["sole", "absolute discretion", "unchallengeable"]]),
    ("biometric dpdp waiver", "critical", [["polygraph", "retina", "keylogging", "biometric"], ["dpdp", "digital personal data protection", "waives any and all rights"]]),
    ("gag order equity forfeiture", "critical", [["disparaging", "non-disparagement", "negative remarks"], ["forfeit", "claw back"], ["vested equity", "unpaid bonuses", "stock"]]),
]
