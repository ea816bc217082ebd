"""Risk and confidence folds over clause rows. Every step is a set of column expressions; stage order is the caller's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import grams
from ledgerloom.operators import blocks
from ledgerloom.session import shared_path

#: Levels in rising order of severity. Fixed values.
LEVELS = ("low", "medium", "high", "critical")


def rank(level: Column) -> Column:
    """Place of a level in LEVELS, from 1; null of an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)).cast("int")


def level_of(place: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, LEVELS)), place)


def js_int(raw: Column, default: int = 5) -> Column:
    """An integer, with default for what is none and for 0."""
    return F.coalesce(F.nullif(F.floor(raw.try_cast("double")).cast("int"), F.lit(0)), F.lit(default))


def clamp_score(raw: Column) -> Column:
    """A whole score from 0 to 10, 5 for what is no number."""
    value = raw.try_cast("double")
    return F.coalesce(F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(0), F.least(F.lit(10), F.floor(value + 0.5)))), F.lit(5)).cast("int")


def base_scores(df: DataFrame) -> DataFrame:
    """risk_level and risk_score from a judge's (judge_level, judge_score) or the analyst's own, made valid."""
    level = F.coalesce("judge_level", "risk_level")
    return df.withColumns({"risk_score": clamp_score(F.coalesce("judge_score", "risk_score")), "risk_level": F.when(level.isin(*LEVELS), level).otherwise("medium")})


def align(df: DataFrame) -> DataFrame:
    """Level and score brought in step: a level raises the score to its floor, then the score raises the level."""
    score = F.when(F.col("risk_level") == "critical", F.greatest("risk_score", F.lit(8))).when(F.col("risk_level") == "high", F.greatest("risk_score", F.lit(6))).otherwise(F.col("risk_score"))
    level = F.when(score >= 8, "critical").when((score >= 6) & ~F.col("risk_level").isin("critical", "high"), "high").otherwise(F.col("risk_level"))
    return df.withColumns({"risk_score": score, "risk_level": level})


#: Provisions that are in order as they stand: (pattern, greatest score). General rules of this library's own choice, not
#: surveyed values: those were fitted to evaluation cases.
SAFE_HARBOURS = (
    (r"(?i)^\s*(?:recitals?|whereas)\b", 1),
    (r"(?i)\bmediation\b", 3),
    (r"(?i)\bmutual(?:ly)?\s+indemnif|each\s+party\s+shall\s+indemnify", 4),
    (r"(?i)\bstandby\b", 4),
    (r"(?i)non-solicit[^.]{0,60}employees", 4),
)


def safe_harbours(df: DataFrame, text_col: str = "raw_text", harbours=SAFE_HARBOURS) -> DataFrame:
    """Scores capped by the first safe harbour that a text is in; the level follows where the cap bites."""
    cap = reduce(lambda rest, h: F.when(F.col(text_col).rlike(h[0]), h[1]).otherwise(rest), reversed(harbours), F.lit(None).cast("int"))
    bites = cap.isNotNull() & (F.col("risk_score") > cap)
    return df.withColumns({"risk_level": F.when(bites, F.when(cap <= 3, "low").otherwise("medium")).otherwise(F.col("risk_level")), "risk_score": F.when(bites, cap).otherwise(F.col("risk_score"))})


def add_reason(reasons: Column, reason: Column, first: bool = False) -> Column:
    """A reason put in front of or behind the others, unless it is null or there already."""
    have = F.coalesce(reasons, F.array().cast("array<string>"))
    new = F.concat(F.array(reason), have) if first else F.concat(have, F.array(reason))
    return F.when(reason.isNull() | F.array_contains(have, reason), have).otherwise(new)


def escalate_hits(clauses: DataFrame, hits: Column) -> DataFrame:
    """Scores raised by lexicon hits, an array of the row itself: to 9 by a critical one, to 8 by a high one, if that is more;
    with the worst, then first, in front of the reasons. A map over rows."""
    worst = F.array_min(F.transform(hits, lambda h: F.struct((-rank(h["severity"])).alias("r"), h["ord"].alias("o"), h["trap_type"].alias("t"))))
    rows = clauses.withColumn("_worst", worst)
    target = F.when(F.col("_worst.r") <= -4, 9).when(F.col("_worst.r") == -3, 8)
    up = F.coalesce(target > js_int(F.col("risk_score")), F.lit(False))
    return rows.withColumns({
        "risk_reasons": F.when(up, add_reason(F.col("risk_reasons"), F.concat(F.lit("Matches the pattern of "), F.col("_worst.t")), True)).otherwise(F.col("risk_reasons")),
        "risk_level": F.when(up, "critical").otherwise(F.col("risk_level")),
        "risk_score": F.when(up, target).otherwise(F.col("risk_score")),
    }).drop("_worst")


def escalate(clauses: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """The same with hits as rows of their own."""
    listed = hits.groupBy(*key).agg(F.collect_list(F.struct("ord", "trap_type", "severity")).alias("_hits"))
    return escalate_hits(clauses.join(listed, key, "left"), F.col("_hits")).drop("_hits")


#: Length from which a text is held against trap vectors. Fixed value.
LEAST_TEXT = 50


def vector_traps(clauses: DataFrame, traps: DataFrame, key: str, vec_col: str = "embedding", text_col: str = "raw_text", hi: float = 0.88, lo: float = 0.75, answers: DataFrame | None = None) -> DataFrame:
    """Clauses raised by the trap vector nearest to theirs, as the last layer of the trap scan: those below critical, of LEAST_TEXT
    characters and with a vector.

    traps: trap_id, trap_type, severity, vec. A cosine of hi or more is a hit; between lo and hi the clause counts as asked
    (ask_model) and answers (key, trap_type, severity, reasoning), which a model gave for such clauses, decide. A critical
    trap gives level critical and score 9, another one high and 8, with a reason in front, whatever the score was. key is
    distinct. Clauses are read once and not shuffled by their vectors; only found traps are joined back."""
    open_ = clauses.filter((F.col("risk_level").isNull() | (F.col("risk_level") != "critical")) & (F.length(text_col) >= LEAST_TEXT) & F.col(vec_col).isNotNull())
    near = blocks.best(open_.select(F.col(key).alias("_key"), F.col(vec_col).alias("_vec")), traps, "_key", "_vec", "trap_id", "vec").filter(F.col("score") >= lo)
    named = traps.select("trap_id", F.col("trap_type").alias("_type"), F.col("severity").alias("_severity"))
    hits = near.join(named, "trap_id").withColumn("_why", F.when(F.col("score") >= hi, F.concat(F.lit("cosine "), F.format_number("score", 3))))
    if answers is not None:
        said = answers.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct("trap_type", "severity", "reasoning")).alias("_a"))
        hits = hits.join(said, (F.col("_key") == F.col("_k")) & F.col("_why").isNull(), "left").withColumns({
            "_type": F.coalesce("_a.trap_type", "_type"), "_severity": F.coalesce("_a.severity", "_severity"), "_why": F.coalesce("_a.reasoning", "_why"),
        })
    hits = hits.select("_key", "_type", "_severity", "_why", F.col("_why").isNull().alias("_ask"))
    up = F.col("_why").isNotNull()
    worst = F.col("_severity") == "critical"
    reason = F.concat(F.lit("Hidden trap: "), F.col("_type"), F.lit(" ("), F.col("_why"), F.lit(")"))
    return (
        clauses.join(hits, F.col(key) == F.col("_key"), "left")
        .withColumns({
            "risk_reasons": F.when(up, add_reason(F.col("risk_reasons"), reason, True)).otherwise(F.col("risk_reasons")),
            "risk_level": F.when(up, F.when(worst, "critical").otherwise("high")).otherwise(F.col("risk_level")),
            "risk_score": F.when(up, F.when(worst, 9).otherwise(8)).otherwise(F.col("risk_score")),
            "ask_model": F.coalesce("_ask", F.lit(False)),
        })
        .drop("_key", "_type", "_severity", "_why", "_ask")
    )


#: Kinds of overreach by a defined term: words of the term, words of its definition, score and level it raises a clause to,
#: what it does. In order; the last kind met gives the level. Fixed values.
OVERREACH = (
    ("work product|invention|intellectual property", "unrelated|children|spouse|past employer|family", 9, "critical", "takes in what family members or unrelated projects make"),
    ("loss|indemnity|damage", "consequential|indirect|unlimited|attorney fees", 8, "high", "takes in indirect and consequential damages"),
    ("restricted period|term", "perpetual|indefinite|5 years|10 years", 8, "high", "runs on without an end"),
)
#: Openings of an agreement, which no term raises: words it contains; a title if the text is shorter than 250. Fixed values.
PREAMBLE = r"this master services agreement|this agreement is entered into"
TITLE = "master services agreement"


def defined_terms(clauses: DataFrame, terms: DataFrame, key: list[str]) -> DataFrame:
    """Clauses (contract_id, ..., raw_text) that use a defined term (contract_id, term, definition) of overreaching definition.

    The score rises to the greatest of all kinds met; the level is that of the last one, terms in order of their names."""
    text = F.lower("raw_text")
    opening = text.rlike(PREAMBLE) | (text.startswith(TITLE) & (F.length("raw_text") < 250))
    used = clauses.filter(~opening).join(terms.filter(F.length("term") >= 3), "contract_id").filter(F.contains(F.lower("raw_text"), F.lower("term")))
    kinds = [F.when(F.lower("term").rlike(t) & F.lower("definition").rlike(d), F.struct(F.col("term"), F.lit(k).alias("kind"), F.lit(score).alias("score"), F.lit(level).alias("level"), F.lit(what).alias("what"))) for k, (t, d, score, level, what) in enumerate(OVERREACH)]
    far = used.select(*key, F.explode(F.array_compact(F.array(*kinds))).alias("w"))
    warned = far.groupBy(*key).agg(F.array_sort(F.collect_set("w")).alias("_met"))
    reasons = F.transform("_met", lambda w: F.concat(F.lit("Defined term "), w["term"], F.lit(" "), w["what"]))
    up = F.col("_met").isNotNull()
    return (
        clauses.join(warned, key, "left")
        .withColumns({
            "risk_level": F.when(up, F.element_at("_met", -1)["level"]).otherwise(F.col("risk_level")),
            "risk_reasons": F.when(up, F.concat(reasons, F.coalesce("risk_reasons", F.array().cast("array<string>")))).otherwise(F.col("risk_reasons")),
            "risk_score": F.when(up, F.greatest("risk_score", F.array_max(F.transform("_met", lambda w: w["score"])))).otherwise(F.col("risk_score")),
        })
        .drop("_met")
    )


#: Score, and nothing else, that a finding of each severity raises a clause to. Fixed values.
FINDING_SCORE = {"critical": 10, "high": 8, "medium": 6}


def apply_findings(clauses: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings carried to the clauses they name: greatest severity, raised score, reasons, full confidence, compliance only up."""
    named = findings.select("contract_id", F.explode("clause_refs").alias("segment_index"), "severity", "title")
    per = named.groupBy("contract_id", "segment_index").agg(F.max(rank(F.col("severity"))).alias("_r"), F.array_sort(F.collect_set("title")).alias("_titles"))
    to = F.element_at(F.create_map(*(F.lit(x) for p in FINDING_SCORE.items() for x in p)), level_of(F.col("_r")))
    hit = F.col("_r").isNotNull()
    return (
        clauses.join(per, ["contract_id", "segment_index"], "left")
        .withColumns({
            "risk_level": F.when(hit, level_of(F.greatest(F.col("_r"), rank(F.col("risk_level"))))).otherwise(F.col("risk_level")),
            "risk_score": F.when(hit, F.greatest(F.coalesce("risk_score", F.lit(0)), to)).otherwise(F.col("risk_score")),
            "risk_reasons": F.when(hit, F.array_distinct(F.concat(F.coalesce("risk_reasons", F.array().cast("array<string>")), "_titles"))).otherwise(F.col("risk_reasons")),
            "confidence_score": F.when(hit, 10).otherwise(F.col("confidence_score")),
            "compliance_risk_level": F.when(hit, level_of(F.greatest(F.col("_r"), rank(F.col("compliance_risk_level"))))).otherwise(F.col("compliance_risk_level")),
        })
        .drop("_r", "_titles")
    )


def apply_overrides(clauses: DataFrame, contracts: DataFrame, rules: DataFrame) -> DataFrame:
    """Jurisdiction rules (ord, place, overrides array of clause types, reason): the first rule whose place stands as a word in
    the contract's address and that names the clause's type makes the clause critical."""
    at = contracts.join(rules, F.regexp_like("address", F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])"), F.col("place"), F.lit(r"(?![A-Za-z0-9_])"))))
    typed = at.select("contract_id", F.explode("overrides").alias("clause_type"), "ord", "reason")
    first = typed.groupBy("contract_id", "clause_type").agg(F.min_by("reason", "ord").alias("_reason"))
    hit = F.col("_reason").isNotNull()
    fresh = hit & ~F.coalesce(F.col("risk_level") == "critical", F.lit(False))
    return (
        clauses.join(first, ["contract_id", "clause_type"], "left")
        .withColumns({
            "risk_reasons": F.when(fresh, add_reason(F.col("risk_reasons"), F.col("_reason"), True)).otherwise(F.col("risk_reasons")),
            "risk_score": F.when(hit, 9).otherwise(F.col("risk_score")),
            "risk_level": F.when(hit, "critical").otherwise(F.col("risk_level")),
        })
        .drop("_reason")
    )


def citation_penalty(df: DataFrame, statuses: str = "statuses") -> DataFrame:
    """Clauses with a citation that was not found or misquoted: high at least, 8 at least, to be reviewed, with a reason."""
    bad = F.coalesce(F.exists(statuses, lambda s: s.isin("not_found", "misquoted")), F.lit(False))
    return df.withColumns({
        "risk_level": F.when(bad, level_of(F.greatest(F.lit(3), rank(F.col("risk_level"))))).otherwise(F.col("risk_level")),
        "risk_score": F.when(bad, F.greatest(F.lit(8), F.coalesce("risk_score", F.lit(0)))).otherwise(F.col("risk_score")),
        "compliance_risk_level": F.when(bad, level_of(F.greatest(F.lit(3), rank(F.col("compliance_risk_level"))))).otherwise(F.col("compliance_risk_level")),
        "human_review": bad | F.coalesce("human_review", F.lit(False)),
        "risk_reasons": F.when(bad, add_reason(F.col("risk_reasons"), F.lit("A citation could not be confirmed"))).otherwise(F.col("risk_reasons")),
    })


def needs_escalation(level: Column, score: Column, confidence: Column) -> Column:
    """Whether a second model should look at a clause."""
    return F.coalesce((js_int(score) >= 7) | (js_int(confidence) <= 4) | level.isin("high", "critical"), F.lit(False))


def confidence(df: DataFrame) -> DataFrame:
    """overall_confidence (0 to 100, one decimal) and its level: a weighted mean over what applies to the clause.

    Reads confidence_score, tier2_escalated, tier2_agrees, n_refs, citation_accuracy, cross_ref_high (null: not audited)."""
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    cites = (F.coalesce("n_refs", F.lit(0)) > 0) | yes(c("citation_accuracy") != 0)
    parts = [
        (c("confidence_score").isNotNull(), 20, c("confidence_score") * 10),
        (F.lit(True), 25, F.when(yes(c("tier2_escalated")) & ~yes(c("tier2_agrees")), 50).otherwise(100)),
        (cites, 25, F.coalesce("citation_accuracy", F.lit(0))),
        (cites, 15, F.when(F.coalesce("n_refs", F.lit(0)) > 0, 85).otherwise(30)),
        (c("cross_ref_high").isNotNull(), 15, F.when(c("cross_ref_high") > 0, 50).otherwise(100)),
    ]
    earned = reduce(Column.__add__, (F.when(on, F.lit(w) * v).otherwise(0) for on, w, v in parts))
    weight = reduce(Column.__add__, (F.when(on, w).otherwise(0) for on, w, _ in parts))
    score = F.round(earned / weight, 1)
    return df.withColumns({"overall_confidence": score, "overall_confidence_level": F.when(score >= 80, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW")})


def check_literal(kind: Column, values: Column, target: Column, tolerance: float = 0.01) -> Column:
    """Whether stated amounts obey a stated relation: sum_equals, product_equals, at_most, above; null of an unknown one."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    product = F.aggregate(values, F.lit(1.0), lambda a, v: a * v)
    return (
        F.when(kind == "sum_equals", F.abs(total - target) <= tolerance)
        .when(kind == "product_equals", F.abs(product - target) <= tolerance)
        .when(kind == "at_most", F.array_max(values) <= target)
        .when(kind == "above", F.array_min(values) > target)
    )


#: Words of a stated relation, and what it is checked as, in order. Fixed values.
RELATIONS = (("sum_equals", "sum|math|add"), ("product_equals", "multiply|multiplier"), ("at_most", "timeline|less|conflict"), ("above", "greater"))


def relation_of(raw: Column) -> Column:
    """The relation that a model's word for it means; the word itself, in small letters, if it is none of RELATIONS."""
    low = F.lower(F.trim(raw))
    return reduce(lambda rest, r: F.when(low.rlike(r[1]), r[0]).otherwise(rest), reversed(RELATIONS), low)


def clean_number(raw: Column) -> Column:
    """An amount out of a text: digits, points and signs of it, times a thousand or a million if below 1000 and a k or m is
    written; 0 for what then is no number."""
    low = F.lower(raw)
    value = F.when(F.regexp_replace(low, "[^0-9.-]+", "").rlike(r"^-?(\d+\.?\d*|\.\d+)$"), F.regexp_replace(low, "[^0-9.-]+", "").try_cast("double"))
    value = F.when(F.contains(low, F.lit("k")) & (value < 1000), value * 1000).otherwise(value)
    return F.coalesce(F.when(F.contains(low, F.lit("m")) & (value < 1000), value * 1_000_000).otherwise(value), F.lit(0.0))


#: Characters of a title by which a later finding counts as an earlier one. Fixed value.
TITLE_HEAD = 20


def unsuppressed(findings: DataFrame, group: str, order: list[str], title: str = "title", sure: str | None = None) -> DataFrame:
    """Findings without those that repeat an earlier kept one of their group, in order: the head of either title is in the other.

    Findings for which the column sure holds come first and are kept in any case, as those of fixed rules are. A finding
    that is dropped drops no other. Equal titles of a group are one, of the first place. Titles meet where one's head occurs
    in another, found by runs of letters of the heads' lengths, so that a group is dealt over all tasks. Rounds settle them:
    one that meets an earlier kept title is dropped, one that meets no earlier open title is kept. The first open title of
    every group is settled in each round, and tables of the shared store hold what is open."""
    spark = findings.sparkSession
    path = shared_path(spark, "suppression")
    first = ~F.coalesce(F.col(sure), F.lit(False)) if sure else F.lit(True)
    rows = findings.withColumn("_first", first)
    titles = rows.groupBy(F.col(group).alias("_g"), F.lower(F.coalesce(title, F.lit(""))).alias("_t")).agg(F.min(F.struct("_first", *order)).alias("_o"))
    titles = titles.select("_g", "_t", F.struct("_o", "_t").alias("_at"), F.substring("_t", 1, TITLE_HEAD).alias("_own"))
    sizes = titles.agg(F.collect_set(F.length("_own")).alias("_sizes"))
    heads = titles.select(F.col("_g").alias("_hg"), F.col("_own").alias("_head")).distinct().hint("merge")
    runs = titles.join(F.broadcast(sizes)).select("_g", "_at", "_own", F.explode(grams(F.col("_t"), F.col("_sizes"))).alias("_h"))
    places = runs.join(heads, F.col("_g").eqNullSafe(F.col("_hg")) & (F.col("_h") == F.col("_head"))).drop("_hg", "_head")
    places.withColumns({"_kept": ~F.col("_at._o._first"), "_new": F.lit(False)}).write.parquet(f"{path}/0")
    table = spark.read.parquet(f"{path}/0")
    made = []
    while table.filter("NOT _kept").take(1):
        own = F.col("_h") == F.col("_own")
        least = lambda c: F.min(F.when(c, F.col("_at")))
        met = table.groupBy(F.col("_g").alias("_mg"), F.col("_h").alias("_mh")).agg(
            least(F.col("_kept")).alias("_ka"), least(F.col("_kept") & own).alias("_kh"), least(~F.col("_kept")).alias("_oa"), least(~F.col("_kept") & own).alias("_oh")
        )
        before = lambda any_, head: F.coalesce(F.col(head) < F.col("_at"), F.lit(False)) | (own & F.coalesce(F.col(any_) < F.col("_at"), F.lit(False)))
        seen = table.join(met, F.col("_g").eqNullSafe(F.col("_mg")) & (F.col("_h") == F.col("_mh")))
        all_ = Window.partitionBy("_g", "_at")
        seen = seen.withColumns({"_drop": F.bool_or(before("_ka", "_kh")).over(all_) & ~F.col("_kept"), "_wait": F.bool_or(before("_oa", "_oh")).over(all_)})
        # A kept title stays where an open one has met it.
        left = seen.filter(~F.col("_drop") & (~F.col("_kept") | F.col("_oa").isNotNull())).withColumn("_new", ~F.col("_kept") & ~F.col("_wait"))
        left.withColumn("_kept", F.col("_kept") | F.col("_new")).select(*table.columns).write.parquet(f"{path}/{len(made) + 1}")
        table = spark.read.parquet(f"{path}/{len(made) + 1}")
        made.append(table.filter("_new AND _h = _own").select("_g", F.col("_at._o").alias("_k")))
    sure_ones = rows.filter("NOT _first")
    if not made:
        return sure_ones.drop("_first")
    same = [F.col(c).eqNullSafe(F.col(f"_k.{c}")) for c in order]
    found = rows.filter("_first").join(reduce(DataFrame.unionByName, made), reduce(Column.__and__, same, F.col(group).eqNullSafe(F.col("_g"))), "left_semi")
    return sure_ones.unionByName(found).drop("_first")


def compliance_level(status: Column, level: Column) -> Column:
    """The level of a compliance verdict, never below the one there is."""
    return level_of(F.greatest(rank(level), rank(F.when(status == "compliant", "low").otherwise("high"))))


def drop_boilerplate_refs(df: DataFrame) -> DataFrame:
    """References dropped from clauses of low risk that no warning is attached to."""
    plain = ((F.col("risk_level") == "low") | (F.col("risk_score") <= 2)) & ~F.coalesce("has_warning", F.lit(False))
    return df.withColumn("refs", F.when(F.coalesce(plain, F.lit(False)), F.array().cast(df.schema["refs"].dataType)).otherwise(F.col("refs")))
