"""Grouped summaries, time series and pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.scoring import LEVELS, level_of, rank


def effective_level(level: str = "risk_level", score: str = "risk_score") -> Column:
    """low where there is a score of 5 or less, else the level, else low."""
    return F.when(F.col(score) <= 5, "low").otherwise(F.coalesce(level, F.lit("low")))


def risk_summary(clauses: DataFrame, key: str = "contract_id", override: bool = True) -> DataFrame:
    """Counts of levels, of compliance levels, and of clauses to be reviewed, of each contract; without override, plain levels."""
    level = effective_level() if override else F.coalesce("risk_level", F.lit("low"))
    low = F.coalesce(F.col("risk_score") <= 5, F.lit(False)) & F.lit(override)
    compliance = F.when(low, "low").otherwise(F.coalesce("compliance_risk_level", F.lit("low")))
    review = F.coalesce("human_review", F.lit(False)) & ~low
    return clauses.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(level == v).alias(v) for v in LEVELS),
        *(F.count_if(compliance == v).alias(f"compliance_{v}") for v in LEVELS), F.count_if(review).alias("needs_review"),
    )


def risk_by_type(clauses: DataFrame, key: str = "contract_id") -> DataFrame:
    """Clauses, and those of high or critical level, of each type of each contract."""
    kind = F.coalesce("clause_type", F.lit("other")).alias("clause_type")
    return clauses.groupBy(key, kind).agg(F.count(F.lit(1)).alias("count"), F.count_if(effective_level().isin("high", "critical")).alias("high_or_critical"))


def overall_risk(clauses: DataFrame, key: str = "contract_id") -> DataFrame:
    """The gravest level of each contract, null if it has none."""
    return clauses.groupBy(key).agg(level_of(F.max(rank(F.col("risk_level")))).alias("overall_risk"))


def exposure(obligations: DataFrame, key: str, amount: str = "amount", currency: str = "currency", default: str = "INR") -> DataFrame:
    """Sum of amounts of each contract and currency; what is no number counts 0."""
    money = F.coalesce(F.col(amount).try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return obligations.groupBy(key, F.coalesce(currency, F.lit(default)).alias("currency")).agg(F.sum(money).alias("exposure"))


def by_provider(metrics: DataFrame, kind: str, since: Column, how=F.sum, out: str = "value") -> DataFrame:
    """how over the values of one kind of metric from a time on, of each provider."""
    return metrics.filter((F.col("metric_type") == kind) & (F.col("created_at") >= since)).groupBy("provider").agg(how("value").alias(out))


def daily(metrics: DataFrame, kind: str, since: Column, how=F.sum, out: str = "value") -> DataFrame:
    """The same of each day and provider."""
    rows = metrics.filter((F.col("metric_type") == kind) & (F.col("created_at") >= since))
    return rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "provider").agg(how("value").alias(out))


def daily_pivot(tokens: DataFrame, latency: DataFrame, providers: list[str]) -> DataFrame:
    """Two daily series, a column a provider, of all days of either."""
    wide = lambda df, value, mark: df.groupBy("day").pivot("provider", providers).agg(F.first(value)).select("day", *(F.col(p).alias(f"{p}_{mark}") for p in providers))
    return wide(tokens, "tokens", "tokens").join(wide(latency, "latency", "latency"), "day", "full_outer")


def avg_of_avgs(latency: DataFrame) -> DataFrame:
    """Mean of the providers' means, each weighing alike, rounded."""
    return latency.agg(F.floor(F.avg("latency") + 0.5).cast("long").alias("avg_latency"))


def confusion(cases: DataFrame, score: str | None = None) -> DataFrame:
    """Accuracy of type and risk and numbers of over- and under-rated cases (expected_*, actual_*); with score, also
    mean_rewrite_score, the mean of the scores that were given, to two places."""
    high = lambda c: F.col(c).isin("HIGH", "CRITICAL")
    return cases.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("expected_type") == F.col("actual_type")).alias("type_right"),
        F.count_if(F.col("expected_risk") == F.col("actual_risk")).alias("risk_right"),
        F.count_if((F.col("expected_risk") == "LOW") & high("actual_risk")).alias("false_positives"),
        F.count_if(high("expected_risk") & (F.col("actual_risk") == "LOW")).alias("false_negatives"),
        *([F.round(F.avg(score), 2).alias("mean_rewrite_score")] if score else []),
    )


def counts_with_total(rows: DataFrame, key: str, domain: str, order: str) -> DataFrame:
    """Rows of each key, the domain of its first row by order, and in a row of level 1 those of all keys; most rows first.

    One pass: the total is a grouping set beside the keys, so a key that is null is told from the total by its level."""
    per = rows.rollup(key).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.min_by(domain, order).alias("domain"))
    return per.withColumn("domain", F.when(F.col("level") == 0, F.col("domain"))).orderBy(F.desc("level"), F.desc("n"), key)


#: Clauses from which on findings are taken to repeat, and characters of an issue by which they do. Fixed values.
MANY_CLAUSES, ISSUE_HEAD = 15, 60


def dedup_findings(findings: DataFrame, clauses: DataFrame, key: str = "contract_id", kind: str = "type", issue: str = "issue_text", order: str = "finding_no") -> DataFrame:
    """Findings of contracts of more than MANY_CLAUSES clauses without those of a type and issue head that stood before; others as they are."""
    many = clauses.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MANY_CLAUSES).select(F.col(key).alias("_many"))
    rows = findings.join(many, F.col(key) == F.col("_many"), "left")
    same = Window.partitionBy(key, kind, F.substring(issue, 1, ISSUE_HEAD), F.when(F.col("_many").isNull(), F.col(order))).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(same)).filter((F.col("_r") == 1) | F.col("_many").isNull()).drop("_r", "_many")


def sample(df: DataFrame, n: int) -> DataFrame:
    """Any n rows, for a look at a table: as few partitions are read as give them."""
    return df.limit(n)


def merge_symbols(chunks: DataFrame, key: str = "contract_id") -> DataFrame:
    """Definitions (chunk_no, term, definition) of all chunks as one map, the last chunk's winning."""
    last = chunks.groupBy(key, "term").agg(F.max_by("definition", "chunk_no").alias("definition"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "definition")))).alias("symbols"))


def trace(edges: DataFrame, key: str) -> DataFrame:
    """Tokens, edges and whether a breaker tripped, of each run."""
    return edges.groupBy(key).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("edges"), F.bool_or("breaker").alias("breaker"))


def page(df: DataFrame, order: list, number, size) -> DataFrame:
    """One page of an ordered table with total and pages; number from 1, size 1 to 100, 20 unless a whole number."""

    def whole(x, default):
        try:
            return int(x) or default
        except (TypeError, ValueError):
            return default

    number, size = max(1, whole(number, 1)), min(100, max(1, whole(size, 20)))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))


def multi_filter(clauses: DataFrame, risk: str | None = None, kind: str | None = None, compliance: str | None = None, search: str | None = None, columns: tuple[str, ...] = ("raw_text",)) -> DataFrame:
    """Clauses by level, type, compliance level (low unless set) and a text in any of some columns, without case."""
    if risk:
        clauses = clauses.filter(F.col("risk_level") == risk)
    if kind:
        clauses = clauses.filter(F.col("clause_type") == kind)
    if compliance:
        clauses = clauses.filter(F.coalesce("compliance_risk_level", F.lit("low")) == compliance)
    if search:
        clauses = clauses.filter(F.exists(F.array(*columns), lambda c: F.contains(F.lower(c), F.lit(search.lower()))))
    return clauses


def dashboard(contracts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals with risk histogram, counts by category, uploads by day) of a list of contracts."""
    totals = contracts.agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("total_clauses").alias("clauses"),
        *(F.count_if(F.coalesce("overall_risk", F.lit("low")) == v).alias(v) for v in LEVELS),
    )
    return totals, contracts.groupBy("category").count(), contracts.groupBy(F.to_date("uploaded_at").alias("day")).count()


def dedup_first(df: DataFrame, key: list[Column], order: list) -> DataFrame:
    """The first row of each key."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    w = Window.partitionBy(*(f"_k{i}" for i in range(len(key)))).orderBy(*order)
    return df.select("*", *named).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", *(f"_k{i}" for i in range(len(key))))


def redline(clauses: DataFrame, only_risky: bool = True, key: str = "contract_id", index: str = "segment_index") -> DataFrame:
    """What an export holds, in order: risky clauses with a rewrite, or all, each as its old text struck and its new one put in."""
    changed = F.coalesce(F.col("risk_level").isin("medium", "high", "critical") & (F.length("rewritten_text") > 0), F.lit(False))
    rows = clauses.filter(changed) if only_risky else clauses
    text = F.when(changed, F.concat(F.lit("[-"), "raw_text", F.lit("-] {+"), "rewritten_text", F.lit("+}"))).otherwise(F.col("raw_text"))
    return rows.select(key, index, text.alias("line")).orderBy(key, index)


def with_latest(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """left with the latest row of right, as a struct latest, null where there is none."""
    last = right.groupBy(key).agg(F.max_by(F.struct(*(c for c in right.columns if c != key)), order).alias("latest"))
    return left.join(last, key, "left")


def with_parent(contracts: DataFrame, key: str, parent: str, columns: list[str]) -> DataFrame:
    """contracts with the columns of their parent where their own are null."""
    up = contracts.select(F.col(key).alias("_p"), *(F.col(c).alias(f"_p_{c}") for c in columns))
    rows = contracts.join(up, F.col(parent) == F.col("_p"), "left").drop("_p")
    return rows.withColumns({c: F.coalesce(c, f"_p_{c}") for c in columns}).drop(*(f"_p_{c}" for c in columns))


def agreement(clauses: DataFrame, key: str = "contract_id") -> DataFrame:
    """Clauses that a second model saw, and those it agreed on."""
    return clauses.groupBy(key).agg(F.count_if("tier2_escalated").alias("escalated"), F.count_if(F.col("tier2_escalated") & F.col("tier2_agrees")).alias("agreed"))
