"""Nearest neighbours among vectors, with filters before and after, and what hangs on the hits.

Searches without a condition on pairs go through blocks. Of others the queries are the small side: they are broadcast where a count shows that they fit MAX_BROADCAST rows, and
otherwise go round in bands of a hash of their key, so that a band meets every corpus partition in a shuffle. Top k is taken
in two steps, within partitions of the corpus and then over all, so that no query's candidates gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import grams
from ledgerloom.functions.vectors import dot, norm
from ledgerloom.operators import blocks

MAX_BROADCAST = 10_000
CORPUS_BANDS = 64


def _top(scored: DataFrame, query_id: str, corpus_id: str, k: int) -> DataFrame:
    """The k best rows a query by score, then corpus id, with rank from 1."""
    order = [F.col("score").desc(), F.col(corpus_id)]
    part = scored.withColumn("_band", F.pmod(F.xxhash64(corpus_id), F.lit(CORPUS_BANDS)))
    near = part.withColumn("_r", F.row_number().over(Window.partitionBy(query_id, "_band").orderBy(*order))).filter(F.col("_r") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).filter(F.col("rank") <= k).drop("_r", "_band")


def scores(queries: DataFrame, corpus: DataFrame, q_vec: str, c_vec: str, on: Column | None = None) -> DataFrame:
    """Every pair that on allows, with its cosine as score; NaN and pairs of different lengths are left out.

    Column names of the two sides must differ."""
    q = queries.withColumn("_qn", norm(F.col(q_vec)))
    c = corpus.withColumn("_cn", norm(F.col(c_vec)))
    allow = (F.size(q_vec) == F.size(c_vec)) if on is None else (F.size(q_vec) == F.size(c_vec)) & on
    if q.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        pairs = c.join(F.broadcast(q), allow)
    else:
        bands = 16
        q = q.withColumn("_b", F.pmod(F.xxhash64(q_vec), F.lit(bands)))
        c = c.withColumn("_b2", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
        pairs = c.join(q, (F.col("_b") == F.col("_b2")) & allow).drop("_b", "_b2")
    size = F.col("_qn") * F.col("_cn")
    return pairs.withColumn("score", F.when(size > 0, dot(F.col(q_vec), F.col(c_vec)) / size).otherwise(0.0)).filter(~F.isnan("score")).drop("_qn", "_cn")


def knn(queries: DataFrame, corpus: DataFrame, q_id: str, q_vec: str, c_id: str, c_vec: str, k: int = 3, min_score: float | None = None, fetch: int = 10, on: Column | None = None) -> DataFrame:
    """The fetch nearest rows a query, of these the ones that reach min_score, of these the first k: q_id, c_id, score, rank.

    Without a condition on pairs cosines are matrix products of blocks; with one (on) the two sides are joined, and their
    columns stay."""
    most = max(fetch, k)
    found = blocks.nearest(queries, corpus, q_id, q_vec, c_id, c_vec, most) if on is None else scores(queries, corpus, q_vec, c_vec, on)
    near = _top(found, q_id, c_id, most)
    if min_score is not None:
        near = near.filter(F.col("score") >= min_score)
    return near.filter(F.col("rank") <= k) if min_score is None else near.withColumn("rank", F.row_number().over(Window.partitionBy(q_id).orderBy("rank"))).filter(F.col("rank") <= k)


def knn_filtered(queries: DataFrame, corpus: DataFrame, q_id: str, q_vec: str, c_id: str, c_vec: str, pre: Column | None, post: Column, fetch: int = 20, k: int = 5, min_score: float = 0.7, keep: Column | None = None, keys: tuple[str, str] | None = None) -> DataFrame:
    """pre narrows the candidates, the fetch nearest are taken, post is asked of these, the first k stay, of which those that
    reach min_score and keep are returned with a tag. The order of the steps is the meaning.

    Where the candidates are those whose key is in an array of the query's, keys names the two columns in place of pre: the
    cosines are then products of blocks, and of other columns only the ids are there for post and keep."""
    found = scores(queries, corpus, q_vec, c_vec, pre) if keys is None else blocks.nearest(queries, corpus, q_id, q_vec, c_id, c_vec, fetch, keys)
    near = _top(found, q_id, c_id, fetch).filter(F.coalesce(post, F.lit(False)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy(q_id).orderBy("rank"))).filter(F.col("rank") <= k)
    near = near.filter(F.col("score") >= min_score) if keep is None else near.filter((F.col("score") >= min_score) & keep)
    return near.withColumn("confidence", F.when(F.col("score") >= 0.8, "High").otherwise("Medium"))


def siblings(clauses: DataFrame, group: str, c_id: str, vec: str, k: int = 3) -> DataFrame:
    """For each clause the k nearest of its own group, itself taken out afterwards, so k - 1 of them as a rule. Groups of any size
    are compared block by block."""
    pairs = blocks.within_groups(clauses, group, c_id, vec, k).withColumnRenamed("other_id", "sibling_id")
    return _top(pairs, "query_id", "sibling_id", k).filter("query_id <> sibling_id")


def zone_route(queries: DataFrame, traps: DataFrame, q_id: str, q_vec: str, t_id: str, t_vec: str, hi: float = 0.88, lo: float = 0.75, on: Column | None = None, keys: tuple[str, str] | None = None, apart: bool = False) -> DataFrame:
    """The nearest trap of each query, of those that on allows, and what follows: hit, ask (a model) or none.

    keys (an array column of the queries, a column of the traps) and apart (no trap of the query's own id) are conditions that
    products of blocks keep; any other (on) joins the two sides pair by pair."""
    if on is None and (keys or apart):
        found = blocks.nearest(queries, traps, q_id, q_vec, t_id, t_vec, 1, keys, apart)
        best = found.groupBy(q_id).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(t_id).alias("t"))).alias("b"))
        return best.select(q_id, F.col("b.t").alias(t_id), (-F.col("b.s")).alias("score"), zone(-F.col("b.s"), hi, lo).alias("zone"))
    if on is None:
        found = blocks.best(queries, traps, q_id, q_vec, t_id, t_vec)
        return found.select(q_id, t_id, "score", zone(F.col("score"), hi, lo).alias("zone"))
    best = scores(queries, traps, q_vec, t_vec, on).groupBy(q_id).agg(F.max(F.struct("score", (-F.col(t_id)).alias("t"))).alias("b"))
    return best.select(q_id, (-F.col("b.t")).alias(t_id), F.col("b.score").alias("score"), zone(F.col("b.score"), hi, lo).alias("zone"))


def zone(score: Column, hi: float = 0.88, lo: float = 0.75) -> Column:
    """What follows from the cosine with the nearest trap."""
    return F.when(score >= hi, "hit").when(score >= lo, "ask").otherwise("none")


def route_domains(clauses: DataFrame, domain_map: DataFrame, fallback: DataFrame, default: str = "general_contract_law") -> DataFrame:
    """domains of each clause: by (contract_type, clause_type), else by clause_type, else the default; labour law only in employment.
    Keys are compared without case; both maps are small dimensions."""
    low = F.lower
    m = domain_map.select(low("contract_type").alias("_ct"), low("clause_type").alias("_k"), F.col("target_domains").alias("_a"))
    f = fallback.select(low("clause_type").alias("_k2"), F.col("target_domains").alias("_b"))
    rows = clauses.join(m, (low("contract_type") == F.col("_ct")) & (low("clause_type") == F.col("_k")), "left").join(f, low("clause_type") == F.col("_k2"), "left")
    found = F.coalesce("_a", "_b", F.array(F.lit(default)))
    kept = F.when(low("contract_type") == "employment", found).otherwise(F.filter(found, lambda d: d != "labor_law"))
    return rows.withColumn("domains", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))).drop("_ct", "_k", "_a", "_k2", "_b")


def expand_one_hop(hits: DataFrame, edges: DataFrame, hit_id: str, first: int = 2) -> DataFrame:
    """hits with the targets of EXCEPTS and DEFINED_BY edges and the sources of STARE_DECISIS edges of the first ranks."""
    near = hits.filter(F.col("rank") <= first).select(F.col(hit_id).alias("_h")).distinct()
    out = edges.filter(F.col("rel").isin("EXCEPTS", "DEFINED_BY")).join(near, F.col("src") == F.col("_h")).groupBy("_h").agg(F.array_sort(F.collect_set(F.struct("rel", F.col("dst").alias("id")))).alias("dependencies"))
    into = edges.filter(F.col("rel") == "STARE_DECISIS").join(near, F.col("dst") == F.col("_h")).groupBy("_h").agg(F.array_sort(F.collect_set("src")).alias("precedents"))
    on = lambda df: (F.col(hit_id) == df["_h"]) & (F.col("rank") <= first)
    return hits.join(out, on(out), "left").drop("_h").join(into, on(into), "left").drop("_h")


#: Most letters of a part of a name that names are found by.
GRAM = 16


def edges_from_triples(triples: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges (src, dst, rel) from (src, rel, hint), the target being the vertex of least id whose name holds the hint, once each.

    Equal names are one, of their least id. A hint of up to GRAM letters is looked up whole among the names' runs of as many
    letters, of which only the least id stays, so that no name meets many hints or the other way round. A longer one is looked
    up by its run of GRAM letters that fewest names have, and then found in the name or not. Letters are compared without
    case; an empty or null hint has no target.

    What is exploded is larger than the plan takes it for, so those joins are to be shuffled rather than broadcast."""
    low = F.lower("hint")
    hints = triples.filter(F.length("hint") > 0).select(low.alias("_low")).distinct()
    names = vertices.filter(F.col("name").isNotNull()).groupBy(F.lower("name").alias("_name")).agg(F.min("id").alias("_id"))
    # One row, of at most GRAM sizes.
    sizes = hints.agg(F.coalesce(F.collect_set(F.least(F.length("_low"), F.lit(GRAM))), F.array().cast("array<int>")).alias("_sizes"))
    short, long = hints.filter(F.length("_low") <= GRAM), hints.filter(F.length("_low") > GRAM)
    index = names.join(F.broadcast(sizes)).select("_id", F.explode(grams(F.col("_name"), F.col("_sizes"))).alias("_low")).groupBy("_low").agg(F.min("_id").alias("dst"))
    found = short.join(index.hint("merge"), "_low").select("_low", "dst")
    one = F.array(F.lit(GRAM))
    runs = names.select("_id", "_name", F.explode(grams(F.col("_name"), one)).alias("_gram"))
    asked = long.select("_low", F.explode(grams(F.col("_low"), one)).alias("_gram"))
    common = runs.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(common.hint("merge"), "_gram", "left").groupBy("_low").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_r"))
    held = rarest.filter("_r.n > 0").select("_low", F.col("_r.g").alias("_gram")).join(runs.hint("merge"), "_gram").filter(F.contains("_name", "_low"))
    target = found.unionByName(held.groupBy("_low").agg(F.min("_id").alias("dst")))
    return triples.withColumn("_low", low).join(target.hint("merge"), "_low").select("src", "dst", "rel").distinct()


def chat_context(queries: DataFrame, clauses: DataFrame, q_id: str, q_vec: str, group: str, k: int = 5, first: int = 20) -> DataFrame:
    """What a question about a contract is answered from: its k nearest clauses, or, where none has a vector, its first ones.

    The first clauses of a contract are found once and not for each question; a question carries at most k or first of them."""
    asked = queries.select(q_id, q_vec, group, F.array(group).alias("_keys"))
    near = _top(blocks.nearest(asked, clauses, q_id, q_vec, "segment_index", "embedding", k, ("_keys", group)), q_id, "segment_index", k)
    near = near.groupBy(F.col(q_id).alias("_q")).agg(F.array_sort(F.collect_list(F.struct("rank", "segment_index"))).alias("_near"))
    row = Window.partitionBy(group).orderBy("segment_index")
    firsts = clauses.select(group, "segment_index").withColumn("rank", F.row_number().over(row)).filter(F.col("rank") <= first)
    firsts = firsts.groupBy(F.col(group).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("rank", "segment_index"))).alias("_first"))
    rows = queries.select(q_id, group).join(near, F.col(q_id) == F.col("_q"), "left").join(firsts, F.col(group) == F.col("_g"), "left")
    rows = rows.select(q_id, F.explode(F.coalesce("_near", "_first")).alias("_c"), F.when(F.col("_near").isNull(), "order").otherwise("vector").alias("how"))
    return rows.select(q_id, "_c.segment_index", "_c.rank", "how")


def asof_cutoff(executed: Column, repealed: Column, cutoff: str, now: Column) -> Column:
    """Whether a statute counts: contracts executed from the cutoff on (or at an unknown time, from now) leave repealed ones out;
    an unknown state is not repealed."""
    return (F.coalesce(executed, now) < F.lit(cutoff).cast("timestamp")) | ~F.coalesce(repealed, F.lit(False))


def worth_asking(text: Column) -> Column:
    """Whether a clause is worth a search: not a preamble, signature block or recital."""
    return ~F.lower(text).rlike(r"^\s*(?:this agreement is (?:made|entered)|whereas|in witness whereof|signed (?:by|for))")


def plausible(act: Column, section: Column, text: Column) -> Column:
    """Whether a hit fits the clause: acts on banking and finance need such words in the text, a section on restraint of trade needs
    words of restraint. Sections are compared by their number."""
    money = F.lower(act).rlike(r"bank|securiti[sz]ation|negotiable instruments")
    about_money = F.lower(text).rlike(r"loan|bank|credit|cheque|security interest|borrow")
    restraint = (F.regexp_extract(section, r"(\d+[A-Z]?)", 1) == "27") & F.contains(F.lower(act), F.lit("contract act"))
    about_restraint = F.lower(text).rlike(r"compet|solicit|restrain|exclusiv")
    return (~money | about_money) & (~restraint | about_restraint)


def reranked(logit: Column, shift: float = 7.5, least: float = 0.65) -> Column:
    """Whether a reranker's logit, as a probability, reaches a threshold."""
    return 1 / (1 + F.exp(-(logit + shift))) >= least
