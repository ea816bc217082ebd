"""Queries of lookups between tables: parents, latest rows, element matches, exports, gates, digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.digest import changed, hmac_sha256
from ledgerloom.operators import retrieval, summaries
from ledgerloom.plans.registry import pick, pick_sql, query
from ledgerloom.session import table


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'")
def contract_clauses(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    return orders.join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


@query("""SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS order_key FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def latest_job(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    found = summaries.with_latest(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", "at")
    return found.select("c_custkey", F.col("latest.o_orderkey").alias("order_key"))


@query("""WITH c AS (SELECT c_custkey, c_custkey // 2 AS parent, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer)
SELECT a.c_custkey, coalesce(a.segment, b.segment) AS segment FROM c a LEFT JOIN c b ON a.parent = b.c_custkey""")
def parent_context(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 2).alias("parent"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    return summaries.with_parent(rows, "c_custkey", "parent", ["segment"]).select("c_custkey", "segment")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 48 AND l_returnflag = 'N'")
def element_match(spark, sf):
    """Orders with one line that meets both conditions, lines being an array of structs."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("lines"))
    return rows.filter(F.exists("lines", lambda x: (x["l_quantity"] > 48) & (x["l_returnflag"] == "N"))).select("l_orderkey")


@query("SELECT doc_id, lang, left(text, 60) AS head FROM documents QUALIFY row_number() OVER (PARTITION BY lang, left(text, 60) ORDER BY doc_id) = 1")
def dedup_by_prefix(spark, sf):
    docs = table(spark, sf, "documents")
    head = F.substring("text", 1, 60)
    return summaries.dedup_first(docs, [F.col("lang"), head], ["doc_id"]).select("doc_id", "lang", head.alias("head"))


@query("""SELECT item_id, 'k' || (item_id % 5) AS act_key, CASE item_id % 5 WHEN 0 THEN 'Act zero' ELSE 'Act one' END AS act_name, CASE item_id % 5 WHEN 0 THEN 90 ELSE 85 END AS score FROM benchmark WHERE item_id % 5 IN (0, 1)""")
def act_references(spark, sf):
    """Keys looked up in a reference table, unknown ones dropped, defaults filled in."""
    config = spark.createDataFrame([("k0", "Act zero", 90), ("k1", "Act one", None)], "act_key string, act_name string, score int")
    rows = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("k"), (F.col("item_id") % 5).cast("string")).alias("act_key"))
    return rows.join(config, "act_key").select("item_id", "act_key", "act_name", F.coalesce("score", F.lit(85)).alias("score"))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS escalated, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS agreed FROM lineitem GROUP BY 1")
def tier2_agreement(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity") > 25).alias("tier2_escalated"), (F.col("l_discount") > 0.05).alias("tier2_agrees"))
    return summaries.agreement(rows, "l_orderkey")


@query("""SELECT conv_id, turn, '[-' || role || '-] {+' || upper(role) || '+}' AS line FROM conversations WHERE turn % 3 = 1""")
def redline_export(spark, sf):
    level = F.when(F.col("turn") % 3 == 1, "high").otherwise("low")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("raw_text"), F.upper("role").alias("rewritten_text"), level.alias("risk_level"))
    return summaries.redline(rows, True, "conv_id", "turn")


@query("SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END, TIMESTAMP '2024-08-01') < TIMESTAMP '1996-01-01' OR o_orderstatus <> 'F'")
def asof_cutoff(spark, sf):
    executed = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp"))
    keep = retrieval.asof_cutoff(executed, F.col("o_orderstatus") == "F", "1996-01-01", F.lit("2024-08-01").cast("timestamp"))
    return table(spark, sf, "orders").filter(keep).select("o_orderkey")


_GATES = [
    ("Contract Act", "Section 27", "Employee shall not compete.", True, True),
    ("Contract Act", "Section 27 (Chunk 2)", "Rent is due.", False, True),
    ("Contract Act", "Section 127", "Rent is due.", True, True),
    ("Banking Act", "Section 3", "Whereas the parties borrow money", True, False),
    ("Banking Act", "Section 3", "The goods are blue.", False, True),
]


@query(f"SELECT c_custkey, {pick_sql('c_custkey', [g[3] for g in _GATES], 'BOOLEAN')} AS fits, {pick_sql('c_custkey', [g[4] for g in _GATES], 'BOOLEAN')} AS asked FROM customer")
def retrieval_gates(spark, sf):
    """Hits and clauses dealt over the customers, whose names stand in them."""
    act, section, text = (pick(F.col("c_custkey"), [g[k] for g in _GATES]) for k in range(3))
    act, text = F.concat("c_mktsegment", F.lit(" "), act), F.concat(text, F.lit(" "), "c_name")
    return table(spark, sf, "customer").select("c_custkey", retrieval.plausible(act, section, text).alias("fits"), retrieval.worth_asking(text).alias("asked"))


_SECRET = "secret" * 20
#: The key's two pads: a key longer than a block is its digest.
_PADS = [bytes(x ^ p for x in hashlib.sha256(_SECRET.encode()).digest().ljust(64, b"\0")).hex() for p in (0x5C, 0x36)]


@query(f"SELECT conv_id, turn, sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode(text)))) AS signature FROM conversations")
def webhook_signature(spark, sf):
    """Every turn signed."""
    return table(spark, sf, "conversations").select("conv_id", "turn", hmac_sha256(F.col("text"), _SECRET).alias("signature"))


@query("SELECT page_id, page_id % 3 <> 0 AS changed FROM pages")
def amended_pages(spark, sf):
    known = F.when(F.col("page_id") % 3 == 0, F.sha2("html", 256)).when(F.col("page_id") % 3 == 1, F.sha2("url", 256))
    return table(spark, sf, "pages").select("page_id", changed(F.col("html"), known).alias("changed"))


@query("SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-(l_quantity - 35 + 7.5))) >= 0.65 AS kept FROM lineitem")
def rerank_threshold(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", retrieval.reranked(F.col("l_quantity") - 35).alias("kept"))


@query("SELECT role, count(*) AS n, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def request_tokens(spark, sf):
    """Estimated tokens of what would be sent, four characters a token."""
    return table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))


@query(r"SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9\s_-]', '', 'g') AS identifier FROM pages")
def sanitised_identifiers(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.identifier(F.col("url")).alias("identifier"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) <= 20000 OR regexp_matches(left(text, 20000), '(?i)governing law') THEN left(text, 20000)
ELSE left(text, 20000) || chr(10) || '...' || chr(10) || right(text, 5000) END) AS ends FROM documents""")
def text_ends(spark, sf):
    """Digests of what a first look at a whole document reads: its beginning, and its end where the beginning lacks a governing law."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.ends_of(F.col("text"))).alias("ends"))


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_returnflag AS provider, avg(l_quantity) AS latency FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' GROUP BY 1, 2")
def daily_latency(spark, sf):
    """The daily mean of each provider."""
    rows = table(spark, sf, "lineitem").select(F.lit("latency").alias("metric_type"), F.col("l_shipdate").alias("created_at"), F.col("l_returnflag").alias("provider"), F.col("l_quantity").alias("value"))
    return summaries.daily(rows, "latency", F.lit("1995-01-01").cast("timestamp"), F.avg, "latency")
