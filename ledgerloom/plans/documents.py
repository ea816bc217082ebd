"""Queries over documents, pages and conversations: cleaning, chunking, lexicons, upserts, pages of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import chunking, enrich, lexicon, scoring, summaries, upsert
from ledgerloom.plans.registry import query
from ledgerloom.session import table
from ledgerloom.sources import readers

#: Words that the corpus of prose has, for lexicons over it.
CORPUS_TRAPS = [
    ("licence", "critical", [["license", "licence"], ["version", "public"]]),
    ("greeting", "high", [["the and", "der dem", "la et"]], [["license"]]),
    ("marked", "high", [[lexicon.Pattern("[#%&]{3}")]]),
    ("either", "critical", [["this", "zu und"], ["this", "von mit"]]),
]
CASCADE = [("licence", r"licen[sc]e"), ("contact", r"@"), ("marked", r"[#%&]{3}"), ("question", r"\?"), ("numbers", r"[0-9]{4}")]

_STRIP = r"regexp_replace({}, '^[\s\x{{00A0}}\x{{FEFF}}]+|[\s\x{{00A0}}\x{{FEFF}}]+$', '', 'g')"
CLEAN_SQL = r"""
WITH a AS (SELECT doc_id, replace(replace(text, chr(12), chr(10)), chr(13), '') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '\b[Pp]age\s+\d+\s+of\s+\d+\b', '', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^[-–]\s*\d+\s*[-–]\s*$', '', 'g'), '(?m)^\s*\d{1,3}\s*$', '', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(replace(t, chr(9), ' '), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM c)
"""


@query(CLEAN_SQL + r"SELECT doc_id, " + _STRIP.format("array_to_string(list_transform(string_split(t, chr(10)), lambda x: " + _STRIP.format("x") + "), chr(10))") + " AS cleaned FROM d")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '([a-z.])(\d{1,2}\.\d{0,2}\s*[A-Z])', '\1' || chr(10) || chr(10) || '\2', 'g'),
  '([a-z.])(ARTICLE|SECTION|SCHEDULE)', '\1' || chr(10) || chr(10) || '\2', 'g'), '\.([A-Z][a-z])', '. \1', 'g'),
  '\n(\d{1,2}(?:\.\d{1,2})*\.?\s+)', chr(10) || chr(10) || '\1', 'g'), '(?i)\n(HIDDEN:)', chr(10) || chr(10) || '\1', 'g')"""
CHUNKS_SQL = (
    "WITH n AS (SELECT doc_id, string_split_regex(" + _NORMAL + r", '\n+') AS parts FROM documents), "
    "p AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM n), "
    "b AS (SELECT doc_id, pos, " + _STRIP.format("raw") + " AS block FROM p), "
    r"h AS (SELECT *, length(block) < 80 AND (NOT regexp_matches(block, '[.!?]$') OR regexp_matches(block, '(?i)^(Article|Section|Clause|Schedule|Exhibit)\s+\d+')) AS header FROM b WHERE length(block) > 0), "
    "g AS (SELECT *, coalesce(sum(CASE WHEN header THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM h), "
    "chunks AS (SELECT doc_id, grp, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS raw_text FROM g GROUP BY doc_id, grp), "
    "clauses AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INT) AS segment_index, raw_text FROM chunks) "
)


def clauses(spark, sf):
    """Documents cut at line ends, without overflow."""
    return chunking.chunk_clauses(table(spark, sf, "documents"), "doc_id", "text", max_tokens=10**9, separator=r"\n+")


@query(CHUNKS_SQL + "SELECT doc_id, segment_index, raw_text, 'semantic_block' AS type FROM clauses")
def chunk_clauses(spark, sf):
    return clauses(spark, sf)


_PACKED_SQL = CHUNKS_SQL + r""", s AS (SELECT doc_id, segment_index AS grp, raw_text, list_transform(string_split(regexp_replace(raw_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {'done': CAST([] AS VARCHAR[]), 'open': x}) AS parts FROM clauses),
f AS (SELECT doc_id, grp, raw_text, list_reduce(list_concat([{'done': CAST([] AS VARCHAR[]), 'open': ''}], parts), lambda acc, x: CASE WHEN (length(acc.open) + length(x.open)) / 4 > 400
  THEN {'done': CASE WHEN length(""" + _STRIP.format("acc.open") + ") > 0 THEN list_append(acc.done, " + _STRIP.format("acc.open") + r""") ELSE acc.done END, 'open': x.open}
  ELSE {'done': acc.done, 'open': acc.open || ' ' || x.open} END) AS r FROM s),
q AS (SELECT doc_id, grp, length(raw_text) / 4 > 400 AS long, CASE WHEN length(raw_text) / 4 > 400 THEN list_filter(list_append(r.done, """ + _STRIP.format("r.open") + r"""), lambda x: length(x) > 0) ELSE [raw_text] END AS parts FROM f),
u AS (SELECT doc_id, grp, long, unnest(parts) AS raw_text, unnest(range(len(parts))) AS part FROM q)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, part) - 1 AS INT) AS segment_index, raw_text, CASE WHEN long THEN 'overflow_block' ELSE 'semantic_block' END AS type FROM u"""


@query(_PACKED_SQL)
def overflow_split(spark, sf):
    """Chunks of at most 400 tokens, long ones packed sentence by sentence."""
    return chunking.chunk_clauses(table(spark, sf, "documents"), "doc_id", "text", max_tokens=400, separator=r"\n+")


@query(r"SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS INT) AS n_sentences FROM documents")
def sentence_split_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


_HTML = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, url, {_HTML} AS text FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1")
def scrape_pages(spark, sf):
    return readers.scraped(table(spark, sf, "pages"))


@query(r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM lines WHERE length(regexp_replace(line, '^\s+|\s+$', '', 'g')) > 0),
m AS (SELECT *, regexp_matches(line, '^.{1,12}$') AS chap, regexp_matches(line, '^(Th|In|De|La)([^ ]*) (.*)') AND NOT regexp_matches(line, '^.{1,12}$') AS opens FROM t),
s AS (SELECT *, sum(CAST(opens AS INT)) OVER w AS section_no, last_value(CASE WHEN chap THEN line END IGNORE NULLS) OVER w AS chapter FROM m
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, CASE WHEN opens THEN regexp_extract(line, '^(?:Th|In|De|La)([^ ]*) (.*)', 1) END AS number, CASE WHEN opens THEN regexp_extract(line, '^(?:Th|In|De|La)([^ ]*) (.*)', 2) ELSE line END AS body FROM s WHERE NOT chap AND section_no > 0)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, arg_min_null(chapter, pos) AS chapter, max(number) AS number, string_agg(body, ' ' ORDER BY pos) AS content FROM k GROUP BY doc_id, section_no
""")
def sectionise_lines(spark, sf):
    return chunking.sectionise(table(spark, sf, "documents"), "doc_id", "text", r"^.{1,12}$", r"^(?:Th|In|De|La)([^ ]*) (.*)")


_LEX = r"""
l AS (SELECT doc_id, segment_index, lower(raw_text) AS t FROM clauses WHERE length(raw_text) >= 50),
hits AS (
SELECT doc_id, segment_index, 1 AS rule_id, 'licence' AS trap_type, 'critical' AS severity FROM l WHERE (contains(t, 'license') OR contains(t, 'licence')) AND (contains(t, 'version') OR contains(t, 'public'))
UNION ALL SELECT doc_id, segment_index, 2, 'greeting', 'high' FROM l WHERE (contains(t, 'the and') OR contains(t, 'der dem') OR contains(t, 'la et')) AND NOT contains(t, 'license')
UNION ALL SELECT doc_id, segment_index, 3, 'marked', 'high' FROM l WHERE regexp_matches(t, '[#%&]{3}')
UNION ALL SELECT doc_id, segment_index, 4, 'either', 'critical' FROM l WHERE contains(t, 'this') OR (contains(t, 'zu und') AND contains(t, 'von mit')))
"""


@query(CHUNKS_SQL + "," + _LEX + "SELECT doc_id, segment_index, CAST(rule_id AS INT) AS rule_id, trap_type, severity FROM hits")
def lexicon_hits(spark, sf):
    return lexicon.match(clauses(spark, sf), "raw_text", lexicon.table(spark, CORPUS_TRAPS)).select("doc_id", "segment_index", "rule_id", "trap_type", "severity")


def scored_clauses(spark, sf):
    """Clauses with a first score from their text, raised by lexicon hits."""
    rows = clauses(spark, sf).select("doc_id", "segment_index", "raw_text")
    rows = rows.withColumns({
        "risk_score": (F.length("raw_text") % 11).cast("int"), "risk_level": F.lit("medium"), "judge_score": F.lit(None).cast("int"), "judge_level": F.lit(None).cast("string"),
        "risk_reasons": F.array().cast("array<string>"), "compliance_risk_level": F.when(F.length("raw_text") % 5 == 0, "high"), "human_review": F.length("raw_text") % 3 == 0,
        "clause_type": lexicon.classify(F.col("raw_text"), CASCADE),
    })
    scored = scoring.align(scoring.base_scores(rows))
    return scoring.escalate_hits(scored, lexicon.hits("raw_text", lexicon.table(spark, CORPUS_TRAPS))).drop("raw_text")


SCORED_SQL = CHUNKS_SQL + "," + _LEX + r""",
worst AS (SELECT doc_id, segment_index, max(CASE severity WHEN 'critical' THEN 9 ELSE 8 END) AS target FROM hits GROUP BY 1, 2),
base AS (SELECT doc_id, segment_index, raw_text, length(raw_text) % 11 AS s, CASE WHEN length(raw_text) % 5 = 0 THEN 'high' ELSE 'low' END AS compliance, length(raw_text) % 3 = 0 AS review,
  CASE WHEN regexp_matches(lower(raw_text), 'licen[sc]e') THEN 'licence' WHEN contains(raw_text, '@') THEN 'contact' WHEN regexp_matches(raw_text, '[#%&]{3}') THEN 'marked' WHEN contains(raw_text, '?') THEN 'question' WHEN regexp_matches(raw_text, '[0-9]{4}') THEN 'numbers' ELSE 'other' END AS kind FROM clauses),
lev AS (SELECT b.*, target, CASE WHEN s >= 8 THEN 'critical' WHEN s >= 6 THEN 'high' ELSE 'medium' END AS lv FROM base b LEFT JOIN worst USING (doc_id, segment_index)),
up AS (SELECT *, coalesce(target > CASE WHEN s = 0 THEN 5 ELSE s END, false) AS raised FROM lev),
scored AS (SELECT doc_id, segment_index, kind, compliance, review, CASE WHEN raised THEN target ELSE s END AS score, CASE WHEN raised THEN 'critical' ELSE lv END AS level FROM up)
"""


@query(SCORED_SQL + "SELECT doc_id, segment_index, CAST(score AS INT) AS risk_score, level AS risk_level, kind AS clause_type FROM scored")
def score_fold(spark, sf):
    return scored_clauses(spark, sf).select("doc_id", "segment_index", "risk_score", "risk_level", "clause_type")


@query(SCORED_SQL + """, e AS (SELECT *, CASE WHEN score <= 5 THEN 'low' ELSE level END AS lv, CASE WHEN score <= 5 THEN 'low' ELSE compliance END AS c FROM scored)
SELECT doc_id, count(*) AS total, count(*) FILTER (lv = 'low') AS low, count(*) FILTER (lv = 'medium') AS medium, count(*) FILTER (lv = 'high') AS high, count(*) FILTER (lv = 'critical') AS critical,
count(*) FILTER (c = 'low') AS compliance_low, count(*) FILTER (c = 'medium') AS compliance_medium, count(*) FILTER (c = 'high') AS compliance_high, count(*) FILTER (c = 'critical') AS compliance_critical,
count(*) FILTER (review AND score > 5) AS needs_review FROM e GROUP BY doc_id""")
def risk_summary(spark, sf):
    return summaries.risk_summary(scored_clauses(spark, sf), "doc_id")


@query(SCORED_SQL + """SELECT doc_id, count(*) AS total, count(*) FILTER (level = 'low') AS low, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'critical') AS critical,
count(*) FILTER (compliance = 'low') AS compliance_low, count(*) FILTER (compliance = 'medium') AS compliance_medium, count(*) FILTER (compliance = 'high') AS compliance_high, count(*) FILTER (compliance = 'critical') AS compliance_critical,
count(*) FILTER (review) AS needs_review FROM scored GROUP BY doc_id""")
def plain_risk_summary(spark, sf):
    """Levels as they stand, whatever the scores."""
    return summaries.risk_summary(scored_clauses(spark, sf), "doc_id", override=False)


@query(SCORED_SQL + "SELECT doc_id, kind AS clause_type, count(*) AS count, count(*) FILTER (score > 5 AND level IN ('high', 'critical')) AS high_or_critical FROM scored GROUP BY 1, 2")
def risk_summary_by_type(spark, sf):
    return summaries.risk_by_type(scored_clauses(spark, sf), "doc_id")


@query(SCORED_SQL + "SELECT doc_id, ['low','medium','high','critical'][max(list_position(['low','medium','high','critical'], level))] AS overall_risk FROM scored GROUP BY 1")
def overall_risk(spark, sf):
    return summaries.overall_risk(scored_clauses(spark, sf), "doc_id")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'licence' WHEN contains(text, '@') THEN 'contact' WHEN regexp_matches(text, '[#%&]{3}') THEN 'marked'
WHEN contains(text, '?') THEN 'question' WHEN regexp_matches(text, '[0-9]{4}') THEN 'numbers' ELSE 'other' END AS class FROM documents""")
def classify_cascade(spark, sf):
    return table(spark, sf, "documents").select("doc_id", lexicon.classify(F.col("text"), CASCADE).alias("class"))


@query("""WITH w AS (SELECT * FROM documents WHERE doc_id % 3 = 0), n AS (SELECT doc_id + 1 AS doc_id, source, n_chars + 7 AS n_chars FROM w)
SELECT doc_id, source, n_chars FROM n UNION ALL SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)""")
def upsert_latest(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    new = docs.filter("doc_id % 3 = 0").select((F.col("doc_id") + 1).alias("doc_id"), "source", (F.col("n_chars") + 7).alias("n_chars"))
    older = new.withColumn("n_chars", F.col("n_chars") - 1)
    return upsert.upsert(docs, new.unionByName(older), ["doc_id"], "n_chars")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 2 = 1")
def insert_absent(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return upsert.insert_absent(docs.filter("doc_id % 2 = 0"), docs, ["doc_id"], "doc_id")


@query("SELECT doc_id, CASE WHEN l.quality = 0 THEN 'bad' ELSE source END AS source, CASE WHEN n_chars > 5000 THEN -1 ELSE n_chars END AS n_chars FROM documents LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.toxic = 1, false)")
def keyed_and_predicate_updates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf, "labels")
    rows = upsert.update_by_key(docs, labels.select("doc_id", F.when(F.col("quality") == 0, "bad").alias("source")), ["doc_id"])
    rows = upsert.update_where(rows, F.col("n_chars") > 5000, n_chars=F.lit(-1))
    return upsert.delete_cascade(rows, labels.filter("toxic = 1"), "doc_id")[0]


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(source)), lang, md5(text) ORDER BY doc_id) = 1")
def dedup_keep_first(spark, sf):
    docs = table(spark, sf, "documents")
    return summaries.dedup_first(docs, [F.lower(F.trim("source")), F.col("lang"), F.md5("text")], ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND coalesce(source, 'low') = 'src3' AND (contains(lower(text), 'the') OR contains(lower(source), 'the'))")
def multi_filter(spark, sf):
    rows = table(spark, sf, "documents").withColumnsRenamed({"lang": "risk_level", "source": "compliance_risk_level", "text": "raw_text"})
    found = summaries.multi_filter(rows, risk="en", compliance="src3", search="THE", columns=("raw_text", "compliance_risk_level"))
    return found.select("doc_id", F.col("risk_level").alias("lang"), F.col("compliance_risk_level").alias("source"))


@query("SELECT DISTINCT source FROM documents ORDER BY 1")
def distinct_sorted(spark, sf):
    return table(spark, sf, "documents").select("source").distinct().orderBy("source")


@query("SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, CAST(max(turn) AS BIGINT) AS turn FROM conversations GROUP BY conv_id")
def last_turn(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


@query("SELECT conv_id, CAST(floor(turn / 3) AS INT) AS \"window\", array_to_string(list(role ORDER BY turn), ',') AS roles FROM conversations GROUP BY 1, 2")
def turn_windows(spark, sf):
    rows = table(spark, sf, "conversations").withColumnRenamed("text", "raw_text")
    found = enrich.windows_of_clauses(rows.withColumn("raw_text", F.col("role")), "conv_id", "turn", 3)
    return found.select("conv_id", "window", F.array_join(F.transform("clauses", lambda c: c["raw_text"]), ",").alias("roles"))


@query("""WITH d AS (SELECT conv_id, turn, role AS term, text AS definition FROM conversations)
SELECT conv_id, term, arg_max(definition, turn) AS definition FROM d GROUP BY 1, 2""")
def merge_symbols(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk_no"), F.col("role").alias("term"), F.col("text").alias("definition"))
    return summaries.merge_symbols(rows, "conv_id").select("conv_id", F.explode("symbols").alias("term", "definition"))


@query("""WITH s AS (SELECT doc_id, length(text) AS n, unnest(range(0, least(length(text), 20000), 10000)) AS a, text FROM documents)
SELECT doc_id, CAST(a / 10000 AS INT) AS chunk_no, md5(substring(text, CAST(a + 1 AS INT), CAST(least(10000, 20000 - a) AS INT))) AS digest FROM s""")
def prompt_chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.windows_of(F.col("text"), 10_000, 20_000)).alias("chunk_no", "part"))
    return rows.select("doc_id", "chunk_no", F.md5("part").alias("digest"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'defer|withhold|deduct|negative margin|reserve') THEN 'wage_deferral'
WHEN regexp_matches(lower(text), '24/7|availability|latency|weekly working hours|45-minute|45 minute|shops') THEN 'availability_waiver'
WHEN regexp_matches(lower(text), 'training|repay|bond|administrative fee|compounding interest|36 months|[$]450') THEN 'training_bond'
WHEN regexp_matches(lower(text), '200%|liquidated|ex-parte|injunct|without proving|compensation penalty|penalty clause') THEN 'liquidated_penalty' END AS flag FROM documents""")
def offline_advice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", enrich.offline_advice(F.col("text"), F.lit("other"))["flag"].alias("flag"))


def _provider(frame):
    """Classes by length: a provider that needs no network."""
    return frame.assign(answer=frame["text"].str.len().map(lambda n: "long" if n > 2000 else "odd" if n % 2 else "short"))[["doc_id", "answer"]]


@query("SELECT doc_id, CASE WHEN lang <> 'en' THEN 'other' WHEN length(text) > 2000 THEN 'long' WHEN length(text) % 2 = 1 THEN 'other' ELSE 'short' END AS answer FROM documents")
def enrich_with_provider(spark, sf):
    docs = table(spark, sf, "documents")
    answers = enrich.enrich(docs, ["doc_id"], "text", _provider, "doc_id long, answer string", F.col("lang") == "en")
    return enrich.merge(docs.select("doc_id"), answers, ["doc_id"], {"answer": "other"}, {"answer": ["long", "short", "other"]})


@query()
def word_diff(spark, sf):
    """Every document, whole, against the whole document of the next id; where there is none, all its words are removed."""
    docs = table(spark, sf, "documents")
    later = docs.select((F.col("doc_id") - 1).alias("_id"), F.col("text").alias("after"))
    rows = docs.select("doc_id", F.col("text").alias("before")).join(later, F.col("doc_id") == F.col("_id"), "left")
    return enrich.word_diff(rows, "doc_id", "before", "after")
