"""Deleting runs of lines that repeat earlier text, by winnowing over line hashes. DataFrame functions only.

A run is a stretch of consecutive lines with at least min_words words that stands, line for line, earlier in the corpus;
earlier is by document id, then line. Every line of the later run goes. Lines without a word count for nothing: a run
goes on over them, and they go with it.

1. A document becomes its sheet, the hashes and words of its lines. Around each line lie two windows: the shortest stretch
   that starts with it and the shortest that ends with it and has min_words words. Where a window lies follows from its own
   lines, so equal runs hold equal windows, and every run is the union of its windows.
2. The least line hash of a window is its fingerprint. Equal windows have equal ones at the same place, so a repeated run
   is guaranteed to hold fingerprints that occur at two places or more. Fingerprints met at one place only, which are
   most, end here together with their windows.
3. The places of a fingerprint are extended both ways at once: by one line on either side, then by up to 8, by up to 64 and
   so on, within their windows, places that go on alike staying together; those that are alone are dropped after every
   step. A frequent line thus parts into the companies it keeps, and its places are never paired with each other.
4. Positions are joined: each with the first position that it was extended alike with. The pair is compared line by line over
   both sheets, by other hashes than those that brought it together, as far as its windows reach. A matched stretch with
   min_words words is a repeated run.
5. The lines of later runs, taken together per document, are deleted.

Groups are reduced to least places before they are shuffled and never collected, and the tables that places are joined with
are written first, so that Spark can split the rows of a frequent key over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, Scratch, table

MIN_WORDS = 50
#: How many times further each step of extension reaches.
STRIDE = 8


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """A row a window: _id, _th, start, end and anchor (numbers of lines), least (the fingerprint), all (hashes of its lines)."""
    doc = Window.partitionBy("_id", "_th")
    c = lines.withColumn("upto", F.sum("words").over(doc.orderBy("n"))).withColumn("before", F.col("upto") - F.col("words"))
    ahead, back = doc.orderBy("before").rangeBetween(0, min_words - 1), doc.orderBy("upto").rangeBetween(1 - min_words, 0)
    for name, frame in (("a", ahead), ("b", back)):
        window = F.struct(
            F.min("n").over(frame).alias("start"),
            F.max("n").over(frame).alias("end"),
            F.sum("words").over(frame).alias("words"),
            F.min(F.struct("h", "n")).over(frame).alias("low"),
            F.collect_list("h").over(frame).alias("all"),
        )
        c = c.withColumn(name, window)
    c = c.select("_id", "_th", F.explode(F.array("a", "b")).alias("w")).filter(F.col("w.words") >= min_words)
    return c.select("_id", "_th", "w.start", "w.end", F.col("w.low.n").alias("anchor"), F.col("w.low.h").alias("least"), "w.all")


def _again(places: DataFrame, key: str, scratch: Scratch, read: DataFrame) -> DataFrame:
    """places whose key another place has too, written anew; the table that places read is deleted."""
    met = F.xxhash64("_id", "_th", "anchor")
    twice = scratch.keep(places.groupBy(key).agg(F.min(met).alias("_a"), F.max(met).alias("_b")).filter("_a < _b").select(key), "twice")
    found = scratch.keep(places.join(twice, key, "left_semi"), "again")
    scratch.drop(twice, read)
    return found


def _extended_alike(places: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """places (windows) with company, which is the same of those whose windows go on alike on both sides of the anchor; places
    that were found alone on the way are left out. longest is the most lines that a window has."""
    at, done, reach = F.col("anchor") - F.col("start") + 1, 0, 1
    read, places = places, places.withColumn("company", F.col("least"))
    while True:
        right = F.slice("all", at + (1 + done), F.lit(reach - done))
        begin = F.greatest(at - reach, F.lit(1))
        left = F.slice("all", begin, F.greatest(at - done - begin, F.lit(0)))
        places = places.withColumn("company", F.xxhash64("company", F.size(right), right, left))
        if reach >= longest - 1:
            return places.drop("all")
        read = places = _again(places, "company", scratch, read)
        done, reach = reach, reach * STRIDE


def _run(equal: Column, length: Column) -> Column:
    """How many entries at the head of an array of booleans hold."""
    stop = F.array_position(equal, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(length).cast("int")


def _extended(pairs: DataFrame, sheets: DataFrame, min_words: int) -> DataFrame:
    """pairs (_id, _th, anchor, back, ahead and the first place f_id, f_th, f_anchor) to the runs (_id, _th, start, end) of positions.

    back and ahead say how many lines on either side the windows of the pair reach."""
    size = F.col("back") + F.col("ahead") + 1
    part = lambda a, at: F.slice(a, F.greatest(at - F.col("back"), F.lit(1)), size)
    first = sheets.select(F.col("_id").alias("_fi"), F.col("_th").alias("_ft"), F.col("lines.h2").alias("_fl"))
    own = sheets.select(F.col("_id").alias("_oi"), F.col("_th").alias("_ot"), "lines")
    found = pairs.join(first, F.col("f_id").eqNullSafe(F.col("_fi")) & F.col("f_th").eqNullSafe(F.col("_ft")))
    found = found.select("_id", "_th", "anchor", "back", "ahead", part(F.col("_fl"), F.col("f_anchor")).alias("there"))
    found = found.join(own, F.col("_id").eqNullSafe(F.col("_oi")) & F.col("_th").eqNullSafe(F.col("_ot")))
    same = F.zip_with(part(F.col("lines.h2"), F.col("anchor")), "there", lambda x, y: x.eqNullSafe(y))
    found = found.withColumn("same", same).filter(F.get("same", F.col("back")))
    left, right = F.reverse(F.slice("same", F.lit(1), F.col("back"))), F.slice("same", F.col("back") + 2, F.col("ahead"))
    found = found.withColumn("from", F.col("anchor") - _run(left, F.col("back"))).withColumn("to", F.col("anchor") + _run(right, F.col("ahead")))
    words = F.aggregate(F.slice("lines.words", F.col("from"), F.col("to") - F.col("from") + 1), F.lit(0), lambda a, x: a + x)
    at = lambda n: F.get("lines", n - 1)["pos"]
    return found.filter(words >= min_words).select("_id", "_th", at(F.col("from")).alias("start"), at(F.col("to")).alias("end"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row a document that repeats earlier lines: _id, _th (hash of the text), gone (positions of its lines to delete)."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.cast("int").alias("pos"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(2), x).alias("h2"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    sheets = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.filter(lines, lambda x: x["words"] > 0).alias("lines"))
    # Rows that repeat an id and its text are one document here.
    sheets = scratch.keep(sheets.filter(F.size("lines") > 0).groupBy("_id", "_th").agg(F.first("lines").alias("lines")), "sheets")
    numbered = sheets.select("_id", "_th", F.posexplode("lines").alias("n", "line")).select("_id", "_th", (F.col("n") + 1).alias("n"), "line.h", "line.words")
    windows = scratch.keep(_windows(numbered, min_words), "windows")

    # Fingerprints met at two places or more, then places that go on alike. A line has a word, so windows have few lines.
    windows = _again(windows, "least", scratch, windows)
    windows = _extended_alike(windows, min_words, scratch)
    # Positions joined: a place with the first one that was extended alike.
    place = F.struct("_id", "_th", "start")
    first = windows.groupBy("least", "company").agg(F.min(F.struct("_id", "_th", "start", "anchor")).alias("f"), F.max(place).alias("_last"))
    first = first.filter(F.struct("f._id", "f._th", "f.start") < F.col("_last")).select("least", "company", "f")
    later = windows.join(scratch.keep(first, "first"), ["least", "company"]).filter(place > F.struct("f._id", "f._th", "f.start"))
    pairs = later.groupBy("_id", "_th", "anchor", F.col("f._id").alias("f_id"), F.col("f._th").alias("f_th"), F.col("f.anchor").alias("f_anchor"))
    pairs = scratch.keep(pairs.agg(F.max(F.col("anchor") - F.col("start")).alias("back"), F.max(F.col("end") - F.col("anchor")).alias("ahead")), "pairs")
    runs = _extended(pairs, sheets, min_words)
    return runs.select("_id", "_th", F.explode(F.sequence("start", "end")).alias("pos")).groupBy("_id", "_th").agg(F.collect_set("pos").alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs deleted from text_col, and _n_lines, _n_deleted.

    Null and empty texts stay as they are, with no lines; a text of which every line goes becomes empty; rows that repeat
    an id and its text are treated alike; an empty table stays empty; other columns pass through, whatever their names.
    """
    gone = repeats(docs, id_col, text_col, min_words).select(F.col("_id").alias("_gone_id"), F.col("_th").alias("_gone_th"), F.col("gone").alias("_gone_at"))
    split = F.split(F.col(text_col), "\n")
    found = docs.join(gone, docs[id_col].eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text_col) == F.col("_gone_th")), "left")
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("_gone_at", i)), "\n")
    return found.select(
        *(F.when(F.col("_gone_at").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns),
        F.when(F.length(text_col) > 0, F.size(split)).otherwise(0).cast("long").alias("_n_lines"),
        F.when(F.col("_gone_at").isNull(), 0).otherwise(F.size("_gone_at")).cast("long").alias("_n_deleted"),
    )


def op1_line_dedup(spark, sf_dir):
    """All documents without later repeated runs of 50 words and more: doc_id, n_lines, n_deleted, text."""
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), "text")


#: The same without fingerprints: windows are compared by their whole text.
WINDOWS_SQL = r"""
all_lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM {docs} WHERE text IS NOT NULL),
lines AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM all_lines),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines WHERE words > 0),
spans AS (
  SELECT doc_id, min(pos) OVER f AS s, max(pos) OVER f AS e, sum(words) OVER f AS w, list(line) OVER f AS key FROM (SELECT *, upto - words AS before FROM summed)
  WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER f, max(pos) OVER f, sum(words) OVER f, list(line) OVER f FROM summed
  WINDOW f AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, min((doc_id, s)) OVER (PARTITION BY array_to_string(key, chr(10))) AS first FROM spans WHERE w >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM ranked WHERE (doc_id, s) > first),
left_over AS (
  SELECT l.doc_id, count(g.pos) AS n_deleted, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
  FROM all_lines l LEFT JOIN gone g USING (doc_id, pos) GROUP BY l.doc_id)
"""
OP1_SQL = "WITH " + WINDOWS_SQL.replace("{docs}", "documents") + """
SELECT d.doc_id, CAST(CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END AS BIGINT) AS n_lines,
  CAST(coalesce(k.n_deleted, 0) AS BIGINT) AS n_deleted, CASE WHEN k.n_deleted > 0 THEN k.text ELSE d.text END AS text
FROM documents d LEFT JOIN left_over k USING (doc_id)
"""
