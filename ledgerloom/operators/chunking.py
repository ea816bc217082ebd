"""Cutting documents into clauses, sections and lines, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_header, normalize_text, sentences, strip


def blocks(text: Column, separator: str = r"\n{2,}") -> Column:
    """The non-blank blocks of a text, trimmed."""
    return F.filter(F.transform(F.split(text, separator), strip), lambda b: F.length(b) > 0)


def chunk_ends(parts: Column) -> Column:
    """Where chunks end, counted from 1: after each body, and after the last block."""
    return F.filter(F.transform(parts, lambda b, i: F.when(~is_header(b, stripped=True) | (i + 1 == F.size(parts)), i + 1)), lambda i: i.isNotNull())


def merge_headers(parts: Column, ends: Column) -> Column:
    """Blocks with the headings before them in one chunk; headings at the end form a chunk of their own.

    A chunk is the slice from after one end to the next, so the work is that of reading the blocks once."""
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    return F.zip_with(starts, ends, lambda a, e: F.array_join(_between(parts, a, e), "\n\n"))


def _between(parts: Column, after: Column, to: Column) -> Column:
    """Entries after+1 to `to`, counted from 1."""
    return F.slice(parts, after + 1, to - after)


def pack_sentences(chunk: Column, max_tokens: int) -> Column:
    """Sentences packed in order into blocks of max_tokens tokens of four characters, as an array; blank blocks are dropped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        full = (F.length(acc["open"]) + F.length(s)) / 4 > max_tokens
        flushed = F.when(F.length(strip(acc["open"])) > 0, F.concat(acc["done"], F.array(strip(acc["open"])))).otherwise(acc["done"])
        return F.struct(F.when(full, flushed).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(F.concat(acc["open"], F.lit(" "), s)).alias("open"))

    close = lambda acc: F.filter(F.concat(acc["done"], F.array(strip(acc["open"]))), lambda b: F.length(b) > 0)
    return F.aggregate(sentences(chunk), start, add, close)


def chunk_clauses(df: DataFrame, id_col: str, text_col: str, max_tokens: int = 1500, separator: str = r"\n{2,}", normalize: bool = True) -> DataFrame:
    """Documents to clauses: id, segment_index from 0, raw_text, type (semantic_block or overflow_block). Each document is cut
    within its row, so nothing is shuffled."""
    text = normalize_text(F.col(text_col)) if normalize else F.col(text_col)

    def parts(chunk: Column) -> Column:
        long = F.length(chunk) / 4 > max_tokens
        kind = F.when(long, "overflow_block").otherwise("semantic_block")
        return F.transform(F.when(long, pack_sentences(chunk, max_tokens)).otherwise(F.array(chunk)), lambda p: F.struct(p.alias("raw_text"), kind.alias("type")))

    # Each step is a column of its own, exploded from one entry, so that it is computed once a row.
    rows = df.select(id_col, F.explode(F.array(blocks(text, separator))).alias("_blocks")).filter(F.size("_blocks") > 0)
    rows = rows.select(id_col, "_blocks", F.explode(F.array(chunk_ends(F.col("_blocks")))).alias("_ends"))
    rows = rows.select(id_col, F.explode(F.array(merge_headers(F.col("_blocks"), F.col("_ends")))).alias("_chunks"))
    return rows.select(id_col, F.posexplode(F.flatten(F.transform("_chunks", parts))).alias("segment_index", "_p")).select(id_col, "segment_index", "_p.raw_text", "_p.type")


def sectionise(df: DataFrame, id_col: str, text_col: str, chapter: str = r"^CHAPTER\b.*", opens: str = r"^(?:Section )?(\d+[A-Z]?)\. (.*)") -> DataFrame:
    """Lines to sections: a line that opens a section starts a row, others are appended, a chapter line names the chapter of
    the sections after it. Lines before the first section are dropped. Rows: id, section_no, chapter, number, content.

    A section is a slice of its document's lines, cut within the row: nothing is shuffled."""
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), strip), lambda x: F.length(x) > 0)
    kinds = F.transform("_lines", lambda x: F.when(x.rlike(chapter), "c").when(x.rlike(opens), "s").otherwise("b"))
    places = lambda kind: F.filter(F.transform("_kinds", lambda k, i: F.when(k == kind, i + 1)), lambda i: i.isNotNull())
    rows = df.select(id_col, F.explode(F.array(lines)).alias("_lines")).filter(F.size("_lines") > 0)
    rows = rows.select(id_col, "_lines", F.explode(F.array(kinds)).alias("_kinds"))
    rows = rows.select(id_col, "_lines", "_kinds", F.explode(F.array(F.struct(places("s").alias("s"), places("c").alias("c")))).alias("_at"))
    rows = rows.select(id_col, "_lines", "_kinds", F.col("_at.c").alias("_chapters"), F.col("_at.s").alias("_starts"), F.posexplode("_at.s").alias("_k", "_from"))
    end = F.coalesce(F.get("_starts", F.col("_k") + 1) - 1, F.size("_lines"))
    kept = F.zip_with(_between(F.col("_lines"), F.col("_from"), end), _between(F.col("_kinds"), F.col("_from"), end), lambda x, k: F.when(k != "c", x))
    first = F.element_at("_lines", F.col("_from"))
    content = F.array_join(F.concat(F.array(F.regexp_extract(first, opens, 2)), F.filter(kept, lambda x: x.isNotNull())), " ")
    before = F.array_max(F.filter("_chapters", lambda c: c < F.col("_from")))
    return rows.select(id_col, (F.col("_k") + 1).cast("long").alias("section_no"), F.try_element_at("_lines", before).alias("chapter"), F.regexp_extract(first, opens, 1).alias("number"), content.alias("content"))


def split_sections(df: DataFrame, id_col: str, text_col: str, least: int = 50) -> DataFrame:
    """Text cut before every "Section n" and numbered heading: id, part, section, content, of more than least characters."""
    text = F.split(F.col(text_col), r"(?m)(?=Section\s+\d+|^\d+\.\s+[A-Z])")
    rows = df.select(id_col, F.posexplode(text).alias("part", "content")).withColumn("content", F.trim(F.regexp_replace("content", r"\s+", " ")))
    number = F.regexp_extract("content", r"^(?:Section\s+)?(\d+[A-Z]?)", 1)
    return rows.filter(F.length("content") > least).withColumn("section", F.when(number != "", F.concat(F.lit("Section "), number)).otherwise(F.concat(F.lit("Part "), F.col("part").cast("string"))))


def join_pages(pages: DataFrame, id_col: str, page_col: str, text_col: str, least: int = 50) -> DataFrame:
    """Page texts in page order with a blank line between, and whether they hold enough characters to go on with."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page_col, text_col))), lambda p: p[text_col]), "\n\n")
    return pages.groupBy(id_col).agg(joined.alias("text")).withColumn("enough", F.length(F.regexp_replace("text", r"\s+", "")) >= least)
