"""Text functions and chunking on literals, with properties of the chunker."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import chunking


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a\fb\r\n\n\n\nc", "a\nb\n\nc"),
        ("Before Page 3 of 12 after", "Before after"),
        ("x\n- 4 -\ny\n 12 \nz 12 w", "x\n\ny\n\nz 12 w"),
        ("a\t\tb   c ", "a b c"),
        ("", ""),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, T.clean_text) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("courts.16. GOVERNING", "courts.\n\n\n16. GOVERNING"),
        ("50,00,000.Milestone two", "50,00,000. Milestone two"),
        ("the U.S.A. and Pvt.LTD", "the U.S.A. and Pvt.LTD"),
        ("a\n2. Next\nHidden: x", "a\n\n2. Next\n\nHidden: x"),
        ("a​b", "ab"),
    ],
)
def test_normalize_text(spark, raw, want):
    assert one(spark, raw, T.normalize_text) == want


@pytest.mark.parametrize(("raw", "want"), [("PAYMENT", True), ("It ends here.", False), ("Section 4.", True), ("x" * 80, False), ("  ", False)])
def test_is_header(spark, raw, want):
    assert one(spark, raw, T.is_header) is want


def chunks(spark, text, **more):
    rows = chunking.chunk_clauses(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", **more).orderBy("segment_index").collect()
    assert [r["segment_index"] for r in rows] == list(range(len(rows)))
    return [(r["raw_text"], r["type"]) for r in rows]


def test_headings_join_the_block_after_them(spark):
    text = "TITLE\n\nSUB\n\nBody one ends here.\n\nBody two ends here.\n\nTRAILING"
    assert [t for t, _ in chunks(spark, text)] == ["TITLE\n\nSUB\n\nBody one ends here.", "Body two ends here.", "TRAILING"]


def test_overflow(spark):
    many = chunks(spark, " ".join(f"This is sentence number {k}." for k in range(20)), max_tokens=50)
    assert len(many) > 1 and all(len(t) <= 200 and kind == "overflow_block" for t, kind in many)
    first = chunks(spark, "x" * 300 + ". Short one.", max_tokens=50)
    assert all(t.strip() for t, _ in first) and len(first) == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab.!? \n", min_size=1, max_size=60), min_size=1, max_size=5))
def test_chunks_keep_all_text_in_order(spark, parts):
    text = "\n\n".join(parts)
    got = chunks(spark, text, max_tokens=8)
    assert all(t.strip() for t, _ in got)
    assert re.sub(r"\s", "", "".join(t for t, _ in got)) == re.sub(r"\s", "", one(spark, text, T.normalize_text))


def test_sections(spark):
    text = "front\nCHAPTER I\n1. First thing\nmore of it\nSection 2A. Second\nCHAPTER II\n3. Third"
    rows = chunking.sectionise(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("section_no").collect()
    assert [(r["chapter"], r["number"], r["content"]) for r in rows] == [("CHAPTER I", "1", "First thing more of it"), ("CHAPTER I", "2A", "Second"), ("CHAPTER II", "3", "Third")]
    body = "words " * 12
    parts = chunking.split_sections(spark.createDataFrame([(1, f"{body}Section 12 {body}\n4. Also {body}")], "id long, t string"), "id", "t").orderBy("part").collect()
    assert [r["section"] for r in parts] == ["Part 0", "Section 12", "Section 4"]
    pages = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 1, "w" * 60)], "id long, page int, t string")
    joined = {r["id"]: (r["text"], r["enough"]) for r in chunking.join_pages(pages, "id", "page", "t").collect()}
    assert joined == {1: ("first\n\nsecond", False), 2: ("w" * 60, True)}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Offices in Bengaluru", ("Karnataka", "BBMP")), ("within BMC limits", ("Maharashtra", "BMC")), ("Gujarat", ("Gujarat", None)), ("India", ("Central", None)), (None, ("Central", None)), ("Old Madras road", ("Tamil Nadu", "GCC"))],
)
def test_jurisdiction(spark, raw, want):
    assert tuple(one(spark, raw, T.resolve_jurisdiction)) == want


def test_small_functions(spark):
    assert one(spark, "drop graph'; x-y_z", T.identifier) == "drop graph x-y_z"
    assert one(spark, "abcdefghij", lambda t: T.windows_of(t, 4)) == ["abcd", "efgh", "ij"] and one(spark, "", lambda t: T.windows_of(t, 4)) == []
    assert one(spark, "head " * 10, lambda t: T.ends_of(t, 10, 5)).startswith("head head \n...\n")
    assert one(spark, "this is called the Shops Act, 1953 and so on", T.act_title) == "Shops Act, 1953"
    assert one(spark, "an act to provide for much more", T.act_title) == "an act to provide for..."
    assert one(spark, "Rule 7 says", lambda t: T.cited_section(F.lit(""), t)) == "Rule 7"
    assert one(spark, "<p>a<script>b</script> &amp; <b>c</b></p>", T.html_text) == "a &amp; c"


def test_windows_at_headers(spark):
    text = "intro Definitions one two DEFINITIONS inside " + "x" * 30 + " definitions last"
    got = one(spark, text, lambda t: T.windows_at(t, size=30))
    assert [g[:15] for g in got] == ["Definitions one", "definitions las"] and one(spark, "none", T.windows_at) == []
    assert one(spark, "definitions first", T.windows_at) == ["definitions first"]
