"""Column functions over text: cleaning, segmentation tests, numbers in words, durations, citations, names.

Every function takes and returns Columns and stays inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- cleaning ---------------------------------------------------------------------------------------

#: Rewrites of clean_text, in order. Fixed values.
CLEAN_STEPS = (
    (r"\f", "\n"),
    (r"\r", ""),
    (r"\b[Pp]age\s+\d+\s+of\s+\d+\b", ""),
    (r"(?m)^[-–]\s*\d+\s*[-–]\s*$", ""),
    (r"(?m)^\s*\d{1,3}\s*$", ""),
    (r"\t", " "),
    (r" {2,}", " "),
    (r"\n{3,}", "\n\n"),
)

#: Rewrites of normalize_text, in order: hidden characters, line ends, section numbers and headings glued to text before
#: them, sentences glued together, and breaks before numbered lines and markers. Fixed values.
NORMALIZE_STEPS = (
    ("[\\u200B-\\u200D\\uFEFF]", ""),
    (r"\r\n", "\n"),
    (r"([a-z.])(\d{1,2}\.\d{0,2}\s*[A-Z])", "$1\n\n$2"),
    (r"([a-z.])(ARTICLE|SECTION|SCHEDULE)", "$1\n\n$2"),
    (r"\.([A-Z][a-z])", ". $1"),
    (r"\n(\d{1,2}(?:\.\d{1,2})*\.?\s+)", "\n\n$1"),
    (r"(?i)\n(HIDDEN:)", "\n\n$1"),
)

#: White space as a trim in the source data means it, no-break space and byte-order mark included.
EDGE = r"[\s ﻿]+"


def rewrite(text: Column, steps) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, *step), steps, text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{EDGE}|{EDGE}\z", "")


def clean_text(text: Column) -> Column:
    """Page numbers, form feeds and runs of blanks removed; every line and the whole trimmed."""
    lines = F.transform(F.split(rewrite(text, CLEAN_STEPS), "\n"), strip)
    return strip(F.array_join(lines, "\n"))


def normalize_text(text: Column) -> Column:
    """Breaks put where sections begin."""
    return rewrite(text, NORMALIZE_STEPS)


#: A heading that ends like a sentence: a word for a section and its number, or capitals only. Fixed values.
HEADING = r"(?i)^(Article|Section|Clause|Schedule|Exhibit)\s+\d+"


def is_header(text: Column, stripped: bool = False) -> Column:
    """Whether a block is a heading: short, and without a full stop or opened by a section word."""
    t = text if stripped else strip(text)
    return (F.length(t) > 0) & (F.length(t) < 80) & (~t.rlike(r"[.!?]\z") | t.rlike(HEADING))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags dropped, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return collapse(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


# --- numbers and durations --------------------------------------------------------------------------

#: Number words. Fixed values.
WORD_NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000, "lakh": 100000, "crore": 10000000,
}
#: Days in a unit of duration. Fixed values.
UNIT_DAYS = {"hours": 1 / 24, "days": 1.0, "business_days": 1.4, "weeks": 7.0, "months": 30.0, "years": 365.0}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def word_number(phrase: Column) -> Column:
    """A number in words: hundreds multiply what is open, thousands and more multiply and close it, the rest adds."""
    known = F.filter(F.transform(F.split(F.lower(phrase), "[- ]+"), lambda w: F.try_element_at(_map({k: float(v) for k, v in WORD_NUMBERS.items()}), w)), lambda v: v.isNotNull())
    step = lambda acc, v: (
        F.when(v == 100, F.struct(acc["total"].alias("total"), (F.greatest(acc["open"], F.lit(1.0)) * 100).alias("open")))
        .when(v >= 1000, F.struct((acc["total"] + F.greatest(acc["open"], F.lit(1.0)) * v).alias("total"), F.lit(0.0).alias("open")))
        .otherwise(F.struct(acc["total"].alias("total"), (acc["open"] + v).alias("open")))
    )
    return F.aggregate(known, F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("open")), step, lambda acc: acc["total"] + acc["open"])


def duration_unit(raw: Column) -> Column:
    """The unit of a written one: singular, plural, calendar, business and working days."""
    unit = F.regexp_replace(F.lower(collapse(raw)), r"s\z", "")
    return (
        F.when(unit.isin("business day", "working day"), "business_days")
        .when(unit.isin("hour", "week", "month", "year"), F.concat(unit, F.lit("s")))
        .otherwise("days")
    )


def duration_days(value: Column, unit: Column) -> Column:
    """Days of a duration; an unknown unit counts as days."""
    return F.when(unit == "hours", value / 24).otherwise(value * F.coalesce(F.try_element_at(_map({u: d for u, d in UNIT_DAYS.items() if u != "hours"}), unit), F.lit(1.0)))


def tolerant_number(text: Column) -> Column:
    """A number written with currency signs, commas, and k, m or b; null if it is none."""
    bare = F.lower(F.regexp_replace(text, r"[^0-9.kmbKMB-]", ""))
    scale = F.coalesce(F.try_element_at(_map({"k": 1e3, "m": 1e6, "b": 1e9}), F.regexp_extract(bare, r"([kmb])\z", 1)), F.lit(1.0))
    return F.regexp_replace(bare, r"[kmb]\z", "").try_cast("double") * scale


def money(value: Column, unit: Column) -> Column:
    """A rounded amount with its sign: groups of three, and of two above the thousand in rupees."""
    whole = F.format_string("%d", F.floor(F.abs(value) + 0.5).cast("long"))
    west = F.regexp_replace(whole, r"\B(?=(\d{3})+\z)", ",")
    head = F.regexp_replace(F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0))), r"\B(?=(\d{2})+\z)", ",")
    east = F.when(F.length(whole) > 3, F.concat(head, F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    sign = F.when(value <= -0.5, "-").otherwise("")
    return F.when(unit == "INR", F.concat(sign, F.lit("₹"), east)).otherwise(F.concat(sign, F.lit("$"), west))


# --- word sets and citations ------------------------------------------------------------------------


def word_set(text: Column, longer_than: int = 2) -> Column:
    """Distinct words of more than so many characters, in lower case, without punctuation."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", ""), r"\s+"), lambda w: F.length(w) > longer_than))


def grams(text: Column, sizes: Column) -> Column:
    """The distinct runs of letters of a text that are of one of the sizes, an array."""
    n = F.length(text)
    runs = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda k: k <= n), runs)))


def overlap_pct(claim: Column, text: Column, upto: int = 2000) -> Column:
    """Share of the claim's words that the first characters of text have, in rounded percent; 0 if either has no words."""
    return overlap_of_sets(word_set(claim), word_set(F.substring(text, 1, upto)))


def overlap_of_sets(a: Column, b: Column) -> Column:
    """The same of two word sets, for where many pairs share a side."""
    share = F.floor(100 * F.size(F.array_intersect(a, b)) / F.size(a) + 0.5)
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), share), F.lit(0)).cast("int")


#: Abbreviations of citations and what they stand for, in order; words written out are not taken for them. Fixed values.
CITATION_STEPS = (
    (r"(?i)\bSec(?![A-Za-z])\.?\s*", "Section "),
    (r"(?i)\bS\.\s*", "Section "),
    (r"(?i)\bArt(?![A-Za-z])\.?\s*", "Article "),
    (r"(?i)\bReg(?![A-Za-z])\.?\s*", "Regulation "),
    (r"(?i)\bCl(?![A-Za-z])\.?\s*", "Clause "),
)
SECTION_WORDS = "Section|Article|Rule|Regulation|Schedule|Clause|Order"
SECTION = rf"(?i)({SECTION_WORDS})\s+(\d+[A-Z]?(?:\(\d+\))?(?:\([a-z]\))?)"
CHUNK = r"(?i)\s*\(Chunk\s+\d+(?:/\d+)?\)"


def normalise_citation(hint: Column, act: Column) -> Column:
    """"Section X of Act": abbreviations written out, chunk marks and dashes dropped, the act added to a bare section."""
    long = F.regexp_replace(rewrite(hint, CITATION_STEPS), CHUNK, "")
    long = F.trim(F.regexp_replace(long, r"^\s*[-–—]\s*|\s*[-–—]\s*\z", ""))
    named = F.contains(F.lower(long), F.trim(F.split_part(F.lower(act), F.lit(","), F.lit(1))))
    bare = long.rlike(rf"(?i)^({SECTION_WORDS})\s+\d")
    return F.when((act != "") & ~named & bare, F.concat(long, F.lit(" of "), act)).otherwise(long)


def cited_section(*fields: Column) -> Column:
    """The first section named in the first field that names one, as "Section 27"; null if none does."""
    found = []
    for f in fields:
        long = rewrite(F.coalesce(f, F.lit("")), CITATION_STEPS)
        kind, number = F.regexp_extract(long, SECTION, 1), F.regexp_extract(long, SECTION, 2)
        found.append(F.when(number != "", F.concat(F.initcap(kind), F.lit(" "), number)))
    return F.coalesce(*found)


def summary(content: Column, longest: int = 250) -> Column:
    """The first characters of a text up to its last full stop beyond half of them, else cut with three dots."""
    flat = collapse(content)
    head = F.substring(flat, 1, longest)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    cut = F.when(F.contains(head, F.lit(".")) & (stop - 1 > longest * 0.5), F.substring(head, F.lit(1), stop)).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(flat) <= longest, flat).otherwise(cut)


# --- names ------------------------------------------------------------------------------------------

#: City (or the code of its municipality), state and municipality, in order of precedence. Fixed values.
CITIES = (
    ("bengaluru", "Karnataka", "BBMP"), ("bangalore", "Karnataka", "BBMP"), ("mumbai", "Maharashtra", "BMC"), ("bombay", "Maharashtra", "BMC"),
    ("pune", "Maharashtra", "PMC"), ("new delhi", "Delhi", "NDMC"), ("delhi", "Delhi", "NDMC"), ("gurugram", "Haryana", "MCG"),
    ("gurgaon", "Haryana", "MCG"), ("noida", "Uttar Pradesh", "NOIDA"), ("hyderabad", "Telangana", "GHMC"), ("chennai", "Tamil Nadu", "GCC"), ("madras", "Tamil Nadu", "GCC"),
)
STATES = ("Karnataka", "Maharashtra", "Delhi", "Tamil Nadu", "Gujarat", "Haryana", "Telangana", "Uttar Pradesh")


def first_match(cases, default: Column) -> Column:
    """The value of the first (condition, value) that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(list(cases)), default)


def resolve_jurisdiction(raw: Column) -> Column:
    """(state, municipality) of a place: a city first, then a state, else Central."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    place = lambda state, body: F.struct(F.lit(state).alias("state"), F.lit(body).cast("string").alias("municipality"))
    cities = [(F.contains(low, F.lit(city)) | F.contains(low, F.lit(body.lower())), place(state, body)) for city, state, body in CITIES]
    states = [(F.contains(low, F.lit(s.lower())), place(s, None)) for s in STATES]
    return first_match(cities + states, place("Central", None))


def redact_url(url: Column) -> Column:
    """Scheme, host and port of a URL; a placeholder for what is none."""
    parts = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#@\s]+)", k)
    return F.when(parts(2) != "", F.concat(F.lower(parts(1)), F.lit("://"), F.lower(parts(2)))).otherwise("<invalid url>")


def identifier(text: Column) -> Column:
    """Letters, digits, white space, hyphen and underscore only."""
    return F.regexp_replace(text, r"[^a-zA-Z0-9\s_-]", "")


def garbled_act(name: Column) -> Column:
    """Whether an act's name looks like running text: very long, or opened by a small letter or a digit."""
    return (F.length(name) > 100) | name.rlike("^[a-z0-9]")


def act_title(name: Column) -> Column:
    """A name for a garbled act: what it says it is called, else its first five words."""
    called = F.regexp_extract(name, r"called the ([A-Z][^.]*? Act, \d{4})", 1)
    return F.when(called != "", called).otherwise(F.concat(F.array_join(F.slice(F.split(collapse(name), " "), 1, 5), " "), F.lit("...")))


def windows_of(text: Column, size: int, upto: int | None = None) -> Column:
    """Slices of so many characters, of the first characters only if upto is given."""
    held = F.substring(text, 1, upto) if upto else text
    starts = F.when(F.length(held) > 0, F.sequence(F.lit(1), F.length(held), F.lit(size)))
    return F.coalesce(F.transform(starts, lambda s: F.substring(held, s, F.lit(size))), F.array().cast("array<string>"))


def ends_of(text: Column, first: int = 20_000, last: int = 5_000, needed: str = r"(?i)governing law") -> Column:
    """The first characters, and the last ones too if the first do not have what is needed."""
    head, tail = F.substring(text, 1, first), F.right(text, F.lit(last))
    return F.when(head.rlike(needed) | (F.length(text) <= first), head).otherwise(F.concat(head, F.lit("\n...\n"), tail))


def windows_at(text: Column, header: str = r"(?i)(?=\bdefinitions\b)", size: int = 15_000) -> Column:
    """Slices of so many characters, each beginning at a header that no slice before it covers."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("end"), F.array().cast("array<int>").alias("starts"), F.lit(True).alias("first"))

    def add(acc: Column, part: Column) -> Column:
        opens = (~acc["first"] | part.rlike("^" + header)) & (acc["pos"] >= acc["end"])
        return F.struct(
            (acc["pos"] + F.length(part)).alias("pos"), F.when(opens, acc["pos"] + size).otherwise(acc["end"]).alias("end"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["pos"]))).otherwise(acc["starts"]).alias("starts"), F.lit(False).alias("first"),
        )

    return F.transform(F.aggregate(F.split(text, header), start, add, lambda acc: acc["starts"]), lambda s: F.substring(text, s + 1, F.lit(size)))
