"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score.

Base kinds (email, ip, card, phone) are confirmed by their own rule alone and always stay. Added kinds are proposed by a
pattern, confirmed by a checksum where one exists (iban: mod 97 over its country's length; card13: Luhn over 13 digits), and kept when their score
reaches THRESHOLD: a kind's base score, plus CONTEXT_GAIN when one of its context words stands within CONTEXT_CHARS
characters before it. An added span that overlaps a base span, or an added span found earlier, is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_arrow, table

BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.6
CONTEXT_GAIN = 0.4
CONTEXT_CHARS = 60


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")
#: kind: (pattern, score without context, context words). Patterns have bounded length, so scanning is linear.
ADDED = {
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), 0.7, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    "card13": (re.compile(r"(?<![0-9A-Za-z-])4[0-9]{12}(?![0-9A-Za-z-])"), 0.3, ("card", "visa", "credit", "karte", "carte", "tarjeta")),
    "ssn": (re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"), 0.4, ("ssn", "social security", "security number")),
}


#: Characters of an IBAN by country, of the registry and of the countries that use the form without being in it. Fixed values.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE IM JE GG ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
        26: "IR IS TR DZ", 27: "BI CF CG CM DJ FR GA GF GP GQ GR IT KM MC MG MQ MR NC PF PM RE SM TD TF WF YT", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
        29: "BR EG PS QA UA YE", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if not k & 1 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Country and check digits go to the end, letters count 10 to 35; the remainder by 97 must be 1."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address is the run of local characters before an @, as far back as the last match's end, and the domain after it.

    This gives the leftmost matches of the pattern in linear time, however long a run of local characters is.
    """
    at, floor = text.find("@"), 0
    while at >= 0:
        start, stop = at, max(floor, 0)
        while start > stop and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(at + 1, floor))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Dotted runs of numbers, four at a time from the left; fours with a part over 255 are dropped whole."""
    for run in _NUMBERS.finditer(text):
        if run.group().count(".") < 3:
            continue
        at = run.start()
        parts = run.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _DIGITS.finditer(text):
        if found.end() - found.start() < 14:
            continue
        digits = found.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in found.group()) <= 15:
                yield found.span()


def iban_end(proposed: str) -> int:
    """Where the number ends in what the pattern took, which may run on over words in capitals or digits; 0 if none does.

    The country says how long it is; for a country not listed, ends of words are tried from the last one back."""
    length = IBAN_LENGTHS.get(proposed[:2])
    ends = [k for k in range(len(proposed), 14, -1) if k == len(proposed) or proposed[k] == " "]
    for k in ends:
        size = k - proposed.count(" ", 0, k)
        if size >= 15 and size == (length or size) and mod97(proposed[:k]):
            return k
    return 0


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The search goes on where a number ends, or behind the first character of what holds none."""
    pattern, at = ADDED["iban"][0], 0
    while found := pattern.search(text, at):
        end = iban_end(found.group())
        if end:
            yield found.start(), found.start() + end
        at = found.start() + (end or 1)


_BASE_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}
_CONFIRM = {"card13": luhn}


def added(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Spans of an added kind that its checksum, if it has one, confirms."""
    if kind == "iban":
        yield from ibans(text)
        return
    for found in ADDED[kind][0].finditer(text):
        if kind not in _CONFIRM or _CONFIRM[kind](found.group()):
            yield found.span()


def find(text: str | None) -> list[Span]:
    """All spans, by start, then kind as listed. Null and empty texts have none."""
    if not text:
        return []
    spans = []
    digit = _HAS_DIGIT.search(text)
    for kind in BASE:
        if kind == "email" or digit:
            spans += [Span(kind, a, b, 1.0) for a, b in _BASE_FINDERS[kind](text)]
    # Base spans may overlap each other: a span meets one of them if the farthest end of those that start before its end lies
    # behind its start. Added spans never do.
    starts = sorted(s.start for s in spans)
    reach = list(accumulate((s.end for s in sorted(spans, key=lambda s: s.start)), max))
    more: list[tuple[int, int]] = []

    def free(start: int, end: int) -> bool:
        k, m = bisect_left(starts, end), bisect_left(more, (end, 0))
        return not (k and reach[k - 1] > start) and not (m and more[m - 1][1] > start)

    if digit:
        for kind, (_, score, words) in ADDED.items():
            for start, end in added(kind, text):
                before = text[max(0, start - CONTEXT_CHARS) : start].lower()
                total = score + CONTEXT_GAIN * any(w in before for w in words)
                if total >= THRESHOLD and free(start, end):
                    spans.append(Span(kind, start, end, min(total, 1.0)))
                    insort(more, (start, end))
    kinds = [*BASE, *ADDED]
    return sorted(spans, key=lambda s: (s.start, kinds.index(s.kind)))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: _id, spans array of (kind, start, end, score), in code points, end exclusive.

    A narrow map over the rows; null and empty texts have no spans, repeated rows give repeated rows, an empty table
    gives none. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            found = [[s.__dict__ for s in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["_id", "spans"])

    return map_arrow(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), run, f"_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>")


def op10_pii(spark, sf_dir):
    """Personal data of all documents: counts and digest of the base spans, and all spans."""
    listed = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    found = spans(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    of = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("_id").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
