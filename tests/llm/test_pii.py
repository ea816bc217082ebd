"""Base spans against the patterns as they stand, added spans by example."""

import random
import re

from ledgerloom.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and pii.luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]
    return sorted(spans, key=lambda s: (s[1], pii.BASE.index(s[0])))


def base(text):
    return [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE]


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    for alphabet in ("ab@.@-. 1é", "12.34.5 .", "0123456789 -", "+1 ().-23456789", "a@b.c@d.e+1"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
            assert base(text) == brute(text), text


def test_checksums_context_and_overlap():
    kinds = lambda t: [s.kind for s in pii.find(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01 ok") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("lot 123-45-6789") == []
    assert kinds("visa card 4222222222222") == ["card13"] and kinds("lot 4222222222222") == []
    assert kinds("4111 1111 1111 1111") == ["card"] and kinds("4111 1111 1111 1112") == []
    assert kinds(None) == kinds("") == []
    assert len(pii.find("9" * 200_000)) == 0 and len(pii.find("a" * 200_000 + "@")) == 0


def test_query_shape(spark, tmp_path):
    rows = [(1, "mail a@b.co or 1.2.3.4", "x"), (2, None, "x"), (3, "", "x"), (1, "mail a@b.co or 1.2.3.4", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op10_pii(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["n_email"] for r in got] == [1, 1, 0, 0] and got[0]["spans"] == "email:5:11,ip:15:22" and got[2]["spans"] == ""
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op10_pii(spark, f"{tmp_path}/none").collect() == []


def test_many_spans_take_linear_time_and_do_not_overlap():
    text = " ".join(f"social security number {100 + k % 500}-45-{1000 + k % 9000}, IBAN DE89370400440532013000" for k in range(4000))
    found = pii.find(text)
    assert sum(s.kind == "ssn" for s in found) == sum(s.kind == "iban" for s in found) == 4000
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False) if b.kind not in pii.BASE)
