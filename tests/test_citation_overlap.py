"""Overlaps of whole claims with all references, against sets."""

import random
import re

from ledgerloom.operators import citations
from ledgerloom.plans import tables


def words(text):
    return {w for w in re.split(r"\s+", re.sub(r"[^a-z0-9_\s]", "", text.lower())) if len(w) > 2}


def brute(docs, refs):
    found = []
    for i, text in docs:
        for j, ref in refs:
            a, b = words(text or ""), words((ref or "")[:2000])
            found.append((i, j, int(100 * len(a & b) / len(a) + 0.5) if a and b else 0))
    return sorted(found)


def test_all_pairs_of_whole_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["Law,", "of"]) + rng.choice("abcdefgh") * 3 + str(rng.randint(0, 60)) + rng.choice([" of", "", "!"]) for _ in range(n))
    docs = [(k, text(rng.choice([1, 5, 400]))) for k in range(45)] + [(45, None), (46, ""), (47, "a b"), (3, text(9))]
    refs = [(k, text(rng.choice([2, 30, 500]))) for k in range(20)] + [(20, None), (21, "!")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(refs, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for block in (1024, 7):
        monkeypatch.setattr(citations, "REF_BLOCK", block)
        got = sorted(tuple(r) for r in tables.citation_overlap_all(spark, str(tmp_path)).collect())
        assert got == brute(docs, refs)


def test_no_references(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert citations.overlaps(docs, spark.createDataFrame([], "item_id long, ref string"), "doc_id", "text", "item_id", "ref").collect() == []
