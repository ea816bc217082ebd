"""Base counts against a plain count, estimation against known rules, and the handling of odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import common, quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)]


def test_counts_equal_a_plain_count():
    rng = random.Random(0)
    texts = [None, "", " ", "\n\n", "a", "é ñ x", "x " * 40_000]
    texts += ["".join(rng.choice("ab \n#é日") for _ in range(rng.randint(0, 120))) for _ in range(3000)]
    got = quality.counts(pa.array(texts))
    assert np.stack([got[c] for c in quality.BASE], 1).tolist() == [brute(t) for t in texts]


def test_estimation_finds_the_bad_and_reliable_rules():
    rng = np.random.default_rng(1)
    good = rng.random(5000) < 0.7
    fires = [(0.6, 0.02), (0.5, 0.01), (0.4, 0.05), (0.3, 0.3)]  # the last says nothing
    votes = np.stack([np.where(rng.random(5000) < np.where(good, b, a), 0, 1) for a, b in fires], 1)
    patterns, back, weights = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, likely, posterior = quality.estimate(patterns, weights.astype(float))
    assert abs(share - 0.7) < 0.1
    right = ((posterior[back.ravel()] >= 0.5) == good).mean()
    assert right > 0.88 and likely[0, 0, 1] > 0.4 and abs(likely[3, 0, 1] - likely[3, 1, 1]) < 0.1


SCHEMA = "doc_id long, text string, votes string, posterior double, kept int"
GOOD = " ".join(f"Word{k} of the sentence goes on, and on." for k in range(12))
JUNK = " ".join(f"w{k}### of$$$ the%%%" for k in range(30))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, f"{GOOD} {k}", "v", 1.0, k) for k in range(40)] + [(100 + k, JUNK, None, None, None) for k in range(4)] + [(200, None, "v", 1.0, 1), (201, "", "v", 1.0, 1), (202, "few words", "v", 1.0, 1), (0, f"{GOOD} 0", "v", 1.0, 0), (None, GOOD, "v", 1.0, 0)], SCHEMA)


def test_judge(rows):
    got = {r["_id"]: r for r in quality.judge(rows).collect()}
    assert quality.judge(rows).count() == rows.count()
    assert all(got[k]["kept"] for k in range(40)) and not any(got[k]["kept"] for k in (100, 101, 200, 201, 202))
    assert got[200]["base_failed"] and got[200]["n_words"] == 0 and not got[100]["base_failed"]


def test_keep_has_the_same_rows_and_all_columns(rows, spark):
    kept = quality.keep(rows)
    assert kept.columns == rows.columns and kept.schema["kept"].dataType == rows.schema["kept"].dataType
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["_id"] or -1 for r in quality.judge(rows).filter("kept").collect())
    none = spark.createDataFrame([], SCHEMA)
    assert quality.keep(none).collect() == [] and quality.judge(none).collect() == []


def test_long_texts_are_counted_alike_in_steps(monkeypatch):
    rng = random.Random(7)
    texts = ["\n".join(" ".join(rng.choice(["a", "bb", "c#", "THE", "Élan", "word"]) for _ in range(rng.randint(0, 12))) for _ in range(60)) for _ in range(8)]
    texts += ["x" * 900 + " y", "\n".join(["q " * 20] * 50), "z" * 700, "line\n" * 80, " " * 300 + "#" * 300]
    want = quality.counts(pa.array(texts))
    monkeypatch.setattr(common, "STEP_BYTES", 64)
    for k, text in enumerate(texts):
        assert {c: x[0] for c, x in quality.counts(pa.array([text])).items()} == {c: x[k] for c, x in want.items()}
