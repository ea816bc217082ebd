"""Word diffs of whole texts against a table of lengths and against difflib."""

import difflib
import random

from ledgerloom.operators import enrich
from ledgerloom.plans import documents


def longest(x, y):
    row = [0] * (len(y) + 1)
    for w in x:
        new = [0]
        for k, v in enumerate(y):
            new.append(row[k] + 1 if v == w else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_alignment_is_longest():
    rng = random.Random(1)
    for n in (0, 1, 3, 9, 40, 90):
        for letters in ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"):
            for _ in range(20):
                x, y = ([rng.choice(letters) for _ in range(rng.randint(0, n))] for _ in "xy")
                pairs = enrich.aligned(x, y)
                assert len(pairs) == longest(x, y) and all(x[i] == y[j] for i, j in pairs), (x, y)
                assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
                blocks = difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
                assert len(pairs) >= sum(b.size for b in blocks)
                ops = list(enrich.changes(" ".join(x), " ".join(y)))
                assert [w for op, ws in ops if op != "added" for w in ws] == x and [w for op, ws in ops if op != "removed" for w in ws] == y
                assert all(a[0] != b[0] for a, b in zip(ops, ops[1:], strict=False))


def test_edits_far_into_a_long_text():
    x = [f"w{k}" for k in range(60_000)]
    y = [*x[:30_000], "new", *x[30_001:50_000], *x[50_003:]]
    got = [(op, len(words)) for op, words in enrich.changes(" ".join(x), " ".join(y))]
    assert got == [("same", 30_000), ("removed", 1), ("added", 1), ("same", 19_999), ("removed", 3), ("same", 9_997)]


def test_query_takes_whole_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(enrich, "DIFF_ROWS", 3)
    first = " ".join(f"w{k}" for k in range(500))
    rows = [(1, first), (2, first + " end"), (3, None), (4, "x y"), (6, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in documents.word_diff(spark, str(tmp_path)).collect())
    assert got == [(1, 0, "same", first), (1, 1, "added", "end"), (2, 0, "removed", first + " end"), (3, 0, "added", "x y"), (4, 0, "removed", "x y"), (6, 0, "removed", "x")]
