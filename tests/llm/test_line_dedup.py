"""Line dedup against a plain comparison of all windows."""

import random
import re

from ledgerloom.llm import line_dedup

SCHEMA = "doc_id long, text string, gone string, pos int, words int"


def brute(docs: list[tuple[int, str]], least: int) -> dict[int, str]:
    spans = []
    for i, text in docs:
        lines = [(p, line, len(re.findall(r"[^\x20\x09-\x0D]+", line))) for p, line in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[2]]
        for k in range(len(lines)):
            for step in (1, -1):
                j, n = k, 0
                while 0 <= j < len(lines):
                    n += lines[j][2]
                    if n >= least:
                        part = lines[min(k, j) : max(k, j) + 1]
                        spans.append((tuple(x[1] for x in part), i, part[0][0], part[-1][0]))
                        break
                    j += step
    first = {}
    for key, i, a, _ in spans:
        first[key] = min(first.get(key, (i, a)), (i, a))
    gone = {(i, p) for key, i, a, b in spans if (i, a) > first[key] for p in range(a, b + 1)}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs if t is not None}


def test_against_all_windows(spark):
    rng = random.Random(2)
    lines = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(30)] + ["", "  "]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 25)))) for k in range(120)]
    for least in (1, 7, 12):
        frame = spark.createDataFrame([(*d, "clash", 1, 2) for d in docs], SCHEMA)
        found = line_dedup.dedup(frame, min_words=least)
        assert found.columns == [*frame.columns, "_n_lines", "_n_deleted"]
        assert {r["doc_id"]: r["text"] for r in found.collect()} == brute(docs, least)


def test_passages_go_once_and_clean_documents_stay(spark):
    passage = " ".join(f"word{k}" for k in range(55))
    short = " ".join(f"word{k}" for k in range(20))
    docs = [(1, f"one\n{passage}\nend one"), (2, f"two\n{passage}\nend two"), (3, f"{short}\nthree"), (4, f"{short}\nfour"), (5, passage)]
    got = {r["doc_id"]: (r["text"], r["_n_deleted"]) for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("two\nend two", 1), 3: (docs[2][1], 0), 4: (docs[3][1], 0), 5: ("", 1)}


def test_odd_rows(spark):
    long = " ".join(["w"] * 60)
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (None, long), (4, long), (4, long), (5, "\n".join(["x " * 20] * 2000))]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r["_n_deleted"] for r in got if r["doc_id"] == 4} == {1}  # both alike: repeats of the row without an id
    assert [r["text"] for r in got if r["doc_id"] in (1, 2, 3)].count(None) == 1
    assert [r["text"] for r in got if r["doc_id"] == 5][0].startswith("x x")
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
