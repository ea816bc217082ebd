"""Mixing against a brute-force version that follows the rules step by step."""

import random
import re

import pytest

from ledgerloom.llm import mixing


def brute_targets(sizes: dict, share=1.5, weights=(3, 1, 2)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(sizes), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target.update((s, level * weight[s]) for s in open_)
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= over
    return target


SCHEMA = "doc_id long, text string, source string, size string, taken int"


def mix(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return [r.asDict() for r in mixing.queue(docs).collect()]


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_amounts(spark, seed):
    rng = random.Random(seed)
    names = [None, "a", "b", "c", "é", "hot"]
    rows = [(k, " ".join(["w"] * rng.randint(0, 9)), rng.choice([*names, *["hot"] * 4])) for k in range(400)]
    got = mix(spark, rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"\S+", text))
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for source in sizes:
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {sizes[source]}
        assert own[0]["target"] == pytest.approx(want[source])
        assert sum(r["rounds"] * r["size"] for r in own) == pytest.approx(want[source], abs=15)
    assert sum(r["rounds"] * r["size"] for r in got) <= 1.5 * sum(sizes.values())
    assert all(0 <= r["rounds"] <= 2 and (r["size"] or not r["rounds"]) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix(spark, rows[::-1])))


def test_edge_cases(spark):
    assert mix(spark, []) == []
    got = mix(spark, [(1, None, "a"), (2, "", None), (3, " \t\n", "a")])
    assert [(r["size"], r["rounds"], r["target"]) for r in got] == [(0, 0, 0.0)] * 3
    twice = mix(spark, [(1, "x y z", "a"), (1, "x y z", "a"), (None, "q", "b"), (2, "word " * 50_000, "a")])
    assert len(twice) == 4 and len({r["rounds"] for r in twice if r["_id"] == 1}) == 1
