"""The n-gram join, the vector join and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import common, embedding_dedup, ngram_join
from ledgerloom.llm.common import Scratch
from ledgerloom.llm.components import connected_components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500 + k, 501 + k) for k in range(60)] + [(900, 901 + k) for k in range(200)]
    frame = spark.createDataFrame([(a, b) for a, b in links] + [(7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame, Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == {n: r for n, r in roots({n for p in real for n in p}, real).items()}
    assert connected_components(frame.limit(0), Scratch(spark, "t")).collect() == []


def shingles(text, n=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return roots({i for i, _ in rows}, links), {i: len(s) for i, s in sets}


def check(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "doc_id long, text string, size int, id string, hub int")
    got = ngram_join.components(frame, **more).collect()
    classes, sizes = brute_classes(rows)
    assert sorted((r["_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((i, sizes[i], classes[i]) for i, _ in rows)


def test_near_copies_chains_and_shared_passages(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], fresh(60)
    for g in range(12):
        text = fresh(rng.randint(20, 120))
        for _ in range(rng.choice([1, 2, 6, 30])):
            rows.append(list(text))
            if rng.random() < 0.7:
                text = list(text) if g % 2 else rows[-1]
                for _ in range(rng.randint(0, 3)):
                    text[rng.randrange(len(text))] = rng.choice(words)
    rows += [passage + fresh(rng.randint(10, 60)) for _ in range(40)]
    rows += [fresh(rng.randint(0, 8)) for _ in range(40)]
    texts = [(k, rng.choice([" ", "\n"]).join(w)) for k, w in enumerate(rows)]
    rng.shuffle(texts)
    monkeypatch.setattr(ngram_join, "COLUMN_ROWS", 8)
    monkeypatch.setattr(ngram_join, "STAR_ROWS", 4)
    check(spark, texts)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)  # every link by pairs across
    check(spark, texts)


def test_product_adds_up_over_pieces(monkeypatch):
    """Rows of different length, cut finer the longer they are, against overlaps of whole sets."""
    monkeypatch.setattr(ngram_join, "PIECE_BITS", 4)
    monkeypatch.setattr(ngram_join, "DENSE_COLUMNS", 8)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(w if rng.random() > 0.02 else rng.choice(base) for w in base[: 150 - 3 * k]) for k in range(7)]
    sets = ngram_join.ngram_sets(pa.array(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(texts)], ["id", "text"])
    pieces = [r for b in ngram_join._pieces(iter([batch]), 5) for r in b.to_pylist()]
    assert len(pieces) > 20
    bits = max(0, int(0.8 * len(sets[0])).bit_length() - 4)
    rows = sorted((1, 0, r["start"] >> 30 - bits, r["id"], r["start"], r["size"], r["grams"]) for r in pieces for _ in range(2))
    kinds = [pa.int64()] * 6 + [pa.binary()]
    at = [0, 1, 2, 3, 5, 4, 6]
    found = []
    for percent in (20, 60, 80, 100):
        batches = (pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + 5]], kinds[k]) for k in at], list("abcdefg")) for a in range(0, len(rows), 5))
        got = [(r["a"], r["b"]) for b in ngram_join._product(batches, percent) for r in b.to_pylist()]
        want = [(i, j) for i in range(7) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j]))]
        assert roots(range(7), got) == roots(range(7), want)
        found.append(len(set(roots(range(7), got).values())))
    assert found[0] == 1 < found[-1]


def test_long_texts_hash_alike_in_steps(monkeypatch):
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab  \n") for _ in range(3000)), "x" * 1000, " " * 500 + "y" * 700 + " z", "é" * 400]
    whole = [common.word_hashes(*common.text_buffers(pa.array([t]))) for t in texts]
    monkeypatch.setattr(common, "STEP_BYTES", 64)
    for t, (hashes, count) in zip(texts, whole, strict=True):
        got, n = common.word_hashes(*common.text_buffers(pa.array([t])))
        assert got.tolist() == hashes.tolist() and n.tolist() == count.tolist() == [len(t.split())]


def test_odd_texts(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    check(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (7, long), (8, long + " y"), (9, "a b c d e"), (10, "A B C D E"), (11, "a b c d é")])
    twice = ngram_join.components(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (3, "q w e r t z")], "doc_id long, text string")).collect()
    assert sorted((r["_id"], r["component_id"]) for r in twice) == [(1, 1), (1, 1), (3, 3)]
    assert ngram_join.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 16))
    rows = []
    for k in range(600):
        v = base[k % 30] + (0.0 if k % 7 == 0 else 1.0) * rng.standard_normal(16) * rng.choice([0.01, 0.05, 0.09])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 3) if k % 50 else None))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [float("inf")] + [1.0] * 15, 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [None] + [1.0] * 15, 1)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, links int")
    got = {r["_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame).collect()}
    sound = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for k, (a, x, g) in enumerate(sound) for b, y, h in sound[k + 1 :] if g == h and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    comp = roots(set(count), links)
    assert len(links) > 500 and got == {i: (count[i], comp[i]) for i in count}
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_vectors_of_any_scale(spark):
    """Products of tiny and of huge components neither link what is orthogonal nor part what is parallel."""
    rows = [(1, [1e-200, 0.0], 1), (2, [0.0, 1e-200], 1), (3, [1e200, 0.0], 1), (4, [0.0, 1e200], 1), (5, [2e-200, 1e-203], 1), (6, [5e-324, 0.0], 1)]
    got = {r["_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 3: (3, 1), 5: (3, 1), 6: (3, 1), 2: (1, 2), 4: (1, 2)}


def test_tables_reach_the_recall():
    for n in (10, 10**4, 10**8, 10**11):
        bits, tables = embedding_dedup.plan_tables(n)
        meet = (1 - np.arccos(0.98) / np.pi) ** bits
        assert 1 - (1 - meet) ** tables >= embedding_dedup.RECALL and tables < 2000
