"""Decontamination against brute force, and the index by itself."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import decontamination as dc


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(docs, items, window=10):
    wins = []
    for item, text in items:
        w = [x for x, _, _ in words(text)]
        wins += [(item, w[k : k + window]) for k in range(max(1, len(w) - window + 1)) if w]
    out = []
    for doc, text in docs:
        w = words(text)
        plain = [x for x, _, _ in w]
        hit, found = set(), set()
        for item, win in wins:
            for k in range(len(plain) - len(win) + 1):
                if plain[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found |= {item} - {None}
        spans = []
        for k in sorted(hit):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out.append((doc, len(w), len(hit), sorted(found), [(a, b, w[a][1], w[b - 1][2]) for a, b in spans]))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "7", "été", "ΔX", "delta's", "om-ega"]
    text = lambda n: rng.choice([" ", "  ", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(14)) for k in range(6)] + [(90, "Beta gamma gamma"), (91, "7"), (92, ""), (93, None), (94, "..., !"), (None, text(12)), (3, text(11)), (95, text(400))]
    docs = [(k, text(rng.randrange(60))) for k in range(40)]
    docs += [(100 + k, text(9) + " " + (items[k][1] or "") + " " + text(5)) for k in range(len(items))]
    docs += [(200, None), (201, ""), (202, "--"), (203, items[0][1].upper()), (203, items[0][1]), (None, items[1][1]), (204, (items[2][1] + " and so on ") * 40), (205, "x" * 5000)]
    return docs, items


@pytest.mark.parametrize("block_pairs", [dc.BLOCK_PAIRS, 90])
def test_against_brute_force(spark, block_pairs):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, shard int").repartition(3)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = [(r["_id"], r["n_words"], r["n_hit"], sorted(r["items"]), [tuple(s) for s in r["spans"]]) for r in dc.contamination(d, b, block_pairs=block_pairs).collect()]
    assert sorted(got, key=repr) == brute(docs, items)
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.contamination(d.limit(0), b).collect() == []
    assert [tuple(r) for r in dc.contamination(d, b.limit(0)).collect()] == [(1, 2, 0, [], [])]
    assert [r["n_hit"] for r in dc.contamination(d, b).collect()] == [2]


def test_removal(spark):
    d = spark.createDataFrame([(1, "Ünd one, Two three. rest"), (2, "clean"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two THREE")], "item_id long, text string")
    found = dc.contamination(d, b).join(d, d["doc_id"] == dc.F.col("_id"))
    assert {r["doc_id"]: r["t"] for r in found.select("doc_id", dc.without("text", "spans").alias("t")).collect()} == {1: "Ünd . rest", 2: "clean", 3: None}


@pytest.mark.parametrize("seed", range(4))
def test_index(seed):
    rng = np.random.default_rng(seed)
    counts = np.array([0, 5, 40, 0, 200, 200, 1, 64, 0])
    alphabet = rng.integers(0, 2**64, 3 if seed else 1, dtype=np.uint64)
    sequence = alphabet[rng.integers(0, len(alphabet), counts.sum())]
    index = dc.Index.load(dc.Index(sequence, counts).dump())
    owner = np.repeat(np.arange(len(counts)), counts)
    for k in (1, 2, 7):
        phrases = np.unique(alphabet[rng.integers(0, len(alphabet), (20, k))], axis=0)
        which, at = index.find(phrases)
        want = {(p, i) for p in range(len(phrases)) for i in range(len(sequence) - k + 1) if owner[i] == owner[i + k - 1] and (sequence[i : i + k] == phrases[p]).all()}
        assert len(which) == len(want) and set(zip(which.tolist(), at.tolist())) == want


def test_one_document_in_several_indexes(monkeypatch):
    """A document longer than two shards is indexed in pieces that overlap; words that long are hashed in steps."""
    monkeypatch.setattr(dc, "SHARD_WORDS", 50)
    docs, items = cases()
    docs = [(1, " ".join(t or "" for _, t in docs)), (2, "a"), (3, "b c")]
    pairs = [(i, w[k : k + 10]) for i, t in items for w in [[x for x, _, _ in words(t)]] for k in range(max(1, len(w) - 9)) if w]
    hashes = lambda ws: dc.hashed_words(*dc.text_buffers(pa.array([" ".join(ws)])))[0].view(np.int64).tolist()
    phrases = dc.Phrases.of(pa.table({"item": pa.array([i for i, _ in pairs], pa.int64()), "words": pa.array([hashes(w) for _, w in pairs], pa.list_(pa.int64()))}))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["_id", "_text"])
    got = []
    for t in dc.read(iter([batch])):
        found = [(w, at + base) for base, index in t.indexes() for w, at in [phrases.find(index)]]
        found = tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))
        for a, b, (hits, listed, spans) in dc.results(found, phrases, t.counts, t.starts, t.ends):
            for d in range(a, b):
                got.append((t.ids[d].as_py(), int(t.counts[d]), hits[d - a].as_py(), sorted(listed[d - a].as_py()), [tuple(s.values()) for s in spans[d - a].as_py()]))
    assert sorted(got, key=repr) == brute(docs, items)
    raw = ("word " * 300_000 + "é" * 1_500_000).encode()
    h, s, e, _ = dc.hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(h) == 300_001 and len(set(h[:-1].tolist())) == 1 and (e[-1] - s[-1]) == 3_000_000
