"""The network's gradients, its accuracy on held-out texts, and odd rows."""

import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm import language_id

SYLLABLES = {"aa": "the and ing ion of er".split(), "bb": "der und sch ung ein ß".split(), "cc": "é que ment eau les tre".split()}


def text(rng, lang):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 60)))


def test_gradients():
    net = language_id.Network(3, hidden=4, seed=1)
    net.E, net.U, net.W = (p.astype(float) for p in (net.E, net.U, net.W))
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (3, 7)).astype(np.uint8)
    mask = np.ones((3, 7), np.float32)
    mask[1, 4:] = 0
    args = (x, mask, np.array([0, 1, 2]), np.ones(3, np.float32))
    _, grads = net.gradients(*args)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = net.gradients(*args)[0]
        p[at] = old - step
        down = net.gradients(*args)[0]
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-3


def test_both_layouts_agree():
    net = language_id.Network(4)
    x, mask, _ = language_id.windows(*language_id.text_buffers(pa.array(["héllo " * 50, "a", "xyz" * 43])))
    p = net.run(x, mask)[0]
    assert np.allclose(np.einsum("tnk,nt->nk", p, mask), net.sums(x, mask), atol=1e-3)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(0)
    rows = [(k, text(rng, lang := rng.choice(list(SYLLABLES))), lang, "s", 1.0) for k in range(1200)]
    schema = "doc_id long, text string, lang string, source string, score double"
    docs = spark.createDataFrame([*rows, (5000, None, "aa", "s", 1.0), (5001, "", None, "s", 1.0), (5002, "12 ... \n", "aa", "s", 1.0), (5003, "the " * 30_000, None, "s", 1.0), (5003, "the " * 30_000, None, "s", 1.0)], schema)
    train = docs.filter(~language_id.held_out())
    passages, langs = language_id.sample(train, "doc_id", "text", "lang", per_language=150)
    assert max(map(len, passages)) <= language_id.PASSAGE and 100 < langs.count("aa") < 220
    model = language_id.train(passages, langs, rounds=150)
    got = {r["_id"]: r for r in language_id.identify(docs, model).collect()}
    held = [r["doc_id"] for r in docs.filter(language_id.held_out()).filter("doc_id < 5000").collect()]
    assert len(held) > 200 and np.mean([got[k]["lang_pred"] == rows[k][2] for k in held]) > 0.95
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (5000, 5001, 5002))
    assert got[5003]["lang_pred"] == "aa" and 0 <= got[5003]["score"] <= 1
    none = docs.limit(0)
    assert language_id.train(*language_id.sample(none, "doc_id", "text", "lang")) is None
    assert language_id.identify(none, None).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
