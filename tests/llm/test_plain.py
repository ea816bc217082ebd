"""The network and the estimation against versions that take one byte and one document at a time."""

import math

import numpy as np
import pyarrow as pa

from ledgerloom.llm import language_id, quality
from ledgerloom.llm.common import table


def plain_network(net, raw):
    """Mean probabilities over the bytes of a text, a byte and a unit at a time; the state starts anew every WINDOW bytes."""
    h, k = net.hidden, len(net.b)
    E, U, W, b = ([p.astype(float).tolist() for p in (net.E, net.U, net.W, net.b)])
    logistic = lambda v: 1 / (1 + math.exp(-v))
    total = [0.0] * k
    for a in range(0, len(raw), language_id.WINDOW):
        part = raw[a : a + language_id.WINDOW]
        states = []
        for d in (0, 1):
            s, seen = [0.0] * h, {}
            for t in range(len(part)) if d == 0 else reversed(range(len(part))):
                g = E[d][part[t]]
                u = [sum(s[i] * U[d][i][j] for i in range(h)) for j in range(3 * h)]
                z = [logistic(g[j] + u[j]) for j in range(h)]
                r = [logistic(g[h + j] + u[h + j]) for j in range(h)]
                c = [math.tanh(g[2 * h + j] + r[j] * u[2 * h + j]) for j in range(h)]
                s = [(1 - z[j]) * s[j] + z[j] * c[j] for j in range(h)]
                seen[t] = s
            states.append(seen)
        for t in range(len(part)):
            both = states[0][t] + states[1][t]
            p = [math.exp(b[j] + sum(both[i] * W[i][j] for i in range(2 * h))) for j in range(k)]
            total = [x + y / sum(p) for x, y in zip(total, p, strict=True)]
    return [x / sum(total) for x in total] if raw else total


def test_network_a_byte_at_a_time():
    net = language_id.Network(3, hidden=4, seed=5)
    texts = ["a", "ß", "Größe und Gewicht " * 3, "x" * language_id.WINDOW, "words of a text " * 20, "", "é" * 200]
    want = [plain_network(net, t.encode()) for t in texts]
    assert np.allclose(language_id.pooled(net, pa.array(texts)), want, atol=1e-5)
    assert all(np.allclose(language_id.pooled(net, pa.array([t])), [w], atol=1e-5) for t, w in zip(texts, want, strict=True))


def test_predictions_are_those_of_the_plain_network(spark):
    langs, net = ["aa", "bb", "cc"], language_id.Network(3, hidden=4, seed=9)
    texts = ["Hello there, all of you", "Ünd so weiter", "123 456", None, "", "ein", "ein"]
    frame = spark.createDataFrame([(k, t, "zz") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["_id"]: r for r in language_id.identify(frame, (langs, net)).collect()}
    for k, t in enumerate(texts):
        if t and any(c.isalpha() for c in t):
            p = plain_network(net, t.encode())
            assert got[k]["lang_pred"] == langs[p.index(max(p))] and abs(got[k]["score"] - max(p)) < 1e-5
        else:
            assert got[k]["lang_pred"] == "und"


def plain_estimation(votes, rounds=200, prior=0.8, smooth=2.0):
    """Posteriors of documents, which are visited one by one in each round."""
    kinds, start = (-1, 0, 1), quality.START.tolist()
    n = len(votes[0])
    likely = [[list(start[c]) for c in (0, 1)] for _ in range(n)]
    share, posterior = prior, [prior] * len(votes)
    for _ in range(rounds):
        new = []
        for own in votes:
            odds = math.log(share) - math.log(1 - share)
            for r, v in enumerate(own):
                odds += math.log(likely[r][1][kinds.index(v)]) - math.log(likely[r][0][kinds.index(v)])
            new.append(1 / (1 + math.exp(-max(-700, min(700, odds)))))
        share = min(0.99, max(0.01, (sum(new) + prior) / (len(votes) + 1)))
        for r in range(n):
            seen = [[smooth * start[c][k] for k in range(3)] for c in (0, 1)]
            for own, p in zip(votes, new, strict=True):
                seen[0][kinds.index(own[r])] += 1 - p
                seen[1][kinds.index(own[r])] += p
            likely[r] = [[x / sum(row) for x in row] for row in seen]
            if likely[r][0][1] < likely[r][1][1]:
                likely[r] = [[(x + y) / 2 for x, y in zip(*likely[r], strict=True)]] * 2
        moved = max(abs(a - b) for a, b in zip(new, posterior, strict=True))
        posterior = new
        if moved < 1e-9:
            break
    return posterior


def test_verdicts_a_document_at_a_time(spark):
    rows = quality.judge(table(spark, "/root/testdata/sf0.001", "documents")).collect()
    want = plain_estimation([[int(v) for v in r["votes"].split(",")] for r in rows])
    assert len(rows) == 200 and {r["kept"] for r in rows} == {True, False}
    for r, p in zip(rows, want, strict=True):
        assert abs(r["posterior"] - p) < 1e-6 and r["kept"] == (not r["base_failed"] and p >= 0.5)
