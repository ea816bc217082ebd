"""Whitening against a covariance in memory."""

import math

import numpy as np
import pytest

from ledgerloom.llm import whitening as wh


def integers(v):
    return [math.floor(1024 * float(c)) + 100_000 for c in v]


def brute(vectors, k=8):
    """(n, deviations, whitened up to signs, variances, trace) of sound vectors of one length."""
    x = np.array([integers(v) for v in vectors], object)
    n, s = len(x), x.sum(0)
    diff = n * x - s
    c = diff.astype(float) / n
    values, directions = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    return n, (diff**2).sum(1).tolist(), c @ directions[:, order] / np.sqrt(values[order]), values[order], values.sum()


def rows_of(frame):
    return {(r["_id"], r["dim"]): r for r in frame.collect()}


@pytest.mark.parametrize(("dim", "scale"), [(12, 1.0), (5, 1e6), (3, 1e12)])
def test_against_a_covariance(spark, dim, scale):
    rng = np.random.default_rng(dim)
    data = ((rng.standard_normal((300, dim)) @ rng.standard_normal((dim, dim)) + rng.standard_normal(dim) * 3) * scale).tolist()
    data[7] = data[6]
    rows = [(k, v, 1) for k, v in enumerate(data)]
    odd = [(900, None, 1), (901, [float("nan")] + [0.0] * (dim - 1), 1), (902, [None] + [0.0] * (dim - 1), 1), (903, [float("inf")] * dim, 1), (904, [], 1), (905, [1e300] * dim, 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, dim int").repartition(9)
    models = wh.check(frame, wh.fit(frame))
    assert list(models) == [dim] and models[dim].identity_error < 1e-9
    got = rows_of(wh.transform(frame, models))
    n, deviation, white, values, trace = brute(data)
    assert sorted(i for i, _ in got) == list(range(300))
    assert [int(got[i, dim]["deviation"]) for i in range(300)] == deviation and {r["n"] for r in got.values()} == {n}
    mine = np.array([got[i, dim]["whitened"] for i in range(300)])
    signs = np.sign((mine * white).sum(0))
    assert np.allclose(mine, white * signs, atol=1e-6)
    assert np.allclose(models[dim].variances, values, rtol=1e-9) and math.isclose(models[dim].trace, trace, rel_tol=1e-9)


def test_edges(spark):
    schema = "vec_id string, embedding array<float>, label int"
    lengths = spark.createDataFrame([("a", [1.0, 2.0], 1), ("b", [1.5, 4.0], 1), ("c", [1.0, 2.0, 3.0], 1), (None, [2.0, 1.0, 3.0], 1), ("d", [0.0, 9.0, 3.0], 1)], schema)
    models = wh.check(lengths, wh.fit(lengths))
    got = rows_of(wh.transform(lengths, models))
    assert {d: m.n for d, m in models.items()} == {2: 2, 3: 3} and set(got) == {("a", 2), ("b", 2), ("c", 3), (None, 3), ("d", 3)}
    # Two rows vary along one direction, and the third entry of the others not at all.
    assert [x is None for x in got["a", 2]["whitened"]] == [False, True] and math.isclose(abs(got["a", 2]["whitened"][0]), 1)
    assert got["c", 3]["whitened"][2] is None and models[2].identity_error < 1e-9
    one = lengths.limit(1)
    models = wh.check(one, wh.fit(one))
    assert rows_of(wh.transform(one, models))["a", 2]["whitened"] == [None, None] and models[2].identity_error is None
    none = lengths.limit(0)
    assert wh.fit(none) == {} and wh.transform(none, {}).collect() == []


def test_factors_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((500, 6)) @ rng.standard_normal((6, 6))
    parts = [wh.add_rows(None, p) for p in np.array_split(rows, 7)]
    merged = (0, parts[0])
    for p in parts[1:]:
        merged = wh.merge_factors(6, merged, (0, p))
    assert np.allclose(np.linalg.svd(merged[1])[1], np.linalg.svd(rows)[1])
    states = [wh.moments(p) for p in np.array_split(rows, 7)]
    whole = wh.moments(rows)
    for s in states[1:]:
        states[0] = wh.merge_moments(6, states[0], s)
    assert states[0][0] == 500 and np.allclose(states[0][1], whole[1])


def test_query(spark):
    import duckdb

    got = wh.op13_whitening(spark, "/root/testdata/sf0.001").collect()
    vectors = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.001/embeddings.parquet' ORDER BY vec_id").fetchall()
    n, deviation, white, values, trace = brute([v for _, v in vectors])
    at = {i: k for k, (i, _) in enumerate(vectors)}
    assert len(got) == 8 * n
    mine = np.zeros((n, 8))
    for r in got:
        mine[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[at[r["vec_id"]]] and r["identity_error"] < 1e-4
        assert math.isclose(r["explained"], values[r["component"] - 1] / trace, rel_tol=1e-6)
    assert np.allclose(mine, white * np.sign((mine * white).sum(0)), atol=1e-6)
