"""Zones of the nearest vector among all others, against every pair."""

import random

from ledgerloom.plans import tables


def test_every_other_vector_is_searched(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], k % 3) for k in range(160)]
    rows[7] = (7, rows[50][1], 0)
    rows[9] = (9, rows[50][1], 0)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")

    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    want = []
    for i in range(0, 160, 50):
        score, j = max((round(cosine(rows[i][1], v), 12), -k) for k, v, _ in rows if k != i)
        want.append((i, -j, "hit" if score >= 0.5 else "ask" if score >= 0.3 else "none"))
    got = sorted(tuple(r) for r in tables.argmax_zone_all(spark, str(tmp_path)).collect())
    assert got == want and got[1] == (50, 7, "hit") and all(j % 17 != 1 for _, j, _ in want[1:2])
