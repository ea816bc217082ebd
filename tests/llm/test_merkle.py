"""The Merkle manifest against a tree built in memory."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout=8):
    """(root, siblings by level of each leaf, from left to right)."""
    proofs, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, proof in enumerate(proofs):
            run = of[k] // fanout * fanout
            proof.append([nodes[j] if j != of[k] else None for j in range(run, min(run + fanout, len(nodes)))])
        nodes = [sha("".join(nodes[a : a + fanout])) for a in range(0, len(nodes), fanout)]
        of = [k // fanout for k in of]
    return nodes[0], proofs


def brute(rows, fanout=8):
    """(id, leaf, subroot, root, proof) a row; rows are (group, id, leaf)."""
    groups = sorted({g for g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(((i, d) for h, i, d in rows if h == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in groups}
    made = {g: tree([d for _, d in own[g]], fanout) for g in groups}
    root, above = tree([made[g][0] for g in groups], fanout)
    out = []
    for k, g in enumerate(groups):
        for (i, d), proof in zip(own[g], made[g][1], strict=True):
            out.append((i, d, made[g][0], root, sha("".join(x for level in proof + above[k] for x in level if x))))
    return sorted(out, key=repr)


def results(made):
    path = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    found = made.proofs.join(made.subroots.select("tree", merkle.hex_of("digest").alias("subroot")), "tree")
    found = found.select("id", merkle.hex_of("digest").alias("leaf"), "subroot", F.lit(made.root), F.sha2(path, 256), merkle.fold(merkle.hex_of("digest"), "path").alias("folded"))
    rows = [tuple(r) for r in found.collect()]
    assert all(r[-1] == made.root for r in rows)
    return sorted((r[:-1] for r in rows), key=repr)


@pytest.mark.parametrize(("sizes", "fanout", "levels"), [([1], 8, 4), ([1, 8, 9, 64, 65], 8, 1), ([700, 3, 1], 3, 2), ([2] * 30, 2, 3), ([130], 2, 0)])
def test_against_a_tree_in_memory(spark, sizes, fanout, levels):
    rows = [(None if g == 0 else f"g{g}", i * 3, sha(f"{g}:{i}")) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, id long, d string").repartition(5)
    made = merkle.manifest(frame.select("id", merkle.group_key(F.col("g")).alias("tree"), F.unhex("d").alias("digest")), fanout, levels)
    assert results(made) == brute(rows, fanout)


def test_edges(spark):
    rows = [(1, None, None, None, None), (None, "s", "en", 3, "x"), (5, "s", "en", 3, "Text"), (5, "s", "en", 3, "Text"), (5, "s", "en", 4, ""), (2, "s", "é", 1, "ü" * 100_000), (4, "s", "", 0, "a:b")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("tree", F.lit(7)).withColumn("idx", F.lit("x"))
    digest = F.unhex(F.sha2(merkle.leaf_text(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))), 256))
    leaves = frame.select(F.col("doc_id").alias("id"), merkle.group_key(F.col("lang")).alias("tree"), digest.alias("digest"))
    want = [(r[2], r[0], leaf(*r)) for r in rows]
    assert results(merkle.manifest(leaves)) == brute(want)
    none = merkle.manifest(leaves.limit(0))
    assert none.root is None and none.proofs.collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_ranges_meet(seed):
    """Peaks of any cuts of the leaves, merged, are the nodes of the whole; stacks never hold more than a run a level."""
    rng = random.Random(seed)
    n, fanout = rng.randrange(2, 400), rng.choice([2, 3, 8])
    digests = [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(n)]
    cuts = [0, *sorted(rng.sample(range(1, n), min(5, n - 1))), n]
    records = []
    for a, b in zip(cuts, cuts[1:]):
        stack = merkle.Range(n, a, fanout)
        for k in range(a, b):
            records += stack.push(digests[k])
            assert all(len(run) < fanout for run in stack.waiting)
        records += stack.close()
    nodes = {(level, i): d for level, i, d, _ in records}
    assert len(nodes) == len(records)
    level = 0
    while merkle.nodes_in(n, level, fanout) > 1:
        for up in range(merkle.nodes_in(n, level + 1, fanout)):
            members = [nodes[level, i] for i in range(up * fanout, min((up + 1) * fanout, merkle.nodes_in(n, level, fanout)))]
            assert nodes.setdefault((level + 1, up), merkle.digest_of(members)) == merkle.digest_of(members)
        level += 1
    assert nodes[level, 0].hex() == tree([d.hex() for d in digests], fanout)[0]


def test_query_tells_tampered_rows(spark, tmp_path):
    import zlib

    rows = [(k, "s", "en" if k % 3 else None, 5, "Upper" if k % 2 else "lower") for k in range(40)] + [(41, "s", "en", 1, None), (None, "s", "en", 2, "Upper")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in merkle.op12_merkle(spark, str(tmp_path)).collect()}
    for i, _, _, _, text in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        assert got[i]["verified"] == (not (tampered and text == "Upper")) == (got[i]["folded_root"] == got[i]["root"])
    assert {r["verified"] for r in got.values()} == {True, False}
