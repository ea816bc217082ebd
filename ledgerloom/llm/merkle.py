"""A Merkle manifest of a table: a tree of digests a group, a tree over the groups' roots, and a proof for every row.

A tree has the leaves of its group in order; every `fanout` consecutive nodes of a level, the last ones too if they are
fewer, have one parent, the digest of their digests' text, until one node is left.

1. Rows are reduced to their leaf digests and range-sorted; counts a group and partition give each leaf its index.
2. Each stretch of consecutive leaves in a partition goes over a mountain-range stack (Range): a leaf that completes a run
   of fanout carries their digest up a level, and so on. A run that lies within the stretch leaves a node record; nodes
   whose run has members elsewhere are left as open peaks. A level's last run is short, and is hashed as it is.
3. Open peaks merge level by level, grouped by their parent's index: at most fanout rows a group, and as many rows as
   partitions have edges.
4. The roots are the leaves of one more tree, made the same way.
5. A proof is the siblings of each level up to the root. Leaves meet the path above their block of fanout^BLOCK_LEVELS
   leaves, one row a block, and the levels within the block are made again from the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.common import Scratch, map_arrow, table

FANOUT = 8
#: Leaves of a block of proofs are FANOUT to this power.
BLOCK_LEVELS = 4
#: Levels that any tree can have.
MOST_LEVELS = 20

_NODE, _OPEN, _ROOT = 0, 1, 2
PATH = "array<struct<left: string, right: string>>"


# --- digests --------------------------------------------------------------------------------------


def leaf_text(*columns: Column) -> Column:
    """What a leaf is the digest of: each value as its UTF-8 length, a colon and its text, `-` for null."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def fold(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf (as text) and the siblings of its path give."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def hex_of(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def digest_of(parts: list[bytes]) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


# --- trees ----------------------------------------------------------------------------------------


def nodes_in(n: int, level: int, fanout: int) -> int:
    return -(-n // fanout**level)


class Range:
    """The mountain range over consecutive leaves, from index start on, of a tree of n: complete nodes, and peaks that wait for members elsewhere.

    push and close return records (level, index, digest, kind)."""

    def __init__(self, n: int, start: int, fanout: int = FANOUT, records_from: int = 0):
        self.n, self.next, self.fanout, self.records_from = n, start, fanout, records_from
        self.waiting: list[list[tuple[int, bytes]]] = []  # by level: the members so far of the run that is open there

    def push(self, digest: bytes) -> list[tuple[int, int, bytes, int]]:
        out, level, index = [], 0, self.next
        self.next += 1
        while True:
            last = nodes_in(self.n, level, self.fanout) - 1
            if last == 0:
                return [*out, (level, 0, digest, _ROOT)]
            if level == len(self.waiting):
                self.waiting.append([])
            run = self.waiting[level]
            run.append((index, digest))
            if index % self.fanout != self.fanout - 1 and index != last:
                return out
            self.waiting[level] = []
            if run[0][0] % self.fanout:  # it began before this stretch
                return [*out, *((level, i, d, _OPEN) for i, d in run)]
            if level >= self.records_from:
                out += [(level, i, d, _NODE) for i, d in run]
            digest, level, index = digest_of([d for _, d in run]), level + 1, index // self.fanout

    def close(self) -> list[tuple[int, int, bytes, int]]:
        return [(level, i, d, _OPEN) for level, run in enumerate(self.waiting) for i, d in run]


@dataclass
class Tree:
    leaves: DataFrame  # tree, n, idx, digest and what else the leaves had
    nodes: DataFrame  # tree, n, level, idx, digest of the levels from records_from on
    roots: DataFrame  # tree, n, digest
    fanout: int
    records_from: int


_RECORD = "tree string, n long, level int, idx long, digest binary, kind int"


def ranges(batches: Iterator[pa.RecordBatch], fanout: int, records_from: int) -> Iterator[pa.RecordBatch]:
    """Rows (tree, n, idx, digest), leaves mostly in order, to records; any break in the order only leaves more peaks open."""
    own, stack = None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "n", "level", "idx", "digest", "kind"])

    for batch in batches:
        out = []
        for tree, n, idx, digest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if stack is None or (tree, n) != own or idx != stack.next:
                if stack:
                    out += [(*own, *r) for r in stack.close()]
                own, stack = (tree, n), Range(n, idx, fanout, records_from)
            out += [(tree, n, *r) for r in stack.push(digest)]
        if out:
            yield batch_of(out)
    if stack and (rest := stack.close()):
        yield batch_of([(*own, *r) for r in rest])


def indexed(leaves: DataFrame, order: list[Column | str], scratch: Scratch) -> DataFrame:
    """leaves with idx, their place in the order within their tree from 0, and n, the leaves of the tree."""
    ordered = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = scratch.keep(ordered.withColumn("part", F.spark_partition_id()).withColumn("place", place), "ordered")
    runs = ordered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("many"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("many").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("many").over(tree).alias("n"))
    numbered = ordered.join(runs, ["tree", "part"]).withColumn("idx", F.col("shift") + F.col("place")).drop("part", "place", "shift")
    return scratch.keep(numbered.sortWithinPartitions("tree", "idx"), "indexed")


def build(leaves: DataFrame, order: list[Column | str], scratch: Scratch, fanout: int = FANOUT, records_from: int = BLOCK_LEVELS) -> Tree:
    """The trees of leaves (tree string, digest binary, ...), not null both, in the given order; rows that tie are taken to be equal."""
    leaves = indexed(leaves, order, scratch)
    made = map_arrow(leaves.select("tree", "n", "idx", "digest"), lambda b: ranges(b, fanout, records_from), _RECORD)
    made = scratch.keep(made, "records")
    tables, most = [made], leaves.agg(F.max("n")).first()[0] or 0
    level, merged = 0, None
    while nodes_in(most, level, fanout) > 1:
        peaks = made.filter((F.col("kind") == _OPEN) & (F.col("level") == level))
        if merged is not None:
            peaks = peaks.unionByName(merged.filter(F.col("kind") == _OPEN))
        members = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        runs = peaks.groupBy("tree", "n", F.floor(F.col("idx") / fanout).alias("up")).agg(members.alias("m"))
        digest = F.unhex(F.sha2(F.array_join(F.transform("m", lambda x: hex_of(x["digest"])), ""), 256))
        want = F.least(F.lit(fanout), F.ceil(F.col("n") / fanout**level) - F.col("up") * fanout)
        digest = F.when(F.size("m") == want, digest).otherwise(F.raise_error(F.lit("a run of the tree lacks members")).cast("binary"))
        kind = F.when(F.col("n") <= fanout ** (level + 1), _ROOT).otherwise(_OPEN)
        merged = scratch.keep(runs.select("tree", "n", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), digest.alias("digest"), kind.alias("kind")), "merged", 0)
        tables.append(merged)
        level += 1
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    nodes = every.filter((F.col("kind") != _ROOT) & (F.col("level") >= records_from)).drop("kind")
    return Tree(leaves, nodes, every.filter(F.col("kind") == _ROOT).select("tree", "n", "digest"), fanout, records_from)


# --- proofs ---------------------------------------------------------------------------------------


def above(tree: Tree) -> DataFrame:
    """(tree, block, path): the siblings above each block of fanout^records_from leaves, from below."""
    f, k = tree.fanout, tree.records_from
    size = f**k
    blocks = tree.roots.select("tree", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("block"))
    span = F.pow(F.lit(float(f)), F.col("level")).cast("long")
    steps = blocks.withColumn("level", F.explode(F.sequence(F.lit(k), F.lit(max(k, MOST_LEVELS))))).filter(span < F.col("n"))
    steps = steps.withColumn("own", F.floor(F.col("block") / F.pow(F.lit(float(f)), F.col("level") - k).cast("long"))).withColumn("up", F.floor(F.col("own") / f))
    families = tree.nodes.groupBy("tree", "level", F.floor(F.col("idx") / f).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("m"))
    side = lambda keep: F.array_join(F.transform(F.filter("m", keep), lambda x: hex_of(x["digest"])), "")
    sides = steps.join(families, ["tree", "level", "up"]).select("tree", "block", "level", side(lambda x: x["idx"] < F.col("own")).alias("left"), side(lambda x: x["idx"] > F.col("own")).alias("right"))
    paths = sides.groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("level", "left", "right"))).alias("p"))
    path = F.transform("p", lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))
    return blocks.select("tree", "block").join(paths.select("tree", "block", path.alias("path")), ["tree", "block"], "left").withColumn("path", F.coalesce("path", F.array().cast(PATH)))


def block_paths(digests: list[bytes], n: int, first: int, fanout: int, levels: int) -> list[list[tuple[str, str]]]:
    """By level, the (left, right) siblings of each node within a block of leaves that begins at index first of n."""
    out, now = [], [d.hex() for d in digests]
    for level in range(levels):
        if nodes_in(n, level, fanout) == 1:
            break
        sides, ups = [], []
        for a in range(0, len(now), fanout):
            run = now[a : a + fanout]
            sides += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
            ups.append(hashlib.sha256("".join(run).encode()).hexdigest())
        out.append(sides)
        now = ups
    return out


def prove(tree: Tree, beyond: DataFrame | None = None) -> DataFrame:
    """The leaves with path, their siblings a level up to the root; beyond (tree, path) goes on from there."""
    f, k = tree.fanout, tree.records_from
    upper = above(tree)
    if beyond is not None:
        upper = upper.join(beyond.select("tree", F.col("path").alias("_beyond")), "tree").select("tree", "block", F.concat("path", "_beyond").alias("path"))
    blocked = tree.leaves.withColumn("block", F.floor(F.col("idx") / f**k))
    schema = StructType([*tree.leaves.schema.fields, upper.schema["path"]])

    def run(leaves: pa.Table, context: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("idx").combine_chunks()
        rows = leaves.num_rows
        if not rows:
            return pa.table({c.name: pa.array([], c.type) for c in leaves.drop_columns("block").schema} | {"path": pa.array([], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})
        inner = block_paths(leaves.column("digest").to_pylist(), leaves.column("n")[0].as_py(), leaves.column("idx")[0].as_py(), f, k)
        outer = [(s["left"], s["right"]) for s in context.column("path")[0].as_py()]
        steps = [s for i in range(rows) for s in [*(level[i // f**j] for j, level in enumerate(inner)), *outer]]
        sides = pa.StructArray.from_arrays([pa.array([s[x] for s in steps], pa.string()) for x in (0, 1)], ["left", "right"])
        many = len(inner) + len(outer)
        path = pa.ListArray.from_arrays(pa.array([many * i for i in range(rows + 1)], pa.int32()), sides)
        return leaves.drop_columns("block").append_column("path", path)

    return blocked.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(run, schema)


@dataclass
class Manifest:
    proofs: DataFrame  # leaves with tree, n, idx, path to the root; digests as bytes
    subroots: DataFrame  # tree, n, digest
    root: str | None  # None of an empty table


def group_key(group: Column) -> Column:
    """The tree of a group: null comes first, then groups by their bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def manifest(leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of leaves (id, tree from group_key, digest binary, and columns that go along).

    Leaves of a tree are in the order of id, null first, then digest, so rows that repeat an id have a defined place and
    rows that repeat all are interchangeable. A tree of one leaf is that leaf. An empty table has no root and no proofs."""
    scratch = Scratch(leaves.sparkSession, "merkle")
    leaves = scratch.keep(leaves, "leaves")
    trees = build(leaves, [F.col("id").asc_nulls_first(), "digest"], scratch, fanout, block_levels)
    tops = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    top = build(scratch.keep(tops, "tops", 0), ["group"], scratch, fanout, block_levels)
    beyond = scratch.keep(prove(top).select(F.col("group").alias("tree"), "path"), "beyond")
    root = top.roots.select(hex_of("digest")).first()
    return Manifest(prove(trees, beyond), trees.roots, root[0] if root else None)


def op12_merkle(spark, sf_dir):
    """Leaves, proofs and folded roots of all documents, a tree a language."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    digest = lambda text: F.unhex(F.sha2(leaf_text(*(F.col(c) for c in fields), text), 256))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digest(F.translate("text", upper, upper.lower())))
    made = manifest(docs.select(F.col("doc_id").alias("id"), group_key(F.col("lang")).alias("tree"), digest(F.col("text")).alias("digest"), tampered.alias("tampered")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(hex_of(F.coalesce("tampered", "digest")), "path")
    root = F.lit(made.root).cast("string")
    out = made.proofs.join(made.subroots.select("tree", hex_of("digest").alias("subroot")), "tree")
    out = out.select(F.col("id").alias("doc_id"), hex_of("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The same by joining every node with its run, for trees of up to 8^7 leaves a language and 8^3 languages."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    rounds = "i"
    for _ in range(8):
        rounds = f"(SELECT {step} FROM (SELECT {rounds} AS c))"
    sql = f"""WITH RECURSIVE byte AS (SELECT i, {rounds} AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
crc AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, k + 1, xor(crc.c >> 8, byte.v) FROM crc JOIN byte ON byte.i = xor(crc.c & 255, ascii(s[k + 1])) WHERE k < length(s)),
bad AS (SELECT doc_id FROM crc WHERE k = length(s) AND xor(c, 4294967295) % 3 = 0),
d AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN {leaf(low)} END AS tampered FROM documents),
a0 AS (SELECT row_number() OVER () AS r, doc_id, lang, leaf, coalesce(tampered, leaf) AS folded, leaf AS node, '' AS sib,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
"""
    for level in range(7):
        sql += f"""n{level} AS (SELECT DISTINCT lang, i, node FROM a{level} WHERE n > 1),
a{level + 1} AS (SELECT r, doc_id, a.lang, leaf, CASE WHEN n > 1 THEN sha256(lt || folded || rt) ELSE folded END AS folded, CASE WHEN n > 1 THEN sha256(lt || node || rt) ELSE node END AS node,
  sib || lt || rt AS sib, i // 8 AS i, (n + 7) // 8 AS n FROM (
  SELECT a.*, coalesce((SELECT string_agg(m.node, '' ORDER BY m.i) FROM n{level} m WHERE m.lang IS NOT DISTINCT FROM a.lang AND m.i // 8 = a.i // 8 AND m.i < a.i), '') AS lt,
  coalesce((SELECT string_agg(m.node, '' ORDER BY m.i) FROM n{level} m WHERE m.lang IS NOT DISTINCT FROM a.lang AND m.i // 8 = a.i // 8 AND m.i > a.i), '') AS rt FROM a{level} a) a),
"""
    sql += """subs AS (SELECT DISTINCT lang, node AS subroot FROM a7),
b0 AS (SELECT a.r, a.doc_id, a.leaf, s.subroot, a.folded, a.node, a.sib, s.i, s.n FROM a7 a JOIN (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM subs) s ON s.lang IS NOT DISTINCT FROM a.lang),
"""
    for level in range(3):
        sql += f"""t{level} AS (SELECT DISTINCT i, node FROM b{level} WHERE n > 1),
b{level + 1} AS (SELECT r, doc_id, leaf, subroot, CASE WHEN n > 1 THEN sha256(lt || folded || rt) ELSE folded END AS folded, CASE WHEN n > 1 THEN sha256(lt || node || rt) ELSE node END AS node,
  sib || lt || rt AS sib, i // 8 AS i, (n + 7) // 8 AS n FROM (
  SELECT a.*, coalesce((SELECT string_agg(m.node, '' ORDER BY m.i) FROM t{level} m WHERE m.i // 8 = a.i // 8 AND m.i < a.i), '') AS lt,
  coalesce((SELECT string_agg(m.node, '' ORDER BY m.i) FROM t{level} m WHERE m.i // 8 = a.i // 8 AND m.i > a.i), '') AS rt FROM b{level} a) a),
"""
    return sql.rstrip(",\n") + "\nSELECT doc_id, leaf, subroot, node AS root, sha256(sib) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM b3"


OP12_SQL = _sql()
