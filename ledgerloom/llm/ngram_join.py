"""Similarity join of documents by their word n-grams, as a blocked sparse product of the document by n-gram incidence.

Documents link when the Jaccard coefficient of their n-gram sets is at least percent / 100. The result is one row a document
with the component it belongs to; links themselves are never written out in full, but none is lost.

The product of the incidence matrix with its transpose counts the overlap of every two documents. Size-derived bounds
leave little of it to be formed:
- Equal rows are one row: documents of one set are a class, known by a digest of the set.
- Only sets with percent * larger <= 100 * smaller can link, and only if they overlap in enough n-grams.
- With the n-grams of each row in one order, rare ones first, two rows that reach the bound share an n-gram among their
  first n - ceil(percent * n / 100) + 1, so only these entries say which rows must be multiplied. Rare is judged by a
  sketch of fixed size that counts the n-grams of all documents; any order gives right results, a good one short columns.
- From where a shared n-gram stands in both rows follows how much the rows can still share at most; pairs below the
  bound are discarded.

1. These entries are dealt into column blocks by hash. A block sorts its entries, drops columns with one row, and sets each
   row against the head of its column, the smallest row that it could link with.
2. Rows that could link with anything are written as pieces of their full incidence, cut by columns.
3. Row blocks are multiplied: a head and up to STAR_ROWS of the rows set against it most often meet in one task, piece by
   piece of the columns, and the overlaps of all their pairs are added up over the pieces. What reaches the bound in the
   end is a link. A block gives a spanning forest of its links, so a group of near copies costs a row each, not its pairs.
4. Components are formed, and rows are set against heads of other components, as long as that joins many.
5. Only then are the pairs of each column formed, across components and within a band of sizes, a block of a column
   against a block of it where columns are long: first one for every two components, then all of those that this does
   not join. They go through the product like the rest, and components are formed for good.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, Scratch, map_arrow, mix, slices, table, text_buffers, windows_hash, word_hashes
from ledgerloom.llm.components import connected_components

N = 5
PERCENT = 80
#: The sketch counts n-grams under this many leading bits; its size does not depend on the corpus.
SKETCH_BITS = 21
SKETCH_PARTS = 16
#: Entries of a column block, about, and entries a task holds before it writes them.
BLOCK_ENTRIES = 250_000
HELD_ENTRIES = 1_000_000
#: Rows of one side of a pair of blocks of a column.
COLUMN_ROWS = 256
#: Rows of a row block beside its head, and n-grams they have together, about.
STAR_ROWS = 128
STAR_GRAMS = 200_000
#: N-grams of a piece of a row, about, and columns that one step of the product holds as a dense matrix.
PIECE_BITS = 16
DENSE_COLUMNS = 4096
#: Pairs of a column that are looked at in one step.
PAIRS_HELD = 500_000
#: Neighbours in size order that an entry of a column is tried against.
NEAR = 8
#: Rounds of joining components at most, and the share of multiplied pairs that must link for one more.
ROUNDS = 4
WORTH = 0.05
#: Pairs up to which who is asked for is broadcast to the rows (two short rows a pair, 20 MB); beyond it both sides are shuffled.
ASKED_PAIRS = 250_000
#: Bits of the filter that keeps rows nobody asks for from being written; fixed as well.
FILTER_BITS = 24


# --- sets -----------------------------------------------------------------------------------------


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of x, which is sorted in place."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ngram_sets(column: pa.Array, n: int = N) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text, A-Z in lower case; a text of fewer words is one gram of all of them."""
    words, count = word_hashes(*text_buffers(column), LOWER)
    first = np.cumsum(count) - count
    grams = windows_hash(words, n)
    out = []
    for a, c in zip(first.tolist(), count.tolist(), strict=True):
        if c >= n:
            out.append(distinct(grams[a : a + c - n + 1]))
        elif c:
            out.append(mix(windows_hash(words[a : a + c], c) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(size, percent: int = PERCENT):
    """Entries of a row of this size that enter the search."""
    return size - -(-percent * size // 100) + 1


def rare_first(grams: np.ndarray, k: int, sketch: np.ndarray) -> np.ndarray:
    """The first k of a sorted set in the order of (count in the sketch, value)."""
    shift = np.uint64(64 - SKETCH_BITS)
    counts = np.concatenate([sketch[(grams[a : a + 65536] >> shift).astype(np.int64)] for a in range(0, len(grams), 65536)])
    if k < len(grams):
        last = np.partition(counts, k - 1)[k - 1]
        chosen = counts < last
        ties = np.flatnonzero(counts == last)
        chosen[ties[: k - int(chosen.sum())]] = True
        grams, counts = grams[chosen], counts[chosen]
    return grams[np.argsort(counts, kind="stable")]


# --- first scan: sizes, digests, sketch -----------------------------------------------------------


def _scan(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to rows (id, size, d1, d2), and at the end rows (part, counts) of this task's sketch."""
    names = ["id", "size", "d1", "d2", "part", "counts"]
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    shift = np.uint64(64 - SKETCH_BITS)
    for batch in slices(batches, "text"):
        sets = ngram_sets(batch.column(1), n)
        every = np.concatenate(sets) if len(sets) > 1 else sets[0]
        for a in range(0, len(every), 1 << 20):
            sketch += np.bincount((every[a : a + (1 << 20)] >> shift).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
        digests = np.frombuffer(b"".join(hashlib.blake2b(s.data, digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
        size = pa.array([len(s) for s in sets], pa.int64())
        nulls = [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(digests[:, 0]), pa.array(digests[:, 1]), *nulls], names)
    if sketch.any():
        parts = [p.tobytes() for p in np.split(sketch, SKETCH_PARTS)]
        none = pa.nulls(SKETCH_PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names)


def _summed(parts: DataFrame, add) -> dict[int, np.ndarray]:
    """Arrays (part, counts) brought together by add, a part at a time, and handed to the driver; their size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(counts, np.uint32)
                held[part] = add(held[part], got) if part in held else got
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([a.tobytes() for a in held.values()], pa.binary())], ["part", "counts"])

    near = map_arrow(parts.select("part", "counts"), run, "part int, counts binary")
    done = map_arrow(near.repartition(SKETCH_PARTS, "part"), run, "part int, counts binary")
    return {r["part"]: np.frombuffer(r["counts"], np.uint32) for r in done.collect()}


# --- second scan: entries in column blocks --------------------------------------------------------


def _entries(batches: Iterator[pa.RecordBatch], n: int, percent: int, n_blocks: int, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, text) to packed entries, a row a block: sets and their sizes, and for each entry its set, column and place."""
    names = ["block", "sets", "sizes", "at", "column", "place"]
    seen: set[bytes] = set()
    keys, sizes, grams = [], [], []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal keys, sizes, grams, held
        every = np.concatenate(grams)
        lengths = np.array([len(g) for g in grams])
        at = np.repeat(np.arange(len(grams)), lengths)
        place = np.arange(len(every)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        block = ((every >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)
        column = every.astype(np.uint32)
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        ids, of_size = np.frombuffer(b"".join(keys), np.int64), np.array(sizes, np.uint32)
        rows = []
        for some in np.split(order, cuts):
            own, where = np.unique(at[some], return_inverse=True)
            rows.append([int(block[some[0]]), *(x.tobytes() for x in (ids[own], of_size[own], where.astype(np.uint32), column[some], place[some].astype(np.uint32)))])
        keys, sizes, grams, held = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 5], strict=True)], names)

    for batch in slices(batches, "text"):
        for s in ngram_sets(batch.column(1), n):
            if not len(s):
                continue
            key = hashlib.blake2b(s.data, digest_size=16).digest()[:8]
            if key in seen:
                continue
            seen.add(key)
            first = rare_first(s, prefix_length(len(s), percent), sketch)
            keys.append(key)
            sizes.append(len(s))
            grams.append(first)
            held += len(first)
        if held > HELD_ENTRIES:
            yield flush()
    if held:
        yield flush()


def admissible(columns: np.ndarray, sizes: np.ndarray, places: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which entries, sorted by column, have another in their column with which the bounds leave a link possible; the
    smallest entry that fits in size with each, or the next in size of those that are the smallest themselves).

    In size order an entry's partners stand near it: each is tried against the NEAR next ones. Entries of columns with more
    rows are kept if they fit with the smallest row that could be their partner, where the bound is lowest.
    """
    order = np.lexsort((sizes, columns))
    c, size, room = columns[order], sizes[order], (sizes - places)[order]
    ok = np.zeros(len(c), bool)
    for d in range(1, NEAR + 1):
        a, b = size[:-d], size[d:]
        fits = (c[:-d] == c[d:]) & (percent * b <= 100 * a) & (np.minimum(room[:-d], room[d:]) >= -(-percent * (a + b) // (100 + percent)))
        ok[:-d] |= fits
        ok[d:] |= fits
    starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    lengths = np.diff(np.append(starts, len(c)))
    key = np.repeat(np.arange(len(starts)), lengths) << 40
    least = np.minimum(np.searchsorted(key + size, key + -(-percent * size // 100)), len(c) - 1)
    long = np.repeat(lengths > NEAR + 1, lengths)
    ok |= long & (room >= -(-percent * (size + size[least]) // (100 + percent)))
    here = np.arange(len(c))
    after = np.minimum(here + 1, len(c) - 1)
    heads = np.where(least == here, np.where((c[after] == c) & (percent * size[after] <= 100 * size), after, here), least)
    keep, head = np.zeros(len(c), bool), np.zeros(len(c), np.int64)
    keep[order], head[order] = ok, order[heads]
    return keep, head


def _columns(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Blocks of packed entries, sorted by block, to those entries (list, set, size, place, head) that can still link."""

    def done(block: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sets, sizes, columns, places = [], [], [], []
        for r in rows:
            at = np.frombuffer(r["at"], np.uint32)
            sets.append(np.frombuffer(r["sets"], np.int64)[at])
            sizes.append(np.frombuffer(r["sizes"], np.uint32)[at])
            columns.append(np.frombuffer(r["column"], np.uint32))
            places.append(np.frombuffer(r["place"], np.uint32))
        sets, sizes, columns, places = map(np.concatenate, (sets, sizes, columns, places))
        order = np.lexsort((sets, columns))
        sets, sizes, columns, places = sets[order], sizes[order], columns[order], places[order]
        new = np.ones(len(sets), bool)
        new[1:] = (sets[1:] != sets[:-1]) | (columns[1:] != columns[:-1])
        sets, sizes, columns, places = sets[new], sizes[new], columns[new], places[new]
        keep, head = admissible(columns.astype(np.int64), sizes.astype(np.int64), places.astype(np.int64), percent)
        if keep.any():
            list_ = columns[keep].astype(np.int64) | np.int64(block) << 32
            yield pa.RecordBatch.from_arrays([pa.array(list_), pa.array(sets[keep]), pa.array(sizes[keep].astype(np.int32)), pa.array(places[keep].astype(np.int32)), pa.array(sets[head[keep]])], ["list", "set", "size", "place", "head"])

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["block"] != row["block"]:
                yield from done(held[0]["block"], held)
                held = []
            held.append(row)
    if held:
        yield from done(held[0]["block"], held)


# --- the product ----------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to pieces of their rows: (id, size, start, grams), cut by leading bits of the n-grams.

    start is where a piece begins, as a share of all columns in 2 ** -30; longer rows are cut finer, always in halves."""
    for batch in slices(batches, "text"):
        ids, size, start, grams = [], [], [], []
        for id_, s in zip(batch.column(0).to_pylist(), ngram_sets(batch.column(1), n), strict=True):
            bits = max(0, len(s).bit_length() - PIECE_BITS)
            cuts = np.searchsorted(s, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, int)
            for k, part in enumerate(np.split(s, cuts)):
                if len(part):
                    ids.append(id_)
                    size.append(len(s))
                    start.append(k << 30 - bits)
                    grams.append(part.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(start, pa.int64()), pa.array(grams, pa.binary())], ["id", "size", "start", "grams"])


def overlaps(rows: list[np.ndarray], of: np.ndarray, counts: np.ndarray) -> None:
    """Add to counts what every two rows share in these pieces; of says whose piece each is."""
    every = np.concatenate(rows)
    if len(rows) == 2 and of[0] != of[1]:
        every.sort()
        counts[of[0], of[1]] += (both := int((every[1:] == every[:-1]).sum()))
        counts[of[1], of[0]] += both
        return
    owner = np.repeat(of, [len(r) for r in rows])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    starts = np.flatnonzero(new)
    shared = np.repeat(np.diff(np.append(starts, len(every))) > 1, np.diff(np.append(starts, len(every))))
    column, owner = (np.cumsum(new & shared) - 1)[shared], owner[shared]
    last = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, last, DENSE_COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + DENSE_COLUMNS])
        dense = np.zeros((len(counts), min(DENSE_COLUMNS, last - a)), np.float32)
        dense[owner[lo:hi], column[lo:hi] - a] = 1
        counts += (dense @ dense.T).astype(np.int64)


def forest(ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (least id of a component, other id) that join what the overlaps of a row block link."""
    linked = (counts > 0) & (100 * counts >= percent * (sizes[:, None] + sizes - counts))
    least = ids.copy()
    while True:
        new = np.minimum(least, np.where(linked, least, np.iinfo(np.int64).max).min(1))
        if (new == least).all():
            return least[least != ids], ids[least != ids]
        least = new


def _product(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pieces (hub, part, step, of, size, start, grams) sorted by (hub, part, step, of, start) to the links (a, b) of each row block.

    A piece that comes twice, as its document's id does, counts once."""
    group, step, last = None, None, None
    at: dict[int, int] = {}
    sizes: list[int] = []
    counts = np.zeros((0, 0), np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        nonlocal counts
        if len(sizes) > len(counts):
            counts = np.pad(counts, (0, len(sizes) - len(counts)))
        if len(held) > 1:
            overlaps([g for _, g in held], np.array([k for k, _ in held]), counts)
        held.clear()

    def done() -> tuple[np.ndarray, np.ndarray]:
        add()
        np.fill_diagonal(counts, 0)
        return forest(np.array(list(at)), np.array(sizes), counts, percent)

    for batch in batches:
        found = []
        columns = [batch.column(k).to_pylist() for k in range(7)]
        for hub, part, step_, of, size, start, grams in zip(*columns, strict=True):
            if last == (hub, part, of, start):
                continue
            last = (hub, part, of, start)
            if group != (hub, part):
                if len(at) > 1:
                    found.append(done())
                group, step, at, sizes, counts = (hub, part), step_, {}, [], np.zeros((0, 0), np.int64)
                held.clear()
            elif step != step_:
                add()
                step = step_
            if of not in at:
                at[of] = len(sizes)
                sizes.append(size)
            held.append((at[of], np.frombuffer(grams, np.uint64)))
        yield _links(found)
    if len(at) > 1:
        yield _links([done()])


def _links(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (id, text) that may be in ids (id): a filter of fixed size, so some that are not in ids may pass."""
    width = 1 << FILTER_BITS
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(width))
    part_bits = width // SKETCH_PARTS

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(width, bool)
        for batch in batches:
            on[batch.column(0).to_numpy()] = True
        packed = np.packbits(on).reshape(SKETCH_PARTS, -1)
        some = [k for k in range(SKETCH_PARTS) if packed[k].any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[k].tobytes() for k in some], pa.binary())], ["part", "counts"])

    found = _summed(map_arrow(ids.select(spot("id").alias("s")), bits, "part int, counts binary"), np.bitwise_or)
    whole = np.zeros((SKETCH_PARTS, part_bits // 8), np.uint8)
    for k, a in found.items():
        whole[k] = a.view(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(whole.ravel())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            yield batch.filter(pa.array((shared.value[s >> 3] >> (7 - (s & 7)) & 1).astype(bool))).select([0, 1])

    return map_arrow(docs.select("id", "text", spot("id").alias("s")), keep, "id long, text string")


def multiplied(rows: DataFrame, pairs: DataFrame, percent: int, n_pairs: int) -> DataFrame:
    """Links (a, b) of the row blocks that n_pairs pairs (hub, member, hub_size) of rows (id, size, start, grams) make up.

    A head with many members is dealt over several blocks, each with a copy of the head's row. A step is a range of columns
    that no piece of the block's rows crosses: sizes that can link differ little, and the finest cut of a head's size is taken
    coarser by one for that."""
    load = pairs.groupBy("hub").agg(F.max("hub_size").alias("hub_size"), F.count(F.lit(1)).alias("n"))
    load = load.select("hub", "hub_size", F.least("n", F.ceil(F.greatest(F.col("n") / STAR_ROWS, F.col("n") * F.col("hub_size") / STAR_GRAMS))).cast("int").alias("parts"))
    members = pairs.drop("hub_size").join(load, "hub").select("hub", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.col("member").alias("of"), "hub_size")
    hubs = load.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("of"), "hub_size")
    bits = F.greatest(F.lit(0), F.length(F.bin(F.floor(F.col("hub_size") * percent / 100))) - PIECE_BITS)
    step = F.floor(F.col("start") / F.pow(F.lit(2.0), 30 - bits))
    who = members.unionByName(hubs)
    # A head has a copy a block, and no more blocks than members. Few pairs go to the rows, so that rows are moved once.
    who = F.broadcast(who) if n_pairs <= ASKED_PAIRS else who
    asked = rows.join(who, F.col("of") == F.col("id")).select("hub", "part", step.alias("step"), "of", "size", "start", "grams")
    dealt = asked.repartition("hub", "part").sortWithinPartitions("hub", "part", "step", "of", "start")
    return map_arrow(dealt, lambda b: _product(b, percent), "a long, b long")


# --- pairs across components ----------------------------------------------------------------------


def _across(batches: Iterator[pa.RecordBatch], percent: int, one: bool) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (list, band, first, second) to the pairs (hub, member, hub_size, lo, hi) across components that the bounds leave.

    lo and hi are the components; with one, a step gives one pair for every two components. own is 1 for entries of the band itself; pairs of others meet under their own band."""

    def done(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups, all at once: in order of (group, size) the partners of a row are those next to it."""
        group = np.cumsum(np.concatenate([[0], (x[:4, 1:] != x[:4, :-1]).any(0)])) << 40
        order = np.argsort(group + x[5], kind="stable")
        group, (first, second, comp, size, place, id_, side, own) = group[order], x[2:, order]
        reach = np.searchsorted(group + size, group + size * 100 // percent, side="right") - np.arange(len(size)) - 1
        total, start = np.cumsum(reach), 0
        while start < len(size):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_HELD)))
            n = reach[start:end]
            a = np.repeat(np.arange(start, end), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            start = end
            # Rows dealt to two blocks of a column meet across these only.
            ok = (comp[a] != comp[b]) & (own[a] | own[b] > 0) & ((side[a] != side[b]) | (first[a] == second[a]))
            a, b = a[ok], b[ok]
            ok = np.minimum(size[a] - place[a], size[b] - place[b]) >= -(-percent * (size[a] + size[b]) // (100 + percent))
            a, b = a[ok], b[ok]
            a, b = np.where(id_[a] < id_[b], a, b), np.where(id_[a] < id_[b], b, a)
            both = np.stack([np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])], 1)
            _, at = np.unique(both if one else np.stack([id_[a], id_[b]], 1), axis=0, return_index=True)
            a, b, both = a[at], b[at], both[at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (id_[a], id_[b], size[a], both[:, 0].copy(), both[:, 1].copy())], ["hub", "member", "hub_size", "lo", "hi"])

    left = np.zeros((10, 0), np.int64)
    for batch in batches:
        got = np.concatenate([left, np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(10)])], 1)
        cuts = np.flatnonzero((got[:4, 1:] != got[:4, :-1]).any(0))
        whole = int(cuts[-1]) + 1 if len(cuts) else 0
        left = got[:, whole:]
        if whole:
            yield from done(got[:, :whole])
    if left.shape[1]:
        yield from done(left)


def across(labelled: DataFrame, percent: int, one: bool) -> DataFrame:
    """Pairs (hub, member, hub_size) of different components that share a column and that the bounds leave; with one, a pair for
    every two components.

    Sizes fall into bands wider than what can link, so a row meets those of its band and of the next one only."""
    band = F.floor(F.log(F.col("size").cast("double")) / np.log(100 / percent + 0.01)).cast("int")
    rows = labelled.withColumn("band", band).withColumn("own", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn("band", F.col("band") - 1 + F.col("own"))
    key = ["list", "band"]
    mixed = rows.groupBy(*key).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.max("own").alias("_own"), F.ceil(F.count(F.lit(1)) / COLUMN_ROWS).cast("int").alias("n")).filter("_lo < _hi AND _own = 1")
    rows = rows.join(mixed.select(*key, "n"), key)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select(*key, F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"), "comp", "size", "place", "rep", (F.col("mine") > F.col("other")).cast("int").alias("side"), "own")
    group = [*key, "first", "second"]
    found = map_arrow(rows.repartition(*group).sortWithinPartitions(*group), lambda b: _across(b, percent, one), "hub long, member long, hub_size long, lo long, hi long")
    if one:
        return found.groupBy("lo", "hi").agg(F.min(F.struct("hub", "member", "hub_size")).alias("p")).select("p.*")
    return found.select("hub", "member", "hub_size").distinct()


def _best(labelled: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """A pair (hub, member, hub_size) for each row: with the first row of another component that it shares most columns with.

    The first rows of a column are those of its least and its greatest component, so there is a row an entry, not a pair.
    """
    row = F.struct("comp", "rep", "size")
    heads = labelled.groupBy("list").agg(F.min(row).alias("lo"), F.max(row).alias("hi")).filter("lo.comp < hi.comp")
    rows = labelled.join(heads, "list").withColumn("h", F.when(F.col("comp") == F.col("lo.comp"), F.col("hi")).otherwise(F.col("lo")))
    fits = percent * F.greatest("size", F.col("h.size")) <= 100 * F.least("size", F.col("h.size"))
    hub_size = F.when(F.col("rep") < F.col("h.rep"), F.col("size")).otherwise(F.col("h.size")).cast("long")
    rows = rows.filter(fits).select(F.col("rep").alias("row"), F.least("rep", F.col("h.rep")).alias("hub"), F.greatest("rep", F.col("h.rep")).alias("member"), hub_size.alias("hub_size"))
    counts = rows.groupBy("row", "hub", "member", "hub_size").count()
    if tried is not None:
        counts = counts.join(tried, ["hub", "member"], "left_anti")
    best = counts.groupBy("row").agg(F.max(F.struct("count", "hub", "member", "hub_size")).alias("b"))
    return best.select("b.hub", "b.member", "b.hub_size").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row a document: _id, n_shingles, component_id (smallest id reachable by links, its own included).

    Texts that are null, empty or blank have no n-grams and link with nothing; rows that repeat an id stay rows of their
    own, and are taken to repeat its text; a row with a null id keeps it, and has the component of the documents that have
    its very set, or null; ids must be integers; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scan = scratch.keep(map_arrow(docs, lambda b: _scan(b, n), "id long, size long, d1 long, d2 long, part int, counts binary"), "scan")
    sets = scan.filter("part IS NULL").select("id", "size", "d1", "d2")
    total, n_sets = sets.agg(F.sum(F.when(F.col("size") > 0, prefix_sql(F.col("size"), percent))), F.count(F.lit(1))).first()
    # The class of each set and the document that stands for it.
    classes = scratch.keep(sets.filter("size > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("size").alias("hub_size")), "classes", n_sets)
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total or 0) // BLOCK_ENTRIES))
    parts = _summed(scan.filter("part IS NOT NULL"), np.add)
    width = (1 << SKETCH_BITS) // SKETCH_PARTS
    sketch = spark.sparkContext.broadcast(np.concatenate([parts.get(k, np.zeros(width, np.uint32)) for k in range(SKETCH_PARTS)]))

    packed = map_arrow(docs, lambda b: _entries(b, n, percent, n_blocks, sketch.value), "block int, sets binary, sizes binary, at binary, column binary, place binary")
    packed = packed.repartition(n_blocks, "block").sortWithinPartitions("block")
    met = map_arrow(packed, lambda b: _columns(b, percent), "list long, set long, size int, place int, head long")
    entries = scratch.keep(met.join(classes.select("d1", "rep"), F.col("set") == F.col("d1")).select("list", "rep", "size", "place", "head"), "entries")
    n_entries = entries.count()
    rows = scratch.keep(map_arrow(_wanted(docs, entries.select(F.col("rep").alias("id"))), lambda b: _pieces(b, n), "id long, size long, start long, grams binary"), "rows")

    # Each row against the head that it has in most columns, then components against heads of others.
    counts = entries.groupBy("rep", "head").count().join(classes.select(F.col("d1").alias("head"), F.col("rep").alias("other"), "hub_size"), "head").filter("rep != other")
    best = counts.groupBy("rep").agg(F.max(F.struct("count", "other", "hub_size")).alias("b"))
    first = best.select(F.col("b.other").alias("hub"), F.col("rep").alias("member"), "b.hub_size")
    near, tried, n_links = None, None, 0

    def joined(candidates: DataFrame) -> tuple[int, int]:
        """Multiply pairs and join what links; how many pairs and links there were."""
        nonlocal near, tried, n_links
        pairs = scratch.keep(candidates, "pairs")
        if not (n_pairs := pairs.count()):
            return 0, 0
        ordered = pairs.select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member"))
        tried = ordered if tried is None else tried.unionByName(ordered)
        new = scratch.keep(multiplied(rows, pairs, percent, n_pairs), "links")
        n_links += (n_new := new.count())
        if n_new:
            near = _joined(near, new, n_links, scratch)
        return n_pairs, n_new

    for k in range(ROUNDS):
        n_pairs, n_new = joined(first if k == 0 else _best(_labelled(entries, near), tried, percent))
        if n_new <= WORTH * n_pairs:
            break
    # Columns with rows of several components are left: one pair of every two components, then all that still are two.
    for one in (True, False):
        left = across(_labelled(entries, near), percent, one)
        joined(left if tried is None else left.join(tried, ["hub", "member"], "left_anti"))

    known = classes.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "rep")
    if near is None:
        known = known.withColumnRenamed("rep", "component_id")
    else:
        known = known.join(near, F.col("rep") == F.col("node"), "left").select("_d1", "_d2", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(known, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("size") > 0), "left")
    return out.select(F.col("id").alias("_id"), F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _labelled(entries: DataFrame, near: DataFrame | None) -> DataFrame:
    """entries with comp, the component of the row so far."""
    if near is None:
        return entries.select("list", "rep", "size", "place", F.col("rep").alias("comp"))
    return entries.join(near, F.col("rep") == F.col("node"), "left").select("list", "rep", "size", "place", F.coalesce("component", "rep").alias("comp"))


def _joined(near: DataFrame | None, links: DataFrame, n_links: int, scratch: Scratch) -> DataFrame:
    """Components (node, component) near with more links (a, b): only components that new links meet are joined."""
    if near is None:
        return connected_components(links, scratch, rows=n_links)
    of = lambda c: near.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"_{c}to"))
    raised = links.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    raised = scratch.keep(raised.select("a", "b", F.coalesce("_ato", "a").alias("x"), F.coalesce("_bto", "b").alias("y")), "raised", n_links)
    over = connected_components(raised.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch, rows=n_links)
    over = over.select(F.col("node").alias("_n"), F.col("component").alias("_to"))
    # Nodes that the links meet for the first time come in as components of their own.
    ends = raised.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("component")), F.struct(F.col("b").alias("node"), F.col("y").alias("component")))).alias("e")).select("e.*").filter("node = component")
    nodes = near.unionByName(ends.join(near.select("node"), "node", "left_anti").distinct())
    return scratch.keep(nodes.join(over, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_to", "component").alias("component")), "near", 2 * n_links)


def prefix_sql(size: Column, percent: int) -> Column:
    return size - F.ceil(size * percent / 100) + 1


def op2_ngram_join(spark, sf_dir):
    """Near-duplicate components of all documents: doc_id, n_shingles, component_id."""
    return components(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


#: The same by counting all common shingles of all pairs, and following links.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
