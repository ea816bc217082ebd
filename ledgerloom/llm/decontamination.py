"""Benchmark decontamination: an FM-index over the words of each shard of documents, searched for windows of benchmark items.

1. Every benchmark item gives its windows of WINDOW consecutive words; an item of fewer words is one window.
2. Documents are read in shards of about SHARD_WORDS words. A shard's words, a separator after each text, are sorted by
   suffix; the words before the sorted suffixes (the Burrows-Wheeler transform) go into a wavelet matrix of packed bits,
   whose ranks count a word up to a row. Every RATE-th position and the first of each text is sampled.
3. All windows are searched at once, backward from their last word: a step narrows each window's range of rows by two
   ranks, and windows whose range is empty leave. Occurrences are located by stepping from their rows to a sample.
4. Occurrences of a text merge into removal spans; the items of its windows are listed.

Up to BLOCK_PAIRS distinct pairs of window and item go to the tasks at once and the indexes live in the task that made them.
With more, the indexes are written to a table and searched for one block of pairs after the other, so what is broadcast
has a bound however large the benchmark is. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, STEP_BYTES, Scratch, map_arrow, pieces, slices, spans_hash, table, text_buffers, word_spans

WINDOW = 10
#: Words of a shard, about; what a task holds follows from it, not from the table.
SHARD_WORDS = 1 << 19
#: Of so many positions one is sampled.
RATE = 8
#: Pairs of window and item that are sent to the tasks at once, about 100 bytes each.
BLOCK_PAIRS = 250_000
#: Item ids in a batch of results, about.
OUT_ITEMS = 1 << 20

#: Bytes outside words, after A-Z are lower-cased: words hold digits, a-z and all that is not ASCII.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


# --- words ----------------------------------------------------------------------------------------


def hashed_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last, row) of every word; offsets of bytes count from the start of raw. A single text of any length is done in steps."""
    if len(offsets) == 2 and len(raw) > 2 * STEP_BYTES:
        found = []
        for a, b in pieces(raw, STEP_BYTES, cut=OUTSIDE[LOWER]):
            h, s, e, _ = hashed_words(np.concatenate([raw[a:b], [np.uint8(32)]]), np.array([0, b - a, b - a + 1]))
            found.append((h, s + a, e + a))
        h, s, e = (np.concatenate(c) for c in zip(*found, strict=True))
        return h, s, e, np.zeros(len(h), np.int64)
    low = LOWER[raw]
    starts, ends, rows = word_spans(low, offsets, OUTSIDE)
    return spans_hash(low, starts, ends), starts, ends, rows


# --- the index ------------------------------------------------------------------------------------


class Bits:
    """A sequence of bits with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words)
        self.before = (np.cumsum(counts, dtype=np.int64) - counts).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each i."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of s by the suffix that starts there. The symbols that end texts are distinct, so no two suffixes are equal.

    Sorted by as many symbols as one integer holds, then by twice as many in each round, of suffixes not yet told apart."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    k = max(1, 62 // bits)
    padded = np.concatenate([s, np.zeros(k, np.int64)])
    key = s.copy()
    for j in range(1, k):
        key <<= bits
        key |= padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rows = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(rows):
        at = order[rows]
        key = rank[at] << 32 | rank[at + k]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[rows] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        rows = rows[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
    return order


class Index:
    """The FM-index of a sequence of texts of words: where any sequence of words occurs."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        texts = len(counts)
        self.names, ids = np.unique(words, return_inverse=True)
        #: Position of the first word of each text; a separator follows the last one.
        self.starts = np.cumsum(counts + 1) - (counts + 1)
        n = len(words) + texts
        ends = self.starts + counts
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols = np.zeros(n, np.int64)  # 0 is the separator
        symbols[inside] = ids + 1
        told = symbols + (texts - 1)
        told[ends] = np.arange(texts)  # texts end in symbols of their own
        order = suffix_order(told)
        size = np.bincount(symbols, minlength=len(self.names) + 1)
        self.depth = max(1, len(self.names).bit_length())
        last = symbols[order - 1].astype(np.int32)
        self.levels: list[tuple[Bits, int]] = []
        base = np.zeros(len(size), np.int64)
        every = np.arange(len(size))
        for b in range(self.depth - 1, -1, -1):
            bit = (last >> b) & 1 == 1
            level = Bits(bit), int(len(bit) - np.count_nonzero(bit))
            self.levels.append(level)
            last = np.concatenate([last[~bit], last[bit]])
            base = self._down(level, base, every >> b & 1 == 1)
        #: What turns a place in the last level into the row of the suffix one word longer.
        self.shift = np.cumsum(size) - size - base
        self.size = size
        sampled = order % RATE == 0
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        sampled[row[self.starts]] = True
        self.sampled, self.samples = Bits(sampled), order[sampled].astype(np.int32)

    @staticmethod
    def _down(level: tuple[Bits, int], i: np.ndarray, bit: np.ndarray) -> np.ndarray:
        ones = level[0].rank(i)
        return np.where(bit, level[1] + ones, i - ones)

    def _longer(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for b, level in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            i = self._down(level, i, symbol >> b & 1 == 1)
        return self.shift[symbol] + i

    def _before(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one word earlier."""
        symbol = np.zeros(len(row), np.int64)
        for level in self.levels:
            bit = level[0].get(row)
            symbol = symbol << 1 | bit
            row = self._down(level, row, bit)
        return self.shift[symbol] + row

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the phrase, first row, row after the last) of phrases, rows of a matrix of hashes, that occur."""
        if not len(self.names):
            return (np.zeros(0, np.int64),) * 3
        ids = np.minimum(np.searchsorted(self.names, phrases), len(self.names) - 1)
        alive = np.flatnonzero((self.names[ids] == phrases).all(1))
        ids = ids[alive] + 1
        lo = (np.cumsum(self.size) - self.size)[ids[:, -1]]
        hi = lo + self.size[ids[:, -1]]
        for j in range(phrases.shape[1] - 2, -1, -1):
            lo, hi = self._longer(lo, ids[:, j]), self._longer(hi, ids[:, j])
            some = hi > lo
            alive, ids, lo, hi = alive[some], ids[some], lo[some], hi[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of the suffix of each row, a row of a word."""
        at, back = np.empty(len(rows), np.int64), 0
        going = np.arange(len(rows))
        while len(going):
            here = self.sampled.get(rows)
            at[going[here]] = self.samples[self.sampled.rank(rows[here])] + back
            going, rows = going[~here], rows[~here]
            rows = self._before(rows)
            back += 1
        return at

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the phrase, words before it, separators not counted) of every occurrence."""
        which, lo, hi = self.search(phrases)
        many = hi - lo
        rows = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at = self.locate(rows)
        return np.repeat(which, many), at - (np.searchsorted(self.starts, at, side="right") - 1)

    # An index as bytes and back.

    def dump(self) -> bytes:
        arrays = {"names": self.names, "starts": self.starts, "shift": self.shift, "size": self.size, "samples": self.samples}
        for k, bits in enumerate([self.sampled, *(b for b, _ in self.levels)]):
            arrays[f"words{k}"], arrays[f"before{k}"] = bits.words, bits.before
        arrays["zeros"] = np.array([z for _, z in self.levels])
        np.savez(out := io.BytesIO(), **arrays)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Index:
        index, arrays = Index.__new__(Index), np.load(io.BytesIO(data))
        for name in ("names", "starts", "shift", "size", "samples"):
            setattr(index, name, arrays[name])
        index.depth = len(zeros := arrays["zeros"])
        bits = []
        for k in range(index.depth + 1):
            bits.append(Bits.__new__(Bits))
            bits[k].words, bits[k].before = arrays[f"words{k}"], arrays[f"before{k}"]
        index.sampled, index.levels = bits[0], list(zip(bits[1:], zeros.tolist(), strict=True))
        return index


# --- windows of items -----------------------------------------------------------------------------


@dataclass
class Phrases:
    """Distinct windows by their number of words, and the items of each."""

    groups: list[tuple[np.ndarray, np.ndarray]]  # (matrix of hashes, numbers of the windows)
    sizes: np.ndarray  # words of each window
    begins: np.ndarray  # of a window, in owners
    owners: np.ndarray  # numbers of items, by window
    items: pa.Array

    @staticmethod
    def of(pairs: pa.Table) -> Phrases:
        """From a table (item, words)."""
        column = pairs.column("words").combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        size = np.diff(column.offsets.to_numpy())
        begin = np.cumsum(size) - size
        names = pairs.column("item").combine_chunks().dictionary_encode()
        item = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        groups, sizes, windows, done = [], [], np.zeros(len(size), np.int64), 0
        for k in np.unique(size).tolist():
            rows = np.flatnonzero(size == k)
            matrix, own = np.unique(flat[begin[rows][:, None] + np.arange(k)], axis=0, return_inverse=True)
            windows[rows] = own.ravel() + done
            groups.append((matrix, np.arange(len(matrix)) + done))
            sizes.append(np.full(len(matrix), k))
            done += len(matrix)
        named = item >= 0
        by = np.argsort(windows[named], kind="stable")
        begins = np.searchsorted(windows[named][by], np.arange(done + 1))
        return Phrases(groups, np.concatenate([*sizes, np.zeros(0, np.int64)]), begins, item[named][by], names.dictionary)

    def find(self, index: Index) -> tuple[np.ndarray, np.ndarray]:
        """(window, words before it) of every occurrence."""
        found = [(numbers[which], at) for matrix, numbers in self.groups for which, at in [index.find(matrix)]]
        return tuple(np.concatenate([*(f[k] for f in found), np.zeros(0, np.int64)]) for k in (0, 1))

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """Distinct items of distinct windows."""
        return np.unique(np.concatenate([self.owners[self.begins[w] : self.begins[w + 1]] for w in windows.tolist()]))


def windows_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words): the distinct windows of each item, words as hashes."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            h, _, _, rows = hashed_words(*text_buffers(batch.column(1)))
            counts = np.bincount(rows, minlength=batch.num_rows)
            begins = np.cumsum(counts) - counts
            many = np.where(counts, np.maximum(counts - WINDOW + 1, 1), 0)
            size = np.repeat(np.minimum(counts, WINDOW), many)
            row = np.repeat(np.arange(batch.num_rows), many)
            first = np.repeat(begins - (np.cumsum(many) - many), many) + np.arange(many.sum())
            for a in range(0, len(first), 50_000):
                part = slice(a, a + 50_000)
                ends = np.cumsum(size[part])
                at = np.repeat(first[part] - (ends - size[part]), size[part]) + np.arange(ends[-1])
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(h[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part])), words], ["item", "words"])

    return map_arrow(items.select(items[id_col].alias("_item"), items[text_col].alias("_text")), run, f"item {kind}, words array<long>").distinct()


# --- documents ------------------------------------------------------------------------------------


@dataclass
class Texts:
    """Some documents, their words laid end to end."""

    ids: pa.Array
    words: np.ndarray
    counts: np.ndarray
    #: Code points before each word and before what follows it, within its document.
    starts: np.ndarray
    ends: np.ndarray

    def indexes(self) -> Iterator[tuple[int, Index]]:
        """(words before it, index): one index, or several that overlap for one very long document."""
        if len(self.counts) > 1 or len(self.words) <= 2 * SHARD_WORDS:
            yield 0, Index(self.words, self.counts)
            return
        for a in range(0, len(self.words), SHARD_WORDS):
            part = self.words[a : a + SHARD_WORDS + WINDOW - 1]
            yield a, Index(part, np.array([len(part)]))


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """Batches (_id, _text) as shards of documents."""
    held: list[Texts] = []

    def joined() -> Texts:
        return Texts(pa.concat_arrays([t.ids for t in held]), *(np.concatenate([getattr(t, c) for t in held]) for c in ("words", "counts", "starts", "ends")))

    for batch in slices(batches, "_text"):
        raw, offsets = text_buffers(batch.column(1))
        h, s, e, rows = hashed_words(raw, offsets)
        points = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        own = points[offsets[:-1]][rows]
        counts = np.bincount(rows, minlength=batch.num_rows)
        one = Texts(batch.column(0), h, counts, (points[s] - own).astype(np.int32), (points[e] - own).astype(np.int32))
        if held and (len(h) > SHARD_WORDS or sum(len(t.words) for t in held) + len(h) > SHARD_WORDS):
            yield joined()
            held = []
        held.append(one)
    if held:
        yield joined()


def covered(first: np.ndarray, size: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of the merged stretches of words in n; begins are the first words of texts, which no stretch crosses."""
    edge = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(first + size, minlength=n + 1)[: n + 1]
    inside = np.cumsum(edge)[:n] > 0
    cut = np.zeros(n + 1, bool)
    cut[begins] = True
    cut[n] = True
    return np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]]))), np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_SPAN_DDL = "array<struct<first: long, last: long, start: long, end: long>>"


def results(found: tuple[np.ndarray, np.ndarray], phrases: Phrases, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """Documents a to b with (hit words, item ids, spans), cut so that item ids in one result are about OUT_ITEMS at most."""
    window, at = found
    n, docs = len(starts), len(counts)
    begins = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(docs), counts)
    first, last = covered(at, phrases.sizes[window], begins[counts > 0], n)
    doc = owner[first]
    hits = np.bincount(doc, last - first, minlength=docs).astype(np.int64)
    cuts = np.searchsorted(doc, np.arange(docs + 1))
    pair = np.unique(owner[at] * len(phrases.sizes) + window) if len(at) else at
    pair_doc, pair_window = (pair // len(phrases.sizes), pair % len(phrases.sizes)) if len(pair) else (pair, pair)
    pair_cuts = np.searchsorted(pair_doc, np.arange(docs + 1))
    known: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.int64))
    a, total, lists = 0, 0, []
    for d in range(docs):
        own = pair_window[pair_cuts[d] : pair_cuts[d + 1]]
        if len(own):
            if own.tobytes() != known[0]:
                known = own.tobytes(), phrases.items_of(own)
            lists.append(known[1])
        else:
            lists.append(own)
        total += len(lists[-1])
        if d == docs - 1 or total > OUT_ITEMS:
            part = slice(cuts[a], cuts[d + 1])
            base = begins[doc[part]]
            spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (first[part] - base, last[part] - base, starts[first[part]], ends[last[part] - 1])], fields=list(_SPAN))
            listed = phrases.items.take(pa.array(np.concatenate(lists), pa.int64()))
            item_cuts = np.cumsum([0, *map(len, lists)])
            yield a, d + 1, [
                pa.array(hits[a : d + 1]),
                pa.ListArray.from_arrays(pa.array(item_cuts, pa.int32()), listed),
                pa.ListArray.from_arrays(pa.array(cuts[a : d + 2] - cuts[a], pa.int32()), spans),
            ]
            a, total, lists = d + 1, 0, []


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row a document: _id, n_words, n_hit, items (ids of the items with a window in it, in no order), spans.

    spans are the merged stretches of hit words: words first to last and code points start to end, ends exclusive. Words
    are what A-Z lower-cased and `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` give. Null and empty texts have no words; documents that
    repeat an id are rows of their own; items that repeat an id are one item with the windows of all; windows of an item
    without an id hit, but list nothing. Without items nothing is hit. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    pairs = scratch.keep(windows_of(items, item_col, item_text_col), "windows")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    blocks = max(1, -(-pairs.count() // block_pairs))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(blocks)))

    def block(k: int):
        return spark.sparkContext.broadcast(Phrases.of(pairs.filter(F.col("block") == k).select("item", "words").toArrow()))

    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    if blocks == 1:
        sent = block(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for t in read(batches):
                found = [(w, at + base) for base, index in t.indexes() for w, at in [phrases.find(index)]]
                found = tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))
                for a, b, columns in results(found, phrases, t.counts, t.starts, t.ends):
                    yield pa.RecordBatch.from_arrays([t.ids[a:b], pa.array(t.counts[a:b], pa.int64()), *columns], ["_id", "n_words", "n_hit", "items", "spans"])

        return map_arrow(texts, run, f"_id {kind}, n_words long, n_hit long, items array<{item_kind}>, spans {_SPAN_DDL}")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for no, t in enumerate(read(batches)):
            whole = [pa.array([x], pa.list_(y.type)) for x, y in ((t.ids, t.ids), *((pa.array(c), pa.array(c)) for c in (t.counts, t.starts, t.ends)))]
            for base, index in t.indexes():
                few = whole if base == 0 else [w.slice(0, 0).take(pa.array([None], pa.int64())) for w in whole[:1]] + whole[1:]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + no]), pa.array([base], pa.int64()), pa.array([index.dump()], pa.large_binary()).cast(pa.binary()), *few], ["shard", "base", "index", "ids", "counts", "starts", "ends"])

    indexed = scratch.keep(map_arrow(texts, build, f"shard long, base long, index binary, ids array<{kind}>, counts array<long>, starts array<int>, ends array<int>"), "index")
    partial = []
    for k in range(blocks):
        sent = block(k)

        def seek(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for batch in batches:
                for row in range(batch.num_rows):
                    shard, base, data, counts, starts, ends = (batch.column(c)[row] for c in ("shard", "base", "index", "counts", "starts", "ends"))
                    counts, starts, ends = (x.values.to_numpy() for x in (counts, starts, ends))
                    window, at = phrases.find(Index.load(data.as_py()))
                    for a, b, columns in results((window, at + base.as_py()), phrases, counts, starts, ends):
                        some = pa.array(np.flatnonzero(columns[0].to_numpy() > 0))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard.as_py())), pa.array(some.to_numpy() + a, pa.int64()), *(c.take(some) for c in columns[1:])], ["shard", "row", "items", "spans"])

        found = map_arrow(indexed.drop("ids"), seek, f"shard long, row long, items array<{item_kind}>, spans {_SPAN_DDL}")
        partial.append(scratch.keep(found, "found"))
    every = partial[0]
    for p in partial[1:]:
        every = every.unionByName(p)
    met = every.groupBy("shard", "row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), merged(F.flatten(F.collect_list("spans"))).alias("spans"))
    rows = indexed.filter("base = 0").select("shard", F.posexplode(F.arrays_zip("ids", "counts")).alias("row", "r")).select("shard", F.col("row").cast("long"), F.col("r.ids").alias("_id"), F.col("r.counts").alias("n_words"))
    out = rows.join(met, ["shard", "row"], "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return out.select("_id", "n_words", *(F.coalesce(c, F.lit(0) if n == "n_hit" else F.array()).alias(n) for n, c in (("n_hit", n_hit), ("items", F.col("items")), ("spans", F.col("spans")))))


def merged(spans: Column) -> Column:
    """Spans that touch or overlap as one, by first word."""
    empty = F.lit(None).cast(_SPAN_DDL)

    def step(acc: Column, s: Column) -> Column:
        last = acc["last"]
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return (
            F.when(last.isNull(), F.struct(acc["done"].alias("done"), s.alias("last")))
            .when(s["first"] <= last["last"], F.struct(acc["done"].alias("done"), joined.alias("last")))
            .otherwise(F.struct(F.array_append(acc["done"], last).alias("done"), s.alias("last")))
        )

    start = F.struct(F.array().cast(_SPAN_DDL).alias("done"), F.get(empty, F.lit(0)).alias("last"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["last"])))


def without(text: Column | str, spans: Column | str) -> Column:
    """text less its spans, spaces and marks between words left as they are; text itself where there are none."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    kept = F.zip_with(begins, ends, lambda b, e: F.substr(text, (b + 1).cast("int"), (e - b).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)


def op11_decontamination(spark, sf_dir):
    """Hits of all benchmark windows in all documents."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same by joining windows of documents and items, of each length that an item window has.
OP11_SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[k:k+9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
dw AS (SELECT r, k, n, w[k:k+n-1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
met AS (SELECT r, k, n, item_id FROM dw JOIN iw USING (win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM met) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
