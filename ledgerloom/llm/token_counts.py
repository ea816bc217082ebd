"""Token counts of a sentencepiece BPE model by rank-synchronous merging of numpy arrays.

A text becomes one space-marked sequence (spaces are written as the mark, one mark in front). No piece of the model holds
a mark after another character, so a sequence may be cut before each run of marks; characters that are no piece of
their own can never merge, so a sequence may be cut there too, and each costs its bytes. What lies between the cuts are
pre-tokens. The distinct pre-tokens of a batch that no earlier batch of the task had are laid out as one ragged array of
piece ids. In each round every sequence finds its lowest-rank mergeable pair, all of these merges are applied at once, in every
place of the sequence, from the left where places overlap, and finished sequences leave the array; the symbols that
survive are the count. Merging a pair in all places at once is merging it place by place if the symbol that it makes has no
pair of as low a rank; where it has one, the round applies the leftmost of places that lie within a piece's length only.
A sequence that would so put off many places, such as one short word thousands of times without a space, leaves the rounds
and is merged place by place from a heap, in n log n.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import map_arrow, slices, table

MARK = "▁"
#: Distinct pre-tokens whose counts a task remembers; beyond it memory is given back and counting goes on.
CACHE = 400_000
#: Characters of a text that are cut into pre-tokens at a time; a longer text is cut at spaces.
PART = 1 << 20
_NONE = np.int64(1 << 40)
#: Places that a round may put off in one sequence; with more of them it is merged from a heap.
PUT_OFF = 64


class Merger:
    """The merge table of a model: pieces by text, ranks by pair of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in normal}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece spans a space; the sequences of this model cannot be cut at spaces")
        # Equal scores are equal ranks: ties go to the leftmost pair.
        scores = sorted({model.get_score(i) for i in normal}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        pairs = {}
        for text, i in self.pieces.items():
            for cut in range(1, len(text)):
                a, b = self.pieces.get(text[:cut]), self.pieces.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (rank[model.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        # Merges whose symbol has no pair of as low a rank: nothing that they make comes before their other places.
        side = np.full(model.get_piece_size(), _NONE)
        for part in (self.keys >> 20, self.keys & 0xFFFFF):
            np.minimum.at(side, part, self.ranks)
        self.safe = side[self.made] > self.ranks
        self.longest = max(map(len, self.pieces))
        #: Piece of each code point.
        self.single = np.zeros(0x110000, np.int32)
        for piece, i in self.pieces.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        single = "".join(re.escape(p) for p in self.pieces if len(p) == 1 and p != MARK)
        #: A run of marks with the known characters after it, or one unknown character.
        self.split = re.compile(f"{MARK}+[{single}]*|[{single}]+|[^{single}{MARK}]")
        self.cache: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or _NONE, row of the table) of each pair."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), at

    def merge(self, sequences: list[str]) -> np.ndarray:
        """Symbols left of each sequence of known characters."""
        if not sequences:
            return np.zeros(0, np.int64)
        ids = self.single[np.frombuffer("".join(sequences).encode("utf-32-le"), np.uint32)].astype(np.int64)
        lengths = np.array([len(s) for s in sequences])
        owner = np.arange(len(sequences))
        left = lengths.copy()
        rank, row = self._pairs(ids, lengths)
        while len(ids):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank, starts)
            # Sequences without a mergeable pair are done.
            live = best < _NONE
            if not live.all():
                keep = np.repeat(live, lengths)
                ids, rank, row, owner, lengths, best = ids[keep], rank[keep], row[keep], owner[live], lengths[live], best[live]
                if not len(ids):
                    break
                starts = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            # Every place; or, where a merge makes a symbol that comes before the others, places that no piece reaches from one before.
            seq = np.searchsorted(starts, hits, side="right") - 1
            safe = np.bincount(seq, ~self.safe[row[hits]], len(starts)) == 0
            far = np.concatenate([[True], (seq[1:] != seq[:-1]) | (hits[1:] - hits[:-1] > self.longest)]) | safe[seq]
            slow = np.bincount(seq, ~far, len(starts)) > PUT_OFF
            if slow.any():
                for k in np.flatnonzero(slow).tolist():
                    left[owner[k]] = self.one_by_one(ids[starts[k] : starts[k] + lengths[k]].tolist())
                keep = np.repeat(~slow, lengths)
                ids, rank, row, owner, lengths = ids[keep], rank[keep], row[keep], owner[~slow], lengths[~slow]
                continue
            hits = hits[far]
            # Of places that overlap every second one from the left.
            run = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
            at = hits[(np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))) % 2 == 0]
            ids[at] = self.made[row[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            # The new symbol's pair is with what follows the one merged away; the pair before it changes too.
            moved = np.cumsum(keep) - 1
            at, at_old = moved[at], at
            ids, rank, row = ids[keep], rank[keep], row[keep]
            lengths = lengths - np.bincount(np.searchsorted(starts, at_old, side="right") - 1, minlength=len(lengths))
            left[owner] = lengths
            starts = np.cumsum(lengths) - lengths
            seq = np.searchsorted(starts, at, side="right") - 1
            rank[at] = _NONE
            inner = at[at < (starts + lengths - 1)[seq]]
            rank[inner], row[inner] = self.rank_of(ids[inner], ids[inner + 1])
            before = at[at > starts[seq]] - 1
            rank[before], row[before] = self.rank_of(ids[before], ids[before + 1])
        return left

    @functools.cached_property
    def by_pair(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def one_by_one(self, ids: list[int]) -> int:
        """Symbols left of a sequence: the pair of lowest rank, of these the leftmost, merged until there is none."""
        pairs, n = self.by_pair, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[k][0], i, k) for i in range(n - 1) if (k := ids[i] << 20 | ids[i + 1]) in pairs]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, key = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j == n or ids[i] << 20 | ids[j] != key:
                continue
            ids[i], ids[j], after[i] = pairs[key][1], -1, after[j]
            left -= 1
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := ids[a] << 20 | ids[b]) in pairs:
                    heapq.heappush(heap, (pairs[k][0], a, k))
        return left

    def _pairs(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, row = np.full(len(ids), _NONE), np.zeros(len(ids), np.int64)
        rank[:-1], row[:-1] = self.rank_of(ids[:-1], ids[1:])
        rank[np.cumsum(lengths) - 1] = _NONE
        return rank, row

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. What is new in all of them is merged at once, or, if they are long, about PART characters at a time."""
        out, held, size = [0] * len(texts), [], 0
        for k, part in parts(texts):
            held.append((k, self.split.findall(part)))
            size += len(part)
            if size >= PART:
                self._count(held, out)
                held, size = [], 0
        self._count(held, out)
        return out

    def _count(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        cache = self.cache
        new = {w for _, words in held for w in words}.difference(cache)
        if new:
            self.learn(list(new))
        for k, words in held:
            out[k] += sum(map(cache.__getitem__, words))
        if len(cache) > CACHE:
            cache.clear()

    def learn(self, words: list[str]) -> None:
        """Put the tokens of these pre-tokens into the cache."""
        known = [w for w in words if w[0] == MARK or w[0] in self.pieces]
        self.cache.update(zip(known, self.merge(known).tolist(), strict=True))
        self.cache.update({w: len(w.encode("utf-8", "surrogatepass")) for w in words if w not in self.cache})


def parts(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(number of the text, part) of all texts, space-marked; texts longer than PART are cut before runs of spaces."""
    spaces = " " + MARK
    for k, text in enumerate(texts):
        at, n = 0, len(text or "")
        while at < n:
            to = at + PART
            if to < n:
                while to > at and not (text[to] in spaces and text[to - 1] not in spaces):
                    to -= 1
                if to == at:  # no such place: on to the next one
                    to = at + PART
                    while to < n and not (text[to] in spaces and text[to - 1] not in spaces):
                        to += 1
            yield k, (MARK if at == 0 else "") + text[at:to].replace(" ", MARK)
            at = to


@functools.lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row a document: _id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A narrow map; null and empty texts have 0 bytes and 0 tokens, repeated rows give repeated rows, an empty table gives
    none. Other columns are not read. model_path must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = merger(model_path)
        for batch in slices(batches, "_text", 1 << 20):
            texts = batch.column(1).to_pylist()
            counts = np.array(table_.counts(texts), np.int64)
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(counts), pa.array(counts > limit)], ["_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), run, f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir):
    """Token counts of all documents under the public 32k sentencepiece model."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("_id", "doc_id")
