"""BPE encoding and decoding by a tokenization automaton.

The token automaton reads tokens and accepts exactly the token sequences that the merges produce. It starts with one state
and an arc for every base symbol, and every merge (u, v) -> w in turn adds its gadget:
- the state after u loses its arc v, for u followed by v is now written w;
- w gets an arc from each state that has an arc u (after this loss, so that of u u u the first two are joined);
- the state after w is a copy of the state after v as it stood before this merge.
So there is one state a token. Rows are kept as differences: what a copy inherits is looked up in the state it was
copied from as of the merge of the copy, and an arc w as of its creation in the arc u.

Words are read symbol by symbol through a table of transitions, which the token automaton determines: every prefix of a
word has one accepted spelling, so one token ends at each place. A state of the table stands for what can still matter of
a prefix: its longest end that begins some token, and the tokens that end at the places inside it where a token may begin.
From there and the next symbol follows the token that ends behind the symbol: of the tokens that do, the one that an arc
leads to from the token which ends where it begins. A row is compiled when it is first reached and is then only looked up.
The tokens of a word are read off from its end backwards. Decoding emits the labels of the arcs.

The text rules around the automaton (normal form, white space, lower case, splitting, byte symbols, special strings) are
those of the vocabulary file.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from itertools import accumulate
from operator import getitem

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.common import map_arrow, slices, table

#: Words, and states of the table, that a task remembers before it gives the memory back.
CACHE = 100_000
#: Characters of a text that are encoded at a time; a longer text is cut at spaces.
PART = 1 << 20


class State(dict):
    """A row of the table of transitions, by symbol; what is not there yet is compiled."""

    __slots__ = ("means", "of", "token")

    def __missing__(self, symbol: str):
        found = self[symbol] = self.of.compile(self, symbol)
        return found

    def __bool__(self) -> bool:
        return True


class Automaton:
    """Compiled from the merges, in order; tokens are their ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        """suffix belongs to the last symbol of a word."""
        self.label = {i: t for t, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.lost: dict[int, int] = {}
        self.by_text: dict[str, int] = {}
        merged = {a + b for a, b in merges}
        self.by_text.update((t, i) for t, i in vocab.items() if t not in merged)
        for step, (a, b) in enumerate(merges):
            self._gadget(step, vocab[a], vocab[b], a + b, vocab[a + b])
        self.begins = {t[:k] for t in self.by_text for k in range(len(t))}
        self.length = {i: len(t.removesuffix(suffix)) if suffix else len(t) for t, i in self.by_text.items()}
        self.suffix = suffix
        self._start()

    def _gadget(self, step: int, u: int, v: int, text: str, w: int) -> None:
        # Where an earlier merge has already taken v from the state after u, there is nothing to join.
        if self._arc(u, v, step - 1):
            self.born[w], self.left[w], self.right[w] = step, u, v
            self.by_text[text] = w
        self.lost.setdefault(u << 20 | v, step)

    def _arc(self, x: int, t: int, step: int) -> bool:
        """Whether the state after token x has an arc t once the merges up to step are in."""
        born, lost = self.born, self.lost
        while True:
            if lost.get(x << 20 | t, step + 1) <= step:
                return False
            if born[t] >= born[x] and born[t] >= 0:
                step, t = born[t], self.left[t]
            elif born[x] >= 0:
                step, x = born[x] - 1, self.right[x]
            else:
                return True

    def _start(self) -> None:
        """A table of the state before a word alone."""
        for state in getattr(self, "states", {}).values():
            state.clear()  # states refer to each other
        self.states: dict[tuple[str, tuple[int, ...]], State] = {}
        self.arcs = 0
        self.start = self._state(("", (-1,)), -1)

    def _state(self, means: tuple[str, tuple[int, ...]], token: int) -> State:
        state = self.states[means] = State()
        state.of, state.means, state.token = self, means, token
        return state

    def next(self, state: State, symbol: str) -> tuple[str, int]:
        """(end of the prefix, token that ends behind the symbol)."""
        tail, before = state.means
        text, by_text, last = tail + symbol, self.by_text, len(self.lost)
        for k, x in enumerate(before):
            if x != -2 and (token := by_text.get(text[k:])) is not None and (x == -1 or self._arc(x, token, last)):
                return text, token
        raise ValueError(f"no arcs spell {text!r}")

    def compile(self, state: State, symbol: str) -> State | int:
        """Where the symbol leads from a state: a token behind a word's last symbol, else a state."""
        text, token = self.next(state, symbol)
        self.arcs += 1
        if self.suffix and symbol.endswith(self.suffix):
            return token
        before, begins, cut = (*state.means[1], token), self.begins, 0
        while before[cut] == -2 or text[cut:] not in begins:
            cut += 1
        tail = text[cut:]
        # Places where no token can begin any more do not tell states apart.
        means = (tail, tuple([t if t != -2 and tail[k:] in begins else -2 for k, t in enumerate(before[cut:])]))
        return self.states.get(means) or self._state(means, token)

    def encode(self, text: str) -> list[int]:
        """Token ids of a word, a character a base symbol."""
        if not text:
            return []
        if len(self.states) > CACHE or self.arcs > 3 * CACHE:
            self._start()
        passed = list(accumulate(text[:-1], getitem, initial=self.start))
        last = passed[-1][text[-1] + self.suffix]
        length, out = self.length, [last if self.suffix else last.token]
        at = len(text) - length[out[0]]
        while at:
            last = passed[at].token
            out.append(last)
            at -= length[last]
        out.reverse()
        return out


class Codec:
    """A vocabulary file's text rules around its automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.label.update((i, t) for t, i in self.special.items())
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Text rules of the file, by the library it is written for: they follow its tables of characters.
        rules = Tokenizer.from_file(path)
        self.normal, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        parts = {c: [w for w, _ in self.split(f"a{c}a")] for c in map(chr, range(33, 256)) if c.isprintable()}
        #: Letters make one word, marks a word of their own; both as the file has them, up to U+00FF.
        letters = "".join(re.escape(c) for c, words in parts.items() if len(words) == 1)
        marks = "".join(re.escape(c) for c, words in parts.items() if len(words) == 3 and len(self.split(f"a{c}!")) == 2)
        self.simple = re.compile(f"([{letters}]+)([{marks}]*)").fullmatch
        #: Their byte symbols.
        self.symbols = {ord(c): self.split(c)[0][0] for c, words in parts.items() if len(words) in (1, 3)}
        self.spaces = re.compile("[\t-\r\x85\xa0]")
        #: Ids of each piece between spaces.
        self.cache: dict[str, list[int]] = {}

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, joined by a space, as the vocabulary file names no decoder."""
        return " ".join(map(self.automaton.label.__getitem__, ids))

    def _piece(self, piece: str) -> list[int]:
        word = self.automaton.encode
        if simple := self.simple(piece):
            letters, marks = simple.groups()
            if not piece.isascii():
                letters, marks = letters.translate(self.symbols), marks.translate(self.symbols)
            return word(letters) + word(marks) if marks else word(letters)
        return [i for w, _ in self.split(piece) for i in word(w)]

    def ids(self, text: str) -> list[int]:
        cache, found = self.cache, []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                found.append(self.special[part])
                continue
            try:
                part.encode("latin-1")  # these characters are in normal form, and each has one lower case
                part = self.spaces.sub(" ", part).lower()
            except UnicodeEncodeError:
                part = self.normal(part)
            for piece in part.split(" "):
                if piece:
                    if (known := cache.get(piece)) is None:
                        if len(cache) > CACHE:
                            cache.clear()
                        known = cache[piece] = self._piece(piece)
                    found += known
        return found

    def encoded(self, text: str | None) -> Iterator[tuple[list[int], str]]:
        """(ids, decoded text) of one part of a text after the other; decoded parts are joined by a space. Nothing of a null or empty text."""
        at, n = 0, len(text or "")
        while at < n:
            to = at + PART
            if to < n:
                to = text.rfind(" ", at, to) + 1 or text.find(" ", to) + 1 or n
                to = to if to > at else n
            ids = self.ids(text[at:to])
            if ids:
                yield ids, self.decode(ids)
            at = to


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: _id, ids array<long>, decoded text.

    A narrow map; null and empty texts have no ids and an empty text, repeated rows give repeated rows, an empty table
    gives none. Other columns are not read. vocab_path must be readable on every executor.
    """

    def row(parts) -> tuple:
        parts = list(parts)
        return [i for ids, _ in parts for i in ids], " ".join(decoded for _, decoded in parts)

    return _map(docs, vocab_path, id_col, text_col, "ids array<long>, decoded string", row, [pa.list_(pa.int64()), pa.large_string()])


def digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with n_tokens, ids_sha256 and decoded_sha256 in place of the ids and the text."""

    def row(parts) -> tuple:
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for ids, decoded in parts:
            of_text.update((" " * bool(n) + decoded).encode("utf-8", "surrogatepass"))
            of_ids.update(struct.pack(f"<{len(ids)}I", *ids))
            n += len(ids)
        return n, of_ids.hexdigest(), of_text.hexdigest()

    return _map(docs, vocab_path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, [pa.int64(), pa.string(), pa.string()])


def _map(docs: DataFrame, vocab_path: str, id_col: str, text_col: str, ddl: str, row, kinds: list[pa.DataType]) -> DataFrame:
    names = ["_id", *(f.split(" ")[0] for f in ddl.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(vocab_path)  # of this task alone: workers outlive their tasks, and several wait beside an executor's heap
        for batch in slices(batches, "_text"):
            found = [row(own.encoded(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, f"_id {kind}, {ddl}")


def op9_bpe(spark, sf_dir):
    """Ids and decoded texts of all documents under the public 49k word BPE, as counts and digests."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("_id", "doc_id")
