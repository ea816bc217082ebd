"""Language of texts by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one in each direction, read a window of bytes; at every byte a softmax over both states gives
the probability of each language. A document is its windows one after the other, whole; the probabilities of all its
bytes are averaged. The network is trained in numpy by backpropagation through time, on a sample of labelled documents
of a bounded number a language (SAMPLE), with the language of the document as the target at every byte.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_arrow, slices, table, text_buffers

#: Labelled documents a language that training sees, about; and characters taken from a random place of each.
SAMPLE = 600
PASSAGE = 256
HIDDEN = 12
WINDOW = 128
#: Windows that go through the network together, and windows of a long text that are laid out at a time.
BATCH = 512
LONG = 8192
UNKNOWN = "und"


class Network:
    """Parameters of one direction each: E (byte -> gates), U (state -> gates), and W, b from both states to languages."""

    def __init__(self, n_classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.E = rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32)
        self.U = rng.normal(0, 0.5 / np.sqrt(h), (2, h, 3 * h)).astype(np.float32)
        self.W = rng.normal(0, 0.3, (2 * h, n_classes)).astype(np.float32)
        self.b = np.zeros(n_classes, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.E, self.U, self.W, self.b]

    def run(self, x: np.ndarray, mask: np.ndarray):
        """(probabilities time x window x class, states, what else backpropagation needs) of windows x (window x time).

        mask is 0 past a window's end.
        """
        n, t_max = x.shape
        h2 = 2 * self.hidden
        states = np.empty((2, t_max, n, self.hidden), np.float32)
        kept = [[None] * t_max, [None] * t_max]
        for d in (0, 1):
            h = np.zeros((n, self.hidden), np.float32)
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                g, u = self.E[d][x[:, t]], h @ self.U[d]
                gates = 0.5 + 0.5 * np.tanh(0.5 * (g[:, :h2] + u[:, :h2]))
                c = np.tanh(g[:, h2:] + gates[:, self.hidden :] * u[:, h2:])
                kept[d][t] = (h, gates, c, u[:, h2:])
                h = (h + gates[:, : self.hidden] * (c - h)) * mask[:, t : t + 1]
                states[d, t] = h
        p = states[0] @ self.W[: self.hidden] + states[1] @ self.W[self.hidden :] + self.b
        p = np.exp(p - p.max(2, keepdims=True))
        return p / p.sum(2, keepdims=True), states, kept

    def sums(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities summed over the bytes of each window (window x class).

        The same network as run(), laid out with windows last, so that every step works on whole rows in place.
        """
        n, t_max = x.shape
        hidden, h2 = self.hidden, 2 * self.hidden
        half = np.ones((3 * hidden, 1), np.float32)
        half[:h2] = 0.5  # of the logistic function, written with tanh
        at, mask = np.ascontiguousarray(x.T).astype(np.intp), np.ascontiguousarray(mask.T)
        ragged = ~mask.all(1)
        states = np.empty((t_max, h2, n), np.float32)
        g, u = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
        for d in (0, 1):
            table, step = np.ascontiguousarray(self.E[d].T) * half, np.ascontiguousarray(self.U[d].T) * half
            h = np.zeros((hidden, n), np.float32)
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                np.take(table, at[t], axis=1, out=g, mode="clip")
                np.matmul(step, h, out=u)
                gates, c = g[:h2], u[h2:]
                gates += u[:h2]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                c *= gates[hidden:]
                c += g[h2:]
                np.tanh(c, out=c)
                c -= h
                c *= gates[:hidden]
                h = np.add(h, c, out=states[t, d * hidden : (d + 1) * hidden])
                if ragged[t]:
                    h *= mask[t]
        p = np.matmul(np.ascontiguousarray(self.W.T), states) + self.b[:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        if ragged.any():
            p *= mask[:, None, :]
        return p.sum(0).T

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over bytes and its gradients; y is the class of each window, weight its weight."""
        p, states, kept = self.run(x, mask)
        t_max, n, k = p.shape
        share = (mask * weight[:, None]).T[:, :, None]
        share = share / share.sum()
        target = np.zeros((n, k), np.float32)
        target[np.arange(n), y] = 1
        loss = float(-(np.log((p * target).sum(2) + 1e-9) * share[:, :, 0]).sum())
        dp = ((p - target) * share).astype(np.float32)
        hidden, h2 = self.hidden, 2 * self.hidden
        dE, dU = np.zeros_like(self.E), np.zeros_like(self.U)
        dW = np.concatenate([states[d].reshape(-1, hidden).T @ dp.reshape(-1, k) for d in (0, 1)])
        for d in (0, 1):
            down = dp @ self.W[d * hidden : (d + 1) * hidden].T
            carried = np.zeros((n, hidden), np.float32)
            dg_all = np.empty((t_max, n, 3 * hidden), np.float32)
            for t in range(t_max - 1, -1, -1) if d == 0 else range(t_max):
                h, gates, c, uc = kept[d][t]
                dh = (down[t] + carried) * mask[:, t : t + 1]
                z, r = gates[:, :hidden], gates[:, hidden:]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], 1)
                dg_all[t] = np.concatenate([dz, dr, dc], 1)
                dU[d] += h.T @ du
                carried = dh * (1 - z) + du @ self.U[d].T
            np.add.at(dE[d], x.T.ravel(), dg_all.reshape(-1, 3 * hidden))
        return loss, [dE, dU, dW, dp.sum((0, 1))]


def windows(raw: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, mask, row) of the windows of every text, one after the other; the last of a text may be short."""
    lengths = np.diff(offsets)
    n = -(-lengths // size)
    rows = np.repeat(np.arange(len(lengths)), n)
    order = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[:-1][rows] + order * size
    left = np.minimum(lengths[rows] - order * size, size)
    place = np.arange(size)
    mask = place < left[:, None]
    at = np.where(mask, starts[:, None] + place, 0)
    return np.where(mask, raw[at] if len(raw) else 0, 0).astype(np.uint8), mask.astype(np.float32), rows


def train(texts: list[str], langs: list[str], rounds: int = 400, batch: int = 192, size: int = 64, rate: float = 0.01, seed: int = 0) -> tuple[list[str], Network] | None:
    """(languages, network) from labelled passages; None without any. Languages weigh alike, however many passages each has."""
    found = sorted(set(langs))
    if not found:
        return None
    net = Network(len(found), seed=seed)
    x, mask, rows = windows(*text_buffers(pa.array(texts, pa.large_string())), size)
    if not len(x):
        return None
    y = np.array([found.index(v) for v in langs])[rows]
    weight = (1 / np.bincount(y, minlength=len(found)).clip(1))[y].astype(np.float32)
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in (0, 1))
    for step in range(1, rounds + 1):
        pick = rng.integers(0, len(x), batch)
        _, grads = net.gradients(x[pick], mask[pick], y[pick], weight[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for p, g, a, b in zip(net.parameters(), grads, first, second, strict=True):
            g = g / max(1.0, norm)
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return found, net


def pooled(net: Network, column: pa.Array) -> np.ndarray:
    """Average over the bytes of each text of the probabilities of the languages; 0 of an empty text."""
    raw, offsets = text_buffers(column)
    out = np.zeros((len(column), len(net.b)))
    if len(column) == 1:  # a text of any length, in steps of whole windows
        for a in range(0, len(raw), LONG * WINDOW):
            part = raw[a : a + LONG * WINDOW]
            out += _summed(net, part, np.array([0, len(part)]))
    else:
        out += _summed(net, raw, offsets)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-9)


def _summed(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities summed over the bytes of each text."""
    x, mask, rows = windows(raw, offsets)
    out = np.zeros((len(offsets) - 1, len(net.b)))
    # Full windows go together, so that only the batches of short ones need the mask.
    full = mask[:, -1] > 0
    for group in (np.flatnonzero(full), np.flatnonzero(~full)):
        for k in range(0, len(group), BATCH):
            at = group[k : k + BATCH]
            np.add.at(out, rows[at], net.sums(x[at], mask[at]))
    return out


def has_letter(text: pa.Scalar) -> bool:
    """Whether a text, if there is one, holds a letter; it is decoded in steps."""
    if not text.is_valid:
        return False
    raw = memoryview(text.as_buffer())
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    return any(any(map(str.isalpha, decode(raw[a : a + 65536]))) for a in range(0, len(raw), 65536))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE, seed: int = 11) -> tuple[list[str], list[str]]:
    """(passages, languages): about per_language documents of each language, chosen by a hash of id and text, a passage of each.

    Rows that repeat an id and its text are drawn once."""
    rows = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").count().select(F.col("lang").alias("_l"), F.least(F.lit(1.0), per_language / F.col("count")).alias("share"))
    draw = lambda k: F.pmod(F.xxhash64("id", "text", F.lit(seed + k)), F.lit(1 << 30)) / float(1 << 30)
    start = F.floor(draw(1) * F.greatest(F.length("text") - PASSAGE + 1, F.lit(1))).cast("int") + 1
    taken = rows.join(F.broadcast(counts), F.col("lang") == F.col("_l")).filter(draw(0) < F.col("share"))
    found = taken.select("lang", "id", F.substring("text", start, F.lit(PASSAGE)).alias("passage")).distinct().orderBy("id", "passage").collect()
    return [r["passage"] for r in found], [r["lang"] for r in found]


def identify(docs: DataFrame, model: tuple[list[str], Network] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: _id, lang_pred, score (0 to 1).

    A null text, and one without a letter, is UNKNOWN with score 0, as is every text under no model. A narrow map over
    whole texts; repeated rows give repeated rows, an empty table gives none; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            text = batch.column(1)
            lettered = np.array([has_letter(t) for t in text], bool)
            names, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
            if shared.value is not None:
                langs, net = shared.value
                p = pooled(net, text)
                names[lettered] = np.array(langs, object)[p.argmax(1)][lettered]
                score[lettered] = p.max(1)[lettered]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score.clip(0, 1))], ["_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, f"_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language(spark, sf_dir):
    """Predicted language of all documents: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    model = train(*sample(docs.filter(~held_out()), "doc_id", "text", "lang"))
    found = identify(docs, model).withColumnRenamed("_id", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
