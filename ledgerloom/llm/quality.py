"""Quality rules as weak supervision.

Every rule looks at counts of a document and votes good (1), bad (0) or abstains (-1). Nobody knows how far a rule can be
trusted, so expectation-maximisation estimates it from how the rules agree: each rule has probabilities of its three
votes on good and on bad documents, the share of good documents is a further unknown, and rules count as independent
given the class. The posterior probability of good replaces a filter that all rules must pass.

Votes are few-valued, so the corpus reaches the driver as counts of distinct vote patterns, of which there are at most
3 ** len(RULES), however large the corpus is; the posteriors go back the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common
from ledgerloom.llm.common import BLANK, Scratch, map_arrow, pieces, slices, span_hash, spans_hash, table, text_buffers, windows_hash, word_spans

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_letters", "n_symbol_words", "n_stop_like", "n_stutters")
REPEAT_WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_HIGH = np.arange(256) >= 0xC3
_HEAD = (np.arange(256) & 0xC0) != 0x80
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags (bytes) between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(first, seen before) flags: seen twice or more within the row, and not the first of its equals."""
    order = np.lexsort((np.arange(len(hashes)), hashes, rows))
    h, r = hashes[order], rows[order]
    later = np.zeros(len(h), bool)
    later[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = later.copy()
    twice[:-1] |= later[1:]
    out = np.zeros((2, len(h)), bool)
    out[:, order] = twice, later
    return out


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """BASE and MORE of each text of a column, in whole arrays; null counts as empty."""
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    if n == 1 and len(raw) > 2 * common.STEP_BYTES:
        return {c: np.array([x], np.int64) for c, x in _long_counts(raw).items()}
    starts, ends, rows = word_spans(raw, offsets)
    chars = np.concatenate([[0], np.cumsum(_HEAD[raw], dtype=np.int64)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw], dtype=np.int64)])
    length = chars[ends] - chars[starts]
    sum_by = lambda x: np.bincount(rows, x, n).astype(np.int64)
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": sum_by(length), "n_symbols": _per_row(_SYMBOL[raw], offsets)}

    # Lines with a word: those in which a word starts.
    line_starts, line_ends, line_rows = word_spans(raw, offsets, _NEWLINE)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_rows = line_starts[worded], line_ends[worded], line_rows[worded]
    out["n_dup_lines"] = np.bincount(line_rows[_repeated(spans_hash(raw, line_starts, line_ends), line_rows)[1]], minlength=n)
    out["n_lines"] = np.bincount(line_rows, minlength=n)

    hashes = spans_hash(raw, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    out["n_stutters"] = np.bincount(rows[same], minlength=n)
    covered = np.zeros(len(starts) + 1, np.int64)
    k = REPEAT_WINDOW
    if len(starts) >= k:
        whole = np.flatnonzero(rows[k - 1 :] == rows[: len(rows) - k + 1])
        at = whole[_repeated(windows_hash(hashes, k)[whole], rows[whole])[0]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + k, -1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(covered[:-1]) > 0], minlength=n)

    out["n_upper"] = _per_row(_UPPER[raw], offsets)
    out["n_letters"] = _per_row(_UPPER[raw] | _LOWER[raw] | _HIGH[raw], offsets)
    out["n_symbol_words"] = sum_by(symbols[ends] > symbols[starts])
    out["n_stop_like"] = sum_by(length <= 3)
    return {c: x.astype(np.int64) for c, x in out.items()}


def _long_counts(raw: np.ndarray) -> dict[str, int]:
    """What counts() gives of one long text, in steps; a hash a word and a hash a window is what it holds of the whole."""
    step = common.STEP_BYTES
    out = dict.fromkeys((*BASE, *MORE), 0)
    hashes = []

    def total(flags: np.ndarray, part: np.ndarray) -> int:
        return sum(int(flags[part[a : a + step]].sum()) for a in range(0, len(part), step))

    for a, b in pieces(raw, step):
        part = raw[a:b]
        out["n_symbols"] += (symbols := total(_SYMBOL, part))
        out["n_upper"] += total(_UPPER, part)
        out["n_letters"] += total(_UPPER | _LOWER | _HIGH, part)
        if b - a > 2 * step:  # one word, with the blank after it or without
            part = part[: b - a - int(BLANK[part[-1]])]
            length, marked, hashed = np.array([total(_HEAD, part)]), np.array([symbols > 0]), span_hash(part, step)
        else:
            starts, ends, _ = word_spans(part, np.array([0, b - a]))
            chars = np.concatenate([[0], np.cumsum(_HEAD[part], dtype=np.int64)])
            marks = np.concatenate([[0], np.cumsum(_SYMBOL[part], dtype=np.int64)])
            length, marked, hashed = chars[ends] - chars[starts], marks[ends] > marks[starts], spans_hash(part, starts, ends)
        out["n_words"] += len(length)
        out["word_chars"] += int(length.sum())
        out["n_symbol_words"] += int(marked.sum())
        out["n_stop_like"] += int((length <= 3).sum())
        hashes.append(hashed)
    words = np.concatenate(hashes)
    del hashes
    out["n_stutters"] = int((words[1:] == words[:-1]).sum())
    found = windows_hash(words, REPEAT_WINDOW)
    del words
    twice = np.sort(found)
    twice = np.unique(twice[1:][twice[1:] == twice[:-1]])
    covered = np.zeros(out["n_words"], bool)
    for a in range(0, len(found), step):
        some = found[a : a + step]
        at = np.minimum(np.searchsorted(twice, some), max(0, len(twice) - 1))
        seen = twice[at] == some if len(twice) else np.zeros(len(some), bool)
        for k in range(REPEAT_WINDOW):
            covered[a + k : a + k + len(some)] |= seen
    out["n_repeat_words"] = int(covered.sum())

    lines = []
    for a, b in pieces(raw, step, _NEWLINE):
        part = raw[a:b]
        if b - a > 2 * step:  # one line
            part = part[: b - a - int(_NEWLINE[part[-1]])]
            if total(~BLANK, part):
                lines.append(span_hash(part, step))
            continue
        starts, _, _ = word_spans(part, np.array([0, b - a]))
        froms, tos, _ = word_spans(part, np.array([0, b - a]), _NEWLINE)
        worded = np.searchsorted(starts, tos) > np.searchsorted(starts, froms)
        lines.append(spans_hash(part, froms[worded], tos[worded]))
    every = np.concatenate(lines) if lines else np.zeros(0, np.uint64)
    out["n_lines"], out["n_dup_lines"] = len(every), len(every) - len(np.unique(every))
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row a document: _id and BASE and MORE counts; a narrow map over whole texts.

    With carry, the columns of docs come along as _c0, _c1, ... in their order, in place of _id.
    """
    names = [*BASE, *MORE]
    taken = [(f"_c{k}", F.col(c), docs.schema[c]) for k, c in enumerate(docs.columns)] if carry else [("_id", F.col(id_col), docs.schema[id_col])]
    along = len(taken)
    if not carry:
        taken.append(("_text", F.col(text_col), docs.schema[text_col]))
    text = f"_c{docs.columns.index(text_col)}" if carry else "_text"
    ddl = [*(f"{n} {f.dataType.simpleString()}" for n, _, f in taken[:along]), *(f"{c} long" for c in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = counts(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:along], *(pa.array(found[c]) for c in names)], [*batch.schema.names[:along], *names])

    return map_arrow(docs.select(*(c.alias(n) for n, c, _ in taken)), run, ", ".join(ddl))


def _rule(bad, good):
    """Votes bad where bad holds, good where good holds, abstains otherwise and where a count is unknown."""
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules() -> dict:
    """Votes by name. Shares are of words, lines or letters; thresholds leave a band in between in which a rule abstains."""
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    return {
        "length": _rule(c("n_words") < 20, c("n_words") >= 50),
        "word_length": _rule((share("word_chars", "n_words") < 2.5) | (share("word_chars", "n_words") > 14), share("word_chars", "n_words").between(3, 10)),
        "symbols": _rule(share("n_symbols", "n_words") > 0.1, share("n_symbols", "n_words") <= 0.02),
        "symbol_words": _rule(share("n_symbol_words", "n_words") > 0.1, share("n_symbol_words", "n_words") <= 0.02),
        "duplicate_lines": _rule(share("n_dup_lines", "n_lines") > 0.3, share("n_dup_lines", "n_lines") <= 0.1),
        "repeated_words": _rule(share("n_repeat_words", "n_words") > 0.3, share("n_repeat_words", "n_words") <= 0.1),
        "capitals": _rule(share("n_upper", "n_letters") > 0.4, share("n_upper", "n_letters") <= 0.2),
        "stutters": _rule(share("n_stutters", "n_words") > 0.2, share("n_stutters", "n_words") <= 0.05),
        "short_words": _rule(share("n_stop_like", "n_words") < 0.02, share("n_stop_like", "n_words") >= 0.08),
    }


#: Where estimation starts: probability of the votes abstain, bad, good on bad and on good documents. A bad document
#: breaks some rules and keeps most, so a good vote says little and a bad one much.
START = np.array([[0.05, 0.4, 0.55], [0.08, 0.02, 0.9]])


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200, prior: float = 0.8, smooth: float = 2.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) with their counts.

    Returns (share of good, table rule x class x vote, posterior of good a pattern). smooth pseudo-votes a rule, shared
    out as at the start, keep it from certainty, and a rule that comes out voting bad more often on good documents than
    on bad ones is given one distribution for both, so that the classes cannot change places.
    """
    n_rules = patterns.shape[1]
    votes = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)  # pattern x rule x vote
    likely = np.tile(START, (n_rules, 1, 1))  # rule x class x vote
    share = prior
    posterior = np.full(len(patterns), prior)
    for _ in range(rounds):
        log = np.einsum("prv,rcv->pc", votes, np.log(likely)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        share = float(np.clip((new @ weights + prior) / (weights.sum() + 1), 0.01, 0.99))
        seen = np.stack([np.einsum("prv,p->rv", votes, weights * p) for p in (1 - new, new)], 1) + smooth * START
        likely = seen / seen.sum(2, keepdims=True)
        turned = likely[:, 0, 1] < likely[:, 1, 1]
        likely[turned] = likely[turned].mean(1, keepdims=True)
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return share, likely, posterior


def votes():
    """The votes of all rules as one string."""
    return F.concat_ws(",", *(v.cast("string") for v in rules().values()))


def verdicts(measured: DataFrame) -> DataFrame:
    """(votes, posterior) of every pattern of votes in measured."""
    rows = measured.groupBy("votes").count().orderBy("votes").collect()  # 3 ** len(rules) rows at most
    patterns = np.array([[int(v) for v in r["votes"].split(",")] for r in rows], int).reshape(-1, len(rules()))
    posterior = estimate(patterns, np.array([r["count"] for r in rows], float))[2] if rows else []
    return measured.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(rows, posterior, strict=True)], "_votes string, posterior double")


def _failed(min_words: int, max_repeat: float):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 100 * max_repeat * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_repeat: float = 0.3, min_words: int = 20) -> DataFrame:
    """One row a document: _id, the counts, base_failed, votes (string), posterior, kept.

    A document is kept if it passes the base rules (min_words, share of repeated words) and its posterior reaches
    threshold. Null, empty and blank texts have no words and fail; repeated rows give repeated rows; an empty table gives
    none. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = measure(docs, id_col, text_col).withColumn("votes", votes()).withColumn("base_failed", _failed(min_words, max_repeat))
    measured = scratch.keep(measured, "measured")
    found = measured.join(F.broadcast(verdicts(measured)), F.col("votes") == F.col("_votes"))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).select("_id", *BASE, "base_failed", "votes", "posterior", "kept")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_repeat: float = 0.3, min_words: int = 20) -> DataFrame:
    """The rows of docs that judge() keeps, all columns as they are.

    Texts are measured twice, once to estimate and once to decide, which spares writing or shuffling them.
    """
    found = verdicts(measure(docs, id_col, text_col).select(votes().alias("votes")))
    rows = measure(docs, id_col, text_col, carry=True).withColumn("votes", votes()).join(F.broadcast(found), F.col("votes") == F.col("_votes"))
    rows = rows.filter(~_failed(min_words, max_repeat) & (F.col("posterior") >= threshold))
    return rows.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)))


def op4_quality(spark, sf_dir):
    """Verdicts on all documents: the base counts, base_failed, kept, and the posterior."""
    return judge(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")
