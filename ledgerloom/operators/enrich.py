"""Enrichment of clause rows by a provider: a pluggable function over batches, with the relational parts around it.

A provider takes a pandas frame of one batch and gives a frame of answers with the clause's key. What is sent, how answers
meet their rows again and what stands in for a missing answer are queries here; the provider alone is Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import first_match
from ledgerloom.operators import blocks

#: Tokens that one request may hold, by four characters a token, and clauses of a batch.
MAX_TOKENS = 4000
BATCH = 20


def halves(batch: pd.DataFrame, text_col: str, max_tokens: int = MAX_TOKENS) -> Iterator[pd.DataFrame]:
    """A batch cut in halves until each holds max_tokens, or one row."""
    tokens = int(-(-batch[text_col].str.len().fillna(0).sum() // 4))
    if len(batch) <= 1 or tokens <= max_tokens:
        yield batch
    else:
        middle = len(batch) // 2
        yield from halves(batch.iloc[:middle], text_col, max_tokens)
        yield from halves(batch.iloc[middle:], text_col, max_tokens)


def enrich(df: DataFrame, keys: list[str], text_col: str, provider: Callable[[pd.DataFrame], pd.DataFrame], answers: str, where: Column | None = None, batch: int = BATCH, concurrency: int | None = None) -> DataFrame:
    """Answers of a provider (DDL answers, keys included) to the rows for which where holds; filtered before Python sees them.

    concurrency bounds the requests that run at once."""
    asked = df.filter(where) if where is not None else df
    asked = asked.select(*keys, text_col)
    if concurrency:
        asked = asked.repartition(concurrency)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                for part in halves(frame.iloc[k : k + batch], text_col):
                    yield provider(part.reset_index(drop=True))

    return asked.mapInPandas(run, answers)


def merge(df: DataFrame, answers: DataFrame, keys: list[str], defaults: dict[str, object], valid: dict[str, list] | None = None) -> DataFrame:
    """Answers put in columns that are null, defaults where there is none or it is not a valid one."""
    valid = valid or {}
    side = answers.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in defaults))
    rows = df.join(side, keys, "left")
    ok = lambda c: F.when(F.col(f"_a_{c}").isin(*valid[c]), F.col(f"_a_{c}")) if c in valid else F.col(f"_a_{c}")
    have = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return rows.withColumns({c: F.coalesce(have(c), ok(c), F.lit(d)) for c, d in defaults.items()}).drop(*(f"_a_{c}" for c in defaults))


#: Characters of a text's head and tail that a first look reads, and what it looks for. Fixed values.
HEAD, TAIL = 20_000, 5_000
PREFLIGHT = ("documentType", "governingLaw", "executionDate", "employerName", "employeeDesignation", "employeeAddress", "companyAddress")


def preflight(df: DataFrame, keys: list[str], text_col: str, provider: Callable[[pd.DataFrame], pd.DataFrame], fields: tuple[str, ...] = PREFLIGHT, from_tail: tuple[str, ...] = ("governingLaw",), head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """First facts of each text, as a struct of fields: keys, metadata, steps.

    A provider answers frames of keys and text with keys and fields. It is asked the head of every text that is not blank, then the
    tail of those longer than the head that still lack a field of from_tail, for these fields only. What is not answered, or
    answered empty, is null. keys tell rows apart; steps says how many questions a row took. A row's questions are asked in
    one task, one batch after the other, so texts are read once."""
    ddl = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"`{f}` string" for f in fields)])
    parts = df.select(*keys, F.trim(F.substring(text_col, 1, head)).alias("_head"), F.when(F.length(text_col) > head, F.trim(F.right(text_col, F.lit(tail)))).alias("_tail"))
    blank = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        """Answers with every row of the frame once; heads first, then tails of what they left open."""
        said = {}
        for step, column in ((1, "_head"), (2, "_tail")):
            todo = frame[frame[column].fillna("").str.len() > 0]
            if step == 2:
                todo = todo[[any(not said.get(i, {}).get(f) for f in from_tail) for i in todo.index]]
            if not len(todo):
                continue
            for part in halves(todo.rename(columns={column: "text"})[[*keys, "text"]], "text"):
                answer = provider(part.reset_index(drop=True))
                by_key = {tuple(r[k] for k in keys): r for r in answer.to_dict("records")}
                for i, key in zip(part.index, part[keys].itertuples(index=False, name=None), strict=True):
                    own, new = said.setdefault(i, {"steps": 0}), by_key.get(key, {})
                    own["steps"] = step
                    for f in fields if step == 1 else from_tail:
                        own[f] = own.get(f) or (new.get(f) if isinstance(new.get(f), str) and new.get(f) else None)
        out = frame[keys].copy()
        for f in fields:
            out[f] = [said.get(i, {}).get(f) for i in frame.index]
        out["steps"] = [said.get(i, {}).get("steps", 0) for i in frame.index]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), BATCH):
                yield ask(frame.iloc[k : k + BATCH])

    asked = parts.filter(~blank("_head") | ~blank("_tail")).mapInPandas(run, f"{ddl}, steps int")
    unasked = parts.filter(blank("_head") & blank("_tail")).select(*keys, *(F.lit(None).cast("string").alias(f) for f in fields), F.lit(0).alias("steps"))
    return asked.unionByName(unasked).select(*keys, F.struct(*fields).alias("metadata"), "steps")


def match_answers(df: DataFrame, answers: DataFrame, group: str, id_col: str, position: str) -> DataFrame:
    """Answers (group, answer_id, answer_no, answer) to rows: by id, else by place if a group has as many answers as rows, else
    the only answer of its group."""
    count = Window.partitionBy(group)
    rows = df.withColumn("_rows", F.count(F.lit(1)).over(count))
    sizes = answers.groupBy(group).agg(F.count(F.lit(1)).alias("_answers"), F.min_by("answer", "answer_no").alias("_only"))
    by_id = answers.filter("answer_id IS NOT NULL").groupBy(group, "answer_id").agg(F.min_by("answer", "answer_no").alias("_by_id")).select(F.col(group).alias("_g1"), "answer_id", "_by_id")
    by_no = answers.select(F.col(group).alias("_g2"), F.col("answer_no").alias("_no"), F.col("answer").alias("_by_no"))
    found = rows.join(sizes, group, "left").join(by_id, (F.col(group) == F.col("_g1")) & (F.col(id_col) == F.col("answer_id")), "left")
    found = found.join(by_no, (F.col(group) == F.col("_g2")) & (F.col(position) == F.col("_no")), "left")
    value = F.coalesce("_by_id", F.when(F.col("_rows") == F.col("_answers"), F.col("_by_no")), F.when(F.col("_answers") == 1, F.col("_only")))
    return found.select(*df.columns, value.alias("answer"))


def windows_of_clauses(df: DataFrame, group: str, index: str, size: int = 15) -> DataFrame:
    """Clauses in windows of so many, as arrays in order: what an audit of references sees at once."""
    w = F.floor(F.col(index) / size).cast("int").alias("window")
    return df.groupBy(group, w).agg(F.array_sort(F.collect_list(F.struct(index, "raw_text"))).alias("clauses"))


#: Case law that goes with a clause: how many cases, and the least cosine. Fixed values.
PRECEDENTS, LEAST_COSINE = 2, 0.4
#: Kinds of document for which a judge is told what to ground its reasons in: words of the kind, what it is told. Fixed values.
GROUNDS = (("real estate", "Ground property transfers in the Transfer of Property Act, 1882 or the Registration Act, 1908, not in the Contract Act."),)


def request_context(clauses: DataFrame, key: str, group: str, text_col: str, symbols: DataFrame, cases: DataFrame | None = None, vec_col: str = "embedding", kind_col: str | None = None) -> DataFrame:
    """clauses with what a judge is told beside the text: symbols (the defined terms of its group, of three letters and more, that
    stand in it, by term), precedents (the nearest cases) and ground (by the kind of document).

    symbols: group, term, definition; cases: case_id, case_title, citation, summary, vec. key tells clauses apart; a clause
    without a vector has no precedents."""
    side = symbols.filter(F.length("term") > 2).select(F.col(group).alias("_g"), "term", "definition")
    said = clauses.select(key, group, F.lower(text_col).alias("_t")).join(side, F.col(group) == F.col("_g")).filter(F.contains("_t", F.lower("term")))
    said = said.groupBy(F.col(key).alias("_k1")).agg(F.array_sort(F.collect_set(F.struct("term", "definition"))).alias("symbols"))
    none = F.array().cast("array<struct<term: string, definition: string>>")
    rows = clauses.join(said, F.col(key) == F.col("_k1"), "left").withColumn("symbols", F.coalesce("symbols", none)).drop("_k1")
    lines = F.array().cast("array<string>")
    if cases is not None:
        near = blocks.best(clauses.select(F.col(key).alias("_k2"), F.col(vec_col).alias("_v")), cases, "_k2", "_v", "case_id", "vec", PRECEDENTS).filter(F.col("score") >= LEAST_COSINE)
        line = F.concat(F.lit("CASE: "), "case_title", F.lit(" | CITATION: "), "citation", F.lit(" | PRECEDENT: "), "summary")
        named = near.join(cases.select("case_id", line.alias("_line")), "case_id")
        order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "case_id", "_line")))
        found = named.groupBy("_k2").agg(F.transform(order, lambda x: x["_line"]).alias("precedents"))
        rows = rows.join(found, F.col(key) == F.col("_k2"), "left").withColumn("precedents", F.coalesce("precedents", lines)).drop("_k2")
    else:
        rows = rows.withColumn("precedents", lines)
    kind = F.lower(F.col(kind_col)) if kind_col else F.lit(None).cast("string")
    return rows.withColumn("ground", first_match([(F.contains(kind, F.lit(words)), F.lit(what)) for words, what in GROUNDS], F.lit(None).cast("string")))


def parse_json(raw: Column, schema: str) -> Column:
    """JSON in an answer: as it stands, in a fence, or the widest braces; null if none of them reads."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\}|\[.*\])", 1)
    reads = lambda c: F.when(F.get_json_object(c, "$").isNotNull() | (F.json_array_length(c) >= 0), F.from_json(c, schema))
    return F.coalesce(reads(raw), reads(fenced), reads(braces))


#: Provisions that an offline stand-in warns of: name, words of which a text contains one, the clause type it is confined
#: to, issues, negotiation tip. In order, the first counts. Fixed values.
FLAGS = (
    ("wage_deferral", "defer|withhold|deduct|negative margin|reserve", None, ["Unilateral wage deferral", "Unauthorised base salary withholding"], "Request timely payments in compliance with the Payment of Wages Act, 1936. Earned salary cannot be withheld."),
    ("availability_waiver", "24/7|availability|latency|weekly working hours|45-minute|45 minute|shops", None, ["Waiver of statutory working hours", "Shops & Establishments Act hour violations"], "Refuse blanket waivers of Shops & Establishments Act hour protections. Establish standard rest periods."),
    ("training_bond", "training|repay|bond|administrative fee|compounding interest|36 months|[$]450", None, ["Predatory internal training bond", "Arbitrary internal billing penalty"], "Restrict employment bonds strictly to direct, verifiable external training costs outside basic onboarding."),
    ("ip_life_capture", "personal device|weekend|conceive|outside the company|off-duty|global|life-capture", "ip_ownership", ["IP life-capture off-duty assignment", "Copyright Section 57 moral rights violations"], "Limit IP assignment to work created strictly during official hours and directly linked to your job scope."),
    ("liquidated_penalty", "200%|liquidated|ex-parte|injunct|without proving|compensation penalty|penalty clause", None, ["Punitive 200% liquidated damages penalty", "Ex-parte injunction mandate"], "Remove the 200% automatic penalty. Cap liabilities to actual, proven direct loss."),
)
#: The same by clause type, where no provision is met: compliance level, issues, tip. Fixed values.
BY_TYPE = {
    "non_compete": ("high", ["Broad post-termination non-compete duration", "Potential restraint of trade concern"], "Ask to reduce the restriction to 6 months and limit its geographical scope to your city."),
    "arbitration": ("medium", ["Unilateral arbitrator appointment by the company"], "Request that the arbitrator be appointed mutually by both parties or a recognized body like ICA."),
    "dispute_resolution": ("medium", ["Unilateral arbitrator appointment by the company"], "Request that the arbitrator be appointed mutually by both parties or a recognized body like ICA."),
    "ip_ownership": ("low", [], "Request a clear exclusion list for any personal side-projects or pre-existing inventions."),
    "confidentiality": ("low", [], "Negotiate to limit the confidentiality obligation to 2-3 years post-termination."),
    "privacy_data": ("high", ["Lack of revocable or specific consent mechanisms"], "Request a copy of the company data protection policy and ensure they get consent for every transfer."),
}
ANY_TIP = "Ensure you have written copies of all communications and terms."


def offline_advice(text: Column, clause_type: Column) -> Column:
    """(flag, compliance, issues, review, advice) of a clause without a model: by the first provision met, else by its type."""

    def said(flag: str | None, level: str, issues: list[str], tip: str) -> Column:
        listed = F.array(*map(F.lit, issues)).cast("array<string>")
        return F.struct(F.lit(flag).cast("string").alias("flag"), F.lit(level).alias("compliance"), listed.alias("issues"), F.lit(bool(issues)).alias("review"), F.lit(tip).alias("advice"))

    low = F.lower(text)
    made = [(low.rlike(words) if kind is None else low.rlike(words) & (clause_type == kind), said(flag, "high", issues, tip)) for flag, words, kind, issues, tip in FLAGS]
    made += [(clause_type == kind, said(None, *rest)) for kind, rest in BY_TYPE.items()]
    return first_match(made, said(None, "low", [], ANY_TIP))


def aligned(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places (in x, in y) of a longest common subsequence of two lists of words, in order.

    Equal ends and words that one side lacks are set aside, which keeps it longest. For the rest a row of the table of
    lengths is one integer: bit j is 0 where word j of y makes the subsequence longer. Every so many rows are kept, the rows
    between made again on the way back, so memory grows with the square root of x times y."""
    head, most = 0, min(len(x), len(y))
    while head < most and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < most - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    ends = [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]
    both = set(x[head : len(x) - tail]) & set(y[head : len(y) - tail])
    rows = [i for i in range(head, len(x) - tail) if x[i] in both]
    cols = [j for j in range(head, len(y) - tail) if y[j] in both]
    width = len(cols) // 8 + 1
    at: dict[str, bytearray] = {w: bytearray(width) for w in both}
    for k, j in enumerate(cols):
        at[y[j]][k >> 3] |= 1 << (k & 7)
    places = {w: int.from_bytes(bits, "little") for w, bits in at.items()}
    full = (1 << len(cols)) - 1

    def below(v: int, i: int) -> int:
        u = v & places[x[rows[i]]]
        return ((v + u) | (v - u)) & full

    step = int(len(rows) ** 0.5) + 1
    v, kept = full, []
    for i in range(len(rows)):
        if i % step == 0:
            kept.append(v)
        v = below(v, i)
    found, j = [], len(cols)
    for block in range(len(kept) - 1, -1, -1):
        first, last = block * step, min(len(rows), (block + 1) * step)
        lines, v = [kept[block].to_bytes(width, "little")], kept[block]
        for i in range(first, last):
            v = below(v, i)
            lines.append(v.to_bytes(width, "little"))
        i = last - first
        while i and j:
            byte, bit = (j - 1) >> 3, 1 << ((j - 1) & 7)
            if lines[i][byte] & bit:
                j -= 1
            elif lines[i - 1][byte] & bit:
                i, j = i - 1, j - 1
                found.append((rows[first + i], cols[j]))
            else:
                i -= 1
    return [(k, k) for k in range(head)] + found[::-1] + ends


def changes(before: str | None, after: str | None) -> Iterator[tuple[str, list[str]]]:
    """(op, words) of the runs of words kept, removed and added from one text to the next: as few changed words as can be."""
    x, y = (before or "").split(), (after or "").split()
    i = j = 0
    same: list[str] = []
    for a, b in [*aligned(x, y), (len(x), len(y))]:
        if a > i or b > j:
            gap = (("same", same), ("removed", x[i:a]), ("added", y[j:b]))
            yield from ((op, words) for op, words in gap if words)
            same = []
        same += x[a : a + 1]
        i, j = a + 1, b + 1
    if same:
        yield "same", same


#: Rows and characters of an output batch of word_diff.
DIFF_ROWS, DIFF_CHARS = 50_000, 8_000_000


def word_diff(df: DataFrame, id_col: str, before: str, after: str) -> DataFrame:
    """Runs of words that were kept, removed or added between two whole texts: id, ord, op, words. A map over rows, as no
    built-in aligns sequences; work grows with the product of the words in which both differ, 30 of them at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_col, "ord", "op", "words"]
        for frame in frames:
            rows, chars = [], 0
            for i, a, b in frame.itertuples(index=False):
                for k, (op, words) in enumerate(changes(a, b)):
                    rows.append((i, k, op, " ".join(words)))
                    chars += len(rows[-1][3])
                    if len(rows) >= DIFF_ROWS or chars >= DIFF_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, chars = [], 0
            yield pd.DataFrame(rows, columns=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, before, after).mapInPandas(run, f"{id_col} {kind}, ord int, op string, words string")


def embed(df: DataFrame, keys: list[str], text_col: str, provider: Callable[[pd.DataFrame], pd.DataFrame], vec_col: str = "embedding", ddl_keys: str = "") -> DataFrame:
    """df with unit vectors from a provider (keys, vec_col) where it has none yet; rows that have one are not sent."""
    from ledgerloom.functions.vectors import norm

    kinds = ddl_keys or ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    asked = df.filter(F.col(vec_col).isNull()).withColumn(text_col, F.trim(F.regexp_replace(text_col, r"\s+", " ")))
    made = enrich(asked, keys, text_col, provider, f"{kinds}, {vec_col} array<double>")
    unit = F.when(norm(F.col(vec_col)) > 0, F.transform(vec_col, lambda x: x / norm(F.col(vec_col)))).otherwise(F.col(vec_col))
    made = made.select(*keys, unit.alias("_made"))
    return df.join(made, keys, "left").withColumn(vec_col, F.coalesce(vec_col, F.col("_made").cast(df.schema[vec_col].dataType))).drop("_made")
