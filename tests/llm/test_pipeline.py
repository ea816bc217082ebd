"""run() against the stages done by hand: SQL for lines, brute force for classes and amounts, the library for ids."""

import hashlib

import duckdb
import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
from ledgerloom.llm import line_dedup, quality  # noqa: E402
from tests.llm.test_joins import brute_classes  # noqa: E402
from tests.llm.test_mixing import brute_targets  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run(spark):
    from tokenizers import Tokenizer

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["_id"] for r in quality.judge(documents).filter("kept").collect()}
    docs = duckdb.read_parquet(f"{SF}/documents.parquet").df()
    docs = docs[docs.doc_id.isin(kept)]
    con = duckdb.connect()
    con.register("docs", docs)
    left = con.execute("WITH " + line_dedup.WINDOWS_SQL.replace("{docs}", "docs") + " SELECT doc_id, n_deleted, text FROM left_over").df()
    text = {i: t for i, n, t in left.itertuples(index=False) if n == 0 or t.split()}
    classes, _ = brute_classes(sorted(text.items()))
    text = {i: t for i, t in text.items() if classes[i] == i}
    source = dict(docs[["doc_id", "source"]].itertuples(index=False))
    sizes = {}
    for i, t in text.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(t.split())
    targets = brute_targets(sizes)

    got = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    taken, longest = dict.fromkeys(sizes, 0), {}
    for r in got:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        n, s = len(text[r["doc_id"]].split()), source[r["doc_id"]]
        taken[s] += n
    for i, t in text.items():
        longest[source[i]] = max(longest.get(source[i], 0), len(t.split()))
    assert max(sum(r["doc_id"] == i for r in got) for i in {r["doc_id"] for r in got}) <= 2
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest[s], s


def test_stages_keep_columns_and_bear_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some words here " * 30, None, None, 5)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= 2 * len(rows), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_one_row_of_each_group_stays(spark):
    """Rows that repeat an id, rows without one, and near copies of them."""
    text, other = " ".join(f"word{k}" for k in range(60)), " ".join(f"other{k}" for k in range(60))
    near = text + " more"
    rows = [(5, text, "en", "a", 1), (3, near, "en", "a", 1), (3, near, "en", "a", 1), (None, text, "en", "a", 1), (None, other, "en", "a", 1), (None, other, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[4]], key=repr)
    mixed = corpus_pipeline.mix(spark, kept, SF)
    assert {r["doc_id"] for r in mixed.collect()} == {3, None}
