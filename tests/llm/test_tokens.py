"""Token counts and BPE against the libraries the vocabularies are for."""

import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from ledgerloom.llm import bpe_automaton, token_counts  # noqa: E402

RNG = random.Random(5)
ODD = [None, "", "  ", "a", " a  b   c", "▁▁x ▁", "a" * 40, " " * 50 + "x", "<s></s><unk>", "<|endoftext|>x<|startoftext|> y", "日本語 漢字", "a\x00b\r\n\t", "ΑΣ ΟΔΟΣ", "İstanbul ǅ", "it's I'LL we've", "é Å ﬁ 가", "½ ² Ⅷ 1234", "🎉🎉", " 　x​y", "=-" * 900, "q" * 3000]
ODD += ["".join(RNG.choice("ab▁ \n.,éß1#日'İΣ") for _ in range(RNG.randint(1, 60))) for _ in range(800)]
ODD += ["".join(RNG.choice("etaoinshr") for _ in range(RNG.randint(1, 60))) for _ in range(800)]
SCHEMA = "doc_id long, text string, _id int, n_tokens string"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, "clash") for k, t in enumerate(texts)], SCHEMA)


def test_counts_equal_sentencepiece(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["_id"]: r for r in token_counts.token_counts(frame(spark, ODD), path, limit=100).collect()}
    want = [len(library.encode(t or "")) for t in ODD]
    assert [got[k]["n_tokens"] for k in range(len(ODD))] == want
    assert [got[k]["n_bytes"] for k in range(len(ODD))] == [len((t or "").encode()) for t in ODD]
    assert [got[k]["over_limit"] for k in range(len(ODD))] == [n > 100 for n in want]
    assert token_counts.token_counts(frame(spark, []), path).collect() == []


def test_long_texts_and_sequences(monkeypatch):
    """Sequences of thousands of symbols, and texts cut into parts, against the library."""
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("theinga") for _ in range(n)) for n in (700, 5000, 20_000, *[300] * 40)]
    texts += [rng.choice(("the", "ing", "anan")) * 400 for _ in range(3)]
    texts += ["ab" * 3000, "a" * 9999, "the  a " * 500, " " * 300, " x" * 90, *ODD]
    want = [len(library.encode(t or "")) for t in texts]
    assert token_counts.Merger(path).counts(texts) == want
    monkeypatch.setattr(token_counts, "PART", 40)
    assert token_counts.Merger(path).counts(texts) == want


def test_texts_encoded_in_parts(monkeypatch):
    path = P.path("word_bpe_49k.json")
    codec = bpe_automaton.Codec(path)
    whole = [[i for ids, _ in codec.encoded(t) for i in ids] for t in ODD]
    monkeypatch.setattr(bpe_automaton, "PART", 20)
    monkeypatch.setattr(bpe_automaton, "CACHE", 50)
    for t, ids in zip(ODD, whole, strict=True):
        parts = list(codec.encoded(t))
        assert [i for a, _ in parts for i in a] == ids and " ".join(d for _, d in parts) == codec.decode(ids)


def test_encoding_equals_tokenizers_and_decodes(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    rows = {r["_id"]: r for r in bpe_automaton.encode(frame(spark, ODD), path).collect()}
    short = {r["_id"]: r for r in bpe_automaton.digests(frame(spark, ODD), path).collect()}
    for k, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert rows[k]["ids"] == ids and rows[k]["decoded"] == decoded, text
        assert short[k]["n_tokens"] == len(ids)
        assert short[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert short[k]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_automaton.digests(frame(spark, []), path).collect() == []


def test_automaton_of_few_merges_against_plain_merging():
    """Every word over two symbols, under merges with equal and overlapping sides."""
    from itertools import product

    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("b", "ab"), ("aa", "aa"), ("ab", "ab")]
    vocab = {t: i for i, t in enumerate(["a", "b", *(x + y for x, y in merges)])}
    automaton = bpe_automaton.Automaton(vocab, merges)
    for n in range(1, 11):
        for word in product("ab", repeat=n):
            symbols = list(word)
            while True:
                pairs = [(merges.index(p), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges]
                if not pairs:
                    break
                _, i = min(pairs)
                symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
            assert automaton.encode("".join(word)) == [vocab[s] for s in symbols], word
