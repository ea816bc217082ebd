"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from ledgerloom.llm import bpe_automaton, decontamination, embedding_dedup, language_id, line_dedup, merkle, mixing, ngram_join, pii, quality, token_counts, warc, whitening


def queries():
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_warc": warc.op3_warc,
        "op4_quality": quality.op4_quality,
        "op5_language": language_id.op5_language,
        "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_bpe": bpe_automaton.op9_bpe,
        "op10_pii": pii.op10_pii,
        "op11_decontamination": decontamination.op11_decontamination,
        "op12_merkle": merkle.op12_merkle,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql():
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op2_ngram_join": ngram_join.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op6_embedding_dedup": embedding_dedup.OP6_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op11_decontamination": decontamination.OP11_SQL,
        "op12_merkle": merkle.OP12_SQL,
    }
