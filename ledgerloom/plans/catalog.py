"""All registered queries, and the flagship."""

from __future__ import annotations

from ledgerloom.plans import contracts, documents, intake, lookups, tables  # noqa: F401
from ledgerloom.plans.registry import ORACLE, QUERIES


def flagship(spark, sf_dir):
    """Risk summary a document: normalised, cut into clauses, matched with a lexicon, scored, summarised."""
    return documents.risk_summary(spark, sf_dir)


def queries():
    return QUERIES


def oracle_sql():
    return ORACLE
