"""Names of all queries of this subpackage, with their SQL."""

from __future__ import annotations

from folioquarry.llm import q_alignment, q_charforms, q_defects, q_leaks, q_scans, q_sentences, q_sizes

#: Modules that define QUERIES (name to function) and ORACLE (name to SQL). They are imported here, so that what is missing shows at once.
MODULES = (q_charforms, q_leaks, q_sizes, q_defects, q_sentences, q_scans, q_alignment)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
