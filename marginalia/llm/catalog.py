"""All queries of the training-data operators by name, with their SQL counterparts."""

from __future__ import annotations

from . import grouped_split, leakage, mixing, near_duplicates, pair_defects, scan_noise, sentences, set_pairs, term_weight, vector_forest

MODULES = [set_pairs, term_weight, grouped_split, near_duplicates, vector_forest, leakage, mixing, sentences, pair_defects, scan_noise]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
