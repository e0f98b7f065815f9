"""All core queries by name, with their SQL counterparts."""

from __future__ import annotations

from marginalia.operators import blocks, bundle, collection, enrich, evaluation, layout, mutations, reports, retrieval, review, scalars
from marginalia.streaming import events

MODULES = [retrieval, bundle, enrich, blocks, layout, evaluation, review, mutations, reports, scalars, collection, events]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark, sf_dir: str):
    """From search query to keyword, primary paper and its best relation."""
    return retrieval.q_resolve(spark, sf_dir)
