"""The engine's three entry points as functions: search, resolve, review.

They take sets: a search for one question is a set of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.config import DEFAULTS, Settings
from marginalia.functions import text as T
from marginalia.operators import bundle as B
from marginalia.operators import evaluation as E
from marginalia.operators import retrieval as R
from marginalia.operators import review as V
from marginalia.operators.enrich import REGISTRY


def query_terms(questions: DataFrame) -> DataFrame:
    """questions(query_id, text) with the terms that their text names, as keywords are stored."""
    return questions.withColumn("terms", T.unique_terms(T.query_terms(F.col("text"))))


def search(questions: DataFrame, tables: B.Tables, embed: str = "hash", s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(matched, suggested) of questions(query_id, text) or, with their terms known, (query_id, text, terms).

    matched is :func:`marginalia.operators.bundle.resolved` for every question of which a
    term is a stored keyword or its alias; for the others suggested holds the nearest
    keywords.  Keywords that no paper is linked to are never matched nor suggested.
    """
    q = questions if "terms" in questions.columns else query_terms(questions)
    live = R.linked(tables.keywords, tables.links)
    asked = q.select("query_id", F.posexplode("terms").alias("pos", "term")).withColumn("pos", F.col("pos") + 1)
    texts = q.select("query_id", T.keyword(F.coalesce("text", F.lit(""))).alias("text"))
    match = R.best_exact(asked, texts, R.dictionary(live), R.aliases(live), live)
    found = match.join(q.select("query_id", "terms"), "query_id").select("query_id", "keyword_id", F.lit(True).alias("exact"), "terms")
    rest = q.join(match.select("query_id"), "query_id", "left_anti")
    return B.resolved(found, tables, s), B.suggest(rest, tables, REGISTRY.get("embed", embed), s)


def select(chosen: DataFrame, tables: B.Tables, options: B.Options | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """The results of chosen(query_id, keyword_id, terms), keywords picked among suggestions."""
    o = options or B.Options()
    return B.resolved(chosen.select("query_id", "keyword_id", F.lit(False).alias("exact"), "terms"), tables, s, o.related)


def workbook(result: dict, tables: B.Tables, path: str, options: B.Options | None = None, query: str = "", created_at: str = "") -> list[str]:
    """Write the workbook of one result, a row of :func:`search` as a dict; returns the names of its sheets."""
    return B.write_result(B.bundle(result, tables, options, query, created_at), path)


def valid_sessions(sessions: DataFrame, now, minutes: int = 30) -> DataFrame:
    """Sessions(session_id, created_at, ...) of suggestions that have not expired at ``now``."""
    return sessions.filter(F.col("created_at") > F.lit(now).cast("timestamp") - F.expr(f"interval {minutes} minutes"))


def review(documents: DataFrame, scope: str = "pending") -> DataFrame:
    """Documents of a scope with label, progress and the automatic quality gate's result."""
    gate = E.automation_quality(E.review_blocks(documents))
    shown = V.review_scope(documents, scope).withColumn("label", V.doc_label())
    return shown.select("document_id", "label", "phase", "status", "unreviewed", "approved", "corrected", "rejected", "changed").join(gate, "document_id", "left")
