"""Log-entropy weighting: how much a term sets a record apart from the whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.skew import hot_aware_join
from marginalia.storage import load, persist_table

from .terms import normal_term


def log_entropy(counts: DataFrame, record: str, term: str, tf: str, n: int | None = None) -> DataFrame:
    """Global weight of each term: one minus the normalised entropy of its spread over the records.

    ``counts`` has one row per (record, term) with its local frequency ``tf`` > 0.  The
    result has (term, df, weight): weight is 1 for a term of a single record and 0 for one
    spread evenly over all ``n`` records (by default those in ``counts``).  Two aggregations: the number of records, then per term the
    sums from which the entropy follows, H = ln(sum tf) - sum(tf ln tf) / sum tf.  With a
    single record in all, every weight is 1.  Nulls in record, term or tf drop the row.
    """
    c = counts.select(record, term, tf).filter(F.col(record).isNotNull() & F.col(term).isNotNull() & (F.col(tf) > 0))
    n = c.select(record).distinct().count() if n is None else n
    per = c.groupBy(term).agg(F.count("*").alias("df"), F.sum(tf).alias("gf"), F.sum(F.col(tf) * F.log(tf)).alias("s"))
    entropy = F.log("gf") - F.col("s") / F.col("gf")
    weight = 1 - entropy / F.log(F.lit(float(n))) if n > 1 else F.lit(1.0)
    return per.select(term, "df", weight.cast("double").alias("weight"))


def paper_terms(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(keyword_id, term) of all keywords, and the links (paper_id, keyword_id, score) without repeats."""
    kw = load(spark, sf_dir, "keywords").select("keyword_id", normal_term(F.col("keyword")).alias("term")).filter("term is not null and term <> ''")
    links = load(spark, sf_dir, "paper_keywords").select("paper_id", "keyword_id", "score").filter("paper_id is not null and keyword_id is not null").distinct()
    return kw, links


def link_weights(spark, sf_dir: str, spread: str) -> DataFrame:
    """(paper_id, keyword_id, term, score, df, weight) of every link whose keyword is known.

    spread ``records``: each paper of a term counts once; ``score``: papers count by
    ln(1 + their highest score of the term), null and negative scores as 1e-9.  df is the
    number of papers linked to the term under any spelling, null scores included.
    """
    kw, links = paper_terms(spark, sf_dir)
    sizes = persist_table(links.groupBy("keyword_id").agg(F.count("*").alias("n_links")).join(kw, "keyword_id"), "p2-keywords")
    total = sizes.agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0]
    rows = hot_aware_join(links, sizes, "keyword_id", "n_links", total).drop("n_links")
    local = F.lit(1.0) if spread == "records" else F.log1p(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(1e-9)))
    counts = rows.groupBy("paper_id", "term").agg(F.max("score").alias("score")).withColumn("tf", local)
    n = links.select("paper_id").distinct().count()  # papers without a known keyword are records too
    weights = log_entropy(counts, "paper_id", "term", "tf", n)
    return hot_aware_join(rows.drop("term"), sizes.join(weights, "term"), "keyword_id", "n_links", total).drop("n_links")


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Links that set their paper apart: score times the term's log-entropy weight of at least 0.5.

    With every paper counting once, a term's normalised entropy is ln(n) / ln(N), so the
    weight equals ln(N / n) / ln(N).
    """
    w = link_weights(spark, sf_dir, "records")
    return w.filter(F.col("score") * F.col("weight") >= 0.5 - 1e-12).select("paper_id", "keyword_id").distinct()


def p2_log_entropy(spark, sf_dir: str) -> DataFrame:
    """Every scored link with its log-entropy weight: ln(1 + score) times the term's global weight by scores."""
    w = link_weights(spark, sf_dir, "score").filter("score is not null")
    per = w.groupBy("paper_id", "keyword_id", "term", "df").agg(F.max("score").alias("score"), F.max("weight").alias("weight"))
    return per.select("paper_id", "keyword_id", "term", "df", F.round("weight", 6).alias("global_weight"), F.round(F.log1p("score") * F.col("weight"), 6).alias("distinctiveness"))


QUERIES = {"p2_found": p2_found, "p2_log_entropy": p2_log_entropy}

_LINKS = r"""
with kw as (select keyword_id, trim(regexp_replace(lower(keyword), '\s+', ' ', 'g')) as term from keywords),
links as (select distinct paper_id, keyword_id, score from paper_keywords where paper_id is not null and keyword_id is not null),
rows_ as (select l.*, term from links l join kw using (keyword_id) where term <> ''),
big as (select count(distinct paper_id) as n_all from links)
"""
SQL = {
    "p2_found": _LINKS + """,
df as (select term, count(distinct paper_id) as n from rows_ group by 1)
select distinct paper_id, keyword_id from rows_ join df using (term), big
where score * ln(n_all::double / n) / ln(n_all) >= 0.5 - 1e-12""",
    "p2_log_entropy": _LINKS + """,
c as (select paper_id, term, ln(1 + greatest(coalesce(max(score), 0), 1e-9)) as tf from rows_ group by 1, 2),
g as (select term, count(*) as df, sum(tf) as gf, sum(tf * ln(tf)) as s from c group by 1)
select paper_id, keyword_id, term, df, round(max(1 - (ln(gf) - s / gf) / ln(n_all)), 6) as global_weight,
  round(max(ln(1 + score)) * max(1 - (ln(gf) - s / gf) / ln(n_all)), 6) as distinctiveness
from rows_ join g using (term), big where score is not null group by 1, 2, 3, 4""",
}
