"""Retrieval: keyword matching, vector search, choice of a primary paper, relations, section bundles.

Every operator takes a set of queries; a single search is a set of one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import DEFAULTS
from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.storage import load


def dictionary(keywords: DataFrame) -> DataFrame:
    """(keyword_id, term): the canonical keyword of each term, the one with the least id; blank terms dropped."""
    k = keywords.select("keyword_id", T.keyword(F.col("keyword")).alias("term")).filter("term <> ''")
    return k.groupBy("term").agg(F.min("keyword_id").alias("keyword_id"))


def aliases(keywords: DataFrame) -> DataFrame:
    """(alias, keyword_id): other spellings of a term, by its display form, and the canonical keyword."""
    k = keywords.select("keyword_id", T.keyword(F.col("keyword")).alias("term"), T.strip(F.col("display_form")).alias("alias")).filter("term <> '' and alias <> ''")
    canon = dictionary(keywords).withColumnRenamed("keyword_id", "canon")
    return k.join(canon, "term").groupBy("alias").agg(F.min("canon").alias("keyword_id"))


def linked(keywords: DataFrame, links: DataFrame) -> DataFrame:
    """Keywords that at least one paper is linked to."""
    return keywords.join(links.select("keyword_id").distinct(), "keyword_id", "left_semi")


def lookup(asked: DataFrame, terms: DataFrame, other: DataFrame) -> DataFrame:
    """asked(query_id, pos, term) matched with the dictionary, else with the aliases; one keyword_id per term.

    The two ways are two equi-joins with a priority, not one join on either.
    """
    direct = asked.join(terms, "term").withColumn("via", F.lit("term"))
    alias = asked.join(other.withColumnRenamed("alias", "term"), "term").withColumn("via", F.lit("alias"))
    first = Window.partitionBy("query_id", "pos").orderBy(F.desc("via"), "keyword_id")
    both = direct.unionByName(alias).withColumn("r", F.row_number().over(first))
    return both.filter("r = 1").drop("r")


def best_exact(asked: DataFrame, texts: DataFrame, terms: DataFrame, other: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, keyword_id, term, weight): of each query the keyword with the largest frequency times order weight.

    The order weight falls from 1 with the term's place in the query text, and is
    1 / position for terms that the text does not have.  A null frequency counts as 0;
    ties go to the earlier term, then to the larger frequency.
    """
    hit = lookup(asked, terms, other).join(keywords.select("keyword_id", F.coalesce("frequency", F.lit(0)).alias("frequency")), "keyword_id").join(texts, "query_id")
    at = F.expr("locate(term, text)")
    order = F.when(at > 0, F.greatest(F.lit(0.01), 1 - (at - 1) / F.greatest(F.lit(1), F.length("text")))).otherwise(1 / F.col("pos"))
    best = Window.partitionBy("query_id").orderBy(F.desc("weight"), "pos", F.desc("frequency"))
    hit = hit.withColumn("weight", F.round(F.col("frequency") * order, 6)).withColumn("r", F.row_number().over(best))
    return hit.filter("r = 1").select("query_id", "keyword_id", "term", "weight")


def year_weight(c: Column, as_of: int = DEFAULTS.as_of_year) -> Column:
    """1 for this year or later, falling by 0.1 a year to 0; null years 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(F.lit(0), F.lit(as_of) - c) / 10.0)), F.lit(0.0))


def year_proximity(a: Column, b: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / 10.0), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Common by all different items; 0 if either is null or empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def usable_paragraphs(paragraphs: DataFrame, dim: int = 64) -> DataFrame:
    """Topic-relevant paragraphs with a vector of the right length that is not zero."""
    return paragraphs.filter(f"is_topic_relevant and size(embedding) = {dim} and exists(embedding, x -> x <> 0)")


def _cosines(batches):
    """query_id, paper_id, paragraph_id, paragraph_order, q, v -> their cosine, rounded; a vector of another length or of zeros gives 0."""
    for pdf in batches:
        fits = (pdf["q"].map(len) == pdf["v"].map(len)).to_numpy(bool)
        value = np.zeros(len(pdf))
        if fits.any():
            a, b = np.stack(pdf["q"][fits]).astype("f8"), np.stack(pdf["v"][fits]).astype("f8")
            size = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
            value[fits] = np.divide(np.einsum("ij,ij->i", a, b), size, out=np.zeros(len(a)), where=size > 0)
        yield pdf[["query_id", "paper_id", "paragraph_id", "paragraph_order"]].assign(similarity=np.round(value, 6))


def paragraph_similarity(pairs: DataFrame, paragraphs: DataFrame, dim: int = 64) -> DataFrame:
    """pairs(query_id, paper_id, q) with each usable paragraph of the paper and its cosine with q.

    Scored in Arrow batches by matrix rows; a null q gives 0.
    """
    p = usable_paragraphs(paragraphs, dim).select("paper_id", "paragraph_id", "paragraph_order", F.col("embedding").alias("v"))
    q = F.coalesce("q", F.array().cast(dict(pairs.dtypes)["q"]))
    j = pairs.withColumn("q", q).join(p, "paper_id").select("query_id", "paper_id", "paragraph_id", "paragraph_order", "q", "v")
    return j.mapInPandas(_cosines, f"query_id {dict(pairs.dtypes)['query_id']}, paper_id long, paragraph_id long, paragraph_order int, similarity double")


def primary_scores(links: DataFrame, keywords: DataFrame, papers: DataFrame, paragraphs: DataFrame, as_of: int = DEFAULTS.as_of_year, dim: int = 64) -> DataFrame:
    """Score of every paper linked to each keyword: 0.5 link + 0.3 best paragraph + 0.1 title or abstract hit + 0.1 year.

    Papers without usable paragraphs have 0 for the best paragraph; null link scores count as 0.
    """
    link = links.groupBy("keyword_id", "paper_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("kw_score"))
    k = keywords.select("keyword_id", T.keyword(F.col("keyword")).alias("term"), F.col("embedding").alias("q"))
    rows = link.join(k, "keyword_id")
    best = paragraph_similarity(rows.select(F.col("keyword_id").alias("query_id"), "paper_id", "q"), paragraphs, dim).groupBy("query_id", "paper_id").agg(F.max("similarity").alias("similarity"))
    rows = rows.drop("q").join(best.withColumnRenamed("query_id", "keyword_id"), ["keyword_id", "paper_id"], "left")
    rows = rows.join(papers.select("paper_id", "title", "abstract", "published_year"), "paper_id")
    hit = (F.length("term") > 0) & F.contains(T.keyword(F.concat_ws(" ", "title", "abstract")), F.col("term"))
    rows = rows.select("keyword_id", "term", "paper_id", "kw_score", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.when(hit, 1.0).otherwise(0.0).alias("hit"), year_weight(F.col("published_year"), as_of).alias("year"))
    return rows.withColumn("total", F.round(0.5 * F.col("kw_score") + 0.3 * F.col("similarity") + 0.1 * F.col("hit") + 0.1 * F.col("year"), 6))


def select_primary(scored: DataFrame) -> DataFrame:
    """The best paper of each keyword; ties go to the larger link score, then the smaller id."""
    best = Window.partitionBy("keyword_id").orderBy(F.desc("total"), F.desc("kw_score"), "paper_id")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def paper_profiles(papers: DataFrame, paragraphs: DataFrame, links: DataFrame, keywords: DataFrame, dim: int = 64) -> DataFrame:
    """(paper_id, published_year, v, terms): vector of the first usable paragraph, null without one; sorted distinct terms."""
    v = usable_paragraphs(paragraphs, dim).groupBy("paper_id").agg(F.min_by("embedding", F.struct("paragraph_order", "paragraph_id")).alias("v"))
    k = keywords.select("keyword_id", T.keyword(F.col("keyword")).alias("term")).filter("term <> ''")
    terms = links.select("paper_id", "keyword_id").distinct().join(k, "keyword_id").groupBy("paper_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    out = papers.select("paper_id", "published_year").join(v, "paper_id", "left").join(terms, "paper_id", "left")
    return out.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def relations(profiles: DataFrame, asked: str = "true", top: int = DEFAULTS.relation_top_k) -> DataFrame:
    """(source_paper_id, related_paper_id, relation_score): the ``top`` best relations of each paper that meets ``asked``.

    0.6 cosine + 0.3 Jaccard of terms + 0.1 nearness of years; candidates need a vector,
    a paper isn't related to itself, ties go to the smaller id.  The asked papers go to
    every task in blocks of V.QUERY_BLOCK; a task scores its candidates against V.ROWS of
    them at a time, so its memory does not grow with either side, and keeps its own best.
    """
    schema = "source_paper_id long, related_paper_id long, relation_score double"
    out = profiles.sparkSession.createDataFrame([], schema)
    for block in V.query_blocks(profiles.filter(asked).filter("v is not null"), "paper_id"):
        out = out.unionByName(profiles.filter("v is not null").mapInPandas(_relation_scorer(block.toPandas(), top), schema))
    rank = F.row_number().over(Window.partitionBy("source_paper_id").orderBy(F.desc("relation_score"), "related_paper_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top)


def _unit(v: pd.Series) -> np.ndarray:
    m = np.stack(v).astype("f8")
    return m / np.linalg.norm(m, axis=1)[:, None]


def _relation_scorer(q: pd.DataFrame, top: int):
    """Batches of profiles -> the best of each batch for the asked papers ``q``."""
    ids, unit = q["paper_id"].to_numpy(), _unit(q["v"]) if len(q) else None
    years, sizes = q["published_year"].to_numpy(dtype="f8"), q["terms"].map(len).to_numpy(dtype="f8")
    number = {t: i for i, t in enumerate(sorted({t for terms in q["terms"] for t in terms}))}
    # Asked papers of each term, in order.
    at = np.array([number[t] for terms in q["terms"] for t in terms], "i8")
    whose = np.repeat(np.arange(len(q)), sizes.astype(int))
    order = np.lexsort((whose, at))
    at, whose = at[order], whose[order]

    def score(batches):
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            m, own, y = _unit(pdf["v"]), pdf["paper_id"].to_numpy(), pdf["published_year"].to_numpy(dtype="f8")
            n = pdf["terms"].map(len).to_numpy(dtype="f8")
            held = [(number[t], j) for j, terms in enumerate(pdf["terms"]) for t in terms if t in number]
            terms, mine = np.array(held, "i8").reshape(-1, 2).T
            lo, hi = np.searchsorted(at, terms), np.searchsorted(at, terms, "right")
            count = hi - lo
            left = whose[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            right = np.repeat(mine, count)
            order = np.argsort(left, kind="stable")
            left, right = left[order], right[order]
            for first in range(0, len(ids), V.ROWS):
                rows = slice(first, min(first + V.ROWS, len(ids)))
                a, b = np.searchsorted(left, [rows.start, rows.stop])
                common = np.zeros((rows.stop - first, len(pdf)))
                np.add.at(common, (left[a:b] - first, right[a:b]), 1)
                jac = np.divide(common, sizes[rows, None] + n[None, :] - common, out=np.zeros_like(common), where=common > 0)
                near = np.nan_to_num(np.maximum(0.0, 1 - np.abs(years[rows, None] - y[None, :]) / 10.0), nan=0.0)
                s = np.round(0.6 * np.round(unit[rows] @ m.T, 6) + 0.3 * jac + 0.1 * near, 6)
                s[ids[rows, None] == own[None, :]] = -9
                i, j = V.top_columns(s, top + 1)
                keep = s[i, j] > -9
                yield pd.DataFrame({"source_paper_id": ids[first + i[keep]], "related_paper_id": own[j[keep]], "relation_score": s[i[keep], j[keep]]})

    return score


def top_relation(edges: DataFrame) -> DataFrame:
    """The best relation of each paper, looked up in both directions; ties go to the smaller peer."""
    both = edges.select(F.col("source_paper_id").alias("paper_id"), F.col("related_paper_id").alias("peer_id"), "relation_score").unionByName(edges.select(F.col("related_paper_id").alias("paper_id"), F.col("source_paper_id").alias("peer_id"), "relation_score"))
    best = Window.partitionBy("paper_id").orderBy(F.desc("relation_score"), "peer_id")
    return both.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def section_filter(paragraphs: DataFrame, names: list[str] | str | None) -> DataFrame:
    """Topic-relevant paragraphs of sections that hold one of the names, in any case; no names, no filter.

    Names are taken literally; blank ones are ignored.
    """
    wanted = [n.strip().lower() for n in ([names] if isinstance(names, str) else names or []) if n.strip()]
    out = paragraphs.filter("is_topic_relevant")
    if not wanted:
        return out
    hit = F.lit(False)
    for n in wanted:
        hit = hit | F.contains(F.lower("section_name"), F.lit(n))
    return out.filter(hit)


def section_folds(paragraphs: DataFrame, default: str = DEFAULTS.default_section) -> DataFrame:
    """Neighbouring paragraphs of one section folded: (paper_id, section_order, section_name, paragraph_count, original_text, keywords).

    A section that comes again later is another one.  A null or blank name is the default.
    The fold looks at a paragraph's predecessor only, in a sort by paper.
    """
    by = Window.partitionBy("paper_id").orderBy("paragraph_order", "paragraph_id")
    p = paragraphs.withColumn("name", F.coalesce(F.nullif(T.strip(F.col("section_name")), F.lit("")), F.lit(default)))
    p = p.withColumn("new", F.when(F.col("name") == F.lag("name").over(by), 0).otherwise(1)).withColumn("section_order", F.sum("new").over(by))
    rows = F.array_sort(F.collect_list(F.struct("paragraph_order", "paragraph_id", "original_text", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))))
    g = p.groupBy("paper_id", "section_order", "name").agg(F.count("*").alias("paragraph_count"), rows.alias("rows"))
    texts = F.filter(F.transform("rows", lambda r: r["original_text"]), lambda t: t.isNotNull() & (t != ""))
    words = F.array_distinct(F.filter(F.flatten(F.transform("rows", lambda r: r["keywords"])), lambda k: k.isNotNull()))
    return g.select("paper_id", F.col("section_order").cast("int").alias("section_order"), F.col("name").alias("section_name"), "paragraph_count", F.array_join(texts, "\n\n").alias("original_text"), F.array_join(words, "|").alias("keywords"))


# Queries --------------------------------------------------------------------------------------------------


def _asked(spark, d) -> tuple[DataFrame, DataFrame]:
    """Search queries from the summaries: their terms with positions, and their texts."""
    s = load(spark, d, "paper_summaries")
    terms = s.select(F.col("summary_id").alias("query_id"), F.posexplode(T.unique_terms(F.coalesce("keywords", F.array().cast("array<string>")))).alias("pos", "term")).withColumn("pos", F.col("pos") + 1)
    texts = s.select(F.col("summary_id").alias("query_id"), T.keyword(F.concat_ws(" ", F.col("title"), F.array_join("keywords", " "))).alias("text"))
    return terms, texts


def q_scan_in_list(spark, d):
    """Titles, years and counts of children for every paper that has a review document."""
    ids = load(spark, d, "review_documents").select("paper_id").filter("paper_id is not null").distinct()
    out = load(spark, d, "papers").select("paper_id", "title", "published_year").join(ids, "paper_id", "left_semi")
    for table, name in (("paragraphs", "n_paragraphs"), ("paper_tables", "n_tables")):
        n = load(spark, d, table).select("paper_id").join(ids, "paper_id", "left_semi").groupBy("paper_id").agg(F.count("*").alias(name))
        out = out.join(n, "paper_id", "left").fillna(0, [name])
    return out


def q_scan_table(spark, d):
    """Metadata of the papers of recent years, filter and columns pushed to the scan."""
    return load(spark, d, "papers").filter("published_year >= 2015").select("paper_id", "title", "authors", "published_year", "journal", "full_text_link")


def q_filter_sections(spark, d):
    p = section_filter(load(spark, d, "paragraphs"), ["method", "", "Result"])
    return p.select("paragraph_id", "paper_id", "paragraph_order", "section_name")


def q_filter_topic(spark, d):
    return load(spark, d, "paragraphs").filter("is_topic_relevant").groupBy("paper_id").agg(F.count("*").alias("relevant"))


def q_exists_link(spark, d):
    return linked(load(spark, d, "keywords"), load(spark, d, "paper_keywords")).select("keyword_id", "keyword")


def q_contains_norm(spark, d):
    """Links whose term stands in the paper's title or abstract."""
    k = load(spark, d, "keywords").select("keyword_id", T.keyword(F.col("keyword")).alias("term")).filter("term <> ''")
    p = load(spark, d, "papers").select("paper_id", T.keyword(F.concat_ws(" ", "title", "abstract")).alias("t"))
    links = load(spark, d, "paper_keywords").select("paper_id", "keyword_id").distinct()
    return links.join(k, "keyword_id").join(p, "paper_id").filter(F.contains("t", "term")).select("paper_id", "keyword_id")


def q_join_paper_keywords(spark, d):
    """Display forms of each paper by score, then name."""
    link = load(spark, d, "paper_keywords").filter("score is not null").groupBy("paper_id", "keyword_id").agg(F.max("score").alias("score"))
    k = load(spark, d, "keywords").select("keyword_id", "display_form")
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("score"), "display_form", "keyword_id"))
    return link.join(k, "keyword_id").withColumn("rank", rank).select("paper_id", "keyword_id", "display_form", "score", "rank")


def q_join_alias_lookup(spark, d):
    """Every display form looked up as a term, else as an alias."""
    k = load(spark, d, "keywords")
    asked = k.select(F.col("keyword_id").alias("query_id"), F.lit(1).alias("pos"), T.strip(F.col("display_form")).alias("term")).filter("term <> ''")
    return lookup(asked, dictionary(k), aliases(k)).select("query_id", "keyword_id", "via")


def q_join_relation_candidates(spark, d):
    """Every paper with the sorted terms linked to it, an empty list without any."""
    k = load(spark, d, "keywords").select("keyword_id", T.keyword(F.col("keyword")).alias("term")).filter("term <> ''")
    t = load(spark, d, "paper_keywords").select("paper_id", "keyword_id").distinct().join(k, "keyword_id").groupBy("paper_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return load(spark, d, "papers").select("paper_id", "published_year").join(t, "paper_id", "left").select("paper_id", "published_year", F.coalesce(F.array_join("terms", "|"), F.lit("")).alias("terms"))


def q_topk_similar_keywords(spark, d):
    """For each keyword whose id is divisible by 20 the three nearest other linked keywords above the floor."""
    k = load(spark, d, "keywords").filter("size(embedding) = 64 and exists(embedding, x -> x <> 0)")
    near = V.best_matches(k.filter("keyword_id % 20 = 0").select(F.col("keyword_id").alias("query_id"), F.col("embedding").alias("q")), linked(k, load(spark, d, "paper_keywords")).select(F.col("keyword_id").alias("id"), F.col("embedding").alias("v")), None, DEFAULTS.suggestion_limit + 1)
    near = near.filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), "id"))
    return near.withColumn("rank", rank).filter(f"rank <= {DEFAULTS.suggestion_limit} and similarity >= {DEFAULTS.similarity_floor}").select("query_id", F.col("id").alias("keyword_id"), F.round("similarity", 5).alias("similarity"), "rank")


def q_sections_first_seen(spark, d):
    p = load(spark, d, "paragraphs").filter("is_topic_relevant").filter(T.strip(F.col("section_name")) != "")
    g = p.groupBy("paper_id", "section_name").agg(F.min("paragraph_order").alias("first_order"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("paper_id").orderBy("first_order", "section_name")))


def _own_keyword(spark, d):
    """Each linked keyword with each of its papers and its vector."""
    k = load(spark, d, "keywords").filter("size(embedding) = 64").select(F.col("keyword_id").alias("query_id"), F.col("embedding").alias("q"))
    return load(spark, d, "paper_keywords").select(F.col("keyword_id").alias("query_id"), "paper_id").distinct().join(k, "query_id")


def q_best_paragraph_sim(spark, d):
    return paragraph_similarity(_own_keyword(spark, d), load(spark, d, "paragraphs")).groupBy("query_id", "paper_id").agg(F.max("similarity").alias("similarity"))


def q_top_matching_paragraph(spark, d):
    p = paragraph_similarity(_own_keyword(spark, d), load(spark, d, "paragraphs"))
    return p.groupBy("query_id", "paper_id").agg(F.min_by("paragraph_id", F.struct(-F.round("similarity", 5), F.col("paragraph_id"))).alias("paragraph_id"))


def q_select_primary(spark, d):
    s = primary_scores(load(spark, d, "paper_keywords"), load(spark, d, "keywords"), load(spark, d, "papers"), load(spark, d, "paragraphs"))
    return select_primary(s.withColumn("total", F.round("total", 5))).select("keyword_id", "paper_id", "kw_score", "hit", F.round("year", 6).alias("year"), "total")


def q_best_exact_match(spark, d):
    terms, texts = _asked(spark, d)
    k = load(spark, d, "keywords")
    return best_exact(terms, texts, dictionary(k), aliases(k), k)


def q_resolve(spark, d):
    """From query to keyword to primary paper to its best relation, for all queries in one plan."""
    match = q_best_exact_match(spark, d)
    primary = q_select_primary(spark, d).select("keyword_id", F.col("paper_id").alias("primary_id"), "total")
    edges = q_build_relations(spark, d)
    rel = top_relation(edges).select(F.col("paper_id").alias("primary_id"), F.col("peer_id").alias("related_id"), "relation_score")
    return match.join(primary, "keyword_id").join(rel, "primary_id", "left").select("query_id", "keyword_id", "primary_id", "total", "related_id", "relation_score")


def q_build_relations(spark, d):
    """The 20 best relations of every paper whose id is divisible by 20."""
    prof = paper_profiles(load(spark, d, "papers"), load(spark, d, "paragraphs"), load(spark, d, "paper_keywords"), load(spark, d, "keywords"))
    return relations(prof, "paper_id % 20 = 0").select("source_paper_id", "related_paper_id", "relation_score")


def q_top1_relation(spark, d):
    return top_relation(q_build_relations(spark, d))


def q_union_relations(spark, d):
    """Relations of each paper counted in both directions."""
    e = q_build_relations(spark, d)
    both = e.select(F.col("source_paper_id").alias("paper_id")).unionByName(e.select(F.col("related_paper_id").alias("paper_id")))
    return both.groupBy("paper_id").agg(F.count("*").alias("edges"))


def q_section_fold(spark, d):
    return section_folds(load(spark, d, "paragraphs").filter("is_topic_relevant"))


def q_islands(spark, d):
    return section_folds(load(spark, d, "paragraphs")).groupBy("paper_id").agg(F.count("*").alias("sections"), F.max("paragraph_count").alias("longest"))


def q_order_papers(spark, d):
    """Papers of each keyword by score, then id."""
    link = load(spark, d, "paper_keywords").groupBy("keyword_id", "paper_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    return link.withColumn("rank", F.row_number().over(Window.partitionBy("keyword_id").orderBy(F.desc("score"), "paper_id")))


def q_jaccard(spark, d):
    """Overlap of the first two summaries of each paper by their keyword sets."""
    s = load(spark, d, "paper_summaries").select("paper_id", "summary_id", T.unique_terms(F.coalesce("keywords", F.array().cast("array<string>"))).alias("k"))
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("paper_id").orderBy("summary_id")))
    a, b = s.filter("r = 1"), s.filter("r = 2").select("paper_id", F.col("k").alias("k2"))
    return a.join(b, "paper_id").select("paper_id", F.round(jaccard(F.col("k"), F.col("k2")), 6).alias("jaccard"), F.array_join(F.array_sort(F.array_intersect("k", "k2")), "|").alias("common"))


QUERIES = {
    "scan_table": q_scan_table, "scan_in_list": q_scan_in_list, "filter_sections": q_filter_sections, "filter_topic": q_filter_topic, "exists_link": q_exists_link,
    "contains_norm": q_contains_norm, "join_paper_keywords": q_join_paper_keywords, "join_alias_lookup": q_join_alias_lookup, "join_relation_candidates": q_join_relation_candidates,
    "topk_similar_keywords": q_topk_similar_keywords, "agg_sections_first_seen": q_sections_first_seen, "best_paragraph_sim": q_best_paragraph_sim,
    "top_matching_paragraph": q_top_matching_paragraph, "select_primary": q_select_primary, "best_exact_match": q_best_exact_match, "resolve": q_resolve,
    "build_relations": q_build_relations, "top1_relation": q_top1_relation, "union_relations": q_union_relations, "section_fold": q_section_fold, "islands": q_islands, "order_papers": q_order_papers, "overlap_list": q_jaccard,
}

_N = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_KW = f"k as (select keyword_id, frequency, embedding, trim(display_form) as alias, {_N.format('keyword')} as term from keywords)"
_TERMS = f"{_KW}, dict as (select term, min(keyword_id) as keyword_id from k where term <> '' group by 1), al as (select alias, min(dict.keyword_id) as keyword_id from k join dict using (term) where alias <> '' group by 1)"
_COS = "list_dot_product({0}::double[], {1}::double[]) / sqrt(list_dot_product({0}::double[], {0}::double[]) * list_dot_product({1}::double[], {1}::double[]))"
_USABLE = "usable as (select * from paragraphs where is_topic_relevant and len(embedding) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"
_SIM = f"""{_KW}, {_USABLE}, link as (select keyword_id, paper_id, coalesce(max(score), 0) as kw_score from paper_keywords group by 1, 2),
sim as (select l.keyword_id as query_id, l.paper_id, u.paragraph_id, case when len(list_filter(k.embedding, lambda x: x <> 0)) = 0 then 0 else round({_COS.format('k.embedding', 'u.embedding')}, 6) end as similarity
  from link l join k using (keyword_id) join usable u using (paper_id) where len(k.embedding) = 64)"""
_PRIMARY = f"""{_SIM}, best as (select query_id as keyword_id, paper_id, max(similarity) as similarity from sim group by 1, 2),
scored as (select l.keyword_id, l.paper_id, l.kw_score, case when term <> '' and contains({_N.format("concat_ws(' ', title, abstract)")}, term) then 1.0 else 0.0 end::double as hit,
  round(coalesce(greatest(0.0, least(1.0, 1 - greatest(0, 2024 - published_year) / 10.0)), 0.0)::double, 6) as year, coalesce(similarity, 0) as similarity
  from link l join k using (keyword_id) join papers p using (paper_id) left join best using (keyword_id, paper_id)),
tot as (select *, round(round(0.5 * kw_score + 0.3 * similarity + 0.1 * hit + 0.1 * year, 6), 5) as total from scored),
prim as (select keyword_id, paper_id, kw_score, hit, year, total from (select *, row_number() over (partition by keyword_id order by total desc, kw_score desc, paper_id) as r from tot) where r = 1)"""
_ASK = rf"""asks as (select summary_id as query_id, title, keywords from paper_summaries),
items as (select query_id, unnest(list_transform(keywords, lambda x: {_N.format('x')})) as term, unnest(range(1, len(keywords) + 1)) as i from asks),
firsts as (select query_id, term, min(i) as i from items where term is not null and term <> '' group by 1, 2),
terms as (select query_id, term, row_number() over (partition by query_id order by i) as pos from firsts),
texts as (select query_id, {_N.format("concat_ws(' ', title, array_to_string(keywords, ' '))")} as t from asks),
hit as (select query_id, pos, term, coalesce(d.keyword_id, a.keyword_id) as keyword_id from terms left join dict d using (term) left join al a on a.alias = term),
w as (select h.query_id, h.pos, h.term, h.keyword_id, coalesce(k.frequency, 0) as f, round(coalesce(k.frequency, 0) * case when strpos(t, h.term) > 0 then greatest(0.01, 1 - (strpos(t, h.term) - 1)::double / greatest(1, length(t))) else 1.0::double / pos end, 6) as weight
  from hit h join k using (keyword_id) join texts using (query_id)),
matched as (select query_id, keyword_id, term, weight from (select *, row_number() over (partition by query_id order by weight desc, pos, f desc) as r from w) where r = 1)"""
_REL = rf"""prof as (select p.paper_id, p.published_year, v.v, coalesce(t.terms, []) as terms from papers p
  left join (select paper_id, arg_min(embedding, (paragraph_order, paragraph_id)) as v from usable group by 1) v using (paper_id)
  left join (select paper_id, list(distinct term) as terms from paper_keywords join k using (keyword_id) where term <> '' group by 1) t using (paper_id)),
rs as (select a.paper_id as source_paper_id, b.paper_id as related_paper_id, round(0.6 * round({_COS.format('a.v', 'b.v')}, 6)
  + 0.3 * case when len(a.terms) = 0 or len(b.terms) = 0 then 0.0 else len(list_intersect(a.terms, b.terms))::double / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))) end
  + 0.1 * coalesce(greatest(0.0, 1 - abs(a.published_year - b.published_year) / 10.0), 0)::double, 6) as relation_score
  from prof a join prof b on a.paper_id <> b.paper_id where a.paper_id % 20 = 0 and a.v is not null and b.v is not null),
edge as (select source_paper_id, related_paper_id, relation_score from (select *, row_number() over (partition by source_paper_id order by relation_score desc, related_paper_id) as r from rs) where r <= 20),
both_ as (select source_paper_id as paper_id, related_paper_id as peer_id, relation_score from edge union all select related_paper_id, source_paper_id, relation_score from edge),
top as (select paper_id, peer_id, relation_score from (select *, row_number() over (partition by paper_id order by relation_score desc, peer_id) as r from both_) where r = 1)"""
_FOLD = """n as (select *, coalesce(nullif(trim(section_name), ''), '본문') as name from paragraphs where {}),
f as (select *, case when name = lag(name) over w then 0 else 1 end as new from n window w as (partition by paper_id order by paragraph_order, paragraph_id)),
g as (select *, sum(new) over (partition by paper_id order by paragraph_order, paragraph_id) as section_order from f)"""
SQL = {
    "scan_table": "select paper_id, title, authors, published_year, journal, full_text_link from papers where published_year >= 2015",
    "scan_in_list": "select paper_id, title, published_year, (select count(*) from paragraphs x where x.paper_id = p.paper_id) as n_paragraphs, (select count(*) from paper_tables x where x.paper_id = p.paper_id) as n_tables from papers p where paper_id in (select paper_id from review_documents)",
    "filter_sections": "select paragraph_id, paper_id, paragraph_order, section_name from paragraphs where is_topic_relevant and (section_name ilike '%method%' or section_name ilike '%result%')",
    "filter_topic": "select paper_id, count(*) as relevant from paragraphs where is_topic_relevant group by 1",
    "exists_link": "select keyword_id, keyword from keywords where keyword_id in (select keyword_id from paper_keywords)",
    "contains_norm": f"with {_KW} select distinct paper_id, keyword_id from paper_keywords join k using (keyword_id) join papers using (paper_id) where term <> '' and contains({_N.format(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', title, abstract)')}, term)",
    "join_paper_keywords": "with l as (select paper_id, keyword_id, max(score) as score from paper_keywords where score is not null group by 1, 2) select paper_id, keyword_id, display_form, score, row_number() over (partition by paper_id order by score desc, display_form, keyword_id) as rank from l join keywords using (keyword_id)",
    "join_alias_lookup": f"with {_TERMS}, a as (select keyword_id as query_id, alias as t from k where alias <> '') select query_id, coalesce(d.keyword_id, al.keyword_id) as keyword_id, case when d.keyword_id is null then 'alias' else 'term' end as via from a left join dict d on d.term = t left join al on al.alias = t where d.keyword_id is not null or al.keyword_id is not null",
    "join_relation_candidates": f"with {_KW}, t as (select paper_id, string_agg(term, '|' order by term) as terms from (select distinct paper_id, term from paper_keywords join k using (keyword_id) where term <> '') group by 1) select paper_id, published_year, coalesce(terms, '') as terms from papers left join t using (paper_id)",
    "topk_similar_keywords": f"with v as (select keyword_id, embedding from keywords where len(embedding) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0), s as (select a.keyword_id as query_id, b.keyword_id, {_COS.format('a.embedding', 'b.embedding')} as s from v a join v b on a.keyword_id <> b.keyword_id where a.keyword_id % 20 = 0 and b.keyword_id in (select keyword_id from paper_keywords)), r as (select *, row_number() over (partition by query_id order by round(s, 6) desc, keyword_id) as rank from s) select query_id, keyword_id, round(s, 5) as similarity, rank from r where rank <= 3 and s >= 0.5",
    "agg_sections_first_seen": "with g as (select paper_id, section_name, min(paragraph_order) as first_order from paragraphs where is_topic_relevant and trim(section_name) <> '' group by 1, 2) select *, row_number() over (partition by paper_id order by first_order, section_name) as position from g",
    "best_paragraph_sim": f"with {_SIM} select query_id, paper_id, max(similarity) as similarity from sim group by 1, 2",
    "top_matching_paragraph": f"with {_SIM} select query_id, paper_id, arg_min(paragraph_id, (-round(similarity, 5), paragraph_id)) as paragraph_id from sim group by 1, 2",
    "select_primary": f"with {_PRIMARY} select * from prim",
    "best_exact_match": f"with {_TERMS}, {_ASK} select * from matched",
    "resolve": f"with {_PRIMARY}, dict as (select term, min(keyword_id) as keyword_id from k where term <> '' group by 1), al as (select alias, min(dict.keyword_id) as keyword_id from k join dict using (term) where alias <> '' group by 1), {_ASK}, {_REL} select query_id, keyword_id, prim.paper_id as primary_id, total, peer_id as related_id, relation_score from matched join prim using (keyword_id) left join top on top.paper_id = prim.paper_id",
    "build_relations": f"with {_KW}, {_USABLE}, {_REL} select * from edge",
    "top1_relation": f"with {_KW}, {_USABLE}, {_REL} select * from top",
    "union_relations": f"with {_KW}, {_USABLE}, {_REL} select paper_id, count(*) as edges from both_ group by 1",
    "section_fold": "with " + _FOLD.format("is_topic_relevant") + """, ks as (select paper_id, section_order, kw, min((paragraph_order, paragraph_id, i)) as first from (select paper_id, section_order, paragraph_order, paragraph_id, unnest(keywords) as kw, unnest(range(len(keywords))) as i from g) where kw is not null group by 1, 2, 3),
kj as (select paper_id, section_order, string_agg(kw, '|' order by first) as keywords from ks group by 1, 2)
select g.paper_id, section_order::int as section_order, name as section_name, count(*) as paragraph_count, coalesce(string_agg(nullif(original_text, ''), chr(10) || chr(10) order by paragraph_order, paragraph_id), '') as original_text, coalesce(any_value(kj.keywords), '') as keywords
from g left join kj using (paper_id, section_order) group by 1, 2, 3""",
    "islands": "with " + _FOLD.format("true") + ", c as (select paper_id, section_order, count(*) as n from g group by 1, 2) select paper_id, count(*) as sections, max(n) as longest from c group by 1",
    "order_papers": "with l as (select keyword_id, paper_id, coalesce(max(score), 0) as score from paper_keywords group by 1, 2) select *, row_number() over (partition by keyword_id order by score desc, paper_id) as rank from l",
    "overlap_list": rf"""with s as (select paper_id, row_number() over (partition by paper_id order by summary_id) as r, list_filter(list_distinct(list_transform(coalesce(keywords, []), lambda x: {_N.format('x')})), lambda x: x is not null and x <> '') as k from paper_summaries)
select a.paper_id, round(case when len(a.k) = 0 or len(b.k) = 0 then 0.0 else len(list_intersect(a.k, b.k))::double / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) end, 6) as jaccard, coalesce(array_to_string(list_sort(list_intersect(a.k, b.k)), '|'), '') as common from s a join s b using (paper_id) where a.r = 1 and b.r = 2""",
}
