"""What a search returns: suggestions, reasons, the papers with their sections, paragraphs and tables, and a workbook of it all."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import DEFAULTS, Settings
from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.sources import workbook as W
from marginalia.sources.files import upsert
from marginalia.storage import load, persist_table

from . import retrieval as R
from .layout import grid_rows
from .reports import headers

# Sheets of the workbook, their heads, and the words of explanations.
PRIMARY, RELATED = "대표", "연관"
SHEETS = ("검색 결과 요약", "대표 논문 정보", "대표 논문 섹션", "대표 논문 단락", "연관 논문 정보", "연관 논문 섹션", "연관 논문 단락", "표 데이터", "표 셀")
SUMMARY_HEAD = ["질의", "질의 추출 키워드", "매칭 키워드", "매칭 방식", "검색 설명", "대표 논문 제목", "연관 논문 제목", "대표 RAG 점수", "대표 선정 사유", "대표 관련도 설명", "연관 관계 점수", "연관 선정 사유", "연관 관련도 설명", "생성 일시"]
PAPER_HEAD = ["논문 ID", "제목", "저자", "연도", "저널", "초록 원문", "초록 요약", "전문 링크", "키워드"]
RELATION_HEAD = ["연관 점수", "연관 사유"]
SECTION_HEAD = ["섹션 순서", "섹션명", "단락 수", "섹션 원문", "섹션 정제문", "섹션 요약", "키워드"]
PARAGRAPH_HEAD = ["단락 번호", "섹션명", "원문", "정제문", "요약", "키워드"]
TABLE_HEAD = ["구분", "표 번호", "표 제목", "표 내용", "표 요약"]
EXACT, SELECTED = "정확히 일치", "유사 키워드로 선택"
#: A name that no section has: only the abstract was chosen.
NO_SECTION = "\u0000"
ABSTRACT_CHOICE = "초록"


def primary_reason() -> Column:
    """How the score of a primary paper comes about; needs the columns of R.primary_scores."""
    term = lambda name, c, w: F.format_string(f"{name} %.3f*{w}=%.3f", F.col(c).cast("double"), F.col(c) * w)
    parts = F.concat_ws(", ", term("키워드", "kw_score", 0.5), term("단락", "similarity", 0.3), term("제목/초록", "hit", 0.1), term("연도", "year", 0.1))
    return F.concat(F.format_string("대표 점수=%.3f (", F.col("total").cast("double")), parts, F.lit(")"))


def relation_reason(cosine: Column, jaccard: Column, years: Column, overlap: Column) -> Column:
    """How a relation's score comes about, with the sorted common terms."""
    score = 0.6 * cosine + 0.3 * jaccard + 0.1 * years
    text = F.format_string("관계 점수=%.3f (논문 임베딩 cosine %.3f*0.6=%.3f, 키워드 Jaccard %.3f*0.3=%.3f, 연도 근접도 %.3f*0.1=%.3f); ", score, cosine, 0.6 * cosine, jaccard, 0.3 * jaccard, years, 0.1 * years)
    return F.concat(text, F.when(F.size(overlap) > 0, F.concat(F.lit("겹치는 키워드: "), F.array_join(overlap, ", "))).otherwise("겹치는 키워드 없음"))


def explanation(asked: Column, keyword: Column, exact: Column, primary: Column, related: Column) -> Column:
    """One sentence on a search: the terms asked, the keyword matched, the papers chosen; a null related title is left out."""
    more = F.when(related.isNotNull(), F.concat(F.lit(" 연관 논문으로 '"), related, F.lit("'도 함께 제공합니다."))).otherwise("")
    return F.concat(F.lit("질의에서 "), F.array_join(asked, ", "), F.lit(" 키워드를 추출했고 저장 키워드 '"), keyword, F.lit("'와 "), F.when(exact, EXACT).otherwise(SELECTED), F.lit("했습니다. 점수 근거에 따라 '"), primary, F.lit("'을 대표 논문으로 선택했습니다."), more)


def section_choice(chosen: list[str], with_abstract: bool, abstract_before: bool = True) -> tuple[list[str] | None, bool]:
    """(section filter, include the abstract) of what was chosen among a paper's sections and, if offered, the abstract.

    Nothing chosen is no filter; only the abstract is a filter that no section meets.
    """
    names = [c for c in chosen if not (with_abstract and c == ABSTRACT_CHOICE)]
    abstract = (not chosen or ABSTRACT_CHOICE in chosen) if with_abstract else abstract_before
    return (None if not chosen else names or [NO_SECTION]), abstract


def ordered_paragraphs(paragraphs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Topic-relevant paragraphs of the sections asked for, with their position in the paper by order, then id."""
    by = Window.partitionBy("paper_id").orderBy("paragraph_order", "paragraph_id")
    return R.section_filter(paragraphs, names).withColumn("position", F.row_number().over(by))


def ordered_tables(tables: DataFrame) -> DataFrame:
    """Tables with their position in the paper by id."""
    return tables.withColumn("position", F.row_number().over(Window.partitionBy("paper_id").orderBy("table_id")))


def paper_info(papers: DataFrame, links: DataFrame, keywords: DataFrame, abstract: bool = True) -> DataFrame:
    """Papers with the display forms of their keywords by score, then name; without ``abstract`` those fields are empty."""
    forms = links.groupBy("paper_id", "keyword_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score")).join(keywords.select("keyword_id", "display_form"), "keyword_id")
    listed = forms.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "display_form", "keyword_id"))), lambda x: x["display_form"]).alias("keywords"))
    p = papers.select("paper_id", "title", "authors", "published_year", "journal", "abstract", "abstract_summary", "full_text_link").join(listed, "paper_id", "left")
    if not abstract:
        p = p.withColumn("abstract", F.lit("")).withColumn("abstract_summary", F.lit(None).cast("string"))
    return p.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def section_bundle(paragraphs: DataFrame, default: str = DEFAULTS.default_section) -> DataFrame:
    """Neighbouring paragraphs of one section as one: order, name, count, joined texts and summaries, distinct keywords."""
    by = Window.partitionBy("paper_id").orderBy("paragraph_order", "paragraph_id")
    name = F.coalesce(F.nullif(T.strip(F.col("section_name")), F.lit("")), F.lit(default))
    p = paragraphs.withColumn("name", name).withColumn("new", F.coalesce((F.col("name") != F.lag("name").over(by)).cast("int"), F.lit(1))).withColumn("section_order", F.sum("new").over(by))
    rows = F.array_sort(F.collect_list(F.struct("paragraph_order", "paragraph_id", "original_text", "cleaned_text", "summary", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))))
    g = p.groupBy("paper_id", "section_order", "name").agg(F.count("*").alias("paragraph_count"), rows.alias("rows"))
    joined = lambda c, sep: F.array_join(F.filter(F.transform("rows", lambda r: r[c]), lambda t: t.isNotNull() & (t != "")), sep)
    words = F.array_distinct(F.filter(F.flatten(F.transform("rows", lambda r: r["keywords"])), lambda k: k.isNotNull()))
    return g.select("paper_id", F.col("section_order").cast("int").alias("section_order"), F.col("name").alias("section_name"), "paragraph_count", joined("original_text", "\n\n").alias("original_text"), joined("cleaned_text", "\n\n").alias("cleaned_text"), joined("summary", " ").alias("summary"), words.alias("keywords"))


@dataclass
class Tables:
    """The stored tables that a search reads."""

    papers: DataFrame
    paragraphs: DataFrame
    keywords: DataFrame
    links: DataFrame
    tables: DataFrame
    relations: DataFrame

    @classmethod
    def of(cls, spark, d: str) -> Tables:
        t = lambda name: load(spark, d, name)
        prof = R.paper_profiles(t("papers"), t("paragraphs"), t("paper_keywords"), t("keywords"))
        return cls(t("papers"), t("paragraphs"), t("keywords"), t("paper_keywords"), t("paper_tables"), R.relations(prof))


@dataclass
class Options:
    """What a search shows; the default view is the one that is cached."""

    primary_sections: list[str] | None = None
    related_sections: list[str] | None = None
    related: bool = True
    tables: bool = True
    abstract: bool = True
    force_refresh: bool = False

    @property
    def is_default(self) -> bool:
        return not self.primary_sections and not self.related_sections and self.related and self.tables and self.abstract


def resolved(found: DataFrame, t: Tables, s: Settings = DEFAULTS, related: bool = True) -> DataFrame:
    """found(query_id, keyword_id, exact, terms) with the primary paper of each keyword and that paper's best relation.

    (query_id, keyword_id, matched_keyword, primary_id, score, reason, primary_relevance,
    related_id, relation_score, related_relevance, explanation): the relevance is what the
    best matching paragraph of the paper begins with.  A keyword without papers has no row.
    """
    dim = 64
    scored = R.select_primary(R.primary_scores(t.links.join(found.select("keyword_id").distinct(), "keyword_id", "left_semi"), t.keywords, t.papers, t.paragraphs, s.as_of_year, dim))
    scored = scored.select("keyword_id", F.col("paper_id").alias("primary_id"), F.col("total").alias("score"), primary_reason().alias("reason"))
    k = t.keywords.select("keyword_id", F.col("display_form").alias("matched_keyword"), F.col("embedding").alias("q"))
    out = found.join(k, "keyword_id").join(scored, "keyword_id")
    if related:
        best = R.top_relation(t.relations).select(F.col("paper_id").alias("primary_id"), F.col("peer_id").alias("related_id"), "relation_score")
        out = out.join(best, "primary_id", "left")
    else:
        out = out.withColumn("related_id", F.lit(None).cast("long")).withColumn("relation_score", F.lit(None).cast("double"))
    titles = t.papers.select("paper_id", "title")
    out = persist_table(out, "resolved")
    for role in ("primary", "related"):
        pairs = out.filter(f"{role}_id is not null").select(F.col("keyword_id").alias("query_id"), F.col(f"{role}_id").alias("paper_id"), "q").dropDuplicates(["query_id", "paper_id"])
        near = R.paragraph_similarity(pairs, t.paragraphs, dim).groupBy("query_id", "paper_id").agg(F.min_by("paragraph_id", F.struct(-F.round("similarity", 5), F.col("paragraph_id"))).alias("paragraph_id"))
        words = T.strip(F.coalesce(F.nullif(F.col("cleaned_text"), F.lit("")), F.col("original_text")))
        near = near.join(t.paragraphs.select("paragraph_id", F.nullif(F.substring(words, 1, 200), F.lit("")).alias(f"{role}_relevance")), "paragraph_id")
        out = out.join(near.select(F.col("query_id").alias("keyword_id"), F.col("paper_id").alias(f"{role}_id"), f"{role}_relevance"), ["keyword_id", f"{role}_id"], "left")
        out = out.join(titles.select(F.col("paper_id").alias(f"{role}_id"), F.col("title").alias(f"{role}_title")), f"{role}_id", "left")
    out = out.withColumn("explanation", explanation(F.col("terms"), F.col("matched_keyword"), F.col("exact"), F.coalesce("primary_title", F.lit("")), F.col("related_title")))
    return out.select("query_id", "keyword_id", "exact", "terms", "matched_keyword", "primary_id", "primary_title", "score", "reason", "primary_relevance", "related_id", "related_title", "relation_score", "related_relevance", "explanation")


def resolve_cached(found: DataFrame, cache: DataFrame, t: Tables, options: Options | None = None, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(results, next cache): the default view is taken from the cache by keyword where it is there, the rest is computed and put in.

    A cached result keeps its papers and scores; its explanation is made for the query.
    ``force_refresh`` computes all.  Other views neither read nor write the cache.
    """
    options = options or Options()
    if not options.is_default:
        return resolved(found, t, s, options.related), cache
    kept = cache.limit(0) if options.force_refresh else cache
    hit = found.join(kept, "keyword_id").withColumn("explanation", explanation(F.col("terms"), F.col("matched_keyword"), F.col("exact"), F.coalesce("primary_title", F.lit("")), F.col("related_title")))
    # One computation per result; the cache is another version of the table.
    miss = persist_table(resolved(found.join(kept.select("keyword_id"), "keyword_id", "left_anti"), t, s), "resolved")
    columns = miss.columns
    fresh = miss.dropDuplicates(["keyword_id"]).select(*cache.columns)
    return hit.select(*columns).unionByName(miss), persist_table(upsert(cache, fresh, ["keyword_id"]), "cache")


def refresh_cache(cache: DataFrame, papers: DataFrame, t: Tables, s: Settings = DEFAULTS) -> DataFrame:
    """The cache after papers(paper_id) came in: the results of all keywords they are linked to computed again, others kept."""
    touched = t.links.join(papers.select("paper_id").distinct(), "paper_id", "left_semi").select("keyword_id").distinct()
    forms = t.keywords.join(touched, "keyword_id", "left_semi").select(F.col("keyword_id").alias("query_id"), "keyword_id", F.lit(True).alias("exact"), F.array("display_form").alias("terms"))
    return resolve_cached(forms, cache, t, Options(force_refresh=True), s)[1]


CACHE_COLUMNS = ("keyword_id", "matched_keyword", "primary_id", "primary_title", "score", "reason", "primary_relevance", "related_id", "related_title", "relation_score", "related_relevance")


def suggest(queries: DataFrame, t: Tables, embed=V.hash_vector, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, rank, keyword_id, display_form, similarity): linked keywords nearest to queries(query_id, text, terms).

    The joined terms are embedded, the whole text where there are none.  ``embed`` makes a
    vector column of a text column.
    """
    words = F.when(F.size("terms") > 0, F.array_join("terms", " ")).otherwise(F.coalesce("text", F.lit("")))
    near = V.best_matches(queries.select("query_id", embed(words).alias("q")), R.linked(t.keywords, t.links).select(F.col("keyword_id").alias("id"), F.col("embedding").alias("v")), s.similarity_floor, s.suggestion_limit)
    return near.join(t.keywords.select(F.col("keyword_id").alias("id"), "display_form"), "id").select("query_id", "rank", F.col("id").alias("keyword_id"), "display_form", F.round("similarity", 5).alias("similarity"))


@dataclass
class Bundle:
    """All sheets of one result."""

    summary: dict
    info: dict[str, DataFrame] = field(default_factory=dict)
    sections: dict[str, DataFrame] = field(default_factory=dict)
    paragraphs: dict[str, DataFrame] = field(default_factory=dict)
    tables: DataFrame | None = None


def bundle(result: dict, t: Tables, options: Options | None = None, query: str = "", created_at: str = "") -> Bundle:
    """The content of one row of :func:`resolved`; the row's papers are looked up by id."""
    o = options or Options()
    out = Bundle(result | {"query": query, "created_at": created_at})
    parts = [(PRIMARY, result["primary_id"], o.primary_sections)] + ([(RELATED, result["related_id"], o.related_sections)] if o.related else [])
    for role, paper, names in parts:
        mine = F.col("paper_id") == F.lit(paper).cast("long")
        out.info[role] = paper_info(t.papers.filter(mine), t.links.filter(mine), t.keywords, o.abstract)
        out.paragraphs[role] = ordered_paragraphs(t.paragraphs.filter(mine), names)
        out.sections[role] = section_bundle(out.paragraphs[role])
        if o.tables:
            own = ordered_tables(t.tables.filter(mine)).withColumn("role", F.lit(role))
            out.tables = own if out.tables is None else out.tables.unionByName(own)
    return out


def _grid_sheet(tables: list) -> W.Sheet:
    """The sheet of cells: every table under a line with its name, registered as a table of the workbook."""
    rows, areas = [], []
    for n, r in enumerate(tables, 1):
        rows.append((W.HEAD, [f"[{r['role']}] 표 {n}" + (f" — {r['table_title']}" if r["table_title"] else "")]))
        if r["grid"]:
            wide = max(map(len, r["grid"]))
            areas.append((len(rows) + 1, len(rows) + len(r["grid"]), wide, list(r["heads"])))
            rows += [(W.PLAIN, list(r["heads"]))] + [(W.PLAIN, list(x)) for x in r["grid"][1:]]
        rows.append((W.PLAIN, []))
    return W.Sheet(SHEETS[8], [], rows, free=True, tables=areas)


def write_result(b: Bundle, path: str) -> list[str]:
    """The workbook of one result, up to nine sheets; returns their names.  One paper's rows are few; all are written."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    r = b.summary
    summary = [r["query"], r["terms"], r["matched_keyword"], "exact" if r["exact"] else "selected", r["explanation"], r["primary_title"], r["related_title"], r["score"], r["reason"], r["primary_relevance"], r["relation_score"], r.get("relation_reason"), r["related_relevance"], r["created_at"]]
    sheets = [W.Sheet(SHEETS[0], SUMMARY_HEAD, [summary])]
    wide = {3: 60, 4: 60}
    for at, role in ((1, PRIMARY), (4, RELATED)):
        if role not in b.info:
            continue
        info = b.info[role].select("paper_id", "title", "authors", "published_year", "journal", "abstract", "abstract_summary", "full_text_link", "keywords")
        more = role == RELATED and r["relation_score"] is not None
        rows = [list(x) + ([r["relation_score"], r.get("relation_reason")] if more else []) for x in W.rows_of(info)]
        sheets.append(W.Sheet(SHEETS[at], PAPER_HEAD + (RELATION_HEAD if more else []), rows))
        sections = b.sections[role].orderBy("section_order").select("section_order", "section_name", "paragraph_count", "original_text", "cleaned_text", "summary", "keywords")
        sheets.append(W.Sheet(SHEETS[at + 1], SECTION_HEAD, map(list, W.rows_of(sections)), wide))
        paragraphs = b.paragraphs[role].orderBy("position").select("paragraph_order", "section_name", "original_text", "cleaned_text", "summary", "keywords")
        sheets.append(W.Sheet(SHEETS[at + 2], PARAGRAPH_HEAD, map(list, W.rows_of(paragraphs)), wide))
    if b.tables is not None:
        grid = grid_rows(F.col("table_text"))
        width = F.array_max(F.transform("grid", lambda x: F.size(x)))
        t = b.tables.withColumn("grid", grid).withColumn("heads", F.when(F.size("grid") > 0, headers(F.get("grid", F.lit(0)), width)))
        rows = t.orderBy(F.when(F.col("role") == PRIMARY, 0).otherwise(1), "position").select("role", "table_title", "table_text", "table_summary", "grid", "heads").collect()  # the tables of two papers
        sheets.append(W.Sheet(SHEETS[7], TABLE_HEAD, [[x["role"], n, x["table_title"], x["table_text"], x["table_summary"]] for n, x in enumerate(rows, 1)], {4: 60}))
        sheets.append(_grid_sheet(rows))
    return W.write_workbook(sheets, path)


# Queries --------------------------------------------------------------------------------------------------


def _found(spark, d) -> DataFrame:
    """Every linked keyword asked for by its own display form."""
    k = R.linked(load(spark, d, "keywords"), load(spark, d, "paper_keywords"))
    return k.select(F.col("keyword_id").alias("query_id"), "keyword_id", F.lit(True).alias("exact"), F.array("display_form").alias("terms"))


def _half(spark, d) -> Tables:
    """The stored tables with the relations of papers to the next one of their journal."""
    t = lambda name: load(spark, d, name)
    w = Window.partitionBy("journal").orderBy("paper_id")
    e = t("papers").filter("journal is not null").select(F.col("paper_id").alias("source_paper_id"), F.lead("paper_id").over(w).alias("related_paper_id"), F.lit(0.5).alias("relation_score")).filter("related_paper_id is not null")
    return Tables(t("papers"), t("paragraphs"), t("keywords"), t("paper_keywords"), t("paper_tables"), e)


def q_reasons(spark, d):
    """The score of every keyword's primary paper, explained."""
    s = R.select_primary(R.primary_scores(load(spark, d, "paper_keywords"), load(spark, d, "keywords"), load(spark, d, "papers"), load(spark, d, "paragraphs")))
    return s.select("keyword_id", "paper_id", F.format_string("%.2f", F.col("total")).alias("score"), (primary_reason().contains("단락 ")).alias("told"))


def q_explanations(spark, d):
    """Every keyword's search explained, related papers being neighbours in their journal."""
    r = resolved(_found(spark, d), _half(spark, d))
    return r.select("keyword_id", "primary_id", "related_id", "explanation")


def q_resolve_cached(spark, d):
    """Searches for all linked keywords, those of frequent ones answered from the cache of the first search."""
    t = _half(spark, d)
    found = _found(spark, d)
    often = found.join(t.keywords.filter("frequency >= 5").select("keyword_id"), "keyword_id", "left_semi")
    empty = resolved(found.limit(0), t).select(*CACHE_COLUMNS)
    _, cache = resolve_cached(often, empty, t)
    results, after = resolve_cached(found, cache, t)
    return results.join(after.select("keyword_id", F.lit(True).alias("cached")), "keyword_id").select("keyword_id", "primary_id", "related_id", "cached")


def q_cache_refreshed(spark, d):
    """A cache of stale results of all linked keywords after the papers of the newest year came in."""
    t = _half(spark, d)
    stale = resolved(_found(spark, d), t).select(*CACHE_COLUMNS).withColumn("primary_title", F.lit("stale"))
    newest = t.papers.agg(F.max("published_year").alias("published_year"))
    after = refresh_cache(persist_table(stale, "stale"), t.papers.join(newest, "published_year"), t)
    return after.select("keyword_id", "primary_id", (F.col("primary_title") == "stale").alias("stale"))


def q_suggest(spark, d):
    """Suggestions for every summary by the vector of its first keyword that is stored."""
    t = _half(spark, d)
    s = load(spark, d, "paper_summaries").select(F.col("summary_id").alias("query_id"), F.explode(T.unique_terms(F.col("keywords"))).alias("term"))
    k = t.keywords.filter("size(embedding) = 64 and exists(embedding, x -> x <> 0)").select(T.keyword(F.col("keyword")).alias("term"), "keyword_id", "embedding")
    q = s.join(k, "term").groupBy("query_id").agg(F.min_by("embedding", F.col("keyword_id")).alias("q"))
    near = V.best_matches(q, R.linked(t.keywords, t.links).select(F.col("keyword_id").alias("id"), F.col("embedding").alias("v")), DEFAULTS.similarity_floor, DEFAULTS.suggestion_limit)
    return near.select("query_id", F.col("id").alias("keyword_id"), F.round("similarity", 5).alias("similarity"))


def q_ordered_paragraphs(spark, d):
    return ordered_paragraphs(load(spark, d, "paragraphs")).select("paper_id", "paragraph_id", "position")


def q_ordered_tables(spark, d):
    return ordered_tables(load(spark, d, "paper_tables")).select("paper_id", "table_id", "position")


def q_section_choice(spark, d):
    """Paragraphs that are left when only the abstract was chosen (none), when nothing was (all relevant ones), and when one section was."""
    p = load(spark, d, "paragraphs")
    out = None
    for name, chosen in (("abstract", [ABSTRACT_CHOICE]), ("nothing", []), ("method", [ABSTRACT_CHOICE, "method"])):
        names, abstract = section_choice(chosen, True)
        one = R.section_filter(p, names).agg(F.count("*").alias("paragraphs")).select(F.lit(name).alias("chosen"), F.lit(abstract).alias("abstract"), "paragraphs")
        out = one if out is None else out.unionByName(one)
    return out


def q_sheet_info(spark, d):
    """The sheet of papers for all papers: their keywords in order."""
    p = paper_info(load(spark, d, "papers"), load(spark, d, "paper_keywords"), load(spark, d, "keywords"))
    return p.select("paper_id", "title", F.array_join("keywords", ", ").alias("keywords"))


def q_sheet_sections(spark, d):
    """The sheet of sections for all papers."""
    s = section_bundle(ordered_paragraphs(load(spark, d, "paragraphs")))
    return s.select("paper_id", "section_order", "section_name", "paragraph_count", F.md5("cleaned_text").alias("cleaned"), F.md5("summary").alias("summary"))


QUERIES = {
    "explanation_reason": q_reasons, "explanation": q_explanations, "resolve_cached": q_resolve_cached, "cache_refreshed": q_cache_refreshed, "suggest": q_suggest, "order_paragraphs": q_ordered_paragraphs, "order_tables": q_ordered_tables,
    "section_choice": q_section_choice, "sheet_info": q_sheet_info, "sheet_sections": q_sheet_sections,
}

_REL = "rel as (select * from (select paper_id as s, lead(paper_id) over (partition by journal order by paper_id) as r from papers where journal is not null) where r is not null), both_ as (select s as paper_id, r as peer from rel union all select r, s from rel), top as (select paper_id, min(peer) as peer from both_ group by 1)"
SQL = {
    "explanation_reason": f"with {R._PRIMARY} select keyword_id, paper_id, printf('%.2f', total) as score, true as told from prim",
    "explanation": f"""with {R._PRIMARY}, {_REL} select prim.keyword_id, prim.paper_id as primary_id, peer as related_id, '질의에서 ' || display_form || ' 키워드를 추출했고 저장 키워드 ''' || display_form || '''와 정확히 일치했습니다. 점수 근거에 따라 ''' || coalesce(p.title, '') || '''을 대표 논문으로 선택했습니다.' || case when q.title is null then '' else ' 연관 논문으로 ''' || q.title || '''도 함께 제공합니다.' end as explanation
from prim join keywords using (keyword_id) join papers p on p.paper_id = prim.paper_id left join top on top.paper_id = prim.paper_id left join papers q on q.paper_id = peer""",
    "resolve_cached": f"with {R._PRIMARY}, {_REL} select prim.keyword_id, prim.paper_id as primary_id, peer as related_id, true as cached from prim left join top on top.paper_id = prim.paper_id",
    "cache_refreshed": f"with {R._PRIMARY} select prim.keyword_id, prim.paper_id as primary_id, prim.keyword_id not in (select keyword_id from paper_keywords join papers using (paper_id) where published_year = (select max(published_year) from papers)) as stale from prim",
    "suggest": f"""with {R._KW}, s as (select summary_id as query_id, {R._N.format('x')} as term from (select summary_id, unnest(keywords) as x from paper_summaries) where x is not null), v as (select * from k where len(embedding) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
q as (select query_id, arg_min(embedding, keyword_id) as q from s join v using (term) where term <> '' group by 1),
c as (select query_id, v.keyword_id, round({R._COS.format('q.q', 'v.embedding')}, 9) as c from q join v on v.keyword_id in (select keyword_id from paper_keywords)),
r as (select *, row_number() over (partition by query_id order by c desc, keyword_id) as r from c where c >= 0.5) select query_id, keyword_id, round(c, 5) as similarity from r where r <= 3""",
    "order_paragraphs": "select paper_id, paragraph_id, row_number() over (partition by paper_id order by paragraph_order, paragraph_id) as position from paragraphs where is_topic_relevant",
    "order_tables": "select paper_id, table_id, row_number() over (partition by paper_id order by table_id) as position from paper_tables",
    "section_choice": "select 'abstract' as chosen, true as abstract, 0::bigint as paragraphs union all select 'nothing', true, count(*) from paragraphs where is_topic_relevant union all select 'method', true, count(*) from paragraphs where is_topic_relevant and section_name ilike '%method%'",
    "sheet_info": "with l as (select paper_id, keyword_id, coalesce(max(score), 0) as score from paper_keywords group by 1, 2), j as (select paper_id, string_agg(display_form, ', ' order by score desc, display_form, keyword_id) as keywords from l join keywords using (keyword_id) group by 1) select paper_id, title, coalesce(keywords, '') as keywords from papers left join j using (paper_id)",
    "sheet_sections": "with " + R._FOLD.format("is_topic_relevant") + " select paper_id, section_order::int as section_order, name as section_name, count(*) as paragraph_count, md5(coalesce(string_agg(nullif(cleaned_text, ''), chr(10) || chr(10) order by paragraph_order, paragraph_id), '')) as cleaned, md5(coalesce(string_agg(nullif(summary, ''), ' ' order by paragraph_order, paragraph_id), '')) as summary from g group by 1, 2, 3",
}
