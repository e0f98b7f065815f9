"""From layout blocks to paragraphs, tables and keywords: routing, sections, merging, scoring.

Blocks are rows (document_id, block_id, page, block_type, text, block_order, ordinal, bbox);
ties of block_order are broken by ordinal, the place in the document.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import DEFAULTS, Settings
from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.storage import load, persist_table

from .grouped import numbered, per_group

# Headings and labels that decide where a block goes.
REFERENCE_HEAD = r"(?iU)^\s*(references|appendix|참고문헌|부록)\b"
ABSTRACT_HEAD = r"(?iU)^\s*(abstract|초록|요약)\b"
FIGURE_CAPTION = r"(?iU)^\s*(fig(?:ure)?\.?|그림)\s*\d+\b"
KEYWORD_LABEL = r"(?iU)^\s*(keywords?|key\s*words?|색인어|주요\s*검색어|ccs\s*concepts?)\s*[:：]"
DROPPED = ("figure", "figure_caption", "formula", "header_footer", "reference")
META = ("title", "author", "abstract")
TABLES = ("table", "table_caption")
KEYWORD_TOKEN = r"([A-Za-z][A-Za-z0-9_-]{2,}|[가-힣]{2,})"
STOPWORDS = ("this", "that", "with", "from", "study", "paper", "논문", "연구", "결과")


def _doc():
    return Window.partitionBy("document_id").orderBy("block_order", "ordinal")


def _before():
    return _doc().rowsBetween(Window.unboundedPreceding, -1)


def _upto():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def document_blocks(reviews: DataFrame) -> DataFrame:
    """Blocks of review documents with their corrected text where there is one, else the text read."""
    b = reviews.select("document_id", "paper_id", F.posexplode("blocks").alias("ordinal", "b"))
    return b.select("document_id", "paper_id", "b.block_id", "b.page", "b.block_type", F.coalesce("b.corrected_text", "b.ocr_text").alias("text"), "b.block_order", "ordinal", "b.bbox", "b.confidence")


def page_extents(blocks: DataFrame) -> DataFrame:
    """Least x, greatest x and greatest y of the boxes of each page."""
    return blocks.filter("bbox is not null").groupBy("document_id", "page").agg(F.min("bbox.x1").alias("min_x"), F.max("bbox.x2").alias("max_x"), F.max("bbox.y2").alias("max_y"))


def is_footnote(s: Settings = DEFAULTS):
    """A short, flat, narrow text block at the foot of its page; needs the page's extents."""
    b = F.col("bbox")
    width = F.col("max_x") - F.col("min_x")
    flat = (b["y2"] - b["y1"]) <= s.footnote_max_height * F.col("max_y")
    low = b["y1"] >= s.footnote_min_y * F.col("max_y")
    return F.coalesce((F.col("block_type") == "text") & (F.length("text") <= s.footnote_max_chars) & low & flat & (b["x2"] - b["x1"] <= s.footnote_max_width * width), F.lit(False))


def recover_authors(blocks: DataFrame) -> DataFrame:
    """Text blocks of the first page strictly between the last title and the next abstract or section header become authors."""
    doc = Window.partitionBy("document_id")
    first = F.min("page").over(doc)
    b = blocks.withColumn("on_first", F.col("page") == first)
    b = b.withColumn("title_end", F.max(F.when(F.col("on_first") & (F.col("block_type") == "title"), F.col("block_order"))).over(doc))
    stop = F.min(F.when(F.col("on_first") & F.col("block_type").isin("abstract", "section_header") & (F.col("block_order") > F.col("title_end")), F.col("block_order"))).over(doc)
    b = b.withColumn("stop", stop)
    hit = F.col("on_first") & (F.col("block_type") == "text") & (F.col("block_order") > F.col("title_end")) & (F.col("block_order") < F.col("stop"))
    return b.withColumn("block_type", F.when(hit, "author").otherwise(F.col("block_type"))).drop("on_first", "title_end", "stop")


def route(blocks: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Each block with its route: meta, body, table, author_keywords or dropped.

    Everything from a reference heading on is dropped; abstracts after the first section
    header are body text.  Two running flags over the blocks of a document decide.
    """
    b = recover_authors(blocks).join(page_extents(blocks), ["document_id", "page"], "left")
    t = F.coalesce("text", F.lit(""))
    b = b.withColumn("ref_head", t.rlike(REFERENCE_HEAD)).withColumn("caption", t.rlike(FIGURE_CAPTION)).withColumn("foot", is_footnote(s))
    ends = F.col("ref_head") | (~F.col("caption") & ~F.col("foot") & (F.col("block_type") == "reference"))
    b = b.withColumn("gone", F.coalesce(F.max(ends).over(_before()), F.lit(False)) | F.col("ref_head"))
    alive = ~F.col("gone") & ~F.col("caption") & ~F.col("foot")
    header = alive & (F.col("block_type") == "section_header") & ~t.rlike(ABSTRACT_HEAD)
    b = b.withColumn("started", F.coalesce(F.max(header).over(_before()), F.lit(False)))
    kind = F.col("block_type")
    path = (
        F.when(~alive, "dropped")
        .when((kind == "header_footer") & t.rlike(KEYWORD_LABEL), "author_keywords")
        .when(kind.isin(*DROPPED), "dropped")
        .when((kind == "section_header") & t.rlike(ABSTRACT_HEAD), "dropped")
        .when((kind == "abstract") & F.col("started"), "body")
        .when(kind.isin(*META), "meta").when(kind.isin(*TABLES), "table")
        .when(kind.isin("section_header", "text"), "body").otherwise("dropped")
    )
    return b.withColumn("route", path).drop("ref_head", "caption", "foot", "gone", "started", "min_x", "max_x", "max_y")


def sections(routed: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Body blocks with the section header that was last seen; text before any header is in the default section."""
    body = routed.filter("route = 'body'")
    head = F.last(F.when(F.col("block_type") == "section_header", T.collapse(F.col("text"))), ignorenulls=True).over(_upto())
    return body.withColumn("section", F.coalesce(head, F.lit(s.default_section))).filter("block_type <> 'section_header'")


_SENTENCE_END = re.compile(r"[.!?。][\"')\]}]*$")
_BOUNDARY = re.compile(r"[.!?。]\s+|다\.")


def merge_short(items: list[tuple[str, str]], least: int) -> list[tuple[str, str]]:
    """Texts of one section joined to the one before where either is short or a sentence goes on."""
    out: list[tuple[str, str]] = []
    for section, text in items:
        if out and out[-1][0] == section:
            before = out[-1][1].rstrip()
            goes_on = bool(before) and not _SENTENCE_END.search(before) and (text[:1].islower() or before[-1] in "-‐‑")
            if len(out[-1][1]) < least or len(text) < least or goes_on:
                out[-1] = (section, f"{out[-1][1]}\n\n{text}")
                continue
        out.append((section, text))
    return out


def split_long(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut after the last sentence end that fits, else hard."""
    pieces = []
    while len(text) > most:
        ends = [m.end() for m in _BOUNDARY.finditer(text[: most + 1]) if m.end() <= most]
        at = ends[-1] if ends else most
        pieces.append(text[:at].strip())
        text = text[at:].lstrip()
    return [p for p in [*pieces, text.strip()] if p]


def build_paragraphs(body: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(document_id, paragraph_order, section, text): lines cleaned, short texts merged, long ones split.

    Merging depends on the order, so it runs once per document; a document is one group.
    """
    least, most = s.paragraph_min_chars, s.paragraph_max_chars

    def one(key: dict, rows: list[dict]) -> list[dict]:
        items = merge_short([(r["section"], r["clean"]) for r in rows if r["clean"]], least)
        pieces = [(section, p) for section, t in items for p in split_long(t, most)]
        return [key | {"paragraph_order": i, "section": section, "text": p} for i, (section, p) in enumerate(pieces, 1)]

    b = body.withColumn("clean", T.clean_lines(F.col("text")))
    return per_group(b, ["document_id"], ["section", "clean"], ["block_order", "ordinal"], one, "document_id string, paragraph_order int, section string, text string")


def table_titles(routed: DataFrame) -> DataFrame:
    """Tables with the caption just before them as title, null without one."""
    t = routed.filter("route = 'table'")
    before = F.lag(F.when(F.col("block_type") == "table_caption", F.col("text"))).over(_doc())
    return t.withColumn("title", before).filter("block_type = 'table'")


def keyword_scores(terms: DataFrame, papers: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(paper_id, term, score): 0.3 title + 0.2 abstract + 0.2 body share + 0.3 given by the authors.

    terms(paper_id, term, is_author); body share is the term's count in paragraph keywords
    by that of the paper's most frequent one.
    """
    body = paragraphs.select("paper_id", F.explode("keywords").alias("k")).select("paper_id", T.keyword(F.col("k")).alias("term")).filter("term <> ''")
    body = body.groupBy("paper_id", "term").agg(F.count("*").alias("n"))
    most = body.groupBy("paper_id").agg(F.max("n").alias("most"))
    r = terms.join(papers.select("paper_id", T.keyword(F.col("title")).alias("t"), T.keyword(F.col("abstract")).alias("a")), "paper_id")
    r = r.join(body, ["paper_id", "term"], "left").join(most, "paper_id", "left")
    hit = lambda c: F.when(F.coalesce(F.contains(F.col(c), F.col("term")), F.lit(False)), 1.0).otherwise(0.0)
    share = F.coalesce(F.col("n") / F.col("most"), F.lit(0.0))
    return r.select("paper_id", "term", F.round(0.3 * hit("t") + 0.2 * hit("a") + 0.2 * share + F.when(F.col("is_author"), 0.3).otherwise(0.0), 6).alias("score"))


def resolve_batch(batch: DataFrame, keywords: DataFrame, aliases: DataFrame, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(resolved, new aliases) of a batch(term, n, v) against keywords(keyword_id, term, frequency, embedding) and aliases(alias, keyword_id).

    resolved(term, keyword_id, frequency, via): a term that is a keyword ("term") or else an
    alias ("alias") raises the frequency; one whose vector is at least ``s.alias_threshold``
    like the nearest keyword's becomes its alias ("merged"); all others are new and get ids
    after the largest in order of their buckets.  A term is judged against what is stored,
    not against other terms of the batch.  Frequencies count all terms of the batch that
    come to a keyword.
    """
    direct = batch.join(keywords.select("term", "keyword_id"), "term").select("term", "n", "keyword_id", F.lit("term").alias("via"))
    other = batch.join(keywords.select("term"), "term", "left_anti").join(aliases.select(F.col("alias").alias("term"), "keyword_id"), "term")
    known = direct.unionByName(other.select("term", "n", "keyword_id", F.lit("alias").alias("via")))
    left = persist_table(batch.join(known.select("term"), "term", "left_anti"), "terms-left")
    near = V.best_matches(left.select(F.col("term").alias("query_id"), F.col("v").alias("q")), keywords.select(F.col("keyword_id").alias("id"), F.col("embedding").alias("v")), None, 1)
    near = near.filter(F.round("similarity", 6) >= s.alias_threshold).select(F.col("query_id").alias("term"), F.col("id").alias("keyword_id"))
    merged = left.join(near, "term").select("term", "n", "keyword_id", F.lit("merged").alias("via"))
    top = keywords.agg(F.coalesce(F.max("keyword_id"), F.lit(0))).first()[0]
    new = numbered(left.join(near, "term", "left_anti").select("term", "n"), [], ["term"], "keyword_id", top)
    both = known.unionByName(merged)
    total = both.groupBy("keyword_id").agg(F.sum("n").alias("more"))
    stored = keywords.select("keyword_id", F.coalesce("frequency", F.lit(0)).alias("f"))
    old = both.join(total, "keyword_id").join(stored, "keyword_id").select("term", "keyword_id", (F.col("f") + F.col("more")).cast("long").alias("frequency"), "via")
    fresh = new.select("term", "keyword_id", F.col("n").cast("long").alias("frequency"), F.lit("new").alias("via"))
    return old.unionByName(fresh), merged.select(F.col("term").alias("alias"), "keyword_id")


# Queries --------------------------------------------------------------------------------------------------


def _blocks(spark, d):
    return document_blocks(load(spark, d, "review_documents"))


def q_route_blocks(spark, d):
    return route(_blocks(spark, d)).select("document_id", "block_id", "block_type", "route")


def q_running_section(spark, d):
    return sections(route(_blocks(spark, d))).select("document_id", "block_id", "section")


def q_page_extents(spark, d):
    e = page_extents(_blocks(spark, d))
    return e.select("document_id", "page", *[F.round(c, 4).alias(c) for c in ("min_x", "max_x", "max_y")])


def q_filter_footnote(spark, d):
    b = _blocks(spark, d)
    return b.join(page_extents(b), ["document_id", "page"]).filter(is_footnote()).select("document_id", "block_id")


def q_recover_author(spark, d):
    return recover_authors(_blocks(spark, d)).filter("block_type = 'author'").select("document_id", "block_id")


def q_build_paragraphs(spark, d):
    return build_paragraphs(sections(route(_blocks(spark, d))))


def q_caption_carry(spark, d):
    return table_titles(route(_blocks(spark, d))).select("document_id", "block_id", "title")


def q_renumber(spark, d):
    b = _blocks(spark, d)
    return b.withColumn("new_order", F.row_number().over(_doc())).select("document_id", "block_id", "new_order")


def q_keyword_score(spark, d):
    k = load(spark, d, "keywords").select("keyword_id", T.keyword(F.col("keyword")).alias("term")).filter("term <> ''")
    link = load(spark, d, "paper_keywords").groupBy("paper_id", "keyword_id").agg(F.max("score").alias("s"))
    terms = link.join(k, "keyword_id").groupBy("paper_id", "term").agg(F.max(F.coalesce(F.col("s") >= 0.8, F.lit(False))).alias("is_author"))
    return keyword_scores(terms, load(spark, d, "papers"), load(spark, d, "paragraphs"))


def q_body_keyword_freq(spark, d):
    body = load(spark, d, "paragraphs").select("paper_id", F.explode("keywords").alias("k")).select("paper_id", T.keyword(F.col("k")).alias("term")).filter("term <> ''")
    return body.groupBy("paper_id", "term").agg(F.count("*").alias("n")).withColumn("most", F.max("n").over(Window.partitionBy("paper_id")))


def q_keyword_resolve(spark, d):
    """Terms of all paragraphs as a batch, each with the vector of the first paragraph that names it, against the stored keywords and their display forms as aliases."""
    p = load(spark, d, "paragraphs").select("paragraph_id", "embedding", F.explode(T.unique_terms(F.col("keywords"))).alias("term"))
    batch = p.groupBy("term").agg(F.count("*").alias("n"), F.min_by("embedding", F.when(F.size("embedding") == 64, F.col("paragraph_id"))).alias("v"))
    k = load(spark, d, "keywords").select(T.keyword(F.col("keyword")).alias("term"), "keyword_id", "frequency", "embedding", "display_form").filter("term <> ''")
    stored = k.groupBy("term").agg(F.min("keyword_id").alias("keyword_id"), F.sum(F.coalesce("frequency", F.lit(0))).alias("frequency"), F.min_by("embedding", "keyword_id").alias("embedding"))
    forms = k.select("term", F.explode(F.array(T.strip(F.col("display_form")), T.keyword(F.col("display_form")))).alias("alias")).filter("alias <> ''")
    forms = forms.join(stored.select("term", "keyword_id"), "term").groupBy("alias").agg(F.min("keyword_id").alias("keyword_id"))
    return resolve_batch(batch, stored, forms)[0]


def q_fallback_keyword_top5(spark, d):
    """The five most frequent tokens of each abstract, stop words left out."""
    t = load(spark, d, "papers").select("paper_id", F.explode(F.regexp_extract_all(F.lower("abstract"), F.lit(KEYWORD_TOKEN), F.lit(1))).alias("token")).filter(~F.col("token").isin(*STOPWORDS))
    g = t.groupBy("paper_id", "token").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("n"), "token"))).filter("rank <= 5")


def q_effective_text(spark, d):
    return _blocks(spark, d).select("document_id", "block_id", "text")


def q_strip_abstract_heading(spark, d):
    return load(spark, d, "papers").select("paper_id", F.md5(T.strip_abstract_heading(F.concat(F.lit("Abstract: "), F.col("abstract")))).alias("h"))


def paper_meta(routed: DataFrame) -> DataFrame:
    """(document_id, title, abstract, published_year) of routed blocks: meta texts by line, the year first named in title, abstract and the first 20 blocks."""
    t = T.strip(F.coalesce("text", F.lit("")))
    b = routed.withColumn("t", t).withColumn("place", F.row_number().over(_doc()))
    joined = lambda keep, sep, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", F.col(c).alias("t"))))), lambda x: x["t"]), sep)
    is_meta = lambda kind: (F.col("route") == "meta") & (F.col("block_type") == kind) & (F.col("t") != "")
    m = b.withColumn("raw", F.coalesce("text", F.lit(""))).groupBy("document_id").agg(joined(is_meta("title"), "\n", "t").alias("title"), joined(is_meta("abstract"), "\n", "t").alias("abstract"), joined(F.col("place") <= 20, "\n", "raw").alias("context"))
    m = m.withColumn("abstract", T.strip_abstract_heading(F.col("abstract")))
    return m.select("document_id", "title", "abstract", T.year(F.concat_ws(" ", "title", "abstract", "context")).alias("published_year"))


def q_extract_authors(spark, d):
    """Author lists with marks and an affiliation after them, as one block per name, read again."""
    bare = lambda x: F.regexp_replace(T.strip(x), r"[\d*∗†‡,\s]+$", "")
    p = load(spark, d, "papers").select("paper_id", F.transform(F.split("authors", ";"), bare).alias("a"))
    block = F.transform("a", lambda x, i: F.when(x == "", x).otherwise(F.concat(x, F.when(i % 2 == 0, F.concat((i + 1).cast("string"), F.lit("*"))).otherwise(F.lit("\n∗2,3")))))
    block = F.concat(block, F.array(F.lit("1 South University of Technology"), F.lit("Not A Name")))
    return p.select("paper_id", F.posexplode(T.author_list(block)).alias("position", "author"))


def q_paper_meta(spark, d):
    """Title, abstract and year as found in the blocks of each document."""
    return paper_meta(route(_blocks(spark, d)))


def q_extract_year(spark, d):
    return paper_meta(route(_blocks(spark, d))).filter("published_year is not null").select("document_id", F.col("published_year").alias("year"))


def q_norm_keyword(spark, d):
    return load(spark, d, "keywords").select("keyword_id", T.keyword(F.col("keyword")).alias("term"))


def q_norm_lines(spark, d):
    return load(spark, d, "paper_tables").select("table_id", T.clean_lines(F.col("table_text")).alias("text"))


def q_norm_unique(spark, d):
    return load(spark, d, "paragraphs").select("paragraph_id", F.array_join(T.unique_terms(F.coalesce("keywords", F.array().cast("array<string>"))), "|").alias("terms"))


def q_query_terms_regex(spark, d):
    return load(spark, d, "papers").select("paper_id", F.array_join(T.query_terms(F.col("title")), "|").alias("terms"))


def q_slug(spark, d):
    return load(spark, d, "papers").select("paper_id", T.slug(F.col("title")).alias("slug"))


def q_truncate(spark, d):
    return load(spark, d, "paper_tables").select("table_id", T.cut(F.col("table_text")).alias("preview"))


def q_cjk_guard(spark, d):
    return load(spark, d, "paragraphs").filter(T.has_ideographs(F.col("summary"))).select("paragraph_id")


def q_hash_split(spark, d):
    """Validation part of the review documents, by hash alone."""
    return load(spark, d, "review_documents").select("document_id", F.when(T.hash_share(F.col("document_id")) < 0.2, "val").otherwise("train").alias("split"))


QUERIES = {
    "route_blocks": q_route_blocks, "running_section": q_running_section, "page_extents": q_page_extents, "filter_footnote": q_filter_footnote, "recover_author": q_recover_author,
    "build_paragraphs": q_build_paragraphs, "caption_carry": q_caption_carry, "renumber": q_renumber, "keyword_score": q_keyword_score, "body_keyword_freq": q_body_keyword_freq,
    "keyword_resolve": q_keyword_resolve, "fallback_keyword_top5": q_fallback_keyword_top5, "effective_text": q_effective_text, "strip_abstract_heading": q_strip_abstract_heading,
    "extract_authors": q_extract_authors, "paper_meta": q_paper_meta, "extract_year": q_extract_year, "norm_keyword": q_norm_keyword, "norm_lines": q_norm_lines, "norm_unique": q_norm_unique,
    "query_terms_regex": q_query_terms_regex, "slug": q_slug, "truncate": q_truncate, "cjk_guard": q_cjk_guard, "hash_split": q_hash_split,
}

_B = "b as (select document_id, paper_id, (x.b).block_id as block_id, (x.b).page as page, (x.b).block_type as block_type, coalesce((x.b).corrected_text, (x.b).ocr_text) as text, (x.b).block_order as block_order, x.i as ordinal, (x.b).bbox as bbox from (select document_id, paper_id, unnest(blocks) as b, unnest(range(len(blocks))) as i from review_documents) x)"
_EXT = "ext as (select document_id, page, min(bbox.x1) as min_x, max(bbox.x2) as max_x, max(bbox.y2) as max_y from b where bbox is not null group by 1, 2)"
_AUTH = """m as (select *, min(page) over (partition by document_id) as fp from b), t as (select *, max(case when page = fp and block_type = 'title' then block_order end) over (partition by document_id) as te from m),
st as (select *, min(case when page = fp and block_type in ('abstract', 'section_header') and block_order > te then block_order end) over (partition by document_id) as stop from t),
au as (select document_id, block_id, page, text, block_order, ordinal, bbox, case when page = fp and block_type = 'text' and block_order > te and block_order < stop then 'author' else block_type end as block_type from st)"""
_FOOT = "coalesce(block_type = 'text' and length(text) <= 240 and bbox.y1 >= 0.88 * max_y and bbox.y2 - bbox.y1 <= 0.02 * max_y and bbox.x2 - bbox.x1 <= 0.5 * (max_x - min_x), false)"
_ROUTE = rf"""{_B}, {_EXT}, {_AUTH},
f as (select au.*, coalesce(text, '') as tx, regexp_matches(coalesce(text, ''), '(?i)^\s*(references|appendix|참고문헌|부록)\b') as rh, regexp_matches(coalesce(text, ''), '(?i)^\s*(fig(?:ure)?\.?|그림)\s*\d+\b') as cap, {_FOOT} as foot from au left join ext using (document_id, page)),
g as (select *, rh or coalesce(max(rh or (not cap and not foot and block_type = 'reference')) over (partition by document_id order by block_order, ordinal rows between unbounded preceding and 1 preceding), false) as gone from f),
h as (select *, not gone and not cap and not foot as alive, regexp_matches(tx, '(?i)^\s*(abstract|초록|요약)\b') as ah from g),
i as (select *, coalesce(max(alive and block_type = 'section_header' and not ah) over (partition by document_id order by block_order, ordinal rows between unbounded preceding and 1 preceding), false) as started from h),
routed as (select *, case when not alive then 'dropped' when block_type = 'header_footer' and regexp_matches(tx, '(?i)^\s*(keywords?|key\s*words?|ccs\s*concepts?)\s*[:]') then 'author_keywords'
  when block_type in ('figure', 'figure_caption', 'formula', 'header_footer', 'reference') or (block_type = 'section_header' and ah) then 'dropped' when block_type = 'abstract' and started then 'body'
  when block_type in ('title', 'author', 'abstract') then 'meta' when block_type in ('table', 'table_caption') then 'table' when block_type in ('section_header', 'text') then 'body' else 'dropped' end as route from i)"""
_N = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_C = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_BODY = f"body as (select paper_id, term, count(*) as n from (select paper_id, {_N.format('k')} as term from (select paper_id, unnest(keywords) as k from paragraphs) where k is not null) where term <> '' group by 1, 2)"
_UNIQUE = f"list_filter(list_distinct(list_transform({{}}, lambda x: {_N.format('x')})), lambda x: x is not null and x <> '')"
SQL = {
    "route_blocks": f"with {_ROUTE} select document_id, block_id, block_type, route from routed",
    "running_section": f"with {_ROUTE}, s as (select *, last_value(case when block_type = 'section_header' then {_C.format('text')} end ignore nulls) over (partition by document_id order by block_order, ordinal rows between unbounded preceding and current row) as sec from routed where route = 'body') select document_id, block_id, coalesce(sec, '본문') as section from s where block_type <> 'section_header'",
    "page_extents": f"with {_B}, {_EXT} select document_id, page, round(min_x, 4) as min_x, round(max_x, 4) as max_x, round(max_y, 4) as max_y from ext",
    "filter_footnote": f"with {_B}, {_EXT} select document_id, block_id from b join ext using (document_id, page) where {_FOOT}",
    "recover_author": f"with {_B}, {_AUTH} select document_id, block_id from au where block_type = 'author'",
    "caption_carry": f"with {_ROUTE}, tt as (select *, lag(case when block_type = 'table_caption' then text end) over (partition by document_id order by block_order, ordinal) as title from routed where route = 'table') select document_id, block_id, title from tt where block_type = 'table'",
    "renumber": f"with {_B} select document_id, block_id, row_number() over (partition by document_id order by block_order, ordinal) as new_order from b",
    "keyword_score": f"""with k as (select keyword_id, {_N.format('keyword')} as term from keywords), l as (select paper_id, keyword_id, max(score) as s from paper_keywords group by 1, 2),
t as (select paper_id, term, max(coalesce(s >= 0.8, false)) as is_author from l join k using (keyword_id) where term <> '' group by 1, 2), {_BODY}, m as (select paper_id, max(n) as most from body group by 1)
select t.paper_id, t.term, round(0.3 * coalesce(contains({_N.format('p.title')}, t.term), false)::int + 0.2 * coalesce(contains({_N.format('p.abstract')}, t.term), false)::int + 0.2 * coalesce(n::double / most, 0) + 0.3 * is_author::int, 6)::double as score
from t join papers p using (paper_id) left join body using (paper_id, term) left join m using (paper_id)""",
    "body_keyword_freq": f"with {_BODY} select paper_id, term, n, max(n) over (partition by paper_id) as most from body",
    "keyword_resolve": f"""with p0 as (select paragraph_id, embedding, unnest({_UNIQUE.format('keywords')}) as term from paragraphs),
ba as (select term, count(*) as n, arg_min(embedding, paragraph_id) filter (len(embedding) = 64) as v from p0 group by 1),
k0 as (select {_N.format('keyword')} as term, keyword_id, frequency, embedding, display_form from keywords), k1 as (select * from k0 where term <> ''),
st as (select term, min(keyword_id) as keyword_id, sum(coalesce(frequency, 0)) as f, arg_min(embedding, keyword_id) as e from k1 group by 1),
al as (select alias, min(st.keyword_id) as keyword_id from (select term, unnest([trim(display_form), {_N.format('display_form')}]) as alias from k1) join st using (term) where alias <> '' group by 1),
kn as (select ba.term, n, coalesce(st.keyword_id, al.keyword_id) as keyword_id, case when st.keyword_id is not null then 'term' else 'alias' end as via from ba left join st using (term) left join al on al.alias = ba.term where st.keyword_id is not null or al.keyword_id is not null),
le as (select * from ba where term not in (select term from kn)),
cs as (select le.term, le.n, st.keyword_id, list_dot_product(v::double[], e::double[]) / sqrt(list_dot_product(v::double[], v::double[]) * list_dot_product(e::double[], e::double[])) as c from le join st on len(v) = 64 and len(e) = 64 where len(list_filter(v, lambda x: x <> 0)) > 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
me as (select term, n, keyword_id, 'merged' as via from (select *, row_number() over (partition by term order by round(c, 9) desc, keyword_id) as r from cs) where r = 1 and round(c, 6) >= 0.95),
bo as (select * from kn union all select * from me)
select term, bo.keyword_id, (st.f + sum(n) over (partition by bo.keyword_id))::bigint as frequency, via from (select bo.*, s.f from bo join (select keyword_id, f from st) s using (keyword_id)) bo join (select keyword_id, f from st) st using (keyword_id) union all
select term, (select max(keyword_id) from st) + row_number() over (order by term), n, 'new' from le where term not in (select term from me)""",
    "fallback_keyword_top5": f"with t as (select paper_id, unnest(regexp_extract_all(lower(abstract), '[A-Za-z][A-Za-z0-9_-]{{2,}}|[가-힣]{{2,}}')) as token from papers), g as (select paper_id, token, count(*) as n from t where token not in {STOPWORDS} group by 1, 2), r as (select *, row_number() over (partition by paper_id order by n desc, token) as rank from g) select * from r where rank <= 5",
    "effective_text": f"with {_B} select document_id, block_id, text from b",
    "strip_abstract_heading": r"select paper_id, md5(regexp_replace(abstract, '^\s+|\s+$', '', 'g')) as h from papers",
    "extract_authors": r"""with a as (select paper_id, regexp_replace(trim(unnest(string_split(authors, ';'))), '[\d*∗†‡,\s]+$', '') as x, unnest(range(len(string_split(authors, ';')))) as i from papers),
b as (select *, coalesce(min(case when regexp_matches(x, '(?i)@|\b(university|institute|laborator(y|ies)|research|department|school|college|centre|center|corporation|company|co\.|ltd\.?|inc\.?)\b') then i end) over (partition by paper_id), 1000000) as stop from a),
c as (select paper_id, trim(unnest(regexp_split_to_array(x, '[,;\n]+'))) as author, i, unnest(range(len(regexp_split_to_array(x, '[,;\n]+')))) as j from b where x <> '' and i < stop)
select paper_id, (row_number() over (partition by paper_id order by i, j) - 1)::int as position, author from c where author <> ''""",
    "paper_meta": rf"""with {_ROUTE}, pl as (select *, trim(coalesce(text, '')) as t, coalesce(text, '') as raw, row_number() over (partition by document_id order by block_order, ordinal) as place from routed),
mm as (select document_id, coalesce(string_agg(t, chr(10) order by place) filter (route = 'meta' and block_type = 'title' and t <> ''), '') as title, trim(regexp_replace(coalesce(string_agg(t, chr(10) order by place) filter (route = 'meta' and block_type = 'abstract' and t <> ''), ''), '(?i)^\s*(abstract|초록|요약)\s*([:：.\-–—]\s*)?(\r?\n|\s+)', '')) as abstract, coalesce(string_agg(raw, chr(10) order by place) filter (place <= 20), '') as context from pl group by 1)
select document_id, title, abstract, nullif(regexp_extract(title || ' ' || abstract || ' ' || context, '\b(19\d{{2}}|20\d{{2}})\b', 1), '')::int as published_year from mm""",
    "extract_year": rf"""with {_ROUTE}, pl as (select *, trim(coalesce(text, '')) as t, coalesce(text, '') as raw, row_number() over (partition by document_id order by block_order, ordinal) as place from routed),
mm as (select document_id, coalesce(string_agg(t, ' ' order by place) filter (route = 'meta' and block_type = 'title'), '') || ' ' || coalesce(string_agg(t, ' ' order by place) filter (route = 'meta' and block_type = 'abstract'), '') || ' ' || coalesce(string_agg(raw, ' ' order by place) filter (place <= 20), '') as all_ from pl group by 1),
y as (select document_id, nullif(regexp_extract(all_, '\b(19\d{{2}}|20\d{{2}})\b', 1), '')::int as year from mm) select * from y where year is not null""",
    "norm_keyword": f"select keyword_id, {_N.format('keyword')} as term from keywords",
    "norm_lines": rf"select table_id, array_to_string(list_filter(list_transform(string_split(table_text, chr(10)), lambda x: {_C.format('x')}), lambda x: x <> ''), chr(10)) as text from paper_tables",
    "norm_unique": f"with u as (select paragraph_id, {_N.format('x')} as t, min(i) as i from (select paragraph_id, unnest(keywords) as x, unnest(range(len(keywords))) as i from paragraphs) where x is not null group by 1, 2) select paragraph_id, coalesce(string_agg(t, '|' order by i) filter (t <> ''), '') as terms from paragraphs left join u using (paragraph_id) group by 1",
    "query_terms_regex": "select paper_id, array_to_string(regexp_extract_all(coalesce(title, ''), '[A-Za-z][A-Za-z0-9_-]+|[가-힣]{2,}'), '|') as terms from papers",
    "slug": "with s as (select paper_id, regexp_replace(substring(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') as s from papers) select paper_id, case when s = '' then 'paper' else s end as slug from s",
    "truncate": "with s as (select table_id, replace(replace(table_text, chr(10), ' ⏎ '), '|', '/') as s from paper_tables) select table_id, case when length(s) > 60 then substring(s, 1, 59) || '…' else s end as preview from s",
    "cjk_guard": r"select paragraph_id from paragraphs where regexp_matches(summary, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]')",
    "hash_split": "select document_id, case when ('0x' || substring(sha256(document_id), 1, 16))::uhugeint::double / 18446744073709551616 < 0.2 then 'val' else 'train' end as split from review_documents",
}
