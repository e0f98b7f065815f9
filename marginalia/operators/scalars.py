"""Row functions and small joins over the tables, one query each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import DEFAULTS
from marginalia.functions import boxes as B
from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.storage import load

from .blocks import ABSTRACT_HEAD, REFERENCE_HEAD, document_blocks
from .evaluation import review_blocks
from .layout import _GRID, grid_rows
from .retrieval import year_proximity, year_weight


def markdown_grid(c: Column) -> Column:
    """A pipe table as a Markdown table: rows filled up to the widest, the first as head; null without rows."""
    rows = grid_rows(c)
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n"))


def simple_layout(lines: DataFrame) -> DataFrame:
    """Classes of text-layer lines(document_id, page, line, text, size); blank lines are left out.

    From a reference heading on all are references.  The title is the first line of page 1
    with the text of its largest line, if no heading came before; the rest is text.
    """
    w = Window.partitionBy("document_id").orderBy("page", "line")
    doc = Window.partitionBy("document_id")
    lines = lines.withColumn("text", T.strip(F.col("text"))).filter("text <> ''")
    lines = lines.withColumn("refs", F.max(F.col("text").rlike(REFERENCE_HEAD)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min_by(F.when(F.col("page") == 1, F.col("text")), F.when(F.col("page") == 1, F.struct(-F.col("size"), F.col("line")))).over(doc)
    lines = lines.withColumn("alike", (F.col("page") == 1) & ~F.col("refs") & (F.col("text") == best))
    first = F.min(F.when(F.col("alike"), F.col("line"))).over(doc)
    return lines.withColumn("block_type", F.when(F.col("alike") & (F.col("line") == first), "title").when(F.col("refs"), "reference").otherwise("text"))


def typed_items(items: DataFrame) -> DataFrame:
    """Classes of parsed items(document_id, item, label, text); items without a label are left out.

    The first title is the title, later ones are text.  A header, a text whose first line
    is a reference heading, or a reference opens the references for good; the last header
    opens or ends the abstract; captions are of tables if a neighbour is one.
    """
    w = Window.partitionBy("document_id").orderBy("item")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    label, text = F.lower(T.strip(F.coalesce("label", F.lit("")))), T.strip(F.coalesce("text", F.lit("")))
    items = items.withColumn("label", label).withColumn("text", text).filter("label <> ''")
    header, body = F.col("label") == "section_header", F.col("label").isin("text", "paragraph", "list_item")
    opens = (F.col("label") == "reference") | (header & F.col("text").rlike(REFERENCE_HEAD)) | (body & F.substring_index("text", "\n", 1).rlike(REFERENCE_HEAD))
    refs = F.max(opens).over(upto)
    abstract = F.coalesce(F.last(F.when(header, F.col("text").rlike(ABSTRACT_HEAD)), ignorenulls=True).over(upto), F.lit(False))
    table = F.coalesce((F.lag("label").over(w) == "table"), F.lit(False)) | F.coalesce((F.lead("label").over(w) == "table"), F.lit(False))
    first = F.row_number().over(Window.partitionBy("document_id", "label").orderBy("item")) == 1
    kind = (
        F.when(F.col("label") == "table", "table").when(F.col("label").isin("picture", "chart"), "figure")
        .when(F.col("label") == "title", F.when(first, "title").otherwise("text")).when(header, "section_header")
        .when(body, F.when(refs, "reference").when(abstract, "abstract").otherwise("text"))
        .when(F.col("label") == "caption", F.when(table, "table_caption").otherwise("figure_caption"))
        .when(F.col("label").isin("formula", "reference"), F.col("label")).when(F.col("label").isin("page_header", "page_footer", "footnote"), "header_footer").otherwise("text")
    )
    return items.withColumn("block_type", kind)


def visual_rows(blocks: list[dict]) -> list[dict]:
    """Boxes in rows: from the top, a box joins the first row whose mean middle is within half its height; rows downwards, boxes to the right.

    Blocks without a box come last.
    """
    placed = [b for b in blocks if b["bbox"]]
    box = np.array([b["bbox"] for b in placed], "f8").reshape(-1, 4)
    middle, reach = (box[:, 1] + box[:, 3]) / 2, np.maximum(box[:, 3] - box[:, 1], 1) / 2
    total, count, row = np.zeros(len(placed)), np.zeros(len(placed)), np.zeros(len(placed), int)
    rows = 0
    for i in np.lexsort((box[:, 0], middle)):
        near = np.flatnonzero(np.abs(middle[i] - total[:rows] / np.maximum(count[:rows], 1)) <= reach[i])
        row[i] = near[0] if len(near) else rows
        rows = max(rows, row[i] + 1)
        total[row[i]] += middle[i]
        count[row[i]] += 1
    mean = total / np.maximum(count, 1)
    order = np.lexsort((box[:, 0], row, mean[row])) if placed else []
    return [placed[i] for i in order] + [b for b in blocks if not b["bbox"]]


# Queries --------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    return load(spark, d, "keywords").select("keyword_id", "embedding").withColumn("next", F.lead("embedding").over(Window.partitionBy(F.floor(F.col("keyword_id") / 16)).orderBy("keyword_id")))


def q_cosine(spark, d):
    return _vectors(spark, d).select("keyword_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 5).alias("cosine"))


def q_year_weight(spark, d):
    return load(spark, d, "papers").select("paper_id", F.round(year_weight(F.col("published_year"), DEFAULTS.as_of_year), 6).alias("weight"))


def q_year_proximity(spark, d):
    p = load(spark, d, "papers").select("paper_id", "published_year", F.lag("published_year").over(Window.partitionBy("journal").orderBy("paper_id")).alias("before"))
    return p.select("paper_id", F.round(year_proximity(F.col("published_year"), F.col("before")), 6).alias("proximity"))


def q_agg_keywords(spark, d):
    k = load(spark, d, "keywords").select("keyword_id", "display_form")
    j = load(spark, d, "paper_keywords").select("paper_id", "keyword_id").distinct().join(k, "keyword_id")
    return j.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("display_form")), "|").alias("keywords"), F.count("*").alias("n"))


def q_norm_ws(spark, d):
    return load(spark, d, "paragraphs").select("paragraph_id", F.md5(T.collapse(F.col("original_text"))).alias("h"))


def q_clean_keywords(spark, d):
    return load(spark, d, "paper_summaries").select("summary_id", F.size(T.clean_items(F.col("keywords"))).alias("n"))


def q_vector_literal(spark, d):
    """Vectors written as text and read again: their number of values."""
    k = load(spark, d, "keywords").select("keyword_id", V.parse_vector(V.vector_literal(F.col("embedding"))).alias("v"))
    return k.select("keyword_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("n"))


def q_type_histogram(spark, d):
    b = review_blocks(load(spark, d, "review_documents"))
    return b.groupBy("block_type").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


def q_median_height(spark, d):
    b = document_blocks(load(spark, d, "review_documents")).filter("bbox is not null")
    return b.groupBy("document_id", "page").agg(F.round(F.median(F.greatest(F.lit(1.0), F.col("bbox.y2") - F.col("bbox.y1"))), 4).alias("height"))


def q_markdown_grid(spark, d):
    return load(spark, d, "paper_tables").select("table_id", markdown_grid(F.col("table_text")).alias("markdown"))


def q_point_in_box(spark, d):
    """Detected boxes whose middle lies in a table block of the page."""
    r = review_blocks(load(spark, d, "review_documents"))
    t = r.filter("block_type = 'table' and bbox is not null").select("document_id", "page", F.col("block_id").alias("table_block"), F.col("bbox").alias("t"))
    x, y = (F.col("detected_bbox.x1") + F.col("detected_bbox.x2")) / 2, (F.col("detected_bbox.y1") + F.col("detected_bbox.y2")) / 2
    j = r.filter("detected_bbox is not null").join(t, ["document_id", "page"])
    return j.filter((x >= F.col("t.x1")) & (x <= F.col("t.x2")) & (y >= F.col("t.y1")) & (y <= F.col("t.y2"))).select("document_id", "table_block", "block_id")


def q_retained(spark, d):
    """Blocks that stay when those are dropped that lie within another of their class, but for rejected and added ones."""
    b = review_blocks(load(spark, d, "review_documents"))
    p = b.filter("bbox is not null")
    o = p.select("document_id", "page", "block_type", F.col("block_id").alias("other"), F.col("bbox").alias("o"))
    inner = p.join(o, ["document_id", "page", "block_type"]).filter((F.col("other") != F.col("block_id")) & (B.inside(F.col("bbox"), F.col("o")) >= 0.92) & (B.area(F.col("bbox")) < B.area(F.col("o"))) & (F.coalesce("review_status", F.lit("")) != "rejected") & F.col("detected_bbox").isNotNull())
    return b.join(inner.select("block_id").distinct(), "block_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("retained"))


def q_default_doc(spark, d):
    r = load(spark, d, "review_documents")
    newest = r.groupBy("phase").agg(F.max_by(F.struct("document_id", "filename", "status"), F.struct("created_at", "document_id")).alias("x"))
    return newest.select("phase", F.format_string("%s (%s)", F.col("x.filename"), F.col("x.status")).alias("label"))


def q_author_order(spark, d):
    from .layout import per_page

    b = document_blocks(load(spark, d, "review_documents")).filter("block_type in ('author', 'title')")
    return per_page(b, visual_rows).select("document_id", "page", "position", "block_id")


def q_simple_layout(spark, d):
    """Lines of the blocks as a text layer, longer boxes as larger type."""
    b = document_blocks(load(spark, d, "review_documents")).filter("bbox is not null and page is not null")
    lines = b.select("document_id", "page", F.col("ordinal").alias("line"), "text", F.round(F.col("bbox.y2") - F.col("bbox.y1"), 2).alias("size"))
    return simple_layout(lines).select("document_id", "page", "line", "block_type")


def q_typed_items(spark, d):
    """Blocks as a parser's items."""
    b = document_blocks(load(spark, d, "review_documents"))
    t = F.col("block_type")
    label = F.when(t.isin("table_caption", "figure_caption"), "caption").when(t == "figure", "picture").when(t == "header_footer", "page_footer").when(t.isin("author", "abstract"), "paragraph").otherwise(t)
    return typed_items(b.select("document_id", F.col("ordinal").alias("item"), label.alias("label"), "text")).select("document_id", "item", "block_type")


QUERIES = {
    "cosine": q_cosine, "year_weight": q_year_weight, "year_proximity": q_year_proximity, "agg_keywords_per_paper": q_agg_keywords, "norm_ws": q_norm_ws,
    "clean_keywords": q_clean_keywords, "vector_literal": q_vector_literal, "type_histogram": q_type_histogram, "median_line_height": q_median_height, "markdown_grid": q_markdown_grid, "point_in_box_join": q_point_in_box,
    "retained_difference": q_retained, "default_doc": q_default_doc, "author_visual_order": q_author_order,
    "layout_simple": q_simple_layout, "layout_docling": q_typed_items,
}

_REF = r"'(?i)^\s*(references|appendix|참고문헌|부록)\b'"
_ABS = r"'(?i)^\s*(abstract|초록|요약)\b'"
_C = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_B = "b as (select document_id, x.i as ordinal, x.b.block_id as block_id, x.b.page as page, x.b.block_type as block_type, x.b.bbox as bbox, x.b.detected_bbox as dbox, x.b.review_status as review_status, coalesce(x.b.corrected_text, x.b.ocr_text) as text from (select document_id, unnest(blocks) as b, unnest(range(len(blocks))) as i from review_documents) x)"
_AREA = "(greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1))"
_INT = "(greatest(0, least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1)) * greatest(0, least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1)))"
_DOT = "list_dot_product({}::double[], {}::double[])"
SQL = {
    "markdown_grid": f"""with {_GRID}, w as (select table_id, max(len(cells)) as w from g group by 1), m as (select table_id, row, w, '| ' || array_to_string(list_concat(cells, list_transform(range(w - len(cells)), lambda x: '')), ' | ') || ' |' as line from g join w using (table_id)),
j as (select table_id, string_agg(case when row = 0 then line || chr(10) || '|' || repeat(' --- |', w) else line end, chr(10) order by row) as markdown from m group by 1) select table_id, markdown from paper_tables left join j using (table_id)""",
    "layout_docling": rf"""with {_B}, i as (select document_id, ordinal as item, trim(coalesce(text, '')) as text, case when block_type in ('table_caption', 'figure_caption') then 'caption' when block_type = 'figure' then 'picture' when block_type = 'header_footer' then 'page_footer' when block_type in ('author', 'abstract') then 'paragraph' else block_type end as label from b where block_type <> ''),
j as (select *, label = 'reference' or (label = 'section_header' and regexp_matches(text, {_REF})) or (label in ('text', 'paragraph', 'list_item') and regexp_matches(string_split(text, chr(10))[1], {_REF})) as opens, case when label = 'section_header' then regexp_matches(text, {_ABS}) end as abs from i),
k as (select *, max(opens) over u as refs, coalesce(last_value(abs ignore nulls) over u, false) as inabs, coalesce(lag(label) over w = 'table', false) or coalesce(lead(label) over w = 'table', false) as near, row_number() over (partition by document_id, label order by item) = 1 as first
  from j window w as (partition by document_id order by item), u as (partition by document_id order by item rows between unbounded preceding and current row))
select document_id, item, case label when 'table' then 'table' when 'picture' then 'figure' when 'title' then case when first then 'title' else 'text' end when 'section_header' then 'section_header' when 'caption' then case when near then 'table_caption' else 'figure_caption' end
  when 'formula' then 'formula' when 'reference' then 'reference' when 'page_footer' then 'header_footer' when 'footnote' then 'header_footer' else case when label not in ('text', 'paragraph', 'list_item') then 'text' when refs then 'reference' when inabs then 'abstract' else 'text' end end as block_type from k""",
    "cosine": f"with v as (select keyword_id, embedding as a, lead(embedding) over (partition by keyword_id // 16 order by keyword_id) as b from keywords) select keyword_id, round(case when a is null or b is null or len(a) = 0 or len(a) <> len(b) or len(list_filter(a, lambda x: x <> 0)) = 0 or len(list_filter(b, lambda x: x <> 0)) = 0 then 0.0 else {_DOT.format('a', 'b')} / sqrt({_DOT.format('a', 'a')} * {_DOT.format('b', 'b')}) end, 5) as cosine from v",
    "year_weight": "select paper_id, round(coalesce(greatest(0.0, least(1.0, 1 - greatest(0, 2024 - published_year) / 10.0)), 0)::double, 6) as weight from papers",
    "year_proximity": "with p as (select paper_id, published_year as a, lag(published_year) over (partition by journal order by paper_id) as b from papers) select paper_id, round(case when a is null or b is null then 0.0 else greatest(0.0, 1 - abs(a - b) / 10.0) end::double, 6) as proximity from p",
    "agg_keywords_per_paper": "select paper_id, string_agg(display_form, '|' order by display_form) as keywords, count(*) as n from (select distinct paper_id, keyword_id from paper_keywords) join keywords using (keyword_id) group by 1",
    "norm_ws": f"select paragraph_id, md5({_C.format('original_text')}) as h from paragraphs",
    "clean_keywords": "select summary_id, len(list_distinct(list_filter(list_transform(coalesce(keywords, []), lambda x: trim(x)), lambda x: x is not null and x <> '')))::int as n from paper_summaries",
    "vector_literal": "select keyword_id, len(embedding)::int as n from keywords",
    "type_histogram": f"with {_B} select block_type, count(*) as n, count(distinct document_id) as documents from b group by 1",
    "median_line_height": f"with {_B} select document_id, page, round(median(greatest(1.0, bbox.y2 - bbox.y1)), 4) as height from b where bbox is not null group by 1, 2",
    "point_in_box_join": f"with {_B} select r.document_id, t.block_id as table_block, r.block_id from b r join b t on t.block_type = 'table' and t.document_id = r.document_id and t.page = r.page where t.bbox is not null and r.dbox is not null and (r.dbox.x1 + r.dbox.x2) / 2 between t.bbox.x1 and t.bbox.x2 and (r.dbox.y1 + r.dbox.y2) / 2 between t.bbox.y1 and t.bbox.y2",
    "retained_difference": f"with {_B}, i as (select distinct x.block_id from b x join b y on x.document_id = y.document_id and x.page = y.page and x.block_type = y.block_type and x.block_id <> y.block_id where x.bbox is not null and y.bbox is not null and x.dbox is not null and coalesce(x.review_status, '') <> 'rejected' and {_AREA.format('x.bbox')} < {_AREA.format('y.bbox')} and case when {_AREA.format('x.bbox')} > 0 then {_INT.format('x.bbox', 'y.bbox')} / {_AREA.format('x.bbox')} else 0 end >= 0.92) select document_id, count(*) as retained from b where block_id not in (select block_id from i) group by 1",
    "default_doc": "select phase, arg_max(filename || ' (' || status || ')', (created_at, document_id)) as label from review_documents group by 1",
    "layout_simple": rf"""with {_B}, l as (select document_id, page, ordinal as line, trim(text) as text, round(bbox.y2 - bbox.y1, 2) as size from b where bbox is not null and page is not null and trim(text) <> ''),
m as (select *, max(regexp_matches(text, {_REF})) over (partition by document_id order by page, line rows between unbounded preceding and current row) as refs from l),
t as (select document_id, arg_min(text, (-size, line)) as best from l where page = 1 group by 1), f as (select document_id, min(line) as line from m join t using (document_id) where page = 1 and not refs and text = best group by 1)
select m.document_id, page, m.line, case when page = 1 and f.line = m.line then 'title' when refs then 'reference' else 'text' end as block_type from m left join f on f.document_id = m.document_id""",
}
