"""Views of documents under review: progress, scopes, dashboards, recognised text put in, evaluation sheets, reports."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import DEFAULTS
from marginalia.functions import boxes as B
from marginalia.functions import text as T
from marginalia.sources import workbook as W
from marginalia.storage import load

from .evaluation import doc_profiles, quality_notes, review_blocks, summary_warning

# Phases as they are shown, scopes of the dashboard, sheets of the evaluation and their heads.
PHASES = {"layout_review": "레이아웃", "ocr_review": "OCR 예외", "ready_to_ingest": "OCR 완료"}
SCOPES = ("pending", "layout", "ocr_exception", "completed", "all")
EVALUATION = {
    "논문요약": ["문서 ID", "논문 ID", "파일명", "DB 제목", "저자", "페이지", "레이아웃 블록", "영역 유형별 개수", "검수 교정 블록", "평균 신뢰도", "초록 원문", "초록 요약", "대표 키워드", "본문 단락", "관련 단락", "요약 경고 단락", "표", "브라우저 검수 URL", "자동 점검 메모"],
    "레이아웃_OCR": ["문서 ID", "파일명", "페이지", "순서", "블록 ID", "자동 인식 유형", "현재 유형", "검수 상태", "자동 bbox", "현재 bbox", "신뢰도", "OCR 엔진", "원시 OCR", "교정 OCR", "적재 사용 텍스트"],
    "단락_요약": ["논문 ID", "제목", "단락 ID", "섹션", "단락 순서", "원문", "정제 본문", "LLM 요약", "단락 키워드", "본문 관련 여부", "요약 자동 경고"],
    "대표키워드": ["논문 ID", "제목", "정규화 키워드", "표시 키워드", "누적 빈도", "논문 점수"],
    "표_추출": ["논문 ID", "제목", "표 ID", "표 제목", "표 OCR", "표 요약"],
}


def _count(condition: str) -> Column:
    return F.expr(f"size(filter(coalesce(blocks, array()), b -> coalesce({condition}, false)))")


#: A block that differs from its detection: added by hand, of another class or place, or with another text.
CHANGED = "b.detected_bbox is null or b.detected_block_type <> b.block_type or (b.bbox is not null and b.bbox <> b.detected_bbox) or (b.corrected_text is not null and not b.corrected_text <=> b.ocr_text)"


def with_progress(reviews: DataFrame) -> DataFrame:
    """Review documents with counts of their blocks by state, of those that differ from the detection and of those with text; no shuffle."""
    out = reviews
    for state in ("unreviewed", "approved", "corrected", "rejected"):
        out = out.withColumn(state, _count(f"b.review_status = '{state}'"))
    return out.withColumn("changed", _count(CHANGED)).withColumn("read", _count("trim(b.ocr_text) <> ''"))


def in_scope(scope: str) -> Column:
    """Whether a document with its progress belongs to a scope; an unknown scope is "all"."""
    open_ = (F.coalesce("status", F.lit("")) != "ingested") & (F.col("unreviewed") > 0)
    return {"pending": open_, "completed": ~open_, "layout": F.coalesce(F.col("phase") == "layout_review", F.lit(False)), "ocr_exception": F.coalesce(F.col("phase") == "ocr_review", F.lit(False))}.get(scope, F.lit(True))


def review_scope(reviews: DataFrame, scope: str) -> DataFrame:
    """The documents of a scope; all of them if it has none."""
    p = with_progress(reviews)
    some = p.filter(in_scope(scope))
    return p if some.isEmpty() else some


def dashboard(reviews: DataFrame) -> DataFrame:
    """One row: documents, changed blocks, and the documents of each scope."""
    p = with_progress(reviews)
    return p.agg(F.count("*").alias("documents"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"), *[F.count_if(in_scope(s)).alias(s) for s in SCOPES])


def doc_label() -> Column:
    """The line that names a document with its progress."""
    phase = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), F.col("phase")), F.col("phase"))
    size = lambda c: F.size(F.coalesce(c, F.array())).cast("string")
    return F.concat(F.col("filename"), F.lit(" · "), phase, F.lit(" · "), size("pages"), F.lit("쪽 · "), size("blocks"), F.lit("영역 · OCR "), F.col("read").cast("string"), F.lit(" · 미검수 "), F.col("unreviewed").cast("string"))


def layout_metrics(q: DataFrame) -> DataFrame:
    """Metrics of a layout as they are shown: q(document_id, detected, initial, final, uncovered), shares of lines covered.

    The final share is at least the initial one; the uncovered lines are derived where they
    are missing, or 0 although not all are covered.
    """
    detected, initial = F.coalesce("detected", F.lit(0)), F.coalesce("initial", F.lit(0.0))
    q = q.withColumn("detected", detected).withColumn("initial", initial).withColumn("final", F.greatest(F.col("initial"), F.coalesce("final", "initial")))
    derived = F.greatest(F.lit(0), F.col("detected") - F.bround(F.col("detected") * F.col("final")).cast("int"))
    wrong = F.col("uncovered").isNull() | ((F.col("final") < 1) & (F.col("uncovered") == 0))
    return q.withColumn("uncovered", F.when(wrong, derived).otherwise(F.col("uncovered")))


def join_recognised(blocks: DataFrame, read: DataFrame) -> DataFrame:
    """Review blocks with what was read(document_id, block_order, text, engine) put in: text and engine replaced, the correction dropped, unreviewed again.

    Blocks that nothing was read for and rejected ones stay as they are.
    """
    new = read.select("document_id", "block_order", F.col("text").alias("_text"), F.col("engine").alias("_engine"), F.lit(True).alias("_hit"))
    j = blocks.join(new, ["document_id", "block_order"], "left")
    hit = F.col("_hit") & (F.coalesce("review_status", F.lit("")) != "rejected")
    put = {"ocr_text": F.col("_text"), "ocr_engine": F.col("_engine"), "corrected_text": F.lit(None).cast("string"), "review_status": F.lit("unreviewed")}
    hit = F.coalesce(hit, F.lit(False))
    return j.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()}).drop("_text", "_engine", "_hit")


def evaluation_sheets(spark, d: str, documents: DataFrame, viewer: str = "") -> dict[str, DataFrame]:
    """The five sheets of an evaluation of documents(review documents with a stored paper), by name; rows in the order of their keys."""
    t = lambda name: load(spark, d, name)
    papers = t("papers").join(documents.select("paper_id").distinct(), "paper_id", "left_semi")
    title = papers.select("paper_id", F.col("title").alias("paper_title"))
    cell = lambda c: T.cell_text(F.col(c), DEFAULTS.cell_limit).alias(c)
    links = t("paper_keywords").groupBy("paper_id", "keyword_id").agg(F.max("score").alias("score")).join(t("keywords").select("keyword_id", "keyword", "display_form", "frequency"), "keyword_id").join(title, "paper_id")
    listed = links.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "display_form", "keyword_id"))), lambda x: x["display_form"]), ", ").alias("keywords"))
    profile = doc_profiles(documents, t("paragraphs"), t("paper_tables")).join(quality_notes(documents, papers), "document_id")
    overview = documents.select("document_id", "paper_id", "filename").join(papers.select("paper_id", "title", "authors", "abstract", "abstract_summary"), "paper_id").join(profile.drop("paper_id"), "document_id").join(listed, "paper_id", "left")
    overview = overview.withColumn("url", F.concat(F.lit(viewer.rstrip("/") + "/documents/"), "document_id", F.lit("/viewer")))
    overview = overview.select("document_id", "paper_id", "filename", "title", "authors", "pages", "blocks", "kinds", "corrected", "confidence", cell("abstract"), cell("abstract_summary"), "keywords", "paragraphs", "relevant", "warned", "tables", "url", "note")
    b = review_blocks(documents).join(documents.select("document_id", "filename"), "document_id")
    kind = F.coalesce("detected_block_type", "block_type").alias("detected")
    layout = b.orderBy("document_id", "block_order", "ordinal").select("document_id", "filename", "page", "block_order", "block_id", kind, "block_type", "review_status", B.text(F.coalesce("detected_bbox", "bbox")).alias("detected_at"), B.text(F.col("bbox")).alias("at"), "confidence", "ocr_engine", cell("ocr_text"), cell("corrected_text"), T.cell_text(F.coalesce("corrected_text", "ocr_text"), DEFAULTS.cell_limit).alias("used"))
    p = t("paragraphs").join(title, "paper_id").orderBy("paper_id", "paragraph_order", "paragraph_id")
    paragraphs = p.select("paper_id", "paper_title", "paragraph_id", "section_name", "paragraph_order", cell("original_text"), cell("cleaned_text"), cell("summary"), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", ").alias("keywords"), "is_topic_relevant", summary_warning(F.col("summary")).alias("warning"))
    tables = t("paper_tables").join(title, "paper_id").orderBy("paper_id", "table_id").select("paper_id", "paper_title", "table_id", "table_title", cell("table_text"), cell("table_summary"))
    keywords = links.orderBy("paper_id", F.desc("score"), "display_form").select("paper_id", "paper_title", "keyword", "display_form", "frequency", "score")
    return dict(zip(EVALUATION, (overview.orderBy("document_id"), layout, paragraphs, keywords, tables)))


def write_evaluation(sheets: dict[str, DataFrame], path: str) -> list[str]:
    """The evaluation as a workbook; corrected blocks and warned summaries stand out."""
    style = {"레이아웃_OCR": lambda r: W.MARKED if r[7] == "corrected" else W.PLAIN, "단락_요약": lambda r: W.WARNED if r[10] else W.PLAIN}
    made = [W.Sheet(name, EVALUATION[name], ((style.get(name, lambda r: W.PLAIN)(r), list(r)) for r in W.rows_of(df))) for name, df in sheets.items()]
    return W.write_workbook(made, path)


def batch_report(runs: DataFrame) -> DataFrame:
    """(position, line): runs(source, paper_id, paragraphs, keywords, tables, relations, error) as a table of fixed width, the head and a rule first.

    The widths are an aggregate over all runs, so the lines are made without gathering them.
    """
    names = ["source", "paper_id", "paragraphs", "keywords", "tables", "relations", "status"]
    status = F.when(F.col("error").isNull(), "done").when(F.col("paper_id").isNull(), F.concat(F.lit("failed: "), "error")).otherwise("failed")
    rows = runs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("" if c in ("source", "paper_id") else "0")).alias(c) for c in names[:-1]], status.alias("status"))
    width = rows.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(f"_{c}") for c in names])
    wide = F.broadcast(width)  # one row
    line = F.concat_ws(" | ", *[F.rpad(c, F.greatest(F.col(f"_{c}"), F.length(c)), F.lit(" ")) for c in names])
    body = rows.join(wide).select(F.lit(2).alias("position"), "source", line.alias("line"))
    head = width.select(F.lit(0).alias("position"), F.lit("").alias("source"), F.concat_ws(" | ", *[F.rpad(F.lit(c), F.col(f"_{c}"), F.lit(" ")) for c in names]).alias("line"))
    rule = width.select(F.lit(1).alias("position"), F.lit("").alias("source"), F.concat_ws("-+-", *[F.expr(f"repeat('-', _{c})") for c in names]).alias("line"))
    return head.unionByName(rule).unionByName(body).orderBy("position", "source", "line").select("position", "line")


def stage_report(log: DataFrame) -> DataFrame:
    """(stage, line): a line of a Markdown table per stage that was done or failed."""
    g = log.filter("status in ('done', 'failed')").groupBy("stage").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    return g.select("stage", F.format_string("| %s | %d | %d |", "stage", "done", "failed").alias("line"))


def append_report(runs: DataFrame, log: DataFrame, folder: str, day: str, at: str) -> str:
    """Append a batch to the day's Markdown report: counts, stages done and failed, and what failed why; returns the path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{day}.md")
    n, failed = runs.agg(F.count_if(F.col("error").isNull() | F.col("paper_id").isNotNull()), F.count_if(F.col("error").isNotNull() & F.col("paper_id").isNull())).first()
    bad = runs.filter("error is not null and paper_id is null").orderBy("source").select(F.format_string("| `%s` | %s |", "source", F.translate("error", "|", "/")).alias("line"))
    with open(path, "a", encoding="utf-8") as f:
        f.write(("\n" if f.tell() else "") + f"## {at} 배치\n\n- 처리 건수: {n}\n- 실패 건수: {failed}\n\n| 단계 | 성공 | 실패 |\n| --- | ---: | ---: |\n")
        f.writelines(r.line + "\n" for r in stage_report(log).orderBy("stage").toLocalIterator())
        if failed:
            f.write("\n| 파일 | 실패 원인 |\n| --- | --- |\n")
            f.writelines(r.line + "\n" for r in bad.toLocalIterator())
    return path


# Queries --------------------------------------------------------------------------------------------------


def q_review_scope(spark, d):
    """Every document with each scope that it belongs to."""
    p = with_progress(load(spark, d, "review_documents"))
    scopes = F.filter(F.array(*[F.when(in_scope(s), s) for s in SCOPES]), lambda x: x.isNotNull())
    return p.select("document_id", F.explode(scopes).alias("scope"))


def q_dashboard(spark, d):
    return dashboard(load(spark, d, "review_documents"))


def q_doc_label(spark, d):
    return with_progress(load(spark, d, "review_documents")).select("document_id", doc_label().alias("label"))


def q_layout_metrics(spark, d):
    """Shares of blocks with text, and of those with any correction beside them, as coverage before and after."""
    p = with_progress(load(spark, d, "review_documents")).withColumn("n", F.size("blocks"))
    m = layout_metrics(p.select("document_id", F.col("n").alias("detected"), F.round(F.try_divide("read", "n"), 4).alias("initial"), F.round(F.try_divide(F.col("n") - F.col("unreviewed"), F.col("n")), 4).alias("final"), F.when(F.col("unreviewed") > 1, F.lit(0)).alias("uncovered")))
    return m.select("document_id", "detected", "initial", "final", "uncovered")


def q_join_recognised(spark, d):
    """Blocks of every document read again: with a mark, where the first reading was sure."""
    b = review_blocks(load(spark, d, "review_documents"))
    read = b.filter("confidence >= 0.8").groupBy("document_id", "block_order").agg(F.concat(F.lit("again: "), F.min("ocr_text")).alias("text")).withColumn("engine", F.lit("again"))
    return join_recognised(b, read).select("document_id", "block_id", "ocr_text", "ocr_engine", "corrected_text", "review_status")


def q_batch_report(spark, d):
    """Every paper as a run, with what came of it; a paper without a title failed."""
    out = load(spark, d, "papers").select("paper_id", F.col("source_file_path").alias("source"), F.when(F.col("abstract").isNull(), "no abstract").alias("error"))
    for table, name in (("paragraphs", "paragraphs"), ("paper_keywords", "keywords"), ("paper_tables", "tables")):
        out = out.join(load(spark, d, table).groupBy("paper_id").agg(F.count("*").alias(name)), "paper_id", "left")
    return batch_report(out.withColumn("relations", F.lit(0)))


def q_stage_report(spark, d):
    e = load(spark, d, "events").select(F.col("event_type").alias("stage"), F.when(F.col("value") < 0.1, "failed").when(F.col("value") < 0.9, "done").otherwise("running").alias("status"))
    return stage_report(e)


def q_eval_layout(spark, d):
    """The layout sheet of an evaluation of all documents with a stored paper."""
    docs = load(spark, d, "review_documents").filter("paper_id is not null")
    s = evaluation_sheets(spark, d, docs)["레이아웃_OCR"]
    return s.select("block_id", "detected", "detected_at", "at", "used")


def q_eval_overview(spark, d):
    """The overview of an evaluation of all documents with a stored paper."""
    docs = load(spark, d, "review_documents").filter("paper_id is not null")
    s = evaluation_sheets(spark, d, docs, "http://review")["논문요약"]
    return s.select("document_id", "title", "blocks", "keywords", "paragraphs", "url", "note")


QUERIES = {
    "review_scope": q_review_scope, "review_dashboard": q_dashboard, "doc_label": q_doc_label, "layout_metrics_view": q_layout_metrics, "join_recognised": q_join_recognised, "batch_report": q_batch_report,
    "stage_report": q_stage_report, "eval_workbook_layout": q_eval_layout, "eval_workbook_overview": q_eval_overview,
}

_X = "x as (select document_id, status, phase, filename, pages, unnest(blocks) as b from review_documents)"
_P = f"""{_X}, n as (select document_id, count(*) as n, count_if(b.review_status = 'unreviewed') as unreviewed, count_if(trim(b.ocr_text) <> '') as read,
  count_if(b.detected_bbox is null or coalesce(b.detected_block_type <> b.block_type, false) or coalesce(b.bbox <> b.detected_bbox, false) or (b.corrected_text is not null and b.corrected_text is distinct from b.ocr_text)) as changed from x group by 1),
p as (select r.*, coalesce(n, 0) as n, coalesce(unreviewed, 0) as unreviewed, coalesce(read, 0) as read, coalesce(changed, 0) as changed, coalesce(status, '') <> 'ingested' and coalesce(unreviewed, 0) > 0 as open_ from review_documents r left join n using (document_id))"""
SQL = {
    "review_scope": f"with {_P}, s as (select document_id, unnest([case when open_ then 'pending' else 'completed' end, case when phase = 'layout_review' then 'layout' when phase = 'ocr_review' then 'ocr_exception' end, 'all']) as scope from p) select * from s where scope is not null",
    "review_dashboard": f"with {_P} select count(*) as documents, sum(changed)::bigint as changed, count_if(open_) as pending, count_if(phase = 'layout_review') as layout, count_if(phase = 'ocr_review') as ocr_exception, count_if(not open_) as completed, count(*) as all from p",
    "doc_label": f"with {_P} select document_id, filename || ' · ' || case phase when 'layout_review' then '레이아웃' when 'ocr_review' then 'OCR 예외' when 'ready_to_ingest' then 'OCR 완료' else phase end || ' · ' || len(pages) || '쪽 · ' || n || '영역 · OCR ' || read || ' · 미검수 ' || unreviewed as label from p",
    "layout_metrics_view": f"""with {_P}, m as (select document_id, len(blocks) as detected, round(case when n > 0 then read::double / n end, 4) as i, round(case when n > 0 then (n - unreviewed)::double / n end, 4) as f, case when unreviewed > 1 then 0 end as u from p),
k as (select document_id, coalesce(detected, 0)::int as detected, coalesce(i, 0) as initial, greatest(coalesce(i, 0), coalesce(f, i, 0)) as final, u from m)
select document_id, detected, initial, final, (case when u is null or (final < 1 and u = 0) then greatest(0, detected - round_even(detected * final, 0)::int) else u end)::int as uncovered from k""",
    "join_recognised": "with x as (select document_id, unnest(blocks) as b from review_documents), r as (select document_id, b.block_order as o, 'again: ' || min(b.ocr_text) as t from x where b.confidence >= 0.8 group by 1, 2) select x.document_id, b.block_id as block_id, case when ok then r.t else b.ocr_text end as ocr_text, case when ok then 'again' else b.ocr_engine end as ocr_engine, case when ok then null else b.corrected_text end as corrected_text, case when ok then 'unreviewed' else b.review_status end as review_status from (select x.*, r.o, r.t, r.o is not null and coalesce(b.review_status, '') <> 'rejected' as ok from x left join r on r.document_id = x.document_id and r.o = x.b.block_order) x, lateral (select x.t) as r(t)",
    "stage_report": "with e as (select event_type as stage, count_if(value >= 0.1 and value < 0.9) as done, count_if(value < 0.1) as failed from events where value < 0.9 group by 1) select stage, '| ' || stage || ' | ' || done || ' | ' || failed || ' |' as line from e",
    "batch_report": """with r as (select coalesce(source_file_path, '') as source, p.paper_id::varchar as paper_id, coalesce((select count(*) from paragraphs x where x.paper_id = p.paper_id), 0)::varchar as paragraphs, coalesce((select count(*) from paper_keywords x where x.paper_id = p.paper_id), 0)::varchar as keywords, coalesce((select count(*) from paper_tables x where x.paper_id = p.paper_id), 0)::varchar as tables, '0' as relations, case when abstract is null then 'failed' else 'done' end as status from papers p),
w as (select greatest(6, max(length(source))) as a, greatest(8, max(length(paper_id))) as b, greatest(10, max(length(paragraphs))) as c, greatest(8, max(length(keywords))) as d, greatest(6, max(length(tables))) as e, 9 as f, greatest(6, max(length(status))) as g from r)
select 0 as position, concat_ws(' | ', rpad('source', a::int, ' '), rpad('paper_id', b::int, ' '), rpad('paragraphs', c::int, ' '), rpad('keywords', d::int, ' '), rpad('tables', e::int, ' '), rpad('relations', f::int, ' '), rpad('status', g::int, ' ')) as line from w
union all select 1, concat_ws('-+-', repeat('-', a::int), repeat('-', b::int), repeat('-', c::int), repeat('-', d::int), repeat('-', e::int), repeat('-', f::int), repeat('-', g::int)) from w
union all select 2, concat_ws(' | ', rpad(source, a::int, ' '), rpad(paper_id, b::int, ' '), rpad(paragraphs, c::int, ' '), rpad(keywords, d::int, ' '), rpad(tables, e::int, ' '), rpad(relations, f::int, ' '), rpad(status, g::int, ' ')) from r, w""",
    "eval_workbook_layout": "with b as (select unnest(blocks) as b from review_documents where paper_id is not null), t as (select b, coalesce(b.detected_bbox, b.bbox) as x, b.bbox as y from b) select b.block_id as block_id, coalesce(b.detected_block_type, b.block_type) as detected, case when x is null then '' else printf('%.2f, %.2f, %.2f, %.2f', x.x1, x.y1, x.x2, x.y2) end as detected_at, case when y is null then '' else printf('%.2f, %.2f, %.2f, %.2f', y.x1, y.y1, y.x2, y.y2) end as at, coalesce(b.corrected_text, b.ocr_text, '') as used from t",
    "eval_workbook_overview": """with d as (select * from review_documents where paper_id is not null), x as (select document_id, unnest(blocks) as b from d), n as (select document_id, count(*) as blocks, list(distinct coalesce(b.detected_block_type, b.block_type)) as k, count_if(b.review_status = 'corrected') as c from x group by 1),
l as (select paper_id, keyword_id, max(score) as score from paper_keywords group by 1, 2), j as (select paper_id, string_agg(display_form, ', ' order by coalesce(score, 0) desc, display_form, keyword_id) as keywords from l join keywords using (keyword_id) group by 1),
q as (select d.document_id, concat_ws('; ', case when not list_contains(k, 'title') then '자동 제목 영역 누락' end, case when not list_contains(k, 'abstract') or trim(coalesce(abstract, '')) = '' then '초록 영역/텍스트 누락' end, case when c > 0 then c || '개 블록 검수 교정' end) as note, title, keywords, n.blocks as blocks, d.paper_id from d join papers p on p.paper_id = d.paper_id join n using (document_id) left join j on j.paper_id = d.paper_id)
select document_id, title, blocks, keywords, (select count(*) from paragraphs x where x.paper_id = q.paper_id) as paragraphs, 'http://review/documents/' || document_id || '/viewer' as url, case when note = '' then '치명적 메타데이터 누락 없음; OCR 철자·도형 내부 텍스트는 개별 확인 필요' else note end as note from q""",
}
