"""Reports: sheets of a result workbook, logs by stage, collection and readiness counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import DEFAULTS
from marginalia.functions import text as T
from marginalia.storage import load

from .layout import _GRID, grid_rows


#: Fixed value: the name of the N-th column without a head.
UNNAMED = "열"


def headers(cells, width=None):
    """Column heads without blanks and repeats, ``width`` of them: blanks and missing ones are named by their place, a repeat gets _k."""
    width = F.size(cells) if width is None else width
    filled = F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.nullif(T.strip(F.get(cells, i - 1)), F.lit("")), F.concat(F.lit(UNNAMED), i.cast("string"))))
    count = lambda i: F.size(F.filter(F.slice(filled, F.lit(1), i + 1), lambda y: y == F.element_at(filled, i + 1)))
    return F.transform(filled, lambda x, i: F.when(count(i) > 1, F.concat(x, F.lit("_"), count(i).cast("string"))).otherwise(x))


def stage_counts(log: DataFrame, stages: list[str], states: list[str]) -> DataFrame:
    """(stage, one column of counts per state) of log(stage, status)."""
    return log.filter(F.col("stage").isin(*stages)).groupBy("stage").pivot("status", states).agg(F.count(F.lit(1))).fillna(0)


# Queries --------------------------------------------------------------------------------------------------


def q_sheet_papers(spark, d):
    """The sheet of papers: cells cut to what a workbook holds."""
    p = load(spark, d, "papers")
    return p.select("paper_id", *[T.cell_text(F.col(c), DEFAULTS.cell_limit).alias(c) for c in ("title", "authors", "journal", "abstract", "abstract_summary")])


def q_sheet_tables(spark, d):
    t = load(spark, d, "paper_tables").select("table_id", grid_rows(F.col("table_text")).alias("g")).filter("size(g) > 0")
    width = F.array_max(F.transform("g", lambda r: F.size(r)))
    return t.select("table_id", F.array_join(headers(F.element_at("g", 1), width), " | ").alias("headers"))


def q_sheet_keywords(spark, d):
    """Papers and highest score of each keyword."""
    k = load(spark, d, "keywords").select("keyword_id", "display_form", "frequency")
    link = load(spark, d, "paper_keywords").distinct().groupBy("keyword_id").agg(F.count_distinct("paper_id").alias("papers"), F.max("score").alias("top_score"))
    return k.join(link, "keyword_id", "left").fillna(0, ["papers"])


def q_stage_counts(spark, d):
    e = load(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("stage"), F.col("event_type").alias("status"))
    return e.groupBy("stage").pivot("status", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).fillna(0)


def q_report_totals(spark, d):
    """Rows, papers and share of relevant paragraphs by section."""
    p = load(spark, d, "paragraphs").withColumn("s", F.coalesce(F.nullif(T.strip(F.col("section_name")), F.lit("")), F.lit(DEFAULTS.default_section)))
    return p.groupBy(F.col("s").alias("section")).agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"), F.round(F.avg(F.coalesce(F.col("is_topic_relevant"), F.lit(False)).cast("int")), 5).alias("relevant"))


def q_collect_report(spark, d):
    """Papers by whether they have a link, an abstract and a year."""
    p = load(spark, d, "papers")
    has = lambda c: F.coalesce(T.strip(F.col(c)) != "", F.lit(False))
    return p.groupBy(has("full_text_link").alias("has_link"), has("abstract").alias("has_abstract"), F.col("published_year").isNotNull().alias("has_year")).agg(F.count("*").alias("n"))


CALLS = "created_at timestamp, operation string, model string, prompt string, response string, success boolean, error string, latency_ms double, cache_hit boolean, prompt_tokens long, completion_tokens long, context string"


def record_calls(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log of model calls with new ones appended: columns by name, missing ones null, a missing success or cache_hit false.

    Rows that don't fit (a text where a number belongs) get nulls; nothing raises, as a log must not stop the work.
    """
    kinds = [c.strip().split(" ") for c in CALLS.split(",")]
    row = new.select(*[F.col(c).try_cast(k).alias(c) if c in new.columns else F.lit(None).cast(k).alias(c) for c, k in kinds])
    row = row.fillna(False, ["success", "cache_hit"])
    return log.select(*[c for c, _ in kinds]).unionByName(row)


def list_calls(log: DataFrame, operation: str | None = None, success: bool | None = None, limit: int = 200) -> DataFrame:
    """The newest calls, of one operation and outcome if asked; ties by operation and prompt."""
    if operation:
        log = log.filter(F.col("operation") == operation)
    if success is not None:
        log = log.filter(F.col("success") == success)
    return log.orderBy(F.desc("created_at"), "operation", "prompt").limit(limit)


def _calls(spark, d):
    """Events as a log of calls."""
    e = load(spark, d, "events")
    new = e.select(F.col("ts").alias("created_at"), F.col("event_type").alias("operation"), F.col("event_id").cast("string").alias("prompt"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").alias("prompt_tokens"))
    return record_calls(spark.createDataFrame([], CALLS), new)


def q_llm_calls(spark, d):
    """The newest 200 successful purchases of the log."""
    c = list_calls(_calls(spark, d), "purchase", True)
    return c.select("operation", "prompt", "success", F.round("latency_ms", 6).alias("latency_ms"), "cache_hit", "prompt_tokens")


def q_record_calls(spark, d):
    """The log after all events were appended, by operation."""
    c = _calls(spark, d)
    return c.groupBy("operation").agg(F.count("*").alias("calls"), F.count_if("success").alias("done"), F.sum("prompt_tokens").alias("tokens"), F.round(F.max("latency_ms"), 6).alias("longest"))


def q_newest_n(spark, d):
    """The ten newest failed calls: a report."""
    return load(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "user_id", "value")


def q_scan_review_docs(spark, d):
    r = load(spark, d, "review_documents")
    return r.select("document_id", "filename", "status", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("created_at"), "document_id")).alias("position"))


def q_review_of_paper(spark, d):
    """The newest review document of each paper with a result."""
    r = load(spark, d, "review_documents").filter("paper_id is not null")
    newest = r.groupBy("paper_id").agg(F.max_by("document_id", F.struct("created_at", "document_id")).alias("document_id"))
    return load(spark, d, "paper_summaries").select("paper_id").distinct().join(newest, "paper_id", "left")


def q_ocr_listing(spark, d):
    """Blocks with text, as the listing shows them."""
    b = load(spark, d, "review_documents").select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.*").filter(T.strip(F.col("ocr_text")) != "")
    return b.select("document_id", "block_id", "confidence", F.concat_ws(" · ", F.concat(F.lit("p"), F.col("page").cast("string")), "block_type", F.substring(T.collapse(F.col("ocr_text")), 1, 80)).alias("label"))


def q_result_id(spark, d):
    s = load(spark, d, "paper_summaries")
    return s.select("summary_id", T.result_id(F.col("generated_at"), F.col("summary_id")).alias("rid"))


def json_text(c):
    """A text as a JSON string; null is null."""
    return F.expr(f"substring(to_json(named_struct('x', {c})), 6, length(to_json(named_struct('x', {c}))) - 6)")


def cache_key(prompt: str, model: str, temperature: float, tokens: int, schema_hint: str, system_prompt: str):
    """SHA-256 of what a model call depends on, as JSON with sorted keys; ``prompt`` names a column."""
    fixed = [("max_output_tokens", tokens), ("model", model), ("prompt", None), ("schema_hint", schema_hint), ("system_prompt", system_prompt), ("temperature", temperature)]
    parts = []
    for i, (k, v) in enumerate(fixed):
        parts += [F.lit(("{" if i == 0 else ", ") + json.dumps(k) + ": "), json_text(prompt) if v is None else F.lit(json.dumps(v, ensure_ascii=False))]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def q_hash_cache_key(spark, d):
    """Equal inputs of a model call: one key per different text, with how often it would be asked."""
    p = load(spark, d, "paragraphs").filter("cleaned_text is not null")
    return p.groupBy(cache_key("cleaned_text", "none", 0.0, 512, "{}", "JSON only").alias("cache_key")).agg(F.count("*").alias("calls"))


def q_rollup_citations(spark, d):
    """Papers by journal and year with subtotals."""
    p = load(spark, d, "papers").filter("journal is not null and published_year is not null and trim(journal) <> ''")
    return p.cube("journal", "published_year").agg(F.count("*").alias("n"))


def q_star_revenue(spark, d):
    """Revenue by nation and year over the star schema: the relational core."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("revenue"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    return li.join(o, "l_orderkey").join(s, "l_suppkey").join(n, "n_nationkey").groupBy("n_name", "year").agg(F.sum("revenue").cast("double").alias("revenue"), F.count("*").alias("n"))


QUERIES = {
    "sheet_papers": q_sheet_papers, "sanitize_headers": q_sheet_tables, "sheet_keywords": q_sheet_keywords, "stage_counts": q_stage_counts, "report_totals": q_report_totals, "collect_report": q_collect_report,
    "scan_llm_calls": q_llm_calls, "record_llm_call": q_record_calls, "newest_n": q_newest_n, "scan_review_docs": q_scan_review_docs, "join_review_to_result": q_review_of_paper, "ocr_block_listing": q_ocr_listing, "result_id": q_result_id,
    "cache_key": q_hash_cache_key, "papers_cube": q_rollup_citations, "star_revenue": q_star_revenue,
}

_C = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
SQL = {
    "sheet_papers": "select paper_id, " + ", ".join(f"case when length(coalesce({c}, '')) > 32767 then substring({c}, 1, 32767 - 24) || chr(10) || '...[Excel 셀 길이 제한으로 잘림]' else coalesce({c}, '') end as {c}" for c in ("title", "authors", "journal", "abstract", "abstract_summary")) + " from papers",
    "sanitize_headers": f"""with {_GRID}, w as (select table_id, max(len(cells)) as w, arg_min(cells, row) as head from g group by 1),
c as (select table_id, i, coalesce(nullif(trim(head[i]), ''), '열' || i) as x from (select *, unnest(range(1, w + 1)) as i from w)), k as (select *, count(*) over (partition by table_id, x order by i) as k from c)
select table_id, string_agg(case when k > 1 then x || '_' || k else x end, ' | ' order by i) as headers from k group by 1""",
    "sheet_keywords": "with l as (select keyword_id, count(distinct paper_id) as papers, max(score) as top_score from (select distinct * from paper_keywords) group by 1) select keyword_id, display_form, frequency, coalesce(papers, 0) as papers, top_score from keywords left join l using (keyword_id)",
    "stage_counts": "select strftime(ts, '%Y-%m-%d') as stage, " + ", ".join(f"count_if(event_type = '{e}') as {e}" for e in ("click", "error", "purchase", "signup", "view")) + " from events group by 1",
    "report_totals": "select coalesce(nullif(trim(section_name), ''), '본문') as section, count(*) as n, count(distinct paper_id) as papers, round(avg(coalesce(is_topic_relevant, false)::int), 5) as relevant from paragraphs group by 1",
    "collect_report": "select coalesce(trim(full_text_link) <> '', false) as has_link, coalesce(trim(abstract) <> '', false) as has_abstract, published_year is not null as has_year, count(*) as n from papers group by 1, 2, 3",
    "scan_llm_calls": "select event_type as operation, event_id::varchar as prompt, true as success, round(value, 6) as latency_ms, false as cache_hit, json_extract_string(props, '$.k')::bigint as prompt_tokens from events where event_type = 'purchase' order by ts desc, event_id::varchar limit 200",
    "record_llm_call": "select event_type as operation, count(*) as calls, count_if(event_type <> 'error') as done, sum(json_extract_string(props, '$.k')::bigint)::bigint as tokens, round(max(value), 6) as longest from events group by 1",
    "newest_n": "select event_id, user_id, value from events where event_type = 'error' order by ts desc, event_id limit 10",
    "scan_review_docs": "select document_id, filename, status, row_number() over (partition by status order by created_at desc, document_id) as position from review_documents",
    "join_review_to_result": "with n as (select paper_id, arg_max(document_id, (created_at, document_id)) as document_id from review_documents where paper_id is not null group by 1) select paper_id, document_id from (select distinct paper_id from paper_summaries) left join n using (paper_id)",
    "ocr_block_listing": f"with b as (select document_id, unnest(blocks) as b from review_documents) select document_id, b.block_id as block_id, b.confidence as confidence, 'p' || b.page || ' · ' || b.block_type || ' · ' || substring({_C.format('b.ocr_text')}, 1, 80) as label from b where trim(b.ocr_text) <> ''",
    "result_id": "select summary_id, 'r-' || strftime(generated_at::timestamp, '%Y%m%d') || '-' || substring(sha256(summary_id::varchar), 1, 8) as rid from paper_summaries",
    "cache_key": """select sha256('{"max_output_tokens": 512, "model": "none", "prompt": ' || to_json(cleaned_text)::varchar || ', "schema_hint": "{}", "system_prompt": "JSON only", "temperature": 0.0}') as cache_key, count(*) as calls from paragraphs where cleaned_text is not null group by 1""",
    "papers_cube": "select journal, published_year, count(*) as n from papers where journal is not null and published_year is not null and trim(journal) <> '' group by cube (journal, published_year)",
    "star_revenue": "select n_name, year(o_orderdate)::int as year, sum((l_extendedprice * (1 - l_discount))::decimal(18, 4))::double as revenue, count(*) as n from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2",
}
