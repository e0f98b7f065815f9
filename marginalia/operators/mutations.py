"""Changes to stored tables as plans: inserts with new ids, keyed upserts, cascading deletes, caches and logs.

Parquet tables are not updated in place: each operator returns the table's next version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources.files import latest, upsert
from marginalia.storage import load

from .grouped import numbered

CHILDREN = ("paragraphs", "paper_tables", "paper_keywords", "paper_summaries")


def with_ids(new: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """``new`` with ids after ``start`` in ``order``; a task numbers a range of the rows only."""
    return numbered(new, [], order, name, start)


def save_papers(papers: DataFrame, new: DataFrame) -> DataFrame:
    """Papers with new rows appended under new ids; a blank title becomes "Untitled"."""
    top = papers.agg(F.coalesce(F.max("paper_id"), F.lit(0))).first()[0]
    n = new.withColumn("title", F.coalesce(F.nullif(T.strip(F.col("title")), F.lit("")), F.lit("Untitled")))
    return papers.unionByName(with_ids(n, ["source_file_path", "title"], top, "paper_id"), allowMissingColumns=True)


def save_children(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Paragraphs or tables of papers appended under new ids of ``key``, missing columns null; null keyword lists become empty."""
    if "keywords" in new.columns:
        new = new.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    top = old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return old.unionByName(with_ids(new, order, top, key), allowMissingColumns=True)


def update_papers(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """Papers with the columns of ``changes`` (paper_id and others, one row a paper) put in; papers without a change keep theirs.

    A column that papers lack is added.
    """
    names = [c for c in changes.columns if c != "paper_id"]
    new = changes.select("paper_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in names])
    out = papers.join(new, "paper_id", "left")
    for c in names:
        old = F.col(c) if c in papers.columns else F.lit(None)
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(old))
    return out.drop("_hit", *[f"_{c}" for c in names])


def delete_papers(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the papers in ``gone(paper_id)`` and what hangs on them; keyword frequencies stay."""
    return {k: t.join(gone.select("paper_id").distinct(), "paper_id", "left_anti") for k, t in tables.items()}


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with new scores put in; the last score of a pair wins, by ``seq``."""
    last = latest(new, ["paper_id", "keyword_id"], [F.desc("seq")]).drop("seq")
    return upsert(links.groupBy("paper_id", "keyword_id").agg(F.max("score").alias("score")), last, ["paper_id", "keyword_id"])


def replace_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Relations of every source that ``new`` has replaced as a whole; self relations dropped."""
    return upsert(old, new.filter("source_paper_id <> related_paper_id"), ["source_paper_id"])


# Queries --------------------------------------------------------------------------------------------------


def q_save_paper(spark, d):
    """Summaries' papers entered again: the count and the ids after the insert."""
    p = load(spark, d, "papers")
    new = load(spark, d, "paper_summaries").select(F.lit(" ").alias("title"), "authors", "published_year", F.concat(F.lit("/in/"), F.col("summary_id").cast("string")).alias("source_file_path"))
    out = save_papers(p.select("paper_id", "title", "authors", "published_year", "source_file_path"), new)
    return out.groupBy("title").agg(F.count("*").alias("n"), F.min("paper_id").alias("first_id"), F.max("paper_id").alias("last_id"), F.count_distinct("paper_id").alias("ids"))


def q_delete_paper(spark, d):
    """What is left of each child table when papers without a year are deleted."""
    gone = load(spark, d, "papers").filter("published_year is null").select("paper_id")
    out = None
    for k, t in delete_papers({k: load(spark, d, k).select("paper_id") for k in CHILDREN}, gone).items():
        one = t.groupBy().agg(F.lit(k).alias("table_name"), F.count("*").alias("left_rows"), F.count_distinct("paper_id").alias("papers"))
        out = one if out is None else out.unionByName(one)
    return out


def q_save_paragraphs(spark, d):
    """Summaries entered as paragraphs: counts and ids after the insert."""
    p = load(spark, d, "paragraphs").select("paragraph_id", "paper_id", "paragraph_order", "section_name", "original_text", "cleaned_text", "summary", "keywords", "is_topic_relevant")
    new = load(spark, d, "paper_summaries").select("paper_id", F.lit(1).alias("paragraph_order"), F.lit("new").alias("section_name"), F.coalesce("relevance_summary", F.lit("")).alias("original_text"), "keywords", F.lit(True).alias("is_topic_relevant"))
    out = save_children(p, new, "paragraph_id", ["paper_id", "original_text"])
    return out.groupBy("section_name").agg(F.count("*").alias("n"), F.min("paragraph_id").alias("first_id"), F.max("paragraph_id").alias("last_id"), F.count_distinct("paragraph_id").alias("ids"), F.count("keywords").alias("lists"))


def q_save_tables(spark, d):
    """Every table entered again without a summary."""
    t = load(spark, d, "paper_tables")
    out = save_children(t, t.select("paper_id", F.lit("again").alias("table_title"), "table_text"), "table_id", ["paper_id", "table_text"])
    return out.groupBy("table_title").agg(F.count("*").alias("n"), F.max("table_id").alias("last_id"), F.count_distinct("table_id").alias("ids"), F.count("table_summary").alias("summaries"))


def q_update_embedding(spark, d):
    """Papers that get the vector of their first paragraph with one as their own: its length and first value."""
    first = load(spark, d, "paragraphs").filter("size(embedding) > 0").groupBy("paper_id").agg(F.min_by("embedding", F.struct("paragraph_order", "paragraph_id")).alias("embedding"))
    out = update_papers(load(spark, d, "papers").select("paper_id", "title"), first)
    return out.select("paper_id", "title", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("head"))


def q_link(spark, d):
    """Every link scored again by half, unless the score is null."""
    links = load(spark, d, "paper_keywords")
    new = links.filter("score is not null").select("paper_id", "keyword_id", F.round(F.col("score") / 2, 6).alias("score"), (-F.col("score")).alias("seq"))
    return link(links, new)


def q_save_relations(spark, d):
    """Relations between papers of one journal and year replaced by those of the next paper."""
    p = load(spark, d, "papers").filter("journal is not null and published_year is not null")
    w = Window.partitionBy("journal", "published_year").orderBy("paper_id")
    e = p.select(F.col("paper_id").alias("source_paper_id"), F.lag("paper_id").over(w).alias("before"), F.lead("paper_id").over(w).alias("after"))
    old = e.filter("before is not null").select("source_paper_id", F.col("before").alias("related_paper_id"), F.lit(0.25).alias("relation_score"))
    new = e.filter("after is not null").select("source_paper_id", F.col("after").alias("related_paper_id"), F.lit(0.75).alias("relation_score"))
    return replace_relations(old, new)


def q_update_paper(spark, d):
    """Missing abstract summaries filled from the newest summary of the paper."""
    s = latest(load(spark, d, "paper_summaries").filter("relevance_summary is not null").select("paper_id", "summary_id", "generated_at", "relevance_summary"), ["paper_id"], [F.desc("generated_at"), F.desc("summary_id")])
    return load(spark, d, "papers").select("paper_id", "abstract_summary").join(s, "paper_id", "left").select("paper_id", F.coalesce("abstract_summary", "relevance_summary").alias("abstract_summary"))


def q_save_result(spark, d):
    """The newest result of each paper: the state of a table of results after all upserts."""
    s = latest(load(spark, d, "paper_summaries").select("paper_id", "result_id", "summary_id", "score", "generated_at"), ["paper_id"], [F.desc("generated_at"), F.desc("summary_id")])
    return s.select("paper_id", "result_id", "score")


def q_kw_cache(spark, d):
    """Best summary of each term as a cache keyed by keyword."""
    s = load(spark, d, "paper_summaries").select("result_id", "paper_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.explode(T.unique_terms(F.col("keywords"))).alias("term"))
    k = load(spark, d, "keywords").select(T.keyword(F.col("keyword")).alias("term"), "keyword_id").filter("term <> ''").groupBy("term").agg(F.min("keyword_id").alias("keyword_id"))
    return s.join(k, "term").groupBy("keyword_id").agg(F.min_by("result_id", F.struct(-F.col("score"), F.col("result_id"))).alias("result_id"), F.count("*").alias("results"))


def q_cache_refresh(spark, d):
    """Keywords whose cached result is older than the newest paper linked to them."""
    links = load(spark, d, "paper_keywords").select("paper_id", "keyword_id").distinct()
    newest = links.join(load(spark, d, "papers").select("paper_id", "created_at"), "paper_id").groupBy("keyword_id").agg(F.max("created_at").alias("newest"))
    made = links.join(load(spark, d, "paper_summaries").select("paper_id", "generated_at"), "paper_id").groupBy("keyword_id").agg(F.min("generated_at").alias("made"))
    return newest.join(made, "keyword_id").filter("newest > made").select("keyword_id")


def q_review_save(spark, d):
    """Review documents as the store keeps them: the last update per id."""
    r = load(spark, d, "review_documents")
    return latest(r.select("document_id", "phase", "status", "paper_id", "updated_at"), ["document_id"], [F.desc("updated_at")]).select("document_id", "phase", "status", "paper_id")


STATES = ("queued", "running", "done", "failed")


def append_jobs(log: DataFrame, changes: DataFrame) -> DataFrame:
    """A log of jobs with changes(paper_id, stage, status, error, at) appended: started_at where a stage starts to run, finished_at where it is done or failed.

    An unknown state is an error.
    """
    known = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown state "), F.coalesce("status", F.lit("null")))))
    new = changes.select("paper_id", "stage", known.alias("status"), "error", F.when(F.col("status") == "running", F.col("at")).alias("started_at"), F.when(F.col("status").isin("done", "failed"), F.col("at")).alias("finished_at"))
    return log.unionByName(new)


def job_states(log: DataFrame) -> DataFrame:
    """(paper_id, stage, state) as callers see it: the last entry's PENDING, STARTED, SUCCESS or FAILURE."""
    at = F.coalesce("finished_at", "started_at")
    last = log.groupBy("paper_id", "stage").agg(F.max_by("status", F.struct(at, F.col("status"))).alias("status"))
    shown = F.when(F.col("status") == "running", "STARTED").when(F.col("status") == "done", "SUCCESS").when(F.col("status") == "failed", "FAILURE").otherwise("PENDING")
    return last.select("paper_id", "stage", shown.alias("state"))


def _jobs(spark, d):
    """Events as changes of jobs."""
    e = load(spark, d, "events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("stage"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "signup", "queued").otherwise("done").alias("status"), F.when(F.col("event_type") == "error", "error").alias("error"), F.col("ts").alias("at"))
    empty = spark.createDataFrame([], "paper_id long, stage string, status string, error string, started_at timestamp, finished_at timestamp")
    return append_jobs(empty, e.withColumn("at", F.col("at").cast("timestamp")))


def q_job_log(spark, d):
    """The log of all changes."""
    j = _jobs(spark, d)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return j.select("paper_id", "stage", "status", "error", text("started_at").alias("started_at"), text("finished_at").alias("finished_at"))


def q_job_states(spark, d):
    return job_states(_jobs(spark, d))


def q_new_vs_existing(spark, d):
    """Papers whose title was there before, under another id, and those that are new."""
    p = load(spark, d, "papers").select("paper_id", T.keyword(F.col("title")).alias("t"))
    w = Window.partitionBy("t").orderBy("paper_id")
    return p.filter("t is not null").select("paper_id", F.when(F.row_number().over(w) == 1, "new").otherwise("known").alias("state"))


def q_first_seen(spark, d):
    """The first paper of each normalised title."""
    p = load(spark, d, "papers").select("paper_id", T.keyword(F.col("title")).alias("term")).filter("term is not null")
    return p.groupBy("term").agg(F.min("paper_id").alias("paper_id"))


QUERIES = {
    "save_paragraphs": q_save_paragraphs, "save_table": q_save_tables, "update_paper_embedding": q_update_embedding, "save_paper": q_save_paper, "delete_paper": q_delete_paper, "link_paper_keyword": q_link, "save_relations": q_save_relations, "update_paper": q_update_paper, "save_result": q_save_result,
    "kw_cache_put": q_kw_cache, "cache_refresh": q_cache_refresh, "review_save": q_review_save, "job_log": q_job_log, "job_states": q_job_states, "new_vs_existing": q_new_vs_existing, "first_seen_dedup": q_first_seen,
}

_N = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
SQL = {
    "save_paragraphs": "with t as (select section_name, paragraph_id, keywords from paragraphs union all select 'new', (select max(paragraph_id) from paragraphs) + row_number() over (), coalesce(keywords, []) from paper_summaries) select section_name, count(*) as n, min(paragraph_id) as first_id, max(paragraph_id) as last_id, count(distinct paragraph_id) as ids, count(keywords) as lists from t group by 1",
    "save_table": "with t as (select table_title, table_id, table_summary from paper_tables union all select 'again', (select max(table_id) from paper_tables) + row_number() over (), null from paper_tables) select table_title, count(*) as n, max(table_id) as last_id, count(distinct table_id) as ids, count(table_summary) as summaries from t group by 1",
    "update_paper_embedding": "with f as (select paper_id, arg_min(embedding, (paragraph_order, paragraph_id)) as e from paragraphs where len(embedding) > 0 group by 1) select paper_id, title, len(e)::int as dim, round(e[1]::double, 5) as head from papers left join f using (paper_id)",
    "save_paper": "with t as (select title, paper_id from papers union all select 'Untitled', (select max(paper_id) from papers) + row_number() over () from paper_summaries) select title, count(*) as n, min(paper_id) as first_id, max(paper_id) as last_id, count(distinct paper_id) as ids from t group by 1",
    "delete_paper": " union all ".join(f"select '{t}' as table_name, count(*) as left_rows, count(distinct paper_id) as papers from {t} where paper_id is null or paper_id not in (select paper_id from papers where published_year is null)" for t in CHILDREN),
    "link_paper_keyword": "select paper_id, keyword_id, case when count(score) = 0 then null else round(min(score) / 2, 6) end as score from paper_keywords group by 1, 2",
    "save_relations": "with e as (select paper_id as source_paper_id, lag(paper_id) over w as b, lead(paper_id) over w as a from papers where journal is not null and published_year is not null window w as (partition by journal, published_year order by paper_id)) select source_paper_id, a as related_paper_id, 0.75::double as relation_score from e where a is not null union all select source_paper_id, b, 0.25 from e where b is not null and a is null",
    "update_paper": "with s as (select paper_id, arg_max(relevance_summary, (generated_at, summary_id)) as r from paper_summaries where relevance_summary is not null group by 1) select paper_id, coalesce(abstract_summary, r) as abstract_summary from papers left join s using (paper_id)",
    "save_result": "select paper_id, result_id, score from (select *, row_number() over (partition by paper_id order by generated_at desc, summary_id desc) as r from paper_summaries) where r = 1",
    "kw_cache_put": f"with s as (select distinct summary_id, result_id, coalesce(score, 0) as score, term from (select summary_id, result_id, score, {_N.format('x')} as term from (select summary_id, result_id, score, unnest(keywords) as x from paper_summaries) where x is not null) where term <> ''), k as (select {_N.format('keyword')} as term, min(keyword_id) as keyword_id from keywords group by 1) select keyword_id, arg_min(result_id, (-score, result_id)) as result_id, count(*) as results from s join k using (term) where term <> '' group by 1",
    "cache_refresh": "with l as (select distinct paper_id, keyword_id from paper_keywords), n as (select keyword_id, max(created_at) as newest from l join papers using (paper_id) group by 1), m as (select keyword_id, min(generated_at) as made from l join paper_summaries using (paper_id) group by 1) select keyword_id from n join m using (keyword_id) where newest > made",
    "review_save": "select document_id, phase, status, paper_id from (select *, row_number() over (partition by document_id order by updated_at desc) as r from review_documents) where r = 1",
    "job_log": "select user_id as paper_id, event_type as stage, case event_type when 'error' then 'failed' when 'view' then 'running' when 'signup' then 'queued' else 'done' end as status, case when event_type = 'error' then 'error' end as error, case when event_type = 'view' then strftime(ts, '%Y-%m-%d %H:%M:%S') end as started_at, case when event_type not in ('view', 'signup') then strftime(ts, '%Y-%m-%d %H:%M:%S') end as finished_at from events",
    "job_states": "select distinct user_id as paper_id, event_type as stage, case event_type when 'error' then 'FAILURE' when 'view' then 'STARTED' when 'signup' then 'PENDING' else 'SUCCESS' end as state from events",
    "new_vs_existing": f"select paper_id, case when row_number() over (partition by {_N.format('title')} order by paper_id) = 1 then 'new' else 'known' end as state from papers where title is not null",
    "first_seen_dedup": f"select {_N.format('title')} as term, min(paper_id) as paper_id from papers where title is not null group by 1",
}
