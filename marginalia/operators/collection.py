"""Collection of works: dumps filtered into candidates, manifests kept by key, sources found for files."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.sources import files as S
from marginalia.storage import load, new_path


def _dump(spark, d) -> str:
    """The papers as a dump of bibliographic works in the shared folder."""
    p = load(spark, d, "papers").filter("paper_id is not null")
    names = F.split(F.coalesce("authors", F.lit("")), ";")
    licence = F.element_at(F.array(F.lit("CC-BY"), F.lit("closed"), F.lit("cc0")), (F.col("paper_id") % 3 + 1).cast("int"))
    loc = F.struct(licence.alias("license"), F.col("full_text_link").alias("pdf_url"), F.struct(F.col("journal").alias("display_name")).alias("source"))
    w = p.select(F.concat(F.lit("https://works.example/W"), "paper_id").alias("id"), F.concat(F.lit("https://doi.org/10.9/P"), "paper_id").alias("doi"), "title", F.col("published_year").alias("publication_year"), F.transform(names, lambda n: F.struct(F.struct(n.alias("display_name")).alias("author"))).alias("authorships"), loc.alias("best_oa_location"), (F.col("paper_id") % 11 == 0).alias("is_retracted"))
    out = new_path(spark, "works")
    w.write.json(out)
    return out


def q_candidates(spark, d):
    """Works of the dump that may be collected."""
    c = S.candidates(S.works(spark, _dump(spark, d)))
    return c.select("source_id", "doi", "title", "publication_year", "license", F.size("authors").alias("n_authors"))


def q_collected_ids(spark, d):
    """The listed works, all of which the policy lets through; one it does not would be an error."""
    c = S.candidates(S.works(spark, _dump(spark, d)))
    listed = load(spark, d, "paper_summaries").select(F.concat(F.lit("https://works.example/w"), "paper_id").alias("id"), "paper_id").filter("paper_id is not null").distinct()
    # Summaries of papers that the dump offers.
    offered = load(spark, d, "papers").filter(F.col("full_text_link").startswith("https://") & (T.strip(F.col("title")) != "") & (F.col("paper_id") % 3 != 1) & (F.col("paper_id") % 11 != 0)).select("paper_id")
    return S.listed(c, listed.join(offered, "paper_id", "left_semi")).select("source_id", "title", "license")


def q_sizes(spark, d):
    """Papers' abstracts as downloads with declared sizes: which keep the limit of one kilobyte, and are not empty."""
    p = load(spark, d, "papers").select(F.col("paper_id").cast("string").alias("source_id"), F.octet_length(F.coalesce("abstract", F.lit(""))).cast("long").alias("byte_size"), F.when(F.col("published_year").isNotNull(), F.octet_length("abstract").cast("long")).alias("declared"))
    return S.within_size(p, 1024).select("source_id", "byte_size")


def q_smoke_set(spark, d):
    """The manifest of short copies of the first two pages of all documents with a paper."""
    r = load(spark, d, "review_documents").filter("paper_id is not null").select(F.col("document_id").alias("source_id"), F.col("source_path").alias("local_path"), F.sha2("document_id", 256).alias("sha256"), F.size("pages").alias("pages"))
    return S.smoke_set(r, "/smoke", 2).select("source_id", "local_path", "derived_from_sha256", "page_range", "purpose")


def q_backfill(spark, d):
    """Review documents that can be stored, as their paper is, and those that are skipped, by state."""
    saved, skipped = S.backfill(load(spark, d, "review_documents"), load(spark, d, "papers").filter("published_year is not null"))
    one = lambda df, state: df.groupBy("phase").agg(F.count("*").alias("n")).withColumn("state", F.lit(state))
    return one(saved, "saved").unionByName(one(skipped, "skipped"))


def q_migrations(spark, d):
    """Phases of the documents as names of migrations, of which the first by name has been applied."""
    names = load(spark, d, "review_documents").select(F.col("phase").alias("filename")).filter("filename is not null").distinct()
    return S.pending(names, names.agg(F.min("filename").alias("filename")))


def q_manifest(spark, d):
    """A manifest of all papers after an upsert of all papers with a summary: read back from its new version, the last record of a key winning."""
    p = load(spark, d, "papers").filter("paper_id is not null").select("paper_id", F.concat(F.lit("W"), "paper_id").alias("source_id"), T.collapse(F.col("title")).alias("title"), F.col("paper_id").alias("byte_size"), F.lit("2024-01-01").alias("retrieved_at"))
    path = new_path(spark, "manifest")
    p.drop("paper_id").write.json(path)
    new = p.join(load(spark, d, "paper_summaries").select("paper_id").distinct(), "paper_id", "left_semi").drop("paper_id").withColumn("title", F.lower("title")).withColumn("byte_size", -F.col("byte_size"))
    return S.manifest(spark, S.manifest_upsert(spark, path, new)).select("source_id", "title", "byte_size")


def q_lookup(spark, d):
    """The manifest entry of each paper's source file: files under their path, and copies of them known by name only."""
    p = load(spark, d, "papers").filter("source_file_path is not null")
    m = p.groupBy(F.col("source_file_path").alias("local_path")).agg(F.min(F.concat(F.lit("W"), "paper_id")).alias("source_id"), F.min("title").alias("title"))
    copy = F.replace(F.col("source_file_path"), F.lit("/data/"), F.lit("/copy/"))
    f = p.select(F.explode(F.array("source_file_path", copy)).alias("path")).distinct()
    return S.lookup_source(f, m)


def q_jsonl(spark, d):
    """Papers written as JSON lines and read again as objects of a schema."""
    p = load(spark, d, "papers").filter("paper_id is not null").select("paper_id", "title", "published_year")
    path = new_path(spark, "lines")
    p.write.json(path)
    return S.jsonl(spark, path, p.schema)


def q_scan_manifest(spark, d):
    """A manifest with an older record of every source beside the last one."""
    p = load(spark, d, "papers").filter("paper_id is not null").select(F.concat(F.lit("W"), "paper_id").alias("source_id"), T.collapse(F.col("title")).alias("title"), F.col("paper_id").alias("byte_size"))
    path = new_path(spark, "manifest")
    p.withColumn("retrieved_at", F.lit("2024-02-01")).unionByName(p.withColumn("title", F.lit("older")).withColumn("retrieved_at", F.lit("2024-01-01"))).write.json(path)
    return S.manifest(spark, path).select("source_id", "title", "byte_size")


def q_classify(spark, d):
    """Review documents by the pages on which a block has text."""
    r = load(spark, d, "review_documents")
    pages = r.select("document_id", F.explode("pages.page").alias("page"))
    text = r.select("document_id", F.explode("blocks").alias("b")).filter(T.strip(F.col("b.ocr_text")) != "").select("document_id", F.col("b.page").alias("page"), F.lit(True).alias("has_text")).distinct()
    return S.classify_pdf(r, pages.join(text, ["document_id", "page"], "left"))


def q_hash_vector(spark, d):
    """The default embedding of each keyword: its first value before scaling is that of SHA-256."""
    k = load(spark, d, "keywords").select("keyword_id", V.hash_vector(F.coalesce("keyword", F.lit("")), 8).alias("v"))
    return k.select("keyword_id", F.round(F.element_at("v", 1), 5).alias("first"), F.round(V.dot(F.col("v"), F.col("v")), 6).alias("norm"))


def q_author_keywords(spark, d):
    """Keyword lists written after a label and split again."""
    s = load(spark, d, "paper_summaries").select("summary_id", F.concat(F.lit("Keywords: "), F.array_join("keywords", "; ")).alias("line"))
    return s.select("summary_id", F.size(T.keyword_list(F.col("line"))).alias("n"))


QUERIES = {"scan_jsonl": q_jsonl, "scan_manifest": q_scan_manifest, "classify_pdf": q_classify, "filter_size": q_sizes, "smoke_set": q_smoke_set, "backfill_reviews": q_backfill, "apply_migrations": q_migrations, "scan_openalex": q_candidates, "scan_openalex_ids": q_collected_ids, "manifest_upsert": q_manifest, "join_manifest_meta": q_lookup, "hash_vector": q_hash_vector, "extract_author_keywords": q_author_keywords}

_C = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_OK = f"select 'W' || paper_id as source_id, '10.9/P' || paper_id as doi, {_C.format('title')} as title, published_year as publication_year, case paper_id % 3 when 0 then 'cc-by' else 'cc0' end as license, len(list_filter(string_split(coalesce(authors, ''), ';'), lambda x: trim(x) <> ''))::int as n_authors from papers where paper_id % 3 <> 1 and paper_id % 11 <> 0 and full_text_link like 'https://%' and trim(title) <> ''"
SQL = {
    "scan_openalex": _OK,
    "scan_openalex_ids": f"with c as ({_OK}) select source_id, title, license from c where source_id in (select 'W' || paper_id from paper_summaries)",
    "filter_size": "select paper_id::varchar as source_id, strlen(abstract)::bigint as byte_size from papers where strlen(abstract) between 1 and 1024",
    "smoke_set": "select document_id as source_id, '/smoke/' || document_id || '-smoke-' || least(2, len(pages)) || 'p.pdf' as local_path, sha256(document_id) as derived_from_sha256, '1-' || least(2, len(pages)) as page_range, 'pipeline-smoke-test-only' as purpose from review_documents where paper_id is not null",
    "backfill_reviews": "select phase, count(*) as n, case when paper_id is null or paper_id in (select paper_id from papers where published_year is not null) then 'saved' else 'skipped' end as state from review_documents group by 1, 3",
    "apply_migrations": "select distinct phase as filename from review_documents where phase > (select min(phase) from review_documents)",
    "manifest_upsert": f"select 'W' || paper_id as source_id, case when s then lower({_C.format('title')}) else {_C.format('title')} end as title, case when s then -paper_id else paper_id end as byte_size from (select *, paper_id in (select paper_id from paper_summaries where paper_id is not null) as s from papers)",
    "join_manifest_meta": "with m as (select source_file_path as local_path, min('W' || paper_id) as s from papers where source_file_path is not null group by 1), n as (select string_split(local_path, '/')[-1] as name, min(s) as s from m group by 1), f as (select distinct unnest([source_file_path, replace(source_file_path, '/data/', '/copy/')]) as path from papers where source_file_path is not null) select path, coalesce(m.s, n.s) as source_id from f left join m on m.local_path = path left join n on n.name = string_split(path, '/')[-1]",
    "extract_author_keywords": r"select summary_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace('Keywords: ' || coalesce(array_to_string(keywords, '; '), ''), '(?i)^\s*keywords?\s*[:]\s*', ''), '[,;•\n]+'), lambda x: trim(regexp_replace(x, '^[\s.]+|[\s.]+$', '', 'g'))), lambda x: x <> '')))::int as n from paper_summaries",
    "hash_vector": "with r as (select keyword_id, list_transform(range(8), lambda i: ('0x' || substring(sha256(coalesce(keyword, '') || chr(0) || i), 1, 8))::ubigint::double / 4294967296.0 * 2 - 1) as v from keywords) select keyword_id, round(v[1] / sqrt(list_dot_product(v, v)), 5) as first, 1.0::double as norm from r",
    "scan_jsonl": "select paper_id, title, published_year from papers where paper_id is not null",
    "scan_manifest": f"select 'W' || paper_id as source_id, {_C.format('title')} as title, paper_id as byte_size from papers where paper_id is not null",
    "classify_pdf": "with p as (select document_id, unnest(pages) as p from review_documents), b as (select distinct document_id, b.page as page from (select document_id, unnest(blocks) as b from review_documents) where trim(b.ocr_text) <> ''), s as (select p.document_id, avg((b.page is not null)::int) as s from p left join b on b.document_id = p.document_id and b.page = p.p.page group by 1) select document_id, case when s >= 0.8 then 'digital' else 'scanned' end as kind from review_documents left join s using (document_id)",
}
