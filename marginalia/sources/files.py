"""File sources and sinks: PDF files, bibliographic dumps, keyed JSON-lines manifests, versioned tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.config import DEFAULTS, Settings
from marginalia.functions import text as X

MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("source_id", T.StringType()), ("title", T.StringType()), ("sha256", T.StringType()), ("byte_size", T.LongType()), ("local_path", T.StringType()), ("retrieved_at", T.StringType()))])
WORK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("doi", T.StringType()), T.StructField("title", T.StringType()), T.StructField("publication_year", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("is_retracted", T.BooleanType()),
    T.StructField("authorships", T.ArrayType(T.StructType([T.StructField("author", T.StructType([T.StructField("display_name", T.StringType())]))]))),
    T.StructField("best_oa_location", T.StructType([T.StructField("license", T.StringType()), T.StructField("pdf_url", T.StringType()), T.StructField("landing_page_url", T.StringType()), T.StructField("source", T.StructType([T.StructField("display_name", T.StringType())]))])),
])


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files below a path with size, checksum, and whether the first bytes are those of a PDF; for the checksum the files are read whole."""
    return _pdf(spark, path).select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.unhex(F.lit("255044462D"))).alias("is_pdf"))


def list_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte_size, modified) of the PDF files below a path, by name; their contents are not read."""
    return _pdf(spark, path).select("path", F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified")).orderBy("path")


def _pdf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)


def classify_pdf(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, kind) of documents(document_id) by their pages(document_id, has_text): digital if at least 0.8 of the pages have text, else, or without pages, scanned."""
    share = pages.groupBy("document_id").agg(F.avg(F.coalesce("has_text", F.lit(False)).cast("int")).alias("share"))
    return documents.select("document_id").join(share, "document_id", "left").select("document_id", F.when(F.col("share") >= 0.8, "digital").otherwise("scanned").alias("kind"))


def within_size(files: DataFrame, most: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """files(byte_size, declared) that are not empty and neither declared nor in fact larger than ``most`` bytes; an unknown declared size counts as kept."""
    most = s.download_max_mb * 1024 * 1024 if most is None else most
    return files.filter((F.col("byte_size") > 0) & (F.col("byte_size") <= most) & (F.coalesce("declared", F.lit(0)) <= most))


def smoke_set(manifest: DataFrame, folder: str, pages: int) -> DataFrame:
    """Manifest rows of copies of the first ``pages`` pages of manifest(source_id, sha256, pages, ...), with where they come from; cutting the files is the renderer's work."""
    if pages < 1:
        raise ValueError("at least one page")
    n = F.least(F.lit(pages), F.col("pages")).cast("string")
    return manifest.withColumn("local_path", F.concat(F.lit(folder.rstrip("/") + "/"), "source_id", F.lit("-smoke-"), n, F.lit("p.pdf"))).withColumn("derived_from_sha256", F.col("sha256")).withColumn("page_range", F.concat(F.lit("1-"), n)).withColumn("purpose", F.lit("pipeline-smoke-test-only"))


def backfill(documents: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(saved, skipped): documents without a paper or with one that is stored, and those whose paper is not; the last update of an id is taken."""
    last = latest(documents, ["document_id"], [F.desc("updated_at")])
    known = papers.select("paper_id").distinct()
    missing = last.filter("paper_id is not null").join(known, "paper_id", "left_anti")
    return last.join(missing.select("document_id"), "document_id", "left_anti"), missing


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Migrations files(filename) that are not in applied(filename), by name."""
    return files.select("filename").distinct().join(applied.select("filename"), "filename", "left_anti").orderBy("filename")


def migrate(spark: SparkSession, steps: dict, path: str) -> list[str]:
    """Run steps(name -> function of the session) that the history below ``path`` does not hold, by name, each recorded once it is done; returns those run now.

    A step that fails leaves those before it recorded.
    """
    schema = "filename string, applied_at timestamp"
    try:
        history = spark.read.schema(schema).parquet(path)
        done = {r[0] for r in history.collect()}  # a row per migration, written by people
    except AnalysisException:
        done = set()
    now = [n for n in sorted(steps) if n not in done]
    for name in now:
        steps[name](spark)
        spark.createDataFrame([(name,)], "filename string").select("filename", F.current_timestamp().alias("applied_at")).write.mode("append").parquet(path)
    return now


def works(spark: SparkSession, path: str) -> DataFrame:
    """A dump of bibliographic works, one JSON object a line; a bad line is an error."""
    return spark.read.schema(WORK).option("mode", "FAILFAST").json(path)


def candidates(works: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Works that may be collected: open licence, https address of the PDF, not retracted, with id and title; one row per work."""
    loc = F.col("best_oa_location")
    w = works.select(
        X.work_id(F.col("id")).alias("source_id"), X.doi(F.col("doi")).alias("doi"), X.collapse(F.col("title")).alias("title"), "publication_year", "language",
        F.filter(F.transform(F.coalesce("authorships", F.array().cast(WORK["authorships"].dataType)), lambda a: X.collapse(a["author"]["display_name"])), lambda n: n.isNotNull() & (n != "")).alias("authors"),
        F.lower(loc["license"]).alias("license"), loc["pdf_url"].alias("pdf_url"), loc["source"]["display_name"].alias("journal"), F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
    )
    ok = F.col("license").isin(*s.licenses) & F.col("pdf_url").startswith("https://") & ~F.col("is_retracted") & F.col("source_id").isNotNull() & (F.col("title") != "")
    first = Window.partitionBy("source_id").orderBy("pdf_url", "title")
    return w.filter(ok).withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "is_retracted")


def listed(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """The candidates of ids(id), each of which must be one: a listed work that is missing or not allowed is an error when the plan runs."""
    wanted = ids.select("id", X.work_id(F.col("id")).alias("source_id")).dropDuplicates(["source_id"])
    j = wanted.join(candidates.withColumn("_ok", F.lit(True)), "source_id", "left")
    missing = F.raise_error(F.concat(F.lit("not to be collected: "), F.coalesce("id", F.lit("null"))))
    return j.withColumn("source_id", F.when(F.col("_ok"), F.col("source_id")).otherwise(missing)).drop("id", "_ok")


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines that must be objects of the schema; blank lines are skipped, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's rows; of several of one source the last retrieved counts, then the largest checksum."""
    return latest(jsonl(spark, path, MANIFEST), ["source_id"], [F.desc_nulls_last("retrieved_at"), F.desc_nulls_last("sha256")])


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row per key by ``order``; null keys are one key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; columns by name, missing ones null.  ``new`` holds a key once."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def manifest_upsert(spark: SparkSession, path: str, new: DataFrame) -> str:
    """Write the manifest with ``new`` rows put in, sorted by source_id, as a new version beside the old; returns its path.

    Readers of the old version are not disturbed; the caller publishes the new path.
    """
    out = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    upsert(manifest(spark, path), new, ["source_id"]).orderBy("source_id").write.json(out)
    return out


def lookup_source(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest row of files(path): by full path, else by file name, else by a work number in the name."""
    m = manifest.select("source_id", "title", F.col("local_path"), F.element_at(F.split("local_path", "/"), -1).alias("name"))
    f = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.nullif(F.regexp_extract("path", r"\b(W\d+)\b", 1), F.lit("")).alias("work"))
    by_path = m.select(F.col("local_path").alias("path"), F.col("source_id").alias("s1"))
    by_name = m.groupBy("name").agg(F.min("source_id").alias("s2"))
    by_work = m.select(F.col("source_id").alias("work"), F.col("source_id").alias("s3"))
    j = f.join(by_path, "path", "left").join(by_name, "name", "left").join(by_work, "work", "left")
    return j.select("path", F.coalesce("s1", "s2", "s3").alias("source_id"))
