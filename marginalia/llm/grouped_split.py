"""Splits that keep records of one entity together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.storage import load, persist_table

from .forest import spanning_forest, star_edges

#: Author entries that name nobody.
NO_AUTHORS = ("", "unknown", "anonymous", "n/a", "et al.", "et al")
GOLDEN = 0.6180339887498949


def author_names(c):
    """Distinct names of a ``;`` list: lower case, single blanks, without trailing marks; placeholders dropped."""
    one = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)\s+", " "), r"(?U)[\s\d,*†]+$", ""))
    names = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), one)
    return F.array_distinct(F.filter(names, lambda x: ~x.isin(*NO_AUTHORS)))


def taken_documents(spark, sf_dir: str) -> DataFrame:
    """(document_id, paper_id) of review documents that occur in the training labels or annotations."""
    ids = None
    for t in ("ocr_labels", "layout_annotations"):
        one = load(spark, sf_dir, t).select(F.trim(F.lower(F.regexp_replace("document_id", r"(?U)^\s+|\s+$", ""))).alias("norm"))
        ids = one if ids is None else ids.unionByName(one)
    docs = load(spark, sf_dir, "review_documents").select("document_id", "paper_id").filter("document_id is not null")
    docs = docs.withColumn("norm", F.trim(F.lower(F.regexp_replace("document_id", r"(?U)^\s+|\s+$", ""))))
    return docs.filter("norm <> ''").join(ids.distinct(), "norm", "left_semi").select("document_id", "paper_id").distinct()


def entity_links(spark, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(node, hub): the paper of each document and the authors of that paper."""
    papers = load(spark, sf_dir, "papers").select("paper_id", F.explode(author_names(F.col("authors"))).alias("author"))
    own = docs.filter("paper_id is not null").select(F.col("document_id").alias("node"), F.concat(F.lit("p:"), F.col("paper_id").cast("string")).alias("hub"))
    by = docs.join(papers, "paper_id").select(F.col("document_id").alias("node"), F.concat(F.lit("a:"), "author").alias("hub"))
    return own.unionByName(by)


def groups(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their group, forest): group_key is the least document_id of the group, size its documents."""
    docs = persist_table(taken_documents(spark, sf_dir), "p3-docs")
    forest, comps = spanning_forest(star_edges(entity_links(spark, sf_dir, docs)), "p3")
    named = comps.join(comps.groupBy("root").agg(F.min("node").alias("group_key"), F.count("*").alias("size")), "root")
    out = docs.select("document_id").distinct().join(named.select(F.col("node").alias("document_id"), "group_key", "size"), "document_id", "left")
    return out.select("document_id", F.coalesce("group_key", "document_id").alias("group_key"), F.coalesce("size", F.lit(1)).alias("size")), forest


def split_groups(group_sizes: DataFrame, targets: list[tuple[str, float]], seed: int = 7, large: float = 0.005) -> DataFrame:
    """(group_key, size, band, split_name): a split for each group, whole groups only.

    ``group_sizes(group_key, size)`` are stratified into bands by powers of two of the size.
    Groups of more than ``large`` of all records, at most 1 / large of them, go one by one
    to the split that is furthest below its target.  What these leave of the targets is
    dealt systematically to every other band: the groups of a band are put in a random but
    fixed order, and the i-th takes the split at the point i * golden ratio (mod 1) of the
    shares, so each split gets its part of each band up to a few groups.  Shares are scaled
    to a sum of 1; a null or negative share counts as 0.
    """
    shares = [(n, max(0.0, s or 0.0)) for n, s in targets]
    whole = sum(s for _, s in shares) or 1.0
    shares = sorted(((n, s / whole) for n, s in shares), key=lambda x: (-x[1], str(x[0])))
    spark = group_sizes.sparkSession
    total, n = group_sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # A task numbers a bucket of a band; their counts, one row a bucket, are few beside the groups.
    buckets = max(64, n // 100_000)
    cut = max(1.0, total * large)
    big = group_sizes.filter(F.col("size") > cut).orderBy(F.desc("size"), "group_key").collect()
    room = {n: s * total for n, s in shares}
    placed = []
    for g in big:
        name = max(room, key=lambda n: (room[n], str(n)))
        room[name] -= g["size"]
        placed.append((g["group_key"], name))
    left = {n: max(0.0, r) for n, r in room.items()}
    rest = sum(left.values()) or 1.0
    band = F.floor(F.log2("size")).cast("int")
    b = F.pmod(F.xxhash64("group_key", F.lit(seed)), F.lit(buckets))
    small = group_sizes.filter(F.col("size") <= cut).withColumn("band", band).withColumn("bucket", b)
    start = small.groupBy("band", "bucket").agg(F.count("*").alias("m")).withColumn("start", F.sum("m").over(Window.partitionBy("band").orderBy("bucket")) - F.col("m")).drop("m")
    rank = F.row_number().over(Window.partitionBy("band", "bucket").orderBy(F.xxhash64("group_key", F.lit(seed + 1)), "group_key"))
    small = small.withColumn("r", rank).join(F.broadcast(start), ["band", "bucket"])
    point = (F.col("start") + F.col("r") + F.col("band") * 0.37) * GOLDEN
    point = point - F.floor(point)
    edge, case = 0.0, None
    for n, _ in shares:
        edge += left[n] / rest
        case = F.when(point < edge, n) if case is None else case.when(point < edge, n)
    last = next((n for n, _ in reversed(shares) if left[n] > 0), shares[-1][0] if shares else None)
    case = F.lit(None).cast("string") if case is None else case.otherwise(F.lit(last))
    small = small.select("group_key", "size", "band", case.alias("split_name"))
    named = spark.createDataFrame(placed, "group_key string, split_name string")
    return small.unionByName(group_sizes.join(F.broadcast(named), "group_key").select("group_key", "size", band.alias("band"), "split_name"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Documents that have a relative, with the least document_id of their group."""
    docs, _ = groups(spark, sf_dir)
    return docs.filter("size > 1").select("document_id", "group_key")


def p3_splits(spark, sf_dir: str) -> DataFrame:
    """The split of every training document; related documents share it."""
    docs, _ = groups(spark, sf_dir)
    targets = [(r["split_name"], r["share"]) for r in load(spark, sf_dir, "split_targets").orderBy("split_name").collect()]  # a table that people write, a row per split
    sizes = docs.groupBy("group_key").agg(F.count("*").alias("size"))
    dealt = persist_table(split_groups(sizes, targets), "p3-splits")
    return docs.select("document_id", "group_key").join(dealt, "group_key").select("document_id", "group_key", "split_name")


def p3_kept(spark, sf_dir: str) -> DataFrame:
    """What the splits promise of each group of relatives: its documents, and that one split holds them all."""
    s = p3_splits(spark, sf_dir)
    return s.groupBy("group_key").agg(F.count("*").alias("documents"), (F.count_distinct("split_name") == 1).alias("whole"))


def p3_balance(spark, sf_dir: str) -> DataFrame:
    """Each split and whether its part of the documents is within 5 % of its target, and one group more."""
    s = p3_splits(spark, sf_dir)
    total = s.count()
    widest = s.groupBy("group_key").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    have = s.groupBy("split_name").agg(F.count("*").alias("n"))
    t = load(spark, sf_dir, "split_targets").select("split_name", "share").filter("split_name is not null").groupBy("split_name").agg(F.max("share").alias("share")).join(have, "split_name", "left").fillna(0, ["n"])
    return t.select("split_name", (F.abs(F.col("n") - F.coalesce("share", F.lit(0.0)) * total) <= 0.05 * total + widest).alias("near"))


def p3_forest(spark, sf_dir: str) -> DataFrame:
    """The persisted spanning forest: the edges between documents that hold the groups together."""
    _, forest = groups(spark, sf_dir)
    return forest.select(F.col("u").alias("document_a"), F.col("v").alias("document_b"))


QUERIES = {"p3_found": p3_found, "p3_splits": p3_splits, "p3_kept": p3_kept, "p3_balance": p3_balance, "p3_forest": p3_forest}
_REACH = r"""
with recursive ids as (select lower(trim(document_id)) as k from ocr_labels union select lower(trim(document_id)) from layout_annotations),
docs as (select document_id, paper_id from review_documents where lower(trim(document_id)) in (select k from ids)),
names as (select paper_id, trim(regexp_replace(regexp_replace(lower(a), '\s+', ' ', 'g'), '[\s0-9,*†]+$', '')) as a
  from (select paper_id, unnest(string_split(authors, ';')) as a from papers)),
hubs as (select document_id, 'p:' || paper_id as hub from docs where paper_id is not null
  union select document_id, 'a:' || a from docs join names using (paper_id) where a not in ('', 'unknown', 'anonymous', 'n/a', 'et al.', 'et al')),
edges as (select distinct a.document_id as x, b.document_id as y from hubs a join hubs b using (hub)),
reach as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x)
"""
SQL = {
    "p3_found": _REACH + "select x as document_id, min(y) as group_key from reach group by x having count(distinct y) > 1",
    "p3_kept": _REACH + "select coalesce(g, d) as group_key, count(*) as documents, true as whole from (select distinct document_id as d from docs) left join (select x, min(y) as g from reach group by 1) on x = d group by 1",
    "p3_balance": "select split_name, true as near from split_targets",
}
