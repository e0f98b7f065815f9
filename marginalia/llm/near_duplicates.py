"""Groups of records with nearly the same words, by bottom-k sketches.

A record's sketch is its k least words by one hash function.  Inverted lists are kept of
runs of least words in independent orders; a run's length is fixed, and there are as many
orders as the recall asks for at the threshold, so neither the size of the collection nor
how common a group makes its words changes which pairs meet.  Records that meet in a list
are compared by a parity sketch that bounds their difference, then by the estimate from
the sketch of their union, then exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.skew import hot_keys
from marginalia.storage import load, persist_table

from .expand import chunked, pairs_within
from .forest import spanning_forest

LIST = 256
#: Long lists up to this number have their keys sent to all tasks.
BROADCAST_LISTS = 200_000
#: Share of the pairs at the threshold that meet in a list.
RECALL = 0.999
_MULT = 0x9E3779B97F4A7C15
SEED = 20_240_611


def sketch_size(records: int) -> int:
    return max(32, 8 * math.ceil(math.log10(max(10, records))))


def run_length(records: int) -> int:
    """Words of a run: longer in a larger collection, which takes more orders for the same recall but fewer chance meetings."""
    return 5 + (records > 10**6) + (records > 10**8)


def runs_for(length: int, threshold: float, recall: float = RECALL) -> int:
    """Runs in which two sets of that Jaccard similarity share one with probability ``recall``."""
    p = threshold**length
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))


def word_set(text: Column) -> Column:
    """Sorted 64-bit hashes of the different words: runs of letters and digits, lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_sort(F.transform(F.array_distinct(words), lambda w: F.xxhash64(w)))


def _lister(runs: int, length: int):
    """id, kind, ws -> key, id, sz, p0, p1 for each run: the least words in ``length`` orders."""
    rng = np.random.default_rng(SEED)
    shift, odd = rng.integers(0, 2**64, (2, runs * length), dtype="u8")
    odd |= np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = batch.column(2)
            u = ws.flatten().to_numpy(zero_copy_only=False).astype("i8").view("u8")
            size = np.diff(ws.offsets.to_numpy()).astype("i8")
            if not len(u):
                continue
            doc = np.repeat(np.arange(len(size)), size)
            parity = [np.zeros(len(size), "u8"), np.zeros(len(size), "u8")]
            for half in (0, 1):
                mine = (u >> np.uint64(6)) & np.uint64(1) == half
                np.bitwise_xor.at(parity[half], doc[mine], np.uint64(1) << (u[mine] & np.uint64(63)))
            first = np.cumsum(size) - size
            rest = [pa.array(x) for x in (batch.column(0).to_numpy(), size.astype("i4"), parity[0].view("i8"), parity[1].view("i8"))]
            for r in range(runs):
                key = batch.column(1).to_numpy().astype("u8") * np.uint64(runs) + np.uint64(r)
                for i in range(r * length, (r + 1) * length):
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(_MULT) + np.minimum.reduceat((u ^ shift[i]) * odd[i], first)
                yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), *rest], ["key", "id", "sz", "p0", "p1"])

    return run


def _pairs(lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a < b) within lists(key, id, sz, p0, p1) whose parity sketches allow the threshold.

    The parity sketches of two sets differ in at most as many bits as the sets in elements,
    so no pair that reaches the threshold is lost.
    """
    far = (1 - threshold) / (1 + threshold)
    on = f"""a.key = b.key and a.id < b.id and a.sz >= {threshold} * b.sz and b.sz >= {threshold} * a.sz
      and bit_count(a.p0 ^ b.p0) + bit_count(a.p1 ^ b.p1) <= {far} * (a.sz + b.sz) + 1e-9"""
    return lists.alias("a").join(lists.alias("b"), F.expr(on)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _chunks(rows: DataFrame) -> DataFrame:
    """A list of n > LIST rows as lists of two chunks each, in which every two rows meet."""
    parts = f"cast(ceil(n / {LIST}) as int)"
    rows = rows.withColumn("c", F.expr(f"cast(pmod(xxhash64(id, 5), {parts}) as int)")).withColumn("o", F.explode(F.expr(f"sequence(0, {parts} - 1)")))
    return rows.withColumn("key", F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o"))).select("key", "id", "sz", "p0", "p1")


def _split(rows: DataFrame) -> DataFrame:
    """The lists with those of more than LIST rows in chunks; every two rows of a list still meet.

    As long as few lists are long their keys go to all tasks, so no row is moved to find
    out.  Else only the longest, of more than a thousandth of the rows each, are told
    apart so, that no task gets such a list whole, and the others by a shuffle.
    """
    long = persist_table(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LIST), "p6-long")
    many = long.count()
    if not many:
        return rows
    if many <= BROADCAST_LISTS:
        marked = rows.join(F.broadcast(long), "key", "left")
        return marked.filter("n is null").drop("n").unionByName(_chunks(marked.filter("n is not null")))
    hot = hot_keys(long, "n", long.agg(F.sum("n")).first()[0])
    rest = rows.join(F.broadcast(hot.select("key")), "key", "left_anti")
    cold = long.join(F.broadcast(hot.select("key")), "key", "left_anti")
    marked = rest.join(cold, "key", "left")
    return marked.filter("n is null").drop("n").unionByName(_chunks(marked.filter("n is not null"))).unionByName(_chunks(rows.join(F.broadcast(hot), "key")))


def similar_records(records: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of ``records(rid long, kind int, text string)``.

    Records of a kind with equal word sets are one class: classes(rid, kind, cid, copies),
    cid its least rid.  links(a, b, similarity) are the pairs of classes of one kind whose
    Jaccard similarity is at least ``threshold``.  Null texts and texts without any word
    are left out; text of any length is used whole.
    """
    sets = records.select("rid", "kind", word_set(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    sets = persist_table(sets.withColumn("h0", F.xxhash64("ws")).withColumn("h1", F.xxhash64(F.reverse("ws"))), "p6-sets")
    reps = persist_table(sets.groupBy("kind", "h0", "h1").agg(F.min("rid").alias("id"), F.count("*").alias("copies"), F.first("ws").alias("ws")), "p6-reps")
    n = reps.count()
    k, length = sketch_size(n), run_length(n)
    rows = reps.select("id", "kind", "ws").mapInArrow(_lister(runs_for(length, threshold), length), "key long, id long, sz int, p0 long, p1 long")
    rows = persist_table(rows, "p6-lists")
    pairs = _pairs(_split(rows), threshold).distinct()
    # The k least of the union's values, by value: its estimate of the similarity errs by a standard error of 0.5 / sqrt(k).
    wa, wb = reps.select(F.col("id").alias("a"), F.col("ws").alias("wa")), reps.select(F.col("id").alias("b"), F.col("ws").alias("wb"))
    both = pairs.join(wa, "a").join(wb, "b")
    least = f"slice(array_sort(array_union(slice(wa, 1, {k}), slice(wb, 1, {k}))), 1, {k})"
    both = both.withColumn("u", F.expr(least)).withColumn("est", F.expr("size(array_intersect(array_intersect(u, wa), wb)) / size(u)"))
    both = both.filter(F.col("est") >= threshold - 2.5 / math.sqrt(k))
    shared = F.size(F.array_intersect("wa", "wb"))
    both = both.withColumn("similarity", shared / (F.size("wa") + F.size("wb") - shared))
    links = persist_table(both.filter(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity"), "p6-links")
    ids = reps.select("kind", "h0", "h1", F.col("id").alias("cid"), "copies")
    few = ids.filter("copies > 1")
    one = sets.select("rid", "kind", "h0", "h1")
    classes = one.join(few, ["kind", "h0", "h1"], "left").select("rid", "kind", F.coalesce("cid", "rid").alias("cid"), F.coalesce("copies", F.lit(1)).alias("copies"))
    return persist_table(classes, "p6-classes"), links


def near_groups(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(rid, kind, group_key, copies, links): the group of each record under chains of links.

    group_key is the least rid of the group; copies and links are of the record's class.
    """
    classes, links = similar_records(records, threshold)
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"), (1 - F.col("similarity")).alias("w"))
    ends = links.select(F.col("a").alias("cid")).unionByName(links.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("links"))
    _, comps = spanning_forest(edges, "p6-forest")
    named = comps.join(comps.groupBy("root").agg(F.min("node").alias("group_key")), "root").select(F.col("node").alias("cid"), "group_key").join(ends, "cid")
    out = classes.join(named, "cid", "left")
    return out.select("rid", "kind", F.coalesce("group_key", "cid").alias("group_key"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def corpus(spark, sf_dir: str) -> DataFrame:
    """Papers (kind 0, rid 2 * paper_id) by title and abstract, paragraphs (kind 1, rid 2 * paragraph_id + 1) by original text."""
    papers = load(spark, sf_dir, "papers").filter("abstract is not null and trim(abstract) <> ''")
    papers = papers.select((F.col("paper_id") * 2).alias("rid"), F.lit(0).alias("kind"), F.concat_ws(" ", "title", "abstract").alias("text"))
    para = load(spark, sf_dir, "paragraphs").select((F.col("paragraph_id") * 2 + 1).alias("rid"), F.lit(1).alias("kind"), F.col("original_text").alias("text"))
    return papers.unionByName(para).filter("rid is not null")


def _public(kind: str = "kind"):
    return F.when(F.expr(kind) == 0, "paper").otherwise("paragraph")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Any two papers, or two paragraphs, of one group of nearly equal records."""
    g = near_groups(corpus(spark, sf_dir))
    rows, _ = chunked(g.select(F.col("group_key").alias("key"), "rid"))
    pairs = pairs_within(persist_table(rows, "p6-members"))
    # Records of one kind have ids of one parity.
    return pairs.select(_public("pmod(r1, 2)").alias("kind"), F.floor(F.col("r1") / 2).cast("long").alias("id_a"), F.floor(F.col("r2") / 2).cast("long").alias("id_b"))


def p6_groups(spark, sf_dir: str) -> DataFrame:
    """One row per record with words: its group, exact copies of its word set, and links of its class."""
    g = near_groups(corpus(spark, sf_dir))
    return g.select(_public().alias("kind"), F.floor(F.col("rid") / 2).cast("long").alias("rec_id"), F.floor(F.col("group_key") / 2).cast("long").alias("group_id"), F.col("copies").cast("long").alias("copies"), F.col("links").cast("long").alias("links"))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}

_GROUPS = r"""
with recursive rec as (
  select 'paper' as kind, paper_id as id, concat_ws(' ', title, abstract) as t from papers where abstract is not null and trim(abstract) <> ''
  union all select 'paragraph', paragraph_id, original_text from paragraphs),
w as (select distinct kind, id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) as x from rec),
s as (select kind, id, count(*) as n from w group by all),
v as (select w.*, n from w join s using (kind, id)),
pair as (select kind, a.id as a, b.id as b from v a join v b using (kind, x) where a.id <> b.id
  group by kind, a.id, b.id, a.n, b.n having count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9),
reach as (select kind, a, b from pair union select r.kind, r.a, p.b from reach r join pair p on r.kind = p.kind and r.b = p.a)
"""
SQL = {
    "p6_found": _GROUPS + "select distinct kind, a as id_a, b as id_b from reach where a < b",
    "p6_groups": _GROUPS + """,
k as (select kind, id, string_agg(x, ' ' order by x) as k from w group by all),
c as (select kind, k, min(id) as cid, count(*) as copies from k group by all),
l as (select p.kind, ca.cid, count(distinct cb.cid) as links from pair p join k ka on ka.kind = p.kind and ka.id = p.a join c ca on ca.kind = ka.kind and ca.k = ka.k
  join k kb on kb.kind = p.kind and kb.id = p.b join c cb on cb.kind = kb.kind and cb.k = kb.k where ca.cid <> cb.cid group by all),
g as (select kind, a as id, min(b) as g from reach group by all)
select k.kind, k.id as rec_id, least(k.id, coalesce(g.g, k.id)) as group_id, c.copies, coalesce(l.links, 0) as links
from k join c using (kind, k) left join l on l.kind = k.kind and l.cid = c.cid left join g on g.kind = k.kind and g.id = k.id""",
}
