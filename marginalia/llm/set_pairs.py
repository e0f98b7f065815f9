"""Similarity self-join of sets by recursive chosen-path splitting.

Equal sets are collapsed into classes first.  Every class is then branched on its
tokens.  A node that few classes share is a leaf and is compared by brute force; a
larger one is split again on tokens chosen at random, with the probability that keeps
one branch in common, on average, between any two sets that reach the threshold.  The
splitting is repeated in as many trees as the target recall asks for, and each
candidate is verified on its strings.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.skew import HOT_SHARE, hot_keys
from marginalia.storage import load, persist_table

from .expand import chunked, pairs_across, pairs_within
from .terms import normal_set

LEAF = 64
RECALL = 0.999
#: Levels after which a node is compared as it is, in blocks.
MAX_LEVEL = 12


def survival(m: int) -> float:
    """Least chance that a pair with ``m`` common tokens, all of them needed, ends in one leaf of one tree."""
    q = 1.0
    for left in range(1, m + 1):
        q = 1 - (1 - q / left) ** left
    return q


def trees_for(m: int, recall: float) -> int:
    """Trees after which such a pair is missed with a probability of at most ``1 - recall``."""
    q = survival(m)
    return 1 if q >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def _trees_column(c, most: int, recall: float):
    """:func:`trees_for` of a number of tokens; of over ten in steps of a tenth, and at most that of ``most``."""
    steps = [m for m in range(1, 11) if m < most]
    while steps and steps[-1] >= 10 and steps[-1] * 11 // 10 < most:
        steps.append(steps[-1] * 11 // 10)
    case = F.lit(trees_for(most, recall))
    for m in reversed(steps):
        case = F.when(c <= m, trees_for(m, recall)).otherwise(case)
    return case


def set_classes(records: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of ``records(rid long, toks array<string>)``, toks sorted and without repeats.

    members(rid, key) has one row per record with at least ``min_size`` tokens;
    classes(cid, key, n, toks, sz, sig, slack) one per different set, cid its least rid.
    Two sets share at most bit_count(sig & sig') + slack tokens.
    """
    rec = records.select("rid", "toks").filter(F.size("toks") >= min_size).withColumn("key", F.unhex(F.md5(F.concat_ws("\u0001", "toks"))))
    classes = rec.groupBy("key").agg(F.min("rid").alias("cid"), F.count("*").alias("n"), F.first("toks").alias("toks"))
    sig = F.expr("aggregate(transform(toks, x -> shiftleft(1L, int(pmod(xxhash64(x), 64)))), 0L, (a, x) -> a | x)")
    classes = classes.select("cid", "key", "n", "toks", F.size("toks").alias("sz"), sig.alias("sig"))
    return rec.select("rid", "key"), classes.withColumn("slack", F.col("sz") - F.bit_count("sig"))


def _could_match(threshold: float) -> str:
    """Necessary for a and b to reach the threshold: sizes, then the bound by sketches."""
    return f"""a.cid < b.cid AND a.sz >= {threshold} * b.sz AND b.sz >= {threshold} * a.sz
      AND (bit_count(a.sig & b.sig) + least(a.slack, b.slack)) * {1 + threshold} >= {threshold} * (a.sz + b.sz) - 1e-9"""


def _leaf_pairs(leaves: DataFrame, threshold: float) -> DataFrame:
    """Candidates within leaves(node, cid, sz, sig, slack)."""
    a, b = leaves.alias("a"), leaves.alias("b")
    return a.join(b, F.expr(f"a.node = b.node AND {_could_match(threshold)}")).select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b"))


def _blocks(node_rows: DataFrame, leaf: int) -> DataFrame:
    """Split each row of a node of n > leaf rows over pairs of chunks, so that a block has about 2 * leaf rows.

    Every two rows of a node meet in a block: the exact way out for nodes that cannot be split any more.
    """
    parts = f"cast(ceil(n / {leaf}) as int)"
    rows = node_rows.withColumn("chunk", F.expr(f"cast(pmod(xxhash64(cid, 17), {parts}) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr(f"sequence(0, {parts} - 1)")))
    return rows.withColumn("node", F.xxhash64("node", F.least("chunk", "other"), F.greatest("chunk", "other"))).drop("chunk", "other")


def similar_set_pairs(classes: DataFrame, threshold: float = 0.6, recall: float = RECALL, leaf: int = LEAF, rare: bool = True) -> DataFrame:
    """Pairs (cid_a < cid_b, similarity) of different sets whose Jaccard similarity is at least ``threshold``.

    ``classes`` is as :func:`set_classes` gives it, persisted.  With ``rare`` every token
    held by at most ``leaf`` sets is a leaf of the root, so pairs that share one are always
    found; the others, or without ``rare`` all, with a probability of at least ``recall``.
    A set is in as many trees as its own size asks for.  An empty table gives no pairs;
    ties at the threshold count.
    """
    slim = ["cid", "sz", "sig", "slack"]
    postings = classes.select(*slim, F.explode(F.transform("toks", lambda x: F.xxhash64(x))).alias("tok"))
    counts = persist_table(postings.groupBy("tok").agg(F.count("*").alias("n")).filter("n > 1"), "p1-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Tokens of a large part of all sets never go through a shuffle by token.
    hot = hot_keys(counts, "n", max(total, leaf / HOT_SHARE)).select("tok")
    cold = counts.join(F.broadcast(hot), "tok", "left_anti")
    part = postings.join(F.broadcast(hot), "tok", "left_anti").join(cold, "tok")
    leaves = part.filter(F.col("n") <= (leaf if rare else 0)).select(F.col("tok").alias("node"), *slim)
    common = part.filter(F.col("n") > (leaf if rare else 1)).select(*slim, "tok").unionByName(postings.join(F.broadcast(hot), "tok").select(*slim, "tok"))
    # What two sets with only common tokens in common need: as many common tokens as the larger one requires.
    need = F.ceil(F.col("sz") * threshold - 1e-9).cast("int")
    state = common.groupBy("cid").agg(F.first("sz").alias("sz"), F.first("sig").alias("sig"), F.first("slack").alias("slack"), F.collect_list("tok").alias("left"))
    state = persist_table(state.withColumn("need", need).filter(F.size("left") >= F.col("need")), "p1-root")
    largest = state.agg(F.max("sz")).first()[0]
    found = [leaves]
    if largest is not None:
        # The larger set of a pair needs no more common tokens than the smaller one has, so both are in all the trees that the pair asks for.
        trees = _trees_column(F.col("sz"), math.ceil(largest * threshold - 1e-9), recall)
        state = state.withColumn("node", F.explode(F.sequence(F.lit(1), trees))).withColumn("node", F.xxhash64("node"))
        for level in range(MAX_LEVEL):
            u = "(shiftrightunsigned(xxhash64(node, x, 29), 11) / 9007199254740992D)"
            chosen = f"filter(left, x -> {u} * greatest(1, need - {level}) < 1)"
            state = state.withColumn("x", F.explode(F.expr(chosen)))
            state = state.select(F.xxhash64("node", "x").alias("node"), *slim, "need", F.array_remove("left", F.col("x")).alias("left"))
            state = persist_table(state, f"p1-level{level}")
            sizes = state.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
            rows = state.join(sizes, "node")
            found.append(rows.filter(F.col("n") <= leaf).select("node", *slim))
            big = rows.filter(F.col("n") > leaf)
            spent = big if level == MAX_LEVEL - 1 else big.filter(F.col("need") <= level + 1)
            found.append(_blocks(spent.select("node", "n", *slim), leaf).select("node", *slim))
            state = persist_table(big.drop("n").filter(F.size("left") > 0), f"p1-big{level}")
            if state.isEmpty():
                break
    candidates = None
    for one in found:
        candidates = one if candidates is None else candidates.unionByName(one)
    pairs = _leaf_pairs(candidates, threshold).distinct()
    sets = classes.select("cid", "toks", "key")
    pairs = pairs.join(sets.select(F.col("cid").alias("a"), F.col("toks").alias("ta"), F.col("key").alias("key_a")), "a")
    pairs = pairs.join(sets.select(F.col("cid").alias("b"), F.col("toks").alias("tb"), F.col("key").alias("key_b")), "b")
    pairs = pairs.withColumn("common", F.size(F.array_intersect("ta", "tb")))
    pairs = pairs.withColumn("similarity", F.col("common") / (F.size("ta") + F.size("tb") - F.col("common")))
    return pairs.filter(F.col("similarity") >= threshold - 1e-12).select(F.col("a").alias("cid_a"), F.col("b").alias("cid_b"), "key_a", "key_b", "similarity")


def keyword_records(spark, sf_dir: str) -> DataFrame:
    """(rid, toks): paragraphs have the even rid 2 * paragraph_id, summaries the odd rid 2 * summary_id + 1."""
    p = load(spark, sf_dir, "paragraphs").select((F.col("paragraph_id") * 2).alias("rid"), normal_set(F.col("keywords")).alias("toks"))
    s = load(spark, sf_dir, "paper_summaries").select((F.col("summary_id") * 2 + 1).alias("rid"), normal_set(F.col("keywords")).alias("toks"))
    return p.unionByName(s).filter(F.col("rid").isNotNull())


def record_pairs(members: DataFrame, class_pairs: DataFrame) -> DataFrame:
    """All pairs of records (r1, r2), unordered, of one class or of two paired classes."""
    rows, sizes = chunked(members.select("key", "rid"))
    rows, sizes = persist_table(rows, "p1-members"), persist_table(sizes, "p1-sizes")
    return pairs_across(rows, sizes, class_pairs).unionByName(pairs_within(rows))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """All pairs of paragraphs, summaries, or one of each whose keyword sets overlap by at least 0.6."""
    members, classes = set_classes(keyword_records(spark, sf_dir), 3)
    classes = persist_table(classes, "p1-classes")
    pairs = record_pairs(members, similar_set_pairs(classes, 0.6))
    odd1, odd2 = F.col("r1") % 2, F.col("r2") % 2
    kind = F.when(odd1 != odd2, "cross").when(odd1 == 1, "summary").otherwise("paragraph")
    id1, id2 = F.floor(F.col("r1") / 2).cast("long"), F.floor(F.col("r2") / 2).cast("long")
    first = F.when(kind == "cross", F.when(odd1 == 0, id1).otherwise(id2)).otherwise(F.least(id1, id2))
    second = F.when(kind == "cross", F.when(odd1 == 0, id2).otherwise(id1)).otherwise(F.greatest(id1, id2))
    return pairs.select(kind.alias("kind"), first.alias("id_a"), second.alias("id_b"))


def p1_classes(spark, sf_dir: str) -> DataFrame:
    """One row per record with its class (equal keyword sets) and the number of classes linked to that class."""
    members, classes = set_classes(keyword_records(spark, sf_dir), 3)
    classes = persist_table(classes, "p1-classes")
    pairs = similar_set_pairs(classes, 0.6)
    ends = pairs.select(F.col("key_a").alias("key")).unionByName(pairs.select(F.col("key_b").alias("key")))
    links = classes.select("key", F.col("cid").alias("class_rid"), F.col("n").alias("copies")).join(ends.groupBy("key").agg(F.count("*").alias("links")), "key", "left")
    out = members.join(links, "key")
    kind = F.when(F.col("rid") % 2 == 1, "summary").otherwise("paragraph")
    return out.select(kind.alias("kind"), F.floor(F.col("rid") / 2).cast("long").alias("rec_id"), "class_rid", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}

_SETS = r"""
with raw as (
  select paragraph_id * 2 as rid, unnest(keywords) as x from paragraphs
  union all select summary_id * 2 + 1, unnest(keywords) from paper_summaries),
t as (select distinct rid, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) as x from raw where x is not null),
u as (select * from t where x <> ''),
s as (select rid, count(*) as n from u group by 1 having count(*) >= 3),
v as (select u.rid, u.x, s.n from u join s using (rid)),
pair as (
  select a.rid as r1, b.rid as r2 from v a join v b on a.x = b.x and a.rid < b.rid
  group by 1, 2, a.n, b.n having count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9)
"""
SQL = {
    "p1_found": _SETS + """
select case when r1 % 2 <> r2 % 2 then 'cross' when r1 % 2 = 1 then 'summary' else 'paragraph' end as kind,
  case when r1 % 2 = r2 % 2 then least(r1 // 2, r2 // 2) when r1 % 2 = 0 then r1 // 2 else r2 // 2 end as id_a,
  case when r1 % 2 = r2 % 2 then greatest(r1 // 2, r2 // 2) when r1 % 2 = 0 then r2 // 2 else r1 // 2 end as id_b
from pair""",
    "p1_classes": _SETS + """,
k as (select rid, string_agg(x, chr(1) order by x) as k from v group by 1),
c as (select k, min(rid) as class_rid, count(*) as copies from k group by 1),
e as (select distinct least(a.class_rid, b.class_rid) as a, greatest(a.class_rid, b.class_rid) as b
  from pair join k ka on ka.rid = r1 join k kb on kb.rid = r2 join c a on a.k = ka.k join c b on b.k = kb.k where ka.k <> kb.k),
d as (select z, count(*) as links from (select a as z from e union all select b from e) group by 1)
select case when rid % 2 = 1 then 'summary' else 'paragraph' end as kind, rid // 2 as rec_id, class_rid, copies, coalesce(links, 0) as links
from k join c using (k) left join d on d.z = c.class_rid""",
}
