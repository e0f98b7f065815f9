"""Most similar vectors by a hash-prefix forest.

Each tree hashes a vector to a string of sign bits of random projections and keeps the
strings in a sorted array.  A node of a tree is a range of the array with a common
prefix; descending lengthens the prefix until few enough rows are left, so its length
varies with the density, down to a level that is the same for all trees: the number of
trees is fitted to it, and a node of that level is compared whole, in blocks, however many
rows it holds, so a dense cluster is found like any other rows.  Ranges that come out too
small ascend to a shorter prefix.  A leaf holds as many rows in a collection of any size;
the level grows with the logarithm of the rows.  Trees are searched a few at a time, each
wave keeping what may still be among the best, so disk holds the rows of one wave only.
Candidates are scored on vectors rounded to 16 bits; all that can be among the best are
scored again exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.skew import hot_aware_join
from marginalia.storage import drop_table, load, persist_table

DIM = 64
BITS = 32
LEAF = 1024
MIN_TREES = 8
#: Trees that are hashed, shuffled and searched together.
WAVE = 8
#: Leaves of rows that one task compares at once; larger nodes are compared in blocks of that many.
BLOCK = 64
#: Leaves of evenly spread rows in a part, the unit of the shuffle.
PART = 16
#: Similarities held at once.
CELLS = 1 << 22
#: Rounding to 16 bits moves a cosine by less than this.
SLACK = 2.5e-4
SEED = 20_240_607


def planes(first: int, trees: int, dim: int = DIM) -> np.ndarray:
    """The projections of ``trees`` trees from number ``first`` on, each tree by its own seed."""
    return np.concatenate([np.random.default_rng((SEED, t)).standard_normal((dim, BITS)) for t in range(first, first + trees)], axis=1).astype("f4")


def codes(unit: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """Hash strings as integers, shape (rows, trees); the first bit of the string is the highest."""
    bits = (unit @ projections > 0).reshape(len(unit), -1, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype="i8"))


def depth_for(rows: int, leaf: int = LEAF) -> int:
    """Longest prefix of a node: two to four leaves of evenly spread rows share one."""
    return min(BITS - 1, int(math.log2(max(1.0, rows / (2 * leaf)))))


def trees_for(depth: int, similarity: float, recall: float) -> int:
    """Trees, at least MIN_TREES if there is any prefix, in which two vectors of that similarity share a node of that depth with probability ``recall``."""
    p = (1 - math.acos(min(1.0, similarity)) / math.pi) ** depth
    return 1 if p > 0.999 else max(MIN_TREES, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def waves_for(trees: int) -> list[tuple[int, int]]:
    """(first tree, trees) of each wave, as even as can be."""
    n = math.ceil(trees / WAVE)
    return [(trees * i // n, trees * (i + 1) // n - trees * i // n) for i in range(n)]


def leaves(code: np.ndarray, leaf: int, deepest: int = BITS) -> list[tuple[int, int, int, int]]:
    """(first, end, candidates' first, candidates' end) of each leaf of a sorted array of codes; nodes of the ``deepest`` level stay whole."""
    out, todo = [], [(0, len(code), 0, [(0, len(code))])]
    while todo:
        lo, hi, depth, above = todo.pop()
        if hi <= lo:
            continue
        if hi - lo <= leaf or depth >= deepest:
            wide = next(((a, b) for a, b in reversed(above) if b - a >= leaf // 2), above[0])
            if wide[1] - wide[0] > 2 * leaf:
                wide = (max(wide[0], lo - leaf // 2), min(wide[1], hi + leaf // 2))
            out.append((lo, hi, *wide))
            continue
        bit = np.int64(1) << (BITS - 1 - depth)
        mid = lo + int(np.searchsorted(code[lo:hi] & bit > 0, True))
        for a, b in ((lo, mid), (mid, hi)):
            todo.append((a, b, depth + 1, [*above, (a, b)]))
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype="i4")
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    if isinstance(column, pa.ListArray):
        return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _unit(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    v = _matrix(batch.column(1), "f4", dim)
    return v / np.sqrt(np.einsum("ij,ij->i", v.astype("f8"), v.astype("f8")))[:, None].astype("f4")


def _counter(first: int, trees: int, depth: int, dim: int):
    """id, v -> node, n: rows of nodes of the common level, node = tree of the wave * 2**depth + prefix; partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projections = planes(first, trees, dim)
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["node", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append(((codes(_unit(batch, dim), projections) >> (BITS - depth)) + (np.arange(trees) << depth)).ravel())
                if sum(map(len, held)) > 1 << 20:
                    yield counted()
        if held:
            yield counted()

    return run


def _hasher(first: int, trees: int, depth: int, coarse: int, hot: np.ndarray, blocks: np.ndarray, dim: int):
    """id, v, q -> a row per tree, several in hot nodes: part, block, side, code, id, q, vector in 16 bits.

    ``hot`` are the sorted nodes of over BLOCK leaves, ``blocks`` their numbers of blocks;
    each is a part of its own (below 0).  Other nodes share a part by their first
    ``coarse`` bits.  A hot node of c blocks is compared by the pairs (i <= j) of its
    blocks; a row is on side 0 of its pairs as i, on side 1 as j.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "side", "code", "id", "q", "vec"]
        projections = planes(first, trees, dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch, dim)
            small = np.round(unit * (32767 / np.abs(unit).max(axis=1))[:, None]).astype("i2")
            code = codes(unit, projections)
            ident, asked = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            mix = (ident.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for t in range(trees):
                part = (code[:, t] >> (BITS - coarse)) + (t << coarse)
                c = np.ones(len(part), "i8")
                if len(hot):
                    node = (code[:, t] >> (BITS - depth)) + (t << depth)
                    at = np.minimum(np.searchsorted(hot, node), len(hot) - 1)
                    inside = hot[at] == node
                    part, c = np.where(inside, -1 - at, part), np.where(inside, blocks[at], 1)
                mine = (mix % c.astype("u8")).astype("i8")
                for other in range(int(c.max())):
                    at = np.flatnonzero(c > other)
                    lo, hi = np.minimum(mine[at], other), np.maximum(mine[at], other)
                    side = (mine[at] > other).astype("i4")
                    yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(lo * c[at] + hi), pa.array(side), pa.array(code[at, t]), pa.array(ident[at]), pa.array(asked[at]), _binary(small[at])], names)

    return run


def _searcher(k: int, least: float, leaf: int, depth: int, dim: int):
    """Rows sorted by part, block, side and code -> the candidates (id, nbr, approx) of each query in its leaf."""

    def against(ident, unit, rows, a, b):
        """The rows' candidates among a..b: of each row all that may be among its k best there."""
        step = max(1, CELLS // max(1, b - a))
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            sims = unit[some] @ unit[a:b].T
            inside = (some >= a) & (some < b)
            sims[np.flatnonzero(inside), some[inside] - a] = -2
            bound = np.full(len(some), least, "f4")
            if b - a > k and np.count_nonzero(sims >= least) > k * len(some) // 2:
                bound = np.maximum(bound, np.partition(sims, b - a - k, axis=1)[:, b - a - k] - np.float32(2 * SLACK))
            i, j = np.divmod(np.flatnonzero(sims >= bound[:, None]), b - a)
            yield ident[some[i]], ident[a + j], sims[i, j]

    def search(hot, side, code, ident, query, small) -> Iterator[pa.RecordBatch]:
        unit = small.astype("f4")
        unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        if hot:
            edge = int(np.searchsorted(side, 1))
            # One block against itself, or two against each other.
            todo = [(0, len(code), 0, len(code))] if edge == len(code) else [(0, edge, edge, len(code)), (edge, len(code), 0, edge)]
        else:
            todo = leaves(code, leaf, depth)
        found, held = [], 0
        for lo, hi, a, b in todo:
            for one in against(ident, unit, lo + np.flatnonzero(query[lo:hi]), a, b):
                found.append(one)
                held += len(one[0])
                if held > CELLS // 8:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["id", "nbr", "approx"])
                    found, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["id", "nbr", "approx"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def flush():
            if held:
                t = pa.Table.from_batches(held)
                held.clear()
                yield from search(at[0] < 0, *(t[x].to_numpy() for x in ("side", "code", "id", "q")), _matrix(t["vec"].combine_chunks(), "i2", dim))

        for batch in batches:
            part, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0)) + 1), len(part)]
            for a, b in zip(edges, edges[1:]):
                if b <= a:
                    continue
                if (part[a], block[a]) != at:
                    yield from flush()
                at = (part[a], block[a])
                held.append(batch.slice(a, b - a))
        yield from flush()

    return run


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows of (id, v) whose vector has ``dim`` finite values that are not all zero."""
    fine = f"size(v) = {dim} and forall(v, x -> x is not null and not isnan(x) and abs(x) < 1e30) and exists(v, x -> x <> 0)"
    return vectors.filter(f"id is not null and coalesce({fine}, false)")


def _cosine() -> str:
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"
    return f"{dot.format('va', 'vb')} / sqrt({dot.format('va', 'va')} * {dot.format('vb', 'vb')})"


def _wave(asked: DataFrame, first: int, trees: int, rows: int, depth: int, leaf: int, k: int, least: float, dim: int) -> DataFrame:
    """(id, nbr, approx): the candidates that some trees give for each query of asked(id, v, q)."""
    spark = asked.sparkSession
    # Nodes of over BLOCK leaves: at most rows / (BLOCK * leaf) a tree, 16 bytes each.
    big = asked.select("id", "v").mapInArrow(_counter(first, trees, depth, dim), "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK * leaf).orderBy("node").toArrow()
    hot, n = big["node"].to_numpy(), big["n"].to_numpy()
    blocks = -(-n // (BLOCK * leaf))
    coarse = min(depth, depth_for(rows, PART * leaf // 2))
    hashed = asked.mapInArrow(_hasher(first, trees, depth, coarse, hot, blocks, dim), "part long, block long, side int, code long, id long, q int, vec binary")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = (trees << coarse) + int((blocks * (blocks + 1) // 2).sum())
    sorted_ = hashed.repartition(max(width, min(4 * width, tasks)), "part", "block").sortWithinPartitions("part", "block", "side", "code")
    return sorted_.mapInArrow(_searcher(k, least - SLACK, leaf, depth, dim), "id long, nbr long, approx float")


def _best(near: DataFrame, k: int) -> DataFrame:
    """Of each id the neighbours that rounding may have put behind the k-th or before it."""
    near = near.repartition("id").groupBy("id", "nbr").agg(F.max("approx").alias("approx"))
    mine = Window.partitionBy("id").orderBy(F.desc("approx"), "nbr")
    near = near.withColumn("r", F.row_number().over(mine))
    kth = F.min(F.when(F.col("r") <= k, F.col("approx"))).over(Window.partitionBy("id"))
    return near.withColumn("kth", kth).filter(F.col("approx") >= F.col("kth") - 2 * SLACK).select("id", "nbr", "approx")


def nearest(vectors: DataFrame, k: int = 10, least: float = 0.88, queries: str = "true", recall: float = 0.99, dim: int = DIM, leaf: int = LEAF) -> DataFrame:
    """(id, nbr, similarity, rank): of each query row the ``k`` most similar rows of cosine >= ``least``.

    ``vectors`` is (id long, v array<float>); null, short, zero or non-finite vectors are
    left out.  Equal vectors are indexed once and expanded afterwards, so a group of copies
    of any size costs one entry.  Ties go to the smaller id.  ``queries`` is a condition on
    id.  ``recall`` is the expected share of pairs at ``least`` that meet in a tree,
    however the vectors are spread.
    """
    rows = usable(vectors.select("id", "v"), dim).withColumn("key", F.xxhash64("v")).withColumn("key2", F.hash(F.reverse("v")))
    members = rows.select("id", "key", "key2")
    # One entry per vector; v is the same in all rows of a key.
    points = persist_table(rows.groupBy("key", "key2").agg(F.min("id").alias("pid"), F.count("*").alias("n"), F.max(F.expr(f"cast(({queries}) as int)")).alias("q"), F.first("v").alias("v")), "p7-points")
    n = points.count()
    depth = depth_for(n, leaf)
    asked = points.select(F.col("pid").alias("id"), "v", F.col("q").cast("int").alias("q"))
    found = None
    for first, trees in waves_for(trees_for(depth, least, recall)):
        wave = persist_table(_best(_wave(asked, first, trees, n, depth, leaf, k, least, dim), k), "p7-wave")
        if found is not None:
            # Only what may be among the best of all waves so far is kept.
            both = persist_table(_best(found.unionByName(wave), k), "p7-found")
            drop_table(found, wave)
            wave = both
        found = wave
    near = found
    ends = points.select("pid", "v", "key", "key2")
    near = near.join(ends.select(F.col("pid").alias("id"), F.col("v").alias("va"), "key", "key2"), "id").join(ends.select(F.col("pid").alias("nbr"), F.col("v").alias("vb"), F.col("key").alias("nkey"), F.col("key2").alias("nkey2")), "nbr")
    near = near.select("key", "key2", "nkey", "nkey2", F.expr(_cosine()).alias("similarity")).filter(F.col("similarity") >= least)
    # Of each group of copies the first k + 1 ids are all that any list can need; salted, so that no task sorts a hot group.
    by = Window.partitionBy("key", "key2", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    some = members.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)
    by = Window.partitionBy("key", "key2").orderBy("id")
    some = some.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)
    near = near.unionByName(points.filter("n > 1 and q > 0").select("key", "key2", F.col("key").alias("nkey"), F.col("key2").alias("nkey2"), F.lit(1.0).alias("similarity")))
    lists = near.join(some.select(F.col("key").alias("nkey"), F.col("key2").alias("nkey2"), F.col("id").alias("nbr")), ["nkey", "nkey2"])
    best = Window.partitionBy("key", "key2").orderBy(F.desc("similarity"), "nbr")
    lists = lists.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    lists = lists.groupBy("key", "key2").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "nbr"))).alias("list"))
    lists = lists.join(points.select("key", "key2", "n"), ["key", "key2"]).withColumn("both", F.struct("key", "key2")).drop("key", "key2")
    wanted = members.filter(queries).select("id", F.struct("key", "key2").alias("both"))
    out = hot_aware_join(wanted, lists, "both", "n", n)
    out = out.select("id", F.posexplode(F.slice(F.expr("filter(list, x -> x.nbr <> id)"), 1, k)).alias("rank", "x"))
    return out.select("id", F.col("x.nbr").alias("nbr"), (-F.col("x.d")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


TABLES = (("keyword", "keywords", "keyword_id"), ("paragraph", "paragraphs", "paragraph_id"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Pairs within keywords or paragraphs of cosine >= 0.88, one among the ten most similar of the other."""
    out = None
    for kind, table, key in TABLES:
        near = nearest(load(spark, sf_dir, table).select(F.col(key).alias("id"), F.col("embedding").alias("v")))
        pairs = near.select(F.lit(kind).alias("kind"), F.least("id", "nbr").alias("id_a"), F.greatest("id", "nbr").alias("id_b")).distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p7_neighbours(spark, sf_dir: str) -> DataFrame:
    """For every usable paragraph whose id is divisible by 20 its ten most similar paragraphs of cosine >= 0.88."""
    rows = load(spark, sf_dir, "paragraphs").select(F.col("paragraph_id").alias("id"), F.col("embedding").alias("v"))
    near = nearest(rows, queries="id % 20 = 0")
    return near.select(F.col("id").alias("paragraph_id"), "rank", F.col("nbr").alias("neighbour_id"), F.round("similarity", 5).alias("similarity"))


QUERIES = {"p7_found": p7_found, "p7_neighbours": p7_neighbours}

_RANKED = """
with v as ({rows}),
u as (select kind, id, v from v where len(v) = 64 and len(list_filter(v, lambda x: x <> 0)) > 0 and len(list_filter(v, lambda x: x is null or isnan(x))) = 0),
w as (select kind, id, v, sqrt(list_dot_product(v, v)) as n from u),
s as (select a.kind, a.id, b.id as nbr, list_dot_product(a.v, b.v) / (a.n * b.n) as sim from w a join w b on a.kind = b.kind and a.id <> b.id),
r as (select *, row_number() over (partition by kind, id order by round(sim, 7) desc, nbr) as rank from s where sim >= 0.88)
"""
_BOTH = "select 'keyword' as kind, keyword_id as id, embedding::double[] as v from keywords union all select 'paragraph', paragraph_id, embedding::double[] from paragraphs"
SQL = {
    "p7_found": _RANKED.format(rows=_BOTH) + "select distinct kind, least(id, nbr) as id_a, greatest(id, nbr) as id_b from r where rank <= 10",
    "p7_neighbours": _RANKED.format(rows="select 'paragraph' as kind, paragraph_id as id, embedding::double[] as v from paragraphs") + "select id as paragraph_id, rank::int as rank, nbr as neighbour_id, round(sim, 5) as similarity from r where rank <= 10 and id % 20 = 0",
}
