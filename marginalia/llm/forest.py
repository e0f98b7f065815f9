"""Spanning forests of large graphs by Borůvka rounds of minimum-edge contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.storage import drop_table, persist_table

MAX_ROUNDS = 40


def _roots(parent: DataFrame, tag: str) -> DataFrame:
    """(node, root) from (node, up): follow the pointers, twice as far in every step, until all end in a root."""
    parent = persist_table(parent, tag)
    for _ in range(MAX_ROUNDS):
        up = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        step = parent.join(up, "up", "left").select("node", F.coalesce("upper", "up").alias("next"), "up")
        step = persist_table(step, tag)
        moved = not step.filter(F.col("next") != F.col("up")).isEmpty()
        drop_table(parent)
        parent = step.select("node", F.col("next").alias("up"))
        if not moved:
            break
    return parent.select("node", F.col("up").alias("root"))


def spanning_forest(edges: DataFrame, tag: str = "forest") -> tuple[DataFrame, DataFrame]:
    """(forest, components) of the undirected edges(u, v, w): a minimum spanning forest.

    In each round every component takes its least edge by (w, u, v), the taken edges are
    contracted, and parallel edges are reduced to the least; rounds at least halve the
    components that have edges left.  forest(u, v, w) are the taken edges, components
    (node, root) covers every node that has an edge, root being a node of the component.
    Both are tables in the shared folder.  Loops and null ends are dropped, repeated edges
    count once, and no edges give two empty tables.
    """
    e = edges.filter("u is not null and v is not null and u <> v")
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    e = e.select(lo.alias("a"), hi.alias("b"), F.struct(F.col("w"), lo.alias("u"), hi.alias("v")).alias("e"))
    e = persist_table(e.groupBy("a", "b").agg(F.min("e").alias("e")), tag)
    taken, labels = None, None
    for _ in range(MAX_ROUNDS):
        ends = e.select(F.col("a").alias("node"), F.struct("e", F.col("b").alias("to")).alias("x")).unionByName(e.select(F.col("b").alias("node"), F.struct("e", F.col("a").alias("to")).alias("x")))
        best = persist_table(ends.groupBy("node").agg(F.min("x").alias("x")).select("node", F.col("x.to").alias("up"), F.col("x.e").alias("e")), tag)
        won = best.select("e.*").distinct()
        taken = won if taken is None else taken.unionByName(won)
        # Edges are totally ordered, so the only cycles are two components that chose the same edge; the lesser is the root.
        back = best.select(F.col("node").alias("up"), F.col("up").alias("again"))
        parent = best.select("node", "up").join(back, "up", "left").select("node", F.when((F.col("again") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up"))
        roots = _roots(parent, tag)
        if labels is None:
            labels = roots
        else:
            after = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = persist_table(labels.join(after, "root", "left").select("node", F.coalesce("next", "root").alias("root")), tag)
        na, nb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e2 = e.join(na, "a").join(nb, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "e")
        e2 = persist_table(e2.groupBy("a", "b").agg(F.min("e").alias("e")), tag)
        drop_table(e)
        e = e2
        if e.isEmpty():
            break
    return taken, labels


def star_edges(links: DataFrame, buckets: int = 256) -> DataFrame:
    """Edges (u, v, w) that connect the nodes of every hub of links(node, hub) without the hub.

    Each node is tied to the least node of its bucket of the hub, and each bucket's least
    node to the hub's, so a hub of any size gives no node more than its bucket's share.
    """
    b = F.pmod(F.xxhash64("node"), F.lit(buckets))
    links = links.filter("node is not null and hub is not null").distinct().withColumn("bucket", b)
    part = links.groupBy("hub", "bucket").agg(F.min("node").alias("v"))
    top = part.groupBy("hub").agg(F.min("v").alias("top"))
    inner = links.join(part, ["hub", "bucket"]).select(F.col("node").alias("u"), "v")
    outer = part.join(top, "hub").select(F.col("v").alias("u"), F.col("top").alias("v"))
    return inner.unionByName(outer).filter("u <> v").distinct().withColumn("w", F.lit(1))
