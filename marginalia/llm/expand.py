"""Groups and pairs of groups expanded into pairs of their members, in tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a chunk: a key of the joins below holds the pairs of two chunks.
CHUNK = 512


def chunked(members: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(members with chunk, sizes) of members(key, rid): sizes(key, chunks) holds the keys of more than one chunk."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    sizes = sizes.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    # A member's chunk is taken from its hash modulo the chunks of its key, which at most 1 / chunk of the members have.
    rows = members.join(sizes, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(23)), F.col("chunks")).cast("int")), sizes


def pairs_within(rows: DataFrame) -> DataFrame:
    """(r1 < r2) of every key of rows(key, rid, chunk, chunks): each two chunks of a key meet in a key of the join of their own."""
    many = rows.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    many = many.select("key", "rid", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), (F.col("chunk") > F.col("other")).alias("second"))
    a, b = many.alias("a"), many.alias("b")
    # Of two different chunks the one side is joined with the other; of one chunk each pair comes once by r1 < r2.
    on = "a.key = b.key and a.lo = b.lo and a.hi = b.hi and ((a.lo = a.hi and a.rid < b.rid) or (a.lo < a.hi and not a.second and b.second))"
    return a.join(b, F.expr(on)).select(F.least("a.rid", "b.rid").alias("r1"), F.greatest("a.rid", "b.rid").alias("r2"))


def pairs_across(rows: DataFrame, sizes: DataFrame, linked: DataFrame) -> DataFrame:
    """(r1, r2) of every two linked(key_a, key_b): a hot key's pairs are split over its chunks on both sides."""
    one = sizes.withColumnRenamed("chunks", "n_a").withColumnRenamed("key", "key_a")
    two = sizes.withColumnRenamed("chunks", "n_b").withColumnRenamed("key", "key_b")
    links = linked.select("key_a", "key_b").join(one, "key_a", "left").join(two, "key_b", "left").fillna(1, ["n_a", "n_b"])
    links = links.withColumn("chunk_a", F.explode(F.expr("sequence(0, n_a - 1)"))).withColumn("chunk_b", F.explode(F.expr("sequence(0, n_b - 1)")))
    left = rows.select(F.col("key").alias("key_a"), F.col("chunk").alias("chunk_a"), F.col("rid").alias("r1"))
    right = rows.select(F.col("key").alias("key_b"), F.col("chunk").alias("chunk_b"), F.col("rid").alias("r2"))
    return links.join(left, ["key_a", "chunk_a"]).join(right, ["key_b", "chunk_b"]).select("r1", "r2")
