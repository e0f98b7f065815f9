"""Vector expressions on arrays of numbers, computed in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is null, empty, zero, holds nulls or has another length."""
    value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value).otherwise(0.0)


def hash_vector(text: Column, dim: int = 64) -> Column:
    """A unit vector made of a text's SHA-256 values: the default embedding where no model is plugged in."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(F.sha2(F.concat(text.cast("binary"), F.unhex(F.lit("00")), i.cast("string").cast("binary")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0 * 2 - 1)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / norm)


def parse_vector(c: Column) -> Column:
    """[v, ...] as text made an array of floats."""
    return F.from_json(c, "array<float>")


def vector_literal(c: Column) -> Column:
    """An array of numbers as [v,...]."""
    return F.to_json(c)


#: Queries that go to every task at once; more are asked block by block.
QUERY_BLOCK = 100_000
#: Queries scored by one matrix product.
ROWS = 512


def norm(a: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(dot(a, a))


def query_blocks(queries: DataFrame, key: str, block: int = QUERY_BLOCK) -> list[DataFrame]:
    """The queries dealt by a hash of ``key`` into blocks of about ``block`` rows, each small enough for the driver."""
    n = queries.count()
    blocks = -(-n // block)
    return [queries.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)) == b) if blocks > 1 else queries for b in range(blocks)]


def top_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest values of each row and of all that equal the k-th; the caller ranks them."""
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return np.nonzero(s >= kth[:, None])
    return np.nonzero(np.ones(s.shape, bool))


def best_matches(queries: DataFrame, vectors: DataFrame, floor: float | None, k: int) -> DataFrame:
    """Exact top ``k`` of vectors(id, v) for each of queries(query_id, q): (query_id, id, similarity, rank).

    The queries go to every task in blocks of QUERY_BLOCK and are scored by matrix
    products.  Each task keeps its own k best per query, so what is shuffled does not grow
    with the collection.  Null, zero or ill-sized vectors match nothing; ties go to the
    smaller id.
    """
    asked_of = queries.filter("q is not null")
    kind = dict(queries.dtypes)["query_id"]
    least = -2.0 if floor is None else floor
    schema = f"query_id {kind}, id long, similarity double"
    out = queries.sparkSession.createDataFrame([], schema)
    for block in query_blocks(asked_of, "query_id"):
        asked = block.select("query_id", "q").toPandas()
        dims = asked["q"].map(len)
        asked = asked[dims == dims.mode().iloc[0]] if len(asked) else asked
        qs = np.stack(asked["q"]).astype("f8") if len(asked) else np.zeros((0, 1))
        norms = np.linalg.norm(qs, axis=1)
        ids, qs = asked["query_id"].to_numpy()[norms > 0], qs[norms > 0] / norms[norms > 0, None]

        def score(batches, ids=ids, qs=qs):
            for pdf in batches:
                ok = pdf[pdf["v"].map(lambda v: v is not None and len(v) == qs.shape[1])]
                if not len(ok) or not len(qs):
                    continue
                m = np.stack(ok["v"]).astype("f8")
                n = np.linalg.norm(m, axis=1)
                m, own = m[n > 0] / n[n > 0, None], ok["id"].to_numpy()[n > 0]
                for at in range(0, len(qs), ROWS):
                    s = np.round(qs[at:at + ROWS] @ m.T, 9)
                    i, j = top_columns(s, k)
                    keep = s[i, j] >= least
                    yield pd.DataFrame({"query_id": ids[at + i[keep]], "id": own[j[keep]], "similarity": s[i[keep], j[keep]]})

        out = out.unionByName(vectors.filter("id is not null and v is not null").select("id", "v").mapInPandas(score, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)
