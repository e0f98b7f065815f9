"""Order-dependent algorithms on small groups, such as the blocks of a page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from marginalia.storage import persist_table


def per_group(df: DataFrame, keys: list[str], columns: list[str], order: list[str], fn: Callable[[dict, list[dict]], list[dict]], schema: str) -> DataFrame:
    """``fn(key, rows)`` for each group: rows in ``order``, dicts of ``columns``; gives rows of ``schema``.

    The groups are gathered by the JVM as arrays of structs, and whole batches of groups
    go through Python at once, so a group costs no round trip of its own.  For groups that
    are small by nature only: pages, documents.
    """
    names = list(dict.fromkeys([*order, *columns]))
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(c.replace(".", "_")) for c in names]))).alias("rows"))
    fields = _parse_datatype_string(schema)
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                out.extend(fn({k: r[k] for k in keys}, r["rows"]))
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return rows.mapInArrow(run, fields)


def numbered(df: DataFrame, within: list[str], order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with dense numbers from ``start`` + 1 on in ``order`` (``within`` the values of some columns).

    Rows are range-partitioned by the order and written; a partition's offset is the sum of
    the counts before it, so no task sees more than its own range.  ``order`` should be
    unique; equal rows are numbered in any order.
    """
    cols = [*within, *order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    at = persist_table(ranged.withColumn("_part", F.spark_partition_id()), "numbered")
    counts = at.groupBy("_part", *within).agg(F.count("*").alias("_m"))
    # A row per partition and value of ``within`` in it: one window over these few rows.
    before = Window.partitionBy(*(within or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    rank = F.row_number().over(Window.partitionBy("_part", *within).orderBy(*order))
    out = at.withColumn("_rank", rank)
    on = F.col("o._part") == F.col("a._part")
    for c in within:
        on = on & F.col(f"o.{c}").eqNullSafe(F.col(f"a.{c}"))
    out = out.alias("a").join(offsets.alias("o"), on).select("a.*", F.col("o._before").alias("_before"))
    return out.withColumn(name, F.lit(start) + F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")
