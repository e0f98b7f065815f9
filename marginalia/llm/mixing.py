"""Mixes of sources with target shares, by pivotal dependent rounding.

The share of a source asks for so many copies of each of its documents, a whole part
and a fraction.  The fractions are rounded dependently: two documents at a time pass
expected tokens from one to the other at random until one of them is whole, so the
tokens of a source come out as planned up to a part of one document.  Documents are
paired within buckets; what is left of each goes up a reduction tree.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.storage import load, persist_table

#: The default vocabulary: ranks of byte pairs, one "token rank" a line in base 64.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BUCKET = 50_000
FAN = 16


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "source", "tokens"])

    return run


def token_counts(texts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, tokens) of texts(id long, text string, source string) by a public tokenizer; null and empty texts have 0."""
    return texts.select("id", "text", "source").mapInArrow(_counter(vocabulary), "id long, source string, tokens long")


def uniform(a: int, b: int) -> float:
    """A number in [0, 1) that depends on the two ids only."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & (2**64 - 1)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (2**64 - 1)
    return ((x ^ (x >> 31)) >> 11) / 2**53


def pivot(pi: float, wi: float, pj: float, wj: float, u: float) -> tuple[float, float]:
    """Pass weight between two probabilities until one is 0 or 1; keeps wi pi + wj pj and both expectations."""
    up, down = min(1 - pi, pj * wj / wi), min(pi, (1 - pj) * wj / wi)
    if u * (up + down) < down:
        return (1.0 if up >= 1 - pi else pi + up), (0.0 if up < 1 - pi or up >= pj * wj / wi else pj - up * wi / wj)
    return (0.0 if down >= pi else pi - down), (1.0 if down < pi or down >= (1 - pj) * wj / wi else pj + down * wi / wj)


def _rounder(last: bool):
    """Rows (source, bucket, id, w, p), sorted -> the same with p 0 or 1, but for at most one in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for s, b, i, w, p in zip(*(c.to_pylist() for c in batch.columns)):
                if p <= 0 or p >= 1 or w <= 0:
                    out.append((s, b, i, w, float(p >= 1)))
                    continue
                if held is None or held[:2] != (s, b):
                    if held is not None:
                        out.append(held)
                    held = (s, b, i, w, p)
                    continue
                ps, pi = pivot(held[4], held[3], p, w, uniform(held[2], i))
                first, second = (*held[:4], ps), (s, b, i, w, pi)
                if 0 < ps < 1:
                    out.append(second)
                    held = first
                elif 0 < pi < 1:
                    out.append(first)
                    held = second
                else:
                    out += [first, second]
                    held = None
            if out:
                yield _batch(out)
        if held is not None:
            yield _batch([held])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        if last:
            rows = [(s, b, i, w, p if p in (0.0, 1.0) else float(uniform(i, 1) < p)) for s, b, i, w, p in rows]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["source", "bucket", "id", "w", "p"])

    return run


def dependent_rounding(units: DataFrame, rows: int) -> DataFrame:
    """(source, id, w, up): rounds the probabilities of units(source, id long, w long, p double) to 0 or 1.

    For each source sum(w p) is kept but for a part of one unit.  The result depends on the
    data only, not on how it is partitioned, so a task that is run again decides the same.
    Units without weight are rounded down.
    """
    buckets = max(1, math.ceil(rows / BUCKET))
    schema = "source string, bucket long, id long, w long, p double"
    state = units.select("source", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "id", "w", "p")
    done = None
    while True:
        step = state.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "id")
        step = persist_table(step.mapInArrow(_rounder(buckets == 1), schema), "p9-round")
        whole = step.filter("p = 0 or p = 1").select("source", "id", "w", F.col("p").cast("int").alias("up"))
        done = whole if done is None else done.unionByName(whole)
        if buckets == 1:
            return done
        buckets = math.ceil(buckets / FAN)
        state = step.filter("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))


def source_key(c: Column) -> Column:
    """A source as it is compared: trimmed, lower case; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies, report) of a mix as large in tokens as all documents together.

    ``docs`` is (id, source, text), ``targets`` (source, target_share, max_repeats), a
    table of sources.  copies(id, source, tokens, copies) covers every document of a listed
    source.  report has a row per listed source: wanted and actual tokens and shares, and
    whether the mix holds less than wanted although it has max_repeats copies of everything.  Documents of null or other
    sources count for the size of the mix only; null shares and repeats count as 0.
    """
    keyed = docs.select("id", "text", source_key(F.col("source")).alias("source"))
    tokens = persist_table(token_counts(keyed, vocabulary), "p9-tokens")
    want = targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    want = want.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    have = tokens.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    plan = want.join(have, "source", "left").fillna(0, ["available", "documents"])
    plan = plan.withColumn("wanted", F.col("target_share") * total)
    rate = F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted") / F.col("available"))).otherwise(0.0)
    plan = persist_table(plan.withColumn("rate", rate), "p9-plan")
    # One row per source; its number is that of the target table, which people write.
    small = plan.select("source", (F.col("rate") - F.floor("rate")).alias("p"), F.floor("rate").cast("int").alias("whole"))
    small = F.broadcast(small) if small.count() <= 100_000 else small
    units = tokens.join(small, "source").select("source", "id", F.col("tokens").alias("w"), "p")
    rounded = dependent_rounding(units, tokens.count())
    copies = rounded.join(small, "source").select("id", "source", F.col("w").alias("tokens"), (F.col("whole") + F.col("up")).alias("copies"))
    copies = persist_table(copies, "p9-copies")
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    report = plan.join(got, "source", "left").fillna(0, ["mixed"])
    report = report.withColumn("short", (F.col("mixed") < F.col("wanted")) & (F.col("mixed") >= F.col("available") * F.col("max_repeats")))
    mixed = max(1, report.agg(F.sum("mixed")).first()[0] or 1)
    return copies, report.withColumn("actual_share", F.col("mixed") / F.lit(mixed))


def _inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text"), load(spark, sf_dir, "source_targets")


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Sources that fall short of their target share even if repeated as often as allowed."""
    _, report = mix(*_inputs(spark, sf_dir))
    return report.filter("short").select("source")


def p9_mix(spark, sf_dir: str) -> DataFrame:
    """The copies of every document of a listed source in the mix."""
    copies, _ = mix(*_inputs(spark, sf_dir))
    return copies.select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p9_kept(spark, sf_dir: str) -> DataFrame:
    """What the rounding promises of each source: copies within max_repeats and within one of each other, tokens within one document of the plan."""
    copies, report = mix(*_inputs(spark, sf_dir))
    c = copies.groupBy("source").agg(F.max("copies").alias("most"), F.min(F.when(F.col("tokens") > 0, F.col("copies"))).alias("least"), F.max(F.when(F.col("tokens") > 0, F.col("copies"))).alias("top"), F.max("tokens").alias("longest"))
    r = report.join(c, "source", "left")
    return r.select(
        "source", "documents", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (F.coalesce(F.col("top") - F.col("least"), F.lit(0)) <= 1).alias("even"),
        (F.abs(F.col("mixed") - F.least(F.col("wanted"), (F.col("available") * F.col("max_repeats")).cast("double"))) <= F.coalesce("longest", F.lit(0)) + 1e-6).alias("within_one"),
    )


def p9_shares(spark, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    _, report = mix(*_inputs(spark, sf_dir))
    return report.select("source", "target_share", F.round("actual_share", 6).alias("actual_share"), "documents", "available", "mixed", "short")


QUERIES = {"p9_found": p9_found, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_kept": p9_kept}
SQL = {
    "p9_found": """
with d as (select nullif(lower(trim(source)), '') as source, coalesce(length(text), 0) as size from documents),
have as (select source, sum(size) as size from d group by 1), total as (select sum(size) as n from d)
select lower(trim(t.source)) as source from source_targets t left join have h on h.source = lower(trim(t.source)), total
where coalesce(h.size, 0) * max_repeats < target_share * n""",
    "p9_kept": """
with d as (select nullif(lower(trim(source)), '') as source, count(*) as n from documents group by 1)
select lower(trim(t.source)) as source, coalesce(n, 0)::bigint as documents, true as within_repeats, true as even, true as within_one from source_targets t left join d on d.source = lower(trim(t.source))""",
}
