"""Evaluation passages inside training documents, by greedy string tiling.

The passages are the stated query set: blocks of them with a bounded number of words go
to every task, and every document meets every block once, so no document is shuffled.
A document's runs of three words that a passage has too bound what tiles can hold; where
the bound allows a leak, document and passage are tiled: the longest common runs that do
not overlap are marked one after the other, found by running Karp-Rabin hashes of falling
length.  The tiles give the share of the passage the document holds in any order, and the
longest run that a few changed words interrupt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.storage import load

TILE = 3
#: Words that may differ between two tiles of one run.
GAP = 4
#: A leading sentence that this many passages with different rests share is an instruction.
SHARED = 3
#: Characters of passages in a block; a block goes to every task.
BLOCK = 8_000_000
_P = (1 << 61) - 1
_B = 1_000_003

_PLAIN = re.compile(r"[a-z0-9]+")
_ANY = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[[\p{L}\p{N}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]+", regex.V1)


def words(text: str | None) -> list[str]:
    """Lower-case words; in scripts without spaces every character is one.  Null gives none."""
    low = (text or "").lower()
    return _PLAIN.findall(low) if low.isascii() else _ANY.findall(low)


def _prefix(t: list) -> list[int]:
    out = [0]
    for x in t:
        out.append((out[-1] * _B + hash(x)) % _P)
    return out


def _common_runs(a: list, b: list, n: int) -> list[bool]:
    """Whether each word of ``a`` lies in a run of ``n`` words that ``b`` has too."""
    there = set(zip(*(b[i:] for i in range(n))))
    out = [False] * len(a)
    for i, run in enumerate(zip(*(a[i:] for i in range(n)))):
        if run in there:
            out[i:i + n] = [True] * n
    return out


def tiles(a: list, b: list, shortest: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first, none overlapping another.

    The search length falls from half of the shorter text to ``shortest`` and goes up again
    when a run of more than twice the length is met, as in running Karp-Rabin matching.
    Words in no common run of ``shortest`` words can be in no tile and are never free.
    """
    if not a or not b:
        return []
    free_a, free_b = _common_runs(a, b, shortest), _common_runs(b, a, shortest)
    ha, hb = _prefix(a), _prefix(b)
    powers = [1]
    for _ in range(max(len(a), len(b))):
        powers.append(powers[-1] * _B % _P)
    out: list[tuple[int, int, int]] = []
    s = max(shortest, min(len(a), len(b)) // 2)
    while True:
        table: dict[int, list[int]] = {}
        run = 0
        for j in range(len(b)):
            run = run + 1 if free_b[j] else 0
            if run >= s:
                at = j - s + 1
                table.setdefault((hb[j + 1] - hb[at] * powers[s]) % _P, []).append(at)
        found: list[tuple[int, int, int]] = []
        longest, run = 0, 0
        for i in range(len(a)):
            run = run + 1 if free_a[i] else 0
            if run < s:
                continue
            at = i - s + 1
            for j in table.get((ha[i + 1] - ha[at] * powers[s]) % _P, ()):
                k = 0
                while at + k < len(a) and j + k < len(b) and a[at + k] == b[j + k] and free_a[at + k] and free_b[j + k]:
                    k += 1
                if k >= s:
                    found.append((k, at, j))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        for k, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if all(free_a[i:i + k]) and all(free_b[j:j + k]):
                out.append((i, j, k))
                free_a[i:i + k] = [False] * k
                free_b[j:j + k] = [False] * k
        if s <= shortest:
            return out
        # A run that lost a part of itself to a longer one may still be left at its remaining length.
        s = max(shortest, s // 2)


def longest_run(found: list[tuple[int, int, int]], gap: int = GAP) -> tuple[int, int]:
    """(words spanned in a, words of them in tiles) of the longest chain of tiles in the same order with small gaps."""
    best = (0, 0)
    chains: list[tuple[int, int, int, int]] = []
    for i, j, k in sorted(found):
        mine = (i + k, j + k, i, k)
        for end_a, end_b, start, held in chains:
            da, db = i - end_a, j - end_b
            if 0 <= da <= gap and 0 <= db <= gap and abs(da - db) <= 2 and i + k - start > i + k - mine[2]:
                mine = (i + k, j + k, start, held + k)
        chains.append(mine)
        best = max(best, (mine[0] - mine[2], mine[3]))
    return best


class Index:
    """Where the runs of TILE words of a block of passages stand."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        # Words as numbers from 1 on; 0 is a word that no passage has.
        self.words = [[self.number.setdefault(w, len(self.number) + 1) for w in t] for _, t in items]
        self.size = np.array([len(t) for t in self.words], "i8")
        where = [(self.runs(np.array(t, "i8")), n) for n, t in enumerate(self.words)]
        runs = np.concatenate([r for r, _ in where]) if where else np.zeros(0, "i8")
        item = np.repeat(np.arange(len(where)), [len(r) for r, _ in where])
        at = np.concatenate([np.arange(len(r)) for r, _ in where]) if where else np.zeros(0, "i8")
        order = np.argsort(runs, kind="stable")
        self.run, self.item, self.at = runs[order], item[order], at[order]
        self.least_size = int(self.size.min()) if len(self.size) else 0
        self.longest = int(self.size.max()) if len(self.size) else 0

    @staticmethod
    def runs(t: np.ndarray) -> np.ndarray:
        """The runs of TILE words as numbers; 0 where one of the words is unknown.  Shorter texts have none."""
        if len(t) < TILE:
            return np.zeros(0, "i8")
        known, out = np.ones(len(t) - TILE + 1, bool), np.zeros(len(t) - TILE + 1, "i8")
        for i in range(TILE):
            part = t[i:len(t) - TILE + 1 + i]
            known &= part > 0
            out = out * np.int64(0x1000003D) ^ part * np.int64(0x5BD1E995)
        return np.where(known, out | 1, 0)

    def held(self, runs: np.ndarray) -> np.ndarray:
        """Words of each passage that lie in one of the runs: at least what tiles can hold."""
        runs = np.unique(runs)
        lo, hi = np.searchsorted(self.run, runs), np.searchsorted(self.run, runs, "right")
        n = hi - lo
        some = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        # The places that any run covers, each once for each passage.
        spots = np.unique((self.item[some] * (self.longest + 1) + self.at[some])[:, None] + np.arange(TILE))
        return np.bincount(spots // (self.longest + 1), minlength=len(self.ids))


def _tiler(items: list[tuple[int, list[str]]], least: float):
    """doc_id, text -> the leaks of the passages in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = Index(items)
        get = ix.number.get
        for batch in batches:
            docs = [words(t) for t in batch.column(1).to_pylist()]
            size = np.array([len(t) for t in docs], "i8")
            flat = np.fromiter((get(w, 0) for t in docs for w in t), "i8", int(size.sum()))
            end = np.cumsum(size)
            # Runs of the whole batch; those over the end of a document belong to none.
            runs = ix.runs(flat)
            doc = np.repeat(np.arange(len(docs)), size)
            inside = (doc[:len(runs)] == doc[TILE - 1:]) & (runs != 0) if len(runs) else np.zeros(0, bool)
            at = np.flatnonzero(inside)
            spot = np.minimum(np.searchsorted(ix.run, runs[at]), max(0, len(ix.run) - 1))
            at = at[ix.run[spot] == runs[at]] if len(ix.run) else at[:0]
            out = []
            few = max(1.0, least * ix.least_size - TILE + 1) / TILE
            for d in np.flatnonzero(np.bincount(doc[at], minlength=len(docs)) >= few) if len(at) else ():
                lo, hi = np.searchsorted(at, [end[d] - size[d], end[d]])
                held = ix.held(runs[at[lo:hi]])
                for n in np.flatnonzero((held >= least * ix.size) & (held > 0)):
                    p, text = ix.words[n], flat[end[d] - size[d]:end[d]].tolist()
                    found = tiles(p, text)
                    span, kept = longest_run(found)
                    out.append((batch.column(0)[int(d)].as_py(), ix.ids[n], sum(k for _, _, k in found) / len(p), span / len(p), kept / len(p)))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "coverage", "run", "held"])

    return run


def without_instruction(items: DataFrame) -> DataFrame:
    """(item_id, passage) of items(item_id, passage), without a leading sentence that passages with different rests share."""
    lead = F.regexp_extract("passage", r"^\s*([^.!?。！？]+[.!?。！？]+)\s+\S", 1)
    items = items.filter("item_id is not null and passage is not null").select("item_id", "passage", lead.alias("lead"))
    items = items.withColumn("rest", F.expr("substring(ltrim(passage), length(ltrim(lead)) + 1)"))
    bare = F.regexp_replace(F.lower("rest"), r"[^\p{L}\p{N}]+", "")
    shared = items.filter("lead <> ''").groupBy("lead").agg(F.count_distinct(bare).alias("n")).filter(F.col("n") >= SHARED).select("lead", F.lit(True).alias("cut"))
    items = items.join(shared, "lead", "left")
    return items.select("item_id", F.when(F.col("cut"), F.col("rest")).otherwise(F.col("passage")).alias("passage"))


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.35) -> DataFrame:
    """(doc_id, item_id, coverage, run, held) of every document and item where tiles may hold at least ``least`` of the item.

    coverage is the share of the item's words in tiles, run the share that the longest run
    spans, held the share of words of that run that are in tiles.  Null texts and passages
    have none, nor have passages of fewer than three words.  Passages of more than BLOCK
    characters in all are searched block by block, each against all documents.
    """
    items = without_instruction(items)
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK
    out = None
    for b in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        found = docs.mapInArrow(_tiler([(i, t) for i, t in ((r[0], words(r[1])) for r in some) if len(t) >= TILE], least), "doc_id long, item_id long, coverage double, run double, held double")
        out = found if out is None else out.unionByName(found)
    return out


def p8_found(spark, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of an item's passage as one run, with the item."""
    out = leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "eval_items").select("item_id", "passage"))
    return out.filter("run >= 0.5 and held >= 0.35").select("doc_id", "item_id").distinct()


def p8_report(spark, sf_dir: str) -> DataFrame:
    """Per item: documents that hold half of it or more in any order, and the largest share any of them holds."""
    out = leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "eval_items").select("item_id", "passage"))
    return out.filter("coverage >= 0.5").groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("coverage"), 6).alias("largest_share"))


QUERIES = {"p8_found": p8_found, "p8_report": p8_report}
SQL: dict[str, str] = {}
