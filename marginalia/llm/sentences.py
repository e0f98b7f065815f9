"""Sentence boundaries by a hidden-event language model.

Between the words of a text lie events: boundary or none.  Marks carry most of what there
is to know, so a text is read in two ways.

Where marks are used, the events at gaps after closing punctuation outside of quotations
and brackets, and at white space in Thai, are hidden; gaps between words without a mark
have none.  The model has the probability of the event given the word before the gap, that
of what follows given the event, and that of the distance between neighbouring gaps given
both events.  It is trained on the whole corpus by expectation maximisation, started from
the gaps that are certain (ends of paragraphs, inner punctuation); forward-backward
posteriors decide.  The counts stay in tables, a row per word; a round brings to the driver
only sums by the kind of what follows, so nothing is left out however many words there are.

Stretches without any mark that are longer than sentences are have a hidden event between
any two words, or any two characters in scripts without spaces.  An n-gram model over words
with boundary tokens, counted on the marked part of the corpus by two aggregations, gives
the odds of each gap, the lengths of marked sentences those of each distance, and
forward-backward posteriors decide again.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.storage import load, persist_table

#: Occurrences from which the model tells a word before a gap, or one after it, apart; rarer ones count by their shape, so no gap is left out.
LEAST = 3
ROUNDS = 8
#: Chances are summed up as whole numbers of this part, so sums do not depend on their order.
UNIT = 1 << 24
CUTOFF = 0.5
#: Log odds of a word before a gap, and of what follows, are kept within these.
SURE, SWAY = 5.0, 2.5
#: Words, and characters of scripts without spaces, that no sentence of a text with marks has in a row without any.
LONG_WORDS, LONG_SIGNS = 80, 160
#: Longest distance to the last boundary that the model for unmarked stretches tells apart.
FAR = 120

# Marks that may end a sentence in all scripts; those of FULL always do, those of WIDE need no blank after them.
STOPS = ".!?…。！？।؟॥۔።፧፨։။។៕།༎"
FULL = "!?。！？।؟॥۔።፧፨։။។៕།༎"
WIDE = "。！？।॥።፧፨։။។៕།༎"
OPENERS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›", "(": ")", "（": "）", "[": "]"}
CLOSERS = "\"”“»」』›)）]’'"
_STOP = regex.compile(rf"[{STOPS}]+")
_BREAK = regex.compile(r"\n[^\S\n]*\n\s*")
_LEFT = regex.compile(r"(?r)[\p{L}\p{M}\p{N}º°'’.]*")
_RIGHT = regex.compile(r"[\p{L}\p{M}]+|\p{N}+|\S|$")
_THAI_GAP = regex.compile(r"(?<=\S)\s+(?=\S)")
_THAI = regex.compile(r"\p{Thai}")
#: A heading is a numbered line of at most about 80 characters.
_HEAD = regex.compile(r"(?:\d+(?:\.\d+)*\.?|[IVX]+\.)[^\S\n]+\S[^\n]{0,80}")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_SPECIAL = regex.compile(r"\n[^\S\n]*\n|[\"“„«‹「『(（\[”»」』)）\]]")
_SIGN = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"
_SIGNS = regex.compile(_SIGN)
#: A mark that could end a sentence where it stands, inside of a quotation too.
_USED = regex.compile(rf"[{STOPS}][{regex.escape(CLOSERS)}]*(?:\s|$)|[{WIDE}]")
_TOKEN = regex.compile(rf"{_SIGN}\p{{M}}*|[[\p{{L}}\p{{N}}\p{{M}}'’]--{_SIGN}]+", regex.V1)


def _quoted(text: str) -> list[tuple[int, int]]:
    """Outermost spans (open, close) of quotations and brackets that are closed within their paragraph."""
    spans, stack = [], []
    for m in _SPECIAL.finditer(text):
        i, ch = m.start(), text[m.start()]
        if ch == "\n":
            stack = []
        elif stack and ch in stack[-1][1]:
            start = stack.pop()[0]
            if not stack:
                spans.append((start, i))
        elif ch == '"':
            stack.append((i, '"'))
        elif ch in OPENERS:
            stack.append((i, OPENERS[ch]))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if ch in stack[k][1]:  # what was opened later and never closed is no quotation
                    start = stack[k][0]
                    del stack[k:]
                    if not stack:
                        spans.append((start, i))
                    break
    return spans


def _word_class(word: str) -> str:
    w = word.casefold().strip("'’")
    if not w:
        return "<none>"
    if w.replace(".", "").isdigit():
        return "<digits>" if len(w.strip(".")) <= 2 else "<number>"
    if len(w.rstrip(".")) == 1:
        return "<letter>" if w[0].isascii() else w
    return w if len(w) <= 6 or "." in w.rstrip(".") else "<long>"


def shape(context: str) -> str:
    """What a context falls back on: its word only by length, the rest kept."""
    word, _, rest = context.partition("\t")
    return ("<short>" if len(word) <= 3 else "<word>") + "\t" + rest


def gaps(text: str) -> list[tuple[int, str, str, int, int | None]]:
    """(end, before, after, words since the last gap, event if certain) of each gap that may be a boundary.

    end is the number of characters up to the gap.
    """
    spans = _quoted(text)
    opened = {a for a, _ in spans}
    found: list[tuple[int, str, str, int | None]] = []
    at = 0

    n = len(text)

    def after(end: int) -> tuple[str, str, str]:
        k = end
        while k < n and text[k].isspace():
            k += 1
        if k == n:
            return "end", "<end>", "<end>"
        space = text[end:k]
        s = "none" if not space else "blank" if "\n" not in space else "par" if space.count("\n") > 1 else "line"
        nxt = _RIGHT.match(text, k).group()
        c = nxt[0]
        if not c.isalpha():
            return s, "digit" if c.isnumeric() else c, ""
        kind = "upper" if c.isupper() or c.istitle() else "lower" if c.islower() else "letter"
        return s, kind, nxt[:2] if s == "none" and not c.isascii() or _CJK.match(nxt) else nxt.casefold()

    for m in _STOP.finditer(text):
        i, j = m.span()
        while at < len(spans) and spans[at][1] < i:
            at += 1
        end = j
        if at < len(spans) and spans[at][0] < i:
            close = spans[at][1]
            inner = text[j:close + 1]
            if text[spans[at][0]] in "(（[" or any(c not in CLOSERS for c in inner):
                continue  # inside of a quotation or of brackets
            end = close + 1
        while end < len(text) and text[end] in "\"”»」』›)）]’'" and end not in opened:
            end += 1
        mark = m.group()
        s, kind, word = after(end)
        wide = mark[-1] in WIDE
        if s == "none" and end == j and not wide and (kind in ("lower", "digit") or kind in ",;:-/" or mark == "." and kind == "letter" and not text[i - 1:i].isalpha()):
            continue  # within a word or number
        left = _LEFT.match(text, max(0, i - 24), i).group()
        word_before = _word_class(left) if mark == "." else "<none>"
        p = "dots" if len(mark) > 1 and set(mark) <= {".", "…"} or mark == "…" else "full" if any(c in FULL for c in mark) else "dot"
        closing = text[end - 1] if end > j else ""
        before = f"{word_before}\t{p}\t{closing}{'+' if closing and s == 'none' else ''}"
        what = f"{s}\t{kind}\t{word}"
        event = None
        if p != "dots" and s in ("par", "end"):
            event = 1
        elif p == "full" and not closing and (s != "none" or wide):
            event = 1
        elif kind in (",", ";", ":", ")", "-"):
            event = 0
        found.append((end, before, what, event))
    # Headings: a numbered line of its own at the start of a paragraph, without a stop.
    start, headings = 0, []
    for m in [*_BREAK.finditer(text), None]:
        while start < len(text) and text[start].isspace():
            start += 1
        line = _HEAD.match(text, start)
        if line and line.end() < len(text) and text[line.end()] == "\n" and line.group().rstrip()[-1] not in STOPS + ",;:":
            headings.append((line.start(), line.start() + len(line.group().rstrip())))
        if m is None:
            break
        start = m.end()
    if headings:
        at, kept = 0, []
        for f in found:
            while at < len(headings) and headings[at][1] < f[0]:
                at += 1
            if at == len(headings) or f[0] <= headings[at][0]:
                kept.append(f)
        found = kept + [(end, "<heading>\thead\t", "line\t\t", 1) for _, end in headings]
    if not text.isascii() and _THAI.search(text):
        there, at = {f[0] for f in found}, 0
        for m in _THAI_GAP.finditer(text):
            a, b = text[m.start() - 1], text[m.end()]
            if not (_THAI.match(a) or _THAI.match(b)) or a in STOPS + CLOSERS:
                continue
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            if at < len(spans) and spans[at][0] < m.start() or m.start() in there:
                continue
            par = m.group().count("\n") > 1
            side = lambda c: "thai" if _THAI.match(c) else "word" if c.isascii() and c.isalnum() else "other"
            sides = (side(a), side(b))
            event = 1 if par else 0 if "word" in sides else 1 if sides == ("thai", "thai") else None
            found.append((m.start(), f"<space>\tthai\t{sides[0]}", f"{'par' if par else 'blank'}\t{sides[1]}\t", event))
    found.sort()
    out, last = [], 0
    cjk = not text.isascii() and _CJK.search(text) is not None
    for end, before, what, event in found:
        out.append((end, before, what, 4 if cjk and _CJK.search(text, last, end) else min(3, len(text[last:end].split()) // 2), event))
        last = end
    return out


def unmarked(text: str, found: list[tuple]) -> list[tuple[int, int]]:
    """(start, end) of the stretches between neighbouring gaps that are too long for one sentence and have no mark inside."""
    out, last = [], 0
    for end in [*(g[0] for g in found), len(text)]:
        if end - last > LONG_SIGNS:
            part = text[last:end]
            if (len(part.split()) > LONG_WORDS or len(_SIGNS.findall(part)) > LONG_SIGNS) and not _USED.search(part[:-1]):
                out.append((last, end))
        last = end
    return out


def _observer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (before, after, event if certain), of (distance, events), and of unmarked stretches, in the texts of a partition."""
    pairs: Counter = Counter()

    def flush():
        rows = [(*k, n) for k, n in pairs.items()]
        pairs.clear()
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["before", "what", "event", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            prev = 1
            found = gaps(text or "")
            for _, before, what, dist, event in found:
                pairs[before, what, -1 if event is None else event] += 1
                # Distances are also learned where the case of the next word leaves little doubt.
                likely = event if event is not None else 0 if what.split("\t")[1] in ("lower", "digit", "(") else None
                if likely is not None and prev is not None and dist < 4:
                    pairs["<distance>", f"{dist}\t{prev}", likely] += 1
                prev = likely
            if text and unmarked(text, found):
                pairs["<unmarked>", "", 0] += 1
        if len(pairs) > 200_000:
            yield flush()
    if pairs:
        yield flush()


def group(follow: str) -> str:
    """Words in scripts with and without case are told apart before they are compared."""
    return "letter" if follow.endswith("\tletter") else "thai" if follow.endswith(("\tthai", "\tword")) else "cased"


class Priors:
    """Log odds of a boundary by the word before a gap alone.

    A word that ends sentences also ends paragraphs, at a rate that long words show; an
    abbreviation never does.  The counts decide between the two for each word before a gap.
    ``common`` has (name, all gaps, those that end a paragraph) of shapes and long words, a few.
    """

    def __init__(self, common: Iterable[tuple[str, int, int]]):
        common = list(common)
        long = [x for x in common if x[0].startswith(("<long>", "<word>"))]
        rate = (sum(sure for _, _, sure in long) + 1) / (sum(every for _, every, _ in long) + 10) / 3
        self.gain, self.loss = math.log(rate / 0.002) if rate > 0.002 else 0.0, min(0.0, math.log((1 - rate) / (1 - 0.002)))
        self.shapes: dict[str, float] = {}
        for start in ("<word>", "<short>"):  # short words fall back on all
            for name, every, sure in common:
                if name.startswith(start):
                    self.shapes[name] = self.of(name, every, sure)

    def of(self, name: str, every: int, sure: int) -> float:
        odds = self.shapes.get(shape(name), 1.5) / 2 + sure * self.gain + (every - sure) * self.loss
        return 0.0 if name.endswith("+") else max(-SURE, min(SURE, odds))

    def table(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """name, every, sure -> name, key, prior."""
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            prior = [self.shapes[r[0]] if r[0] in self.shapes else self.of(*r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([key_of(r[0]) for r in rows], pa.int64()), pa.array(prior, pa.float64())], ["name", "key", "prior"])


def key_of(name: str) -> int:
    return int.from_bytes(blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Scores:
    """Log odds by name in 16 bytes each: names are kept as 64 bits of their hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.lexsort((values, keys))
        self.keys, self.values = keys[order], values[order]

    def get(self, name: str) -> float | None:
        key = key_of(name)
        i = int(self.keys.searchsorted(key))
        return float(self.values[i]) if i < len(self.keys) and self.keys[i] == key else None


class Follows:
    """Log odds of what follows a gap by its kind, from (on, off) of each kind: chances with and without a boundary, in UNITs."""

    def __init__(self, sums: dict[str, tuple[int, int]]):
        every = defaultdict(lambda: [0, 0])
        for f, (on, off) in sums.items():
            every[group(f)][0] += on
            every[group(f)][1] += off
        # Once for the kind and once for the word.
        self.every = {g: 2 * (math.log(off / UNIT + 1) - math.log(on / UNIT + 1)) for g, (on, off) in every.items()}
        self.kinds = {f: math.log(on / UNIT + 0.5) - math.log(off / UNIT + 0.5) + self.every[group(f)] for f, (on, off) in sums.items()}

    def get(self, follow: str) -> float:
        x = self.kinds.get(follow)
        return self.every.get(group(follow), 0.0) if x is None else x


_CELLS = "array<struct<follow:string,plus:boolean,prior:double,event:int,n:bigint>>"
_GUESS = {"upper": 0.8, "lower": 0.1, "digit": 0.2, "letter": 0.8}


def _chances(cells: pa.ListArray, before: list[Follows]):
    """Chances of each cell of each word after the rounds ``before``: (start of each word, kinds, kind of each cell, on, off), in UNITs.

    What a word says depends on its own cells and on the sums by kind alone, so a round can
    be followed word by word from the first one on.
    """
    sizes = cells.value_lengths().to_numpy()
    follow, plus, prior, event, n = cells.flatten().flatten()
    follow = follow.dictionary_encode()
    kinds, kind = follow.dictionary.to_pylist(), follow.indices.to_numpy()
    plus, prior, event, n = (x.to_numpy(zero_copy_only=False) for x in (plus, prior, event, n))
    starts, word, most = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), np.where(plus, SURE, SWAY)
    guess = np.array([_GUESS.get(k.split("\t")[1], 0.5) for k in kinds])
    p = np.where(plus, 0.1, guess[kind] / (1 + np.exp(-prior)))

    def parts():
        on = np.rint(np.where(event >= 0, event, p) * UNIT).astype("i8") * n
        return on, n * UNIT - on

    for follows in before:
        # What follows weighs most where the text goes on after a quotation without a blank.
        x = np.array([follows.get(k) for k in kinds])[kind] + _word_odds(starts, *parts())[word]
        p = 1 / (1 + np.exp(-prior - np.clip(x, -most, most)))
    return starts, kinds, kind, *parts()


def _word_odds(starts: np.ndarray, on: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.log(np.add.reduceat(on, starts) / UNIT + 0.5) - np.log(np.add.reduceat(off, starts) / UNIT + 0.5)


def _sums(before: list[Follows]):
    """word, cells -> kind of what follows, on, off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = defaultdict(lambda: [0, 0])
        for batch in batches:
            if batch.num_rows:
                _, kinds, kind, *parts = _chances(batch.column(1), before)
                for i, part in enumerate(parts):
                    total = np.zeros(len(kinds), "i8")
                    np.add.at(total, kind, part)
                    for k, x in zip(kinds, total.tolist()):
                        sums[k][i] += x
        if sums:
            on, off = zip(*sums.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(on, pa.int64()), pa.array(off, pa.int64())], ["follow", "on", "off"])

    return run


def _words(before: list[Follows]):
    """word, cells -> key, log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                starts, _, _, on, off = _chances(batch.column(1), before)
                yield pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in batch.column(0).to_pylist()], pa.int64()), pa.array(_word_odds(starts, on, off))], ["key", "odds"])

    return run


class Estimates(NamedTuple):
    """Log odds by the word before a gap and its shapes, by the word after it, and by the kind of what follows."""

    before: Scores
    words: Scores
    follows: Follows


def _rounds(sums: Callable[[list[Follows]], dict[str, tuple[int, int]]]) -> list[Follows]:
    """Expectation maximisation; ``sums`` gives the sums by kind after the rounds so far."""
    done: list[Follows] = []
    for _ in range(ROUNDS):
        done.append(Follows(sums(done)))
    return done


def _estimates_here(rows: list[tuple[str, str, int, int]]) -> Estimates:
    """:func:`_estimates` of counts in memory."""
    befores, words = Counter(), Counter()
    for b, w, _, n in rows:
        befores[b] += n
        words[w.rsplit("\t", 1)[1]] += n
    table: Counter = Counter()
    for b, w, e, n in rows:
        follow, word = w.rsplit("\t", 1)
        # A word that follows the same word once or twice counts as a rare one; the word before keeps its counts.
        kept = words[word] >= LEAST and (n >= LEAST or not word)
        table[b if befores[b] >= LEAST else shape(b), follow, word if kept else "<rare>", e] += n
    every, sure = Counter(), Counter()
    for k, n in table.items():
        for name in (k[0], shape(k[0])):
            every[name] += n
            sure[name] += n * (k[3] == 1)
    counts = [(name, n, sure[name]) for name, n in every.items()]
    priors = Priors(x for x in counts if x[0].startswith(_COMMON))
    prior = {name: priors.shapes[name] if name in priors.shapes else priors.of(name, n, s) for name, n, s in counts}
    cells: Counter = Counter()
    for (b, follow, word, e), n in table.items():
        cells[word, follow, b.endswith("+"), prior[b], e] += n
    by = defaultdict(list)
    for (word, *cell), n in cells.items():
        by[word].append(dict(zip(("follow", "plus", "prior", "event", "n"), (*cell, n))))
    kind = pa.list_(pa.struct([("follow", pa.string()), ("plus", pa.bool_()), ("prior", pa.float64()), ("event", pa.int32()), ("n", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array(list(by.values()), kind)], ["word", "cells"])
    done = _rounds(lambda before: {f: (on, off) for b in _sums(before)(iter([batch])) for f, on, off in zip(*(c.to_pylist() for c in b.columns))})
    odds = [(k, x) for b in _words(done[:-1])(iter([batch])) for k, x in zip(*(c.to_pylist() for c in b.columns))]
    scores = lambda pairs: Scores(np.array([k for k, _ in pairs], "i8"), np.array([x for _, x in pairs], "f8"))
    return Estimates(scores([(key_of(name), x) for name, x in prior.items()]), scores(odds), done[-1])


class Model:
    """Probabilities of the hidden events at marks.

    ``rows`` are (before, what, event, n); where ``estimates`` are given, only those of distances and unmarked stretches.
    """

    def __init__(self, rows: list[tuple[str, str, int, int]], estimates: Estimates | None = None):
        dist = [(w, e, n) for b, w, e, n in rows if b == "<distance>"]
        self.memo: dict[tuple[str, str], float] = {}
        self.unmarked = sum(n for b, _, _, n in rows if b == "<unmarked>")
        self.far = {}
        for prev in (0, 1):
            for event in (0, 1):
                got = Counter()
                for w, e, n in dist:
                    if e == event and w.endswith(f"\t{prev}"):
                        got[w.split("\t")[0]] += n
                total = sum(got.values()) + 4
                self.far[prev, event] = [0.8 * (got[str(d)] + 1) / total + 0.05 for d in range(4)] + [0.25]  # without blanks the distance says nothing
        self.estimates = estimates or _estimates_here([r for r in rows if r[0] not in ("<distance>", "<unmarked>")])

    def score(self, before: str, what: str) -> float:
        """Log odds of a boundary: event given the word before, then what follows given the event."""
        at, words, follows = self.estimates
        name = before
        for _ in range(3):  # the word, its shape, the shape of all
            prior = at.get(name)
            if prior is not None:
                break
            name = shape(name)
        # The ends of paragraphs and of lines differ in what they say, the word after them doesn't.
        follow, word = what.rsplit("\t", 1)
        x = words.get(word)
        x = follows.get(follow) + ((words.get("<rare>") or 0.0) if x is None else x)
        most = SURE if before.endswith("+") else SWAY
        return (prior or 0.0) + max(-most, min(most, x))

    def posterior(self, before: str, what: str) -> float:
        return 1 / (1 + math.exp(-self.score(before, what)))

    def ends(self, text: str, more: list[int] | None = None) -> list[int]:
        """Ends of the sentences: gaps whose forward-backward posterior reaches the cutoff, those of ``more``, and the end of the text."""
        g = gaps(text)
        emit, memo = [], self.memo
        if len(memo) > 200_000:  # only saves computing a score again
            memo.clear()
        for _, before, what, _, event in g:
            if event is None:
                x = memo.get((before, what))
                if x is None:
                    x = memo[before, what] = self.posterior(before, what)
            else:
                x = 0.9999 if event else 0.0001
            emit.append((max(1e-9, 1 - x), max(1e-9, x)))
        f00, f01, f10, f11 = self.far[0, 0], self.far[0, 1], self.far[1, 0], self.far[1, 1]
        fwd, s0, s1 = [], 0.0, 1.0
        for (_, _, _, d, _), (e0, e1) in zip(g, emit):
            n0, n1 = (s0 * f00[d] + s1 * f10[d]) * e0, (s0 * f01[d] + s1 * f11[d]) * e1
            z = n0 + n1 or 1.0
            s0, s1 = n0 / z, n1 / z
            fwd.append((s0, s1))
        out, b0, b1 = [], 1.0, 1.0
        for k in range(len(g) - 1, -1, -1):
            off, on = fwd[k][0] * b0, fwd[k][1] * b1
            if on >= CUTOFF * (off + on):
                out.append(g[k][0])
            d, (e0, e1) = g[k][3], emit[k]
            e0, e1 = e0 * b0, e1 * b1
            n0, n1 = f00[d] * e0 + f01[d] * e1, f10[d] * e0 + f11[d] * e1
            z = n0 + n1 or 1.0
            b0, b1 = n0 / z, n1 / z
        last = len(text.rstrip())
        out += more or []
        if last and (not out or max(out) < last):
            out.append(last)
        first = len(text) - len(text.lstrip())
        return sorted(x for x in set(out) if x > first)


#: Starts of the shapes, and of the classes of long words, among the words before a gap.
_COMMON = ("<short>", "<word>", "<long>")


def _shape_column(c: str):
    """:func:`shape` as an expression."""
    word = F.substring_index(c, "\t", 1)
    rest = F.expr(f"substring({c}, length(substring_index({c}, '\\t', 1)) + 1)")
    return F.concat(F.when(F.length(word) <= 3, "<short>").otherwise("<word>"), rest)


def _estimates(rows: DataFrame) -> Estimates:
    """Estimates from rows(before, what, event, n) of any number.

    Gaps that agree in the word after, in the kind of what follows and in the odds of the
    word before are one cell; cells are gathered by word, and every round reads them once.
    """
    rows = rows.withColumn("word", F.substring_index("what", "\t", -1)).withColumn("follow", F.substring_index("what", "\t", 2))
    often = lambda c: rows.groupBy(c).agg(F.sum("n").alias("m")).filter(F.col("m") >= LEAST).select(c, F.lit(True).alias(f"{c}_known"))
    rows = rows.join(often("before"), "before", "left").join(often("word"), "word", "left")
    # A word that follows the same word once or twice counts as a rare one; the word before keeps its counts.
    kept = F.col("word_known") & ((F.col("n") >= LEAST) | (F.col("word") == ""))
    rows = rows.select(F.when(F.col("before_known"), F.col("before")).otherwise(_shape_column("before")).alias("name"), "follow", F.when(kept, F.col("word")).otherwise("<rare>").alias("word"), "event", "n")
    rows = persist_table(rows.groupBy("name", "follow", "word", "event").agg(F.sum("n").alias("n")), "p10-contexts")
    every = rows.groupBy("name").agg(F.sum("n").alias("every"), F.sum(F.when(F.col("event") == 1, F.col("n")).otherwise(0)).alias("sure"))
    every = every.withColumn("name", F.explode(F.array("name", _shape_column("name")))).groupBy("name").agg(F.sum("every").alias("every"), F.sum("sure").alias("sure"))
    every = persist_table(every, "p10-befores")
    is_common = F.lit(False)
    for start in _COMMON:
        is_common = is_common | F.col("name").startswith(start)
    priors = Priors(tuple(r) for r in every.filter(is_common).collect())  # a few for each mark and closing sign
    prior = persist_table(every.mapInArrow(priors.table, "name string, key long, prior double"), "p10-priors")
    cells = rows.join(prior.select("name", "prior"), "name").groupBy("word", "follow", F.col("name").endswith("+").alias("plus"), "prior", "event").agg(F.sum("n").alias("n"))
    cells = persist_table(cells.groupBy("word").agg(F.collect_list(F.struct("follow", "plus", "prior", "event", "n")).alias("cells")).select("word", F.col("cells").cast(_CELLS).alias("cells")), "p10-cells")

    def sums(before: list[Follows]) -> dict[str, tuple[int, int]]:
        out = cells.mapInArrow(_sums(before), "follow string, on long, off long").groupBy("follow").agg(F.sum("on"), F.sum("off"))
        return {f: (on, off) for f, on, off in out.collect()}

    done = _rounds(sums)
    words = cells.mapInArrow(_words(done[:-1]), "key long, odds double")
    scores = lambda df: Scores(*(c.to_numpy() for c in df.toArrow().columns))
    return Estimates(scores(prior.select("key", "prior")), scores(words), done[-1])


def train(texts: DataFrame) -> Model:
    """Fit the model on texts(text) of any size; 16 bytes for each word that is told apart come to the driver and go to the tasks."""
    rows = texts.select("text").mapInArrow(_observer, "before string, what string, event int, n long")
    rows = persist_table(rows.groupBy("before", "what", "event").agg(F.sum("n").alias("n")), "p10-counts")
    special = F.col("before").isin("<distance>", "<unmarked>")
    few = [tuple(r) for r in rows.filter(special).collect()]  # a dozen
    return Model(few, _estimates(rows.filter(~special)))


def _tokens(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, word) of the words of a stretch; in scripts without spaces of its characters with their marks."""
    return [(m.start(), m.end(), m.group().casefold()) for m in _TOKEN.finditer(text, start, end)]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> a row per gap between the words of an unmarked stretch: key, stretch, gap, end, a, b, par."""
    names = ["key", "stretch", "gap", "end", "a", "b", "par"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for n, (start, end) in enumerate(unmarked(text, gaps(text)) if text else ()):
                t = _tokens(text, start, end)
                rows += [(doc, n, i, x[1], x[2], y[2], text.count("\n", x[1], y[0]) > 1) for i, (x, y) in enumerate(zip(t, t[1:]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _grams(model: Model):
    """text -> counts of (a, b, boundary) of neighbouring words in the marked parts, and of the lengths of sentences (a is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            a, b, e = zip(*seen)
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(e, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["a", "b", "event", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                long_, last, before = unmarked(text, gaps(text)), 0, None
                for end in model.ends(text):
                    if not any(a < end and last < b for a, b in long_):
                        t = [w for _, _, w in _tokens(text, last, end)]
                        if t and before is not None:
                            seen[before, t[0], 1] += 1
                        for x, y in zip(t, t[1:]):
                            seen[x, y, 0] += 1
                        seen[None, "", min(len(t), FAR)] += 1
                        before = t[-1] if t else before
                    else:
                        before = None
                    last = end
            if len(seen) > 200_000:
                yield flush()
        if seen:
            yield flush()

    return run


def _decider(hazard: np.ndarray, prior: float):
    """Rows of gaps of a document's stretch in order, each with its log odds -> the ends whose posterior reaches the cutoff."""
    h = np.clip(hazard, 1e-6, 1 - 1e-6)

    def decide(ends: list[int], odds: list[float]) -> list[int]:
        r = np.exp(np.clip(np.array(odds) - math.log(prior / (1 - prior)), -12, 12))
        n, d = len(r), len(h)
        alpha = np.zeros((n + 1, d))
        alpha[0, 0] = 1
        for i in range(n):
            stay = alpha[i] * (1 - h)
            alpha[i + 1, 1:] = stay[:-1]
            alpha[i + 1, -1] += stay[-1]
            alpha[i + 1, 0] = (alpha[i] * h).sum() * r[i]
            alpha[i + 1] /= alpha[i + 1].sum()
        beta, out = np.ones(d), []
        for i in range(n - 1, -1, -1):
            on = h * r[i] * beta[0]
            off = (1 - h) * np.append(beta[1:], beta[-1])
            cut, keep = float((alpha[i] * on).sum()), float((alpha[i] * off).sum())
            if cut >= CUTOFF * (cut + keep):
                out.append(ends[i])
            beta = on + off
            beta /= beta.max()
        return out[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, stretches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by: dict[int, list] = {}
                for g in sorted(stretches, key=lambda g: (g["stretch"], g["gap"])):
                    by.setdefault(g["stretch"], []).append(g)
                ids.append(doc)
                found.append(sorted(e for gs in by.values() for e in decide([g["end"] for g in gs], [g["odds"] for g in gs])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["key", "more"])

    return run


def unmarked_ends(docs: DataFrame, model: Model) -> DataFrame:
    """(key, more): the ends that the n-gram model finds in the unmarked stretches of docs(key long, text).

    Two aggregations count words and pairs of words with and without a boundary between
    them; only the gaps of unmarked stretches are joined with the counts.
    """
    gap = docs.select("key", "text").mapInArrow(_stretches, "key long, stretch int, gap int, end long, a string, b string, par boolean")
    gap = persist_table(gap.dropDuplicates(["key", "stretch", "gap"]), "p10-gaps")
    grams = docs.select("text").mapInArrow(_grams(model), "a string, b string, event int, n long")
    grams = persist_table(grams.groupBy("a", "b", "event").agg(F.sum("n").alias("n")), "p10-grams")
    lengths = {r["event"]: r["n"] for r in grams.filter("a is null").groupBy("event").agg(F.sum("n").alias("n")).collect()}
    pairs = grams.filter("a is not null")
    of = lambda c, name: pairs.groupBy(F.col(c).alias("w")).agg(F.sum("n").alias(f"{name}_all"), F.sum(F.when(F.col("event") == 1, F.col("n")).otherwise(0)).alias(f"{name}_cut"))
    left, right = of("a", "l"), of("b", "r")
    total, cuts = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("event") == 1, F.col("n"))), F.lit(0))).first()
    total, prior = max(1, total), (cuts + 1) / (total + 20)
    # Chances of a sentence to end after so many words, given that it has not ended before; few long sentences count as one.
    n = np.array([lengths.get(i + 1, 0) for i in range(FAR)], "f8") + 1e-3
    left_over = np.cumsum(n[::-1])[::-1]
    hazard = np.append(n[:-1] / left_over[:-1], max(prior, 0.2))
    inner = pairs.filter("event = 0").select("a", "b", F.col("n").alias("both"))
    g = gap.join(inner, ["a", "b"], "left").join(left.withColumnRenamed("w", "a"), "a", "left").join(right.withColumnRenamed("w", "b"), "b", "left").fillna(0, ["both", "l_all", "l_cut", "r_all", "r_cut"])
    share = (F.col("r_all") + 0.5) / total
    cut = (F.col("l_cut") + 4 * prior) / (F.col("l_all") + 4) * (F.col("r_cut") + 2 * share) / (cuts + 2)
    keep = (F.col("l_all") - F.col("l_cut") + 4 * (1 - prior)) / (F.col("l_all") + 4) * (F.col("both") + 2 * share) / (F.col("l_all") - F.col("l_cut") + 2)
    g = g.withColumn("odds", F.log(cut) - F.log(keep) + F.when(F.col("par"), 4.0).otherwise(0.0))
    g = g.groupBy("key").agg(F.collect_list(F.struct("stretch", "gap", "end", "odds")).alias("gaps"))
    return g.mapInArrow(_decider(hazard, prior), "key long, more array<long>")


def _splitter(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, more in zip(*(c.to_pylist() for c in batch.columns)):
                start = 0
                for n, end in enumerate(model.ends(text or "", more)):
                    while text[start].isspace():
                        start += 1
                    rows.append((doc, n + 1, start, end, text[start:end]))
                    start = end
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], ["doc_id", "sentence_no", "start_pos", "end_pos", "sentence"])

    return run


def _ender(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [model.ends(t or "", more) for t, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            doc = np.repeat(np.arange(len(ends)), [len(e) for e in ends])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([x for e in ends for x in e], pa.int64())], ["doc_id", "end_pos"])

    return run


def _with_unmarked(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, more): documents with the ends in their unmarked stretches, null where there are none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not model.unmarked:
        return docs.withColumn("more", F.lit(None).cast("array<bigint>"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    return docs.join(persist_table(unmarked_ends(docs, model), "p10-unmarked"), "key", "left").select("doc_id", "text", "more")


def boundaries(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, end_pos): the ends of the sentences of docs(doc_id long, text string), as :func:`sentences` gives them."""
    model = model or train(docs)
    return _with_unmarked(docs, model).mapInArrow(_ender(model), "doc_id long, end_pos long")


def sentences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, sentence_no, start_pos, end_pos, sentence) of docs(doc_id long, text string).

    Positions count code points; end_pos is exclusive.  Null and blank texts have no
    sentences, a text without any boundary is one.  Texts are read whole.
    """
    model = model or train(docs)
    return _with_unmarked(docs, model).mapInArrow(_splitter(model), "doc_id long, sentence_no int, start_pos long, end_pos long, sentence string")


def p10_found(spark, sf_dir: str) -> DataFrame:
    """The end of every sentence of every document."""
    return boundaries(load(spark, sf_dir, "documents").select("doc_id", "text")).distinct()


def p10_sentences(spark, sf_dir: str) -> DataFrame:
    """Every sentence of every document with its place."""
    return sentences(load(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p10_found": p10_found, "p10_sentences": p10_sentences}
SQL: dict[str, str] = {}
