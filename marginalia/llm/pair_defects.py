"""Defective prompt and answer pairs, by labelling functions and an expectation-maximisation label model.

For each defect several noisy functions vote yes, no or nothing.  Whether an answer is in
its prompt's language is also voted on by character n-grams that are learnt from the
prompts themselves.  A label model with one latent variable per defect learns from the
counts of vote patterns how far to trust each function, and gives every pattern a
posterior.  A pair keeps every label whose posterior reaches the defect's cutoff.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.storage import load, persist_table

DEFECTS = ("empty", "refusal", "copy", "truncated", "wrong_language")
#: Cutoffs of the posteriors, validated on 3,000 held-out labelled pairs (tests/llm/pair_fixture.py): see best_cutoff.
CUTOFFS = {"empty": 0.5, "refusal": 0.5, "copy": 0.5, "truncated": 0.5, "wrong_language": 0.6}
ROUNDS = 50

# Placeholders, and what refusals say in several languages.
PLACEHOLDERS = ("n/a", "na", "none", "null", "nan", "nil", "tbd", "tba", "todo", "no summary", "no abstract", "no answer", "not available", "unknown", "empty", "pending", "missing", "placeholder", "kein text", "keine angabe", "keine zusammenfassung", "k. a", "k.a", "aucun", "aucun résumé", "sans objet", "s/o", "sin resumen", "ninguno", "no disponible", "없음", "요약 없음", "해당 없음", "解当なし", "なし", "无", "無")
CANNOT = (
    r"\bi(?: am|'m|’m)? (?:cannot|can ?not|can't|can’t|could not|couldn't|couldn’t|am unable|unable|not able|am not able|won't|won’t|will not|must decline|have to decline|must refuse|do not feel|don't|don’t)\b",
    r"\bi(?:'m|’m) (?:sorry|afraid|unable|not able)\b",
    r"\b(?:kann|darf|möchte|werde|muss) (?:ich|leider)\b|\bich (?:kann|darf|möchte|werde|muss|bin nicht|ich)\b",
    r"\bje (?:ne|n'|n’|suis (?:incapable|désolé|dans l)|dois (?:refuser|décliner)|regrette)\b|\bje n['’]",
    r"\bno (?:puedo|me es posible|estoy en condiciones|es posible que|soy capaz|podré|estoy autorizad)|\bme (?:temo|veo obligad|disculpo)|\bdebo (?:rechazar|declinar)\b",
    r"(?:할|드릴|될|해 드릴|요약할|답변할|제공할|도와드릴|처리할) 수 (?:없|가 없)|어렵습니다|불가능합니다|거절|못합니다|못하|도와드리지",
    r"できません|できかねます|お答えできない|无法|不能|抱歉|申し訳",
)
SORRY = (
    r"^\W*(?:i'm sorry|i’m sorry|i am sorry|sorry|apologies|my apologies|unfortunately|regrettably|at this time|as an? (?:ai|language|large)|leider|es tut mir leid|tut mir leid|entschuldigung|bedauerlicherweise|als (?:ki|sprachmodell)|désolé|desole|malheureusement|je suis désolé|je regrette|en tant que|lo siento|lamentablemente|desafortunadamente|por desgracia|como modelo|disculp|perdón|죄송|유감|미안|안타깝|申し訳|抱歉|对不起|很遗憾|i (?:cannot|can't|can’t|am|won't|won’t|must))",
)
ABOUT = r"summar|passage|this text|given content|paragraph|comply|request|help with|zusammenfass|angaben|diesen text|résum|répondre|passage|texte|resum|responder|texto|ayudar|요약|답변|본문|내용|도와"

# Frequent function words; the two lists of a language vote separately.
ARTICLES = {
    "en": ("the", "a", "an", "each", "neither", "we", "it", "that", "this"),
    "de": ("der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "jede", "mehrere"),
    "fr": ("le", "les", "des", "une", "du", "au", "aux", "chaque", "l", "d", "plusieurs", "toutes"),
    "es": ("el", "los", "las", "una", "unos", "cada", "muchos", "varios", "todas", "al", "del"),
}
PREPOSITIONS = {
    "en": ("of", "in", "at", "on", "with", "for", "and", "because", "whereas", "nor", "by", "to", "was"),
    "de": ("von", "bei", "in", "im", "was", "zum", "und", "nach", "ohne", "aus", "mit", "vor", "für", "seit", "an", "unter", "auf", "trotz", "innerhalb", "entlang"),
    "fr": ("avec", "selon", "dans", "en", "pour", "sur", "sans", "sous", "et", "avant", "après", "depuis", "hors", "malgré", "moindre"),
    "es": ("con", "por", "sin", "en", "y", "tras", "desde", "para", "dentro", "fuera", "antes", "pese", "finales"),
}


DANGLING = frozenset("and or the a an of in on at with for to although because nor neither whereas each und oder der die das den von mit bei et ou le la les de des du avec un une y o el los con en por 그리고 및".split())

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_LETTER = regex.compile(r"[\p{L}\p{N}]")
_LETTERS_ONLY = regex.compile(r"[\p{L}\p{M}]+")
_BARE = regex.compile(r"^[\W_]+|[\W_]+$")
_NOT_FLAT = regex.compile(r"[^\p{L}\p{N}]+")
_END = regex.compile(r"(?<![.…])(?:[!?。！？।؟]|\.)[\"”»’'」』)\]“]*$")
_TAIL = regex.compile(r"(?:[-‐–—,;:…]|\.\.\.|\s\p{L}{1,2})$")
_BROKEN = regex.compile(r"(?:[\p{L}\p{N}]|\p{L}\s*(?:[-,…]|\.\.\.)|\s\([\p{L}]*)$")
_LAST = regex.compile(r"(\p{L}+)[^\p{L}]*$")
_SCRIPTS = (("hangul", 3, regex.compile(r"\p{Hangul}")), ("han", 3, regex.compile(r"\p{Han}")), ("kana", 12, regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("latin", 1, regex.compile(r"\p{Latin}")), ("arabic", 1, regex.compile(r"\p{Arabic}")), ("devanagari", 1, regex.compile(r"\p{Devanagari}")), ("thai", 1, regex.compile(r"\p{Thai}")), ("cyrillic", 1, regex.compile(r"\p{Cyrillic}")))
_CANNOT, _SORRY, _ABOUT = (regex.compile("|".join(f"(?:{x})" for x in ps), regex.I) for ps in (CANNOT, SORRY, (ABOUT,)))
_SETS = [{k: frozenset(v) for k, v in lists.items()} for lists in (ARTICLES, PREPOSITIONS)]


def language(words: set[str], lists: dict[str, frozenset]) -> str | None:
    """The language with most function words among ``words``; None if none has two (one in short texts) or another comes close."""
    n = sorted(((len(words & v), k) for k, v in lists.items()), reverse=True)
    (best, name), (other, _) = n[0], n[1]
    return name if best >= (1 if len(words) <= 8 and not other else 2) and best > other + (other > 1) else None


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Number of the script (from 1 on), and whether it is a letter or mark, of every character of the basic plane."""
    plane = "".join(chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x10000))
    kind, letter = np.zeros(0x10000, "u1"), np.zeros(0x10000, bool)
    for k, (_, _, pattern) in enumerate(_SCRIPTS, 1):
        kind[[m.start() for m in pattern.finditer(plane)]] = k
    letter[[m.start() for m in regex.finditer(r"[\p{L}\p{M}]", plane)]] = True
    return kind, letter


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, length of each)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "u4"), np.array([len(t) for t in texts], "i8")


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype="f8" if values.dtype.kind == "f" else "i8")])
    end = np.cumsum(size)
    return total[end] - total[end - size]


def scripts(texts: list[str]) -> list[str | None]:
    """The script of most of each text, names in Latin letters counting less than syllables, and kana more than the Han they stand among; None if there are few letters."""
    code, size = _characters(texts)
    kind = _tables()[0][np.minimum(code, 0xFFFF)]
    kind[(code >= 0x20000) & (code < 0x40000)] = 1 + [n for n, _, _ in _SCRIPTS].index("han")
    n = np.stack([w * _sums(kind == k, size) for k, (_, w, _) in enumerate(_SCRIPTS, 1)])
    return [_SCRIPTS[k][0] if n[k, i] >= 8 else None for i, k in enumerate(n.argmax(axis=0))]


def script(text: str) -> str | None:
    return scripts([text])[0]


def vote(prompt: str, answer: str | None, known: tuple[str | None, str | None] | None = None) -> tuple[tuple[int, ...], ...]:
    """Votes of the labelling functions, by defect: 1 yes, 0 no, -1 nothing; ``known`` are the scripts of both texts."""
    a = (answer or "").strip()
    p_words, a_words = _WORD.findall(prompt.lower()), _WORD.findall(a.lower())
    ps, as_ = set(p_words), set(a_words)
    bare = _BARE.sub("", a.lower())
    p_script, a_script = known or (script(prompt), script(a))
    told = len(a) > 20 or a_script in ("hangul", "han", "kana") and len(a) > 8

    def said(yes: bool, no: int = 0) -> int:
        return -1 if not told else 1 if yes else no

    def differ(x, y) -> int:
        return -1 if x is None or y is None else said(x != y)

    shared = len(ps & as_)
    flat_a, flat_p = _NOT_FLAT.sub("", a.lower()), _NOT_FLAT.sub("", prompt.lower())
    third = len(flat_p) // 3
    pieces = (flat_p[10:50], flat_p[third:third + 40], flat_p[-50:-10])
    held = sum(len(x) >= 20 and x in flat_a for x in pieces)
    ratio = len(a_words) / max(1, len(p_words))
    last = _LAST.search(a)
    opened = sum(a.count(c) for c in "“„«([「") - sum(a.count(c) for c in "”»)]」") - ("„" in a) * a.count("“") * 2
    langs = [(language(ps, s), language(as_, s)) for s in _SETS]
    return (
        (int(not _LETTER.search(a)), int(not as_ or bare in PLACEHOLDERS), int(len(a) <= 15 and not (told and as_))),
        (said(bool(_CANNOT.search(a))), said(bool(_SORRY.search(a))), said(bool(_ABOUT.search(a)), -1), said(shared <= max(2, 0.35 * len(as_)))),
        (int(shared >= 0.8 * len(ps) and bool(ps)), int(0.75 <= ratio <= 1.35), int(held >= 2 or held == sum(len(x) >= 20 for x in pieces) and held > 0)),
        (said(not _END.search(a)), said(bool(last and last[1].lower() in DANGLING or _TAIL.search(a)), -1), said(opened > 0, -1), said(bool(_BROKEN.search(a)))),
        (differ(*langs[0]), differ(*langs[1]), -1 if p_script == a_script == "latin" else differ(p_script, a_script)),
    )


def encode(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def decode(code: int, functions: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 - 1 for i in range(functions))


#: Functions of each defect; the last one of wrong_language is the vote of the n-grams.
FUNCTIONS = dict(zip(DEFECTS, (3, 4, 3, 4, 4)))
#: Buckets of hashed character trigrams, letters that an answer must have to be scored, and how far from the usual it must be.
BUCKETS, LEAST_LETTERS, AWAY = 1 << 15, 24, 8.0


def languages(texts: list[str], known: list[str | None] | None = None) -> list[str | None]:
    """A name for the language each prompt seems to be in: that of its function words, in scripts other than Latin the script."""
    out = []
    for text, s in zip(texts, known or scripts(texts)):
        if s == "latin":
            words = set(_WORD.findall(text.lower()))
            both = {x for x in (language(words, lists) for lists in _SETS) if x}
            s = both.pop() if len(both) == 1 else None
        out.append(s)
    return out


def language_of(text: str) -> str | None:
    return languages([text])[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the character trigrams of all texts, how many each text has): letters and single blanks in lower case."""
    code, size = _characters([" " + t.lower() + " " for t in texts])
    if not len(code):
        return np.zeros(0, "i8"), size
    code = np.where((code > 0xFFFF) | _tables()[1][np.minimum(code, 0xFFFF)], code, 32)
    blank = code == 32
    kept = np.ones(len(code), bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    first = np.cumsum(size) - size
    kept[first] = True  # each text begins with a blank of its own
    size = _sums(kept, size)
    code = code[kept].astype("u8")
    if len(code) < 3:
        return np.zeros(0, "i8"), np.maximum(size - 2, 0)
    h = ((code[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ code[2:]) * np.uint64(0x165667B19E3779F9)
    inside = np.ones(len(code), bool)
    ends = np.cumsum(size)
    inside[ends - 1] = inside[np.maximum(ends - 2, 0)] = False
    return (h >> np.uint64(40)).astype("i8")[inside[:-2]] % BUCKETS, np.maximum(size - 2, 0)


def _gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prompt -> name of the language, bucket, n."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list[str]] = {}
        prompts = [p for p in batch.column(0).to_pylist() if p]
        for p, name in zip(prompts, languages(prompts)):
            if name:
                by.setdefault(name, []).append(p)
        for name, texts in by.items():
            counts[name] = counts.get(name, 0) + np.bincount(trigrams(texts)[0], minlength=BUCKETS)
    for name, n in sorted(counts.items()):
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], ["name", "bucket", "n"])


def language_models(prompts: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities of trigram buckets for each language of prompts(prompt); at most BUCKETS counts a language come to the driver."""
    t = prompts.select("prompt").mapInArrow(_gram_counter, "name string, bucket long, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = {}
    name, bucket, n = np.array(t["name"].to_pylist(), object), t["bucket"].to_numpy(), t["n"].to_numpy()
    for k in sorted(set(name)):
        p = np.full(BUCKETS, 0.1)
        p[bucket[name == k]] += n[name == k]
        out[k] = np.log(p / p.sum()).astype("f4")
    return out


def _voter(models: dict[str, np.ndarray]):
    names = list(models)
    table = np.stack([models[k] for k in names]) if names else np.zeros((0, BUCKETS), "f4")

    def scores(own: list[str | None], answers: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """Name of each prompt's language, mean log probability of its answer's trigrams in it and in the best language, number of trigrams."""
        gram, n = trigrams(answers)
        mean = np.stack([_sums(t[gram], n) for t in table]) / np.maximum(n, 1) if len(names) else np.zeros((0, len(answers)))
        at = np.array([names.index(x) if x in models else -1 for x in own], int)
        fine = at >= 0
        mine = np.full(len(answers), np.nan)
        mine[fine] = mean[at[fine], np.flatnonzero(fine)]
        return [x if x in models else None for x in own], mine, mean.max(axis=0) if len(names) else mine, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns)) if r[2] and r[2].strip()]
            kinds, ids, prompts = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
            answers = [r[3] or "" for r in rows]
            p_scripts, a_scripts = scripts(prompts), scripts([a.strip() for a in answers])
            codes = [[encode(v) for v in vote(p, a, k)] for p, a, k in zip(prompts, answers, zip(p_scripts, a_scripts))]
            own, mine, best, n = scores(languages(prompts, p_scripts), answers)
            cols = [pa.array(list(c), pa.int32()) for c in (zip(*codes) if codes else [()] * len(DEFECTS))]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ids, pa.int64()), *cols, pa.array(own, pa.string()), pa.array(mine, pa.float64(), from_pandas=True), pa.array(best, pa.float64(), from_pandas=True), pa.array(n, pa.int64())], ["kind", "rec_id", *DEFECTS, "own", "mine", "best", "grams"])

    return run


def votes(pairs: DataFrame) -> DataFrame:
    """(kind, rec_id, a code of the votes per defect) of pairs(kind, rec_id, prompt, answer).

    Pairs with null or blank prompt are no pairs and are left out; a null answer is empty.
    The n-grams vote yes where another language explains the answer better, or where it is
    far less probable in the prompt's language than answers usually are; they say nothing
    on answers of few letters and on prompts of no known language.
    """
    models = language_models(pairs)
    schema = "kind string, rec_id long, " + ", ".join(f"{d} int" for d in DEFECTS) + ", own string, mine double, best double, grams long"
    v = persist_table(pairs.select("kind", "rec_id", "prompt", "answer").mapInArrow(_voter(models), schema), "p5-scores")
    scored = v.filter(F.col("own").isNotNull() & (F.col("grams") >= LEAST_LETTERS))
    usual = scored.groupBy("own").agg(F.percentile_approx("mine", 0.5, 1000).alias("usual"))  # a row per language
    far = (F.col("mine") - F.col("usual")) * F.sqrt("grams")
    spread = scored.join(F.broadcast(usual), "own").groupBy("own").agg(F.first("usual").alias("usual"), F.greatest(F.percentile_approx(F.abs(far), 0.5, 1000), F.lit(0.5)).alias("spread"))
    v = v.join(F.broadcast(spread), "own", "left")
    heard = F.col("spread").isNotNull() & (F.col("grams") >= LEAST_LETTERS)
    # Another language must explain the whole answer better, by more than chance would.
    other = (F.col("best") - F.col("mine")) * F.sqrt("grams") > 4 * F.col("spread")
    said = F.when(~heard, -1).when(other | (far < -AWAY * F.col("spread")), 1).otherwise(0)
    place = 3 ** (FUNCTIONS["wrong_language"] - 1)
    return v.withColumn("wrong_language", (F.col("wrong_language") + (said + 1) * place).cast("int")).select("kind", "rec_id", *DEFECTS)


def fit(patterns: dict[tuple[int, ...], int], prior: float = 0.02, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each pattern of votes, by EM with one binary latent variable.

    Each function says yes with one probability on defective pairs and another on sound
    ones; -1 says nothing.  Starts from the majority of the votes.  Weak priors keep the
    classes from changing places.
    """
    if not patterns:
        return {}
    k = len(next(iter(patterns)))
    post = {}
    for p in patterns:
        said = [v for v in p if v >= 0]
        post[p] = min(0.99, max(0.001, sum(said) / len(said))) ** 2 if said else 0.0
    n = sum(patterns.values())
    for _ in range(rounds):
        bad = sum(post[p] * c for p, c in patterns.items())
        pi = (bad + prior * 50) / (n + 50)
        hit, miss = [], []
        for j in range(k):
            yes1 = sum(post[p] * c for p, c in patterns.items() if p[j] == 1)
            all1 = sum(post[p] * c for p, c in patterns.items() if p[j] >= 0)
            yes0 = sum((1 - post[p]) * c for p, c in patterns.items() if p[j] == 1)
            all0 = sum((1 - post[p]) * c for p, c in patterns.items() if p[j] >= 0)
            hit.append((yes1 + 9) / (all1 + 10))
            miss.append((yes0 + 0.5) / (all0 + 10))
        for p in patterns:
            x = math.log(pi / (1 - pi))
            for j, v in enumerate(p):
                if v >= 0:
                    a, b = (hit[j], miss[j]) if v else (1 - hit[j], 1 - miss[j])
                    x += math.log(max(a, 1e-6) / max(b, 1e-6))
            post[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))
    return post


def posteriors(pairs: DataFrame) -> DataFrame:
    """(kind, rec_id, defect, posterior) of every pair and defect.

    Only counts of vote patterns, at most 3 ** functions of a defect, come to the driver.
    """
    v = persist_table(votes(pairs), "p5-votes")
    scored = []
    for d in DEFECTS:
        counts = {decode(r[0], FUNCTIONS[d]): r[1] for r in v.groupBy(d).count().collect()}
        case = reduce(lambda c, x: F.when(F.col(d) == encode(x[0]), F.lit(float(x[1]))).otherwise(c), fit(counts).items(), F.lit(0.0))
        scored.append(F.struct(F.lit(d).alias("defect"), case.alias("posterior")))
    return v.select("kind", "rec_id", F.explode(F.array(*scored)).alias("x")).select("kind", "rec_id", "x.defect", "x.posterior")


def labelled(pairs: DataFrame) -> DataFrame:
    """(kind, rec_id, defect, posterior): every label of every pair whose posterior reaches the defect's cutoff."""
    least = reduce(lambda c, d: F.when(F.col("defect") == d, CUTOFFS[d]).otherwise(c), DEFECTS, F.lit(1.0))
    return posteriors(pairs).filter(F.col("posterior") >= least)


def best_cutoff(scored: list[tuple[float, bool]]) -> tuple[float, float, float]:
    """(cutoff, lowest and highest cutoff that do as well) for (posterior, is defective) pairs, by F1; the middle of the best range."""
    values = sorted({p for p, _ in scored} | {0.0, 1.0})
    edges = [(a + b) / 2 for a, b in zip(values, values[1:])]

    def f1(c: float) -> float:
        hit = sum(t for p, t in scored if p >= c)
        return 2 * hit / max(1, sum(p >= c for p, _ in scored) + sum(t for _, t in scored))

    rated = [(f1(c), c) for c in edges]
    top = max(rated)[0]
    best = [i for i, (f, _) in enumerate(rated) if f >= top - 1e-12]
    lo, hi = values[best[0]], values[best[-1] + 1]
    return (lo + hi) / 2, lo, hi


def pairs_of(spark, sf_dir: str) -> DataFrame:
    para = load(spark, sf_dir, "paragraphs").select(F.lit("paragraph").alias("kind"), F.col("paragraph_id").alias("rec_id"), F.col("cleaned_text").alias("prompt"), F.col("summary").alias("answer"))
    papers = load(spark, sf_dir, "papers").select(F.lit("paper").alias("kind"), F.col("paper_id").alias("rec_id"), F.col("abstract").alias("prompt"), F.col("abstract_summary").alias("answer"))
    return para.unionByName(papers)


def one_label(labels: DataFrame) -> DataFrame:
    """The label of each pair with the largest posterior; of those equal to two digits the first of empty, refusal, copy, truncated, wrong language."""
    order = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return labels.groupBy("kind", "rec_id").agg(F.min_by("defect", F.struct(-F.round("posterior", 2), order)).alias("defect"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Each defective pair with its one, most probable defect."""
    return one_label(labelled(pairs_of(spark, sf_dir))).select("kind", "rec_id", "defect")


def p5_labels(spark, sf_dir: str) -> DataFrame:
    """All labels of the pairs with their posteriors."""
    return labelled(pairs_of(spark, sf_dir)).withColumn("posterior", F.round("posterior", 4))


QUERIES = {"p5_found": p5_found, "p5_labels": p5_labels}
SQL: dict[str, str] = {}
