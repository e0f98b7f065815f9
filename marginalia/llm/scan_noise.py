"""Noise of page scanning: running heads, page numbers, words split over lines, misread characters.

Lines of their own are taken out first: page numbers by their form, running heads because
they repeat over the corpus up to misread characters and a lost or added letter, or name
the paper, its authors or its journal.  A line may be a head by its form, or because it
stands at the edge of a text or beside a page number and breaks the text there.  The
remaining lines are joined; whether a word was split by a hyphen or is a compound that
ends a line, which characters are misread for which, and whether a rare word is a frequent
one with characters misread, is decided by the vocabulary of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.skew import HOT_SHARE
from marginalia.storage import load, persist_table

#: What scanners read (left) for what is printed (right).
CONFUSIONS = (("c", "e"), ("f", "t"), ("l", "i"), ("0", "o"), ("1", "l"), ("5", "s"), ("ii", "u"), ("li", "h"), ("rn", "m"), ("q", "g"), ("vv", "w"))
IN_NUMBERS = (("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"))
HYPHENS = "-­‐¬~"
#: Times a line must appear in different texts to count as running, and a word must be as frequent as its misreading.
REPEATS = 3
RATIO = 8
#: Words of more than this share of the texts are taken as they are unless another is much more frequent; at most (words per text) / COMMON words.
COMMON = 1e-3
#: Common words up to this number are sent to all tasks.
BROADCAST_WORDS = 500_000
#: A confusion is learnt from at least this many different words, this many times as many as of its reverse, and this share of all words that have one.
LEARN, ONE_WAY, LEARN_SHARE = 5, 4, 5e-3
#: Letters that a head's beginning or end must share with a repeated one to be compared with it.
EDGE = 10

_PAGE = regex.compile(r"[\[|~–—-]*\s*(?:(?:page|seite|pág\.|pag\.|pp?\.|s\.)\s*)?(?=\S*\d)[\dlOIS]{1,5}(?:\s*(?:/|of|von|de|sur)\s*[\dlOIS]{1,5})?\s*[\]|~–—-]*", regex.I)
_ROMAN = regex.compile(r"(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:ix|iv|v?i{0,3})")
_AFFIX = regex.compile(r"^\s*\d{1,4}\s{2,}(?=\S)|(?<=\S)\s{2,}\d{1,4}\s*$")
_VOLUME = regex.compile(r",? (?:vol\.? ?\d+|\d{4}, ?\d+ ?\(\d+\)|\d+ ?\(\d+\)).{0,16}$", regex.I)
_LABEL = regex.compile(r"(?:remark|theorem|lemma|proof|corollary|definition|note|example|bemerkung|satz|beweis|remarque|théorème|observación|teorema|비고|정리)\b[\s\d.:]*", regex.I)
_SPLIT = regex.compile(rf"([\p{{L}}\p{{N}}]*\p{{L}})([{HYPHENS}])[ \t]?\n\s*(\p{{Ll}}[\p{{L}}\p{{N}}]*)")
_WORDS = regex.compile(r"[\p{L}\p{N}]+(?:[.,]\p{N}+)*(?:-[\p{L}\p{N}]+)*")
_LETTERS = regex.compile(r"[^\p{L}]+")


def is_page_number(line: str) -> bool:
    """A line that holds nothing but a page number, plain, decorated, named or Roman."""
    s = line.strip()
    return bool(s) and (bool(_PAGE.fullmatch(s)) or bool(_ROMAN.fullmatch(s)) and len(s) < 8)


def head_core(line: str, rest: str) -> str | None:
    """The heading of a line that may be a running head, without its page number; else None.

    It stands out by a page number set apart, a dot or dash between its parts, a volume,
    "et al. /", or capitals in a text that has others.  Labels, formulas and sentences don't.
    """
    s = line.strip()
    if not 6 <= len(s) <= 110 or " | " in s or "=" in s:
        return None
    core = _AFFIX.sub("", s).strip()
    letters = _LETTERS.sub("", core)
    if len(letters) < 5 or _LABEL.fullmatch(core) or not core[0].isupper():
        return None
    capitals = letters.isupper() and " " in core and any(c.islower() for c in rest)
    if core != s or " · " in core or " et al. / " in core or " — " in core or capitals or _VOLUME.search(core):
        return core
    return None


def fold(text: str) -> str:
    """Letters only, lower case, with characters that are misread for one another made equal."""
    s = _LETTERS.sub("", text.casefold().replace("0", "o").replace("1", "l").replace("5", "s"))
    for a, b in (("rn", "m"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("c", "e"), ("f", "t"), ("i", "l"), ("q", "g")):
        s = s.replace(a, b)
    return s


def names_paper(core: str, title: str | None, authors: str | None, journal: str | None) -> bool:
    """Whether a heading names the paper's journal, begins its title, or has an author with one of them."""
    f = fold(core)
    t, j = fold(title or ""), fold(journal or "")
    if len(j) > 6 and j in f:
        return True
    parts = regex.split(r"\s+(?:et al\. )?[/—·]\s+", core)
    for part in parts:
        p = fold(part)
        if len(p) >= 10 and (t.startswith(p) or sum(x == y for x, y in zip(p, t)) >= 0.9 * len(p)):
            return True
    who = fold(authors or "")
    return len(parts) > 1 and any(len(fold(p)) >= 6 and fold(p) in who for p in parts)


_SENTENCE = regex.compile(r"[.!?:;,。！？]['\"”’)\]]*$")


def edge_heads(lines: list[str], taken: set[int]) -> list[tuple[int, str]]:
    """(line, text) of lines at an edge of the text or beside a page number (``taken``) that break it and are no sentences.

    They begin with a capital, end without a mark, are clearly shorter than the longest line, and what
    goes on behind them goes on in small letters, or what stands before them has no end.
    """
    kept = [i for i, x in enumerate(lines) if x.strip() and i not in taken]
    if len(kept) < 3:
        return []
    longest = max(len(lines[i].strip()) for i in kept)
    out = []
    for at, i in enumerate(kept):
        first, last = at == 0, at == len(kept) - 1
        if not (first or last or i - 1 in taken or i + 1 in taken):
            continue
        s = lines[i].strip()
        if not 6 <= len(s) <= min(110, 0.8 * longest) or not s[0].isupper() or _SENTENCE.search(s) or s[-1] in HYPHENS or any(c in s for c in "|=") or _LABEL.fullmatch(s) or len(_LETTERS.sub("", s)) < 5:
            continue
        before, after = "" if first else lines[kept[at - 1]].strip(), "" if last else lines[kept[at + 1]].strip()
        goes_on = after[:1].islower()
        open_ = bool(before) and not _SENTENCE.search(before)
        if goes_on and (first or open_) or last and open_ and (i - 1 in taken or i + 1 in taken):
            out.append((i, s))
    return out


def read(text: str) -> tuple[bool, list[tuple[int, str, str, bool]], list[tuple[str, str, bool]], set[str], set[str]]:
    """(has a page number, (line, heading, its fold, by its place only) of possible heads, (before, after, hard) of splits, words, compounds)."""
    lines = text.split("\n")
    page, heads, kept, taken = False, [], [], set()
    for i, line in enumerate(lines):
        if len(lines) > 1 and is_page_number(line):
            page = True
            taken.add(i)
            continue
        core = head_core(line, text) if len(lines) > 1 else None
        if core:
            heads.append((i, core, fold(_VOLUME.sub("", core)), False))
            taken.add(i)
        else:
            kept.append(line)
    if len(lines) > 2:
        heads += [(i, s, fold(s), True) for i, s in edge_heads(lines, taken)]
    body = "\n".join(kept)
    splits = [(m[1].casefold(), m[3].casefold(), m[2] != "-") for m in _SPLIT.finditer(body)]
    body = _SPLIT.sub("\n", body)
    words, compounds = set(), set()
    for w in _WORDS.findall(body.casefold()):
        if "-" in w:
            compounds.add(w)
            words.update(w.split("-"))
        else:
            words.add(w)
    return page, heads, splits, words, compounds


_SCHEMA = "field int, rec_key string, paper_id long, page boolean, heads array<struct<line:int,core:string,fold:string,edge:boolean>>, splits array<struct<a:string,b:string,hard:boolean>>, words array<string>, compounds array<string>"
_ARROW = pa.schema([("field", pa.int32()), ("rec_key", pa.string()), ("paper_id", pa.int64()), ("page", pa.bool_()), ("heads", pa.list_(pa.struct([("line", pa.int32()), ("core", pa.string()), ("fold", pa.string()), ("edge", pa.bool_())]))), ("splits", pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("hard", pa.bool_())]))), ("words", pa.list_(pa.string())), ("compounds", pa.list_(pa.string()))])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for text in batch.column(3).to_pylist():
            page, heads, splits, words, compounds = read(text or "")
            out[0].append(page)
            out[1].append([{"line": i, "core": c, "fold": f, "edge": e} for i, c, f, e in heads])
            out[2].append([{"a": a, "b": b, "hard": h} for a, b, h in splits])
            out[3].append(list(words))
            out[4].append(list(compounds))
        cols = [batch.column(0).cast(pa.int32()), batch.column(1), batch.column(2)] + [pa.array(c, t.type) for c, t in zip(out, list(_ARROW)[3:])]
        yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)


def misreadings(word: str, confusions: tuple = CONFUSIONS) -> list[str]:
    """Words that ``word`` may be a misreading of: one confusion undone, or two where that gives no more than a few dozen words."""
    table = confusions + (IN_NUMBERS if any(c.isdigit() for c in word) or len(word) <= 3 else ())
    found: set[str] = set()
    level = {(word, 0)}
    for _ in range(2):
        nxt = set()
        for w, start in level:
            for seen, meant in table:
                i = w.find(seen, start)
                while i >= 0:
                    nxt.add((w[:i] + meant + w[i + len(seen):], i + len(meant)))
                    i = w.find(seen, i + 1)
        found |= {w for w, _ in nxt}
        level = nxt
        if len(level) > 64:
            break
    return [w for w in found if w != word]


def _suspects(confusions: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts, meant = [], [], []
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for v in misreadings(w, confusions):
                    words.append(w)
                    counts.append(n)
                    meant.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(meant, pa.string())], ["word", "n", "meant"])

    return run


def _gapped(words: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """words(word, n) with one or two neighbouring characters taken out at every place: key, what was taken out, and the word, its count."""
    piece = lambda span: F.expr(f"transform(sequence(1, length(word) - {span - 1}), i -> struct(concat(substring(word, 1, i - 1), '*', substring(word, i + {span})) as key, substring(word, i, {span}) as part))")
    out = words.select("word", "n", F.explode(F.concat(piece(1), piece(2))).alias("x"))
    return out.select("x.key", F.col("x.part").alias(names[0]), F.col("word").alias(names[1]), F.col("n").alias(names[2]))


def learnt_confusions(vocabulary: DataFrame) -> tuple[tuple[str, str], ...]:
    """(seen, meant) pairs of one or two characters that rare words of vocabulary(word, n) show against words RATIO times as frequent.

    Rare words are aligned with frequent ones that differ at one place and are not
    themselves like a still more frequent one.  A word that may be explained by several
    confusions counts for the one that explains most words, so accidental likenesses, each
    its own, fall away.
    """
    by = ["seen", "meant"]
    plain = vocabulary.filter(F.length("word").between(4, 64) & F.col("word").rlike(r"^[\p{Ll}\p{Nd}]+$"))
    often = _gapped(plain.filter((F.col("n") >= RATIO) & F.col("word").rlike(r"^\p{Ll}+$")), ("meant", "right", "n_right"))
    rare = _gapped(plain.filter(F.length("word") >= 5), ("seen", "word", "n"))
    differ = (F.substring("seen", 1, 1) != F.substring("meant", 1, 1)) & (F.substring("seen", -1, 1) != F.substring("meant", -1, 1)) & (F.length("seen") + F.length("meant") < 4)
    hits = persist_table(rare.join(often, "key").filter(differ & (F.col("n_right") >= RATIO * F.col("n"))).select("word", "right", "seen", "meant").distinct(), "p4-aligned")
    hits = hits.join(hits.select(F.col("word").alias("right")).distinct(), "right", "left_anti").select("word", *by).distinct()
    support = hits.groupBy(*by).agg(F.count("*").alias("words"))
    mine = hits.join(support, by).groupBy("word").agg(F.max(F.struct("words", *by)).alias("best")).select("word", "best.seen", "best.meant")
    counts = persist_table(mine.groupBy(*by).agg(F.count("*").alias("words")), "p4-confusions")
    total = counts.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    back = counts.select(F.col("seen").alias("meant"), F.col("meant").alias("seen"), F.col("words").alias("reverse"))
    # At most 1 / LEARN_SHARE pairs.
    kept = counts.filter(F.col("words") >= max(LEARN, LEARN_SHARE * total)).join(back, by, "left").filter(F.col("words") >= ONE_WAY * F.coalesce("reverse", F.lit(0)))
    return tuple((r["seen"], r["meant"]) for r in kept.orderBy(F.desc("words"), *by).collect())


def near_repeats(folds: DataFrame) -> DataFrame:
    """(fold, n) of folds(fold, n, form): how often a heading occurs that is the same, or one with a letter lost, added or changed in twelve, that repeats.

    A heading is compared with repeated ones that share its first or its last EDGE letters.
    """
    long_ = folds.filter(F.length("fold") >= 2 * EDGE)
    keyed = long_.select("fold", "n", F.explode(F.array(F.concat(F.lit("<"), F.substring("fold", 1, EDGE)), F.concat(F.lit(">"), F.substring("fold", -EDGE, EDGE)))).alias("key"))
    often = keyed.filter(F.col("n") >= REPEATS).select("key", F.col("fold").alias("other"), F.col("n").alias("m"))
    near = keyed.filter(F.col("n") < REPEATS).join(often, "key").filter(F.abs(F.length("fold") - F.length("other")) <= F.length("fold") / 12)
    near = near.filter(F.levenshtein("fold", "other") <= F.length("fold") / 12).groupBy("fold").agg(F.max("m").alias("m"))
    return folds.join(near, "fold", "left").select("fold", F.greatest("n", F.coalesce("m", F.lit(0))).alias("n"))


def _head_judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [n >= REPEATS or not edge and (bool(_VOLUME.search(core)) or names_paper(core, title, authors, journal)) for core, edge, n, title, authors, journal in zip(*(batch.column(i).to_pylist() for i in range(3, 9)))]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(keep, pa.bool_())], ["field", "rec_key", "line", "is_head"])


class Findings:
    """What :func:`survey` finds: tables heads(field, rec_key, line), splits(field, rec_key, a, b) that are hyphenations,
    compounds(field, rec_key, a, b) that only end a line, fixes(word, meant), misread(field, rec_key, word), and pages(field, rec_key)."""

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)


def survey(texts: DataFrame, papers: DataFrame) -> Findings:
    """Find the noise of texts(field int, rec_key string, paper_id long, text string).

    ``papers`` is (paper_id, title, authors, journal); texts without a known paper are
    judged by repetition alone.  Null and empty texts have no noise.  Lines are counted
    over all texts, words once for all texts of the same words, however many copies there are.
    """
    seen = texts.select("field", "rec_key", F.col("paper_id").cast("long").alias("paper_id"), "text").mapInArrow(_reader, _SCHEMA)
    seen = persist_table(seen.withColumn("same", F.xxhash64(F.array_sort("words"), F.array_sort("compounds"), "splits")), "p4-read")
    once = persist_table(seen.select("same", "words", "compounds").dropDuplicates(["same"]), "p4-once")
    n = once.count()
    key = ["field", "rec_key"]
    # Running heads.
    lines = persist_table(seen.select(*key, "paper_id", "same", F.explode("heads").alias("h")).select(*key, "paper_id", "same", "h.*"), "p4-lines")
    # Heads by form count in every text, those by their place in different texts only.
    folds = lines.groupBy("fold").agg(F.count_distinct("field", "rec_key", F.when(~F.col("edge"), True)).alias("a"), F.count_distinct("same").alias("b"), F.max(~F.col("edge")).alias("form"))
    often = near_repeats(folds.select("fold", F.when(F.col("form"), F.greatest("a", "b")).otherwise(F.col("b")).alias("n"))).filter(F.col("n") >= REPEATS)
    # A head in many texts of one key: at most 1 / HOT_SHARE such, sent to the tasks; the others by a shuffle.
    total = lines.count()
    counts = persist_table(often.join(lines.groupBy("fold").agg(F.count("*").alias("rows")), "fold"), "p4-often")
    hot = F.broadcast(counts.filter(F.col("rows") > max(1.0, total * HOT_SHARE)).select("fold", F.col("n").alias("m")))
    rest = counts.filter(F.col("rows") <= max(1.0, total * HOT_SHARE)).select("fold", "n")
    lines = lines.join(hot, "fold", "left").join(rest, "fold", "left").withColumn("n", F.coalesce("m", "n", F.lit(1)))
    lines = lines.withColumn("paper_id", F.coalesce("paper_id", -1 - F.pmod(F.xxhash64("rec_key"), F.lit(1 << 20))))  # no paper: not all in one task
    named = lines.join(papers.filter("paper_id is not null").dropDuplicates(["paper_id"]), "paper_id", "left")
    heads = named.select(*key, "line", "core", "edge", F.col("n").cast("long").alias("n"), "title", "authors", "journal").mapInArrow(_head_judge, "field int, rec_key string, line int, is_head boolean")
    heads = persist_table(heads.filter("is_head").drop("is_head"), "p4-heads")
    # The vocabulary of words that no line end splits.
    vocabulary = persist_table(once.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "p4-words")
    compounds = once.select(F.explode("compounds").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # Words split over lines.
    splits = persist_table(seen.select(*key, "same", F.explode("splits").alias("s")).select(*key, "same", "s.*"), "p4-splits")
    kinds = splits.groupBy("a", "b", "hard").agg(F.count("*").alias("c")).drop("c").withColumn("joined", F.concat("a", "b")).withColumn("hyphened", F.concat_ws("-", "a", "b"))
    count = lambda table, on, to: table.select(F.col("word").alias(on), F.col("n").alias(to))
    kinds = kinds.join(count(vocabulary, "joined", "n_joined"), "joined", "left").join(count(compounds, "hyphened", "n_hyphened"), "hyphened", "left")
    kinds = kinds.join(count(vocabulary, "a", "n_a"), "a", "left").join(count(vocabulary, "b", "n_b"), "b", "left").fillna(0, ["n_joined", "n_hyphened", "n_a", "n_b"])
    whole = (F.col("n_joined") > 0) | (F.least("n_a", "n_b") < 5)
    kinds = persist_table(kinds.select("a", "b", "hard", (F.col("hard") | (whole & (F.col("n_hyphened") <= F.col("n_joined")))).alias("cut")), "p4-kinds")
    judged = splits.join(kinds, ["a", "b", "hard"])
    # Misread words: those that turn into much more frequent ones when confusions are undone.
    # Words that only stand at the end of lines are judged as well.
    ends = judged.filter("cut").select(*key, "same", F.concat("a", "b").alias("word"))
    only = ends.groupBy("word").agg(F.count_distinct("same").alias("n")).join(vocabulary.select("word"), "word", "left_anti")
    confusions = tuple(dict.fromkeys(CONFUSIONS + learnt_confusions(vocabulary)))
    parts = "|".join(sorted({regex.escape(a) for a, _ in confusions + IN_NUMBERS}))
    suspects = vocabulary.unionByName(only).filter(F.col("word").rlike(parts)).mapInArrow(_suspects(confusions), "word string, n long, meant string")
    fixes = suspects.join(count(vocabulary, "meant", "n_meant"), "meant")
    # Short words and numbers are near many others, so they need more evidence.
    need = F.when(F.length("word") <= 3, 100).when(F.col("word").rlike(r"^[0-9.,]+$"), 10**9).otherwise(RATIO)
    mixed = F.col("word").rlike(r"\p{L}[015]|[015]\p{L}")
    enough = (F.col("n_meant") >= F.col("n") * need) | ((F.length("word") >= 6) & (F.col("n") == 1) & (F.col("n_meant") >= F.when(mixed, 1).otherwise(3)))
    fixes = fixes.filter(enough).groupBy("word").agg(F.max_by("meant", "n_meant").alias("meant"))
    odd = F.col("word").rlike(r"^(?=.*[0-9])[0-9.,osli]*[osli][0-9.,osli]*$") & (F.length("word") > 2)
    numbers = vocabulary.filter(F.col("n") <= max(3.0, COMMON * n)).filter(odd).select("word", F.translate("word", "osli", "0511").alias("meant"))
    fixes = persist_table(fixes.unionByName(numbers.join(fixes.select("word"), "word", "left_anti")), "p4-fixes")
    # Common words that stay as they are; broadcast by Spark if they turn out small, joined by a shuffle if not.
    common = persist_table(vocabulary.filter(F.col("n") > max(3.0, COMMON * n)).select("word").join(fixes.select("word"), "word", "left_anti"), "p4-common")
    held = seen.select(*key, F.explode("words").alias("word"))
    held = held.join(F.broadcast(common) if common.count() <= BROADCAST_WORDS else common, "word", "left_anti").unionByName(ends.drop("same"))
    misread = held.join(fixes, "word").select(*key, "word", "meant").distinct()
    return Findings(heads=heads, splits=judged.filter("cut").select(*key, "a", "b"), compounds=judged.filter("not cut").select(*key, "a", "b"), fixes=fixes, misread=misread, pages=seen.filter("page").select(*key))


FIELDS = ("ocr_text", "original_text", "table_text")


def scanned_texts(spark, sf_dir: str) -> DataFrame:
    """(field, rec_key, paper_id, text) of all blocks, paragraphs and tables."""
    blocks = load(spark, sf_dir, "review_documents").select("paper_id", F.explode("blocks").alias("b")).select(F.lit(0).alias("field"), F.col("b.block_id").alias("rec_key"), "paper_id", F.col("b.ocr_text").alias("text"))
    para = load(spark, sf_dir, "paragraphs").select(F.lit(1).alias("field"), F.col("paragraph_id").cast("string").alias("rec_key"), "paper_id", F.col("original_text").alias("text"))
    tables = load(spark, sf_dir, "paper_tables").select(F.lit(2).alias("field"), F.col("table_id").cast("string").alias("rec_key"), "paper_id", F.col("table_text").alias("text"))
    return blocks.unionByName(para).unionByName(tables).filter("rec_key is not null and text is not null")


def _named(c="field"):
    return F.element_at(F.array(*map(F.lit, FIELDS)), F.col(c) + 1)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Each kind of damage that a block's, paragraph's or table's text has."""
    f = survey(scanned_texts(spark, sf_dir), load(spark, sf_dir, "papers").select("paper_id", "title", "authors", "journal"))
    out = None
    for table, defect in ((f.splits, "hyphenation"), (f.misread, "misread"), (f.heads, "running_head"), (f.pages, "page_number")):
        one = table.select("field", "rec_key").distinct().withColumn("defect", F.lit(defect))
        out = one if out is None else out.unionByName(one)
    return out.select(_named().alias("field"), "rec_key", "defect")


def repaired(text: str, heads: set[int], compounds: set[tuple[str, str]], fixes: dict[str, str], rows: bool) -> str:
    """The text without heads and page numbers, lines joined (rows of tables kept), words whole and misreadings undone."""
    lines = text.split("\n")
    kept = [x for i, x in enumerate(lines) if i not in heads and not (len(lines) > 1 and is_page_number(x))]
    body = _SPLIT.sub(lambda m: m[1] + ("-" if m[2] == "-" and (m[1].casefold(), m[3].casefold()) in compounds else "") + m[3], "\n".join(kept))

    def fix(m) -> str:
        good = fixes.get(m[0].casefold())
        return m[0] if good is None else good.upper() if m[0].isupper() and len(m[0]) > 1 else good[0].upper() + good[1:] if m[0][0].isupper() else good

    body = regex.sub(r"[\p{L}\p{N}]+(?:[.,]\p{N}+)*", fix, body) if fixes else body
    if rows:
        return "\n".join(x.strip() for x in body.split("\n") if x.strip())
    paragraphs = regex.split(r"\n\s*\n", body)
    return "\n\n".join(" ".join(p.split()) for p in paragraphs if p.strip())


def _repairer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for field, text, heads, compounds, fixes in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
            out.append(repaired(text, set(heads or ()), {(x["a"], x["b"]) for x in compounds or ()}, {x["word"]: x["meant"] for x in fixes or ()}, field == 2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["field", "rec_key", "repaired_text"])


def p4_repaired(spark, sf_dir: str) -> DataFrame:
    """Every text as continuous readable text; tables as intact rows."""
    texts = scanned_texts(spark, sf_dir)
    f = survey(texts, load(spark, sf_dir, "papers").select("paper_id", "title", "authors", "journal"))
    key = ["field", "rec_key"]
    texts = texts.select(*key, "text").join(f.heads.groupBy(*key).agg(F.collect_set("line").alias("heads")), key, "left")
    texts = texts.join(f.compounds.groupBy(*key).agg(F.collect_set(F.struct("a", "b")).alias("compounds")), key, "left")
    texts = texts.join(f.misread.groupBy(*key).agg(F.collect_set(F.struct("word", "meant")).alias("fixes")), key, "left")
    out = texts.select(*key, "text", "heads", "compounds", "fixes").mapInArrow(_repairer, "field int, rec_key string, repaired_text string")
    return out.select(_named().alias("field"), "rec_key", "repaired_text")


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
SQL: dict[str, str] = {}
