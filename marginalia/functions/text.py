"""Text expressions.  All are null-safe: null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([A-Za-z][A-Za-z0-9_-]+|[가-힣]{2,})"


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space made one blank, ends stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def keyword(c: Column) -> Column:
    """A keyword as it is stored: collapsed, lower case."""
    return F.lower(collapse(c))


def clean_lines(c: Column) -> Column:
    """Every line collapsed, blank lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), collapse), lambda x: x != ""), "\n")


def slug(c: Column, default: str = "paper", limit: int = 80) -> Column:
    """Letters and digits joined by hyphens, lower case, cut; a default where nothing is left."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, limit), r"-+$", "")
    return F.when(s == "", default).otherwise(s)


def doi(c: Column) -> Column:
    """A DOI without the resolver's address; blank gives null."""
    return F.nullif(F.regexp_replace(strip(c), r"^https://doi\.org/|^http://doi\.org/", ""), F.lit(""))


def work_id(c: Column) -> Column:
    """The work number in the last part of an address: W, in either case, and digits; null where it is something else."""
    number = F.regexp_extract(F.element_at(F.split(F.regexp_replace(strip(c), r"/+$", ""), "/"), -1), r"^[Ww](\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("W"), number))


def query_terms(c: Column) -> Column:
    """Latin tokens of two characters or more and Hangul runs of two or more."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(1))


def unique_terms(c: Column) -> Column:
    """Items of an array as keywords, blanks dropped, the first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(c, keyword), lambda x: x.isNotNull() & (x != "")))


def clean_items(c: Column) -> Column:
    """Items stripped, blanks dropped, the first of equal ones kept; null gives an empty array."""
    items = F.transform(F.coalesce(c, F.array().cast("array<string>")), strip)
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def year(c: Column) -> Column:
    """The first year of 1900 to 2099 in a text, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")), F.lit("9999")).cast("int")


def strip_abstract_heading(c: Column) -> Column:
    """An abstract without its own heading word."""
    return strip(F.regexp_replace(c, r"(?iU)^\s*(?:abstract|초록|요약)\s*(?:[:：.\-–—]\s*)?(?:\r?\n|\s+)", ""))


# Where affiliations begin in an author block, and the marks behind names.
AFFILIATION = r"(?i)(?:@|\b(?:university|institute|laborator(?:y|ies)|research|department|school|college|centre|center|corporation|company|\bco\.|\bltd\.?|\binc\.?)\b)"
AUTHOR_MARKS = r"\s*[*∗†‡]\s*\d*(?:\s*,\s*\d+)*|\d+\s*[*∗†‡](?=\s*(?:,|$))|(?<=[A-Za-z])\d+(?=\s*(?:,|$))"


def author_list(blocks: Column) -> Column:
    """Names of an array of author blocks in order: their lines up to the first affiliation, without marks, split at commas, semicolons and line ends."""
    lines = F.transform(blocks, lambda b: F.filter(F.transform(F.split(F.coalesce(b, F.lit("")), r"\r?\n"), strip), lambda x: x != ""))
    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(False).alias("over"))

    def step(s, block):
        # The lines before the first affiliation: all of them if there is none.
        hit = F.array_position(F.transform(block, lambda x: x.rlike(AFFILIATION)), True)
        own = F.when(hit > 0, F.slice(block, F.lit(1), (hit - 1).cast("int"))).otherwise(block)
        more = F.when(F.size(own) > 0, F.array(F.array_join(own, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(s["over"], s).otherwise(F.struct(F.concat(s["names"], more).alias("names"), (hit > 0).alias("over")))

    text = F.regexp_replace(F.array_join(F.aggregate(F.coalesce(lines, F.array().cast("array<array<string>>")), start, step, lambda s: s["names"]), ", "), AUTHOR_MARKS, "")
    return F.filter(F.transform(F.split(text, r"[,;\n]+"), strip), lambda x: x != "")


def keyword_list(c: Column) -> Column:
    """Keywords after a label such as "Keywords:", split at the usual separators."""
    body = F.regexp_replace(c, r"(?iU)^\s*(?:keywords?|key\s*words?|색인어|주요\s*검색어|ccs\s*concepts?)\s*[:：]\s*", "")
    return clean_items(F.transform(F.split(body, r"[,;•\n]+"), lambda x: F.regexp_replace(x, r"^[\s.]+|[\s.]+$", "")))


def cut(c: Column, limit: int = 60, marker: str = "…") -> Column:
    """At most ``limit`` characters on one line, line ends shown, pipes made slashes, with a marker where something is missing."""
    flat = F.translate(F.replace(c, F.lit("\n"), F.lit(" ⏎ ")), "|", "/")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - len(marker)), F.lit(marker))).otherwise(flat)


#: Fixed value: what stands where a workbook's cell was cut.
CELL_CUT = "\n...[Excel 셀 길이 제한으로 잘림]"


def cell_text(c: Column, limit: int, marker: str = CELL_CUT) -> Column:
    """A value fit for a workbook's cell; null is empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - len(marker)), F.lit(marker))).otherwise(c)


def has_ideographs(c: Column) -> Column:
    """Whether an answer holds Han characters, which a summary must not."""
    return F.coalesce(c.rlike("[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"), F.lit(False))


def result_id(at: Column, key: Column) -> Column:
    """r-YYYYMMDD-xxxxxxxx, the last part from a hash of the key."""
    return F.concat(F.lit("r-"), F.date_format(at, "yyyyMMdd"), F.lit("-"), F.substring(F.sha2(key.cast("string"), 256), 1, 8))


def hash_share(c: Column) -> Column:
    """A number in [0, 1) from the first eight bytes of the SHA-256 of a text."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)
