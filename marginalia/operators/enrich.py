"""Enrichment of paragraphs, tables and abstracts by a model behind a plug, with its contract and what stands in when it fails.

A plug is a function of a DataFrame: ``enrich(requests(key, operation, prompt, attempt))``
gives answers(key, response), a JSON text per request.  Each request is tried twice, the
second time with a stricter prompt and a higher temperature; answers that are no object, lack what
is asked for, or hold characters that an answer must not hold are failures.  After two
failures the fallback stands in, or the plan raises if degraded results are not allowed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.storage import load, persist_table

from . import layout as Y
from . import scalars as S
from .blocks import KEYWORD_TOKEN, STOPWORDS

# How much of a text stands in for its summary, keywords asked for, and the temperature of the second try.
SUMMARY_CHARS, TABLE_CHARS, ABSTRACT_CHARS = 200, 200, 500
LEAST_KEYWORDS, MOST_KEYWORDS = 3, 5
RETRY_TEMPERATURE = 0.2
_OBJECT = "summary string, keywords array<string>, is_topic_relevant boolean"


def coerce_json(c: Column, schema: str = _OBJECT) -> Column:
    """A JSON object's fields as a struct; null where the text is no object."""
    s = T.strip(c)
    return F.when(F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}")), F.from_json(s, schema, {"mode": "PERMISSIVE"}))


def coerce_authors(c: Column) -> Column:
    """A list of names as one text: stripped, blanks dropped, joined by "; "; null is empty."""
    return F.array_join(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.strip), lambda x: x.isNotNull() & (x != "")), "; ")


def fallback_keywords(texts: DataFrame) -> DataFrame:
    """(key, keywords): the five most frequent tokens of texts(key, text), stop words left out; ties by token."""
    t = texts.select("key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(KEYWORD_TOKEN), F.lit(1))).alias("token")).filter(~F.col("token").isin(*STOPWORDS))
    g = t.groupBy("key", "token").agg(F.count("*").alias("n"))
    g = g.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "token"))).filter(F.col("r") <= MOST_KEYWORDS)
    top = g.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]).alias("keywords"))
    return texts.select("key").join(top, "key", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def _clean(c: Column) -> Column:
    """No character that an answer must not hold."""
    return ~T.has_ideographs(F.coalesce(c, F.lit("")))


@dataclass(frozen=True)
class Task:
    """An operation: its prompts, when an answer (the struct ``o``) is good, and what stands in, by the text."""

    operation: str
    prompt: Callable[[Column], Column]
    stricter: Callable[[Column], Column]
    good: Callable[[], Column]
    fallback: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def _no_words() -> Column:
    return F.array().cast("array<string>")


def _ask(head: str) -> Callable[[Column], Column]:
    return lambda text: F.concat(F.lit(head + "\n\n"), text)


_KO = "JSON only; no Han characters"
PARAGRAPH = Task(
    "paragraph_enrich", _ask("Summarise, list keywords, say whether it is on topic. " + _KO), _ask("Again, strictly. " + _KO),
    lambda: F.col("o").isNotNull() & F.col("o.summary").isNotNull() & _clean(F.col("o.summary")) & _clean(F.array_join("o.keywords", " ")),
    {"summary": lambda t: F.substring(T.strip(t), 1, SUMMARY_CHARS), "keywords": lambda t: _no_words(), "is_topic_relevant": lambda t: F.lit(True)},
)
TABLE = Task("table_summary", _ask("Summarise the table. " + _KO), _ask("Again, strictly. " + _KO), lambda: (T.strip(F.col("o.summary")) != "") & _clean(F.col("o.summary")), {"summary": lambda t: F.substring(T.strip(t), 1, TABLE_CHARS), "keywords": lambda t: _no_words(), "is_topic_relevant": lambda t: F.lit(None).cast("boolean")})
ABSTRACT = Task("abstract_summary", _ask("Summarise in two sentences. " + _KO), _ask("Again, strictly. " + _KO), lambda: (T.strip(F.col("o.summary")) != "") & _clean(F.col("o.summary")), {"summary": lambda t: F.substring(T.strip(t), 1, ABSTRACT_CHARS), "keywords": lambda t: _no_words(), "is_topic_relevant": lambda t: F.lit(None).cast("boolean")})
KEYWORDS = Task("keywords", _ask("List three to five keywords. " + _KO), _ask("Again, strictly. " + _KO), lambda: (F.size(T.clean_items(F.col("o.keywords"))) >= LEAST_KEYWORDS) & _clean(F.array_join("o.keywords", " ")), {"summary": lambda t: F.lit(None).cast("string"), "keywords": lambda t: _no_words(), "is_topic_relevant": lambda t: F.lit(None).cast("boolean")})

Plug = Callable[[DataFrame], DataFrame]


def enrich(texts: DataFrame, task: Task, plug: Plug | None = None, degraded: bool = True) -> DataFrame:
    """(key, summary, keywords, is_topic_relevant, via) of texts(key, text); via is model, retry or fallback.

    Without a plug all is fallback.  Blank texts are not asked for and give the fallback of
    an empty text.  A failure with ``degraded`` false is an error when the plan runs.
    """
    texts = texts.select("key", F.coalesce("text", F.lit("")).alias("text"))
    done, left = None, texts.filter(T.strip(F.col("text")) != "")
    for attempt, prompt in enumerate((task.prompt, task.stricter) if plug else ()):
        request = left.select("key", F.lit(task.operation).alias("operation"), prompt(F.col("text")).alias("prompt"), F.lit(attempt).alias("attempt"), F.lit(RETRY_TEMPERATURE if attempt else 0.0).alias("temperature"))
        answer = plug(request).groupBy("key").agg(F.min("response").alias("response"))
        tried = persist_table(left.join(answer, "key", "left").withColumn("o", coerce_json(F.col("response"))).withColumn("ok", F.coalesce(task.good(), F.lit(False))), f"enrich-{attempt}")
        words = T.clean_items(F.col("o.keywords"))
        one = tried.filter("ok").select("key", T.strip(F.col("o.summary")).alias("summary"), (F.slice(words, 1, MOST_KEYWORDS) if task is KEYWORDS else words).alias("keywords"), F.coalesce("o.is_topic_relevant", F.lit(True)).alias("is_topic_relevant"), F.lit("retry" if attempt else "model").alias("via"))
        done = one if done is None else done.unionByName(one)
        left = tried.filter("not ok").select("key", "text")
    rest = left.unionByName(texts.filter(T.strip(F.col("text")) == ""))
    if plug and not degraded:
        stop = F.raise_error(F.concat(F.lit(f"{task.operation}: no valid answer in two tries for "), F.col("key").cast("string")))
        rest = rest.withColumn("text", F.when(T.strip(F.col("text")) == "", F.col("text")).otherwise(stop))
    via = F.lit("fallback").alias("via")
    if task is KEYWORDS:
        rest = fallback_keywords(rest).select("key", F.lit(None).cast("string").alias("summary"), "keywords", F.lit(None).cast("boolean").alias("is_topic_relevant"), via)
    else:
        rest = rest.select("key", *[f(F.col("text")).alias(c) for c, f in task.fallback.items()], via)
    return rest if done is None else done.unionByName(rest)


@dataclass
class Registry:
    """Plugs by name: embed (text column to vector column), enrich (requests to answers), layout (blocks of a page to blocks, or lines or items to classes)."""

    plugs: dict[tuple[str, str], Callable] = field(default_factory=dict)

    def add(self, kind: str, name: str, plug: Callable) -> None:
        if kind not in ("embed", "enrich", "layout"):
            raise ValueError(f"unknown kind {kind}")
        self.plugs[kind, name.strip().lower()] = plug

    def get(self, kind: str, name: str) -> Callable:
        try:
            return self.plugs[kind, name.strip().lower()]
        except KeyError:
            known = ", ".join(sorted(n for k, n in self.plugs if k == kind))
            raise ValueError(f"unknown {kind} {name!r}; known: {known}") from None


#: What comes with the engine; renderers and recognisers are added by who has them.
REGISTRY = Registry()
REGISTRY.add("embed", "hash", V.hash_vector)
REGISTRY.add("layout", "simple", S.simple_layout)
REGISTRY.add("layout", "docling", S.typed_items)
REGISTRY.add("layout", "paddle", lambda blocks: Y.per_page(blocks, lambda page: Y.reading_order(Y.dedup(page))))


# Queries --------------------------------------------------------------------------------------------------


def _echo(requests: DataFrame) -> DataFrame:
    """A stand-in for a model: answers by the first letter of the text after the prompt's head; some are broken, some only the first time."""
    text = F.substring_index("prompt", "\n\n", -1)
    n = F.length(text) % 4
    good = F.to_json(F.struct(F.substring(text, 1, 20).alias("summary"), F.array(F.lit("a"), F.lit(" b "), F.lit("a"), F.lit("c")).alias("keywords"), F.lit(True).alias("is_topic_relevant")))
    return requests.select("key", F.when(n == 0, good).when((n == 1) & (F.col("attempt") == 0), F.lit("no json")).when(n == 2, F.lit('{"summary": "含漢字"}')).when(n == 3, F.lit("[1]")).otherwise(good).alias("response"))


def q_enrich(spark, d):
    """Paragraphs enriched by a stand-in whose answers are broken by the length of the text: how each came about."""
    p = load(spark, d, "paragraphs").select(F.col("paragraph_id").alias("key"), F.translate(F.col("cleaned_text"), "\n", " ").alias("text"))
    e = enrich(p, PARAGRAPH, _echo)
    return e.select(F.col("key").alias("paragraph_id"), "via", F.md5("summary").alias("summary"), F.size("keywords").alias("keywords"), "is_topic_relevant")


def q_enrich_fallback(spark, d):
    """Tables and abstracts without a model: their first characters."""
    t = load(spark, d, "paper_tables").select(F.concat(F.lit("t"), "table_id").alias("key"), F.col("table_text").alias("text"))
    a = load(spark, d, "papers").select(F.concat(F.lit("a"), "paper_id").alias("key"), F.col("abstract").alias("text"))
    out = enrich(t, TABLE).unionByName(enrich(a, ABSTRACT))
    return out.select("key", F.md5("summary").alias("summary"), "via")


def q_enrich_keywords(spark, d):
    """Keywords of every paper by the frequency of its tokens."""
    p = load(spark, d, "papers").select(F.col("paper_id").alias("key"), F.concat_ws(" ", "title", "abstract").alias("text"))
    return enrich(p, KEYWORDS).select(F.col("key").alias("paper_id"), F.array_join("keywords", "|").alias("keywords"))


def q_coerce_json(spark, d):
    """Property texts of the events as objects."""
    e = load(spark, d, "events")
    return e.select("event_id", coerce_json(F.col("props"), "k long")["k"].alias("k"))


def q_coerce_authors(spark, d):
    return load(spark, d, "papers").select("paper_id", coerce_authors(F.split("authors", ";")).alias("authors"))


def q_layout_registry(spark, d):
    """The blocks of all documents through the layout plug asked for by name."""
    from .blocks import document_blocks

    out = REGISTRY.get("layout", " Paddle ")(document_blocks(load(spark, d, "review_documents")))
    return out.groupBy("document_id").agg(F.count("*").alias("blocks"), F.max("position").alias("longest_page"))


QUERIES = {"enrich_contract": q_enrich, "enrich_fallback": q_enrich_fallback, "enrich_keywords": q_enrich_keywords, "coerce_json": q_coerce_json, "coerce_authors": q_coerce_authors, "layout_registry": q_layout_registry}
_S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SQL = {
    "enrich_contract": f"""with t as (select paragraph_id, replace(coalesce(cleaned_text, ''), chr(10), ' ') as t, length(replace(coalesce(cleaned_text, ''), chr(10), ' ')) % 4 as n from paragraphs),
v as (select *, case when {_S.format('t')} = '' or n in (2, 3) then 'fallback' when n = 1 then 'retry' else 'model' end as via from t)
select paragraph_id, via, md5(case when via = 'fallback' then substring({_S.format('t')}, 1, 200) else {_S.format('substring(t, 1, 20)')} end) as summary, (case when via = 'fallback' then 0 else 3 end)::int as keywords, true as is_topic_relevant from v""",
    "enrich_fallback": f"select 't' || table_id as key, md5(substring({_S.format(chr(99) + 'oalesce(table_text, ' + chr(39) * 2 + ')')}, 1, 200)) as summary, 'fallback' as via from paper_tables union all select 'a' || paper_id, md5(substring({_S.format(chr(99) + 'oalesce(abstract, ' + chr(39) * 2 + ')')}, 1, 500)), 'fallback' from papers",
    "enrich_keywords": f"with t as (select paper_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[A-Za-z][A-Za-z0-9_-]{{2,}}|[가-힣]{{2,}}')) as token from papers), g as (select paper_id, token, count(*) as n from t where token not in {STOPWORDS} group by 1, 2), r as (select *, row_number() over (partition by paper_id order by n desc, token) as r from g), j as (select paper_id, string_agg(token, '|' order by r) as k from r where r <= 5 group by 1) select paper_id, coalesce(k, '') as keywords from papers left join j using (paper_id)",
    "coerce_json": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "coerce_authors": "select paper_id, coalesce(array_to_string(list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x)), lambda x: x <> ''), '; '), '') as authors from papers",
}
