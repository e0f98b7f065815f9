import math

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.operators import blocks as K
from marginalia.operators import evaluation as E
from marginalia.operators import layout as Y
from marginalia.operators import mutations as M
from marginalia.operators import reports as P
from marginalia.operators import retrieval as R
from marginalia.operators import scalars as S


@pytest.fixture(scope="module")
def seed(spark):
    kw = spark.createDataFrame([(1, "rag", "RAG", 10, [1.0, 0.0]), (2, "ocr", "OCR", 5, [0.9, 0.1]), (3, "vector search", "Vector Search", 3, [0.8, 0.2]), (4, "low", "Low", 1, [0.0, 1.0]), (5, "orphan", "Orphan", 20, [1.0, 0.0])], "keyword_id long, keyword string, display_form string, frequency int, embedding array<double>")
    papers = spark.createDataFrame([(10, "RAG Retrieval Study", 2023, ""), (20, "Other", 2019, None), (30, "OCR Related Paper", 2024, "")], "paper_id long, title string, published_year int, abstract string")
    links = spark.createDataFrame([(10, 1, 0.8), (20, 1, 0.7), (30, 2, 0.9), (30, 3, 0.4), (20, 4, 0.1)], "paper_id long, keyword_id long, score double")
    para = spark.createDataFrame([(10, 1, 1, "A", True, [1.0, 0.0]), (20, 2, 1, "B", True, [0.5, 0.866]), (30, 3, 1, "C", True, [0.9, 0.1]), (10, 4, 2, "A", False, [1.0, 0.0])], "paper_id long, paragraph_id long, paragraph_order int, section_name string, is_topic_relevant boolean, embedding array<double>")
    return kw, papers, links, para


def test_primary_paper_score(seed):
    kw, papers, links, para = seed
    best = R.select_primary(R.primary_scores(links, kw, papers, para, 2024, 2)).filter("keyword_id = 1").first()
    assert best.paper_id == 10 and math.isclose(best.total, 0.89)


def test_orphans_are_not_linked(seed):
    kw, _, links, _ = seed
    assert {r.keyword_id for r in R.linked(kw, links).collect()} == {1, 2, 3, 4}


def test_relation_score_and_both_directions(spark):
    prof = spark.createDataFrame([(10, 2024, [1.0, 0.0], ["pdf", "rag"]), (20, 2023, [1.0, 0.0], ["ocr", "rag"]), (30, 2000, [0.0, 1.0], ["other"]), (40, None, None, [])], "paper_id long, published_year int, v array<double>, terms array<string>")
    rel = R.relations(prof, "paper_id = 10", 1).collect()
    assert [(r.related_paper_id, round(r.relation_score, 6)) for r in rel] == [(20, round(0.6 + 0.3 / 3 + 0.09, 6))]
    top = {r.paper_id: r.peer_id for r in R.top_relation(R.relations(prof, "paper_id = 10", 2)).collect()}
    assert top == {10: 20, 20: 10, 30: 10}


def test_section_filter_is_literal(spark):
    p = spark.createDataFrame([(1, "Methods_A", True), (2, "methodsXa", True), (3, "methods_a", False), (4, None, True)], "id long, section_name string, is_topic_relevant boolean")
    ids = lambda names: [r.id for r in R.section_filter(p, names).collect()]
    assert ids("methods_a") == [1] and ids([" "]) == [1, 2, 4] and ids(["none"]) == []


def test_section_folds_keep_returning_sections_apart(spark):
    rows = [(1, i, i, s, t, k) for i, (s, t, k) in enumerate([("A", "x", ["k"]), ("A", None, ["k", "l"]), (" ", "y", None), ("A", "z", [])])]
    p = spark.createDataFrame(rows, "paper_id long, paragraph_id long, paragraph_order int, section_name string, original_text string, keywords array<string>")
    got = [(r.section_name, r.paragraph_count, r.original_text, r.keywords) for r in R.section_folds(p, "body").orderBy("section_order").collect()]
    assert got == [("A", 2, "x", "k|l"), ("body", 1, "y", ""), ("A", 1, "z", "")]


def test_best_exact_match_weighs_place_and_frequency(spark, seed):
    kw = seed[0]
    terms = spark.createDataFrame([(1, 1, "ocr"), (1, 2, "rag"), (2, 1, "missing")], "query_id long, pos int, term string")
    texts = spark.createDataFrame([(1, "ocr and rag"), (2, "missing")], "query_id long, text string")
    got = R.best_exact(terms, texts, R.dictionary(kw), R.aliases(kw), kw).collect()
    assert [(r.query_id, r.term) for r in got] == [(1, "ocr")]


def blocks(spark, rows):
    return spark.createDataFrame([("d", 1, f"b{i}", r[2] if len(r) > 2 else 1, r[0], r[1], i, i, r[3] if len(r) > 3 else None, None) for i, r in enumerate(rows)], "document_id string, paper_id long, block_id string, page int, block_type string, text string, block_order int, ordinal int, bbox struct<x1:double,y1:double,x2:double,y2:double>, confidence double")


def test_routes(spark):
    rows = [("title", "T"), ("text", "Some Author"), ("abstract", "Abs"), ("section_header", "Abstract"), ("section_header", "Intro"), ("text", "Body"), ("abstract", "late"), ("text", "Figure 3 shows"), ("header_footer", "Keywords: a, b"), ("table_caption", "Table 1"), ("table", "a | b"), ("formula", "x"), ("text", "참고문헌"), ("text", "after"), ("table", "c | d")]
    got = {r.block_id: (r.block_type, r.route) for r in K.route(blocks(spark, rows)).collect()}
    assert [got[f"b{i}"][1] for i in range(15)] == ["meta", "meta", "meta", "dropped", "body", "body", "body", "dropped", "author_keywords", "table", "table", "dropped", "dropped", "dropped", "dropped"]
    assert got["b1"][0] == "author"
    titles = K.table_titles(K.route(blocks(spark, rows))).collect()
    assert [(r.block_id, r.title) for r in titles] == [("b10", "Table 1")]
    assert {r.section for r in K.sections(K.route(blocks(spark, rows))).collect()} == {"Intro"}


def test_paragraphs_merge_and_split():
    long_ = "x" * 120
    assert K.merge_short([("a", "short"), ("a", long_), ("b", long_)], 100) == [("a", f"short\n\n{long_}"), ("b", long_)]
    assert len(K.merge_short([("a", long_ + "."), ("a", "Y" + long_)], 100)) == 2
    assert len(K.merge_short([("a", long_ + " the re-"), ("a", "covery " + long_)], 100)) == 1
    pieces = K.split_long("One sentence here. " * 10, 80)
    assert all(len(p) <= 80 and p.endswith(".") for p in pieces) and " ".join(pieces) == ("One sentence here. " * 10).strip()
    assert K.split_long("y" * 25, 10) == ["y" * 10, "y" * 10, "y" * 5]


def test_keyword_scores(spark):
    papers = spark.createDataFrame([(1, "On RAG", "rag abstract")], "paper_id long, title string, abstract string")
    para = spark.createDataFrame([(1, ["rag", "ocr", "ocr"]), (1, ["RAG", "ocr", "ocr"])], "paper_id long, keywords array<string>")
    terms = spark.createDataFrame([(1, "rag", False), (1, "pdf", True)], "paper_id long, term string, is_author boolean")
    got = {r.term: r.score for r in K.keyword_scores(terms, papers, para).collect()}
    assert math.isclose(got["rag"], 0.6) and math.isclose(got["pdf"], 0.3)


def box(kind, *b, order=0, conf=0.5, name=None):
    return {"block_id": name or kind, "block_type": kind, "block_order": order, "confidence": conf, "bbox": b or None}


def test_dedup_of_boxes():
    out = Y.dedup([box("title", 0, 0, 100, 20), box("title", 10, 5, 120, 25), box("text", 0, 100, 100, 200), box("abstract", 0, 100, 100, 199)])
    assert [b["block_type"] for b in out] == ["title", "abstract"] and out[0]["bbox"] == (0, 0, 120, 25)
    container = [box("figure", 0, 0, 100, 100), box("text", 0, 0, 100, 40, name="a"), box("text", 0, 50, 100, 90, name="b")]
    assert [b["block_id"] for b in Y.dedup(container)] == ["a", "b"]
    assert [b["block_type"] for b in Y.dedup([box("text", 0, 0, 100, 100), box("figure", 0, 0, 100, 30), box("table", 0, 50, 100, 90)])] == ["text", "figure", "table"]


def test_two_columns_are_read_left_first():
    page = [box("t", 10, 0, 590, 40, name="title"), box("t", 310, 60, 590, 100, name="r1"), box("t", 10, 60, 290, 100, name="l1"), box("t", 310, 120, 590, 160, name="r2"), box("t", 10, 120, 290, 160, name="l2"), box("t", name="none")]
    assert [b["block_id"] for b in Y.reading_order(page)] == ["title", "l1", "l2", "r1", "r2", "none"]


def test_lines_grow_and_add_blocks():
    blocks_ = [box("title", 20, 40, 400, 90), box("text", 20, 200, 500, 300)]
    lines = [((20, 45, 520, 85), 0.9), ((20, 210, 500, 240), 0.9), ((20, 500, 500, 520), 0.8), ((20, 525, 500, 545), 0.6)]
    out, n = Y.reconcile(blocks_, lines)
    assert n == {"detected": 4, "initial": 1, "final": 4, "expanded": 1, "added": 1}
    assert out[0]["bbox"] == (20, 40, 520, 90)


def test_html_tables():
    html = "<table><tr><th colspan='2'>a|b</th><th rowspan=2>c</th></tr><tr><td>1</td><td> 2 x</td></tr></table>"
    assert Y.html_grid(html) == "a/b | a/b | c\n1 | 2 x | c" and Y.html_grid("") == "" and Y.html_grid(None) == ""


def test_table_quality(spark):
    df = spark.createDataFrame([("a | b\n1 | 2\n3 | 4",), ("a | b\n |  | \n | x",), ("a | b",), (None,)], "t string")
    good, bad, short, none = [r[0] for r in df.select(Y.table_quality(df.t)).collect()]
    assert good > 0.9 and bad < 0.7 and short == 0 and none == 0


def test_character_errors(spark):
    df = spark.createDataFrame([("a", "abcde", "abXde"), ("b", " ", "x"), ("c", "“q”", '"q"'), ("d", "ab", None)], "key string, reference string, hypothesis string")
    got = {r.key: r.cer for r in E.character_errors(df).collect()}
    assert got == {"a": 0.2, "c": 0.0, "d": 1.0}


def test_table_similarity():
    t = "a | b\n1 | 2"
    assert E.teds(t, t) == 1 and 0 < E.teds(t, "a | b\n1 | 3") < 1 and E.teds(t, "") < 0.3
    assert E.tree_distance(("a", [("b", []), ("c", [])]), ("a", [("c", [])])) == 1


def test_versions_of_tables(spark):
    papers = spark.createDataFrame([(5, "x", "/a")], "paper_id long, title string, source_file_path string")
    new = spark.createDataFrame([(" ", "/b"), ("y", "/c")], "title string, source_file_path string")
    out = M.save_papers(papers, new).collect()
    assert sorted(r.paper_id for r in out) == [5, 6, 7] and {r.title for r in out} == {"x", "y", "Untitled"}
    left = M.delete_papers({"t": spark.createDataFrame([(1,), (2,), (None,)], "paper_id long")}, spark.createDataFrame([(1,)], "paper_id long"))
    assert left["t"].count() == 2
    old = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.1)], "source_paper_id long, related_paper_id long, relation_score double")
    new = spark.createDataFrame([(1, 9, 0.7), (1, 1, 0.9)], "source_paper_id long, related_paper_id long, relation_score double")
    assert {(r[0], r[1]) for r in M.replace_relations(old, new).collect()} == {(1, 9), (3, 4)}


def test_headers(spark):
    df = spark.createDataFrame([(["a", "", "a", "b", "a"],)], "h array<string>")
    assert df.select(P.headers(df.h)).first()[0] == ["a", "열2", "a_2", "b", "a_3"]


def test_summary_warnings(spark):
    df = spark.createDataFrame([("fine",), ("含中文",), ("```json",), (None,)], "s string")
    assert [r[0] for r in df.select(E.summary_warning(df.s)).collect()] == ["", "중국어/한자 혼입", "응답 형식 오염", ""]


def test_visual_rows():
    page = [box("author", 300, 10, 380, 20, name="b"), box("author", 10, 12, 90, 22, name="a"), box("author", 10, 40, 90, 50, name="c"), box("author", name="n")]
    assert [b["block_id"] for b in S.visual_rows(page)] == ["a", "b", "c", "n"]
    assert S.visual_rows([]) == [] and S.visual_rows(page[3:]) == page[3:]


def test_classes_from_text_layers(spark):
    lines = spark.createDataFrame([("d", 1, 1, "Small", 9.0), ("d", 1, 2, " The Title", 20.0), ("d", 1, 3, "also large", 20.0), ("d", 1, 4, "The Title", 9.0), ("d", 2, 1, "References and notes", 9.0), ("d", 2, 2, "[1]", 9.0), ("d", 2, 3, " ", 9.0), ("e", 1, 1, "Appendix", 9.0), ("e", 1, 2, "Large", 30.0)], "document_id string, page int, line int, text string, size double")
    assert [r.block_type for r in S.simple_layout(lines).orderBy("document_id", "page", "line").collect()] == ["text", "title", "text", "text", "reference", "reference", "reference", "reference"]
    items = [("title", "T"), ("section_header", "Abstract"), ("text", "a"), ("section_header", "Intro"), ("text", "b"), ("caption", "Table 1"), ("table", ""), ("picture", ""), ("caption", "Figure 1"), ("title", "again"), ("footnote", "1"), ("", "nothing"), ("text", "References\n[0]"), ("section_header", "Methods"), ("list_item", "[1]"), ("page_footer", "3"), ("odd", "x")]
    df = spark.createDataFrame([("d", i, *x) for i, x in enumerate(items)], "document_id string, item int, label string, text string")
    got = [r.block_type for r in S.typed_items(df).orderBy("item").collect()]
    assert got == ["title", "section_header", "abstract", "section_header", "text", "table_caption", "table", "figure", "figure_caption", "text", "header_footer", "reference", "section_header", "reference", "header_footer", "text"]


def test_markdown(spark):
    df = spark.createDataFrame([("a | b | c\n1 | 2",), ("none",)], "t string")
    assert [r[0] for r in df.select(S.markdown_grid(df.t)).collect()] == ["| a | b | c |\n| --- | --- | --- |\n| 1 | 2 |  |", None]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 4).flatmap(lambda w: st.lists(st.lists(st.sampled_from(["a", "b", "cd", "x y", ""]), min_size=w, max_size=w), min_size=1, max_size=5)))
def test_tables_as_html_and_back(rows):
    text = "\n".join(" | ".join(r) for r in rows)
    if all(text.split("\n")):
        assert Y.html_grid(E.table_html(text)) == text
