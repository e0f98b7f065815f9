"""Values that are known from outside of this code: inputs with the results that any engine of this kind must give."""

import json
import math

import pytest

from marginalia import facade
from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.operators import blocks as K
from marginalia.operators import bundle as B
from marginalia.operators import enrich as N
from marginalia.operators import evaluation as E
from marginalia.operators import layout as Y
from marginalia.operators import mutations as M
from marginalia.operators import reports as P
from marginalia.operators import retrieval as R
from marginalia.operators import review as V2
from marginalia.operators import scalars as S
from marginalia.sources import workbook as W


def box(kind, *b, order=0, conf=None, name=None, text=None):
    return {"block_id": name or kind, "block_type": kind, "block_order": order, "confidence": conf, "bbox": tuple(map(float, b)) or None, "text": text}


# Layout -----------------------------------------------------------------------------------------------------


def test_semantic_region_wins_and_large_container_goes():
    page = [box("section_header", 20, 20, 180, 45, conf=0.7), box("text", 20, 20, 180, 45, conf=0.9), box("abstract", 10, 60, 300, 300, conf=0.8), box("text", 20, 80, 280, 140, conf=0.7), box("text", 20, 160, 280, 220, conf=0.7)]
    assert [b["block_type"] for b in Y.dedup(page)] == ["section_header", "text", "text"]


@pytest.mark.parametrize("a, b, stays", [("table", "section_header", "table"), ("reference", "figure", "reference"), ("formula", "text", "formula"), ("header_footer", "figure", "figure")])
def test_classes_by_how_special_they_are(a, b, stays):
    for first, second in ((a, b), (b, a)):
        assert [x["block_type"] for x in Y.dedup([box(first, 0, 0, 100, 100, conf=0.1), box(second, 0, 0, 100, 100, conf=0.9)])][0] in (stays, first if Y.PRIORITY[first] == Y.PRIORITY[second] else stays)


def test_confidence_decides_between_equally_special_classes():
    pair = [box("author", 0, 0, 100, 100, conf=0.2), box("table", 0, 0, 100, 100, conf=0.9)]
    assert [b["block_type"] for b in Y.dedup(pair)] == ["table"] and [b["block_type"] for b in Y.dedup(pair[::-1])] == ["table"]


def test_partial_titles_are_united():
    out = Y.dedup([box("title", 150, 60, 360, 100, conf=0.4), box("title", 215, 60, 425, 100, conf=0.6, order=1)])
    assert len(out) == 1 and out[0]["bbox"] == (150, 60, 425, 100) and out[0]["confidence"] == 0.6


def test_lines_fit_blocks():
    lines = [((20.0, 50.0, 520.0, 80.0), 0.98), ((60.0, 170.0, 240.0, 190.0), 0.97), ((300.0, 160.0, 500.0, 180.0), 0.96), ((300.0, 185.0, 500.0, 205.0), 0.95)]
    out, n = Y.reconcile([box("title", 100, 40, 400, 90), box("text", 50, 150, 250, 250, order=1)], lines)
    assert next(b for b in out if b["block_type"] == "title")["bbox"] == (20, 40, 520, 90)
    assert n == {"detected": 4, "initial": 1, "final": 4, "expanded": 1, "added": 1} and len(out) == 3


def test_text_beside_an_abstract_joins_it():
    out, n = Y.reconcile([box("abstract", 100, 100, 300, 300)], [((100.0, 70.0, 300.0, 90.0), 0.95)])
    assert [(b["block_type"], b["bbox"]) for b in out] == [("abstract", (100, 70, 300, 300))] and n["expanded"] == 1 and n["added"] == 0
    # More than half a line away it is text of its own.
    out, n = Y.reconcile([box("abstract", 100, 100, 300, 300)], [((100.0, 65.0, 300.0, 85.0), 0.95)])
    assert len(out) == 2 and n["added"] == 1


def test_abstract_heading_is_taken_off():
    lines = [(240.0, 105.0, 350.0, 125.0), (110.0, 140.0, 490.0, 160.0), (110.0, 170.0, 480.0, 190.0), (110.0, 200.0, 470.0, 220.0)]
    out = Y.split_headings([box("abstract", 100, 100, 500, 260, conf=0.8)], lines)
    assert [(b["block_type"], b["bbox"]) for b in out] == [("section_header", lines[0]), ("abstract", (110, 140, 490, 220))]
    there = [box("section_header", 235, 100, 355, 128), box("abstract", 100, 100, 500, 260)]
    assert [b["block_type"] for b in Y.split_headings(there, lines)] == ["section_header", "abstract"]


def test_body_is_taken_out_of_a_header():
    lines = [(70.0, 90.0, 210.0, 110.0), (70.0, 130.0, 510.0, 150.0), (70.0, 160.0, 500.0, 180.0)]
    out = Y.split_headings([box("section_header", 60, 80, 520, 220, order=4)], lines)
    assert [(b["block_type"], b["bbox"]) for b in out] == [("section_header", lines[0]), ("text", (70, 130, 510, 180))]


def test_full_width_first_line_is_no_heading():
    lines = [(110.0, 110.0, 490.0, 130.0), (110.0, 140.0, 480.0, 160.0), (110.0, 170.0, 470.0, 190.0)]
    page = [box("abstract", 100, 100, 500, 220)]
    assert Y.split_headings(page, lines) == page


def test_headers_and_abstracts_without_lines_stay():
    lines = [(70.0, 90.0, 210.0, 110.0), (70.0, 130.0, 510.0, 150.0), (70.0, 160.0, 500.0, 180.0)]
    page = [box("section_header", 60, 380, 520, 420), box("abstract", 60, 500, 520, 700), box("abstract", 0, 0, 0, 0) | {"bbox": None}]
    assert Y.split_headings(page, lines) == page and Y.split_headings(page, []) == page
    # A block without an order is taken apart like any other.
    out = Y.split_headings([*page, box("section_header", 60, 80, 520, 220, order=None)], lines)
    assert out[:3] == page and [(b["block_type"], b["bbox"]) for b in out[3:]] == [("section_header", lines[0]), ("text", (70, 130, 510, 180))]


def test_inline_abstract():
    lines = [(82.0, 105.0, 498.0, 125.0), (82.0, 135.0, 495.0, 155.0), (82.0, 165.0, 490.0, 185.0)]
    page = [box("abstract", 80, 100, 500, 220)]
    out = Y.split_inline_abstracts(page, lines, {lines[0]: "Abstract This paper proposes a layout model."})
    assert [b["block_type"] for b in out] == ["section_header", "abstract", "abstract"]
    assert out[0]["bbox"][2] == out[1]["bbox"][0] and out[2]["bbox"] == (82, 135, 495, 185)
    assert Y.split_inline_abstracts(page, lines, {lines[0]: "This paper proposes a layout model."}) == page
    text = [box("text", 80, 100, 500, 220)]
    assert Y.split_inline_abstracts(text, lines, {lines[0]: "초록"}) == text
    assert [b["block_type"] for b in Y.split_inline_abstracts(text, lines, {lines[0]: "초록"}, texts=True)] == ["section_header", "abstract"]


def test_found_blocks_go_before_the_next_lower_one_of_their_column():
    page = [box("t", 10, 60, 290, 100, order=0, name="l1"), box("t", 10, 120, 290, 160, order=1, name="l2"), box("t", 310, 60, 590, 100, order=2, name="r1"), box("t", 310, 120, 590, 160, order=3, name="r2")]
    found = [box("t", 310, 104, 590, 116, name="f"), box("t", 10, 300, 290, 320, name="g")]
    assert [b["block_id"] for b in Y.merged_order(page, found)] == ["l1", "l2", "g", "r1", "f", "r2"]
    assert [b["block_id"] for b in Y.merged_order(page[:2], found)] == ["l1", "f", "l2", "g"]


# Tables -----------------------------------------------------------------------------------------------------


def grid(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(Y.grid_rows(T.F.col("t")).alias("g")).first().g


def test_lines_of_a_table(spark):
    # A line with one cell between its outer pipes has no pipe left: it goes on in the row before.
    assert grid(spark, "| a | b |\nmore of a\n\n| c |\nTable 2 next\n| x | y |") == [["a more of a c", "b"]]
    assert grid(spark, "a | b\nmore\nc | d\nTABLE 2\nx | y") == [["a more", "b"], ["c", "d"]]
    assert grid(spark, "title line\na | b") == [["a", "b"]] and grid(spark, None) == []


def test_merged_cells_are_inferred():
    assert E.table_html("a | a | b\nc | d | b") == '<table><tr><td colspan="2">a</td><td rowspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table>'
    assert E.table_html("x | x\nx | x") == '<table><tr><td colspan="2" rowspan="2">x</td></tr><tr></tr></table>'
    assert E.table_html(" | \n{a} | <b>") == "<table><tr><td></td><td></td></tr><tr><td>(a)</td><td><b></td></tr></table>" and E.table_html("") == "<table></table>"


def test_error_rates(spark):
    df = spark.createDataFrame([("a", "abc", "abX"), ("b", "a" * 10, "a" * 10), ("c", " ", "x"), ("d", "a−b", "a-b")], "key string, reference string, hypothesis string")
    rows = {r.key: r for r in E.character_errors(df).collect()}
    assert sum(rows[k].edits for k in "ab") / sum(rows[k].length for k in "ab") == 1 / 13 and "c" not in rows
    assert rows["d"].edits == 1  # the minus sign is no dash of those that are folded


# Metadata ---------------------------------------------------------------------------------------------------


def test_authors_before_affiliations(spark):
    blocks = [box("author", 158, 106, 239, 119, order=1, text="Jiapeng\nWang"), box("author", 373, 103, 440, 121, order=2, text="Kai Ding\n∗2,3"), box("author", 260, 103, 352, 121, order=3, text="Lianwen Jin*1,3,4"), box("author", 156, 119, 442, 135, order=4, text="1 South China University of Technology, Guangzhou, China"), box("author", order=5, text="author@example.edu")]
    ordered = [b["text"] for b in S.visual_rows(blocks)]
    got = spark.createDataFrame([(ordered,)], "b array<string>").select(T.author_list(T.F.col("b"))).first()[0]
    assert got == ["Jiapeng Wang", "Lianwen Jin", "Kai Ding"]


def test_keyword_labels_and_abstract_headings(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(T.F.col("x"))).first()[0]
    assert one(T.keyword_list, "Keywords: RAG, document layout, OCR") == ["RAG", "document layout", "OCR"]
    assert one(T.keyword_list, "CCS Concepts: Information systems -> Information retrieval") == ["Information systems -> Information retrieval"]
    assert one(T.strip_abstract_heading, "Abstract\nPaper summary") == "Paper summary" and one(T.strip_abstract_heading, "Abstraction works") == "Abstraction works"
    assert one(T.cut, "a|b\nc" + "x" * 70) == ("a/b ⏎ c" + "x" * 70)[:59] + "…"


def test_sentences_go_on(spark):
    long_ = "x" * 120
    assert len(K.merge_short([("a", long_ + " 한다"), ("a", "y" + long_)], 100)) == 1
    assert len(K.merge_short([("a", long_ + ".}"), ("a", "y" + long_)], 100)) == 2


def test_fallback_keywords(spark):
    t = spark.createDataFrame([(1, "Study of OCR ocr ab 연구 논문 데이터 데이터 this layout"), (2, None), (3, "")], "key long, text string")
    assert {r.key: r.keywords for r in N.fallback_keywords(t).collect()} == {1: ["ocr", "데이터", "layout"], 2: [], 3: []}


def test_keywords_are_resolved_three_ways(spark):
    stored = spark.createDataFrame([(1, "rag", 10, [1.0, 0.0]), (2, "ocr", None, [0.0, 1.0])], "keyword_id long, term string, frequency int, embedding array<double>")
    names = spark.createDataFrame([("retrieval augmented", 1)], "alias string, keyword_id long")
    batch = spark.createDataFrame([("rag", 2, None), ("retrieval augmented", 1, None), ("r.a.g.", 3, [0.99, 0.05]), ("other", 1, [0.7, 0.7]), ("another", 1, None)], "term string, n long, v array<double>")
    out, new = K.resolve_batch(batch, stored, names)
    assert {r.term: (r.keyword_id, r.frequency, r.via) for r in out.collect()} == {"rag": (1, 16, "term"), "retrieval augmented": (1, 16, "alias"), "r.a.g.": (1, 16, "merged"), "another": (3, 1, "new"), "other": (4, 1, "new")}
    assert [(r.alias, r.keyword_id) for r in new.collect()] == [("r.a.g.", 1)]


# Retrieval --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark):
    pad = lambda *x: [float(v) for v in x] + [0.0] * 62
    kw = spark.createDataFrame([(1, "rag", "RAG", 10, pad(1, 0)), (2, "ocr", "OCR", 5, pad(0.9, 0.1)), (3, "vector search", "Vector Search", 3, pad(0.8, 0.2)), (4, "low", "Low", 1, pad(0, 1)), (5, "orphan", "Orphan", 20, pad(1, 0))], "keyword_id long, keyword string, display_form string, frequency int, embedding array<double>")
    papers = spark.createDataFrame([(10, "RAG Retrieval Study", "A; B", 2023, "J", "abstract", "short", "http://x"), (20, "Other", None, 2019, None, None, None, None), (30, "OCR Related Paper", None, 2024, None, "", None, None)], "paper_id long, title string, authors string, published_year int, journal string, abstract string, abstract_summary string, full_text_link string")
    links = spark.createDataFrame([(10, 1, 0.8), (20, 1, 0.7), (30, 2, 0.9), (30, 3, 0.4)], "paper_id long, keyword_id long, score double")
    para = spark.createDataFrame([(10, 1, 1, "A", "first text", "clean one", "s1", ["k"], True, pad(1, 0)), (10, 2, 2, "A", "second", None, None, None, True, None), (10, 3, 3, "Method", "third", "", "s3", ["k", "l"], True, None), (20, 4, 1, "B", "b", "b", "b", [], True, pad(0.5, 0.866)), (30, 5, 1, None, "c", "c", "c", None, True, pad(0.9, 0.1)), (10, 6, 4, "A", "off", "off", "off", [], False, pad(1, 0))], "paper_id long, paragraph_id long, paragraph_order int, section_name string, original_text string, cleaned_text string, summary string, keywords array<string>, is_topic_relevant boolean, embedding array<double>")
    tabs = spark.createDataFrame([(1, 10, "Table 1. Scores", "metric | value\nf1 | 0.90", None), (2, 30, None, "no grid", "sum")], "table_id long, paper_id long, table_title string, table_text string, table_summary string")
    rel = spark.createDataFrame([(10, 30, 0.77)], "source_paper_id long, related_paper_id long, relation_score double")
    return B.Tables(papers, para, kw, links, tabs, rel)


def test_search_resolves_and_suggests(spark, tables):
    q = spark.createDataFrame([(1, "what is rag", ["rag"]), (2, "what is an orphan", ["orphan"])], "query_id long, text string, terms array<string>")
    matched, suggested = facade.search(q, tables)
    r = matched.collect()
    assert [(x.query_id, x.primary_id, x.related_id, x.matched_keyword) for x in r] == [(1, 10, 30, "RAG")]
    assert math.isclose(r[0].score, 0.89) and r[0].reason.startswith("대표 점수=0.890 (키워드 0.800*0.5=0.400, 단락 1.000*0.3=0.300, 제목/초록 1.000*0.1=0.100")
    assert r[0].primary_relevance == "clean one" and "'RAG'와 정확히 일치했습니다" in r[0].explanation and "'OCR Related Paper'도 함께" in r[0].explanation
    # The orphan is linked to no paper: never matched, never suggested.
    assert 5 not in {x.keyword_id for x in suggested.collect()}


def test_suggestions_in_order_of_similarity(spark, tables):
    one = spark.createDataFrame([(7, "x", [])], "query_id long, text string, terms array<string>")
    same = lambda c: T.F.array(*[T.F.lit(1.0)] + [T.F.lit(0.0)] * 63)
    from marginalia.config import Settings

    got = B.suggest(one, tables, same, Settings(similarity_floor=0.6)).orderBy("rank").collect()
    assert [r.display_form for r in got] == ["RAG", "OCR", "Vector Search"]


def test_cache_keeps_the_default_view(spark, tables):
    found = spark.createDataFrame([(1, 1, True, ["rag"])], "query_id long, keyword_id long, exact boolean, terms array<string>")
    empty = B.resolved(found.limit(0), tables).select(*B.CACHE_COLUMNS)
    first, cache = B.resolve_cached(found, empty, tables)
    assert cache.count() == 1 and first.first().primary_id == 10
    changed = cache.withColumn("primary_title", T.F.lit("CACHED"))
    hit, _ = B.resolve_cached(found.withColumn("terms", T.F.array(T.F.lit("asked"))), changed, tables)
    assert hit.first().primary_title == "CACHED" and hit.first().explanation.startswith("질의에서 asked 키워드를")
    again, after = B.resolve_cached(found, changed, tables, B.Options(force_refresh=True))
    assert again.first().primary_title == "RAG Retrieval Study" and after.first().primary_title == "RAG Retrieval Study"
    view, same = B.resolve_cached(found, changed, tables, B.Options(related=False))
    assert view.first().related_id is None and same.first().primary_title == "CACHED"


def test_workbook_of_a_result(spark, tables, tmp_path):
    q = spark.createDataFrame([(1, "rag", ["rag"])], "query_id long, text string, terms array<string>")
    result = facade.search(q, tables)[0].first().asDict()
    path = str(tmp_path / "out" / "r.xlsx")
    assert facade.workbook(result, tables, path, query="rag?") == list(B.SHEETS)
    got = W.read_workbook(path)
    assert got["검색 결과 요약"][0] == B.SUMMARY_HEAD and got["검색 결과 요약"][1][:4] == ["rag?", "rag", "RAG", "exact"]
    assert [r[:3] for r in got["대표 논문 섹션"][1:]] == [["1", "A", "2"], ["2", "Method", "1"]] and got["대표 논문 섹션"][1][3] == "first text\n\nsecond"
    assert [r[0] for r in got["대표 논문 단락"]] == ["단락 번호", "1", "2", "3"] and got["연관 논문 단락"][1][1] == ""
    assert got["연관 논문 정보"][0][-2:] == B.RELATION_HEAD and got["표 데이터"][1][:3] == ["대표", "1", "Table 1. Scores"]
    assert got["표 셀"][:3] == [["[대표] 표 1 — Table 1. Scores"], ["metric", "value"], ["f1", "0.90"]]
    o = B.Options(primary_sections=["method"], related=False, tables=False, abstract=False)
    assert facade.workbook(result, tables, path, o) == list(B.SHEETS[:4])
    got = W.read_workbook(path)
    assert [r[0] for r in got["대표 논문 단락"][1:]] == ["3"] and got["대표 논문 정보"][1][5:7] == ["", ""]


def test_rows_beyond_a_sheet_go_on_in_another(tmp_path):
    path = str(tmp_path / "w.xlsx")
    names = W.write_workbook([W.Sheet("a", ["n"], ([i] for i in range(7))), W.Sheet("b", ["x"], [[None], ["c\x01<&"], [True], [float("nan")]])], path, most=4)
    got = W.read_workbook(path)
    assert names == ["a", "a (2)", "a (3)", "b", "b (2)"] and [r[0] for n in names[:3] for r in got[n][1:]] == [str(i) for i in range(7)]
    assert [r[0] for n in names[3:] for r in got[n][1:]] == ["", "c<&", "1", "nan"] and W.column_name(28) == "AB"


def test_relation_reason(spark):
    df = spark.createDataFrame([(1.0, 1 / 3, 0.9, ["rag"])], "c double, j double, y double, o array<string>")
    text = df.select(B.relation_reason(T.F.col("c"), T.F.col("j"), T.F.col("y"), T.F.col("o"))).first()[0]
    assert text == "관계 점수=0.790 (논문 임베딩 cosine 1.000*0.6=0.600, 키워드 Jaccard 0.333*0.3=0.100, 연도 근접도 0.900*0.1=0.090); 겹치는 키워드: rag"


def test_relations_in_blocks_are_the_same(spark, monkeypatch):
    rows = [(i, 2000 + i % 9, [float((i * k) % 7 + 1) for k in range(1, 5)], sorted({f"t{i % 5}", f"u{i % 3}"})) for i in range(60)]
    prof = spark.createDataFrame(rows, "paper_id long, published_year int, v array<double>, terms array<string>")
    whole = sorted(map(tuple, R.relations(prof, top=5).collect()))
    monkeypatch.setattr(V, "ROWS", 7)
    monkeypatch.setattr(V.query_blocks, "__defaults__", (16,))
    assert sorted(map(tuple, R.relations(prof, top=5).collect())) == whole and len(whole) == 300


def test_section_choice():
    assert B.section_choice([], True) == (None, True) and B.section_choice(["초록"], True) == ([B.NO_SECTION], True)
    assert B.section_choice(["A"], True) == (["A"], False) and B.section_choice(["초록", "A"], True) == (["A"], True)
    assert B.section_choice(["A"], False, False) == (["A"], False)


# Enrichment -------------------------------------------------------------------------------------------------


def test_enrichment_tries_twice_and_falls_back(spark):
    asked = []

    def plug(requests):
        asked.append(1)
        F = T.F
        good = F.lit('{"summary": " fine ", "keywords": ["a", " a", "", "b"]}')
        return requests.select("key", F.when(F.col("key") == 1, good).when((F.col("key") == 2) & (F.col("attempt") == 1), good).when(F.col("key") == 3, F.lit('{"summary": "漢字"}')).otherwise("broken").alias("response"))

    t = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z" * 300), (4, " "), (5, None)], "key long, text string")
    got = {r.key: (r.via, r.summary, r.keywords, r.is_topic_relevant) for r in N.enrich(t, N.PARAGRAPH, plug).collect()}
    assert len(asked) == 2 and got[1] == ("model", "fine", ["a", "b"], True) and got[2][0] == "retry"
    assert got[3] == ("fallback", "z" * 200, [], True) and got[4] == got[5] == ("fallback", "", [], True)
    with pytest.raises(Exception, match="no valid answer in two tries for 3"):
        N.enrich(t, N.PARAGRAPH, plug, degraded=False).collect()


def test_registry():
    with pytest.raises(ValueError, match="known: docling, paddle, simple"):
        N.REGISTRY.get("layout", "none")
    with pytest.raises(ValueError):
        N.Registry().add("other", "x", print)
    assert N.REGISTRY.get("embed", " HASH ") is V.hash_vector


# Review -----------------------------------------------------------------------------------------------------


def test_metrics_as_shown(spark):
    q = spark.createDataFrame([("a", 10, 0.9, 0.8, None), ("b", 10, 0.5, 0.75, 0), ("c", None, None, None, None), ("d", 4, 0.5, 1.0, 0)], "document_id string, detected int, initial double, final double, uncovered int")
    got = {r.document_id: (r.detected, r.initial, r.final, r.uncovered) for r in V2.layout_metrics(q).collect()}
    assert got == {"a": (10, 0.9, 0.9, 1), "b": (10, 0.5, 0.75, 2), "c": (0, 0.0, 0.0, 0), "d": (4, 0.5, 1.0, 0)}


def test_training_files(spark, tmp_path):
    a = spark.createDataFrame([("layout/images/p1.png", 100, 200, "Doc", 1, [("text", [10.0, 20.0, 80.0, 60.0]), ("odd", [0.0, 0.0, 1.0, 1.0]), ("table", [5.0, 5.0, 5.0, 9.0])])], "image string, width int, height int, document_id string, page int, blocks array<struct<label:string,bbox:array<double>>>")
    labels = spark.createDataFrame([("ocr/x.png", "a\tb\nc ", "Doc", "b1"), ("ocr/y.png", " ", "Doc", "b2")], "image string, text string, document_id string, block_id string")
    images, boxes = E.coco(a, ratio=0.0)
    stats = E.write_training(images, boxes, E.ocr_lines(labels, ratio=0.0), str(tmp_path))
    coco = json.loads((tmp_path / "layout" / "train.json").read_text())
    assert coco["images"] == [{"id": 1, "file_name": "p1.png", "width": 100.0, "height": 200.0}]
    assert [(x["bbox"], x["category_id"], x["image_id"], x["iscrowd"]) for x in coco["annotations"]] == [([10, 20, 70, 40], 5, 1, 0)] and len(coco["categories"]) == 12
    assert (tmp_path / "ocr" / "train.txt").read_text() == "x.png\ta b c\n" and json.loads((tmp_path / "layout" / "val.json").read_text())["images"] == []
    assert stats == {"layout_train_pages": 1, "ocr_train_crops": 1, "layout_val_pages": 0, "ocr_val_crops": 0}


def test_job_log_and_calls(spark):
    log = spark.createDataFrame([], "paper_id long, stage string, status string, error string, started_at timestamp, finished_at timestamp")
    changes = spark.createDataFrame([(1, "parse", "running", None, "2024-01-01"), (1, "parse", "failed", "x", "2024-01-02"), (2, "parse", "queued", None, "2024-01-01")], "paper_id long, stage string, status string, error string, at string").withColumn("at", T.F.col("at").cast("timestamp"))
    out = M.append_jobs(log, changes)
    assert [(r.started_at is not None, r.finished_at is not None) for r in out.collect()] == [(True, False), (False, True), (False, False)]
    assert {(r.paper_id, r.state) for r in M.job_states(out).collect()} == {(1, "FAILURE"), (2, "PENDING")}
    with pytest.raises(Exception, match="unknown state"):
        M.append_jobs(log, changes.withColumn("status", T.F.lit("odd"))).collect()
    calls = P.record_calls(spark.createDataFrame([], P.CALLS), spark.createDataFrame([("op", "not a number", "p")], "operation string, latency_ms string, prompt string"))
    row = calls.first()
    assert row.latency_ms is None and row.success is False and P.list_calls(calls, "op", False).count() == 1 and P.list_calls(calls, "op", True).count() == 0


def test_dense_numbers_in_order(spark):
    from marginalia.operators.grouped import numbered

    df = spark.createDataFrame([(i % 2, (i * 37) % 101) for i in range(101)], "g int, x int").repartition(5)
    got = sorted((r.g, r.x, r.id) for r in numbered(df, ["g"], ["x"], "id", 10).collect())
    for g in (0, 1):
        mine = [(x, i) for gg, x, i in got if gg == g]
        assert [i for _, i in mine] == list(range(11, 11 + len(mine)))


def test_batch_reports_are_appended(spark, tmp_path):
    runs = spark.createDataFrame([("a.pdf", 1, 3, None), ("b.pdf", None, 0, "bad | file"), ("c.pdf", 2, 0, "late")], "source string, paper_id long, paragraphs int, error string").selectExpr("*", "0 as keywords", "0 as tables", "0 as relations")
    log = spark.createDataFrame([("parse", "done"), ("parse", "failed"), ("embed", "done"), ("embed", "running")], "stage string, status string")
    for at in ("10:00", "11:00"):
        path = V2.append_report(runs, log, str(tmp_path / "r"), "2024-01-01", at)
    text = open(path, encoding="utf-8").read()
    assert text.count("- 처리 건수: 2") == 2 and "| embed | 1 | 0 |\n| parse | 1 | 1 |" in text and text.count("| `b.pdf` | bad / file |") == 2
    lines = [r.line for r in V2.batch_report(runs).collect()]
    assert lines[0].startswith("source | paper_id | paragraphs") and set(lines[1]) == {"-", "+"} and lines[3].endswith("| failed: bad | file") and lines[4].rstrip().endswith("| failed")


def test_evaluation_workbook(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/review_documents.parquet").filter("paper_id is not null")
    sheets = V2.evaluation_sheets(spark, data, docs, "http://x/")
    path = str(tmp_path / "e.xlsx")
    assert V2.write_evaluation(sheets, path) == list(V2.EVALUATION)
    got = W.read_workbook(path)
    assert all(got[k][0] == v for k, v in V2.EVALUATION.items()) and len(got["논문요약"]) == docs.count() + 1
    assert got["논문요약"][1][17] == f"http://x/documents/{got['논문요약'][1][0]}/viewer"


def test_review_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/review_documents.parquet")
    rows = facade.review(docs, "all").collect()
    assert len(rows) == docs.count() and all(" · 미검수 " in r.label for r in rows)
    assert facade.review(docs.limit(0), "pending").count() == 0
