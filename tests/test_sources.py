import json

import pytest

from marginalia import skew
from marginalia.sources import files as S
from marginalia.storage import drop_table, persist_table


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    got = {r.path.rsplit("/", 1)[1]: (r.is_pdf, r.byte_size) for r in S.pdf_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (True, 10), "b.pdf": (False, 7)}


def test_classify_pdf(spark):
    pages = spark.createDataFrame([("d", True)] * 4 + [("d", False), ("s", True), ("s", False)], "document_id string, has_text boolean")
    documents = spark.createDataFrame([("d",), ("s",), ("none",)], "document_id string")
    assert {r.document_id: r.kind for r in S.classify_pdf(documents, pages).collect()} == {"d": "digital", "s": "scanned", "none": "scanned"}


def test_list_of_pdf_files_reads_no_content(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "a.pdf").write_bytes(b"x")
    df = S.list_pdf(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in df.collect()] == ["a.pdf", "b.pdf"]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def work(i, **more):
    return {"id": f"https://works.example/W{i}", "doi": "https://doi.org/10.1/X", "title": " A  b ", "publication_year": 2020, "language": "en", "is_retracted": False, "authorships": [{"author": {"display_name": "Ann"}}, {"author": {"display_name": None}}], "best_oa_location": {"license": "CC-BY", "pdf_url": "https://x/y.pdf", "source": {"display_name": "J"}}} | more


def test_candidates(spark, tmp_path):
    rows = [work(1), work(1), work(2, is_retracted=True), work(3, title=""), work(4, best_oa_location={"license": "closed", "pdf_url": "https://x"}), work(5, best_oa_location=None), work(6, id="none")]
    (tmp_path / "w.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = S.candidates(S.works(spark, str(tmp_path / "w.json"))).collect()
    assert [(r.source_id, r.title, r.authors, r.doi, r.journal) for r in got] == [("W1", "A b", ["Ann"], "10.1/X", "J")]


def test_licences_numbers_and_listed_works(spark, tmp_path):
    rows = [work(1), work(2, best_oa_location={"license": "public-domain", "pdf_url": "https://x"}), work(3, id="https://works.example/w3/"), work(4, best_oa_location={"license": "cc0", "pdf_url": "http://x"})]
    (tmp_path / "w.json").write_text("\n".join(map(json.dumps, rows)))
    c = S.candidates(S.works(spark, str(tmp_path / "w.json")))
    assert sorted(r.source_id for r in c.collect()) == ["W1", "W3"]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r.source_id for r in S.listed(c, ids("https://works.example/W3", "w3")).collect()] == ["W3"]
    for bad in ("W2", "W9", "nothing"):
        with pytest.raises(Exception, match="not to be collected"):
            S.listed(c, ids("W1", bad)).collect()


def test_sizes_smoke_sets_and_backfill(spark):
    f = spark.createDataFrame([("a", 0, None), ("b", 10, None), ("c", 10, 30), ("d", 30, 10)], "source_id string, byte_size long, declared long")
    assert [r.source_id for r in S.within_size(f, 20).collect()] == ["b"]
    m = spark.createDataFrame([("W1", "aa", 5), ("W2", "bb", 1)], "source_id string, sha256 string, pages int")
    assert [(r.local_path, r.page_range, r.derived_from_sha256) for r in S.smoke_set(m, "/s/", 2).orderBy("source_id").collect()] == [("/s/W1-smoke-2p.pdf", "1-2", "aa"), ("/s/W2-smoke-1p.pdf", "1-1", "bb")]
    with pytest.raises(ValueError):
        S.smoke_set(m, "/s", 0)
    docs = spark.createDataFrame([("x", 1, 1), ("x", 1, 2), ("y", 9, 1), ("z", None, 1)], "document_id string, paper_id long, updated_at int")
    saved, skipped = S.backfill(docs, spark.createDataFrame([(1,)], "paper_id long"))
    assert sorted((r.document_id, r.updated_at) for r in saved.collect()) == [("x", 2), ("z", 1)] and [r.document_id for r in skipped.collect()] == ["y"]


def test_migrations_run_once_and_in_order(spark, tmp_path):
    ran, path = [], str(tmp_path / "history")
    step = lambda n: lambda s: ran.append(n)

    def fails(s):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        S.migrate(spark, {"2": fails, "1": step("1")}, path)
    assert S.migrate(spark, {"2": step("2"), "1": step("1"), "3": step("3")}, path) == ["2", "3"] and ran == ["1", "2", "3"]


def test_last_record_of_a_key_wins(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"source_id": "W1", "title": "old", "retrieved_at": "2024-01-01"}\n{"source_id": "W1", "title": "new", "retrieved_at": "2024-02-01"}\n')
    assert [r.title for r in S.manifest(spark, str(tmp_path / "m.json")).collect()] == ["new"]


def test_manifest_versions(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{"source_id": "W2", "title": "old"}\n\n{"source_id": "W1", "title": "one"}\n')
    new = spark.createDataFrame([("W2", "new")], "source_id string, title string")
    out = S.manifest_upsert(spark, str(p), new)
    assert [(r.source_id, r.title) for r in S.jsonl(spark, out, S.MANIFEST).orderBy("source_id").collect()] == [("W1", "one"), ("W2", "new")]


def test_bad_line_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"source_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        S.jsonl(spark, str(tmp_path / "bad.json"), S.MANIFEST).collect()


def test_lookup_order(spark):
    m = spark.createDataFrame([("W1", "t", "/d/a.pdf"), ("W7", "t", "/e/b.pdf")], "source_id string, title string, local_path string")
    f = spark.createDataFrame([("/d/a.pdf",), ("/x/b.pdf",), ("/x/W7 copy.pdf",), ("/x/none.pdf",)], "path string")
    assert [r.source_id for r in S.lookup_source(f, m).orderBy("path").collect()] == ["W1", "W7", "W7", None]


def test_persisted_table_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, ["a"], None)], "a long, b array<string>, c string")
    t = persist_table(df, "t")
    assert t.collect() == df.collect() and t.dtypes == df.dtypes
    drop_table(t)


def test_hot_aware_join_equals_join(spark):
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, x long")
    keys = big.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n")
    got = skew.hot_aware_join(big, keys, "k", "n", 3000)
    assert sorted(got.select("k", "x", "n").collect()) == sorted(big.join(keys, "k").select("k", "x", "n").collect())
