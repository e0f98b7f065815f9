import hashlib
import math

from pyspark.sql import functions as F

from marginalia.functions import boxes as B
from marginalia.functions import text as T
from marginalia.functions import vectors as V


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in [(k, "string" if v is None or isinstance(v, str) else "array<double>" if v and isinstance(v[0], float) else "array<string>") for k, v in values.items()]))
    return df.select(expr).first()[0]


def test_normalisers(spark):
    assert one(spark, T.keyword(F.col("x")), x="  Deep 　 Learning ") == "deep learning"
    assert one(spark, T.clean_lines(F.col("x")), x=" a  b \n\n c ") == "a b\nc"
    assert one(spark, T.slug(F.col("x")), x="  Ein Test: Nr. 5! ") == "ein-test-nr-5" and one(spark, T.slug(F.col("x")), x="한글") == "paper"
    assert one(spark, T.doi(F.col("x")), x="https://doi.org/10.1/AbC") == "10.1/AbC"
    assert one(spark, T.work_id(F.col("x")), x="https://works.example/W123") == "W123" and one(spark, T.work_id(F.col("x")), x="none") is None
    assert one(spark, T.year(F.col("x")), x="in 2018 and 2020") == 2018 and one(spark, T.year(F.col("x")), x="12019") is None
    assert one(spark, T.strip_abstract_heading(F.col("x")), x="초록: 본문") == "본문"
    assert one(spark, T.author_list(F.array("x")), x="Ann Lee1,*, Bo Ek†; Cy") == ["Ann Lee", "Bo Ek", "Cy"]
    assert one(spark, T.keyword_list(F.col("x")), x="Keywords: OCR; layout , OCR.") == ["OCR", "layout"]
    assert one(spark, T.query_terms(F.col("x")), x="RAG 검색 a B2 의") == ["RAG", "검색", "B2"]
    assert one(spark, T.unique_terms(F.col("x")), x=["A ", "a", "", "b"]) == ["a", "b"]
    assert one(spark, T.cut(F.col("x"), 5), x="a|b\ncdef") == "a/b …"
    assert one(spark, T.keyword(F.col("x")), x=None) is None


def test_hash_share_is_the_digest(spark):
    d = hashlib.sha256(b"doc").digest()
    assert math.isclose(one(spark, T.hash_share(F.col("x")), x="doc"), int.from_bytes(d[:8], "big") / 2**64)


def test_cosine_cases(spark):
    c = V.cosine(F.col("a"), F.col("b"))
    assert math.isclose(one(spark, c, a=[1.0, 0.0], b=[0.5, math.sqrt(3) / 2]), 0.5)
    assert one(spark, c, a=[1.0, 0.0], b=[1.0]) == 0 and one(spark, c, a=[0.0, 0.0], b=[1.0, 1.0]) == 0


def test_hash_vector_is_unit_and_from_sha256(spark):
    v = one(spark, V.hash_vector(F.col("x"), 8), x="text")
    raw = [int.from_bytes(hashlib.sha256(b"text\0" + str(i).encode()).digest()[:4], "big") / 2**32 * 2 - 1 for i in range(8)]
    n = math.sqrt(sum(x * x for x in raw))
    assert all(math.isclose(a, b / n, rel_tol=1e-12) for a, b in zip(v, raw))


def test_best_matches_ties_and_blocks(spark):
    vec = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)] + [(99, None), (98, [1.0]), (97, [0.0, 0.0])], "id long, v array<double>").repartition(4)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, q array<double>")
    got = [(r.id, round(r.similarity, 6)) for r in V.best_matches(q, vec, 0.5, 4).orderBy("rank").collect()]
    assert got == [(0, 1.0), (3, 1.0), (6, 1.0), (9, 1.0)]


def test_boxes(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0), None)], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>, n struct<x1:double,y1:double,x2:double,y2:double>")
    r = df.select(B.iou(df.a, df.b), B.inside(df.a, df.b), B.iou(df.a, df.n), B.area(df.n), B.text(df.a), B.clip(df.b, F.lit(8.0), F.lit(8.0)), B.clip(df.b, F.lit(4.0), F.lit(8.0))).first()
    assert math.isclose(r[0], 1 / 3) and r[1] == 0.5 and r[2] == 0 and r[3] == 0 and r[4] == "0.00, 0.00, 10.00, 10.00"
    assert tuple(r[5]) == (5.0, 0.0, 8.0, 8.0) and r[6] is None
