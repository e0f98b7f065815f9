import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from marginalia.session import local_session  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", "6g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.is_dir():
        pytest.skip("no test data")
    return str(DATA)


def _null_row(fields):
    return tuple(None for _ in fields)


@pytest.fixture(scope="session")
def empty_dir(spark, data, tmp_path_factory):
    """All tables without rows."""
    out = tmp_path_factory.mktemp("empty")
    for p in Path(data).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(str(out / p.name))
    return str(out)


@pytest.fixture(scope="session")
def dirty_dir(spark, data, tmp_path_factory):
    """The smallest tables with rows of nulls, repeated rows, empty and very long texts, and extra columns of clashing names."""
    from pyspark.sql import functions as F

    out = tmp_path_factory.mktemp("dirty")
    extra = ("key", "n", "r", "id", "part", "word", "tokens", "rank", "kind", "size", "text2", "u", "v", "w")
    for p in Path(data).glob("*.parquet"):
        df = spark.read.parquet(str(p))
        nulls = spark.createDataFrame([_null_row(df.columns)] * 2, df.schema)
        one = df.limit(3)
        strings = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        long_ = df.limit(1).select(*[F.repeat(F.concat(F.coalesce(F.col(c), F.lit("x")), F.lit(" Word one. ")), 3000).alias(c) if c in strings and c in ("text", "passage", "original_text", "cleaned_text", "summary", "abstract", "abstract_summary", "table_text", "title") else F.col(c) for c in df.columns])
        blank = df.limit(2).select(*[F.lit("").alias(c) if c in strings else F.col(c) for c in df.columns])
        allof = df.unionByName(nulls).unionByName(one).unionByName(long_).unionByName(blank)
        for c in extra:
            if c not in df.columns:
                allof = allof.withColumn(c, F.lit("clash"))
        allof.coalesce(1).write.parquet(str(out / p.name))
    return str(out)
