"""Every query of the catalogue against its SQL, over whole tables."""

from __future__ import annotations

import pytest
from duck import same_rows

from tallyforge.catalog.oracle import SQL
from tallyforge.catalog.queries import QUERIES


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, data, name):
    same_rows(QUERIES[name](spark, data), SQL[name], data)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = QUERIES["of_dataset"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)" in plan
    assert "text" not in plan


def test_first_n_is_limited_before_the_shuffle(spark, data):
    plan = QUERIES["head_per_tier"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["variant_expansion", "pivot_variants"])
def test_documents_without_text_or_source_have_their_variants(spark, tmp_path, name):
    rows = [(0, "a\n\"b\"", "en", "web"), (1, "", "en", "web"), (2, None, "de", "web"), (3, "c", None, None), (4, " ", "fr", "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    same_rows(QUERIES[name](spark, str(tmp_path)), SQL[name], str(tmp_path))
