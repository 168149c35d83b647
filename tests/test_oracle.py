"""Every registered query against its DuckDB oracle (rows-only where there is none)."""

from logspark.plans import catalog
from logspark.plans.verify import check
from tests.conftest import SF_SMALL


def test_every_query_has_a_builder_and_sql_names_match():
    names = set(catalog.queries())
    assert set(catalog.oracle_sql()) <= names
    assert len(names) == len(catalog.REGISTRY)


def test_all_queries_match_oracle(spark):
    res = check(spark, SF_SMALL)
    bad = {k: v for k, v in res.items() if not v["ok"]}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns == ["severity", "n"]
