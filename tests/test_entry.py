"""All queries of the library itself against DuckDB at the smallest size; the entry point without its optional parts."""

import subprocess
import sys

import pytest

import __spark_entry__ as e
from inkwarp.plans import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as from '{D}/{t}.parquet'")
    return c


def canonical(df, columns):
    own = df[columns].astype(object)
    own = own.where(df[columns].notna(), None).map(lambda v: round(v, 6) if isinstance(v, float) else v).astype(str)
    return own.sort_values(columns).values.tolist()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, D).toPandas()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(want.columns)
        assert canonical(got, columns) == canonical(want, columns)
    else:
        assert len(got)


def test_entry(spark):
    assert e.entry(spark).columns == ["a", "b", "df12", "dice"]


def test_entry_without_optional_parts():
    code = "import sys\nsys.modules['inkwarp.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.queries() and e.oracle_sql() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=e.__file__.rsplit("/", 1)[0])
