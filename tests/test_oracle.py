"""Every core query with SQL agrees with it on the smallest tables."""

import os
import sys

import duckdb
import pytest

from pagegauge.plans import catalogue

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import canonical  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(canonical, row)) for row in df.select(*columns).collect())
    if name in catalogue.ORACLE_SQL:
        result = db.execute(catalogue.ORACLE_SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert mine == sorted(tuple(canonical(row[i]) for i in at) for row in result.fetchall())


def test_the_core_does_not_import_the_llm_package():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "pagegauge"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"pagegauge\.llm|from \.*llm", path.read_text()), path
