"""Every query of the library itself that has SQL, against DuckDB."""

import pytest

from prosemill.plans.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE[name])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["rule_id", "severity", "n"]


def test_import_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], check=True, timeout=120)
