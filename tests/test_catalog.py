import __spark_entry__ as entry
from knotwork import catalog


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(map(callable, catalog.queries().values()))
    assert entry.entry(spark).columns == ["year", "Count"]


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "from knotwork import catalog; print(len(catalog.queries()), len(catalog.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
