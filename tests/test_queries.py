import pytest

from parity import oracle_rows, rows_of
from textloom.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    found = rows_of(QUERIES[name](spark, sf))
    if name in ORACLE:
        assert found == oracle_rows(ORACLE[name], sf)
    else:
        assert found[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_stands_alone():
    """No module outside the subpackage for training data imports it."""
    from pathlib import Path

    root = Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "textloom.llm" not in path.read_text(), path
