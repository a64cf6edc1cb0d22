"""Every registered query against its SQL, the others for their rows."""

import os

import pytest

from contractlens.plans import queries
from tests.harness import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.SQL[name])


@pytest.mark.parametrize("name", ["hard_cut_3000", "segmented_clauses", "repaired_lines", "html_blocks", "rules_catalogue", "evaluate_clause"])
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "flagged", "high", "score", "rules"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
