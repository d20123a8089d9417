import oracle
import pytest

from tagloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    oracle.same(catalog.queries()[name](spark, sf_dir), oracle.connect(sf_dir), catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["lint_duplicates", "lint_overlap", "lint_repeats", "lint_colors", "lint_subsumed"])
def test_lint_rules_find_something(name):
    con = oracle.connect("/root/testdata/sf0.01")
    assert con.sql(catalog.oracle_sql()[name]).limit(1).fetchall()


def test_every_query_has_sql_or_a_test():
    tested = {"dup_groups", "lane_translate"}
    assert set(catalog.queries()) - set(catalog.oracle_sql()) <= tested
