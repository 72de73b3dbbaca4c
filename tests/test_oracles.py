"""A subset of registered queries against their DuckDB oracles at sf0.001 (the full set runs at
sf0.01 through scripts/check_oracles.py)."""

import pytest

import __spark_entry__ as entry
from oracles import compare

FAST = ["sql_feature_rows", "sql_token_relation", "structural_category_shares", "structural_top5",
        "operators_per_query", "columns_boxplot", "text_lexical_richness", "text_dependency_metrics",
        "schema_counts", "database_rows", "deduplicated_datapoints", "predictions_attached_by_position",
        "question_length_chart_bins", "query_hardness", "partial_match", "component_accuracy", "partial_scores", "value_by_depth",
        "sql_column_equivalences", "text_closeness_centralization", "schema_from_catalog", "question_rows"]


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, sf_dir, name):
    con = compare.duck_connect(sf_dir)
    ok, msg = compare.compare(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name])
    assert ok, msg
