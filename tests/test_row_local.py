"""Texts are analysed within their own rows: no exchange by a key, sort or window over tokens (they spilled beyond one query's rows)."""

import pytest
from conftest import frame

from sqlprism.operators import sqlfeatures, sqllists, sqltokens

SQLS = ["select a from t where (b = \"it's\" and c between 1 and 2)", "select c.a, c.b from t c join u on c.a = u.a order by c.a desc, c.b", "",
        "(select a from t) union select b from u where exists (select 1 from v)", "select ) a ( from t", "select a from t where"]


@pytest.mark.parametrize("rows", [
    sqltokens.token_relation, sqltokens.text_errors, sqlfeatures.feature_rows,
    *[lambda df, f=f: f(sqltokens.token_arrays(df)) for f in (
        sqlfeatures.scope_stats, sqllists.operator_lists, sqllists.deep_operator_lists, sqllists.variable_rows, sqllists.query_flags,
        sqllists.normalized_sql, sqllists.column_equivalences)]])
def test_no_exchange_by_key_sort_or_window(spark, rows):
    plan = rows(frame(spark, list(enumerate(SQLS))))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "Sort" not in plan and "Join" not in plan, plan


def test_arrays_and_relation_agree(spark):
    df = frame(spark, list(enumerate(SQLS)))
    for f in (sqlfeatures.scope_stats, sqllists.variable_rows, sqllists.query_flags, sqllists.normalized_sql):
        own, back = (sorted(map(str, f(t).collect())) for t in (sqltokens.token_arrays(df), sqltokens.token_relation(df)))
        assert own == back and own


def test_pairs_meet_without_window_or_sort(spark):
    from pyspark.sql import functions as F

    from sqlprism.operators import match

    gold = frame(spark, list(enumerate(SQLS)))
    preds = gold.select("datapoint_id", F.lit("m0").alias("model"), F.col("sql_query").alias("predicted"))
    plan = match.aligned_scopes(gold, preds)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1, plan


def test_lowered_is_lower(spark):
    from pyspark.sql import functions as F

    words = ["", "abc", "ABC_1", "größe", "GRÖSSE", "ΣΑΣ", "İ", "@[`{", "Z", "ſK", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.lower("w").alias("low"), sqltokens.lowered(F.col("w")).alias("own")).collect()
    assert all(r.low == r.own for r in rows), rows


def test_tokens_between_marks(spark):
    rows = token_rows(spark, "x y select a b , c from t1 a where d in ( select e f from g ) h order by i , j")
    assert rows[:2] == [("x", 0, None), ("y", 0, None)] and [r for r in rows if r[0] in ("b", "f", "h", "j")] == [
        ("b", 0, "select"), ("f", 1, "select"), ("h", 0, "where"), ("j", 0, "orderby")]


def token_rows(spark, sql):
    return [(r.tok, r.depth, r.clause) for r in sqltokens.token_relation(frame(spark, [(1, sql)])).orderBy("pos").collect()]
