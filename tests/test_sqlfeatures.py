"""Hand-written SQL cases with expected counts (Q1-Q33), including the reference defects we fix."""

from conftest import frame
from pyspark.sql import functions as F

from sqlprism.operators import sqlfeatures, sqltokens

CASES = {
    # id: (sql, expected fields on the current_depth = -1 row)
    1: ("select count(*) from orders where o_custkey = 5",
        dict(structural_category_name="S-F-W", structural_category_counter="1.1.1.0.0.0.0.0.0",
             operatorTypes_category_name="Ag-C", select_columns=1, where_conditions=1, sql_query_depth=0,
             columns=1, tables=1, values=1, count=1, eq=1)),
    2: ("select a from t where x between 1 and 5 and y > 2",
        dict(between=1, gt=1, **{"and": 1}, where_conditions=3, values=3)),
    3: ("select a from t where x not in (select b from u) and z is not null",
        dict(nin=1, is_not_null=1, **{"and": 1}, N=1, sql_query_depth=1, S=2, F=2, W=1,
             structural_category_counter="2.2.1.0.0.0.0.0.1")),
    4: ("select a from t left outer join u on t.id = u.id",
        dict(left_outer_join=1, eq=1, tables=2, columns=3)),
    5: ("select a from t union select b from u",
        dict(SO=1, S=2, F=2, select_columns=None, where_conditions=None, structural_category_name="S-F-SO")),
    6: ("select n.a, count(*) from t c, n where c.k = n.k group by n.a having count(*) > 1 order by n.a desc limit 3",
        dict(join=1, count=2, gt=1, eq=1, G=1, H=1, O=1, L=1, values=1, groupby_columns=1)),
    7: ("select a from t where name not like 'x%' and b <> 2 or c != 3",
        dict(not_like=1, neq=2, **{"and": 1, "or": 1}, values=3)),
    8: ("select a * b - c / d + e from t", dict(mul=1, sub=1, div=1, add=1, columns=5)),
    9: ("select count( from t where", dict(parse_error="unbalanced parentheses", structural_category_name=None,
                                          columns=None)),
    10: ("select max(x.total) from (select sum(p) as total from t group by k) as x",
         dict(max=1, sum=1, N=1, columns=3, tables=1, structural_category_counter="2.2.0.1.0.0.0.0.1")),
    11: ("select distinct distinct a from t", dict(parse_error="repeated distinct")),
    12: ("select a from t limit 5 limit 3", dict(parse_error="repeated clause")),
    13: ("select a from t where s = 'from where (' and b = 1", dict(eq=2, values=2, W=1, F=1)),
    14: ("select a from t where not exists (select 1 from u where u.k = t.k)",
         dict(**{"not": 1}, exists=1, eq=1, N=1)),
    15: ("select a from t where n = 'it''s' and b = 1e5 and c > .5", dict(values=3, columns=4, parse_error=None)),
    16: ('select "t"."c" from t where n = "Bob Smith"', dict(columns=2, values=1, tables=1)),
    17: ("select größe from t", dict(columns=1, parse_error=None)),
    18: ("with x as (select a from t) select b from x", dict(columns=2, tables=2, N=1, S=2)),
    19: ("select a from t -- don't\nwhere b = 1 /* it's */", dict(eq=1, columns=2, parse_error=None)),
    20: ("select a from t where b = ?", dict(parse_error="unknown token", columns=None)),
    21: ("select count(*) from t group by a + 1", dict(parse_error="group by on an expression")),
    22: ("select count(distinct a + b) from t", dict(parse_error="distinct on an expression")),
    23: ("select count(distinct t.a) from t group by (b), c", dict(parse_error=None, count=1, groupby_columns=2)),
    24: ("select a from t where s = 'open", dict(parse_error="unbalanced quotes")),
}


def test_feature_rows_hand_cases(spark):
    df = frame(spark, [(i, sql) for i, (sql, _) in CASES.items()])
    rows = {r["datapoint_id"]: r.asDict() for r in
            sqlfeatures.feature_rows(df).where("current_depth = -1").collect()}
    for i, (sql, expected) in CASES.items():
        for k, v in expected.items():
            assert rows[i][k] == v, (i, sql, k, rows[i][k], v)


def test_subquery_rows_and_depths(spark):
    sql = ("select a from t where k not in (select c from u where v > (select avg(v) from u)) "
           "order by a asc limit 3")
    rows = sqlfeatures.feature_rows(frame(spark, [(1, sql)])).orderBy("current_depth", "subquery_no").collect()
    assert [(r.current_depth, r.subquery_no) for r in rows] == [(-1, 0), (0, 0), (1, 0), (2, 0)]
    assert [r.sql_query_depth for r in rows] == [2, 2, 1, 0]
    assert rows[0].sql_query == sql and rows[1].sql_query is None
    assert [r.N for r in rows] == [2, 2, 1, 0]


def test_token_relation_scopes_and_clauses(spark):
    sql = "select a from t where b in (select c from u) group by a"
    t = sqltokens.token_relation(frame(spark, [(1, sql)])).orderBy("pos").collect()
    by_tok = {(r.tok, r.pos): r for r in t}
    inner = [r for r in t if r.scope != -1]
    assert {r.tok for r in inner} == {"(", "select", "c", "from", "u"}
    assert all(r.depth == 1 for r in inner)
    # select0 a1 from2 t3 where4 b5 in6 (7 select8 c9 from10 u11 )12 group13 by14 a15
    assert by_tok[("group", 13)].clause == "groupby" and by_tok[("group", 13)].scope == -1
    assert by_tok[("c", 9)].role == "column" and by_tok[("u", 11)].role == "table"
    assert by_tok[(")", 12)].scope == -1 and by_tok[("(", 7)].scope == 7


def test_parse_errors_only_for_invalid(spark):
    df = frame(spark, [(1, "select a from t"), (2, "select a from t where s = 'x"), (3, "update t set a = 1"),
                       (4, "")])
    t = sqltokens.token_relation(df)
    errs = {r.datapoint_id: r.parse_error for r in sqltokens.parse_errors(df, t).collect()}
    assert errs == {1: None, 2: "unbalanced quotes", 3: "no select", 4: "no select"}


def test_first_condition_that_holds(spark):
    from sqlprism.functions.columns import cases

    x = F.col("id")
    rows = spark.range(4).select(cases((x == 0, "a"), (x <= 1, "b"), (F.lit(None).cast("boolean"), "c"), (x == 3, F.lit("d")), otherwise="e").alias("v"), cases((x == 0, "a")).alias("w")).collect()
    assert [tuple(r) for r in rows] == [("a", "a"), ("b", None), ("e", None), ("d", None)]


def test_token_conditions_are_no_long_cases(spark):
    """A CASE of many branches is searched from the head of a list for each of them, once a token."""
    df = spark.createDataFrame([("select a from t",)], "q string")
    plan = df.select(sqltokens.token_array("q").alias("t"))._jdf.queryExecution().analyzed().toString()
    assert max(case.split(" END")[0].count(" WHEN ") for case in plan.split("CASE")[1:]) < 4
