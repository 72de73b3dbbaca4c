"""Hand-written cases of the list outputs (Q8, Q9, Q18, Q20-Q24, Q30) and of SQL normalisation (Q33)."""

from conftest import frame

from pyspark.sql import functions as F

from sqlprism.operators import sqlfeatures, sqllists, sqltokens
from sqlprism.plans import corpus

SQL = ("select distinct c.a, count(distinct b) from t as c join (select k from u where k > 3 or k = 'x''y') as s on c.a = s.k "
       "where c.a in (1, 2) group by c.a order by c.a desc, b limit 2")


def tokens(spark, *sqls):
    return sqltokens.token_relation(frame(spark, list(enumerate(sqls))))


def test_operator_lists(spark):
    rows = sqllists.operator_lists(tokens(spark, SQL)).collect()
    got = {(r.depth, r.clause): (r.operators, r.operator_types, r.conditions) for r in rows}
    assert got == {
        (0, "select"): (["count"], ["aggregate"], []),
        (0, "from"): (["join", "eq"], ["join", "comparison_operator"], ["join", "comparison_operator"]),
        (0, "where"): (["in"], ["membership_operator"], ["membership_operator"]),
        (1, "where"): (["gt", "or", "eq"], ["comparison_operator", "logical_operator", "comparison_operator"],
                       ["comparison_operator", "logical_operator", "comparison_operator"])}
    deep = {r.clause: r.operators for r in sqllists.deep_operator_lists(tokens(spark, SQL)).collect()}
    assert deep == {"select": ["count"], "from": ["join", "eq"], "where": ["gt", "or", "eq", "in"]}


def test_variables(spark):
    rows = sqllists.variable_rows(tokens(spark, SQL)).orderBy("pos").collect()
    got = {(r.role, r.name, r.complete_name, r.alias_of) for r in rows}
    assert got >= {("table", "t", "t", None), ("table", "u", "u", None), ("table_alias", "c", None, "t"), ("query_alias", "s", None, None),
                   ("column", "a", "t.a", None), ("column", "k", "u.k", None), ("value", "x''y", None, None), ("value", "1", None, None)}
    assert ("value", "2", None, None) in got and sum(r.role == "value" for r in rows) == 4  # the LIMIT number is no value


def test_flags(spark):
    rows = sqllists.query_flags(tokens(spark, SQL, "select upper(a) from t union all select b from u", "select a from t order by a")).collect()
    got = {(r.datapoint_id, r.depth): r for r in rows}
    whole, inner = got[(0, 0)], got[(0, 1)]
    assert whole.select_distinct and whole.aggregate_distinct and whole.has_limit and not whole.union_all
    assert whole.orderby_directions == ["desc", "asc"] and whole.groupby_columns == ["c.a"]
    assert not inner.select_distinct and inner.orderby_directions == [] and inner.groupby_columns == []
    assert got[(1, 0)].union_all and got[(1, 0)].has_unlisted_function and got[(2, 0)].orderby_directions == ["asc"]


def test_normalized(spark):
    cases = {
        "select `a` from t, u inner join v where (a <> 1 and b = 2)": 'select "a" from t join u join v where a != 1 and b = 2',
        "select a from t where (a = 1) and (b = 2)": "select a from t where ( a = 1 ) and ( b = 2 )",
        "select a from t where ((a = 1) or b = 2) order by a": "select a from t where ( a = 1 ) or b = 2 order by a",
        "select a, b from t where a = '<> inner join'": "select a , b from t where a = '<> inner join'",
    }
    rows = {r.datapoint_id: r.sql for r in sqllists.normalized_sql(tokens(spark, *cases)).collect()}
    assert [rows[i] for i in range(len(cases))] == list(cases.values())


def test_every_operator_occurs_in_the_corpus(spark, sf_dir):
    row = corpus.features(spark, sf_dir).agg(*[F.sum(c).alias(c) for c in sqlfeatures.OP_COLS]).first()
    assert all(row[c] for c in sqlfeatures.OP_COLS), row


def test_components_and_equivalences(spark):
    from conftest import frame

    from sqlprism.operators import sqlfeatures, sqllists, sqltokens
    df = frame(spark, [(1, "select a from t where b in (select c from u) union select d from v"), (2, "select x.a from x, y, z where x.a = y.b and y.b = z.c and z.d = 1"), (3, "select (")])
    rows = {(r.datapoint_id, r.current_depth): r.components for r in sqllists.structural_components(sqlfeatures.feature_rows(df)).collect()}
    assert rows[1, -1] == ["S"] * 3 + ["F"] * 3 + ["W", "SO", "N"] and rows[1, 1] == ["S", "F"] and rows[3, -1] is None
    equal = {(r.datapoint_id, r.column): r.equals for r in sqllists.column_equivalences(sqltokens.token_relation(df)).collect()}
    assert equal == {(2, "x.a"): ["y.b", "z.c"], (2, "y.b"): ["x.a", "z.c"], (2, "z.c"): ["x.a", "y.b"]}
