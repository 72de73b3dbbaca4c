"""Partial / exact match properties and hand-checked scores."""

from conftest import frame

from sqlprism.functions.columns import jaccard
from sqlprism.operators import match, sqlfeatures
from pyspark.sql import functions as F


def pm(spark, pairs):
    gold = frame(spark, [(i, g) for i, (g, _) in enumerate(pairs)])
    preds = spark.createDataFrame([(i, "m", p) for i, (_, p) in enumerate(pairs)],
                                  "datapoint_id long, model string, predicted string")
    return {r.datapoint_id: r for r in match.partial_match(gold, preds, boolean=True).collect()}


def test_identical_sql_scores_one(spark):
    sqls = ["select a from t", "select c.n, count(*) from c join o on c.k = o.k group by c.n",
            "select a from t where b in (select c from u where d > 3) order by a desc",
            "select a from t union select b from u"]
    r = pm(spark, [(s, s) for s in sqls])
    for i in range(len(sqls)):
        assert (r[i].PM, r[i].SM, r[i].OM, r[i].VM, r[i].EM, r[i].PM_boolean) == (1.0, 1.0, 1.0, 1.0, 1, 1)


def test_hand_checked_scores(spark):
    r = pm(spark, [("select count(*) from orders where k = 5", "select count(*) from orders where k != 5"),
                   ("select count(*) from orders where k = 5", "select count(*) from orders where k = 5 limit 3"),
                   ("select a from t where k = 1", "select count( from t"),
                   ("select a from t where k = 1", "select a from t where k = 2")])
    # operators {count_select_0, eq_where_0} vs {count_select_0, neq_where_0} -> 1/3
    assert r[0].OM == round(1 / 3, 9) and r[0].SM == 1.0 and r[0].VM == 1.0
    assert r[1].SM == 0.75  # {select, from, where} vs {+ limit}
    assert r[2].PM == 0.0 and r[2].parse_error.startswith("predicted: ")
    assert r[3].EM == 1 and r[3].VM < 1  # values are ignored by EM


def test_alias_and_equivalence_resolution(spark):
    # aliases resolve to tables; the repeated column maps to its equality partner
    r = pm(spark, [("select t.a from t join u on t.k = u.k where t.k > 1",
                    "select x.a from t as x join u as y on x.k = y.k where x.k > 1")])
    assert r[0].VM == 1.0 and r[0].PM == 1.0


def test_equalities_of_both_sides_and_chains(spark):
    chain = "select t.a from a as t join b as u on t.x = u.x join c as v on u.x = v.x where {}.x > 1"
    r = pm(spark, [
        # only the gold side writes the condition; the prediction's repeated u.k becomes t.k: {a, k, u.k, k/1, k/2} against {a, u.k, k}
        ("select t.a from t join u on t.k = u.k where t.k > 1 and u.k < 9", "select t.a from t, u where u.k > 1 and u.k < 9"),
        ("select t.a from t, u where u.k > 1 and u.k < 9", "select t.a from t join u on t.k = u.k where t.k > 1 and u.k < 9"),
        # a.x = b.x = c.x: the smallest of the class is two conditions away
        (chain.format("v"), chain.format("t")), (chain.format("v"), chain.format("u")),
        # aligned subqueries share their equalities, other subqueries don't
        ("select a from w where b in (select t.a from t join u on t.k = u.k where u.k > 1)",
         "select a from w where b in (select t.a from t join u on t.k = u.k where t.k > 1)")])
    columns = {x.datapoint_id: x.score for x in match.component_scores(*sides(spark, 0)).where("component = 'columns'").collect()}
    assert abs(columns[0] - 3 / 5) < 1e-9 and r[0].VM == r[1].VM
    assert [(r[i].VM, r[i].PM, r[i].EM) for i in (2, 3, 4)] == [(1.0, 1.0, 1)] * 3


def sides(spark, i):
    gold = frame(spark, [(i, "select t.a from t join u on t.k = u.k where t.k > 1 and u.k < 9")])
    return gold, spark.createDataFrame([(i, "m", "select t.a from t, u where u.k > 1 and u.k < 9")], "datapoint_id long, model string, predicted string")


def test_jaccard_edge_cases(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1 / 3, 1.0, 0.0]


def test_hardness_levels(spark):
    # counts come from the whole-query row (nested queries included)
    df = frame(spark, [(1, "select a from t"), (2, "select a from t where x = 1 order by a"),
                       (3, "select a, b, c from t where x = 1 and y = 2 and z = 3 group by a, b"),
                       (4, "select count(*), max(a) from t join u on t.k = u.k join v on u.k = v.k "
                           "where a = 1 or b = 2 group by c, d order by c limit 3"),
                       (5, "select count( from t")])
    h = {r.datapoint_id: r.hardness for r in match.hardness(sqlfeatures.feature_rows(df)).collect()}
    assert h == {1: "easy", 2: "medium", 3: "hard", 4: "extra", 5: "NA"}


def test_exact_match_tells_clauses_apart(spark):
    pairs = [("select a from t where b = 1", "select b from t where a = 1"),
             ("select count(a), max(b) from t", "select max(a), count(b) from t"),
             ("select c from t where a = 1 or b = 2", "select c from t where b = 1 or a = 2"),
             ("select a from t order by a, b", "select a from t order by b, a"),
             ("select a from t where a = 1 and b = 2", "select a from t where b = 2 and a = 1"),
             ("select a, b from t", "select b, a from t"), ("select a from t", None)]
    r = pm(spark, pairs)
    assert [r[i].EM for i in range(7)] == [0, 0, 0, 0, 1, 1, 0]


def test_component_accuracy_leaves_rejected_pairs_out(spark):
    gold = frame(spark, [(0, "select a from t where b = 1"), (1, "select a from t where b = 1")])
    preds = spark.createDataFrame([(0, "m", "select a from t where ("), (1, "m", "select a from t")], "datapoint_id long, model string, predicted string")
    levels = match.hardness(sqlfeatures.feature_rows(gold))
    rows = {(r.family, r.component): r for r in match.component_accuracy(gold, preds, levels).where("hardness = 'all'").collect()}
    assert all(r.pairs == 1 for r in rows.values())
    assert rows["SM", "where"].rec == 0.0 and rows["SM", "where"].acc is None and rows["SM", "select"].f1 == 1.0
    long = match.component_scores(gold, preds).where("datapoint_id = 1 and component = 'total'").collect()
    assert {r.family: round(r.score, 6) for r in long} == {"SM": round(2 / 3, 6), "OM": 0.0, "VM": 0.5}


def test_one_exchange(spark, sf_dir):
    from sqlprism.plans import corpus

    dp, pred = corpus.datapoints(spark, sf_dir), corpus.predictions(spark, sf_dir)
    plan = match.partial_match(dp, pred)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(datapoint_id") <= 2


def _sides(spark, gold, predictions):
    g = spark.createDataFrame([(i, q) for i, q in enumerate(gold)], "datapoint_id long, sql_query string")
    p = spark.createDataFrame([(i, m, q) for i, qs in enumerate(predictions) for m, q in enumerate(qs)], "datapoint_id long, m int, predicted string")
    return g, p.selectExpr("datapoint_id", "concat('m', m) AS model", "predicted")


GOLD_SQL = ["select a, count(b) from t where x > 1 and y = 2 group by a having count(*) > 3 order by a desc limit 4", "select a from t", "select a from t", "select broken( from"]
PRED_SQL = [["select a, count(b) from t where x >= 1 and y = 2 group by a order by a limit 4"], ["select a from t", "select b from t where a in (1, 2)"],
            ["select a from t", "select a from t union select b from t"], ["select a from t"]]


def test_partial_scores_by_hand(spark):
    g, p = _sides(spark, GOLD_SQL, PRED_SQL)
    levels = spark.createDataFrame([(0, "hard"), (1, "easy"), (2, "easy")], "datapoint_id long, hardness string")
    got = {(r.model, r.type, r.hardness): r for r in match.partial_scores(g, p, levels).collect()}
    assert len(got) == 2 * 10 + 10 * 2 + 10 * 1  # all of m0 and m1, m0 hard and easy, m1 easy
    for kind, acc, rec in (("select", 1, 1), ("select(no AGG)", 1, 1), ("where", 0, 0), ("where(no OP)", 1, 1), ("group(no Having)", 1, 1), ("group", 0, 0),
                           ("order", 0, 0), ("and/or", 1, 1), ("IUEN", None, None), ("keywords", 0, 0)):
        r = got["m0", kind, "hard"]
        assert (r.acc, r.rec) == (acc, rec), kind
    assert got["m1", "select", "easy"].acc == 0 and got["m1", "IUEN", "all"].acc == 0 and got["m1", "IUEN", "all"].rec is None
    assert got["m0", "select", "all"].acc_pairs == 3 and got["m0", "select", "all"].f1 == 1


def test_value_by_depth(spark):
    g, p = _sides(spark, ["select a from t where b in (select c from u)", "select a from t"], [["select a from t where b in (select d from u)"], ["select a from t"]])
    got = {(r.family, r.component, r.depth): (r.score, r.pairs) for r in match.value_by_depth(g, p).collect()}
    assert got["VM", "columns", 0] == (1.0, 2) and got["VM", "columns", 1] == (0.0, 1)
    assert got["VM", "columns", None] == (0.75, 2) and got["SM", "total", 1] == (1.0, 1)


def test_distinct_pairs_score_like_all_pairs(spark):
    g, p = _sides(spark, GOLD_SQL * 3 + [None], PRED_SQL * 3 + [["select a from t", None]])
    want = sorted(map(str, match.partial_match(g, p, boolean=True).collect()))
    assert sorted(map(str, match.over_distinct_pairs(match.partial_match, g, p, boolean=True).select(*match.partial_match(g, p, boolean=True).columns).collect())) == want


def test_execution_next_to_scores(spark):
    from sqlprism.operators import evaluation
    g, p = _sides(spark, GOLD_SQL, PRED_SQL)
    scores = match.partial_match(g, p)
    executed = spark.createDataFrame([(1, "m0", 1), (1, "m1", 0)], "datapoint_id long, model string, EX int")
    got = {(r.datapoint_id, r.model): r.EX for r in match.with_execution(scores, executed).collect()}
    assert got[1, "m0"] == 1 and got[1, "m1"] == 0 and got[2, "m0"] is None
    assert {r.EX for r in match.with_execution(scores, executed, not_run=1).collect()} == {0, 1}
    long = evaluation.evaluation_long(match.with_execution(scores, executed), p)
    wrong = {(r.metric, r.model): r.errors for r in evaluation.total_errors(long).collect()}
    assert wrong["EX", "m0"] == 3 and wrong["EX", "m1"] == 2  # one that was not run is no success


def test_best_of_alternatives(spark):
    from sqlprism.sources import readers
    dp = spark.createDataFrame([(0, "select a from t", ["select b from t", "select a from t"]), (1, "select a from t where", None), (2, "select a from u", ["select c from"])],
                               "datapoint_id long, sql_query string, sql_alternatives array<string>")
    golds = readers.gold_alternatives(dp)
    assert golds.count() == 5
    p = spark.createDataFrame([(0, "m0", "select b from t"), (0, "m1", "select c from t"), (1, "m0", "select a from t"), (2, "m0", "select (")], "datapoint_id long, model string, predicted string")
    got = {(r.datapoint_id, r.model): r for r in match.best_of_alternatives(golds, p).collect()}
    assert got[0, "m0"].EM == 1 and got[0, "m0"].golds == 2 and got[0, "m1"].EM == 0 and 0 < got[0, "m1"].PM < 1 and got[2, "m0"].PM == 0


def test_levels_and_questions_are_not_broadcast(spark, sf_dir):
    """However small the files look that they come from: a row per datapoint doesn't fit the driver."""
    from sqlprism.plans.catalog import QUERIES

    for name in ("component_accuracy", "partial_scores", "question_rows"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
        assert not [line for line in joins if "[datapoint_id#" in line or "[text_id#" in line], name


def test_component_accuracy_keeps_datapoints_without_a_level(spark):
    g, p = _sides(spark, GOLD_SQL, PRED_SQL)
    levels = spark.createDataFrame([(0, "hard"), (1, "easy")], "datapoint_id long, hardness string")
    rows = match.component_accuracy(g, p, levels).where("family = 'SM' and component = 'select' and model = 'm0'").collect()
    assert {(r.hardness, r.pairs) for r in rows} == {("hard", 1), ("easy", 1), (None, 1), ("all", 3)} and all(r.acc == r.rec == 1 for r in rows)
