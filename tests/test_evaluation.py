"""Evaluation: the same rows whichever way labels, flags and predictions come, and no exchange of a row per metric."""

import itertools

from pyspark.sql import functions as F

from sqlprism.operators import evaluation, match, sqlfeatures, stats
from sqlprism.session import stored

GOLD = ["select a from t where b = 1", "select count(*) from t", "select a from", None]
PRED = [("select a from t where b = 1", "select a from t where b > 1"), ("select count(*) from t", None), ("select a from t", "select a from t"), ("select a from t", "(")]


def _pairs(spark):
    rows = [(i + 10 * r, "m" + str(m), GOLD[i], PRED[i][m], "test" if i % 2 else "train") for r in range(3) for i, m in itertools.product(range(4), range(2))]
    return spark.createDataFrame(rows, "datapoint_id long, model string, gold string, predicted string, split string")


def _rows(df):
    return sorted(map(str, df.collect()))


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0]
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line], plan


def test_pairs_bring_their_gold_text(spark):
    pairs = _pairs(spark)
    gold = pairs.select("datapoint_id", F.col("gold").alias("sql_query")).distinct()
    want = match.over_distinct_pairs(match.partial_match, gold, pairs, boolean=True)
    got = match.over_distinct_pairs(match.partial_match, None, pairs, gold_col="gold", boolean=True, with_text=True, carry=("split",))
    assert _rows(got.select(want.columns)) == _rows(want) == _rows(match.partial_match(gold, pairs, boolean=True).select(want.columns))
    assert _rows(got.select("datapoint_id", "model", "predicted", "split")) == _rows(pairs.select("datapoint_id", "model", "predicted", "split"))


def test_nothing_is_exchanged_once_for_each_metric(spark):
    pairs = _pairs(spark)
    long = evaluation.evaluation_long(match.over_distinct_pairs(match.partial_match, None, pairs, gold_col="gold", with_text=True), None)
    found, plan = _exchanges(long)
    assert len(found) == 4, plan  # distinct texts; texts by gold; hashes of pairs and their scores
    assert "Exchange" not in plan[:plan.index("Expand")], plan
    metrics = match.over_distinct_pairs(match.partial_match, None, pairs, gold_col="gold")
    assert _rows(long) == _rows(evaluation.evaluation_long(metrics, pairs))


def test_flags_and_labels_as_columns(spark):
    pairs = _pairs(spark)
    metrics = match.over_distinct_pairs(match.partial_match, None, pairs, gold_col="gold", carry=("split",))
    labels = pairs.where("datapoint_id < 13").select("datapoint_id", F.concat(F.lit("c"), F.col("datapoint_id") % 2).alias("category")).distinct()
    wide = metrics.withColumn("test", F.col("split") == "test").join(labels.withColumnRenamed("category", "label"), "datapoint_id", "left")
    long, plain = evaluation.evaluation_long(wide, None, carry=("test", "label")), evaluation.evaluation_long(metrics, pairs)
    assert _rows(evaluation.errors(long, subset="test")) == _rows(evaluation.errors(plain, subset=pairs.where("split = 'test'")))
    assert _rows(evaluation.category_errors(long, "label")) == _rows(evaluation.category_errors(plain, labels))


def test_stored(spark):
    df = _pairs(spark)
    back = stored(df)
    assert _rows(back) == _rows(df) and back.schema == df.schema


def test_question_joins_only_where_asked_for(spark, sf_dir):
    from sqlprism.plans import corpus

    dp = corpus.datapoints(spark, sf_dir)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    assert joins(dp.select("datapoint_id", "sql_query")) == 0 and joins(dp.select("datapoint_id", "question")) == 2


def test_categories_come_with_the_scores(spark):
    """Not from a second analysis of every datapoint; a gold text without a prediction is analysed in its row."""
    names = ["structural_category_name", "operatorTypes_category_name"]
    golds = [*GOLD, "", "select a from t where b in (select c from u order by c)", "(select a from t) union select b from u"]
    datapoints = spark.createDataFrame([(i, "d" + str(i % 2), g) for i, g in enumerate(golds * 2)], "datapoint_id long, dataset string, sql_query string")
    pairs = datapoints.where("datapoint_id not in (4, 10)").select(
        "datapoint_id", F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("model"), F.col("sql_query").alias("gold"), F.lit(GOLD[0]).alias("predicted"))
    sides, scores = match.distinct_pairs(match.partial_match, None, pairs, gold_col="gold", labels=lambda tokens: sqlfeatures.query_categories(tokens, names))
    plain = match.over_distinct_pairs(match.partial_match, None, pairs, gold_col="gold")
    assert _rows(sides.join(scores, "_pair").select(plain.columns)) == _rows(plain)
    columns = ["datapoint_id", "dataset", "current_depth", *names]
    want = stats.roots(sqlfeatures.feature_rows(datapoints, carry=("dataset",))).select(columns)
    assert _rows(evaluation.query_categories(datapoints, scores, names).select(columns)) == _rows(want)
    assert {None, "S-F-W", "S-F"} < {r[3] for r in want.collect()}


def test_texts_of_a_datapoint_are_analysed_once(spark):
    pairs = spark.createDataFrame([(1, m, GOLD[0], p) for m, p in enumerate([GOLD[0], GOLD[0], "select b from t", None])], "datapoint_id long, model string, gold string, predicted string")
    aligned = match.aligned_scopes(None, pairs, gold_col="gold", pred_col="predicted")
    plan = aligned._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct(filter(transform(texts" in plan, plan
    scores = {r.model: (r.parse_error, r.EM) for r in match.partial_match(None, pairs, gold_col="gold").collect()}
    assert scores == {"0": (None, 1), "1": (None, 1), "2": (None, 0), "3": (None, 0)}
