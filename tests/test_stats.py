"""Statistics properties (A12-A25) on the stand-in corpus."""

import time

import pytest
from pyspark.sql import functions as F

from sqlprism.operators import sqlfeatures, stats
from sqlprism.plans import corpus
from sqlprism.session import materialize


@pytest.fixture(scope="module")
def feats(spark, sf_dir):
    return materialize(corpus.features(spark, sf_dir))


def test_shares_per_depth_sum_to_100(feats):
    s = stats.structural_categories(feats).groupBy("dataset", "depth").agg(F.sum("pct_queries").alias("t"))
    assert all(abs(r.t - 100.0) < 1e-9 for r in s.collect())


def test_top_k_plus_other_is_100(feats):
    t = stats.structural_categories(feats, k=3).groupBy("dataset").agg(F.sum("pct_queries").alias("t"))
    assert all(abs(r.t - 100.0) < 1e-9 for r in t.collect())


def test_grouped_distribution_reexpands_to_counts(feats):
    raw = stats.variable_type_num(feats, "columns", grouped=False)
    grouped = stats.variable_type_num(feats, "columns")
    n = {r.dataset: r["count"] for r in raw.groupBy("dataset").count().collect()}
    counts = {(r.dataset, r.columns): r["count"] for r in raw.groupBy("dataset", "columns").count().collect()}
    for r in grouped.collect():
        assert round(r.pct_queries * n[r.dataset] / 100) == counts[(r.dataset, r.columns)]


def test_variety_matches_definition(feats):
    shares = stats.structural_categories(feats).where("depth = -1").collect()
    v = {r.dataset: r.structural_variety for r in stats.structural_variety(feats).collect()}
    for ds in v:
        ps = [r.pct_queries / 100 for r in shares if r.dataset == ds]
        assert abs(sum(p * (1 - p) for p in ps) - v[ds]) < 1e-12


def test_union_of_splits_equals_whole(feats):
    whole = stats.unique_sql_queries_num(feats.drop("split").withColumn("dataset", F.lit("all"))).first()[1]
    by_split = feats.where("current_depth = -1").select("sql_query").distinct().count()
    assert whole == by_split


def test_boxplot_matches_numpy(feats):
    import numpy as np
    vals = [r.columns for r in stats.roots(feats).where("dataset = 'F' and columns is not null").collect()]
    b = stats.columns_num_statistics(feats, extended=True).where("dataset = 'F'").first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    assert (b.q1, b.med, b.q3) == (q1, med, q3)
    assert abs(b.mean - np.mean(vals)) < 1e-9


def test_exact_quantiles_by_radix_selection(spark):
    import random

    import numpy as np
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1e9) for _ in range(500)], "b": [rng.choice([-0.0, 0.0, 1.5, -3.25, 1e-300, -1e300]) for _ in range(300)], "c": [7.0], "d": [1.0, 2.0],
              "e": [float(2 ** (i % 60)) * (-1) ** i for i in range(200)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "dataset string, v double").repartition(5)
    counts = df.groupBy("dataset", "v").agg(F.count(F.lit(1)).alias("c"))
    got = {r.dataset: r for r in stats.exact_quantiles(counts, {"q1": 0.25, "med": 0.5, "hi": 0.97, "max": 1.0}, ["dataset"]).collect()}
    for k, vs in groups.items():
        want = np.quantile(np.array(vs), [0.25, 0.5, 0.97, 1.0])
        assert np.allclose([got[k].q1, got[k].med, got[k].hi, got[k].max], want, rtol=1e-12), k
    ranks = spark.createDataFrame([("b", i) for i in range(300)], "dataset string, rank long")
    assert [r.v for r in stats.values_at(counts, ranks, ["dataset"]).orderBy("rank").collect()] == sorted(groups["b"])
    box = {r.dataset: r for r in stats.summary(df, "v", extended=True).collect()}
    assert box["e"].med == np.median(groups["e"]) and stats.summary(df.where("1 = 0"), "v", extended=True).count() == 0


def test_chart_bins_are_pooled_quantiles(spark):
    from sqlprism.operators import reports
    rows = [(d, float(i % 40) + 0.001, 1.0) for i in range(400) for d in "xy"] + [("x", None, 5.0)]
    df = spark.createDataFrame(rows, "dataset string, v double, share double")
    got = reports.bin_chart_data(df, "v", "share").collect()
    assert sum(r.share for r in got) == 805 and len({(r.x_lo, r.x_hi) for r in got}) == 11  # ten bins, and the missing value
    few = reports.bin_chart_data(df.where("v < 10"), "v", "share").collect()
    assert all(r.x_lo == r.x_hi for r in few) and len(few) == 20


def test_categories_read_the_queries_frame_once(spark):
    """Shares, top-k, variety and depth labels are built on one pass over the queries frame, and keep zeros of the grid."""
    from sqlprism.operators import reports
    rows = [("a", "S", -1), ("a", "S", -1), ("a", "S-W", -1), ("a", "S", 0), ("b", "S", -1), (None, "S", -1), ("a", None, -1)]
    feats = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                  "datapoint_id long, dataset string, structural_category_name string, current_depth int")
    shares = stats.structural_categories(feats)
    got = {(r.dataset, r.category, r.depth): r.pct_queries for r in shares.collect()}
    assert got == {("a", "S", -1): 200 / 3, ("a", "S-W", -1): 100 / 3, ("a", "S", 0): 100.0, ("a", "S-W", 0): 0.0, ("b", "S", -1): 100.0}
    top = {(r.dataset, r.category): r.pct_queries for r in stats.structural_categories(feats, k=1).collect()}
    assert top == {("a", "S"): 200 / 3, ("a", "Other"): 100 / 3, ("b", "S"): 100.0, ("b", "Other"): 0.0}
    labels = reports.depth_labels(shares)
    assert {(r.depth, r.depth_label) for r in labels.collect()} == {(-1, "No depth considered"), (0, "Subqueries at depth 0")}
    for df in (shares, stats.structural_categories(feats, k=1), stats.structural_variety(feats), labels):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


@pytest.mark.parametrize("count", [stats.operators_num, stats.operators_statistics])
def test_time_to_plan_does_not_double_with_every_operator(spark, sf_dir, monkeypatch, count):
    feats = corpus.features(spark, sf_dir)
    monkeypatch.setattr(stats, "OP_COLS", sqlfeatures.OP_COLS[:17])  # 33 columns once never came to an end
    start = time.time()
    count(feats)._jdf.queryExecution().optimizedPlan()
    assert time.time() - start < 6
