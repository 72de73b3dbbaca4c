"""Incremental profiling stream and the dataset profile builder."""

import json

from sqlprism.plans.profile import DatasetProfile
from sqlprism.sources import fixtures
from sqlprism.streaming.incremental import profile_stream


def test_stream_appends_feature_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"datapoint_id": i, "dataset": "d", "split": "s", "db_id": "x", "question": "q",
             "sql_query": f"select a from t where b = {i}"} for i in range(5)]
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in rows[:3]))
    (src / "b.json").write_text("\n".join(json.dumps(r) for r in rows[3:]))
    q = profile_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out")).where("current_depth = -1")
    assert "batch_id" in out.columns
    assert out.count() == 5 and {r.where_conditions for r in out.collect()} == {1}


def test_profile_frames(spark, sf_dir):
    dp = fixtures.datapoints(spark, sf_dir)
    prof = DatasetProfile(spark, dp, fixtures.schema_relations(spark, sf_dir),
                          fixtures.dictionary_words(spark, sf_dir), ignore=("questions",))
    f = prof.frames()
    assert set(f) == {"queries", "databases"}
    assert f["databases"].count() == 5 and f["queries"].where("current_depth = -1").count() == dp.count()
