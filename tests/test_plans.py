"""Graphs, choices, learners, queries against DuckDB, streaming."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright import plans
from tablewright.config import config_context, get_config, set_config
from tablewright.operators import AggJoiner, SquashingScaler
from tablewright.plans.learners import iter_cv_splits, train_test_split
from tablewright.sources import make_deduplication_data, make_retail_events, toy_cities, toy_orders, toy_products
from tablewright.streaming import stream_sessions

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_graph(spark):
    orders = toy_orders(spark)
    X = plans.X()
    scaled = X.tw.apply(SquashingScaler(), cols=["quantity"]).tw.set_name("scaled")
    learner = scaled.tw.make_learner().fit({"X": orders})
    assert learner.transform({"X": orders.limit(2)}).count() == 2
    assert learner.find_fitted_estimator("scaled").models_["quantity"].center == 2.5
    with pytest.raises(TypeError):
        bool(X)
    with pytest.raises(KeyError):
        plans.evaluate(plans.var("absent"))
    a = plans.var("a", 2)
    assert plans.evaluate((a + 3) * 2) == 10 and plans.evaluate((a > 1).tw.if_else("yes", plans.var("never"))) == "yes"
    assert plans.evaluate(a.tw.match({2: "two"}, "other")) == "two"
    assert plans.deferred(lambda x, y: x + y)(a, y=1).tw.eval() == 3
    joined = X.tw.apply(AggJoiner("X", ["max"], key="product", cols=["quantity"]))
    assert "quantity_max" in joined.tw.make_learner().fit_transform({"X": orders}).columns


def test_choices_and_search(spark):
    frame = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    limit = plans.choose_int(1, 5, "limit", n_steps=5)
    node = plans.deferred(lambda df, n: df.where(F.col("v") < n))(plans.X(), limit)
    found = node.tw.make_grid_search({"X": frame}, "id", lambda df: float(df.count()), cv=2)
    assert found.best_params_ == {"limit": 5} and len(found.results_) == 5
    assert plans.choose_float(1.0, 100.0, "f", log=True).default() == pytest.approx(10.0)
    assert plans.choose_from({"a": 1, "b": 2}, "c").default() == 1 and "limit" in node.tw.describe_param_grid()
    folds = [held["X"].count() for _, held in iter_cv_splits({"X": frame}, "id", 4)]
    assert sum(folds) == 100
    train, test = train_test_split({"X": frame}, "id")
    assert train["X"].count() + test["X"].count() == 100


def test_config():
    with config_context(cardinality_threshold=3):
        assert get_config()["cardinality_threshold"] == 3
    assert get_config()["cardinality_threshold"] == 40
    with pytest.raises(ValueError):
        set_config(unknown=1)


def test_generators(spark):
    assert toy_products(spark).count() == 6 and toy_cities(spark, 50).count() == 50 and make_retail_events(spark, 5, 40).count() == 40
    assert make_deduplication_data(spark, ["abc", "def"], [3, 2]).count() == 5


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.sql(plans.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def lines(frame):
        return sorted(str([None if pd.isna(v) else float(v) if isinstance(v, (int, float)) else v for v in r]) for r in frame[columns].astype(object).values.tolist())

    assert lines(got) == lines(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_stream_sessions(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("select 1 user, timestamp'2024-01-01 00:00:00' t union all select 1, timestamp'2024-01-01 00:10:00' union all select 1, timestamp'2024-01-02'").write.parquet(source)
    stream = stream_sessions(spark.readStream.schema("user int, t timestamp").parquet(source), "t", ["user"])
    query = stream.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(60)
    assert [r["n_events"] for r in spark.table("closed").collect()] == [2]
