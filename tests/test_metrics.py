import math

import pytest
from pyspark.sql import functions as F

from modelloom.operators import metrics as M
from tests.conftest import plan_of


def one(df):
    return df.first().asDict()


def test_zero_targets(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0)], "y double, m double")
    assert one(M.regression_metrics(df, "y", ["m"])) == {"Model": "m", "mape": 50.0, "rmse": 0.71}
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, m double")
    assert math.isinf(one(M.regression_metrics(df, "y", ["m"]))["mape"])
    assert one(M.regression_metrics(df, "y", ["m"], zero_policy="skip"))["mape"] == 50.0


def test_missing_predictions(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, None)], "y double, m double")
    assert one(M.regression_metrics(df, "y", ["m"])) == {"Model": "m", "mape": 50.0, "rmse": None}
    assert one(M.regression_metrics(df, "y", ["m"], null_policy="skip"))["rmse"] == 1.0


def test_empty_test_side(spark):
    df = spark.createDataFrame([], "y double, m double")
    assert one(M.regression_metrics(df, "y", ["m"])) == {"Model": "m", "mape": None, "rmse": None}
    df = spark.createDataFrame([], "y string, m string")
    assert one(M.classification_metrics(df, "y", ["m"]))["error_pct"] is None


def test_error_counts_rows_without_prediction_in_n_only(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), (None, "a")], "y string, m string")
    row = one(M.classification_metrics(df, "y", ["m"]))
    assert (row["errors"], row["n"], row["error_pct"], row["Error"]) == (1, 4, 25.0, "25.0 % (1/4)")


def test_board_sorts_by_number_and_drops_untimed_models(spark):
    scores = spark.createDataFrame([("a", 10.0), ("b", 9.0), ("c", 1.0)], "Model string, error_pct double")
    times = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "Model string, train_seconds double")
    assert [r["Model"] for r in M.leaderboard(scores, times, "error_pct").collect()] == ["b", "a"]


def test_confusion_total(lineitem):
    df = lineitem.withColumn("m1", F.lit("A")).withColumn("m2", F.col("l_returnflag"))
    sparse = M.confusion_matrix(df, "l_returnflag", ["m1", "m2"])
    assert sparse.agg(F.sum("Freq")).first()[0] == 12_000 and sparse.count() == 6
    dense = M.confusion_matrix(df, "l_returnflag", ["m1", "m2"], dense=True)
    assert dense.agg(F.sum("Freq")).first()[0] == 12_000 and dense.count() == 18


@pytest.mark.parametrize("of", [M.regression_metrics, M.classification_metrics])
def test_all_models_share_one_pass(lineitem, of):
    df = lineitem.select("l_quantity", *[(F.col("l_quantity") + i).alias(f"m{i}") for i in range(4)])
    assert plan_of(of(df, "l_quantity", [f"m{i}" for i in range(4)])).count("FileScan") == 1
