import pytest
from pyspark.sql import functions as F

from modelloom.operators import reshape as R
from modelloom.operators import schema as C
from modelloom.session import shared_folder
from modelloom.sources import export, load_table, preview, stage


def test_names_are_cleaned(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c"])
    assert C.clean_names(df).columns == ["a_b", "c"]
    with pytest.raises(ValueError, match="collide"):
        C.clean_names(spark.createDataFrame([(1, 2)], ["a.b", "a_b"]))


def test_roles(spark):
    df = spark.sql("SELECT 1.5D AS `y.v`, 2 AS n, 'x' AS s, DATE '2020-01-01' AS d, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS t")
    _, roles = C.prepare(df, "y.v", "regression")
    assert (roles.y, roles.time_col, roles.features) == ("y_v", "d", ["n", "s"])
    assert roles.candidates == ["n", "s", "d", "t"]
    assert C.time_columns(df) == ["d", "t"]
    assert C.prepare(df, "y.v", "regression", time_col=None)[1].time_col is None
    assert C.prepare(df, "y.v", "regression", time_col="t", features=["d"])[1].features == ["d"]


def test_bad_targets(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5, "y string, x double")
    with pytest.raises(ValueError, match="no column"):
        C.prepare(df, "z", "regression")
    with pytest.raises(TypeError):
        C.prepare(df, "y", "regression")
    with pytest.raises(ValueError, match="two different"):
        C.prepare(df, "y", "classification")
    with pytest.raises(ValueError, match="no predictor"):
        C.prepare(df, "x", "regression", features=[])
    with pytest.raises(ValueError, match="task"):
        C.prepare(df, "x", "clustering")
    with pytest.raises(ValueError, match="cannot be"):
        C.prepare(df, "x", "regression", features=["x"])
    with pytest.raises(ValueError, match="more than"):
        C.prepare(df, "x", "regression", max_rows=4)
    assert C.prepare(df, "x", "regression", max_rows=5)[1].y == "x"


def test_null_counts_as_a_level(spark):
    df = spark.createDataFrame([("a",), (None,)], "y string")
    assert C.target_levels_at_least_two(df, "y")
    assert C.target_cardinality(df, "y").first()[0] == 2


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "u")], ["x y", "a`b", "c+d"])
    assert C.drop_columns(df, ["x y"]).columns == ["a`b", "c+d"]
    assert C.columns_first(df, ["c+d"]).columns == ["c+d", "x y", "a`b"]
    assert {r["Variable"]: r["Class"] for r in C.describe_columns(df).collect()}["a`b"] == "double"


def test_round_trips(spark, part):
    folder = shared_folder(spark)
    for fmt in ("csv", "json", "orc", "parquet"):
        path = export(part, f"{folder}/part.{fmt}", fmt)
        back = load_table(spark, path, schema=part.schema)
        assert back.exceptAll(part).count() == 0 and back.count() == 200
        with pytest.raises(Exception, match="(?i)exist"):
            export(part, path, fmt)
    with pytest.raises(ValueError):
        export(part, folder, "xlsx")


def test_sources(spark, part):
    assert load_table(spark, part) is part
    stage(part, ["p_size"], view="parts_view")
    assert load_table(spark, "parts_view").columns == ["p_size"]
    assert load_table(spark, [(1, "a")], schema="n int, s string").count() == 1


def test_preview_pages(part):
    pages = [[r[0] for r in preview(part, p, ["p_partkey"], 3).collect()] for p in (0, 1)]
    assert pages == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(ValueError):
        preview(part, 0, [])


def test_melt_takes_one_type(spark):
    df = spark.createDataFrame([(1, 1.5, "x")], "id int, a double, b string")
    assert sorted(map(tuple, R.melt_predictions(df, ["id"], ["a", "b"]).collect())) == [(1, "a", "1.5"), (1, "b", "x")]


def test_top_features(spark):
    df = spark.createDataFrame([("m", "a", 0.2), ("m", "b", 0.8), ("n", "a", 1.0)], "model string, feature string, importance double")
    assert [(r["model"], r["feature"]) for r in R.top_features(df, 1).orderBy("model").collect()] == [("m", "b"), ("n", "a")]


def test_curve_by_time_is_sorted(orders):
    curve = R.prediction_curve(orders.withColumn("m", F.lit(1.0)), "o_totalprice", ["m"], time_col="o_orderdate")
    days = [r["o_orderdate"] for r in curve.collect()]
    assert days == sorted(days) and curve.columns == ["o_orderdate", "o_totalprice", "m"]


def test_pages_by_key(spark):
    df = spark.createDataFrame([(i % 3 or None, i) for i in range(20)], "a int, b int")
    whole = [tuple(r) for r in preview(df, 0, ["a", "b"], size=20).collect()]
    seen, after = [], None
    while page := [tuple(r) for r in preview(df, 0, ["a", "b"], size=6, after=after).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == whole
