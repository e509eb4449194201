import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modelloom.operators import profile as P
from modelloom.operators.reshape import with_counter
from tests.conftest import plan_of

quiet = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_histogram_density_sums_to_one(lineitem):
    for centered in (False, True):
        h = P.histogram(lineitem, "l_extendedprice", centered=centered).toPandas()
        assert len(h) == 30 and h["count"].sum() == 6000
        assert math.isclose((h["density"] * (h["hi"] - h["lo"])).sum(), 1.0, rel_tol=1e-9)


def test_histogram_of_constant_null_and_empty_columns(spark):
    df = spark.range(10).select(F.lit(7.0).alias("c"), F.lit(None).cast("double").alias("e"), F.lit(float("nan")).alias("n"))
    out = P.histograms(df).collect()
    assert [(r["variable"], r["bin"], r["count"], r["density"]) for r in out] == [("c", 0, 10, None)]
    assert P.histogram(df, "e").collect() == []


def test_histogram_needs_numbers(lineitem):
    with pytest.raises(TypeError):
        P.histogram(lineitem, "l_returnflag")
    with pytest.raises(TypeError):
        P.autocorrelation(lineitem, "l_returnflag", ["l_orderkey"])


def test_quantiles_by_narrowing_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(P, "DISTINCT_AT_MOST", 50)
    monkeypatch.setattr(P, "BRACKET_ACCURACY", 100)
    rng = np.random.default_rng(5)
    # A third of the values are equal, the rest spread over many magnitudes.
    x = np.concatenate([np.full(10_000, 3.0), np.exp(rng.normal(0, 6, 20_000))])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    assert np.allclose(P.exact_quantiles(df, "x", probs), np.quantile(x, probs), rtol=1e-12)


def test_quantiles_with_half_of_the_rows_equal(spark, monkeypatch):
    """What reaches the driver stays within the bound, however often one value occurs."""
    monkeypatch.setattr(P, "DISTINCT_AT_MOST", 10)
    monkeypatch.setattr(P, "BRACKET_ACCURACY", 50)
    collected = []
    plain = P._value_counts
    monkeypatch.setattr(P, "_value_counts", lambda values: collected.append(plain(values)) or collected[-1])
    rng = np.random.default_rng(6)
    x = np.concatenate([np.full(4000, 2.5), rng.normal(2.5, 1e-3, 4000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    probs = [0.1, 0.2499, 0.25, 0.5, 0.75, 0.9]
    assert np.allclose(P.exact_quantiles(df, "x", probs), np.quantile(x, probs), rtol=0, atol=1e-12)
    # At most eleven brackets, two ranks for each wanted quantile.
    assert all(len(c) <= 12 * 12 for c in collected)


def test_infinities_are_left_out(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, math.inf, -math.inf, math.nan, None)], "x double")
    assert [(r["lo"], r["hi"], r["count"]) for r in P.histogram(df, "x", bins=2).orderBy("bin").collect()] == [(1.0, 1.5, 1), (1.5, 2.0, 1)]
    row = P.box_stats(df, "x").first()
    assert (row["n"], row["min"], row["max"], row["median"]) == (2, 1.0, 2.0, 1.5)
    assert P.kde(df, "x", points=3).count() == 3


@quiet
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_quantiles_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    assert np.allclose(P.exact_quantiles(df, "x", [0.1, 0.5, 0.9]), np.quantile(values, [0.1, 0.5, 0.9]))


def test_box_stats_by_hand(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 100]], "x double")
    row = P.box_stats(df, "x").first()
    assert (row.q1, row.median, row.q3) == (2.75, 4.5, 6.25)
    assert (row.lo_whisker, row.hi_whisker, row.n_outliers) == (1.0, 7.0, 1)
    assert P.outliers(df, "x").collect() == [(100.0,)]
    near = P.box_stats(df, "x", approx=True).first()
    assert near.q1 in (2.0, 3.0)


def test_box_stats_of_nothing(spark):
    row = P.box_stats(spark.createDataFrame([(None,)], "x double"), "x").first()
    assert row.n == 0 and row.median is None and row.n_outliers == 0


def test_kde_is_close_to_the_exact_sum(events):
    got = P.kde(events, "value").orderBy("point").toPandas()
    x = np.array([r[0] for r in events.select("value").collect()])
    q1, q3 = np.quantile(x, [0.25, 0.75])
    bw = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 512)
    exact = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert np.abs(got["density"] - exact).max() < 1e-4 * exact.max()
    assert "CartesianProduct" not in plan_of(P.kde(events, "value"))


def test_kde_bandwidth_of_a_column_with_equal_quartiles(spark):
    df = spark.createDataFrame([(1.0,)] * 20 + [(2.0,)], "x double")
    assert P.kde(df, "x", points=10).count() == 10


def brute_acf(x, lags):
    d = x - x.mean()
    return [float((d[: len(d) - k] * d[k:]).sum() / (d * d).sum()) for k in range(lags + 1)]


@pytest.mark.parametrize("block", [7, 100, 65_536])
def test_autocorrelation_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_ROWS", block)
    x = np.cumsum(np.random.default_rng(3).normal(size=250))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, x double").repartition(6)
    for max_lag in (5, 100, 400):
        got = [r["ACF"] for r in P.autocorrelation(df, "x", ["t"], max_lag).orderBy("Lag").collect()]
        assert np.allclose(got, brute_acf(x, min(max_lag, 249)))


def test_autocorrelation_edges(spark):
    df = spark.createDataFrame([(1, 7.0), (2, 7.0), (3, None)], "t int, x double")
    with pytest.raises(ValueError, match="missing"):
        P.autocorrelation(df, "x", ["t"])
    assert [r["ACF"] for r in P.autocorrelation(df, "x", ["t"], nulls="skip").collect()] == [None, None]


def test_counter_is_gapless_with_hot_ties(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id").repartition(9)
    out = with_counter(df, ["k"]).orderBy("Counter").collect()
    assert [r["Counter"] for r in out] == list(range(1, 5001))
    assert [r["k"] for r in out] == sorted(r["k"] for r in out)
    assert len({r["id"] for r in out}) == 5000
    assert with_counter(df.limit(0), ["k"]).count() == 0


def test_counter_has_no_window(orders):
    assert "Window" not in plan_of(with_counter(orders, ["o_orderkey"]))


def test_correlations_use_complete_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, (300, 4))
    x[:, 1] += x[:, 0]
    x[:, 3] = 7.0
    x[rng.random(300) < 0.2, 2] = np.nan
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(x)]
    got = P.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4))
    cell = {(r["var_x"], r["var_y"]): r["corr"] for r in got.collect()}
    assert len(cell) == 16
    seen = ~np.isnan(x[:, 2])
    assert math.isclose(cell["a", "b"], np.corrcoef(x[:, 0], x[:, 1])[0, 1], rel_tol=1e-6)
    assert math.isclose(cell["c", "a"], np.corrcoef(x[seen, 2], x[seen, 0])[0, 1], rel_tol=1e-6)
    assert cell["a", "c"] == cell["c", "a"] and math.isclose(cell["a", "a"], 1.0)
    assert cell["a", "d"] is None and cell["d", "d"] is None


def test_scatter_bins_count_all_points(part):
    cells = P.scatter_bins(part, part, "p_size", "p_retailprice", bins=5)
    assert cells.agg(F.sum("n")).first()[0] == 400


def test_correlations_of_many_columns_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 4)) @ rng.standard_normal((4, 90)) + rng.standard_normal((300, 90))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8] = 3.0, np.nan
    names = [f"v.{i}" for i in range(90)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"`{n}` double" for n in names)).repartition(5)
    monkeypatch.setattr(P, "SLICE_ENTRIES", 500)
    found = {(r.var_x, r.var_y): r["corr"] for r in P.correlation_matrix(df, block=20, entries=1200).collect()}
    assert len(found) == 8100 and found == {**found, **{(b, a): r for (a, b), r in found.items()}}
    for i in range(0, 90, 3):
        for j in range(90):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            got = found[names[i], names[j]]
            if {i, j} & {7, 8}:
                assert got is None
            else:
                assert got == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-12)


def test_correlations_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b double, t string")
    assert {r["corr"] for r in P.correlation_matrix(df).collect()} == {None}
    assert P.correlation_matrix(df, []).collect() == []


def test_scatter_draws_exactly(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS x", "id % 3 AS y", "id")
    train, test = rows.where("id % 5 > 0"), rows.where("id % 5 = 0")
    for keys in (["id"], None):
        points = P.scatter(train, test, "x", "y", max_points=64, key_cols=keys)
        assert points.count() == 64 and points.columns == ["x", "y", "split"]
        again = P.scatter(train.repartition(7), test.repartition(3), "x", "y", max_points=64, key_cols=keys)
        assert sorted(points.collect()) == sorted(again.collect())
        assert P.scatter(train, test, "x", "y", max_points=5000, key_cols=keys).count() == 1000
        assert P.scatter(train, test, "x", "y", max_points=0, key_cols=keys).count() == 0
    with pytest.raises(ValueError, match="negative"):
        P.scatter(train, test, "x", "y", max_points=-1)


def test_numbers_do_not_depend_on_partitions(spark):
    from modelloom.operators.reshape import with_counter

    df = spark.range(3000).selectExpr("id % 3 AS kind", "id % 500 AS a", "CAST(id % 250 AS string) AS b")
    numbers = [sorted(with_counter(d, ["kind"]).collect()) for d in (df, df.repartition(5), df.orderBy("b", "a"))]
    assert numbers[0] == numbers[1] == numbers[2]
    assert [r.Counter for r in numbers[0]] == list(range(1, 3001))
    # One row that is all of the table is spread over the cluster as well.
    same = spark.range(2000).selectExpr("1 AS a")
    assert sorted(r.Counter for r in with_counter(same, ["a"]).collect()) == list(range(1, 2001))
