import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modelloom.operators import split as S
from tests.conftest import plan_of


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_share_is_exact_and_sides_are_disjoint(orders):
    train, test = S.split_random(orders, "70%", key_cols=["o_orderkey"])
    assert train.count() == 1050 and test.count() == 450
    assert train.join(test, "o_orderkey", "left_semi").count() == 0


def test_split_does_not_depend_on_partitioning(orders):
    keys = [
        rows(S.split_random(o, 0.6, key_cols=["o_orderkey"]).train.select("o_orderkey"))
        for o in (orders, orders.repartition(7), orders.orderBy(F.desc("o_totalprice")))
    ]
    assert keys[0] == keys[1] == keys[2]


def test_seed_changes_the_draw(orders):
    a, b = (rows(S.split_random(orders, 0.5, seed=s, key_cols=["o_orderkey"]).train.select("o_orderkey")) for s in (1, 2))
    assert len(a) == len(b) and a != b


def test_boundary_is_found_by_descending(orders, monkeypatch):
    plain = rows(S.split_random(orders, 0.37, key_cols=["o_orderkey"]).train)
    monkeypatch.setattr(S, "COLLECT_AT_MOST", 0)
    monkeypatch.setattr(S, "STEP_DIGITS", 1)
    assert rows(S.split_random(orders, 0.37, key_cols=["o_orderkey"]).train) == plain


def test_keyed_split_is_a_filter_without_shuffle(orders):
    for side in S.split_random(orders, 0.7, key_cols=["o_orderkey"]):
        assert "Exchange" not in plan_of(side) and "Join" not in plan_of(side)


def test_keys_that_repeat_are_refused(orders):
    with pytest.raises(ValueError, match="apart"):
        S.split_random(orders, 0.5, key_cols=["o_orderstatus"])


def test_approximate_split(orders):
    train, test = S.split_random(orders, 0.7, key_cols=["o_orderkey"], exact=False)
    assert train.count() + test.count() == 1500 and abs(train.count() - 1050) < 75


def test_hot_row_is_sampled_like_any_other(spark, monkeypatch):
    """A third of the rows are equal; they are cut into many chunks."""
    monkeypatch.setattr(S, "COPIES_PER_CHUNK", 7)
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("a"),
        F.when(F.col("id") % 3 != 0, F.lit("x")).alias("b"),
    )
    train, test = S.split_random(df, 0.5)
    assert train.count() == 1500
    hot = train.filter("a = -1").count()
    assert 400 < hot < 600
    assert test.filter("a = -1").count() == 0
    assert test.count() == 3000 - 1500 - (1000 - hot)


def test_complement_of_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, 5), (3, 6)], "a int, b int")
    out = S.complement(df, spark.createDataFrame([(1, None)], "a int, b int"))
    assert rows(out) == [(2, 5), (2, 5), (3, 6)]
    assert out.columns == ["a", "b"]
    assert rows(S.complement(df, df.limit(0))) == rows(df)
    assert rows(S.complement(df, df)) == []


def test_complement_keeps_hot_rows_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "COPIES_PER_CHUNK", 10)
    df = spark.range(1000).select((F.col("id") % 3).alias("k"))
    out = S.complement(df, spark.createDataFrame([(1,)], "k long"))
    assert out.groupBy("k").count().orderBy("k").collect() == [(0, 334), (2, 333)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(0, 3), st.none() | st.integers(0, 2)), min_size=1, max_size=25),
    st.sampled_from([0.2, 0.5, 0.8]),
)
def test_split_without_key_property(spark, data, share):
    df = spark.createDataFrame(data, "a int, b int")
    train, test = S.split_random(df, share)
    drawn, left = rows(train), rows(test)
    assert len(drawn) == round(len(data) * share)
    assert left == sorted((r for r in data if r not in set(drawn)), key=str)


def test_parse_share():
    assert S.parse_share("70%") == 0.7 and S.parse_share(0.25) == 0.25
    for bad in ("0%", "100%", 1.0, -1):
        with pytest.raises(ValueError):
            S.parse_share(bad)


def test_time_split_and_pushdown(orders):
    train, test = S.split_time(orders, "o_orderdate", cut="1998-01-01", start="1996-01-01", end="2000-01-01")
    lo, hi = train.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    assert str(lo) >= "1996-01-01" and str(hi) <= "1998-01-01 00:00:00"
    assert str(test.agg(F.min("o_orderdate")).first()[0]) > "1998-01-01"
    for side in (train, test):
        plan = plan_of(side)
        assert "Exchange" not in plan
        assert "o_orderdate" in plan.split("PushedFilters")[1].split("ReadSchema")[0]


def test_time_split_limits(spark):
    df = spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2020-01-10')) AS d")
    train, test = S.split_time(df, "d", "2020-01-04", "2020-01-02", "2020-01-08")
    assert (train.count(), test.count()) == (3, 4)
    assert S.split_time(df, "d", "2020-01-04", end="2020-01-08", end_inclusive=False).test.count() == 3
    assert S.split_time(df, "d", "2020-01-04").train.count() == 4
    with pytest.raises(ValueError):
        S.split_time(df, "d", "2020-01-04", start="2020-01-05")
    with pytest.raises(TypeError):
        S.split_time(df.withColumn("x", F.lit(1)), "x", 1)


def test_default_periods_of_dates(spark):
    df = spark.sql("SELECT explode(array(DATE '2020-01-01', DATE '2020-01-02', DATE '2020-01-31')) AS d")
    assert S.default_periods(df, "d") == ("2020-01-01", "2020-01-11", "2020-01-31")


def test_mean_time_ignores_the_session_zone(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2021-03-28 00:30:00', TIMESTAMP_NTZ '2021-03-28 04:30:00')) AS t")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert S.default_periods(df, "t").cut == "2021-03-28 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_keys_do_not_run_together(spark):
    from modelloom.functions import content_hash

    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("\\N", "x"), ("\\", "|"), ("\\|", "")]
    df = spark.createDataFrame(rows, "p string, q string")
    assert df.select(content_hash(1, ["p", "q"])).distinct().count() == len(rows)


def test_periods_are_compared_as_times(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-20 06:30:00' AS t")
    split = S.split_time(df, "t", cut="2024-01-20T06:00:00", end="2024-01-20 07:00:00")
    assert (split.train.count(), split.test.count()) == (0, 1)
    with pytest.raises(ValueError, match="forward"):
        S.split_time(df, "t", cut="2024-01-20T06:00:00", end="2024-01-20 05:00:00")
