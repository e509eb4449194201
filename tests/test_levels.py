"""Encoding of categories with many levels."""

import random

import pytest
from pyspark.sql import functions as F

from modelloom import learners as L
from modelloom.operators.levels import fit_levels, fold_of
from modelloom.plans.compare import compare
from tests.conftest import plan_of

SCHEMA = "id long, level string, y double, kind string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    made = []
    for i in range(4000):
        level = "hot" if i % 3 == 0 else rnd.choice([None, "", "null", "=x", *(f"l{k}" for k in range(900))])
        made.append((i, level, None if i % 97 == 0 else rnd.gauss(len(level or ""), 1), rnd.choice("abc")))
    return made


def plain(rows, folds, own_fold, smoothing, target):
    """The encoding of every row, from all rows but those of its fold (of all for None)."""
    used = [(level, target(r), folds[r[0]]) for r in rows for level in [r[1]] if r[2] is not None]
    prior = sum(t for _, t, _ in used) / len(used)
    found = {}
    for r in rows:
        mine = [t for level, t, f in used if level == r[1] and (not own_fold or f != folds[r[0]])]
        mean = (sum(mine) + smoothing * prior) / (len(mine) + smoothing) if mine else prior
        found[r[0]] = (len(mine) / len(used), mean)
    return found


@pytest.mark.parametrize("own_fold", [True, False])
def test_equals_plain_encoding(spark, rows, own_fold):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    folds = {r.id: r.f for r in df.select("id", fold_of(["id"], 7, 4).alias("f")).collect()}
    table = fit_levels(df, ["level"], "y", ["id"], folds=4, smoothing=3, seed=7)
    few = rows[:600]
    wanted = plain(rows, folds, own_fold, 3, lambda r: r[2])
    for r in table.encode(df, fitting=own_fold).where(F.col("id") < len(few)).collect():
        assert (r.level_freq, r.level_mean) == pytest.approx(wanted[r.id])
        assert (r.id, r.level, r.y, r.kind) == rows[r.id]


def test_class_shares_and_unseen_levels(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    table = fit_levels(df, ["level"], "kind", ["id"], classes=["a", "b", "c"], smoothing=0)
    assert table.encoded_names == ["level_freq", "level_share_b", "level_share_c"]
    new = spark.createDataFrame([(1, "new"), (2, "hot"), (3, None)], "id long, level string")
    found = {r.id: r for r in table.encode(new).collect()}
    counts = {k: sum(r[3] == k for r in rows) for k in "abc"}
    hot = [r[3] for r in rows if r[1] == "hot"]
    assert (found[1].level_freq, found[1].level_share_b) == pytest.approx((0.0, counts["b"] / len(rows)))
    assert found[2].level_share_c == pytest.approx(hot.count("c") / len(hot))
    assert found[3].level_freq == pytest.approx(sum(r[1] is None for r in rows) / len(rows))


def test_hot_levels_are_broadcast(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    encoded = fit_levels(df, ["level"], "y", ["id"]).encode(df)
    # One for the hot levels; small tables of rare levels may be broadcast by Spark as well.
    assert "BroadcastHashJoin" in plan_of(encoded) and "__hot_lv" in plan_of(encoded)


def test_edges(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    empty = fit_levels(df.where("false"), ["level"], "y", ["id"])
    found = empty.encode(df.limit(3)).collect()
    assert {(r.level_freq, r.level_mean) for r in found} == {(0.0, 0.0)}
    with pytest.raises(ValueError, match="already columns"):
        fit_levels(df, ["level"], "y", ["id"]).encode(df.withColumn("LEVEL_FREQ", F.lit(1)))
    with pytest.raises(ValueError, match="folds"):
        fit_levels(df, ["level"], "y", ["id"], folds=1)
    with pytest.raises(ValueError, match="no category"):
        fit_levels(df, [], "y", ["id"])


def test_compare_takes_more_levels_than_a_vector_could(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    with pytest.raises(ValueError, match="target encoded"):
        compare(train, test, "y", ["level"], "regression", [L.GeneralizedLinear()], max_levels=100)
    done = compare(train, test, "y", ["level"], "regression", [L.GeneralizedLinear()], key_cols=["id"], max_levels=100, target_encode=["level"])
    error = done.predictions.where("y IS NOT NULL").agg(F.avg(F.pow(F.col("y") - F.col(done.labels[0]), 2)), F.var_pop("y")).first()
    assert error[0] < error[1] / 1.05
    kinds = compare(train, test, "kind", ["level"], "classification", [L.Logistic()], key_cols=["id"], target_encode=["level"])
    assert kinds.predictions.count() == test.count()
    with pytest.raises(ValueError, match="key_cols"):
        compare(train, test, "y", ["level"], "regression", [L.GeneralizedLinear()], target_encode=["level"])
