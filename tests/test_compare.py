import math
import random
import time
from dataclasses import replace
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from modelloom import classification, compare, regression
from modelloom import learners as L
from modelloom.functions import content_hash
from modelloom.learners.base import encode_training
from modelloom.operators.metrics import classification_metrics
from modelloom.plans.automl import AutoML, leader_summary, search_leaderboard
from tests.conftest import plan_of

QUICK_REGRESSION = [L.GeneralizedLinear(), L.RandomForest(trees=3, max_depth=4), L.DecisionTree(max_depth=4), L.GradientBoosting(trees=2)]
QUICK_CLASSES = [L.NaiveBayes(), L.RandomForest(trees=3, max_depth=4), L.Logistic(), L.DecisionTree(max_depth=4)]


@pytest.fixture(scope="module")
def flowers(spark):
    """150 rows in three kinds with dotted names and some repeated rows."""
    i = F.col("id")
    kind = F.element_at(F.array(F.lit("first"), F.lit("second"), F.lit("third")), (i % 3 + 1).cast("int"))
    return spark.range(150).select(
        F.round(F.lit(1.0) * (i % 3) + (i % 7) / 10.0, 1).alias("Petal.Width"),
        F.round(F.lit(2.0) * (i % 3) + (i % 5) / 5.0, 1).alias("Petal.Length"),
        F.round(F.lit(5.0) + (i % 4) / 4.0, 1).alias("Sepal.Length"),
        kind.alias("Species"),
    )


@pytest.fixture(scope="module")
def years(spark):
    """Sixteen yearly rows, as a short time series."""
    return spark.range(16).select(
        F.make_date(F.lit(1947) + F.col("id").cast("int"), F.lit(1), F.lit(1)).alias("Year"),
        (F.lit(234.0) + F.col("id") * 20).alias("GNP"),
        (F.lit(107.0) + F.col("id") * 1.5).alias("Population"),
    )


def test_regression_on_flowers(flowers):
    result = regression(flowers, "Petal.Width", learners=QUICK_REGRESSION)
    assert result.y == "Petal_Width" and result.train.count() == 105
    board = result.leaderboard.collect()
    assert len(board) == 4 and [r["rank"] for r in board] == [1, 2, 3, 4]
    assert [r["mape"] for r in board] == sorted(r["mape"] for r in board)
    assert set(result.predictions.columns) == {"Petal_Width", "Petal_Length", "Sepal_Length", "Species", *result.labels}
    tops = result.importance.groupBy("model").agg(F.max("scaled_importance").alias("m"), F.sum("importance").alias("s")).collect()
    assert len(tops) == 3 and all(r["m"] == 1.0 and math.isclose(r["s"], 1.0) for r in tops)


def test_classification_on_flowers(flowers):
    result = classification(flowers, "Species", learners=QUICK_CLASSES, parallelism=2)
    assert {r["Model"] for r in result.leaderboard.collect()} == {c.label for c in QUICK_CLASSES}
    status = {r["model"]: r["message"] for r in result.status.collect()}
    assert "importance" in status["Naive Bayes"] and status["Random forest"] == ""
    values = {r[0] for r in result.predictions.select("Decision tree").distinct().collect()}
    assert values <= {"first", "second", "third"}
    result.cache()
    assert result.predictions.count() == result.test.count()
    result.close()


def test_time_series_splits_by_the_mean_date(years):
    result = regression(years, "Population", learners=[L.GeneralizedLinear()])
    assert result.models[0].encoder.features == ("GNP",)
    assert (result.train.count(), result.test.count()) == (8, 8)
    assert result.leaderboard.first()["mape"] == 0.0


def test_time_series_with_own_periods(years):
    result = regression(years, "Population", learners=[L.GeneralizedLinear()], start="1950-01-01", cut="1955-01-01", end="1960-01-01")
    assert (result.train.count(), result.test.count()) == (6, 5)
    off = regression(years, "Population", learners=[L.GeneralizedLinear()], time_col=None, share="50%")
    assert off.train.count() == 8


def test_bad_choices(flowers):
    train = flowers.toDF("w", "l", "s", "k")
    with pytest.raises(ValueError, match="at least one"):
        compare(train, train, "w", ["l"], "regression", [])
    with pytest.raises(ValueError, match="predictor"):
        compare(train, train, "w", [], "regression")
    with pytest.raises(ValueError, match="serve"):
        compare(train, train, "w", ["l"], "regression", [L.Logistic()])
    taken = train.withColumnRenamed("s", "Decision tree")
    with pytest.raises(ValueError, match="already columns"):
        compare(taken, taken, "w", ["l"], "regression", [L.DecisionTree()])


def test_learners_by_name(flowers):
    train = flowers.toDF("w", "l", "s", "k")
    result = compare(train, train, "w", ["l"], "regression", ["DecisionTree", "Generalized linear regression"])
    assert result.labels == ["Decision tree", "Generalized linear regression"]
    assert isinstance(L.learner("Naive Bayes"), L.NaiveBayes)
    with pytest.raises(ValueError, match="no learner"):
        L.learner("SVM")
    with pytest.raises(ValueError, match="task"):
        compare(train, train, "w", ["l"], "clustering")


def test_missing_values_can_be_refused(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 3.0)], "y double, x double")
    with pytest.raises(ValueError, match="'x': 1"):
        compare(df, df, "y", ["x"], "regression", ["DecisionTree"], missing="error")
    gappy = spark.range(40).select("id", F.col("id").cast("double").alias("y"), F.when(F.col("id") % 2 == 0, 1.0).alias("x"))
    with pytest.raises(ValueError, match="missing values per column: {'x'"):
        regression(gappy, "y", ["x"], ["DecisionTree"], key_cols=["id"], missing="error")
    assert compare(df, df, "y", ["x"], "regression", ["DecisionTree"]).predictions.count() == 3


def test_failures_are_reported(flowers):
    train = flowers.toDF("w", "l", "s", "k").withColumn("w", F.col("w") - 5)
    chosen = [L.GeneralizedLinear(family="gamma", link="log"), L.DecisionTree(max_depth=2)]
    with pytest.raises(Exception):
        compare(train, train, "w", ["l"], "regression", chosen)
    result = compare(train, train, "w", ["l"], "regression", chosen, on_error="keep")
    assert result.labels == ["Decision tree"]
    assert {r["model"]: r["status"] for r in result.status.collect()}["Generalized linear regression"] == "failed"


def test_search_repeats_with_a_fixed_number_of_models(flowers):
    train = flowers.toDF("w", "l", "s", "k").withColumn("id", F.monotonically_increasing_id())
    search = AutoML(families=("GLM", "DRF", "XGBoost"), max_seconds=None, max_models=2, folds=2,
                    defaults=(("DRF", L.RandomForest(trees=3, max_depth=3)),))
    boards = []
    for _ in range(2):
        result = compare(train, train, "w", ["l", "k"], "regression", [search], key_cols=["id"])
        boards.append(search_leaderboard(train.sparkSession, result.models[0].model).drop("seconds").collect())
    assert boards[0] == boards[1]
    status = {r["family"]: r["status"] for r in boards[0]}
    assert status["GLM"] == status["DRF"] == "ok"
    assert [r["rank"] for r in boards[0]][:2] == [1, 2]
    assert "Auto ML" in result.predictions.columns and result.importance.count() == 2
    assert leader_summary(train.sparkSession, result.models[0].model).first()["parameter"] == "family"


def test_search_stops_in_time(flowers):
    train = flowers.toDF("w", "l", "s", "k")
    search = AutoML(families=("GLM", "DeepLearning"), max_seconds=10.0, folds=2)
    fitted = compare(train, train, "k", ["w", "l"], "classification", [search]).models[0]
    assert fitted.seconds < 13
    assert fitted.model["leader"] is not None
    with pytest.raises(TimeoutError, match="finished a fold"):
        compare(train, train, "k", ["w", "l"], "classification", [AutoML(families=("DeepLearning",), max_seconds=0.01)])


def test_folds_follow_the_key(flowers):
    train = flowers.toDF("w", "l", "s", "k").withColumn("id", F.monotonically_increasing_id())
    search = AutoML(families=("GLM",), max_seconds=None, max_models=1, folds=3)
    metrics = []
    for parts in (1, 7):
        result = compare(train.repartition(parts), train, "w", ["l", "k"], "regression", [search], key_cols=["id"])
        metrics.append(result.models[0].model["candidates"][0].metric)
    assert abs(metrics[0] - metrics[1]) < 1e-9


def test_search_needs_a_limit_and_families():
    with pytest.raises(ValueError):
        AutoML(families=())
    with pytest.raises(ValueError):
        AutoML(families=("SVM",))
    with pytest.raises(ValueError):
        AutoML(max_seconds=None)


def test_successive_halving(planted_prices):
    """Rungs hold nested samples; of all candidates half go on, and the leader comes from the last rung."""
    search = AutoML(families=("GLM",), max_seconds=None, max_models=6, folds=2, rungs=3, keep=0.5)
    data = encode_training(planted_prices, "y", "regression", ["a", "b"], ["id"])
    model = search.fit(data).model
    tried = model["candidates"]
    assert len(tried) == 6 and {c.status for c in tried} == {"ok"}
    # A bracket of four and the two that are left: 4 -> 2 -> 1, 2 -> 1 -> 1.
    assert sorted(c.rung for c in tried) == [1, 1, 1, 2, 3, 3]
    keys = [r[0] for r in data.df.select("__key").collect()]
    for c in tried:
        assert c.rows == sum(k < 2**60 * 0.5 ** (3 - c.rung) for k in keys)
    best = min((c for c in tried if c.rung == 3), key=lambda c: c.metric)
    assert model["leader"].learner == best.learner
    board = search_leaderboard(planted_prices.sparkSession, model).orderBy("rank").collect()
    assert [r.rung for r in board] == [3, 3, 2, 1, 1, 1] and board[0].n_rows == len(keys)


def test_halving_keeps_what_a_failure_on_more_rows_leaves(planted_prices, monkeypatch):
    judge = AutoML._judge

    def failing(self, candidate, sample, *rest):
        found = judge(self, candidate, sample, *rest)
        return replace(found, metric=None, status="failed: Late") if found.rows > 250 else found

    monkeypatch.setattr(AutoML, "_judge", failing)
    search = AutoML(families=("GLM",), max_seconds=None, max_models=2, folds=2, rungs=2, keep=0.5)
    model = search.fit(encode_training(planted_prices, "y", "regression", ["a", "b"], ["id"])).model
    assert {c.rung for c in model["candidates"]} == {1} and all(c.metric is not None for c in model["candidates"])


@pytest.fixture(scope="module")
def planted_prices(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(400)]
    return spark.createDataFrame([(i, a, b, 2 * a - b + rnd.gauss(0, 0.1)) for i, a, b in rows], "id long, a double, b double, y double")


def test_permutation_importance_takes_one_scoring_stage(planted_prices, monkeypatch):
    """All features and models are scored in one pass, and equal a feature-by-feature computation."""
    from modelloom.plans import compare as plan

    calls, score = [], plan.predict_all
    monkeypatch.setattr(plan, "predict_all", lambda *a: calls.append(a) or score(*a))
    models = [L.GeneralizedLinear(), L.DecisionTree(max_depth=4)]
    result = compare(planted_prices, planted_prices, "y", ["a", "b"], "regression", models, key_cols=["id"])
    found = {(r.model, r.feature): r.importance for r in result.permutation_importance(["id"]).collect()}
    assert len(calls) == 1 and len(found) == 4
    rows = planted_prices.withColumn("h", content_hash(123, ["id"])).orderBy("h").collect()
    for feature in ("a", "b"):
        moved = [{**r.asDict(), feature: rows[i - 1][feature]} for i, r in enumerate(rows)]
        both = []
        for table in (moved, [r.asDict() for r in rows]):
            df = planted_prices.sparkSession.createDataFrame([(t["id"], t["a"], t["b"], t["y"]) for t in table], "id long, a double, b double, y double")
            out = score(df, result.models)
            both.append([out.agg(F.sqrt(F.avg(F.pow(F.col(m.label) - F.col("y"), 2)))).first()[0] for m in result.models])
        for m, grown, base in zip(result.models, *both, strict=True):
            assert found[m.label, feature] == pytest.approx(max(0.0, grown - base), abs=1e-9)


def test_training_times_cover_the_fits(planted_prices):
    """Times are not negative, and together no longer than the comparison that held the fits."""
    started = time.perf_counter()
    result = compare(planted_prices, planted_prices, "y", ["a", "b"], "regression", [L.GeneralizedLinear(), L.DecisionTree(max_depth=3)], key_cols=["id"])
    passed = time.perf_counter() - started
    seconds = [m.seconds for m in result.models]
    assert all(s > 0 for s in seconds) and sum(seconds) <= passed
    times = {r.Model: r.train_seconds for r in result.timings.collect()}
    assert times == {m.label: round(m.seconds, 1) for m in result.models}
    assert {r.Model for r in result.leaderboard.collect()} == set(times)


def test_equal_rows_of_categories_are_scored_once(spark):
    """Errors and importances count all rows, though one of each is scored."""
    rows = spark.range(1200).select(
        "id",
        (F.col("id") % 4).cast("string").alias("s"),
        F.when(F.col("id") % 4 == 1, "a").when(F.col("id") % 7 == 0, "b").when(F.col("id") != 5, "c").alias("kind"),
    )
    found = compare(rows, rows, "kind", ["s"], "classification", [L.DecisionTree(), L.NaiveBayes()], key_cols=["id"])
    assert plan_of(found.metrics).count("keys=[s#") >= 1
    plain = classification_metrics(found.predictions, "kind", found.labels)
    assert found.metrics.schema == plain.schema and sorted(found.metrics.collect()) == sorted(plain.collect())
    errors = {r["Model"]: r["errors"] for r in plain.collect()}
    pairs = [(r["id"], r["s"], r["kind"], r["Decision tree"]) for r in found.predictions.collect()]
    named = {s: p for _, s, _, p in pairs}
    order = sorted(pairs, key=lambda r: md5(f"123|{r[0]}".encode()).hexdigest())
    grown = sum(r[2] is not None and named[order[i - 1][1]] != r[2] for i, r in enumerate(order))
    importance = found.permutation_importance(["id"]).where("model = 'Decision tree'").first()["importance"]
    assert importance == pytest.approx(100 * (grown - errors["Decision tree"]) / 1200)
