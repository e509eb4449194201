import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelloom import learners as L
from modelloom.learners.base import encode_training, predict_all, train_model
from modelloom.learners.linear import standardised_coefficients
from modelloom.learners.names import ACTIVATIONS, LOSSES
from modelloom.learners.neural import Network, output_slope
from modelloom.operators.encode import LABEL, fit_encoder
from modelloom.operators.metrics import classification_metrics, regression_metrics


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(2, 600))
    kind = rng.choice(["p", "q", "r"], 600)
    y = 5 + 2 * a - 3 * b + np.array([{"p": 0.0, "q": 4.0, "r": -1.0}[k] for k in kind])
    side = np.where(a + b > 0.5, "up", np.where(a - b > 0.5, "mid", "low"))
    rows = [(i, float(a[i]), float(b[i]), str(kind[i]), float(y[i]), str(side[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a double, b double, kind string, y double, side string")
    return df.repartition(3, "id").cache()


def error(df, model, y):
    of = regression_metrics if model.data.task == "regression" else classification_metrics
    row = of(predict_all(df, [model]), y, [model.label]).first()
    return row["rmse"] if model.data.task == "regression" else row["error_pct"]


def test_planted_coefficients(planted):
    data = encode_training(planted, "y", "regression", ["a", "b", "kind"])
    model = L.GeneralizedLinear().fit(data)
    got = dict(zip(["a", "b", "r", "q"], model.model.coefficients))
    assert np.allclose([got["a"], got["b"], got["r"], got["q"]], [2, -3, -1, 4], atol=1e-8)
    assert math.isclose(model.model.intercept, 5, abs_tol=1e-8)
    assert data.encoder.linear_names == ["a", "b", "kind", "kind"]
    sizes = dict(standardised_coefficients(data, model.model))
    assert set(sizes) == {"a", "b", "kind"} and sizes["b"] > sizes["a"]


def descend(x, y, family, lam, alpha, rounds=400):
    """Elastic net by plain proximal gradient on mean deviance / 2 (log link)."""
    beta, b0, step = np.zeros(x.shape[1]), math.log(y.mean()), 0.05
    for _ in range(rounds * 20):
        mu = np.exp(b0 + x @ beta)
        r = (mu - y) if family == "poisson" else (1 - y / mu)
        b0 -= step * r.mean()
        beta = beta - step * (x.T @ r / len(y) + lam * (1 - alpha) * beta)
        beta = np.sign(beta) * np.maximum(np.abs(beta) - step * lam * alpha, 0)
    return b0, beta


@pytest.mark.parametrize("family", ["poisson", "gamma"])
def test_penalised_glm_reaches_the_optimum(spark, family):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    x /= x.std(axis=0, ddof=1)
    mu = np.exp(0.5 + x @ np.array([0.6, -0.4, 0.0]))
    y = rng.poisson(mu) + 0.0 if family == "poisson" else rng.gamma(3, mu / 3)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    data = encode_training(df, "y", "regression", ["a", "b", "c"])
    model = L.GeneralizedLinear(family=family, link="log", lambda_=0.2, alpha=0.5, tolerance=1e-9).fit(data).model
    b0, beta = descend(x, y, family, 0.2, 0.5)
    assert np.allclose(model.coefficients.toArray(), beta, atol=2e-4) and math.isclose(model.intercept, b0, abs_tol=2e-4)
    assert model.coefficients[2] == 0.0


@pytest.mark.parametrize(
    "learner",
    [
        L.RandomForest(trees=10, max_depth=6),
        L.DecisionTree(max_depth=6),
        L.GradientBoosting(trees=10),
        L.NeuralNetwork(hidden=(16,), epochs=8, rate=0.02),
    ],
    ids=lambda v: v.label,
)
def test_regressors_beat_the_mean(planted, learner):
    data = encode_training(planted, "y", "regression", ["a", "b", "kind"])
    model = learner.fit(data)
    sd = planted.agg(F.stddev_pop("y")).first()[0]
    assert error(planted, model, "y") < 0.6 * sd
    assert math.isclose(sum(v for _, v in model.importance), 1.0, rel_tol=1e-6)
    assert [n for n, _ in model.importance] == ["a", "b", "kind"]


@pytest.mark.parametrize(
    "learner",
    [
        L.NaiveBayes(),
        L.MLlibNaiveBayes(model_type="gaussian"),
        L.Logistic(),
        L.RandomForest(trees=10, max_depth=6),
        L.DecisionTree(max_depth=6),
        L.GradientBoosting(trees=4, max_depth=3),
        L.NeuralNetwork(hidden=(16,), epochs=8, rate=0.02),
    ],
    ids=lambda v: type(v).__name__,
)
def test_classifiers_beat_the_most_frequent_class(planted, learner):
    data = encode_training(planted, "side", "classification", ["a", "b", "kind"])
    assert data.classes == ("low", "mid", "up")
    top = planted.groupBy("side").count().agg(F.max("count")).first()[0]
    assert error(planted, learner.fit(data), "side") < 0.6 * 100 * (1 - top / 600)


def test_same_seed_same_model_for_any_layout(planted):
    outs = []
    for n in (1, 5):
        data = encode_training(planted.repartition(n), "y", "regression", ["a", "b"], key_cols=["id"])
        models = [L.RandomForest(trees=5, max_depth=5).fit(data), L.NeuralNetwork(hidden=(4,), epochs=2).fit(data)]
        outs.append(sorted(map(tuple, predict_all(planted, models).select("id", "Random forest", "Neural network").collect())))
    assert outs[0] == outs[1]


def test_missing_and_unseen_values_get_no_prediction(spark):
    train = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("a", 1.0, 1.0), (None, 1.0, 9.0), ("b", 2.0, None)], "k string, x double, y double")
    test = spark.createDataFrame([("a", 1.0), ("c", 1.0), (None, 1.0), ("a", None), ("b", float("nan"))], "k string, x double")
    data = encode_training(train, "y", "regression", ["k", "x"])
    assert data.df.count() == 3
    models = [L.GeneralizedLinear().fit(data), L.DecisionTree(max_depth=2).fit(data)]
    out = predict_all(test, models)
    assert [r["Decision tree"] for r in out.collect()] == [1.0, None, None, None, None]
    assert [r["Generalized linear regression"] for r in out.collect()] == [1.0, None, None, None, None]
    assert out.columns == ["k", "x", "Generalized linear regression", "Decision tree"]


def test_encoder_kinds(spark):
    df = spark.sql("SELECT 1 AS i, true AS f, DATE '2020-01-02' AS d, array(1.0F, 2.0F) AS v, 'only' AS c")
    e, _ = fit_encoder(df, ["i", "f", "d", "v", "c"])
    assert e.tree_names == ["i", "d", "v_0", "v_1", "f", "c"]
    vector = e.transform(df).first()["__tree"].toArray()
    assert list(vector) == [1.0, 1577923200.0, 1.0, 2.0, 0.0, 0.0]
    bad = spark.sql("SELECT 1 AS i, false AS f, DATE '2020-01-02' AS d, array(1.0F) AS v, 'only' AS c")
    assert e.transform(bad).first()["__ok"] is False


def test_too_many_levels_are_refused(part):
    with pytest.raises(ValueError, match="levels"):
        fit_encoder(part, ["p_name"], max_levels=3)
    with pytest.raises(TypeError):
        fit_encoder(part.withColumn("m", F.create_map(F.lit(1), F.lit(2))), ["m"])


def test_bayes_of_large_values(spark):
    """Values near 1.7e9, as seconds of a time are, do not cancel."""
    rng = np.random.default_rng(1)
    rows = [(i, "a" if i % 2 else "b", 1.7e9 + (30.0 if i % 2 else 0.0) + rng.normal()) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, y string, x double")
    model = train_model(df, "y", "classification", ["x"], L.NaiveBayes())
    assert predict_all(df, [model]).filter(F.col("Naive Bayes") != F.col("y")).count() == 0


def test_arrays_of_two_lengths_are_refused(spark):
    df = spark.range(30).select("id", F.when(F.col("id") == 7, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(F.array(F.lit(1.0), F.col("id"))).alias("v"))
    with pytest.raises(ValueError, match="'v' have 2 to 3"):
        fit_encoder(df, ["v"])


def test_two_thousand_predictors(spark):
    df = spark.range(40).select("id", *[((F.col("id") * (i + 3)) % 17 + F.lit(0.5 * i)).alias(f"x{i}") for i in range(2000)])
    names = [f"x{i}" for i in range(2000)]
    data = encode_training(df.withColumn("y", F.col("x5") * 2.0), "y", "regression", names)
    assert len(data.df.first()["__tree"]) == 2000
    model = L.DecisionTree(max_depth=3).fit(data)
    assert predict_all(df, [model]).filter(F.col("Decision tree").isNull()).count() == 0


def test_layout_follows_rows_and_key_alone(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 3).alias("y"))
    found = []
    for parts in (1, 13):
        data = encode_training(df.repartition(parts), "y", "regression", ["x"], ["id"], partitions=3)
        sizes = data.df.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()
        found.append((sizes, L.RandomForest(trees=3, max_depth=3).fit(data).model.toDebugString.split("\n", 1)[1]))
        data.release()
    assert found[0] == found[1]
    assert encode_training(df, "y", "regression", ["x"]).df.rdd.getNumPartitions() == 1


def test_class_and_level_limits_can_be_set(part):
    with pytest.raises(ValueError, match="more than 3 levels"):
        train_model(part, "p_size", "regression", ["p_type"], L.DecisionTree(), max_levels=3)
    with pytest.raises(ValueError, match="more than 2 levels"):
        train_model(part, "p_type", "classification", ["p_size"], L.NaiveBayes(), max_classes=2)


def test_joint_boosting_adds_up_its_trees(planted, monkeypatch):
    """Scores past the checkpoint equal the trees' own predictions, summed one by one."""
    from modelloom.learners import trees

    monkeypatch.setattr(trees, "CHECKPOINT_EVERY", 3)
    data = encode_training(planted, "side", "classification", ["a", "b", "kind"], ["id"])
    learner = L.GradientBoosting(trees=7, max_depth=3, learn_rate=0.3)
    fitted = learner.fit(data)
    encoded = data.df.withColumn("row", F.monotonically_increasing_id()).persist()
    sizes = {r[LABEL]: r["count"] for r in encoded.groupBy(LABEL).count().collect()}
    total = np.log([[sizes[float(k)] / sum(sizes.values()) for k in range(3)]] * sum(sizes.values()))
    for each in fitted.model:
        for k, tree in enumerate(each):
            values = [r.t for r in tree.setPredictionCol("t").transform(encoded).orderBy("row").collect()]
            total[:, k] += 0.3 * 2 / 3 * np.array(values)
    found = [r.best for r in fitted.score(encoded, "best").orderBy("row").collect()]
    assert len(fitted.model) == 7 and found == total.argmax(axis=1).tolist()
    assert len(set(found)) > 1


def test_losses_in_classification_are_refused(planted):
    data = encode_training(planted, "side", "classification", ["a"])
    with pytest.raises(ValueError, match="cross entropy"):
        L.NeuralNetwork(loss="Absolute", epochs=1).fit(data)


def test_bayes_small_deviations(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 5.0), ("b", 5.0)], "y string, x double")
    tables = L.NaiveBayes().fit(encode_training(df, "y", "classification", ["x"])).model
    assert tables.sd.tolist() == [[0.01], [0.01]]


def test_multinomial_bayes_names_the_alternative(planted):
    data = encode_training(planted, "side", "classification", ["a"])
    with pytest.raises(ValueError, match="gaussian"):
        L.MLlibNaiveBayes().fit(data)


def test_parameter_ranges():
    for bad in (
        lambda: L.RandomForest(max_depth=31),
        lambda: L.GeneralizedLinear(family="binomial"),
        lambda: L.GradientBoosting(learn_rate=0.0),
        lambda: L.NeuralNetwork(hidden=()),
        lambda: L.NeuralNetwork(activation="Sigmoid"),
        lambda: L.Logistic(elastic_net=2.0),
    ):
        with pytest.raises(ValueError):
            bad()


def test_task_mismatch(planted):
    with pytest.raises(ValueError, match="serve"):
        L.Logistic().fit(encode_training(planted, "y", "regression", ["a"]))


def test_joint_boosting_of_three_classes(planted):
    """More rounds fit better; importances are shares."""
    data = encode_training(planted, "side", "classification", ["a", "b", "kind"])
    errors = [error(planted, L.GradientBoosting(trees=n, max_depth=2, learn_rate=0.3).fit(data), "side") for n in (1, 8)]
    assert errors[1] < errors[0]
    model = L.GradientBoosting(trees=3, max_depth=3, sample_rate=0.8).fit(data)
    assert math.isclose(sum(v for _, v in model.importance), 1.0, rel_tol=1e-9)
    assert dict(model.importance)["kind"] < dict(model.importance)["a"]
    assert [len(trees) for trees in model.model] == [3, 3, 3]


@pytest.mark.parametrize("activation", [a for a in ACTIVATIONS if not a.endswith("Dropout")])
@pytest.mark.parametrize("loss", ["CrossEntropy", *[v for v in LOSSES if v != "Automatic"]])
def test_network_gradient(activation, loss):
    """Backward pass against finite differences."""
    rng = np.random.default_rng(0)
    net = Network([3, 4, 5, 2 if loss == "CrossEntropy" else 1], activation)
    flat = net.initial(1) + rng.normal(0, 0.1, net.initial(1).shape)
    x = rng.normal(size=(7, 3))
    y = rng.integers(0, 2, 7).astype(float) if loss == "CrossEntropy" else rng.normal(size=7)

    def value(w):
        out, trace = net.forward(net.unpack(w), x)
        return output_slope(out, y, loss, 0.3), trace

    (_, delta), trace = value(flat)
    grad = np.concatenate([g.ravel() for g in net.backward(net.unpack(flat), trace, delta)])
    for i in range(0, len(flat), 5):
        bump = np.zeros_like(flat)
        bump[i] = 1e-6
        slope = (value(flat + bump)[0][0] - value(flat - bump)[0][0]) / 2e-6
        assert math.isclose(slope, grad[i], rel_tol=1e-3, abs_tol=1e-6)


def test_network_variants_learn(planted):
    data = encode_training(planted, "y", "regression", ["a", "b"])
    for params in ({"activation": "MaxoutWithDropout"}, {"loss": "Huber", "activation": "Tanh"}, {"loss": "Quantile", "quantile": 0.9}):
        history = L.NeuralNetwork(hidden=(8,), epochs=3, rate=0.02, **params).fit(data).model["history"]
        assert history[-1] < history[0]


@pytest.mark.parametrize("family", ["poisson", "gamma", "tweedie"])
@pytest.mark.parametrize("link", ["log", "identity"])
def test_penalised_fits_agree_with_repeated_least_squares(planted, family, link):
    """One pass a reweighting gives what refitting MLlib's least squares each time gives."""
    rows = planted.withColumn("z", F.exp(F.lit(1.0) + 0.3 * F.col("a") - 0.2 * F.col("b")) + 0.5)
    data = encode_training(rows, "z", "regression", ["a", "b", "kind"], ["id"])
    learner = L.GeneralizedLinear(family=family, link=link, lambda_=0.05, alpha=0.4, tolerance=1e-9)
    fitted = learner.fit(data)
    score, _, _ = learner._fit_penalised_wide(data)
    encoded = data.df.withColumn("__ok", F.lit(True))
    pairs = score(fitted.score(encoded, "one"), "two").select("one", "two").collect()
    assert [r.one for r in pairs] == pytest.approx([r.two for r in pairs], rel=1e-5)
    # One pass for means and spreads, one for each of a few reweightings.
    assert learner.with_params(max_iterations=3).fit(data).model.passes == 4
    assert 4 <= fitted.model.passes < 40


def test_penalised_fit_meets_its_optimum(planted):
    """The penalised deviance can't be lowered by moving any coefficient."""
    rows = planted.withColumn("z", F.floor(F.exp(F.lit(1.0) + 0.3 * F.col("a"))).cast("double"))
    data = encode_training(rows, "z", "regression", ["a", "b"], ["id"])
    learner = L.GeneralizedLinear(family="poisson", link="log", lambda_=0.1, alpha=0.5, tolerance=1e-10)
    model = learner.fit(data).model
    kept = data.df.select("__tree", LABEL).collect()
    x, y = np.array([r["__tree"].toArray() for r in kept]), np.array([r[LABEL] for r in kept])
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)

    def loss(w):
        mu = np.exp(x @ w[:-1] + w[-1])
        ratio = np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0.0)
        return (ratio - (y - mu)).mean() + 0.1 * (0.5 * np.abs(w[:-1]).sum() + 0.25 * (w[:-1] ** 2).sum())

    best = model.standardised
    for i in range(len(best)):
        for step in (-1e-4, 1e-4):
            moved = best.copy()
            moved[i] += step
            assert loss(moved) >= loss(best) - 1e-12


@pytest.mark.parametrize("learner", [L.RandomForest(trees=3, sample_rate=1.0, bootstrap=False), L.GradientBoosting(trees=1, max_depth=8)])
def test_number_of_few_values_is_split_between_any_two(spark, learner):
    """Fifty values and twenty or thirty-two bins: every border between two values can be a split."""
    rows = spark.range(3000).select("id", (F.col("id") % 50).alias("x"), (F.col("id") % 50).cast("double").alias("y"))
    model = train_model(rows, "y", "regression", ["x"], learner, ["id"])
    wrong = predict_all(rows, [model]).where(F.col(learner.label) != F.col("y"))
    assert wrong.count() == 0


def test_equal_rows_of_categories_are_fitted_as_weighted_ones(spark):
    """Three thousand rows of four kinds go to the learners as a few; a leaf's least rows are counted in rows."""
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") == 0, "rare").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("s"),
        F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("kind"),
    ).withColumn("s", F.when(F.col("id") != 7, F.col("s")))
    learners = [L.DecisionTree(), L.GradientBoosting(trees=2), L.Logistic(), L.NaiveBayes(laplace=1.0), L.RandomForest(trees=2, sample_rate=1.0, bootstrap=False)]
    few = encode_training(rows, "kind", "classification", ["s"], ["id"], learners=learners)
    all_rows = encode_training(rows, "kind", "classification", ["s"], ["id"])
    assert few.folded and not all_rows.folded
    assert few.df.count() <= 32 * 10 and all_rows.df.count() == 2999
    assert few.df.agg(F.sum("__weight")).first()[0] == 2999
    for learner in learners:
        pair = [predict_all(rows, [learner.fit(d)]).select("id", learner.label) for d in (few, all_rows)]
        assert pair[0].exceptAll(pair[1]).count() == 0
    small, large = (learner.fit(d).model for learner in [L.NaiveBayes(laplace=1.0)] for d in (few, all_rows))
    assert (small.counts == large.counts).all() and (small.log_share[0] == large.log_share[0]).all()
    few.release(), all_rows.release()


@pytest.mark.parametrize("learner", [L.RandomForest(trees=2), L.GradientBoosting(trees=2, sample_rate=0.5), L.Logistic(reg_param=0.1), L.NeuralNetwork(hidden=(2,))])
def test_learners_that_draw_rows_see_all_of_them(spark, learner):
    rows = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("s"), (F.col("id") % 2).cast("string").alias("kind"))
    data = encode_training(rows, "kind", "classification", ["s"], ["id"], learners=[L.DecisionTree(), learner])
    assert not data.folded and data.df.count() == 300
    data.release()
