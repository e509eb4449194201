"""Trained models and their predictions.

Where a model has a closed form (least squares, group means of a saturated model,
counted shares) the SQL computes it directly. Learners that follow random draws
or iterate without closed form have no SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from modelloom import learners as L
from modelloom.learners.base import predict_all, train_model
from modelloom.operators.reshape import top_features
from modelloom.operators.split import split_random
from modelloom.plans.automl import AutoML, leader_summary, search_leaderboard
from modelloom.plans.compare import classification, compare, regression
from modelloom.queries.registry import query, split_sql

GLM = "Generalized linear regression"


def _regression_check(pred, y: str, label: str):
    """What SQL can know of a model without closed form: rows, the mean's error, and that the model is better."""
    error = F.avg(F.pow(F.col(label) - F.col(y), 2))
    return pred.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(label).alias("n_predicted"),
        F.round(F.var_pop(y), 4).alias("mean_error"),
        (error < F.var_pop(y)).alias("better"),
    )


def _class_check(pred, y: str, label: str):
    """Rows, the errors of always naming the most frequent class, and that the model makes fewer."""
    sizes = pred.groupBy(y).agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("p"), F.count_if(F.col(label) != F.col(y)).alias("e"))
    rows = F.sum("n")
    return sizes.agg(
        rows.alias("n_rows"),
        F.sum("p").alias("n_predicted"),
        (rows - F.max("n")).alias("majority_errors"),
        (F.sum("e") < rows - F.max("n")).alias("better"),
    )


def regression_check_sql(source: str, y: str) -> str:
    return f"""SELECT count(*) AS n_rows, count(*) AS n_predicted, round(var_pop({y}), 4) AS mean_error, true AS better FROM {source}"""


def class_check_sql(source: str, y: str) -> str:
    return f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_predicted, CAST(sum(n) - max(n) AS BIGINT) AS majority_errors,
      true AS better FROM (SELECT {y}, count(*) AS n FROM {source} GROUP BY 1)"""


def _words(t):
    # As many as there are parts between blanks, told from lengths without making the parts.
    words = (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1).cast("double")
    return t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), words.alias("words"))


WORDS = "words AS (SELECT doc_id, n_chars::DOUBLE AS n_chars, len(string_split(text, ' '))::DOUBLE AS words FROM documents)"
WORDS_SPLIT = split_sql("words", "doc_id")


def _fit_words(t, **params):
    train, test = split_random(_words(t), 0.7, key_cols=["doc_id"])
    model = train_model(train, "n_chars", "regression", ["words"], L.GeneralizedLinear(**params))
    return predict_all(test, [model]).withColumnRenamed(GLM, "prediction")


@query(
    f"""WITH {WORDS}, {WORDS_SPLIT},
    line AS (SELECT regr_slope(n_chars, words) AS b, regr_intercept(n_chars, words) AS a FROM train)
    SELECT doc_id, n_chars, words, round(a + b * words, 3) AS prediction FROM test, line"""
)
def linear_fit_documents(t):
    return _fit_words(t)


@query(
    f"""WITH {WORDS}, {WORDS_SPLIT},
    s AS (SELECT corr(n_chars, words) AS r, stddev_pop(n_chars) AS sy, stddev_pop(words) AS sx, avg(n_chars) AS my, avg(words) AS mx FROM train),
    line AS (SELECT *, r * sy / (1 + 0.5) / sx AS b FROM s)
    SELECT doc_id, n_chars, words, round(my + b * (words - mx), 3) AS prediction FROM test, line"""
)
def ridge_fit_documents(t):
    return _fit_words(t, lambda_=0.5, alpha=0.0)


@query(
    f"""WITH {WORDS}, {WORDS_SPLIT},
    s AS (SELECT corr(n_chars, words) AS r, stddev_pop(n_chars) AS sy, stddev_pop(words) AS sx, avg(n_chars) AS my, avg(words) AS mx FROM train),
    line AS (SELECT *, (r * sy - 0.8 * 0.25) / (1 + 0.8 * 0.75) / sx AS b FROM s)
    SELECT doc_id, n_chars, words, round(my + b * (words - mx), 3) AS prediction FROM test, line"""
)
def elastic_net_documents(t):
    return _fit_words(t, lambda_=0.8, alpha=0.25, tolerance=1e-12)


PART_SPLIT = split_sql("part", "p_partkey")
TYPE_MEANS = f"""WITH {PART_SPLIT}, means AS (SELECT p_type, round(avg(p_size), 3) AS prediction FROM train GROUP BY 1)
    SELECT p_partkey, p_type, p_size, prediction FROM test JOIN means USING (p_type)"""


def _fit_types(t, learner):
    """Part size from part type: with one category a saturated model gives group means."""
    rows = t.part.select("p_partkey", "p_type", "p_size")
    train, test = split_random(rows, 0.7, key_cols=["p_partkey"])
    model = train_model(train, "p_size", "regression", ["p_type"], learner, ["p_partkey"])
    return predict_all(test, [model]).withColumnRenamed(learner.label, "prediction")


@query(TYPE_MEANS)
def glm_gaussian_log_predict(t):
    return _fit_types(t, L.GeneralizedLinear(link="log"))


@query(TYPE_MEANS)
def glm_poisson_predict(t):
    return _fit_types(t, L.GeneralizedLinear(family="poisson", link="log"))


@query(TYPE_MEANS)
def glm_poisson_identity_predict(t):
    return _fit_types(t, L.GeneralizedLinear(family="poisson"))


@query(TYPE_MEANS)
def glm_gamma_predict(t):
    return _fit_types(t, L.GeneralizedLinear(family="gamma", link="log"))


@query(TYPE_MEANS)
def glm_tweedie_predict(t):
    return _fit_types(t, L.GeneralizedLinear(family="tweedie", link="log"))


@query(TYPE_MEANS)
def dt_predict(t):
    return _fit_types(t, L.DecisionTree(max_depth=8))


@query(TYPE_MEANS)
def rf_predict(t):
    """Without bootstrap and subsampling every tree sees all rows."""
    return _fit_types(t, L.RandomForest(trees=5, sample_rate=1.0, bootstrap=False, max_depth=8))


@query(TYPE_MEANS)
def gbt_predict(t):
    return _fit_types(t, L.GradientBoosting(trees=5, max_depth=5))


@query(f"WITH {PART_SPLIT} " + regression_check_sql("test", "p_retailprice"))
def glm_elastic_poisson_predict(t):
    """Poisson with L1 and L2 penalty, by reweighted least squares."""
    train, test = split_random(_prices(t), 0.7, key_cols=["p_partkey"])
    learner = L.GeneralizedLinear(family="poisson", link="log", lambda_=0.1)
    model = train_model(train, "p_retailprice", "regression", ["p_type", "p_brand", "step"], learner)
    return _regression_check(predict_all(test, [model]), "p_retailprice", GLM)


@query(
    f"""WITH steps AS (SELECT p_partkey, p_retailprice - 900 AS y, CASE WHEN p_partkey % 1000 >= 500 THEN 1 ELSE 0 END AS x FROM part),
    s AS (SELECT count(*) AS n, sum(x) AS n1, avg(y) FILTER (x = 1) AS m1, avg(y) FILTER (x = 0) AS m0, stddev_samp(x) AS sd FROM steps)
    SELECT p_partkey, y, x, round(CASE WHEN x = 1 THEN m1 - 2.0 * sd * n / n1 ELSE m0 + 2.0 * sd * n / (n - n1) END, 3) AS prediction
    FROM steps, s"""
)
def glm_lasso_poisson_predict(t):
    """With one 0/1 predictor the lasso moves both group means together by a known step."""
    rows = t.part.select(
        "p_partkey",
        (F.col("p_retailprice") - 900).alias("y"),
        F.when(F.col("p_partkey") % 1000 >= 500, 1).otherwise(0).alias("x"),
    )
    learner = L.GeneralizedLinear(family="poisson", link="log", lambda_=2.0, alpha=1.0, tolerance=1e-10)
    return predict_all(rows, [train_model(rows, "y", "regression", ["x"], learner)]).withColumnRenamed(GLM, "prediction")


FLAG = """flagged AS (
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_linestatus,
        l_linestatus || '-' || l_returnflag AS segment,
        CASE WHEN l_quantity <= 15 THEN 'small' WHEN l_returnflag = 'N' THEN 'kept' WHEN l_linestatus = 'F' THEN 'final' ELSE 'open' END AS kind,
        CASE WHEN l_quantity <= 15 THEN 'no' WHEN l_linestatus = 'F' THEN 'yes' ELSE 'no' END AS done
      FROM lineitem)"""
IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _flagged(t):
    small, closed = F.col("l_quantity") <= 15, F.col("l_linestatus") == "F"
    return t.lineitem.select(
        *IDS,
        "l_quantity",
        "l_extendedprice",
        "l_linestatus",
        F.concat_ws("-", "l_linestatus", "l_returnflag").alias("segment"),
        F.when(small, "small").when(F.col("l_returnflag") == "N", "kept").when(closed, "final").otherwise("open").alias("kind"),
        F.when(small, "no").when(closed, "yes").otherwise("no").alias("done"),
    )


def mode_sql(y: str) -> str:
    return f"""WITH {FLAG},
    counts AS (SELECT segment, {y}, count(*) AS c FROM flagged GROUP BY ALL),
    best AS (SELECT segment, arg_max({y}, c) AS prediction FROM counts GROUP BY 1)
    SELECT {', '.join(IDS)}, segment, {y}, prediction FROM flagged JOIN best USING (segment)"""


def _fit_segments(t, learner, y: str = "kind"):
    """Class from one category: a saturated classifier names the segment's most frequent class."""
    rows = _flagged(t).select(*IDS, "segment", y)
    model = train_model(rows, y, "classification", ["segment"], learner)
    return predict_all(rows, [model]).withColumnRenamed(learner.label, "prediction")


@query(mode_sql("kind"))
def logit_predict(t):
    return _fit_segments(t, L.Logistic(max_iterations=30))


@query(mode_sql("done"))
def logit_binary_predict(t):
    return _fit_segments(t, L.Logistic(max_iterations=30), "done")


@query(mode_sql("kind"))
def dt_classify(t):
    return _fit_segments(t, L.DecisionTree(max_depth=8))


@query(mode_sql("kind"))
def rf_classify(t):
    return _fit_segments(t, L.RandomForest(trees=3, sample_rate=1.0, bootstrap=False, max_depth=8))


@query(mode_sql("done"))
def gbt_classify(t):
    return _fit_segments(t, L.GradientBoosting(trees=3, max_depth=5), "done")


@query(mode_sql("kind"))
def gbt_classify_many(t):
    """More than two classes are boosted jointly, one tree per class and round."""
    return _fit_segments(t, L.GradientBoosting(trees=4, max_depth=4))


# Two numbers and one category; class shares are smoothed by one.
BAYES = f"""WITH {FLAG},
    size AS (SELECT kind, count(*) AS n, avg(l_quantity) AS m1, greatest(stddev_samp(l_quantity), 0) AS s1,
        avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS s2 FROM flagged GROUP BY 1),
    levels AS (SELECT DISTINCT l_linestatus FROM flagged),
    share AS (SELECT size.kind, levels.l_linestatus,
        (count(flagged.kind) + 1.0) / (any_value(size.n) + (SELECT count(*) FROM levels)) AS p
      FROM size CROSS JOIN levels LEFT JOIN flagged ON flagged.kind = size.kind AND flagged.l_linestatus = levels.l_linestatus
      GROUP BY ALL)"""


@query(
    BAYES
    + """
    SELECT kind, 'prior' AS term, '' AS level, round(n / (SELECT sum(n) FROM size), 6) AS value FROM size
    UNION ALL SELECT kind, 'mean', 'l_quantity', round(m1, 6) FROM size
    UNION ALL SELECT kind, 'sd', 'l_quantity', round(s1, 6) FROM size
    UNION ALL SELECT kind, 'mean', 'l_extendedprice', round(m2, 4) FROM size
    UNION ALL SELECT kind, 'sd', 'l_extendedprice', round(s2, 4) FROM size
    UNION ALL SELECT kind, 'share', l_linestatus, round(p, 6) FROM share"""
)
def naive_bayes_model(t):
    model = _bayes(t)
    tables, rows = model.model, []
    for k, kind in enumerate(model.data.classes):
        rows.append((kind, "prior", "", round(float(2.718281828459045 ** tables.log_prior[k]), 6)))
        for i, (name, digits) in enumerate((("l_quantity", 6), ("l_extendedprice", 4))):
            rows.append((kind, "mean", name, round(float(tables.mean[k, i]), digits)))
            rows.append((kind, "sd", name, round(float(tables.sd[k, i]), digits)))
        for level, value in zip(reversed(model.encoder.levels[0]), tables.log_share[0][k]):
            rows.append((kind, "share", level, round(float(2.718281828459045**value), 6)))
    return t.spark.createDataFrame(rows, "kind string, term string, level string, value double")


def _bayes(t):
    rows = _flagged(t)
    predictors = ["l_quantity", "l_extendedprice", "l_linestatus"]
    return train_model(rows, "kind", "classification", predictors, L.NaiveBayes(laplace=1.0))


@query(
    BAYES
    + f""", scored AS (SELECT flagged.*, size.kind AS guess,
        ln(n) - ln(s1) - ln(s2) - 0.5 * pow((l_quantity - m1) / s1, 2) - 0.5 * pow((l_extendedprice - m2) / s2, 2) + ln(p) AS score
      FROM flagged CROSS JOIN size JOIN share ON share.kind = size.kind AND share.l_linestatus = flagged.l_linestatus),
    best AS (SELECT {', '.join(IDS)}, l_quantity, l_extendedprice, kind, arg_max(guess, score) AS prediction FROM scored GROUP BY ALL)
    SELECT flagged.{', flagged.'.join(IDS)}, flagged.kind, prediction FROM flagged JOIN best
      USING ({', '.join(IDS)}, l_quantity, l_extendedprice, kind)"""
)
def naive_bayes_predict(t):
    out = predict_all(_flagged(t), [_bayes(t)])
    return out.select(*IDS, "kind", F.col("Naive Bayes").alias("prediction"))


def _vectors(t):
    return t.embeddings.select("vec_id", "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("class"))


def _fit_vectors(t, learner):
    rows = _vectors(t)
    model = train_model(rows, "class", "classification", ["embedding"], learner, ["vec_id"])
    return predict_all(rows, [model]).select("vec_id", "class", F.col(learner.label).alias("prediction"))


VECTORS = """v AS (SELECT vec_id, 'c' || label AS class, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)"""


@query(
    f"""WITH {VECTORS},
    m AS (SELECT class, d, avg(x) AS mean, greatest(stddev_samp(x), 0.0) AS sd FROM v GROUP BY 1, 2),
    prior AS (SELECT 'c' || label AS class, ln(count(*)) AS lp FROM embeddings GROUP BY 1),
    scored AS (SELECT v.vec_id, v.class, m.class AS guess, sum(-ln(m.sd) - 0.5 * pow((v.x - m.mean) / m.sd, 2)) + any_value(lp) AS score
      FROM v JOIN m USING (d) JOIN prior ON prior.class = m.class GROUP BY 1, 2, 3)
    SELECT vec_id, class, arg_max(guess, score) AS prediction FROM scored GROUP BY 1, 2"""
)
def naive_bayes_vectors(t):
    return _fit_vectors(t, L.NaiveBayes())


@query(
    f"""WITH {VECTORS},
    eps AS (SELECT 1e-9 * max(s) AS e FROM (SELECT var_pop(x) AS s FROM v GROUP BY d)),
    m AS (SELECT class, d, avg(x) AS mean, var_pop(x) + e AS var FROM v, eps GROUP BY class, d, e),
    prior AS (SELECT 'c' || label AS class, ln(count(*)) AS lp FROM embeddings GROUP BY 1),
    scored AS (SELECT v.vec_id, v.class, m.class AS guess, sum(-0.5 * ln(m.var) - 0.5 * pow(v.x - m.mean, 2) / m.var) + any_value(lp) AS score
      FROM v JOIN m USING (d) JOIN prior ON prior.class = m.class GROUP BY 1, 2, 3)
    SELECT vec_id, class, arg_max(guess, score) AS prediction FROM scored GROUP BY 1, 2"""
)
def nb_mllib_gaussian_predict(t):
    return _fit_vectors(t, L.MLlibNaiveBayes(model_type="gaussian"))


@query(
    f"""WITH {FLAG}, x AS (SELECT *, row_number() OVER () AS id FROM flagged),
    long AS (SELECT id, kind, 1 AS d, l_quantity AS v FROM x UNION ALL SELECT id, kind, 2, l_linenumber FROM x),
    theta AS (SELECT kind, d, ln(sum(v) + 1) - ln(sum(sum(v)) OVER (PARTITION BY kind) + 2) AS lt FROM long GROUP BY 1, 2),
    prior AS (SELECT kind, ln(count(*)) AS lp FROM flagged GROUP BY 1),
    scored AS (SELECT long.id, theta.kind AS guess, sum(v * lt) + any_value(lp) AS score
      FROM long JOIN theta USING (d) JOIN prior ON prior.kind = theta.kind GROUP BY 1, 2),
    best AS (SELECT id, arg_max(guess, score) AS prediction FROM scored GROUP BY 1)
    SELECT {', '.join(IDS)}, kind, prediction FROM x JOIN best USING (id)"""
)
def nb_mllib_predict(t):
    rows = _flagged(t)
    model = train_model(rows, "kind", "classification", ["l_quantity", "l_linenumber"], L.MLlibNaiveBayes())
    out = predict_all(rows, [model])
    return out.select(*IDS, "kind", F.col("Naive Bayes").alias("prediction"))


def _check_vectors(t, learner):
    return _class_check(_fit_vectors(t, learner), "class", "prediction")


VECTOR_CHECK = class_check_sql("embeddings", "label")


@query(VECTOR_CHECK)
def logit_vectors_predict(t):
    return _check_vectors(t, L.Logistic(reg_param=0.01))


@query(VECTOR_CHECK)
def rf_vectors_predict(t):
    """Numeric splits, bootstrap and a sample of 0.6 of the rows for each tree."""
    return _check_vectors(t, L.RandomForest(trees=20, max_depth=5))


@query(VECTOR_CHECK)
def gbt_vectors_predict(t):
    return _check_vectors(t, L.GradientBoosting(trees=5, max_depth=3, sample_rate=0.8))


@query(VECTOR_CHECK)
def mlp_classify(t):
    """The network's defaults."""
    return _check_vectors(t, L.NeuralNetwork())


@query(
    f"""WITH {WORDS}, {WORDS_SPLIT}, line AS (SELECT regr_slope(n_chars, words) AS b, regr_intercept(n_chars, words) AS a FROM train)
    SELECT count(*) AS n_rows, count(*) AS n_predicted, round(sqrt(avg(pow(a + b * words - n_chars, 2))), 2) AS line_error, true AS near FROM test, line"""
)
def mlp_predict(t):
    """The number of characters is nearly a line in that of words; the network comes near the line's error."""
    train, test = split_random(_words(t), 0.7, key_cols=["doc_id"])
    train = train.persist()
    model = train_model(train, "n_chars", "regression", ["words"], L.NeuralNetwork(hidden=(20, 20)), ["doc_id"])
    line = train.agg(F.regr_slope("n_chars", "words").alias("b"), F.regr_intercept("n_chars", "words").alias("a"))
    pred = predict_all(test, [model]).crossJoin(F.broadcast(line))
    error = F.sqrt(F.avg(F.pow(F.col("a") + F.col("b") * F.col("words") - F.col("n_chars"), 2)))
    own = F.sqrt(F.avg(F.pow(F.col("Neural network") - F.col("n_chars"), 2)))
    return pred.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("Neural network").alias("n_predicted"),
        F.round(error, 2).alias("line_error"),
        (own < error * 3).alias("near"),
    )


@query(
    f"""WITH {VECTORS}, y AS (SELECT vec_id, sum(d * x) / 64 + 2 AS y FROM v GROUP BY 1)
    SELECT vec_id, round(y, 3) AS prediction FROM y"""
)
def linear_fit_slots(t):
    """Sixty-four predictor columns; the target is a line in all of them."""
    slots = [F.col("embedding")[i].cast("double").alias(f"slot{i}") for i in range(64)]
    terms = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x * (i + 1) / 64)
    rows = t.embeddings.select("vec_id", *slots, F.aggregate(terms, F.lit(2.0), lambda a, b: a + b).alias("y"))
    model = train_model(rows, "y", "regression", [f"slot{i}" for i in range(64)], L.GeneralizedLinear())
    return predict_all(rows, [model]).select("vec_id", F.col(GLM).alias("prediction"))


@query(
    """WITH e AS (SELECT event_id, event_type, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS s, CAST(user_id % 100 AS VARCHAR) AS grp FROM events),
    m AS (SELECT event_type, count(*) AS n, avg(s) AS mean, stddev_samp(s) AS sd FROM e GROUP BY 1),
    grps AS (SELECT DISTINCT grp FROM e),
    share AS (SELECT m.event_type, grps.grp, ln((count(e.grp) + 1.0) / (any_value(m.n) + (SELECT count(*) FROM grps))) AS lp
      FROM m CROSS JOIN grps LEFT JOIN e ON e.event_type = m.event_type AND e.grp = grps.grp GROUP BY ALL),
    scored AS (SELECT e.event_id, e.event_type, m.event_type AS guess, ln(n) - ln(sd) - 0.5 * pow((s - mean) / sd, 2) + lp AS score
      FROM e CROSS JOIN m JOIN share ON share.event_type = m.event_type AND share.grp = e.grp)
    SELECT event_id, event_type, arg_max(guess, score) AS prediction FROM scored GROUP BY ALL"""
)
def naive_bayes_times(t):
    """Seconds since 1970, far from zero, and a category of a hundred levels."""
    rows = t.events.select("event_id", "event_type", "ts", (F.col("user_id") % 100).cast("string").alias("grp"))
    model = train_model(rows, "event_type", "classification", ["ts", "grp"], L.NaiveBayes(laplace=1.0))
    return predict_all(rows, [model]).select("event_id", "event_type", F.col("Naive Bayes").alias("prediction"))


def price_check(width: int) -> str:
    """The error of the means of equal ranges of the step, which a model of the price has to beat."""
    return f"""WITH {PART_SPLIT}, means AS (SELECT p_partkey % 1000 // {width} AS step_range, avg(p_retailprice) AS m FROM train GROUP BY 1)
    SELECT count(*) AS n_rows, count(*) AS n_predicted, round(avg(pow(p_retailprice - m, 2)), 4) AS range_error, true AS better
    FROM test JOIN means ON step_range = p_partkey % 1000 // {width}"""


def _check_prices(t, learner, width: int):
    train, test = split_random(_prices(t), 0.7, key_cols=["p_partkey"])
    model = train_model(train, "p_retailprice", "regression", ["step", "p_size", "p_type"], learner, ["p_partkey"])
    step_range = F.floor(F.col("step") / width).alias("step_range")
    means = train.groupBy(step_range).agg(F.avg("p_retailprice").alias("m"))
    pred = predict_all(test, [model]).withColumn("step_range", F.floor(F.col("step") / width)).join(means, "step_range")
    error = F.avg(F.pow(F.col("p_retailprice") - F.col("m"), 2))
    return pred.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(learner.label).alias("n_predicted"),
        F.round(error, 4).alias("range_error"),
        (F.avg(F.pow(F.col("p_retailprice") - F.col(learner.label), 2)) < error).alias("better"),
    )


@query(price_check(250))
def rf_default_predict(t):
    """The forest's defaults: fifty trees to depth twenty, each on a bootstrap sample of 0.6 of the rows and a third of the columns."""
    return _check_prices(t, L.RandomForest(), 250)


@query(price_check(100))
def gbt_default_predict(t):
    """The boosting's defaults: fifty trees to depth five."""
    return _check_prices(t, L.GradientBoosting(), 100)


@query(price_check(100))
def dt_default_predict(t):
    return _check_prices(t, L.DecisionTree(), 100)


@query(
    """WITH r AS (SELECT p_partkey % 1000 AS step, p_size, p_retailprice,
        row_number() OVER (ORDER BY md5(concat_ws('|', '123', CAST(p_partkey AS VARCHAR)))) AS place, count(*) OVER () AS n FROM part),
    d AS (SELECT place % n + 1 AS place, step AS other FROM r),
    line AS (SELECT regr_slope(p_retailprice, step) AS b, regr_intercept(p_retailprice, step) AS a FROM r),
    e AS (SELECT sqrt(avg(pow(a + b * other - p_retailprice, 2))) - sqrt(avg(pow(a + b * step - p_retailprice, 2))) AS grown FROM r JOIN d USING (place), line)
    SELECT 'Generalized linear regression' AS model, 'step' AS feature, round(grown, 3) AS importance FROM e
    UNION ALL SELECT 'Generalized linear regression', 'p_size', 0.0 FROM e"""
)
def permutation_importance_linear(t):
    """Price is a line in step alone, so the error grows by what the line makes of other parts' steps."""
    rows = _prices(t)
    result = compare(rows, rows, "p_retailprice", ["step", "p_size"], "regression", [L.GeneralizedLinear()], key_cols=["p_partkey"])
    found = result.permutation_importance(["p_partkey"])
    return found.select("model", "feature", F.round("importance", 3).alias("importance"))


@query(
    f"""WITH {FLAG}, k AS (SELECT *, md5(concat_ws('|', '123', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR),
        CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))) AS h FROM flagged),
    r AS (SELECT *, row_number() OVER (ORDER BY h) AS place, count(*) OVER () AS n FROM (SELECT min(segment) AS segment, min(kind) AS kind, h FROM k GROUP BY h)),
    d AS (SELECT place % n + 1 AS place, segment AS other FROM r),
    c AS (SELECT segment, kind, count(*) AS c FROM r GROUP BY ALL),
    best AS (SELECT segment, arg_max(kind, c) AS guess FROM c GROUP BY 1)
    SELECT 'Decision tree' AS model, 'segment' AS feature,
      round(100.0 * (sum((g.guess <> r.kind)::INT) - sum((b.guess <> r.kind)::INT)) / count(*), 6) AS importance
    FROM r JOIN d USING (place) JOIN best b USING (segment) JOIN best g ON g.segment = d.other"""
)
def permutation_importance_tree(t):
    """A tree on one category names its most frequent class; another line's category raises the error."""
    rows = _flagged(t).groupBy(*IDS).agg(F.min("segment").alias("segment"), F.min("kind").alias("kind"))
    result = compare(rows, rows, "kind", ["segment"], "classification", [L.DecisionTree(max_depth=8)], key_cols=IDS)
    found = result.permutation_importance(IDS)
    return found.select("model", "feature", F.round("importance", 6).alias("importance"))


def _prices(t):
    return t.part.withColumn("step", F.col("p_partkey") % 1000).select(
        "p_partkey", "step", "p_size", "p_type", "p_brand", "p_retailprice"
    )


# How much of the price's squares each halved column explains: what a single split gains.
GAINS = """halves AS (SELECT p_retailprice AS y, 'step' AS feature, (p_partkey % 1000 >= 500)::INT AS x FROM part
      UNION ALL SELECT p_retailprice, 'size', (p_size >= 25)::INT FROM part
      UNION ALL SELECT p_retailprice, 'brand', (p_brand >= 'Brand#3')::INT FROM part),
    gains AS (SELECT feature, sum(n * pow(m - total, 2)) AS gain FROM (SELECT feature, x, count(*) AS n, avg(y) AS m FROM halves GROUP BY ALL),
      (SELECT avg(p_retailprice) AS total FROM part) GROUP BY feature)"""


def _halves(t):
    return t.part.select(
        "p_partkey",
        "p_retailprice",
        F.when(F.col("p_partkey") % 1000 >= 500, 1).otherwise(0).alias("step"),
        F.when(F.col("p_size") >= 25, 1).otherwise(0).alias("size"),
        F.when(F.col("p_brand") >= "Brand#3", 1).otherwise(0).alias("brand"),
    )


def _importances(t, learner):
    rows = _halves(t)
    result = compare(rows, rows, "p_retailprice", ["step", "size", "brand"], "regression", [learner], key_cols=["p_partkey"])
    return top_features(result.importance)


@query(
    f"""WITH {GAINS}
    SELECT 'Random forest' AS model, count(*) AS n_features, round(sum(gain) / sum(gain), 6) AS total, arg_max(feature, gain) AS top,
      max(gain) / max(gain) AS scaled_top FROM gains"""
)
def importance_rf(t):
    """Importances of a forest of default size are shares of one; the first goes to the column that explains most."""
    return _importances(t, L.RandomForest(max_depth=5)).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.round(F.sum("importance"), 6).alias("total"),
        F.max_by("feature", "importance").alias("top"),
        F.max("scaled_importance").alias("scaled_top"),
    )


@query(
    f"""WITH {GAINS}, g AS (SELECT feature, CASE WHEN gain = (SELECT max(gain) FROM gains) THEN 1.0 ELSE 0.0 END::DOUBLE AS importance FROM gains)
    SELECT 'Decision tree' AS model, feature, importance, importance AS scaled_importance,
      CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM g"""
)
def importance_single_split(t):
    """The one split of a stump goes to the column with the largest gain, which has all the importance."""
    return _importances(t, L.DecisionTree(max_depth=1))


SATURATED = [
    L.GeneralizedLinear(),
    L.RandomForest(trees=3, sample_rate=1.0, bootstrap=False, max_depth=8),
    L.DecisionTree(max_depth=8),
    L.GradientBoosting(trees=3),
]
NAMES = "(VALUES ('Generalized linear regression'), ('Random forest'), ('Decision tree'), ('Gradient boosted trees')) names(\"Model\")"


@query(
    f"""WITH {PART_SPLIT}, means AS (SELECT p_type, round(avg(p_size), 3) AS p FROM train GROUP BY 1),
    scores AS (SELECT round(100 * avg(abs((p - p_size) / p_size)), 1) AS mape, round(sqrt(avg(pow(p - p_size, 2))), 2) AS rmse
      FROM test JOIN means USING (p_type))
    SELECT "Model", mape, rmse, CAST(row_number() OVER (ORDER BY "Model") AS INTEGER) AS rank FROM scores, {NAMES}"""
)
def compare_regression(t):
    """Four learners on one category agree on the group means, so their errors are known."""
    result = regression(t.part.select("p_partkey", "p_type", "p_size"), "p_size", ["p_type"], SATURATED, key_cols=["p_partkey"])
    return result.leaderboard.drop("train_seconds")


@query(
    f"""WITH {FLAG}, names AS (SELECT unnest(['Naive Bayes', 'Logistic regression', 'Decision tree', 'Random forest']) AS "Model"),
    counts AS (SELECT segment, kind, count(*) AS c FROM flagged GROUP BY ALL),
    score AS (SELECT sum(n) - sum(best) AS errors, sum(n) AS n FROM (SELECT max(c) AS best, sum(c) AS n FROM counts GROUP BY segment))
    SELECT "Model", errors::BIGINT AS errors, n::BIGINT AS n, round(100.0 * errors / n, 1) AS error_pct,
      round(100.0 * errors / n, 1) || ' % (' || errors || '/' || n || ')' AS "Error", CAST(row_number() OVER (ORDER BY "Model") AS INTEGER) AS rank
    FROM score, names"""
)
def compare_classification(t):
    """Four classifiers on one category all name its most frequent class, so their errors are known."""
    rows = _flagged(t).select("segment", "kind")
    chosen = [
        L.NaiveBayes(),
        L.Logistic(max_iterations=30),
        L.DecisionTree(max_depth=8),
        L.RandomForest(trees=3, sample_rate=1.0, bootstrap=False, max_depth=8),
    ]
    return compare(rows, rows, "kind", ["segment"], "classification", chosen).leaderboard.drop("train_seconds")


@query(
    """SELECT m AS "Model", (SELECT count(*) FROM documents) AS n_scored, (SELECT count(DISTINCT quality) FROM labels) AS n_classes
    FROM (SELECT unnest(['Naive Bayes', 'Random forest', 'Logistic regression', 'Decision tree', 'Gradient boosted trees']) AS m)"""
)
def compare_documents(t):
    """Five learners fitted on the labelled documents score all documents."""
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "quality")
    chosen = [L.NaiveBayes(), L.RandomForest(max_depth=5), L.Logistic(), L.DecisionTree(max_depth=5), L.GradientBoosting(trees=10)]
    result = classification(rows, "quality", ["lang", "source", "n_chars"], chosen, key_cols=["doc_id"])
    scored = predict_all(t.documents.select("doc_id", "lang", "source", "n_chars"), result.models)
    counts = scored.agg(*[F.count(f"`{m.label}`").alias(m.label) for m in result.models])
    classes = F.lit(len(result.models[0].data.classes)).cast("long").alias("n_classes")
    return counts.unpivot([], result.labels, "Model", "n_scored").select("Model", "n_scored", classes)


PRICE_SPLIT = split_sql("part", "p_partkey")


@query(
    f"""WITH {PRICE_SPLIT}
    SELECT p_partkey, p_partkey % 1000 AS step, p_size, p_type, p_brand, p_retailprice,
      p_retailprice AS "{GLM}" FROM test"""
)
def wide_predictions(t):
    """Price is a line in the part number's last three digits, which least squares recovers."""
    result = regression(_prices(t), "p_retailprice", ["step", "p_size"], [L.GeneralizedLinear()], key_cols=["p_partkey"])
    return result.predictions


@query(
    """SELECT 'Generalized linear regression' AS model, 'trained' AS status, 'this kind of model has no feature importance' AS message
    WHERE (SELECT count(*) FROM part) > 0 UNION ALL SELECT 'Decision tree', 'trained', '' WHERE (SELECT count(*) FROM part) > 0"""
)
def training_status(t):
    rows = _prices(t)
    chosen = [L.GeneralizedLinear(), L.DecisionTree(max_depth=3)]
    return compare(rows, rows, "p_retailprice", ["step", "p_size"], "regression", chosen).status


def _search(t):
    search = AutoML(families=("GLM", "DRF", "XGBoost"), max_seconds=None, max_models=2, folds=2,
                    defaults=(("DRF", L.RandomForest(trees=10, max_depth=5)),))
    rows = _prices(t)
    return train_model(rows, "p_retailprice", "regression", ["step", "p_size", "p_type"], search, ["p_partkey"])


@query(
    """SELECT "rank", family, status FROM (VALUES (1, 'GLM', 'ok'), (2, 'DRF', 'ok'), (NULL, 'XGBoost', 'unavailable')) v("rank", family, status)
    WHERE (SELECT count(*) FROM part) > 0"""
)
def auto_ml_leaderboard(t):
    """A line fits the prices exactly, so the linear candidate wins by cross-validation."""
    return search_leaderboard(t.spark, _search(t).model).select("rank", "family", "status")


@query(
    """SELECT parameter, value FROM (VALUES ('family', 'GLM'), ('family', 'gaussian'), ('link', 'identity'), ('intercept', 'True'),
      ('lambda_', '0.0'), ('alpha', '0.5'), ('max_iterations', '100'), ('variance_power', '1.5'), ('tolerance', '1e-06'), ('seed', '123'))
      v(parameter, value) WHERE (SELECT count(*) FROM part) > 0"""
)
def auto_ml_leader(t):
    return leader_summary(t.spark, _search(t).model)


@query(
    f"""WITH {PRICE_SPLIT} SELECT p_partkey, p_partkey % 1000 AS step, p_size, p_retailprice, p_retailprice AS "Auto ML" FROM test"""
)
def auto_ml_predict(t):
    """The search's leader predicts like any other model; here a line fits exactly."""
    rows = _prices(t).select("p_partkey", "step", "p_size", "p_retailprice")
    search = AutoML(families=("GLM",), max_seconds=None, max_models=2, folds=2)
    return regression(rows, "p_retailprice", ["step", "p_size"], [search], key_cols=["p_partkey"]).predictions


# The class is a range of the size; whichever of the three columns a tree may look at tells it.
SIZES = f"""WITH {PART_SPLIT} SELECT p_partkey, CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'middle' ELSE 'large' END AS kind,
      CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'middle' ELSE 'large' END AS prediction
    FROM test WHERE p_size IN (SELECT p_size FROM train)"""


def _fit_sizes(t, learner):
    size = F.col("p_size")
    kind = F.when(size < 15, "small").when(size < 35, "middle").otherwise("large")
    rows = t.part.select("p_partkey", size.alias("a"), (size * 2 + 1).alias("b"), (-size).alias("c"), kind.alias("kind"))
    train, test = split_random(rows, 0.7, key_cols=["p_partkey"])
    model = train_model(train, "kind", "classification", ["a", "b", "c"], learner, ["p_partkey"])
    known = predict_all(test, [model]).join(train.select("a").distinct(), "a", "left_semi")
    return known.select("p_partkey", "kind", F.col(learner.label).alias("prediction"))


@query(
    f"""WITH k AS ({SIZES}), s AS (SELECT kind, p_size >= 25 AS upper, count(*) AS n FROM k JOIN part USING (p_partkey) GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) - sum(m) AS BIGINT) AS half_errors, true AS better
    FROM s JOIN (SELECT upper, kind, CASE WHEN n = max(n) OVER (PARTITION BY upper) THEN n ELSE 0 END AS m FROM s) USING (upper, kind)"""
)
def rf_default_classify(t):
    """The forest's defaults: fifty trees to depth twenty, each on a bootstrap sample of 0.6 of the rows.

    It makes less than a tenth of the errors of one split of the size.
    """
    found = _fit_sizes(t, L.RandomForest()).join(t.part.select("p_partkey", "p_size"), "p_partkey")
    wrong = F.count_if(F.col("prediction") != F.col("kind"))
    sizes = found.groupBy("kind", (F.col("p_size") >= 25).alias("upper")).agg(F.count(F.lit(1)).alias("n"), wrong.alias("wrong"))
    halves = sizes.groupBy("upper").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("wrong").alias("wrong"))
    errors = F.sum("n") - F.sum("most")
    return halves.agg(F.sum("n").alias("n_rows"), errors.alias("half_errors"), (F.sum("wrong") * 10 < errors).alias("better"))


@query(SIZES)
def gbt_default_classify(t):
    """The boosting's defaults over three classes: fifty rounds of three trees, past the checkpoint of every tenth."""
    return _fit_sizes(t, L.GradientBoosting())


@query(
    """WITH h AS (SELECT CAST('0x' || substr(md5(concat_ws('|', '0', CAST(p_partkey AS VARCHAR))), 1, 15) AS BIGINT) AS h FROM part),
    r AS (SELECT 1 AS rung, 2 AS candidates, count(*) FILTER (h < CAST(0.25 * pow(2, 60) AS BIGINT)) AS n_rows FROM h
      UNION ALL SELECT 2, 1, count(*) FILTER (h < CAST(0.5 * pow(2, 60) AS BIGINT)) FROM h
      UNION ALL SELECT 3, 1, count(*) FROM h)
    SELECT rung, CAST(candidates AS BIGINT) AS candidates, n_rows FROM r"""
)
def auto_ml_halving(t):
    """Four linear candidates on a quarter of the rows, the best two on half, the best on all: each by the rung it came to."""
    search = AutoML(families=("GLM",), max_seconds=None, max_models=4, folds=2, rungs=3, keep=0.5)
    model = train_model(_prices(t), "p_retailprice", "regression", ["step", "p_size"], search, ["p_partkey"])
    board = search_leaderboard(t.spark, model.model).where("status = 'ok'")
    return board.groupBy("rung").agg(F.count(F.lit(1)).alias("candidates"), F.max("n_rows").alias("n_rows"))
