"""Categories with many levels as numbers, and models on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelloom import learners as L
from modelloom.learners.base import predict_all, train_model
from modelloom.operators.levels import fit_levels
from modelloom.operators.split import split_random
from modelloom.queries.registry import query, split_sql

KEY = ["l_orderkey", "l_linenumber"]
KEY_TEXT = "CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)"
FOLD = f"CAST('0x' || substr(md5(concat_ws('|', '123', {KEY_TEXT})), 1, 8) AS BIGINT) % 5"
LEVELS = f"""
    r AS (SELECT *, {FOLD} AS fold FROM lineitem),
    a AS (SELECT count(*) AS total, avg(l_quantity) AS prior FROM r),
    f AS (SELECT l_partkey, fold, count(*) AS n, sum(l_quantity) AS s FROM r GROUP BY ALL),
    g AS (SELECT l_partkey, sum(n) AS n, sum(s) AS s FROM f GROUP BY ALL)"""


def _items(t):
    return t.lineitem.select(*KEY, "l_partkey", "l_quantity", "l_returnflag")


@query(
    f"""WITH {LEVELS}
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round((g.n - f.n) / total, 9) AS l_partkey_freq,
      round(CASE WHEN g.n > f.n THEN (g.s - f.s + 10 * prior) / (g.n - f.n + 10) ELSE prior END, 6) AS l_partkey_mean
    FROM r JOIN f USING (l_partkey, fold) JOIN g USING (l_partkey), a"""
)
def target_encoded_fitting(t):
    """Every line by the other folds' quantities of its part."""
    rows = _items(t).drop("l_returnflag")
    encoded = fit_levels(rows, ["l_partkey"], "l_quantity", KEY).encode(rows, fitting=True)
    return encoded.withColumns({"l_partkey_freq": F.round("l_partkey_freq", 9), "l_partkey_mean": F.round("l_partkey_mean", 6)})


@query(
    """WITH a AS (SELECT count(*) AS total FROM lineitem),
    p AS (SELECT avg((l_returnflag = 'N')::INT) AS pn, avg((l_returnflag = 'R')::INT) AS pr FROM lineitem),
    g AS (SELECT l_partkey, count(*) AS n, sum((l_returnflag = 'N')::INT) AS sn, sum((l_returnflag = 'R')::INT) AS sr FROM lineitem GROUP BY ALL)
    SELECT p_partkey AS l_partkey, round(coalesce(n, 0) / total, 9) AS l_partkey_freq,
      round(CASE WHEN n > 0 THEN (sn + 2 * pn) / (n + 2) ELSE pn END, 6) AS "l_partkey_share_N",
      round(CASE WHEN n > 0 THEN (sr + 2 * pr) / (n + 2) ELSE pr END, 6) AS "l_partkey_share_R"
    FROM part LEFT JOIN g ON p_partkey = g.l_partkey, a, p"""
)
def target_encoded_classes(t):
    """Shares of return flags by part, applied to all parts, sold or not."""
    table = fit_levels(_items(t), ["l_partkey"], "l_returnflag", KEY, classes=["A", "N", "R"], smoothing=2)
    encoded = table.encode(t.part.select(F.col("p_partkey").alias("l_partkey")))
    digits = {c: F.round(c, 9 if c.endswith("freq") else 6) for c in table.encoded_names}
    return encoded.withColumns(digits)



@query(
    f"""WITH {split_sql("orders", "o_orderkey")},
    k AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '123', CAST(o_orderkey AS VARCHAR))), 1, 8) AS BIGINT) % 5 AS fold FROM train),
    a AS (SELECT avg(o_totalprice) AS prior FROM k),
    f AS (SELECT o_custkey, fold, count(*) AS n, sum(o_totalprice) AS s FROM k GROUP BY ALL),
    g AS (SELECT o_custkey, sum(n) AS n, sum(s) AS s FROM f GROUP BY ALL),
    e AS (SELECT o_totalprice AS y, CASE WHEN g.n > f.n THEN (g.s - f.s + 10 * prior) / (g.n - f.n + 10) ELSE prior END AS x
      FROM k JOIN f USING (o_custkey, fold) JOIN g USING (o_custkey), a),
    line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM e)
    SELECT o_orderkey, o_custkey, o_totalprice, round(round(c + b * (CASE WHEN g.n > 0 THEN (g.s + 10 * prior) / (g.n + 10) ELSE prior END), 3), 1) AS prediction
    FROM test LEFT JOIN g USING (o_custkey), a, line"""
)
def linear_fit_customers(t):
    """Order prices by customer, one level each: the line over out-of-fold means, applied to the others."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    train, test = split_random(rows, 0.7, key_cols=["o_orderkey"])
    table = fit_levels(train, ["o_custkey"], "o_totalprice", ["o_orderkey"])
    model = train_model(table.encode(train, fitting=True), "o_totalprice", "regression", ["o_custkey_mean"], L.GeneralizedLinear())
    found = predict_all(table.encode(test), [model]).withColumnRenamed(model.label, "prediction")
    return found.select("o_orderkey", "o_custkey", "o_totalprice", F.round("prediction", 1).alias("prediction"))
