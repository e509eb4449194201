"""Error measures, confusion matrices and leaderboards over predictions that SQL can make too."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelloom.operators import metrics
from modelloom.operators.reshape import melt_predictions, stack, top_features
from modelloom.queries.registry import query

SIZES = ["Type mean", "Constant", "Gappy"]
# Two predictors of the part size, and one that leaves rows without prediction.
# The target is lowered by one, so that some targets are zero.
SIZE_SQL = """
    WITH p AS (
      SELECT p_partkey, (p_size - 1)::DOUBLE AS size,
        round(avg(p_size - 1) OVER (PARTITION BY p_type), 3) AS "Type mean", 20.0::DOUBLE AS "Constant",
        CASE WHEN p_type <> 'PROMO' THEN (p_size - 1)::DOUBLE * 1.25 END AS "Gappy"
      FROM part),
    long AS (UNPIVOT p ON "Type mean", "Constant", "Gappy" INTO NAME "Model" VALUE v),
    every AS (SELECT m."Model", p.size, long.v FROM p CROSS JOIN (VALUES ('Type mean'), ('Constant'), ('Gappy')) m("Model")
      LEFT JOIN long ON long.p_partkey = p.p_partkey AND long."Model" = m."Model"),
    scores AS (
      SELECT "Model",
        round(100 * avg(CASE WHEN v IS NULL THEN NULL WHEN size <> 0 THEN abs((v - size) / size) WHEN v <> size THEN 'inf'::DOUBLE END), 1) AS mape,
        CASE WHEN count(v) = count(*) THEN round(sqrt(avg(pow(v - size, 2))), 2) END AS rmse,
        round(100 * avg(CASE WHEN size <> 0 THEN abs((v - size) / size) END), 1) AS mape_skip,
        round(sqrt(avg(pow(v - size, 2))), 2) AS rmse_skip
      FROM every GROUP BY "Model")
"""


def _sizes(t):
    parts = t.part.withColumn("size", (F.col("p_size") - 1).cast("double"))
    means = parts.groupBy("p_type").agg(F.round(F.avg("size"), 3).alias("Type mean"))
    return (
        parts.join(means, "p_type")
        .withColumn("Constant", F.lit(20.0))
        .withColumn("Gappy", F.when(F.col("p_type") != "PROMO", F.col("size") * 1.25))
    )


@query(SIZE_SQL + 'SELECT "Model", mape, rmse FROM scores')
def regression_metrics_zero_targets(t):
    return metrics.regression_metrics(_sizes(t), "size", SIZES)


@query(SIZE_SQL + 'SELECT "Model", mape_skip AS mape, rmse_skip AS rmse FROM scores')
def regression_metrics_skip(t):
    return metrics.regression_metrics(_sizes(t), "size", SIZES, zero_policy="skip", null_policy="skip")


@query(
    SIZE_SQL
    + 'SELECT "Model", mape_skip AS mape, rmse_skip AS rmse, CAST(row_number() OVER (ORDER BY mape_skip, "Model") AS INTEGER) AS rank FROM scores'
)
def regression_leaderboard(t):
    scores = metrics.regression_metrics(_sizes(t), "size", SIZES, zero_policy="skip", null_policy="skip")
    return metrics.leaderboard(scores, None, "mape")


@query('SELECT p_partkey, size, "Model", v AS "Predicted_value" FROM (' + SIZE_SQL.replace("WITH p AS", "WITH p AS", 1)
       + 'SELECT p.p_partkey, p.size, m."Model", long.v FROM p CROSS JOIN (VALUES (\'Type mean\'), (\'Constant\'), (\'Gappy\')) m("Model")'
         ' LEFT JOIN long ON long.p_partkey = p.p_partkey AND long."Model" = m."Model")')
def melted_predictions(t):
    return melt_predictions(_sizes(t), ["p_partkey", "size"], SIZES)


FLAGS = ["By status", "Always A", "Gappy"]
FLAG_SQL = """
    WITH p AS (
      SELECT l_returnflag AS y, CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END AS a, 'A' AS b,
        CASE WHEN l_tax > 0.01 THEN l_returnflag END AS c FROM lineitem),
    long AS (SELECT 'By status' AS "Model", y, a AS v FROM p UNION ALL SELECT 'Always A', y, b FROM p UNION ALL SELECT 'Gappy', y, c FROM p),
    scores AS (SELECT "Model", count(CASE WHEN v <> y THEN 1 END) AS errors, count(*) AS n,
      round(100.0 * count(CASE WHEN v <> y THEN 1 END) / count(*), 1) AS error_pct FROM long GROUP BY 1),
    times AS (SELECT 'By status' AS "Model", round(sum(l_tax), 1) AS train_seconds FROM lineitem
      UNION ALL SELECT 'Gappy', round(sum(l_discount), 1) FROM lineitem)
"""


def _flags(t):
    return t.lineitem.select(
        "l_returnflag",
        F.when(F.col("l_linestatus") == "F", "R").otherwise("N").alias("By status"),
        F.lit("A").alias("Always A"),
        F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).alias("Gappy"),
    )


@query(FLAG_SQL + "SELECT *, error_pct || ' % (' || errors || '/' || n || ')' AS \"Error\" FROM scores")
def error_rates(t):
    return metrics.classification_metrics(_flags(t), "l_returnflag", FLAGS)


@query(FLAG_SQL + 'SELECT "Model", y AS "ACTUAL", v AS "PREDICTED", count(*) AS "Freq" FROM long GROUP BY ALL')
def confusion_matrix(t):
    return metrics.confusion_matrix(_flags(t), "l_returnflag", FLAGS)


@query(
    FLAG_SQL
    + """, cells AS (SELECT "Model", y, v FROM (SELECT DISTINCT "Model" FROM long), (SELECT DISTINCT y FROM p), (SELECT DISTINCT y AS v FROM p))
    SELECT cells."Model", cells.y AS "ACTUAL", cells.v AS "PREDICTED", count(long.y) AS "Freq"
    FROM cells LEFT JOIN long ON long."Model" = cells."Model" AND long.y = cells.y AND long.v = cells.v GROUP BY ALL"""
)
def confusion_matrix_dense(t):
    return metrics.confusion_matrix(_flags(t), "l_returnflag", ["By status", "Always A", "Gappy"], dense=True).filter(
        "PREDICTED IS NOT NULL"
    )


@query(
    FLAG_SQL
    + """SELECT "Model", errors, n, error_pct, error_pct || ' % (' || errors || '/' || n || ')' AS "Error", train_seconds,
      CAST(row_number() OVER (ORDER BY error_pct, "Model") AS INTEGER) AS rank FROM scores JOIN times USING ("Model")"""
)
def metrics_join_times(t):
    """A model without a training time drops out of the board."""
    times = stack(
        t.lineitem.agg(F.round(F.sum("l_tax"), 1).alias("train_seconds")).select(F.lit("By status").alias("Model"), "*"),
        t.lineitem.agg(F.round(F.sum("l_discount"), 1).alias("train_seconds")).select(F.lit("Gappy").alias("Model"), "*"),
    )
    return metrics.leaderboard(metrics.classification_metrics(_flags(t), "l_returnflag", FLAGS), times, "error_pct")


@query(
    """
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM (
      SELECT p_type AS model, p_brand AS feature, round(avg(p_size), 6) AS importance FROM part GROUP BY ALL)) WHERE rank <= 5"""
)
def top_features_by_model(t):
    table = t.part.groupBy(F.col("p_type").alias("model"), F.col("p_brand").alias("feature")).agg(
        F.round(F.avg("p_size"), 6).alias("importance")
    )
    return top_features(table, 5)


@query(
    """
    SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, NULL AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier"""
)
def stacked_tables(t):
    return stack(
        t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")),
    )
