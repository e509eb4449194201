"""Errors of many models at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelloom.functions import absolute_percentage_error, col, error_label, field
from modelloom.operators.reshape import melt_predictions

METRIC_COLUMN = {"regression": "mape", "classification": "error_pct"}


def regression_metrics(
    pred: DataFrame,
    y: str,
    model_cols: Sequence[str],
    zero_policy: str = "inf",
    null_policy: str = "propagate",
) -> DataFrame:
    """(Model, mape, rmse) for all models in one pass.

    MAPE, in percent to one decimal, leaves out rows without prediction. RMSE, to
    two decimals, becomes NULL when any row lacks one, unless ``null_policy`` is
    'skip'. All models share one row of partial sums per task.
    """
    if null_policy not in ("propagate", "skip"):
        raise ValueError("null_policy must be 'propagate' or 'skip'")
    actual = col(y).cast("double")
    sums = []
    for i, name in enumerate(model_cols):
        field(pred, name)
        p = col(name).cast("double")
        square = (p - actual) * (p - actual)
        sums += [
            F.avg(absolute_percentage_error(p, actual, zero_policy)).alias(f"ape{i}"),
            F.avg(square).alias(f"sq{i}"),
            F.count(square).alias(f"n{i}"),
        ]
    row = pred.agg(F.count(F.lit(1)).alias("rows"), *sums)
    lines = []
    for i, name in enumerate(model_cols):
        rmse = F.round(F.sqrt(F.col(f"sq{i}")), 2)
        if null_policy == "propagate":
            rmse = F.when(F.col(f"n{i}") == F.col("rows"), rmse)
        lines.append(
            F.struct(
                F.lit(name).alias("Model"),
                F.round(F.lit(100.0) * F.col(f"ape{i}"), 1).alias("mape"),
                rmse.alias("rmse"),
            )
        )
    return row.select(F.inline(F.array(*lines)))


def classification_metrics(pred: DataFrame, y: str, model_cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """(Model, errors, n, error_pct, Error) for all models in one pass.

    Rows without prediction or target count in ``n`` but not as errors. With the column
    ``weight`` each row stands for that many equal ones.
    """
    rows = F.lit(1) if weight is None else col(weight)
    sums = []
    for i, name in enumerate(model_cols):
        field(pred, name)
        wrong = F.when(col(name) != col(y), rows).otherwise(0)
        sums.append(F.coalesce(F.sum(wrong), F.lit(0)).cast("long").alias(f"e{i}"))
    row = pred.agg(F.coalesce(F.sum(rows), F.lit(0)).cast("long").alias("n"), *sums)
    lines = [
        F.struct(
            F.lit(name).alias("Model"),
            F.col(f"e{i}").alias("errors"),
            F.col("n"),
            F.when(F.col("n") > 0, F.round(F.lit(100.0) * F.col(f"e{i}") / F.nullif(F.col("n"), F.lit(0)), 1)).alias("error_pct"),
            F.when(F.col("n") > 0, error_label(F.col(f"e{i}"), F.nullif(F.col("n"), F.lit(0)))).alias("Error"),
        )
        for i, name in enumerate(model_cols)
    ]
    return row.select(F.inline(F.array(*lines)))


def confusion_matrix(pred: DataFrame, y: str, model_cols: Sequence[str], dense: bool = False) -> DataFrame:
    """(Model, ACTUAL, PREDICTED, Freq); ``dense`` adds the cells that never occur."""
    long = melt_predictions(
        pred.select(col(y).cast("string").alias("ACTUAL"), *[col(c).cast("string").alias(c) for c in model_cols]),
        ["ACTUAL"],
        model_cols,
        "PREDICTED",
    )
    counts = long.groupBy("Model", "ACTUAL", "PREDICTED").agg(F.count(F.lit(1)).alias("Freq"))
    if not dense:
        return counts
    # Every pair of class names, made on the executors: as large as the matrix asked for.
    names = [counts.select(F.col(c).alias("level")) for c in ("ACTUAL", "PREDICTED")]
    levels = names[0].union(names[1]).filter("level IS NOT NULL").distinct()
    cells = levels.withColumnRenamed("level", "ACTUAL").crossJoin(levels.withColumnRenamed("level", "PREDICTED"))
    cells = cells.select(F.explode(F.lit(list(model_cols))).alias("Model"), "ACTUAL", "PREDICTED", F.lit(0).cast("long").alias("Freq"))
    return counts.unionByName(cells).groupBy("Model", "ACTUAL", "PREDICTED").agg(F.sum("Freq").alias("Freq"))


def leaderboard(metrics: DataFrame, times: DataFrame | None, sort_by: str) -> DataFrame:
    """Metrics joined with training times, best model first.

    Both sides hold one row per model. A model without a time drops out, as it
    has not been trained; ``times=None`` ranks the metrics alone.
    """
    field(metrics, sort_by)
    board = metrics if times is None else metrics.join(times, "Model", "inner")
    order = Window.orderBy(F.asc_nulls_last(sort_by), "Model")
    return board.withColumn("rank", F.row_number().over(order)).orderBy("rank")
