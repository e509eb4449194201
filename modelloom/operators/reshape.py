"""Row numbers, melting, unions and sorted reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelloom.functions import col, content_hash, field
from modelloom.session import ensure_checkpoint_dir

PARTITION_SHIFT = 33  # monotonically_increasing_id: partition number above bit 33, row number below


def with_counter(df: DataFrame, order_by: Sequence[str], name: str = "Counter") -> DataFrame:
    """Rows numbered from 1 in the given order, the number as first column.

    Rows equal in all sort columns follow a hash of their whole content, so the
    numbers are the same however the table is partitioned; rows equal in every column
    can take each other's numbers, which makes no difference, and are spread out. A range sort
    spreads the order over the cluster; it is checkpointed once, so
    that row positions hold, and each row's number is its position plus the rows
    of the partitions before it. No window runs over the whole table.
    """
    if not order_by:
        raise ValueError("order_by is needed: Spark tables have no row order of their own")
    for c in order_by:
        field(df, c)
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (
        df.withColumns({"__tie": content_hash(0, df.columns), "__apart": F.monotonically_increasing_id()})
        .orderBy(*[col(c) for c in order_by], "__tie", "__apart")
        .drop("__tie", "__apart")
        .withColumn("__at", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("__at", PARTITION_SHIFT)
    place = F.col("__at").bitwiseAND(F.lit((1 << PARTITION_SHIFT) - 1))
    sizes = sorted(ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row["part"], before))
        before += row["n"]
    starts = df.sparkSession.createDataFrame(offsets, "__part long, __before long")
    # One row per partition of the sort: at most the number of shuffle partitions.
    return (
        ordered.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .select((F.col("__before") + place + 1).alias(name), *[col(c) for c in df.columns])
    )


def melt_predictions(df: DataFrame, ids: Sequence[str], model_cols: Sequence[str], value: str = "Predicted_value") -> DataFrame:
    """Wide predictions to (ids, Model, value). Values take one common type."""
    for c in [*ids, *model_cols]:
        field(df, c)
    types = {df.schema[c].dataType.simpleString() for c in model_cols}
    if len(types) > 1:
        df = df.select(*[col(c) for c in ids], *[col(c).cast("string").alias(c) for c in model_cols])
    return df.unpivot([col(c) for c in ids], [col(c) for c in model_cols], "Model", value)


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns missing in one become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unique(df: DataFrame, name: str) -> DataFrame:
    field(df, name)
    return df.select(col(name)).distinct()


def top_features(importance: DataFrame, k: int | None = None) -> DataFrame:
    """Features of each model by falling importance, the first ``k`` if given."""
    # One row per model and feature: a report, so the window stays small.
    order = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    ranked = importance.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def prediction_curve(
    predictions: DataFrame,
    y: str,
    model_cols: Sequence[str],
    time_col: str | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Actual and predicted values along time, or along a row counter.

    Rows of one time are ordered by the values. Counted rows come out of the counter's own sort, so they are not sorted again.
    """
    lines = [y, *model_cols]
    if time_col is not None:
        # Equal times are spread by the values, so a frequent time is no hot sort range.
        return predictions.select(col(time_col), *[col(c) for c in lines]).orderBy(col(time_col), *[col(c) for c in lines])
    if not order_by:
        raise ValueError("give time_col, or order_by for the row counter")
    return with_counter(predictions, order_by).select("Counter", *[col(c) for c in lines])


def axis_bound(predictions: DataFrame, y: str) -> DataFrame:
    """Upper end of the value axis: one and a half times the largest target."""
    return predictions.agg((F.lit(1.5) * F.max(col(y))).alias("y_bound"))
