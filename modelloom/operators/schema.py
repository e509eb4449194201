"""Column names, column roles and checks of the target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.functions import col, field, is_numeric, is_time, to_category

TASKS = ("regression", "classification")


def clean_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores; two names may not fall together."""
    names = [clean_name(c) for c in df.columns]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"replacing '.' by '_' makes column names collide: {doubled}")
    return df.toDF(*names)


def clean_name(name: str) -> str:
    return name.replace(".", "_")


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_time(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df)])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    for name in names:
        field(df, name)
    return df.select(*[col(c) for c in df.columns if c not in set(names)])


def columns_first(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in front, the others after them in their old order."""
    for name in names:
        field(df, name)
    rest = [c for c in df.columns if c not in set(names)]
    return df.select(*[col(c) for c in [*names, *rest]])


def require_numeric(df: DataFrame, name: str) -> None:
    dtype = field(df, name).dataType
    if not is_numeric(dtype):
        raise TypeError(f"column {name!r} is {dtype.simpleString()}; a numeric column is needed")


def target_levels_at_least_two(df: DataFrame, y: str) -> bool:
    """Stops reading for more levels as soon as two are seen; NULL counts as a level."""
    return df.select(col(y)).distinct().limit(2).count() == 2


def target_cardinality(df: DataFrame, y: str) -> DataFrame:
    """Number of distinct target values, NULL counted as one value."""
    field(df, y)
    # Two grouped steps: the first removes repeats before the shuffle, so a
    # value held by a third of the rows costs one row per task.
    levels = df.groupBy(col(y).alias("level")).agg(F.lit(1).alias("one"))
    return levels.agg(F.count("one").alias("n_levels"))


def describe_columns(df: DataFrame) -> DataFrame:
    """One row per column: name, class, number of values present."""
    counts = df.agg(
        *[F.count(col(f.name)).alias(f"n{i}") for i, f in enumerate(df.schema)]
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("Variable"),
            F.lit(f.dataType.simpleString()).alias("Class"),
            F.col(f"n{i}").alias("n_values"),
        )
        for i, f in enumerate(df.schema)
    ]
    return counts.select(F.inline(F.array(*rows)))


def dims(df: DataFrame) -> DataFrame:
    """Rows, columns and the text 'R rows x C columns'."""
    n_cols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(n_cols).cast("long").alias("n_columns"),
        F.concat(F.col("n_rows").cast("string"), F.lit(f" rows x {n_cols} columns")).alias("label"),
    )


@dataclass(frozen=True)
class Roles:
    """What each column of a prepared table is used for."""

    task: str
    y: str
    candidates: list[str]
    features: list[str]
    time_col: str | None


def prepare(
    df: DataFrame,
    y: str,
    task: str,
    features: Sequence[str] | None = None,
    time_col: str | None = "auto",
    max_rows: int | None = None,
) -> tuple[DataFrame, Roles]:
    """Clean names, check the target and settle predictors and time column.

    ``time_col='auto'`` takes the first date or timestamp column if there is one;
    None switches time mode off. Predictors default to every other column that
    is no time column. ``max_rows`` is an optional guard; there is none by default.
    """
    if task not in TASKS:
        raise ValueError(f"task must be one of {TASKS}, not {task!r}")
    df, y = clean_names(df), clean_name(y)
    field(df, y)
    if task == "regression":
        require_numeric(df, y)
    else:
        df = df.withColumn(y, to_category(col(y)))
        if not target_levels_at_least_two(df, y):
            raise ValueError(f"target {y!r} needs at least two different values")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"the table has more than {max_rows} rows")
    times = time_columns(df)
    if time_col == "auto":
        time_col = times[0] if times else None
    elif time_col is not None:
        time_col = clean_name(time_col)
        if time_col not in times:
            raise ValueError(f"{time_col!r} is no date or timestamp column; those are {times}")
    candidates = [c for c in df.columns if c != y]
    if features is None:
        chosen = [c for c in candidates if c not in times]
    else:
        chosen = [clean_name(c) for c in features]
        for name in chosen:
            field(df, name)
        if y in chosen:
            raise ValueError(f"target {y!r} cannot be a predictor")
    if not chosen:
        raise ValueError("no predictor selected")
    return df, Roles(task, y, candidates, chosen, time_col)
