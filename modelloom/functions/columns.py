"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
MICROS_PER_DAY = 86_400_000_000


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, name: str) -> T.StructField:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}; columns are {df.columns}")
    return df.schema[name]


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, TIME_TYPES)


def without_percent(value: Column) -> Column:
    """'70%' -> '70'."""
    return F.regexp_replace(value, "%", "")


def to_number(value: Column) -> Column:
    """Text or number as double; text that is no number becomes NULL."""
    return value.cast("string").try_cast("double")


def to_category(value: Column) -> Column:
    return value.cast("string")


def like_column(df: DataFrame, name: str, value) -> Column:
    """``value`` as a constant of the column's own type.

    The constant is cast, never the column, so comparisons reach the file scan.
    """
    return F.lit(str(value)).cast(field(df, name).dataType)


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a date or timestamp column.

    Zone-free timestamps are taken field by field, so that the session zone and
    its daylight-saving gaps play no part.
    """
    dtype = field(df, name).dataType
    c = col(name)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    days = F.unix_date(c.cast("date")).cast("long") * F.lit(MICROS_PER_DAY)
    if isinstance(dtype, T.DateType):
        return days
    if not isinstance(dtype, T.TimestampNTZType):
        raise TypeError(f"column {name!r} is {dtype.simpleString()}, not a date or timestamp")
    seconds = F.hour(c) * F.lit(3600) + F.minute(c) * F.lit(60)
    fraction = (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long")
    return days + seconds.cast("long") * F.lit(1_000_000) + fraction


def content_hash(seed: int, names: Sequence[str]) -> Column:
    """md5 over the seed and the key columns: the rank key of random splits.

    It depends on the row's content only, never on partitioning. A separator within
    a value is escaped and NULL differs from every text, so different keys never
    look alike.
    """
    parts = [F.lit(str(seed))]
    for n in names:
        text = F.replace(F.replace(col(n).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        parts.append(F.coalesce(text, F.lit("\\N")))
    return F.md5(F.concat_ws("|", *parts))


def absolute_percentage_error(pred: Column, actual: Column, zero_policy: str = "inf") -> Column:
    """|pred - actual| / |actual|.

    A zero target gives infinity for a wrong prediction and NULL (left out of
    averages) for an exact one; ``zero_policy='skip'`` leaves both out.
    """
    if zero_policy not in ("inf", "skip"):
        raise ValueError("zero_policy must be 'inf' or 'skip'")
    ratio = F.when(actual != 0, F.abs((pred - actual) / F.nullif(actual, F.lit(0.0))))
    if zero_policy == "inf":
        ratio = ratio.when(pred != actual, F.lit(float("inf")))
    return F.when(~F.isnan(ratio), ratio)


def error_label(errors: Column, rows: Column) -> Column:
    """Display text such as '12.3 % (45/366)'."""
    return F.concat(
        F.round(F.lit(100.0) * errors / rows, 1).cast("string"),
        F.lit(" % ("),
        errors.cast("string"),
        F.lit("/"),
        rows.cast("string"),
        F.lit(")"),
    )
