"""Reading, staging, paging and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelloom.functions import col, field

FORMATS = ("parquet", "orc", "json", "csv")


def load_table(spark: SparkSession, source, fmt: str | None = None, schema=None, **options) -> DataFrame:
    """A table from a path, a catalog name or an in-memory object.

    Paths are recognised by a slash; their format comes from ``fmt`` or the file
    ending (parquet if neither tells). Give ``schema`` for csv and json, so that
    the files are not read an extra time to guess it.
    """
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        return spark.createDataFrame(source, schema=schema)
    if "/" not in source and fmt is None:
        return spark.table(source)
    if fmt is None:
        ending = source.rstrip("/").rsplit(".", 1)[-1].lower()
        fmt = ending if ending in FORMATS else "parquet"
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    reader = spark.read.options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", True))
        if schema is None:
            reader = reader.option("inferSchema", options.get("inferSchema", True))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(source)


def stage(df: DataFrame, columns: Sequence[str] | None = None, view: str | None = None) -> DataFrame:
    """Keep the needed columns cached for several passes, optionally under a view name."""
    if columns is not None:
        for name in columns:
            field(df, name)
        df = df.select(*[col(c) for c in columns])
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if view:
        df.createOrReplaceTempView(view)
    return df


def preview(df: DataFrame, page: int, order_by: Sequence[str], size: int = 10, after: Sequence | None = None) -> DataFrame:
    """Page ``page`` (from 0) of the table in the given order.

    A far page is better asked for by ``after``, the ``order_by`` values of the last row
    seen: then pages count from there, and only what lies beyond is looked at.
    """
    if page < 0 or size < 1:
        raise ValueError("page must be >= 0 and size >= 1")
    if not order_by:
        raise ValueError("order_by is needed: Spark tables have no row order of their own")
    if after is not None:
        if len(after) != len(order_by):
            raise ValueError(f"after needs {len(order_by)} values")
        beyond, same = F.lit(False), F.lit(True)
        for name, value in zip(order_by, after):
            bound = F.lit(value).cast(df.schema[name].dataType)
            # NULL sorts first.
            larger = col(name).isNotNull() if value is None else col(name) > bound
            beyond = beyond | (same & F.coalesce(larger, F.lit(False)))
            same = same & col(name).eqNullSafe(bound)
        df = df.filter(beyond)
    return df.orderBy(*[col(c) for c in order_by]).offset(page * size).limit(size)


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> str:
    """Write a report or a prediction table as a folder of part files."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path
