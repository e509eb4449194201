"""Sources, sinks, columns, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelloom.functions import to_category, to_number, without_percent
from modelloom.operators.encode import fit_encoder
from modelloom.operators.reshape import unique, with_counter
from modelloom.operators.schema import (
    clean_names,
    columns_first,
    describe_columns,
    dims,
    drop_columns,
    prepare,
    select_numeric,
    target_cardinality,
)
from modelloom.operators.split import between
from modelloom.queries.registry import query
from modelloom.session import shared_folder
from modelloom.sources import export, load_table, preview, stage

LINEITEM_CLASSES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"Variable\", '{t}' AS \"Class\", count({c}) AS n_values FROM lineitem"
        for c, t in LINEITEM_CLASSES.items()
    )
)
def column_classes_lineitem(t):
    return describe_columns(t.lineitem)


@query("SELECT count(*) AS n_rows, 6::BIGINT AS n_columns, count(*) || ' rows x 6 columns' AS label FROM orders")
def dataset_dims(t):
    return dims(t.orders)


@query(
    "SELECT (SELECT count(DISTINCT c) + max(CASE WHEN c IS NULL THEN 1 ELSE 0 END)"
    " FROM (SELECT nullif(l_returnflag, 'N') AS c FROM lineitem)) AS n_levels"
)
def target_cardinality_with_null(t):
    return target_cardinality(t.lineitem.select(F.nullif("l_returnflag", F.lit("N")).alias("flag")), "flag")


@query("SELECT DISTINCT l_returnflag FROM lineitem")
def target_levels(t):
    return unique(t.lineitem, "l_returnflag")


@query("SELECT s_suppkey AS supp_key, s_name AS name_of_supplier, s_acctbal AS acct_bal, s_nationkey FROM supplier")
def clean_column_names(t):
    dotted = t.supplier.select(
        F.col("s_suppkey").alias("supp.key"),
        F.col("s_name").alias("name.of.supplier"),
        F.col("s_acctbal").alias("acct.bal"),
        "s_nationkey",
    )
    return clean_names(dotted)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_projection_orders(t):
    return select_numeric(t.orders)


@query("SELECT o_totalprice, o_orderkey, o_orderstatus AS \"ACTUAL\", o_orderpriority FROM orders")
def reordered_projection_orders(t):
    kept = drop_columns(t.orders, ["o_custkey", "o_orderdate"])
    return columns_first(kept, ["o_totalprice"]).withColumnRenamed("o_orderstatus", "ACTUAL")


@query("SELECT l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def categorical_target(t):
    df, roles = prepare(t.lineitem, "l_linenumber", "classification", ["l_linestatus"])
    return df.groupBy(*roles.features, roles.y).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1998-02-28'"
    " AND o_orderstatus IN ('F', 'P')"
)
def range_and_membership_filter(t):
    return between(t.orders, "o_orderdate", "1997-03-01", "1998-02-28").filter(F.col("o_orderstatus").isin("F", "P"))


@query(
    """
    SELECT c_custkey,
      replace(c_name, '#', '_') AS name_clean,
      c_mktsegment || '-' || c_nationkey AS pasted,
      starts_with(c_mktsegment, 'M') AS starts_m,
      substr(c_mktsegment, 2, 3) AS part_of_name,
      CAST(length(c_name) AS INTEGER) AS n_chars,
      round(c_acctbal, 1) AS rounded,
      round(abs(c_acctbal), 0) AS size,
      round(sqrt(abs(c_acctbal)), 6) AS root,
      round(pow(c_acctbal, 2), 4) AS square,
      CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side,
      nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY' AS differs,
      nullif(c_mktsegment, 'BUILDING') IS NULL AS missing,
      CAST(replace(c_nationkey || '%', '%', '') AS DOUBLE) AS number,
      CAST(c_nationkey AS VARCHAR) AS category,
      TRY_CAST(c_name AS DOUBLE) AS no_number
    FROM customer"""
)
def scalar_expressions(t):
    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    gap = F.nullif(segment, F.lit("BUILDING"))
    return t.customer.select(
        "c_custkey",
        F.regexp_replace("c_name", "#", "_").alias("name_clean"),
        F.concat(segment, F.lit("-"), F.col("c_nationkey").cast("string")).alias("pasted"),
        F.startswith(segment, F.lit("M")).alias("starts_m"),
        F.substring(segment, 2, 3).alias("part_of_name"),
        F.length("c_name").alias("n_chars"),
        F.round(balance, 1).alias("rounded"),
        F.round(F.abs(balance), 0).alias("size"),
        F.round(F.sqrt(F.abs(balance)), 6).alias("root"),
        F.round(F.pow(balance, F.lit(2)), 4).alias("square"),
        F.when(balance < 0, "debt").otherwise("credit").alias("side"),
        (gap != "MACHINERY").alias("differs"),
        gap.isNull().alias("missing"),
        to_number(without_percent(F.concat(F.col("c_nationkey").cast("string"), F.lit("%")))).alias("number"),
        to_category(F.col("c_nationkey")).alias("category"),
        to_number(F.col("c_name")).alias("no_number"),
    )


@query(
    "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, round(100.0 * sum(CASE WHEN o_orderstatus = 'F'"
    " THEN 1 ELSE 0 END) / count(*), 1) AS share_pct FROM orders GROUP BY 1"
)
def daily_share(t):
    late = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return (
        t.orders.groupBy(F.to_date("o_orderdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), late.alias("k"))
        .select("day", "n", F.round(F.lit(100.0) * F.col("k") / F.col("n"), 1).alias("share_pct"))
    )


@query("SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 30")
def preview_page(t):
    return preview(t.orders, 3, ["o_totalprice", "o_orderkey"])


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS \"Counter\", o_totalprice, o_orderkey FROM orders")
def row_counter(t):
    return with_counter(t.orders.select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"])


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def staged_table(t):
    staged = stage(t.lineitem, ["l_returnflag", "l_quantity"], view="staged_lineitem")
    return staged.sparkSession.sql(
        "SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity FROM staged_lineitem GROUP BY l_returnflag"
    )


def _round_trip(t, fmt: str):
    path = shared_folder(t.spark) + f"/customer_{fmt}"
    export(t.customer, path, fmt)
    return load_table(t.spark, path, fmt, schema=t.customer.schema)


@query("SELECT * FROM customer")
def export_csv(t):
    return _round_trip(t, "csv")


@query("SELECT * FROM customer")
def export_json(t):
    return _round_trip(t, "json")


@query("SELECT * FROM customer")
def export_orc(t):
    return _round_trip(t, "orc")


@query("SELECT * FROM customer")
def export_parquet(t):
    return _round_trip(t, "parquet")


@query(
    """
    SELECT c_custkey, c_acctbal AS slot_0,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slot_1,
      CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slot_2,
      CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slot_3,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slot_4
    FROM customer"""
)
def encoded_features(t):
    from pyspark.ml.functions import vector_to_array

    encoder, _ = fit_encoder(t.customer, ["c_acctbal", "c_mktsegment"])
    rows = encoder.transform(t.customer).withColumn("v", vector_to_array(encoder.linear))
    return rows.select("c_custkey", *[F.col("v")[i].alias(f"slot_{i}") for i in range(len(encoder.linear_names))])
