"""Random and chronological splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelloom.operators.split import complement, split_counts, split_random, split_time, time_bounds
from modelloom.queries.registry import query, split_sql

ORDERS_SPLIT = split_sql("orders", "o_orderkey")
HASH = "md5(concat_ws('|', '123', CAST(o_orderkey AS VARCHAR)))"


@query(f"WITH {ORDERS_SPLIT} SELECT * FROM train")
def split_random_train(t):
    return split_random(t.orders, "70%", 123, ["o_orderkey"]).train


@query(f"WITH {ORDERS_SPLIT} SELECT * FROM test")
def split_random_test(t):
    return split_random(t.orders, "70%", 123, ["o_orderkey"]).test


@query(f"SELECT * FROM orders WHERE substr({HASH}, 1, 8) < 'b3333333'")
def split_random_hash(t):
    return split_random(t.orders, 0.7, 123, ["o_orderkey"], exact=False).train


@query(
    """
    WITH copies AS (
      SELECT p_brand, p_size, p_type,
        row_number() OVER (PARTITION BY p_brand, p_size, p_type ORDER BY p_partkey) - 1 AS copy_no FROM part),
    ranked AS (
      SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|',
        md5(concat_ws('|', '123', to_json({'p_brand': p_brand, 'p_size': p_size, 'p_type': p_type})::VARCHAR)), copy_no::VARCHAR))) AS rank_no
      FROM copies),
    train AS (SELECT p_brand, p_size, p_type FROM ranked
      WHERE rank_no <= (SELECT round_even(count(*) * CAST(0.3 AS DOUBLE), 0) FROM part))
    SELECT 'train' AS side, * FROM train
    UNION ALL
    SELECT 'test', p_brand, p_size, p_type FROM part WHERE (p_brand, p_size, p_type) NOT IN (SELECT * FROM train)"""
)
def split_random_without_key(t):
    """Equal rows are numbered; rows equal to a drawn one leave the test side."""
    train, test = split_random(t.part.select("p_brand", "p_size", "p_type"), 0.3)
    return train.select(F.lit("train").alias("side"), "*").unionByName(test.select(F.lit("test").alias("side"), "*"))


@query(
    """
    WITH t AS (SELECT l_returnflag, l_linenumber, l_tax, l_discount, nullif(l_quantity, 10) AS quantity, l_shipdate FROM lineitem),
    s AS (SELECT DISTINCT l_returnflag, l_linenumber, l_tax, l_discount, quantity FROM t WHERE l_shipdate < TIMESTAMP '1995-06-01')
    SELECT l_returnflag, l_linenumber, l_tax, l_discount, quantity FROM t WHERE NOT EXISTS (SELECT 1 FROM s
      WHERE s.l_returnflag IS NOT DISTINCT FROM t.l_returnflag
        AND s.l_linenumber IS NOT DISTINCT FROM t.l_linenumber
        AND s.l_tax IS NOT DISTINCT FROM t.l_tax
        AND s.l_discount IS NOT DISTINCT FROM t.l_discount
        AND s.quantity IS NOT DISTINCT FROM t.quantity)"""
)
def split_duplicates_anti(t):
    quantity = F.nullif("l_quantity", F.lit(10)).alias("quantity")
    rows = t.lineitem.select("l_returnflag", "l_linenumber", "l_tax", "l_discount", quantity, "l_shipdate")
    early = rows.filter(F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz")).drop("l_shipdate")
    return complement(rows.drop("l_shipdate"), early)


BOUNDS = "SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi, make_timestamp(CAST(floor(avg(epoch_us(o_orderdate))) AS BIGINT)) AS cut FROM orders"


@query(
    "SELECT CAST(min(o_orderdate) AS DATE) AS \"start\", CAST(max(o_orderdate) AS DATE) AS \"end\","
    " DATE '1970-01-01' + CAST(floor(avg(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)))) AS INTEGER) AS mean FROM orders"
)
def time_bounds_orders(t):
    return time_bounds(t.orders, "o_orderdate", by_day=True)


@query(
    "SELECT min(ts) AS \"start\", max(ts) AS \"end\", date_trunc('second', make_timestamp("
    "CAST(floor(avg(epoch_us(ts))) AS BIGINT))) AS mean FROM events"
)
def time_bounds_events(t):
    return time_bounds(t.events, "ts").withColumn("mean", F.date_trunc("second", "mean").cast("timestamp_ntz"))


@query(f"SELECT orders.* FROM orders, ({BOUNDS}) WHERE o_orderdate >= lo AND o_orderdate <= cut")
def split_time_train(t):
    return split_time(t.orders, "o_orderdate").train


@query(f"SELECT orders.* FROM orders, ({BOUNDS}) WHERE o_orderdate > cut AND o_orderdate <= hi")
def split_time_test(t):
    return split_time(t.orders, "o_orderdate").test


@query(
    "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2001-08-01'"
)
def split_time_open_end(t):
    """The window that leaves its end out, without a start of the training period."""
    return split_time(t.orders, "o_orderdate", cut="1999-01-01", end="2001-08-01", end_inclusive=False).test


@query(
    "SELECT 'train' AS side, count(*) AS n_rows FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20 06:00:00'"
    " UNION ALL SELECT 'test', count(*) FROM events WHERE ts > TIMESTAMP '2024-01-20 06:00:00' AND ts <= TIMESTAMP '2024-01-29'"
)
def split_counts_events(t):
    return split_counts(split_time(t.events, "ts", "2024-01-20 06:00:00", "2024-01-03 00:00:00", "2024-01-29 00:00:00"))
