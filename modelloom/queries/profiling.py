"""Tables behind the explorative charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelloom.operators import profile
from modelloom.operators.reshape import axis_bound, prediction_curve, with_counter
from modelloom.operators.split import split_random
from modelloom.queries.registry import query, split_sql

LINEITEM_NUMBERS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]
DIGITS = 6


def rounded(df, digits: int = DIGITS):
    return df.select(
        *[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


def histogram_sql(table: str, column: str, centered: bool = False, label: str = "") -> str:
    parts, shift = (29, 0.5) if centered else (30, 0.0)
    return f"""
    SELECT {label} bin, round(lo0 + (bin - {shift}) * w, 6) AS lo, round(lo0 + (bin - {shift} + 1) * w, 6) AS hi,
      coalesce(c, 0) AS count, round(coalesce(c, 0) / (n * w), 9) AS density
    FROM (SELECT min({column})::DOUBLE AS lo0, (max({column}) - min({column}))::DOUBLE / {parts} AS w, count({column}) AS n FROM {table}) s,
      (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) b
      LEFT JOIN (
        SELECT CAST(least(floor(({column} - lo1 + {shift} * w1) / w1), 29) AS INTEGER) AS bin2, count(*) AS c
        FROM {table}, (SELECT min({column})::DOUBLE AS lo1, (max({column}) - min({column}))::DOUBLE / {parts} AS w1 FROM {table})
        WHERE {column} IS NOT NULL GROUP BY 1) g ON bin2 = bin"""


def _bins(df):
    return df.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6), "density": F.round("density", 9)})


@query(histogram_sql("lineitem", "l_extendedprice"))
def histogram_price(t):
    return _bins(profile.histogram(t.lineitem, "l_extendedprice"))


@query(histogram_sql("customer", "c_acctbal", centered=True))
def histogram_centered(t):
    return _bins(profile.histogram(t.customer, "c_acctbal", centered=True))


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({histogram_sql('events', c, label=f'{chr(39)}{c}{chr(39)} AS variable,')})" for c in ("value", "user_id")
    )
)
def histograms_events(t):
    return _bins(profile.histograms(t.events, ["value", "user_id"]))


def box_sql(table: str, column: str) -> str:
    return f"""
    WITH q AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median,
        quantile_cont({column}, 0.75) AS q3 FROM {table}),
      f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
    SELECT count({column}) AS n, min({column}) AS min, max({column}) AS max,
      round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
      round(any_value(iqr), 6) AS iqr, round(any_value(lo_fence), 6) AS lo_fence, round(any_value(hi_fence), 6) AS hi_fence,
      min(CASE WHEN {column} >= lo_fence THEN {column} END) AS lo_whisker,
      max(CASE WHEN {column} <= hi_fence THEN {column} END) AS hi_whisker,
      count(CASE WHEN {column} < lo_fence OR {column} > hi_fence THEN 1 END) AS n_outliers
    FROM {table}, f"""


@query(box_sql("lineitem", "l_extendedprice"))
def box_stats_price(t):
    return rounded(profile.box_stats(t.lineitem, "l_extendedprice"))


@query(box_sql("events", "value"))
def box_stats_value(t):
    return rounded(profile.box_stats(t.events, "value"))


@query(
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"
    " SELECT event_id, value FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"
)
def box_outliers_value(t):
    return profile.outliers(t.events.select("event_id", "value"), "value")


@query(
    """
    WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n,
        0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * pow(count(value), -0.2) AS bw
      FROM events),
    placed AS (SELECT (value - lo) / ((hi - lo) / 4096) AS p FROM events, s),
    cells AS (SELECT least(floor(p), 4095) AS node, p - least(floor(p), 4095) AS f FROM placed),
    weights AS (SELECT node, sum(1 - f) AS w FROM cells GROUP BY 1 UNION ALL SELECT node + 1, sum(f) FROM cells GROUP BY 1),
    grid AS (SELECT CAST(range AS INTEGER) AS point, lo + range * (hi - lo) / 511 AS x FROM range(512), s)
    SELECT point, round(any_value(x), 6) AS x,
      round(sum(w * exp(-0.5 * pow((x - (lo + node * (hi - lo) / 4096)) / bw, 2))) / any_value(n * bw * sqrt(2 * pi())), 9) AS density
    FROM grid, weights, s GROUP BY point"""
)
def kde_value(t):
    return profile.kde(t.events, "value").withColumns({"x": F.round("x", 6), "density": F.round("density", 9)})


@query(
    """
    WITH x AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, value - (SELECT avg(value) FROM events) AS v FROM events),
    lags AS (SELECT CAST(range AS INTEGER) AS lag FROM range(101))
    SELECT lag AS "Lag", round(sum(a.v * b.v) / (SELECT sum(v * v) FROM x), 6) AS "ACF"
    FROM (SELECT lag, i + lag AS j, v FROM x, lags) a JOIN x b ON b.i = a.j GROUP BY lag"""
)
def acf_events_value(t):
    return rounded(profile.autocorrelation(t.events, "value", ["ts", "event_id"]))


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS var_x, '{b}' AS var_y, round(corr({a}, {b}), 6) AS corr FROM lineitem"
        for a in LINEITEM_NUMBERS
        for b in LINEITEM_NUMBERS
    )
)
def correlation_matrix_lineitem(t):
    return rounded(profile.correlation_matrix(t.lineitem))


@query(
    """
    WITH long AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
    SELECT 'e' || a.d AS var_x, 'e' || b.d AS var_y, round(corr(a.v, b.v), 6) AS corr
    FROM long a JOIN long b USING (vec_id) GROUP BY 1, 2"""
)
def correlation_matrix_embeddings(t):
    wide = t.embeddings.select(*[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    return rounded(profile.correlation_matrix(wide))


@query(
    """
    WITH long AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
    wide AS (SELECT vec_id, 'e' || d AS name, v FROM long UNION ALL SELECT vec_id, 's' || d, v * v FROM long
      UNION ALL SELECT vec_id, 'n' || d, CASE WHEN v > 0 THEN v END FROM long)
    SELECT a.name AS var_x, b.name AS var_y, round(corr(a.v, b.v), 6) AS corr
    FROM wide a JOIN wide b USING (vec_id) WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2"""
)
def correlation_matrix_blocks(t):
    """192 columns, a third of them with gaps, in two blocks and two passes."""
    each = [F.col("embedding")[i].cast("double") for i in range(64)]
    wide = [e.alias(f"e{i}") for i, e in enumerate(each)] + [(e * e).alias(f"s{i}") for i, e in enumerate(each)]
    wide += [F.when(e > 0, e).alias(f"n{i}") for i, e in enumerate(each)]
    return rounded(profile.correlation_matrix(t.embeddings.select(*wide), block=96, entries=20_000))


PART_SPLIT = split_sql("part", "p_partkey")


@query(
    f"""WITH {PART_SPLIT},
    p AS (SELECT p_size AS x, p_retailprice AS y, 'train' AS split, p_partkey FROM train
      UNION ALL SELECT p_size, p_retailprice, 'test', p_partkey FROM test)
    SELECT x, y, split FROM p ORDER BY md5(concat_ws('|', '5', CAST(p_partkey AS VARCHAR))) LIMIT 150"""
)
def scatter_limited(t):
    """150 points of both sides together, drawn by their keys."""
    train, test = split_random(t.part, 0.7, key_cols=["p_partkey"])
    return profile.scatter(train, test, "p_size", "p_retailprice", max_points=150, key_cols=["p_partkey"], seed=5)


@query(
    """SELECT row_number() OVER (ORDER BY o_orderstatus,
        md5(concat_ws('|', '0', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority))) AS "Counter",
      o_orderkey, o_orderstatus, o_orderpriority FROM orders"""
)
def row_counter_ties(t):
    """Rows numbered by a column of three values; the content decides among equal ones."""
    return with_counter(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus"])


@query(
    f"WITH {PART_SPLIT} SELECT p_size AS x, p_retailprice AS y, 'train' AS split FROM train"
    " UNION ALL SELECT p_size, p_retailprice, 'test' FROM test"
)
def scatter_by_split(t):
    train, test = split_random(t.part, 0.7, key_cols=["p_partkey"])
    return profile.scatter(train, test, "p_size", "p_retailprice")


@query(
    f"""WITH {PART_SPLIT},
    p AS (SELECT p_size AS x, p_retailprice AS y, 'train' AS split FROM train UNION ALL SELECT p_size, p_retailprice, 'test' FROM test),
    r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
    SELECT split, CAST(least(floor((x - x0) * (20 / (x1 - x0)::DOUBLE)), 19) AS INTEGER) AS x_bin,
      CAST(least(floor((y - y0) * (20 / (y1 - y0)::DOUBLE)), 19) AS INTEGER) AS y_bin, count(*) AS n
    FROM p, r GROUP BY ALL"""
)
def scatter_cells(t):
    train, test = split_random(t.part, 0.7, key_cols=["p_partkey"])
    return profile.scatter_bins(train, test, "p_size", "p_retailprice", bins=20)


def _curve(t):
    """Orders with the mean price of their status as the prediction."""
    means = t.orders.groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 3).alias("Group mean"))
    return t.orders.join(means, "o_orderstatus")


CURVE = "SELECT *, round((SELECT avg(o_totalprice) FROM orders g WHERE g.o_orderstatus = o.o_orderstatus), 3) AS \"Group mean\" FROM orders o"


@query(
    f"SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS \"Counter\", o_totalprice, \"Group mean\" FROM ({CURVE})"
)
def prediction_curve_counter(t):
    return prediction_curve(_curve(t), "o_totalprice", ["Group mean"], order_by=["o_orderdate", "o_orderkey"])


@query(f"SELECT o_orderdate, o_totalprice, \"Group mean\" FROM ({CURVE})")
def prediction_curve_time(t):
    return prediction_curve(_curve(t), "o_totalprice", ["Group mean"], time_col="o_orderdate")


@query("SELECT 1.5 * max(o_totalprice) AS y_bound FROM orders")
def prediction_axis_bound(t):
    return axis_bound(t.orders, "o_totalprice")
