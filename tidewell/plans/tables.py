"""Queries over uploaded tables: profiling, SQL, reports and chart feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import tables as ops
from tidewell.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_of(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


ORDERS_OF = "orders JOIN customer ON o_custkey = c_custkey"


@query(
    "d1_region_month_revenue",
    """SELECT r_name AS region, date_trunc('month', o_orderdate)::DATE AS month, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2""",
)
def region_month_revenue(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("region"), F.trunc("o_orderdate", "month").alias("month")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_lines")
    )


@query(
    "d1_cross_file_join",
    """SELECT r_name AS region, round(avg(o_totalprice), 2) AS mean_order, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000 GROUP BY 1""",
)
def cross_file_join(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    j = t("orders").where("o_totalprice > 100000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("region")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean_order"), F.count("*").alias("n"))


@query(
    "b1_inspect",
    "SELECT (SELECT count(*) FROM orders) AS row_count, * FROM (VALUES "
    + ", ".join(f"('{c}', '{t}', true, (SELECT count({c}) FROM orders))" for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")))
    + ") AS t(column_name, data_type, nullable, non_null)",
)
def inspect_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return ops.inspect(df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]))


SQL = """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT avg(o_totalprice) FROM orders))
SELECT c_mktsegment AS segment, count(*) AS customers, round(max(spent), 2) AS most FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""


@query("b2_sql", SQL)
def sql_over_tables(spark, sf_dir):
    names = {"orders 2024.csv": "orders_2024_csv"}
    text = SQL.replace("FROM orders", 'FROM "orders 2024.csv"')
    return ops.query(spark, text, {"orders_2024_csv": table(spark, sf_dir, "orders"), "customer": table(spark, sf_dir, "customer")}, names)


@query("b3_distinct_values", "SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment").distinct()


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "e1_summary_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max, count(*) - count({c}) AS nulls FROM lineitem"
        for c in NUMERIC
    ),
)
def summary_numeric(spark, sf_dir):
    s = ops.summary_numeric(table(spark, sf_dir, "lineitem"), list(NUMERIC))
    return s.select("column_name", "count", *[F.round(c, 6).alias(c) for c in ("mean", "stddev")], "min", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")], "max", "nulls")


CATEGORICAL = ("l_returnflag", "l_linestatus")


@query(
    "e2_summary_categorical",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, count(DISTINCT {c}) AS distinct, (SELECT {c} FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, count(*) - count({c}) AS nulls FROM lineitem" for c in CATEGORICAL),
)
def summary_categorical(spark, sf_dir):
    return ops.summary_categorical(table(spark, sf_dir, "lineitem"), list(CATEGORICAL))


@query(
    "e3_group_by_month",
    "SELECT o_orderpriority AS category, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1, 2",
)
def group_by_month(spark, sf_dir):
    return ops.group_by_month(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


MONTHS = ("1997-01", "1997-02", "1997-03")


@query(
    "e4_pivot_months",
    "SELECT o_orderpriority AS category, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (strftime(o_orderdate, '%Y-%m') = '{m}'), 0), 2) AS m{m.replace('-', '_')}" for m in MONTHS) + " FROM orders GROUP BY 1",
)
def pivot_months(spark, sf_dir):
    return ops.pivot_months(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", list(MONTHS))


@query("e5_value_range", "SELECT min(o_orderdate) AS lowest, max(o_orderdate) AS highest, count(*) AS n FROM orders")
def value_range(spark, sf_dir):
    return ops.value_range(table(spark, sf_dir, "orders"), "o_orderdate")


@query(
    "f1_running_total_and_rank",
    "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rank FROM orders",
)
def running_total_and_rank(spark, sf_dir):
    return ops.running_total_and_rank(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice").select("o_orderkey", "o_custkey", "running", "rank")


@query(
    "g1_top_values",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 2) AS percent, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"
        for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def top_values(spark, sf_dir):
    return ops.top_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("g2_top_customers", f"SELECT c_name AS name, round(sum(o_totalprice), 2) AS total FROM {ORDERS_OF} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_customers(spark, sf_dir):
    return ops.top_totals(orders_of(spark, sf_dir), "c_name", F.col("o_totalprice"))


@query("g2_top_products", "SELECT p_name AS name, round(sum(l_quantity * p_retailprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_products(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return ops.top_totals(j, "p_name", F.col("l_quantity") * F.col("p_retailprice"))


@query("g3_value_distribution", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def value_distribution(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderstatus")


# ---- chart feeds


@query(
    "j1_time_series",
    """WITH t AS (SELECT event_type AS "group", ts::DATE AS t FROM events), s AS (SELECT unnest(generate_series(min(t)::TIMESTAMP, max(t)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS t FROM t)
SELECT g."group", strftime(s.t, '%Y-%m-%d') AS time, count(t.t) AS value FROM (SELECT DISTINCT "group" FROM t) g CROSS JOIN s LEFT JOIN t ON t."group" = g."group" AND t.t = s.t GROUP BY 1, 2""",
)
def time_series(spark, sf_dir):
    return ops.time_series(table(spark, sf_dir, "events"), "event_type", "ts")


@query(
    "j2_histogram",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n, round(lo + least(floor((value - lo) / ((hi - lo) / 20)), 19)::INT * (hi - lo) / 20, 6) AS bin_start FROM events, e WHERE value IS NOT NULL GROUP BY 1, 3""",
)
def histogram(spark, sf_dir):
    return ops.histogram(table(spark, sf_dir, "events"), "value")


@query(
    "j3_box",
    """WITH s AS (SELECT event_type AS category, count(*) AS n, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)
SELECT category, s.n, s.min, s.q25, s.median, s.q75, s.max, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers FROM s JOIN events ON event_type = category GROUP BY ALL""",
)
def box(spark, sf_dir):
    s = ops.box(table(spark, sf_dir, "events"), "event_type", "value")
    return s.withColumns({c: F.round(c, 6) for c in ("q25", "median", "q75")})


@query(
    "j4_pie",
    """WITH g AS (SELECT user_id::VARCHAR AS category, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS r, count(*) OVER () AS k FROM g),
f AS (SELECT CASE WHEN k > 6 AND r >= 6 THEN 'other' ELSE category END AS category, sum(n)::BIGINT AS n FROM r GROUP BY 1) SELECT *, round(n / sum(n) OVER (), 6) AS share FROM f""",
)
def pie(spark, sf_dir):
    return ops.pie(table(spark, sf_dir, "events"), "user_id")


@query(
    "j5_bars",
    """WITH g AS (SELECT user_id AS category, event_type AS "group", count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT category FROM g GROUP BY 1 ORDER BY sum(n) DESC, category LIMIT 12) SELECT * FROM g WHERE category IN (SELECT category FROM t)""",
)
def bars(spark, sf_dir):
    return ops.bars(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(
    "j6_flows",
    """SELECT o_orderstatus AS source, c_mktsegment AS target, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2 HAVING count(*) >= 20""",
)
def flows(spark, sf_dir):
    o = orders_of(spark, sf_dir)
    nodes = o.where("o_orderstatus <> 'P'").select(F.col("o_orderstatus").alias("node")).union(o.select("c_mktsegment")).distinct()
    return ops.flows(o, nodes, "o_orderstatus", "c_mktsegment", 20)


@query(
    "j7_treemap",
    "SELECT p_brand, p_type, round(sum(p_retailprice), 2) AS value, grouping(p_brand, p_type)::BIGINT AS level FROM part WHERE p_retailprice >= 0 GROUP BY ROLLUP (p_brand, p_type)",
)
def treemap(spark, sf_dir):
    return ops.treemap(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_retailprice")


STOP, SYNONYMS = ["the", "and", "of", "to", "in"], {"les": "le", "la": "le"}


@query(
    "j8_word_cloud",
    """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM documents), s AS (SELECT CASE WHEN word IN ('les', 'la') THEN 'le' ELSE word END AS word FROM w)
SELECT word, count(*) AS n FROM s WHERE word NOT IN ('the', 'and', 'of', 'to', 'in') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
)
def word_cloud(spark, sf_dir):
    return ops.word_cloud(table(spark, sf_dir, "documents"), "text", STOP, SYNONYMS)


@query(
    "j9_standardised",
    "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) AS z, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS unit FROM events",
)
def standardised(spark, sf_dir):
    return ops.standardised(table(spark, sf_dir, "events"), "event_id", "value")


STAGES = ["view", "click", "signup", "purchase"]


@query(
    "j10_funnel",
    """WITH g AS (SELECT event_type AS stage, list_position(['view', 'click', 'signup', 'purchase'], event_type)::INT - 1 AS pos, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1, 2)
SELECT stage, pos, n, round(n / first(n) OVER (ORDER BY pos), 6) AS of_first, round(n / coalesce(lag(n) OVER (ORDER BY pos), n), 6) AS of_previous FROM g""",
)
def funnel(spark, sf_dir):
    return ops.funnel(table(spark, sf_dir, "events"), "event_type", STAGES)


@query(
    "j11_dual_axes",
    """WITH a AS (SELECT c_mktsegment AS key, round(sum(c_acctbal), 2) AS left_value FROM customer GROUP BY 1), b AS (SELECT c_mktsegment AS key, count(*) AS right_value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT key, left_value, right_value FROM a FULL JOIN b USING (key)""",
)
def dual_axes(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.round(F.sum("c_acctbal"), 2).alias("value"))
    b = orders_of(spark, sf_dir).groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("value"))
    return ops.aligned(a, b, "key")


@query(
    "j12_venn",
    """WITH f AS (SELECT user_id, string_agg(DISTINCT event_type, '&' ORDER BY event_type) AS sets FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup') GROUP BY 1) SELECT sets, count(*) AS n FROM f GROUP BY 1""",
)
def venn(spark, sf_dir):
    return ops.venn(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup"])


@query(
    "j13_cross_tab",
    "SELECT o_orderpriority AS row, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = '{v}'), 0), 2) AS c_{v}" for v in "FOP") + " FROM orders GROUP BY 1",
)
def cross_tab(spark, sf_dir):
    return ops.cross_tab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", list("FOP"), "o_totalprice")
