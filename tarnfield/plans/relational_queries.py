"""Joins, windows and event queries over the sales tables: additions of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.plans.tables import table
from tarnfield.streaming import jobs


def star_join_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and year, in whole cents so that sums don't depend on their order."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("cents"))
    orders = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    places = t("customer").select("c_custkey", "c_nationkey").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    by_order = lines.groupBy("l_orderkey").agg(F.sum("cents").alias("cents"))
    rows = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("n_name", "year").agg(F.sum("cents").alias("cents"), F.count("*").alias("orders"))


STAR_SQL = """
WITH l AS (SELECT l_orderkey, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY ALL)
SELECT n_name, year(o_orderdate)::INTEGER AS year, sum(cents)::BIGINT AS cents, count(*) AS orders FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""


def rollup_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("n"))


ROLLUP_SQL = "SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


def window_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("place")).where("place <= 3")


TOPN_SQL = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders QUALIFY place <= 3"


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's newest view before it: one window over both, no range join."""
    events = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    order = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(order)
    return events.withColumn("view_id", seen).where("event_type = 'purchase'").select("event_id", "view_id")


ASOF_SQL = """
WITH w AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id
  FROM events WHERE event_type IN ('purchase', 'view')) SELECT event_id, view_id FROM w WHERE event_type = 'purchase'"""


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sessions(table(spark, sf_dir, "events"), gap="12 hours")


SESSION_SQL = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s.n"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.event_windows(table(spark, sf_dir, "events")).select("start", "event_type", "n")


WINDOWS_SQL = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"

QUERIES = {f.__name__: f for f in (star_join_revenue, rollup_sales, window_topn, asof_events, session_windows, event_windows)}
ORACLES = {"star_join_revenue": STAR_SQL, "rollup_sales": ROLLUP_SQL, "window_topn": TOPN_SQL, "asof_events": ASOF_SQL, "session_windows": SESSION_SQL, "event_windows": WINDOWS_SQL}
