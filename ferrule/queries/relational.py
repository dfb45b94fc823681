"""Relational idioms over the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import table
from .base import Book, n, r, rs

book = Book()


@book.query(f"""WITH p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, value AS click FROM events WHERE event_type = 'click')
SELECT event_id, p.user_id::BIGINT AS user_id, {rs("click")} AS asof_click FROM p ASOF LEFT JOIN (SELECT user_id, ts, max(click) AS click FROM c GROUP BY ALL) c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def last_click_before_purchase(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("click"))
    return R.as_of(left, right, "user_id", "ts", ["click"]).select("event_id", n("user_id").alias("user_id"), r("asof_click").alias("asof_click"))


@book.query(f"SELECT band::BIGINT AS band, count(*) AS n, {rs('avg(l_extendedprice)')} AS mean_price FROM (SELECT l_extendedprice, (l_quantity >= 10)::INT + (l_quantity >= 25)::INT + (l_quantity >= 40)::INT AS band FROM lineitem) GROUP BY 1")
def quantity_bands(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    return R.range_join(li, [10.0, 25.0, 40.0], "l_quantity").groupBy("band").agg(F.count("*").alias("n"), r(F.avg("l_extendedprice")).alias("mean_price")).withColumn("band", n("band"))


@book.query(f"SELECT o_custkey, o_orderkey, {rs('sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) / sum(o_totalprice) OVER (PARTITION BY o_custkey)')} AS share FROM orders")
def running_order_share(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.running_share(o, "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", r("share").alias("share"))


@book.query(f"SELECT l_returnflag, {rs('regr_slope(l_extendedprice, l_quantity)')} AS slope, {rs('sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity)')} AS through_origin FROM lineitem GROUP BY 1")
def price_regression(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return R.regression(li, "l_extendedprice", "l_quantity", ["l_returnflag"]).select("l_returnflag", r("slope").alias("slope"), r("through_origin").alias("through_origin"))


@book.query("SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2.0::DOUBLE AS place FROM supplier")
def supplier_tie_ranks(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", R.tie_average_rank("s_acctbal", ["s_nationkey"]).cast("double").alias("place"))
