"""Plain relational families at size: joins, sets, grouping, windows, top rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


def revenue():
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")


@register("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-01-01' GROUP BY 1, 2")
def grouped_totals(spark, sf_dir):
    (lines,) = t(spark, sf_dir, "lineitem")
    return lines.where("l_shipdate <= timestamp '2000-01-01'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), revenue(), F.count("*").alias("lines"))


@register("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def joined_revenue(spark, sf_dir):
    lines, orders, customers, nations = t(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    rows = lines.join(orders.where("o_orderdate >= timestamp '1997-01-01'"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(revenue())


@register("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_counts(spark, sf_dir):
    customers, orders = t(spark, sf_dir, "customer", "orders")
    counted = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return customers.join(counted, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@register("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
def semi_orders(spark, sf_dir):
    orders, lines = t(spark, sf_dir, "orders", "lineitem")
    return orders.join(lines.where("l_quantity = 50"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@register("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_tax > 0.06)")
def anti_parts(spark, sf_dir):
    parts, lines = t(spark, sf_dir, "part", "lineitem")
    return parts.join(lines.where("l_tax > 0.06"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@register("SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 7000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) b ON a.k = b.k")
def full_nations(spark, sf_dir):
    suppliers, customers = t(spark, sf_dir, "supplier", "customer")
    a = suppliers.where("s_acctbal > 7000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = customers.where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full_outer")


@register("SELECT p_brand, p_type, count(*) AS parts FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_parts(spark, sf_dir):
    (parts,) = t(spark, sf_dir, "part")
    return parts.cube("p_brand", "p_type").agg(F.count("*").alias("parts"))


@register("SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def distinct_suppliers(spark, sf_dir):
    (lines,) = t(spark, sf_dir, "lineitem")
    return lines.groupBy(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("day")).agg(F.count_distinct("l_suppkey").alias("suppliers"))


@register("SELECT c_mktsegment, c_custkey, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def top_per_group(spark, sf_dir):
    (customers,) = t(spark, sf_dir, "customer")
    rank = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return customers.withColumn("r", rank).where("r <= 5").select("c_mktsegment", "c_custkey", "r")


@register("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def intersected(spark, sf_dir):
    suppliers, customers = t(spark, sf_dir, "supplier", "customer")
    return suppliers.select(F.col("s_nationkey").alias("k")).intersect(customers.where("c_acctbal < 0").select("c_nationkey"))


@register("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf_dir):
    (events,) = t(spark, sf_dir, "events")
    rows = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "total")
