"""Customer table derived from the star-schema input tables.

One row per customer: the 24 behavioural columns plus the churn target,
computed from ``customer ⋈ nation ⋈ region`` with order, line and event
aggregates left-joined on the customer key.  The observation cut is
``T = max(o_orderdate) - 180 days``; features use orders up to T, the
target is "no order after T".

Scale notes: line items are first reduced to one row per order (counts), then
every fact table is reduced by a ``groupBy`` on the customer key
(map-side partial aggregation, so a hot customer collapses before the shuffle);
the joins are then 1:1 on the key.  ``nation``/``region`` are broadcast behind a
row-count check.  T is one scalar, collected once and pushed into the scans as
a literal filter.  Money is summed as integer cents (exact in any engine and
summation order) and converted to thousands once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import HEADER_ALIASES, ID, TARGET
from .tables import bounded_broadcast, table

CUT_DAYS = 180
DIMENSION_MAX_ROWS = 10_000


def observation_cut(spark: SparkSession, sf_dir: str) -> dt.datetime:
    last = table(spark, sf_dir, "orders", "o_orderdate").agg(F.max("o_orderdate")).first()[0]
    return last - dt.timedelta(days=CUT_DAYS)


def _days(later: Column, earlier: Column) -> Column:
    return F.datediff(later.cast("date"), earlier.cast("date"))


def customer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical typed customer table (snake_case columns, numerics as double)."""
    cut = observation_cut(spark, sf_dir)
    # built from text: a wall-clock literal, independent of session and process time zones
    cut_lit = F.lit(cut.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")

    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                   "o_totalprice", "o_orderpriority")
    before = orders.filter(F.col("o_orderdate") <= cut_lit)
    after = (orders.filter(F.col("o_orderdate") > cut_lit)
             .groupBy(F.col("o_custkey").alias("a_custkey"))
             .agg(F.lit(1).alias("ordered_after")))

    # two-level aggregation: per (customer, priority) first, so the distinct count needs no Expand
    by_priority = before.groupBy("o_custkey", "o_orderpriority").agg(
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("spend_cents"),
    )
    order_agg = by_priority.groupBy(F.col("o_custkey").alias("k")).agg(
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
        F.sum("n_orders").alias("n_orders"),
        F.sum("spend_cents").alias("spend_cents"),
        F.count(F.lit(1)).alias("n_priorities"),
    )

    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_discount", "l_returnflag")
    # pre-aggregate lines per order (partial aggregation next to the scan), then join 1:1 with orders
    per_order = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("l_discount") > 0.05).alias("n_discount"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.count_if(F.col("l_quantity") > 45).alias("n_big"),
    )
    line_agg = (
        per_order.join(before.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("lk"))
        .agg(
            (F.sum("n_discount") / F.sum("n_lines")).alias("discount_share"),
            (F.sum("n_returned") / F.sum("n_lines")).alias("return_share"),
            F.sum("n_big").alias("big_lines"),
        )
    )

    events = table(spark, sf_dir, "events", "user_id", "ts", "event_type", "value", "props")
    etype = F.col("event_type")
    browse = etype.isin("view", "click")
    # two-level aggregation: per (user, day) first — active days become a plain count
    daily = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(browse, F.col("value"))).alias("browse_sum"),
        F.count(F.when(browse, F.col("value"))).alias("browse_n"),
        F.count_if(etype == "view").alias("views"),
        F.count_if(etype == "click").alias("clicks"),
        F.count_if(etype == "purchase").alias("purchases"),
        F.count_if(etype == "error").alias("errors"),
        F.max("value").alias("max_value"),
        F.count_if(F.get_json_object("props", "$.k").cast("int") < 50).alias("app_events"),
    )
    event_agg = daily.groupBy(F.col("user_id").alias("ek")).agg(
        F.sum("n").alias("n_events"),
        (F.sum("browse_sum") / F.nullif(F.sum("browse_n"), F.lit(0))).alias("session_avg"),
        F.sum("views").alias("views"),
        F.sum("clicks").alias("clicks"),
        F.sum("purchases").alias("purchases"),
        F.sum("errors").alias("errors"),
        F.max("max_value").alias("max_value"),
        F.sum("app_events").alias("app_events"),
        F.count(F.lit(1)).alias("active_days"),
    )

    nation = bounded_broadcast(table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey"),
                               DIMENSION_MAX_ROWS)
    region = bounded_broadcast(table(spark, sf_dir, "region", "r_regionkey", "r_name"), DIMENSION_MAX_ROWS)
    cust = (table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")      # unmatched keys keep the customer
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left"))

    j = (cust.join(order_agg, F.col("c_custkey") == F.col("k"), "left")
         .join(line_agg, F.col("c_custkey") == F.col("lk"), "left")
         .join(event_agg, F.col("c_custkey") == F.col("ek"), "left")
         .join(after, F.col("c_custkey") == F.col("a_custkey"), "left"))

    key = F.col("c_custkey")
    cents = F.col("spend_cents").cast("double")
    hundred = F.lit(100.0)
    d = lambda c: c.cast("double")
    out = j.select(
        key.alias(ID),
        d(F.lit(16) + (key * 37) % 90).alias("age"),
        F.when(key % 25 == 0, "Other").when(key % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("city"),
        d(F.floor(_days(cut_lit, F.col("first_order")) / F.lit(365.0))).alias("membership_years"),
        d(F.col("n_events")).alias("login_frequency"),
        F.col("session_avg").alias("session_duration_avg"),
        (d(F.col("views")) / F.col("active_days")).alias("pages_per_session"),
        (hundred * (F.col("clicks") - F.col("purchases")) / F.nullif(F.col("clicks"), F.lit(0)))
        .alias("cart_abandonment_rate"),
        d(F.col("clicks")).alias("wishlist_items"),
        d(F.coalesce(F.col("n_orders"), F.lit(0))).alias("total_purchases"),
        (cents / F.col("n_orders") / 100000.0).alias("average_order_value"),
        d(_days(cut_lit, F.col("last_order"))).alias("days_since_last_purchase"),
        (hundred * F.col("discount_share")).alias("discount_usage_rate"),
        (hundred * F.col("return_share")).alias("returns_rate"),
        (hundred * F.col("views") / F.col("n_events")).alias("email_open_rate"),
        d(F.col("errors")).alias("customer_service_calls"),
        d(F.col("big_lines")).alias("product_reviews_written"),
        (F.col("max_value") / 4).alias("social_engagement_score"),
        d(F.col("app_events")).alias("mobile_app_usage"),
        F.when(F.col("n_priorities") <= 3, "Low").when(F.col("n_priorities") == 4, "Medium")
        .when(F.col("n_priorities") >= 5, "High").alias("payment_method_diversity"),
        (cents / 100000.0).alias("lifetime_value"),
        F.col("c_acctbal").alias("credit_balance"),
        F.concat(F.lit("Q"), F.quarter("first_order").cast("string")).alias("signup_quarter"),
        F.when(F.col("ordered_after").isNull(), 1).otherwise(0).alias(TARGET),
    )
    return out


_MATERIALIZED: dict = {}


def materialized_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived customer table written once per application to the shared checkpoint area.

    Every report reads this Parquet table (pruned, pushed-down scans) instead of
    re-deriving it from the fact tables; the write also cuts the lineage.
    """
    from ..session import shared_scratch
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _MATERIALIZED:
        path = shared_scratch(spark, "customers")
        customer_table(spark, sf_dir).write.mode("overwrite").parquet(path)
        _MATERIALIZED[key] = path
    return spark.read.parquet(_MATERIALIZED[key])


def with_source_headers(df: DataFrame, language: str = "english") -> DataFrame:
    """Rename canonical columns to the source-file headers (English or Spanish)."""
    pick = 0 if language == "english" else 1
    return df.select(ID, *[F.col(c).alias(HEADER_ALIASES[c][pick]) for c in df.columns if c != ID])


def source_frame(spark: SparkSession, sf_dir: str, language: str = "english") -> DataFrame:
    """The (materialised) customer table under the source-file headers."""
    return with_source_headers(materialized_customers(spark, sf_dir), language)
