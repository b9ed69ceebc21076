"""Adaptor that derives the raw content table from the star-schema tables.

One content item per order that has line items:

* video_id         = o_orderkey
* title            = distinct part names of its line items, sorted, space-joined
* category         = o_orderpriority
* publish_date     = o_orderdate as a date
* views            = sum of l_quantity
* watch_time_seconds = sum of l_extendedprice (summed as decimal(18,2))
* likes / comments / shares = line items with return flag A / R / N
* thumbnail_style  = c_mktsegment of the ordering customer

Plan: lineitem is joined to part on the part key (the optimizer broadcasts
part only when its measured size is under the broadcast threshold; otherwise
a sort-merge join with AQE skew splitting). Its rows are then dealt by order key, into
tasks of a bounded number of rows, and aggregated there: an order has a handful of
rows all over the table, so aggregating before the shuffle saves nothing and its sets
of names take more room than the names. Orders get their customer's segment before they meet
the titles, so titles are not shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewscope.functions.distribute import tasks_for

ITEMS_PER_TASK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def content_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 raw content columns, typed, one row per order with line items."""
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")

    items = lineitem.join(part, lineitem.l_partkey == part.p_partkey, "left").drop("l_partkey")
    items = items.repartition(tasks_for(spark, lineitem.count(), ITEMS_PER_TASK), "l_orderkey")
    per_order = items.groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("bigint").alias("views"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("watch_time_seconds"),
        F.count_if(F.col("l_returnflag") == "A").alias("likes"),
        F.count_if(F.col("l_returnflag") == "R").alias("comments"),
        F.count_if(F.col("l_returnflag") == "N").alias("shares"),
        F.count("p_partkey").alias("_named_items"),
        F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("title"),
    ).where(F.col("_named_items") > 0)

    placed = orders.join(customer, orders.o_custkey == customer.c_custkey).drop("o_custkey", "c_custkey")
    return (placed.join(per_order, placed.o_orderkey == per_order.l_orderkey)
            .select(
                F.col("o_orderkey").alias("video_id"),
                "title",
                F.col("o_orderpriority").alias("category"),
                F.to_date("o_orderdate").alias("publish_date"),
                "views",
                "watch_time_seconds",
                "likes",
                "comments",
                "shares",
                F.col("c_mktsegment").alias("thumbnail_style"),
            ))


def documents_as_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second text input: documents with their length as the target metric."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.col("text").alias("title"),
        F.col("lang").alias("category"), F.col("source").alias("thumbnail_style"),
        F.col("n_chars").alias("views"))
