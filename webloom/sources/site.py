"""A site made from the star schema: its links are the foreign keys, so that crawls of it have known results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOST = "http://warehouse.test"


def _link(path: Column, kind: str, text: Column) -> Column:
    return F.concat(F.lit("<a class='"), F.lit(kind), F.lit("' href='"), path, F.lit("'>"), text, F.lit("</a>"))


def _page(path: Column, title: Column, body: Column) -> list[Column]:
    html = F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1>"), body, F.lit("</body></html>"))
    return [F.concat(F.lit(HOST), path).alias("url"), html.alias("html")]


def _children(df: DataFrame, parent: str, path: Column, text: Column, order: str) -> DataFrame:
    """Of each parent the links to its children, in order."""
    links = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), _link(path, "down", text).alias("link"))))
    return df.groupBy(parent).agg(F.array_join(links["link"], "").alias("links"))


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, html: / links to regions, these to nations, these to customers and suppliers, customers to orders and to the next customer; regions link back."""
    region, nation, customer, supplier, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "orders"))
    at = lambda kind, key: F.concat(F.lit(f"/{kind}/"), F.col(key).cast("string"))
    nothing = F.lit("")
    root = _children(region.withColumn("all", F.lit(1)), "all", at("region", "r_regionkey"), F.col("r_name"), "r_regionkey")
    pages = root.select(*_page(F.lit("/"), F.lit("warehouse"), F.col("links")))
    down = _children(nation, "n_regionkey", at("nation", "n_nationkey"), F.col("n_name"), "n_nationkey")
    regions = region.join(down, region.r_regionkey == down.n_regionkey, "left")
    pages = pages.unionByName(regions.select(*_page(at("region", "r_regionkey"), F.col("r_name"), F.concat(_link(F.lit("/"), "up", F.lit("up")), F.coalesce("links", nothing)))))
    people = _children(customer, "c_nationkey", at("customer", "c_custkey"), F.col("c_name"), "c_custkey").withColumnRenamed("links", "people")
    firms = _children(supplier, "s_nationkey", at("supplier", "s_suppkey"), F.col("s_name"), "s_suppkey").withColumnRenamed("links", "firms")
    nations = nation.join(people, nation.n_nationkey == people.c_nationkey, "left").join(firms, nation.n_nationkey == firms.s_nationkey, "left")
    pages = pages.unionByName(nations.select(*_page(at("nation", "n_nationkey"), F.col("n_name"), F.concat(F.coalesce("people", nothing), F.coalesce("firms", nothing)))))
    pages = pages.unionByName(supplier.select(*_page(at("supplier", "s_suppkey"), F.col("s_name"), nothing)))
    bought = _children(orders, "o_custkey", at("order", "o_orderkey"), F.col("o_orderstatus"), "o_orderkey")
    customers = customer.join(bought, customer.c_custkey == bought.o_custkey, "left")
    nxt = F.concat(F.lit("/customer/"), (F.col("c_custkey") + 1).cast("string"))
    pages = pages.unionByName(customers.select(*_page(at("customer", "c_custkey"), F.col("c_name"), F.concat(F.coalesce("links", nothing), _link(nxt, "next", F.lit("next"))))))
    return pages.unionByName(orders.select(*_page(at("order", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("<p class='status'>"), F.col("o_orderstatus"), F.lit("</p>")))))
