"""Tables in the folder that all executors share, and the corpus of pages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the pages to visit are broadcast to the corpus; beyond, both are shuffled by URL.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset (a single machine) one is made."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it names the folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, where lineage ends."""
    at = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= most else df


_DEFAULTS = {"status": "cast(200 as int)", "headers": "cast(null as map<string,string>)", "error": "cast(null as string)", "request_start": "cast(null as double)", "response_end": "cast(null as double)"}


def corpus(pages: DataFrame) -> DataFrame:
    """asked, url, html, status, headers, error, request_start, response_end of pages that have at least url and html. asked is the URL that
    a row answers: request_url where pages has that column, else url. Of several rows that answer one URL the one whose html is least
    counts (null last); only those are shuffled with their html."""
    have = {c.lower() for c in pages.columns}
    asked = F.col("request_url" if "request_url" in have else "url").alias("asked")
    df = pages.select(asked, "url", "html", *(F.col(c) if c in have else F.expr(e).alias(c) for c, e in _DEFAULTS.items())).where("asked is not null")
    # told by hashes first, which are shorter than URLs: a few others that share one do no harm
    key = F.xxhash64("asked")
    several = written(df.groupBy(key.alias("key")).count().where("count > 1").select("key"), "several")
    if several.isEmpty():
        return df
    several = small(written(df.withColumn("key", key).join(small(several), "key", "left_semi").groupBy("asked").count().where("count > 1").select("asked"), "several"))
    one = df.join(several, "asked", "left_semi").groupBy("asked").agg(F.min_by(F.struct(*df.columns), F.struct(F.col("html").isNull(), "html", F.coalesce("url", F.lit("")))).alias("row"))
    return df.join(several, "asked", "left_anti").unionByName(one.select("row.*"))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


IGNORED = ("utm_[^=&#]*", "fbclid")


def cache_key(url):
    """A URL without the query parameters that don't change a page."""
    body, mark = F.regexp_extract(url, r"^[^#]*", 0), F.regexp_extract(url, r"#.*$", 0)
    plain = F.regexp_replace(body, rf"(?<=[?&])(?:{'|'.join(IGNORED)})(?:=[^&]*)?(?:&|$)", "")
    return F.concat(F.regexp_replace(plain, r"[?&]$", ""), mark)


def fresh(cache: DataFrame, now, days: int = 7, codes: tuple[int, ...] = (200, 203, 301, 302, 307, 308), methods: tuple[str, ...] = ("GET", "HEAD")) -> DataFrame:
    """Rows of a cache (url, fetched_at, status, and maybe method, ...) that may still be served, the latest of each key."""
    ok = cache.where((F.col("fetched_at") > now - F.expr(f"interval {days} days")) & F.col("status").isin(*codes))
    if "method" in cache.columns:
        ok = ok.where(F.upper("method").isin(*methods))
    return ok.groupBy(cache_key(F.col("url")).alias("key")).agg(F.max_by(F.struct(*ok.columns), "fetched_at").alias("page")).select("key", "page.*")


def store(fetched: DataFrame, place: str, now=None) -> None:
    """Appends pages (url, html, status, ...) to a cache table, stamped with the time they were fetched at."""
    (fetched if "fetched_at" in fetched.columns else fetched.withColumn("fetched_at", now if now is not None else F.current_timestamp())).write.mode("append").parquet(place)


def through_cache(pages: DataFrame, cache: DataFrame, now, days: int = 7) -> DataFrame:
    """pages (url, html), with the html of those that a cache holds fresh taken from there: a column cached tells which."""
    held = fresh(cache, now, days).select(F.col("key").alias("_key"), F.col("html").alias("_held"))
    both = pages.withColumn("_of", cache_key(F.col("url"))).join(held, F.col("_of") == F.col("_key"), "left")
    return both.withColumn("cached", F.col("_held").isNotNull()).withColumn("html", F.coalesce("_held", "html")).drop("_of", "_key", "_held")
