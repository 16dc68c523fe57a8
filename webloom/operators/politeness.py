"""Robots rules, throttling, retries and crawl statistics as columns and aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pages import host

RETRY_CODES = (500, 502, 503, 504)


@lru_cache(4096)
def _rules(text: str) -> RobotFileParser:
    p = RobotFileParser()
    p.parse(text.splitlines())
    return p


def allowed(robots_txt: str | None, user_agent: str, url: str) -> bool:
    """Whether rules let an agent fetch a URL. No rules allow all; a URL without host is denied."""
    if not urlsplit(url).netloc:
        return False
    return robots_txt is None or _rules(robots_txt).can_fetch(user_agent, url)


def with_permission(pages: DataFrame, robots: DataFrame, user_agent: str = "*") -> DataFrame:
    """pages with a column allowed. robots: host, robots_txt; of several rows of a host the least text counts."""

    @F.pandas_udf("boolean")
    def judge(text: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([allowed(t, user_agent, u) for t, u in zip(text, url)], dtype=bool)

    rules = robots.groupBy(F.col("host").alias("_host")).agg(F.min("robots_txt").alias("_rules"))
    joined = pages.withColumn("_of", host(F.col("url"))).join(rules, F.col("_of") == F.col("_host"), "left")
    return joined.withColumn("allowed", judge("_rules", "url")).drop("_of", "_host", "_rules")


def should_retry(status: Column, failed: Column, retries: Column, most: int = 3, codes: tuple[int, ...] = RETRY_CODES) -> Column:
    """After an exception or a status of codes, while fewer than `most` retries were made."""
    return (F.coalesce(failed, F.lit(False)) | F.coalesce(status.isin(*codes), F.lit(False))) & (retries < most)


def backoff(attempt: Column, base: float = 0.5, cap: float = 30.0, jitter: Column | None = None) -> Column:
    """Seconds before the next attempt; jitter is a factor, such as F.rand() * 0.6 + 0.7."""
    wait = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
    return wait if jitter is None else wait * jitter


def throttle_delay(latency: Column, target: float = 4.0, cap: float = 10.0) -> Column:
    """Seconds between requests to a host whose smoothed latency this is."""
    return F.least(F.lit(cap), F.greatest(F.lit(0.0), latency / F.lit(target)))


@dataclass(frozen=True)
class AutoThrottle:
    """Pauses that follow a host's smoothed latency; `start` before there is one."""

    target: float = 4.0
    cap: float = 10.0
    start: float = 0.25

    def delay(self, host: Column, latency: Column) -> Column:
        return F.when(latency.isNull(), F.lit(self.start)).otherwise(throttle_delay(latency, self.target, self.cap))


@dataclass(frozen=True)
class FixedDelay:
    """The same pause for all, but for hosts that have their own."""

    seconds: float = 1.0
    by_host: tuple[tuple[str, float], ...] = ()

    def delay(self, host: Column, latency: Column) -> Column:
        out = F.lit(float(self.seconds))
        for name, seconds in self.by_host:
            out = F.when(host == name, F.lit(float(seconds))).otherwise(out)
        return out


@dataclass(frozen=True)
class NoDelay:
    def delay(self, host: Column, latency: Column) -> Column:
        return F.lit(0.0)


@dataclass(frozen=True)
class Retry:
    """When to try again, and after how long."""

    most: int = 3
    codes: tuple[int, ...] = RETRY_CODES
    base: float = 0.5
    cap: float = 30.0

    def again(self, status: Column, failed: Column, retries: Column) -> Column:
        return should_retry(status, failed, retries, self.most, self.codes)

    def wait(self, attempt: Column, jitter: Column | None = None) -> Column:
        return backoff(attempt, self.base, self.cap, jitter)


def smoothed_by(samples: DataFrame, key: str, order: list[str], value: str, weight_of_old: float, start: float | None = None) -> DataFrame:
    """key, smoothed: the exponentially smoothed value of each key's samples in order, from start or the first sample on. A weighted sum over
    ranks: samples are sorted within a key, but never gathered."""
    w = Window.partitionBy(key)
    ranked = samples.select(key, value, F.row_number().over(w.orderBy(*(F.col(c).desc() for c in order))).alias("_back"), F.row_number().over(w.orderBy(*order)).alias("_at"))
    first = (F.col("_at") == 1) & F.lit(start is None)
    weight = F.pow(F.lit(float(weight_of_old)), F.col("_back") - 1) * F.when(first, F.lit(1.0)).otherwise(F.lit(1 - weight_of_old))
    out = F.sum(weight * F.col(value))
    if start is not None and start:
        out = out + F.lit(float(start)) * F.pow(F.lit(float(weight_of_old)), F.count("*"))
    return ranked.groupBy(key).agg(out.alias("smoothed"))


def smoothed(samples: Column, weight_of_old: float, start: float | None = None) -> Column:
    """Exponentially smoothed value of an array in order; it begins at start, or at the first sample."""
    first = F.lit(start) if start is not None else F.get(samples, F.lit(0))
    rest = samples if start is not None else F.slice(samples, F.lit(2), F.greatest(F.size(samples) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda s, x: F.lit(weight_of_old) * s + F.lit(1 - weight_of_old) * x)


def fetch_stats(log: DataFrame) -> DataFrame:
    """By host, of a log of url, status, bytes, latency, cached, error: requests, successes, errors, cache_hits, bytes, least and largest latency."""
    return log.groupBy(host(F.col("url")).alias("host")).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") == 200).alias("successes"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("cached")).alias("cache_hits"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.min("latency").alias("min_latency"),
        F.max("latency").alias("max_latency"),
    )


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"))
