"""Streams of pages: extraction as pages come in, crawls that go on with each batch, and a throttle that keeps state by host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.pages import host
from ..operators.crawl import crawl, extract


def extract_stream(pages: DataFrame, expression: str, late: str | None = None) -> DataFrame:
    """extract() on a stream of pages (url, html), each URL once. With late (and a column fetched_at), URLs are remembered that long."""
    once = pages.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url"]) if late else pages.dropDuplicates(["url"])
    return extract(once, expression)


def crawl_stream(spark: SparkSession, seeds: DataFrame, program: str, pages: DataFrame, out: str, checkpoint: str, max_depth: int = 1, every: str | None = None) -> StreamingQuery:
    """Crawls from each batch of a stream of seeds (url), which take the place of the program's own, and appends to a Parquet table.
    Without every, what there is is done and the query ends."""

    def step(batch: DataFrame, number: int) -> None:
        crawl(spark, program, pages, max_depth, seeds=batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    w = seeds.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def throttle_stream(samples: DataFrame, smoothing: float = 0.7, target: float = 4.0, start: float = 0.25, cap: float = 10.0) -> DataFrame:
    """host, latency, delay: after each batch, the smoothed latency of every host of a stream of samples (url, at, latency), and the pause it asks for."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        for x in pd.concat(list(batches)).sort_values("at")["latency"]:
            value = x if value is None else smoothing * value + (1 - smoothing) * x
        state.update((value,))
        yield pd.DataFrame({"host": [key[0]], "latency": [value], "delay": [start if value is None else min(cap, max(0.0, value / target))]})

    by_host = samples.withColumn("host", host(F.col("url"))).groupBy("host")
    return by_host.applyInPandasWithState(step, "host string, latency double, delay double", "latency double", "update", GroupStateTimeout.NoTimeout)
