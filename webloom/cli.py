"""python -m webloom.cli EXPRESSION [--pages TABLE]: results of a program as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.crawl import crawl
from .plans.language import parse
from .settings import Settings, load, log
from .sources.live import fetch
from .sources.tables import cache_key, fresh, store, written


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="webloom", description=__doc__)
    p.add_argument("expression")
    p.add_argument("--pages", help="Parquet table with url and html; without it pages are fetched")
    p.add_argument("--depth", type=int, default=1)
    p.add_argument("--verbose", action="store_true", help="print the parsed program first")
    p.add_argument("--debug", action="store_true", help="print the physical plan first")
    p.add_argument("--errors", action="store_true", help="yield error rows too")
    p.add_argument("--robots", help="Parquet table with host and robots_txt")
    p.add_argument("--user-agent", default="*")
    p.add_argument("--limit", type=int, help="so many results at most")
    p.add_argument("--progress", action="store_true", help="print what each level had")
    p.add_argument("--concurrency", type=int, help="requests at once")
    p.add_argument("--concurrency-per-host", type=int, dest="per_host")
    p.add_argument("--header", action="append", default=[], metavar="NAME:VALUE", help="of every request; may be given again")
    p.add_argument("--respect-robots", action=argparse.BooleanOptionalAction, default=None, help="as --robots says")
    p.add_argument("--insecure", action="store_true", help="don't check certificates")
    p.add_argument("--cache", help="Parquet table of pages that are taken from there while fresh, and added to")
    p.add_argument("--settings", type=Path, help="JSON file of settings")
    return p.parse_args(argv)


def settings_of(a: argparse.Namespace) -> Settings:
    """Settings of the file, with what the command line says over them."""
    given = {"concurrency": a.concurrency, "per_host": a.per_host, "respect_robots": a.respect_robots, "cache": a.cache, "verify_ssl": False if a.insecure else None}
    headers = dict(h.partition(":")[::2] for h in a.header)
    if bad := [h for h in a.header if ":" not in h]:
        raise SystemExit(f"a header has a name and a value: {bad[0]}")
    base = load(a.settings)
    out = replace(base, **{k: v for k, v in given.items() if v is not None}, headers=base.merged_headers({k.strip(): v.strip() for k, v in headers.items()}))
    if found := out.problems():
        raise SystemExit("; ".join(found))
    return out


def source(spark: SparkSession, a: argparse.Namespace, settings: Settings):
    """The table of pages, or a function that fetches them, through the cache where there is one."""
    if a.pages:
        return spark.read.parquet(a.pages)

    def fetched(urls):
        if not settings.cache:
            return fetch(urls, settings)
        try:
            cache = spark.read.parquet(settings.cache)
        except AnalysisException:  # nothing is there yet
            cache = None
        if cache is None:
            new = written(fetch(urls, settings), "fetched")
            store(new, settings.cache)
            return new
        held = fresh(cache, F.current_timestamp(), settings.cache_days).drop("fetched_at")
        keyed = urls.withColumn("key", cache_key(F.col("url")))
        new = written(fetch(keyed.join(held, "key", "left_anti"), settings), "fetched")
        old = written(keyed.join(held.drop("url"), "key").select(new.columns), "held")
        store(new, settings.cache)
        return old.unionByName(new)

    return fetched


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = arguments(argv)
    program = parse(a.expression)
    if a.verbose:
        print(program, file=sys.stderr)
    spark = spark or SparkSession.builder.getOrCreate()
    settings = settings_of(a)
    robots = spark.read.parquet(a.robots) if a.robots and settings.respect_robots else None
    told = log("webloom.crawl", op="crawl")
    progress = lambda x: (told.info("level", **x), print(f"depth {x['depth']}: {x['data']} values, {x['link']} links, {x['error']} errors", file=sys.stderr))
    found = crawl(spark, program, source(spark, a, settings), a.depth, yield_errors=a.errors, robots=robots, user_agent=a.user_agent, limit=a.limit, progress=progress if a.progress else None).orderBy("depth", "path")
    if a.debug:
        found.explain("formatted")
    try:
        for r in found.select(F.to_json(F.struct(*[c for c in found.columns if c not in ("path", "value")])).alias("meta"), "value").toLocalIterator():
            row = json.loads(r.meta)
            try:
                row["value"] = json.loads(r.value) if r.value and r.value[0] in "{[" else r.value
            except ValueError:
                row["value"] = r.value
            print(json.dumps(row, ensure_ascii=False), file=out, flush=True)
    except BrokenPipeError:
        pass
    return 0


if __name__ == "__main__":
    sys.exit(main())
