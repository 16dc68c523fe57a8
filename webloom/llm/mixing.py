"""Mixing sources to target weights: each document is emitted floor(rate) times, plus one copy with the fraction's probability.

rate = weight of the source / sum of weights * tokens to emit / tokens of the source. The draw is a hash of seed and id, so
that a document's copies don't depend on partitions or other documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, small, written

WORD = "[^ \\t\\n\\r\\f]+"
#: Weights of the query: sources share alike, but src0, a bulk crawl, counts as four.
WEIGHTS = {"src0": 4.0}
SEED = 17
#: Sources up to which rates are broadcast; beyond, documents and rates join by shuffle.
MOST_SOURCES = 100_000


def tokens(text: Column) -> Column:
    """Runs of characters but space, tab, line feed, return and form feed; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_: Column, seed: int) -> Column:
    """A number in [0, 1) from seed and id: 32 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, factor: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, tokens, rate of each source of docs. A source that weights doesn't name weighs `default`; factor is tokens to
    emit over tokens there are. Documents without source are a source of their own (null); one without tokens has rate 0."""
    per = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(tokens(F.col(text_col))).alias("mix_tokens"))
    weight = F.lit(float(default))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(weight)
    per = per.withColumn("mix_weight", F.when(F.col("mix_tokens") > 0, weight).otherwise(F.lit(0.0)))
    per = written(per, "rates")  # the texts are read once
    total = per.agg(F.sum("mix_tokens").alias("tokens"), F.sum("mix_weight").alias("weights")).first()  # two numbers
    rate = F.col("mix_weight") / F.lit(total["weights"]) * F.lit(total["tokens"]) * F.lit(float(factor)) / F.col("mix_tokens")
    sure = F.when((F.col("mix_tokens") > 0) & F.lit(bool(total["tokens"] and total["weights"] and total["weights"] > 0)), rate).otherwise(F.lit(0.0))
    return small(per.select("mix_source", "mix_tokens", sure.alias("mix_rate")), MOST_SOURCES)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, factor: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of docs and copy_no (1 to the copies; with underscores after it where docs has that name).

    A null text counts no tokens, yet is emitted at its source's rate, as is an empty one; long texts are counted to their end. Rows of
    one id are drawn alike; null ids are drawn as one id; a draw that equals the fraction gives no copy. A negative or zero weight emits
    nothing. An empty table stays empty.
    """
    per = rates(docs, weights, default, factor, source_col, text_col)
    key, rate, copies = (free_name(docs, x) for x in ("mix_source", "mix_rate", "copy_no"))
    per = per.select(F.col("mix_source").alias(key), F.col("mix_rate").alias(rate))
    joined = docs.join(per, docs[source_col].eqNullSafe(per[key]))
    r = F.col(rate)
    n = F.floor(r) + F.when(draw(F.col(id_col), seed) < r - F.floor(r), 1).otherwise(0)
    return joined.where(n > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), n.cast("int")))).drop(key, rate)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS)


SQL = f"""
with per as (select source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')))::bigint as tokens from documents group by source),
weighed as (select source, tokens, case when tokens > 0 then case when source = 'src0' then 4.0::double else 1.0::double end else 0.0::double end as weight from per),
total as (select sum(tokens)::bigint as all_tokens, sum(weight) as all_weights from weighed),
rates as (select source, case when tokens > 0 and all_weights > 0 then weight / all_weights * all_tokens * 1.0::double / tokens else 0.0::double end as rate from weighed, total),
drawn as (select d.*, (floor(rate) + case when ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0::double < rate - floor(rate) then 1 else 0 end)::bigint as n
  from documents d join rates r on d.source is not distinct from r.source)
select doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::int as copy_no from drawn where n > 0
"""
