"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

Sketches of parts merge by union, and as the threshold is the same for all, containment of a small document in a huge one is
estimated without bias by the share of its hashes that the other has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Batches, rows_of, typed
from .text import U64, ragged, shingles, word_chunks


def sketch(docs: DataFrame, scale: int = 32, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (distinct), sketch (sorted): a row for every row of docs, extra columns left out.

    A shingle is n lower-cased words; a shorter text is one shingle. sketch holds each distinct hash below 2**64 / scale, as
    signed number. Null and empty texts, and texts without words, have 0 shingles and an empty sketch; long texts are read whole.
    Ids stay as they are, null or not; repeated rows give equal sketches, an empty table an empty result. Nothing is ranked, so
    there are no ties.
    """
    below = U64((1 << 64) // scale - 1)

    def step(b: pa.RecordBatch):
        for row, w in word_chunks(b.column(1)):
            h, at = shingles(w, n)
            count = len(w.first) - 1
            doc = np.searchsorted(w.first, at, "right") - 1
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            low = h <= below
            offsets = np.zeros(count + 1, np.int64)
            np.cumsum(np.bincount(doc[low], minlength=count), out=offsets[1:])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(row, count), pa.array(np.bincount(doc, minlength=count)), ragged(h[low].view(np.int64), offsets, pa.int64())], ["doc_id", "n_shingles", "sketch"])

    def run(batches: Batches) -> Batches:
        return rows_of(batches, step)

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, typed(base, "doc_id", "n_shingles long, sketch array<bigint>"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """The union of the sketches of each group of keys: the sketch of the group's texts together. Null keys are a group."""
    each = sketches.select(*keys, F.explode_outer("sketch").alias("hash")).distinct()
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of part's shingles that whole has; null for an empty sketch."""
    return F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0))


def contained(parts: DataFrame, wholes: DataFrame, least: float = 0.5) -> DataFrame:
    """part, whole (ids), containment: pairs of sketches of which the part's estimated share in the whole is `least` or more.

    Hashes meet in one join, and only those of parts; what many wholes share is spread by Spark's skew handling of that join. An empty
    sketch is in no pair, a document that is on both sides pairs with itself too, repeated rows of an id count as one (their
    union), and null ids and empty tables give nothing.
    """
    p = parts.where("doc_id is not null").select(F.col("doc_id").alias("part"), F.explode("sketch").alias("hash")).distinct()
    w = wholes.where("doc_id is not null").select(F.col("doc_id").alias("whole"), F.explode("sketch").alias("hash")).distinct()
    met = p.join(w, "hash").groupBy("part", "whole").agg(F.count("*").alias("both"))
    share = F.col("both") / F.col("size")
    return met.join(p.groupBy("part").agg(F.count("*").alias("size")), "part").select("part", "whole", share.alias("containment")).where(F.col("containment") >= least)


def query(spark, sf_dir: str) -> DataFrame:
    return sketch(spark.read.parquet(f"{sf_dir}/documents.parquet"))
