"""The corpus pipeline: from raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents; where texts change, n_chars follows. What holds for all stages: null ids, null and empty texts are
kept and never an error; long texts are read whole; other columns, whatever their names, stay as they are; an empty table stays
empty; nothing depends on partitions or on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontaminate, mixing, near_dedup, pii, toxicity
from webloom.llm.shared import new_place


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text has them; a null text keeps what it had."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that a classifier, trained on the labelled ones, finds toxic: those of a score over 0; a score of 0 stays. Each of
    repeated rows is judged alike. Null and empty texts have the bias as score. With labels of one kind only, or none, all stay."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id. Of repeated rows, and of rows without an id, one stays too, the
    least in text, then in a hash of all columns; texts without words are in no group and all stay."""
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With phrases of the benchmark cut out of the texts: all rows stay, each of repeated ones cut alike. Spans that overlap or touch are
    one, so that there are no ties; a benchmark that is empty, or of null or wordless texts, cuts nothing."""
    return _counted(decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With private values replaced by their kinds: all rows stay, each of repeated ones changed alike. Of kinds that are equally likely
    the first in pii.KINDS is taken."""
    return _counted(pii.redacted(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' weights want, with copy_no (1 to the copies). Rows of one id are drawn alike, null ids as one id;
    a null source is a source; a null text counts no tokens. A draw that equals the fraction gives no copy."""
    return mixing.mix(docs, mixing.WEIGHTS)


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("decontamination", decontaminated), ("private_data", redacted), ("mixing", mixed)]

#: Classifiers, fingerprints and networks are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = new_place(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
