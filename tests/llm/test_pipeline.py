from collections import Counter

import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from webloom.llm import mixing, pii, toxicity

from . import brute
from .cases import LONG, awkward

DATA = "/root/testdata/sf0.001"


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [r for r, s in zip(rows, model.scores(pa.array([r["text"] for r in rows]))) if s <= 0]
    group = brute.near_groups([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if group.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]
    phrases = brute.benchmark_phrases([r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()], 8, 4)
    for r in rows:
        r["text"] = brute.cut(r["text"], brute.contaminated(r["text"], phrases))
        for a, b, k in reversed(pii.spans_in([r["text"]], pii.train(), bound=False).get(0, [])):
            r["text"] = r["text"][:a] + f"[{pii.KINDS[k].upper()}]" + r["text"][b:]
        r["n_chars"] = len(r["text"])
    copies = brute.mixed([(r["doc_id"], r["source"], r["text"]) for r in rows], mixing.WEIGHTS, mixing.SEED)
    want = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], k + 1) for r, (_, n) in zip(rows, copies) for k in range(n))
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == [*docs.columns, "copy_no"]
    assert Counter(map(tuple, got.collect())) == want
    assert 0 < len(rows) < docs.count()


def test_stages_take_awkward_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "some words", None, None, 10)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, docs.limit(0)):
            got = stage(spark, table, DATA)
            assert got.columns[: len(docs.columns)] == docs.columns, name
            assert got.count() <= 4 * table.count()


def test_stages_take_long_texts_and_any_columns(spark):
    table = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, table, DATA)
        assert got.columns[: len(table.columns)] == table.columns, name
        rows = got.collect()
        assert name != "near_duplicates" or len(rows) == table.count() - 1  # one row is there twice
        if name in ("decontamination", "private_data", "toxicity"):
            assert len(rows) == table.count() and LONG in {r.text for r in rows}, name
            assert len({tuple(r) for r in rows if r.doc_id == 1}) == 1, name


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
