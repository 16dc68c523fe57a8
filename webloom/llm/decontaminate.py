"""Benchmark decontamination: an FM-index of each shard of the training data is searched for the test phrases.

Every run of `n` words of a benchmark text (a shorter text: all its words) is a phrase. Each task joins its documents to shards
of about shard_words words, builds a shard's FM-index over words once, searches the phrases backward, a block of many at once, locates
their occurrences from sampled suffix positions and merges the spans. Phrases lie in the shared folder, in blocks of bounded size that
tasks map into memory; documents aren't shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .fm_index import FMIndex
from .shared import BLOBS, Batches, blob_rows, exchange, free_name, mapped, new_place, rows_of, save
from .text import U64, char_at, mix64, word_chunks

SPANS = "array<struct<start:int,end:int>>"
#: Words of phrases in a block: a larger benchmark has more blocks, and tasks search for one after the other.
PHRASE_WORDS = 4_000_000
#: Bytes of text that a task takes at once, so that shards come near shard_words.
SHARD_BYTES = 8 << 20


def phrases_of(texts: pa.Array, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases (word hashes, a row of n each, zeros after a shorter one) and their lengths."""
    rows = []
    for _, w in word_chunks(texts):
        for a, b in zip(w.first[:-1], w.first[1:]):
            h = w.hashes[a:b]
            if len(h) >= n:
                rows.append(np.lib.stride_tricks.sliding_window_view(h, n))
            elif len(h) >= least:
                rows.append(np.pad(h, (0, n - len(h)))[None])
    all_rows = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, n), U64)
    return all_rows, (all_rows != 0).sum(axis=1)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, sorted, with those that overlap or touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    big = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * big + end)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * big + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:] - 1, [len(doc) - 1]))
    return doc[at], start[at], reach[last] - doc[at] * big


def shards(arr: pa.Array, shard_words: int):
    """Runs of an array's documents of about shard_words words: first row, then their words' hashes, starts, ends (bytes in the lower-cased text of its chunk) and chunks."""
    held, words_held = [], 0
    for row, w in word_chunks(arr):
        held.append((row, w))
        words_held += len(w.hashes)
        if words_held >= shard_words:
            yield held
            held, words_held = [], 0
    if held:
        yield held


def find(arr: pa.Array, blocks: list[tuple[np.ndarray, np.ndarray]], shard_words: int) -> dict[int, list[tuple[int, int]]]:
    """Row to its merged spans in characters, of an array of texts. blocks: phrases and lengths, best mapped from files: a shard's index is
    built once and searched for one block after the other."""
    out: dict[int, list[tuple[int, int]]] = {}
    for held in shards(arr, shard_words):
        first = np.concatenate([[0], *(np.diff(w.first) for _, w in held)]).cumsum()
        index = FMIndex(np.concatenate([w.hashes for _, w in held]), first)
        got = [np.zeros((3, 0), np.int64)]
        for phrases, lengths in blocks:
            low, high = index.search(index.symbols(np.asarray(phrases)), np.asarray(lengths))
            count = high - low
            hit = np.flatnonzero(count)
            if len(hit):
                rows = np.repeat(low[hit] - np.concatenate(([0], count[hit].cumsum()[:-1])), count[hit]) + np.arange(count[hit].sum())
                doc, word = index.locate(rows)
                got.append(np.stack(merged(doc, word, word + np.repeat(lengths[hit], count[hit]))))
        doc, start, end = merged(*np.concatenate(got, axis=1))
        if not len(doc):
            continue
        begin = np.cumsum([0] + [len(w.first) - 1 for _, w in held])
        cut = np.append(np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))), len(doc))
        for i, j in zip(cut[:-1], cut[1:]):
            k = int(np.searchsorted(begin, doc[i], "right")) - 1
            row, w = held[k]
            local = int(doc[i] - begin[k])
            a, b = w.offsets[local], w.offsets[local + 1]
            at = w.first[local]
            chars = char_at(w.data[a:b], np.stack((w.starts[at + start[i:j]], w.ends[at + end[i:j] - 1])) - a)
            out[row + local] = list(zip(*chars.tolist()))
    return out


def phrase_blocks(benchmark: DataFrame, n: int, least: int, text_col: str) -> tuple[str, int]:
    """Where the phrases are and how many blocks of them: distinct phrases, each in the block of its hash, about PHRASE_WORDS words a block.
    Tasks write them to the shared folder; none are sent to the driver."""
    spark = benchmark.sparkSession
    texts = benchmark.where(F.length(text_col) > 0).select(F.col(text_col).alias("t"))
    size = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size * n // (6 * PHRASE_WORDS)))
    place = new_place(spark, "phrases")

    def spread(batches: Batches) -> Batches:
        def step(b: pa.RecordBatch):
            found = phrases_of(b.column(0), n, least)[0]
            part = (mix64(np.bitwise_xor.reduce(mix64(found + np.arange(n, dtype=U64)), axis=1)) % U64(blocks)).astype(np.int64) if len(found) else np.zeros(0, np.int64)
            yield blob_rows([(int(p), found[part == p].tobytes()) for p in np.unique(part)])

        return rows_of(batches, step)

    def meet(batches: Batches) -> Batches:
        got: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                got.setdefault(p, []).append(np.frombuffer(x.as_buffer().to_pybytes(), U64).reshape(-1, n))
        for p, each in got.items():
            rows = np.unique(np.concatenate(each), axis=0)
            save(place, f"words-{p}", rows)
            save(place, f"lengths-{p}", (rows != 0).sum(axis=1))
            yield blob_rows([(p, b"")])

    exchange(texts.mapInArrow(spread, BLOBS), blocks).mapInArrow(meet, BLOBS).count()
    return place, blocks


def spans_column(docs: DataFrame, blocks: tuple[str, int], shard_words: int, text_col: str, name: str) -> DataFrame:
    """docs with a column of merged spans, null where there are none."""
    at = docs.columns.index(text_col)
    place, count = blocks

    def run(batches: Batches) -> Batches:
        each = [(mapped(place, f"words-{p}"), mapped(place, f"lengths-{p}")) for p in range(count)]
        each = [x for x in each if x[0] is not None]  # mapped, not read: memory holds what is being searched for

        def step(b: pa.RecordBatch):
            col = [None] * b.num_rows
            for row, spans in find(b.column(at), each, shard_words).items() if each else ():
                col[row] = [{"start": x, "end": y} for x, y in spans]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(col, kind)], [*b.schema.names, name])

        return rows_of(batches, step, SHARD_BYTES)

    schema = StructType([*docs.schema.fields]).add(name, StructType.fromDDL(f"x {SPANS}")["x"].dataType)
    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 8, least: int = 4, shard_words: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", bench_col: str = "text") -> DataFrame:
    """doc_id (as it is), spans (start, end in characters, in order, apart), n_chars_removed: a row for each row of docs that holds a phrase.

    Words are compared in lower case, whatever stands between them. Null, empty and wordless texts of either side match
    nothing, nor do benchmark texts of fewer than `least` words; long texts of either side are read whole; spans that overlap or touch
    are one, so that there are no ties. Null ids and repeated rows are kept as they are; an empty table of either side gives an empty
    result. Extra columns are left out.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = spans_column(base, phrase_blocks(benchmark, n, least, bench_col), shard_words, "text", "spans").where("spans is not null")
    return found.select("doc_id", "spans", F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"]).alias("n_chars_removed"))


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 8, least: int = 4, shard_words: int = 1 << 20, text_col: str = "text", bench_col: str = "text") -> DataFrame:
    """docs with the spans cut out of the texts: all rows and columns stay, other texts are untouched. Cases as for contaminated()."""
    name = free_name(docs, "spans")
    found = spans_column(docs, phrase_blocks(benchmark, n, least, bench_col), shard_words, text_col, name)
    spans, text = F.col(name), F.col(text_col)
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
    ends = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(text)))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(text, x["a"] + 1, x["b"] - x["a"])), "")
    return found.withColumn(text_col, F.when(spans.isNull(), text).otherwise(kept)).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
