"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary: the texts of a bounded sample of labelled rows, whole. A text is lower-cased, cut into
blocks (so that the dictionary counts in a long text as in a short one) and compressed whole with every dictionary. The smallest
total wins; a margin to the runner-up below `margin` of the runner-up's size rejects.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Batches, rows_of, typed
from .text import buffers, lowered


def dictionaries(docs: DataFrame, sample_docs: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each label of lang_col: the whole lower-cased texts of its sample, the nearest (the last, whose matches are
    cheapest) those of the greatest hash.

    The only bound on training data: of each language the sample_docs rows whose hashed id is least; ids with several rows count
    once a row. Rows without label, id or text don't train; no labelled row: no dictionary.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("label"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    order = Window.partitionBy("label").orderBy("h", "id", "k")  # cut to sample_docs within each task before anything travels
    ids = known.select("label", "id", F.xxhash64(F.col("id").cast("string")).alias("h"), F.xxhash64("t").alias("k"))
    chosen = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs).select("label", "id", "h", "k").distinct()
    rows = known.withColumn("k", F.xxhash64("t")).join(F.broadcast(chosen), ["label", "id", "k"]).distinct().collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["label"], r["h"], r["t"])):
        out[r["label"]] = out.get(r["label"], b"") + r["t"].lower().encode() + b"\n"
    return dict(sorted(out.items()))


def identify(docs: DataFrame, dicts: dict[str, bytes], margin: float = 0.02, level: int = 9, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang (null when rejected), runner_up, size, margin, accepted: a row for every row of docs, extra columns left out.

    Null and empty texts have size 0, margin 0 and are rejected, as are ties; long texts are compressed to their end; with a single
    dictionary the margin is 1 for any text; with none all is rejected with null size. Ids stay as they are, null or not; repeated
    rows are judged each, alike. An empty table gives an empty result.
    """

    def run(batches: Batches) -> Batches:
        coders = []
        for name, data in sent.value.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append((name, zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False).compress))

        def step(b: pa.RecordBatch):
            data, off = buffers(lowered(b.column(1)))
            raw, cols = memoryview(data), ([], [], [], [], [])
            for i in range(b.num_rows):
                blocks = [raw[k : min(k + block, off[i + 1])] for k in range(off[i], off[i + 1], block)]
                sizes = sorted((sum(len(c(x)) for x in blocks), name) for name, c in coders)
                best = sizes[0][0] if sizes else None
                second = sizes[1] if len(sizes) > 1 else (0, None)
                gap = (second[0] - best) / second[0] if second[0] else float(len(sizes) == 1 and best > 0)
                good = gap >= margin and gap > 0
                for col, x in zip(cols, (sizes[0][1] if good else None, second[1], best, gap, good)):
                    col.append(x)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], ["doc_id", "lang", "runner_up", "size", "margin", "accepted"])

        return rows_of(batches, step)

    sent = docs.sparkSession.sparkContext.broadcast(dicts)  # a bounded sample
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, typed(base, "doc_id", "lang string, runner_up string, size long, margin double, accepted boolean"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, dictionaries(docs))
