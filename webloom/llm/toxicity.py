"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning, 2012).

Features are the n-grams of 3 to 6 characters inside words, word edges included, hashed; a document has a feature or not. Every
feature of the labelled documents counts, its value being its log-count ratio between toxic and other documents; logistic regression
over the scaled features is fitted by conjugate gradients. As its weights are sums over documents, the fit holds one number a document,
and ranges of features are worked on by tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import BLOBS, Batches, blob_rows, exchange, free_name, least_type, mapped, new_place, packed, released, rows_of, save, unpacked, written
from .text import chunks, lowered

ORDERS = (3, 4, 5, 6)
BITS = 22
#: Ranges of features whose counts are added up apart.
RANGES = 16
#: Of each label at most so many rows (those whose hashed id is least) are trained on: the only bound on training data.
TRAIN_ROWS = 8000
#: Weight of the squared weights in the fit.
L2 = 0.5


@cache
def _letters() -> np.ndarray:
    t = np.array([chr(i).isalnum() for i in range(0x10000)])
    t[0x300:0x370] = True  # combining marks belong to words
    return t


def codes(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, code points of lower-cased texts with 0 for whatever isn't in a word, and where each text begins (n + 1); a 0 is before and after each text."""
    texts = lowered(arr).to_pylist()
    sizes = np.array([len(t or "") + 1 for t in texts])
    off = np.concatenate(([0], np.cumsum(sizes)))
    for a, b in chunks(off, 1 << 16):
        c = np.frombuffer(("\0" + "\0".join([t or "" for t in texts[a:b]]) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        table = _letters()
        c[~table[np.minimum(c, 0xFFFF)]] = 0
        yield a, c, off[a : b + 1] - off[a]


def hits(c: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) of each n-gram, in order."""
    zeros = np.concatenate(([0], np.cumsum(c == 0)))
    h = c.copy()
    kind = np.uint32 if len(off) - 1 <= 1 << (32 - BITS) else np.int64  # of text and feature in one
    of = np.repeat(np.arange(len(off) - 1).astype(kind) << kind(BITS), np.diff(off))
    of = np.concatenate((of, of[-1:]))
    found = []
    for n in range(2, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + c[n - 1 :]
        if n in ORDERS:
            feature = ((h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            ok = zeros[n - 1 : n - 1 + m] == zeros[1 : m + 1]  # no word edge inside
            at = np.flatnonzero(ok)
            found.append(of[at] | feature[at])
    key = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    key = key[new]
    return (key >> BITS).astype(np.int64), (key & kind((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    """features: sorted hashed n-grams; weights: of each, ratio times coefficient; bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def scores(self, arr: pa.Array) -> np.ndarray:
        """Log-odds that each text is toxic, over its whole length."""
        out = np.full(len(arr), self.bias)
        if not len(self.features):
            return out
        if self.table is None:
            self.table = np.zeros(1 << BITS, np.float32)
            self.table[self.features] = self.weights
        for row, c, off in codes(arr):
            doc, feature = hits(c, off)
            out[row : row + len(off) - 1] += np.bincount(doc, self.table[feature], len(off) - 1)
        return out


def fit(times: Callable[[np.ndarray], np.ndarray], y: np.ndarray, l2: float, rounds: int = 60, tolerance: float = 3e-3) -> tuple[np.ndarray, float]:
    """Coefficients a of documents and bias: logistic regression whose weights of features are x.T @ a, so that times(v) = x @ x.T @ v is all
    that is asked of the scaled features x. Conjugate gradients (Polak and Ribiere) with Newton's steps along each direction."""
    n = len(y)
    a, s, bias = np.zeros(n), np.zeros(n), float(np.log(y.sum() / (n - y.sum())))
    d = kd = g_old = kg_old = np.zeros(n)
    db = gb_old = first = 0.0
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(s + bias, -40, 40)))
        g = p - y
        kg, gb = times(g) + l2 * s, g.sum()
        g = g + l2 * a
        size = g @ kg + gb * gb
        first = first or size
        if size <= tolerance**2 * first:
            break
        old = g_old @ kg_old + gb_old * gb_old
        beta = max(0.0, (size - g @ kg_old - gb * gb_old) / old) if k else 0.0
        d, kd, db = beta * d - g, beta * kd - kg, beta * db - gb
        if g @ kd + gb * db >= 0:  # no way down: begin anew
            d, kd, db = -g, -kg, -gb
        t = 0.0
        for _ in range(20):
            q = 1 / (1 + np.exp(-np.clip(s + t * kd + bias + t * db, -40, 40)))
            along = kd + db
            slope = (q - y) @ along + l2 * (a @ kd + t * (d @ kd))
            step = slope / ((q * (1 - q)) @ (along * along) + l2 * (d @ kd) + 1e-12)
            t = max(t - step, 0.0)
            if abs(step) < 1e-4 * max(t, 1e-9):
                break
        a, s, bias = a + t * d, s + t * kd, bias + t * db
        g_old, kg_old, gb_old = g, kg, gb
    return a, float(bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, smooth: float = 1.0, l2: float = L2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled documents, at most `rows` of either label, with all their n-grams; the bias is set right for what each
    label's rows were cut by, so that scores hold at the labels' own shares. Rows without id, label or text don't train, nor do ids with
    both labels; with one label only, or none, the model finds nothing toxic.

    Ranges of features lie in files of the shared folder. In each step of the fit, every range tells what its features give the
    documents: a number each, which is all that the driver gathers.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast(kind).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("top")).where("y = top and y in (0, 1)")
    labelled = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    cut_by = [max(labelled.get(v, 0) / max(rows, 1), 1.0) for v in (0, 1)]
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = [known.where(F.col("y") == v).orderBy(order, "id").limit(rows).select("id", F.lit(v).alias("y")) for v in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * rows pairs at most
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("length(t) > 0").join(chosen, "id").select("t", "y", F.xxhash64("id", "t").alias("h"))
    base = written(base.withColumn("at", F.monotonically_increasing_id()), "labelled")  # bounded by rows: what follows reads no other documents
    listed = sorted((r["h"], r["at"], r["y"]) for r in base.select("h", "at", "y").collect())
    y = np.array([x[2] for x in listed], np.float64)
    n, positive = len(y), float(y.sum())
    if not 0 < positive < n:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -40.0)
    at = np.array([x[1] for x in listed])
    by = np.argsort(at)
    place = new_place(spark, "features")
    sent = spark.sparkContext.broadcast((at[by], by, y))  # of 2 * rows documents

    def grams(batches: Batches) -> Batches:
        places, numbers, _ = sent.value

        def step(b: pa.RecordBatch):
            own = numbers[np.searchsorted(places, b.column(1).to_numpy())]
            for row, c, off in codes(b.column(0)):
                doc, feature = hits(c, off)
                part = feature // ((1 << BITS) // RANGES)
                order = np.argsort(part, kind="stable")  # within a range by document, then feature
                cut = np.searchsorted(part[order], np.arange(RANGES + 1))
                out = []
                for p in np.flatnonzero(np.diff(cut)):
                    k = order[cut[p] : cut[p + 1]]
                    first = np.flatnonzero(np.concatenate(([True], doc[k][1:] != doc[k][:-1])))
                    of = own[row + doc[k][first]].astype(np.uint32)
                    out.append((int(p), packed(of, np.diff(np.append(first, len(k))).astype(np.uint32), np.diff(feature[k].astype(np.uint32), prepend=np.uint32(0)))))
                yield blob_rows(out)

        return rows_of(batches, step)

    def ranges(batches: Batches) -> Batches:
        got: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                of, size, gaps = unpacked(x.as_buffer().to_pybytes(), *[np.uint32] * 3)
                got.setdefault(p, []).append((np.cumsum(gaps, dtype=np.uint32).astype(np.int64) << 32) | np.repeat(of, size))
        for p, each in got.items():
            key = np.sort(np.concatenate(each))
            doc, feature = key & 0xFFFFFFFF, key >> 32
            first = np.flatnonzero(np.concatenate(([True], feature[1:] != feature[:-1])))
            toxic_in = np.add.reduceat(sent.value[2][doc], first)
            all_in = np.diff(np.append(first, len(doc)))
            ratio = np.log((toxic_in + smooth) / (positive + 2 * smooth)) - np.log((all_in - toxic_in + smooth) / (n - positive + 2 * smooth))
            for name, x in (("feature", feature[first].astype(np.int32)), ("first", first), ("doc", doc.astype(least_type(n))), ("square", (ratio * ratio).astype(np.float32))):
                save(place, f"{name}-{p}", x)
            yield blob_rows([(p, b"")])
        released()

    exchange(base.select("t", "at").mapInArrow(grams, BLOBS), RANGES).mapInArrow(ranges, BLOBS).count()

    def in_ranges(told: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray], v: np.ndarray) -> list[tuple[int, bytes]]:
        """Of each range what told(range, weights by ratios squared, first entries, documents of entries) says of coefficients v."""

        def run(batches: Batches) -> Batches:
            for b in batches:
                for p in b.column(0).to_pylist():
                    first = mapped(place, f"first-{p}")
                    if first is not None:
                        doc = mapped(place, f"doc-{p}")
                        weight = np.add.reduceat(v[doc], first) * mapped(place, f"square-{p}")
                        yield blob_rows([(p, told(p, weight, first, doc).tobytes())])

        found = spark.range(0, RANGES, 1, RANGES).mapInArrow(run, BLOBS).collect()
        return sorted((r["part"], bytes(r["blob"])) for r in found)

    def times(v: np.ndarray) -> np.ndarray:
        said = in_ranges(lambda p, w, first, doc: np.bincount(doc, np.repeat(w, np.diff(np.append(first, len(doc)))), n), v)
        return sum(np.frombuffer(x) for _, x in said)

    a, bias = fit(times, y, l2)
    # a weight of each n-gram: 2 ** BITS at most
    said = in_ranges(lambda p, w, first, doc: np.concatenate((mapped(place, f"feature-{p}").astype(np.int32), w.astype(np.float32).view(np.int32))), a)
    each = [np.frombuffer(x, np.int32).reshape(2, -1) for _, x in said]
    features, weights = (np.concatenate(x) for x in zip(*each))
    return Model(features.astype(np.int64), weights.view(np.float32), bias + float(np.log(cut_by[1] / cut_by[0])))


def with_score(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    place = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of 2 ** BITS features at most

    def step(b: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.scores(b.column(place)))], [*b.schema.names, name])

    def run(batches: Batches) -> Batches:
        return rows_of(batches, step)

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, "double"))


def toxic(docs: DataFrame, model: Model, threshold: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as it is), score (log-odds): a row for each row of docs whose score is over threshold; a score at the threshold isn't toxic.

    Null and empty texts have the bias as score; long texts are read whole. Null ids and repeated rows are judged each, equal texts
    alike; extra columns are left out; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_score(base, model, "text", "score").where(F.col("score") > threshold).select("doc_id", "score")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of docs that toxic() doesn't list, all columns as they were."""
    name = free_name(docs, "score")
    return with_score(docs, model, text_col, name).where(F.col(name) <= threshold).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
