"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint is a 128-bit SimHash of its words (weight: the root of a word's count). Of it, 92 bits are four
segments of 23. Each segment is decoded to the indices of its nearby Golay codewords (one to six keys), so that segments with at
most two errors share a key; every pair of segments gives keys of 24 bits. By the pigeonhole, fingerprints at most 8 bits apart in
the segments have two segments of at most two errors each and meet; most of those somewhat further apart meet too. Those that meet
are verified on all bits. Groups are the connected components.

Equal fingerprints are joined first, so that thousands of exact copies cost what one does, and groups are made of fingerprints, not of
documents. Keys travel packed in blobs, one for each target partition, and a partition compares what meets in it: nothing of size is
sent to the driver or broadcast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import golay
from .shared import BLOBS, Batches, blob_rows, exchange, free_name, parts_for, released, rows_of, small, written
from .text import U64, mix64, word_chunks

SEGMENTS = 4
PAIRS = tuple(combinations(range(SEGMENTS), 2))
#: Bits of 128 in which near-duplicates may differ.
MOST_BITS = 18
#: Fingerprints that share a key are compared all with all up to this many; more are searched breadth-first, which finds the same components.
WIDE_RUN = 24
#: Bytes of fingerprints whose keys a worker makes at once.
KEY_STEP = 1 << 18


def fingerprints(data_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) words of SimHash, and which texts have words."""
    out, some = np.zeros((len(data_column), 2), U64), np.zeros(len(data_column), bool)
    for row, w in word_chunks(data_column):
        count = len(w.first) - 1
        for a in range(0, count, 1 << 15):
            b = min(count, a + (1 << 15))
            lo, hi = w.first[a], w.first[b]
            if lo == hi:
                continue
            doc = np.repeat(np.arange(b - a, dtype=U64), np.diff(w.first[a : b + 1]))
            key = np.sort((doc << U64(48)) | (w.hashes[lo:hi] >> U64(16)))
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            weight = np.sqrt(np.diff(np.append(at, len(key)))).astype(np.float32)
            word = mix64(key[at] & U64((1 << 48) - 1))
            both = np.stack((word, mix64(word ^ U64(0x5851F42D4C957F2D))), axis=1)
            doc = (key[at] >> U64(48)).astype(np.int64)
            first = np.searchsorted(doc, np.arange(b - a + 1))
            for k in range(b - a):
                i, j = first[k], first[k + 1]
                if i < j:
                    bits = np.unpackbits(both[i:j].view(np.uint8), axis=1).astype(np.float32)
                    total = weight[i:j] @ bits
                    out[row + a + k] = np.packbits(total * 2 > weight[i:j].sum()).view(U64)
                    some[row + a + k] = True
    return out, some


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as it is, null or not), hi, lo of each row with words."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_fingerprint(base, "text", "hi", "lo").where("hi is not null").select("doc_id", "hi", "lo")


def with_fingerprint(docs: DataFrame, text_col: str, hi: str, lo: str) -> DataFrame:
    """docs with their fingerprints' two words, null for texts without words."""
    place = docs.columns.index(text_col)

    def step(b: pa.RecordBatch):
        fp, some = fingerprints(b.column(place))
        words = [pa.array(fp[:, k].view(np.int64) if len(fp) else np.zeros(0, np.int64), mask=~some) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*b.columns, *words], [*b.schema.names, hi, lo])

    def run(batches: Batches) -> Batches:
        return rows_of(batches, step)

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(hi, "long").add(lo, "long"))


def key_matrix(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint, -1 for none: a pair of segments (3 bits) and an index of each of the two."""
    hi, lo = hi.view(U64), lo.view(U64)
    mask = U64((1 << 23) - 1)
    segments = np.stack((hi & mask, (hi >> U64(23)) & mask, lo & mask, (lo >> U64(23)) & mask), axis=1).astype(np.int32)
    k = golay.keys(segments)
    cols = []
    for p, (i, j) in enumerate(PAIRS):
        a, b = k[:, i, :, None], k[:, j, None, :]
        cols.append(np.where((a < 0) | (b < 0), -1, (p << 24) | (a << 12) | b).reshape(len(k), 36))
    return np.concatenate(cols, axis=1)


def split_bits(parts: int) -> int:
    """Low bits of a key that don't decide its partition: as many as leave some groups of keys to each partition, up to one segment's."""
    return max(0, min(12, 24 - (4 * parts).bit_length()))


def key_blobs(hi: np.ndarray, lo: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Keys and fingerprints for each partition. Keys that differ in their second index only go to one partition, so that a fingerprint
    goes to some 30 partitions at most. Packed: numbers of fingerprints and groups; these; groups of each; groups; keys of each; second indices."""
    keys = key_matrix(hi, lo)
    row, _ = np.nonzero(keys >= 0)
    keys = keys[keys >= 0]
    part = (mix64((keys >> split_bits(parts)).astype(U64)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")  # rows stay in order, and so do groups in a row
    row, keys, part = row[order], keys[order], part[order]
    cut = np.searchsorted(part, np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(cut)):
        r, k = row[cut[p] : cut[p + 1]], keys[cut[p] : cut[p + 1]]
        head = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] >> 12 != k[:-1] >> 12))))
        first = np.flatnonzero(np.concatenate(([True], r[head][1:] != r[head][:-1])))
        own = r[head][first]
        groups, per = np.diff(np.append(first, len(head))), np.diff(np.append(head, len(r)))
        parts_of = (np.array([len(own), len(head)], np.int64), hi[own], lo[own], groups.astype(np.uint8), (k[head] >> 12).astype(np.uint16), per.astype(np.uint8), (k & 4095).astype(np.uint16))
        out.append((int(p), b"".join(x.tobytes() for x in parts_of)))
    return out


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints (n, 2), and of each of their keys the row and the key."""
    n, m = np.frombuffer(blob, np.int64, 2).tolist()
    take = lambda kind, at, count: np.frombuffer(blob, kind, count, at)
    hi, lo, groups = take(np.int64, 16, n), take(np.int64, 16 + 8 * n, n), take(np.uint8, 16 + 16 * n, n)
    group, per, second = take(np.uint16, 16 + 17 * n, m), take(np.uint8, 16 + 17 * n + 2 * m, m), take(np.uint16, 16 + 17 * n + 3 * m, -1)
    row = np.repeat(np.repeat(np.arange(n), groups), per)
    return np.stack((hi, lo), axis=1), row, (np.repeat(group.astype(np.int32), per) << 12) | second


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ. Words are compared unsigned: of a negative number numpy counts the bits of its absolute value."""
    return np.bitwise_count(a.view(U64) ^ b.view(U64)).sum(axis=-1, dtype=np.int16)


def links(fp: np.ndarray, rows: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """Verified links (pairs of rows of fp, which are in order and unlike) that connect whatever is within `most` bits and shares a key.
    rows and keys: those that have each other."""
    both = np.sort((keys.astype(np.int64) << 32) | rows)
    order, keys = both & 0xFFFFFFFF, both >> 32
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(keys)))
    found = [np.zeros(0, np.int64)]
    wide = size > WIDE_RUN
    left = np.repeat(np.where(wide, 0, at + size), size) - np.arange(len(keys))  # rows to the end of a run that isn't wide
    i = np.flatnonzero(left > 1)
    for d in range(1, WIDE_RUN):
        i = i[left[i] > d]
        if not len(i):
            break
        a, b = order[i], order[i + d]
        ok = distance(fp[a], fp[b]) <= most
        found.append((a[ok] << 32) | b[ok])
    for s, n in zip(at[wide], size[wide]):
        rest = order[s : s + n]
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                a = todo.pop()
                near = distance(fp[a], fp[rest]) <= most
                new = rest[near]
                found.append((np.full(len(new), a) << 32) | new)
                todo.extend(new.tolist())
                rest = rest[~near]
    pairs = np.unique(np.concatenate(found))
    return np.stack((pairs >> 32, pairs & 0xFFFFFFFF), axis=1)


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """The least of what each of n nodes is connected with by pairs."""
    root = np.arange(n)
    while True:
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def links_table(distinct: DataFrame, most: int, parts: int) -> DataFrame:
    """a_hi, a_lo, b_hi, b_lo: distinct fingerprints (hi, lo) with the least one that links of their partition lead to: as many rows as have
    one, however many links there are, and together they connect what the links do."""

    def spread(batches: Batches) -> Batches:
        return rows_of(batches, lambda b: iter([blob_rows(key_blobs(b.column(0).to_numpy(), b.column(1).to_numpy(), parts))]), KEY_STEP)

    def meet(batches: Batches) -> Batches:
        got = [unpacked(x.as_buffer().to_pybytes()) for b in batches for x in b.column(1)]
        if not got:
            return
        before = np.cumsum([0] + [len(g[0]) for g in got])
        every = np.concatenate([g[0] for g in got])
        order = np.lexsort((every[:, 1], every[:, 0]))  # the least fingerprint of a run is what others link to
        new = np.concatenate(([True], (every[order][1:] != every[order][:-1]).any(axis=1)))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        fp = every[order[new]]
        pairs = links(fp, place[np.concatenate([g[1] + k for g, k in zip(got, before)])], np.concatenate([g[2] for g in got]), most)
        root = forest(pairs, len(fp))
        node = np.flatnonzero(root != np.arange(len(fp)))
        rows = np.concatenate((fp[root[node]], fp[node]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["a_hi", "a_lo", "b_hi", "b_lo"])
        released()

    sent = distinct.select("hi", "lo").mapInArrow(spread, BLOBS)
    return exchange(sent, parts).mapInArrow(meet, "a_hi bigint, a_lo bigint, b_hi bigint, b_lo bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for each node of the edges (a, b) that isn't a root itself.

    Alternates large and small stars (Kiveris et al., 2014), each round to a table in the shared folder, until nothing changes. Least
    neighbours are aggregates (combined before they travel) that join the edges, so that Spark can split the edges of a hub.
    """

    def with_least(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("m", "u"))

    state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        starred = with_least(large)
        step = starred.select("u", F.col("m").alias("v")).unionByName(starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        state = written(step.where("u <> v").distinct(), "stars")


def groups(docs: DataFrame, most: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: doc_id, hi, lo of each row with words; hi, lo, root, keeper (the group's least id, null if it has none) of each
    fingerprint; doc_id of ids with several rows."""
    spark = docs.sparkSession
    prints = written(fingerprint_table(docs, id_col, text_col), "simhash")
    heads = written(prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("head")), "heads")
    found = links_table(heads, most, parts_for(docs))
    fp = lambda hi, lo: F.concat_ws("-", F.hex(hi), F.hex(lo))
    per = prints.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(fp("hi", "lo")).alias("a"), F.max(fp("hi", "lo")).alias("z"))
    several = written(per.where("n > 1"), "several")
    tied = prints.join(several.where("a <> z").select("doc_id", "a"), "doc_id").select("a", fp("hi", "lo").alias("b"))  # one id, unlike texts
    roots = components(found.select(fp("a_hi", "a_lo").alias("a"), fp("b_hi", "b_lo").alias("b")).unionByName(tied))
    of = heads.withColumn("node", fp("hi", "lo")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = written(of.select("hi", "lo", "root", "head"), "rooted")
    least = of.groupBy("root").agg(F.min("head").alias("keeper"))
    return prints, written(of.join(least, "root").select("hi", "lo", "root", "keeper"), "groups"), several.select("doc_id")


def duplicates(docs: DataFrame, most: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, duplicate_of: a row for each document that isn't the one that stays (least id) of its group.

    Null, empty and wordless texts and null ids are in no group; texts of any length are read whole. Rows of one id are one
    document; if their texts differ, it is in the groups of all of them, which join. Ids may be of any type that has an order. Ties go
    to the least id; extra columns are left out; an empty table gives an empty result.
    """
    return _gone(*groups(docs, most, id_col, text_col)[:2]).select("doc_id", F.col("keeper").alias("duplicate_of"))


def _gone(prints: DataFrame, of: DataFrame) -> DataFrame:
    return prints.join(of, ["hi", "lo"]).where("doc_id <> keeper").select("doc_id", "keeper").distinct()


def keep_one(docs: DataFrame, most: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of docs: of the least id, and of several rows with that id, or of a group without ids, the least
    in text, then in a hash of all columns. Rows without words all stay; columns are as they were."""
    prints, of, several = groups(docs, most, id_col, text_col)
    gone = written(_gone(prints, of).select("doc_id"), "gone")
    hi, lo, group = (free_name(docs, x) for x in ("hi", "lo", "group"))
    at = F.col(id_col)
    # most rows are told by their id; those without one, and of ids with several rows, by their place in the group
    doubtful = small(written(several.join(gone, "doc_id", "left_anti"), "doubtful"))
    plain = docs.join(small(gone.unionByName(doubtful.select("doc_id"))), at == F.col("doc_id") if id_col != "doc_id" else "doc_id", "left_anti").where(at.isNotNull())
    odd = docs.join(doubtful.withColumnRenamed("doc_id", group), at == F.col(group), "left_semi").unionByName(docs.where(at.isNull()))
    odd = with_fingerprint(odd, text_col, hi, lo)
    named = of.select(F.col("hi").alias(hi), F.col("lo").alias(lo), F.col("root").alias(group), "keeper" if "keeper" not in docs.columns else F.col("keeper").alias(free_name(docs, "keeper")))
    keeper = F.col(free_name(docs, "keeper"))
    met = odd.join(named, [hi, lo]).where(at.eqNullSafe(keeper))
    whole = F.struct(*(F.col(c) for c in docs.columns))
    comparable = F.struct(F.col(text_col).alias("t"), F.xxhash64(*(F.col(c) for c in docs.columns if not _has_map(docs.schema[c].dataType))).alias("h"))
    one = met.groupBy(group).agg(F.min_by(whole, comparable).alias("row")).select("row.*")
    return plain.unionByName(one).unionByName(odd.where(F.col(hi).isNull()).select(docs.columns))


def _has_map(kind) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
