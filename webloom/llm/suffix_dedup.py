"""Passages that stand at several places, in one document or in several, by suffix arrays through prefix-free parsing.

A passage of `length` words is known by its minimizer: of the rolling hashes of its runs of ANCHOR words the least one. Equal passages
have equal minimizers, and neighbouring passages mostly share one, so a document falls into cells: passages in a row with one
minimizer. Equal passages of one document are in different cells, too. The first pass finds the minimizers of several documents or
cells; only cells of these travel, each with its words, to the partition of its minimizer, where every passage equal to one of the
cell's is too.

There the cells' words are one text, parsed prefix-free: rolling-hash triggers cut it into phrases that overlap by TRIGGER words.
The suffix array of the distinct phrases (the dictionary) and that of the phrase numbers (the parse) combine into the order of the text's
suffixes: first by the rest of the phrase, then by the parse from the next phrase on. In that order equal passages are neighbours, and
those are equal that have `length` words in common with the suffix before them. Highly repetitive text has a small dictionary, and only
that is sorted by words. Groups of cells follow one another by their minimizers, so that the corpus has one order: by minimizer, then
by suffix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .fm_index import suffix_array
from .shared import BLOBS, Batches, blob_rows, exchange, mapped, new_place, parts_for, released, rows_of, save, written
from .text import U64, Words, mix64, powers, word_chunks

LENGTH = 50
#: Words of the runs whose least hash is a passage's minimizer; words of a trigger; one run in TRIGGER_EVERY is a trigger.
ANCHOR, TRIGGER, TRIGGER_EVERY = 10, 4, 8
#: Words that are parsed and sorted at once; cells of one minimizer are never parted.
GROUP_WORDS = 1 << 20
#: Bytes of texts of which equal cells are made one before they travel.
CELL_STEP = 16 << 20
#: Cells of one minimizer beyond which they are parted by what stands around it.
HOT_CELLS = 10_000
_PLACE_BITS = 30


def run_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n values in a row (n at most len(values))."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum((values + U64(1)) * up[: len(values)], out=sums[1:])
    return mix64((sums[n:] - sums[:-n]) * down[: len(values) - n + 1])


def window_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    wide = 1
    while wide * 2 <= n:
        x = np.minimum(x[:-wide], x[wide:])
        wide *= 2
    return np.minimum(x[: len(x) - (n - wide)], x[n - wide :]) if n > wide else x


def cells(w: Words, length: int) -> tuple[np.ndarray, ...]:
    """Document, first word, number of passages, minimizer and its first word of each cell. Words are counted over the whole chunk."""
    none = np.zeros(0, np.int64)
    if len(w.hashes) < length:
        return none, none, none, none.view(U64), none
    anchor = min(ANCHOR, length)
    h = run_hashes(w.hashes, anchor)
    mask = (1 << _PLACE_BITS) - 1
    order = (h >> U64(_PLACE_BITS) << U64(_PLACE_BITS)) | (mask - (np.arange(len(h)) & mask)).astype(U64)  # of equal hashes the last
    best = window_min(order, length - anchor + 1)
    counts = np.diff(w.first)
    start = np.arange(len(best))
    doc = np.repeat(np.arange(len(counts)), counts)[: len(best)]
    ok = start + length <= w.first[doc + 1]
    start, doc, best = start[ok], doc[ok], best[ok]
    if not len(start):
        return none, none, none, none.view(U64), none
    place = start + ((mask - (best & U64(mask)).astype(np.int64) - start) & mask)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.diff(np.append(at, len(start))), h[place[at]], place[at]


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each partition and the places of its keys, these in order."""
    part = (mix64(keys) % U64(parts)).astype(np.int64)
    order = np.lexsort((keys, part))
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), order[cut[p] : cut[p + 1]]


def shared_keys(docs: DataFrame, length: int, parts: int, within: bool = False) -> str:
    """Where the minimizers are that several documents have (within: or several cells of one), in sorted files by partition. Of a minimizer
    each step of a task sends the least and the greatest document, however many have it."""
    place = new_place(docs.sparkSession, "minimizers")

    def spread(batches: Batches) -> Batches:
        def step(b: pa.RecordBatch):
            ids = b.column(0).to_numpy()
            held = [(key, ids[row + doc]) for row, w in word_chunks(b.column(1)) for doc, _, _, key, _ in [cells(w, length)] if len(doc)]
            if held:
                key, doc = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                last = np.append(at[1:], len(key)) - 1
                more = last > at if within else doc[last] != doc[at]
                count = np.concatenate((last - at + 1, np.zeros(more.sum(), np.int64)))
                key, doc = np.concatenate((key[at], key[at[more]])), np.concatenate((doc[at], doc[last[more]]))
                yield blob_rows([(p, np.stack((key[k], doc[k].view(U64), count[k].view(U64))).tobytes()) for p, k in _by_part(key, parts)])

        return rows_of(batches, step)

    def meet(batches: Batches) -> Batches:
        each: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                each.setdefault(p, []).append(np.frombuffer(x.as_buffer().to_pybytes(), U64).reshape(3, -1))
        for p, got in each.items():
            key, doc, count = np.concatenate(got, axis=1)
            order = np.lexsort((doc, key))
            key, doc, count = key[order], doc[order], count[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            last = np.append(at[1:], len(key)) - 1
            several = last > at if within else doc[at] != doc[last]
            save(place, f"keys-{p}", key[at[several]])
            save(place, f"hot-{p}", key[at[several & (np.add.reduceat(count, at) > U64(HOT_CELLS))]])
            yield blob_rows([(p, b"")])
        released()

    exchange(docs.mapInArrow(spread, BLOBS), parts).mapInArrow(meet, BLOBS).count()
    return place


def is_in(place: str, name: str, key: np.ndarray, parts: int) -> np.ndarray:
    """Which minimizers are in the files of that name of shared_keys(), which are mapped into memory."""
    out = np.zeros(len(key), bool)
    for p, at in _by_part(key, parts):
        have = mapped(place, f"{name}-{p}")
        if have is not None and len(have):
            out[at] = have[np.minimum(np.searchsorted(have, key[at]), len(have) - 1)] == key[at]
    return out


def _between(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64((sums[b] - sums[a]) * down[a])


def parted(start: np.ndarray, count: np.ndarray, key: np.ndarray, place: np.ndarray, hot: np.ndarray, length: int, between) -> tuple[np.ndarray, ...]:
    """Of each cell that comes of it: which one it was, first word, number of passages and key. Hot cells fall into two: passages with some
    words before the minimizer, which all of them have and by which they are told, and others, which have some words after it."""
    anchor = min(ANCHOR, length)
    before = (length - anchor) // 2
    edge = np.clip(place - before + 1 - start, 0, count)  # passages that begin before it have those words before
    left, right = np.flatnonzero(hot & (edge > 0)), np.flatnonzero(hot & (edge < count))
    cool = np.flatnonzero(~hot)
    of_left = mix64(key[left] ^ between(place[left] - before, place[left]))
    of_right = mix64(~key[right] ^ between(place[right] + anchor, place[right] + length - before))
    which = np.concatenate((cool, left, right))
    first, size = np.concatenate((start[cool], start[left], (start + edge)[right])), np.concatenate((count[cool], edge[left], (count - edge)[right]))
    order = np.lexsort((first, which))
    return which[order], first[order], size[order], np.concatenate((key[cool], of_left, of_right))[order]


def cell_blobs(ids: np.ndarray, texts: pa.Array, wanted, hot, length: int, parts: int, within: bool) -> Iterator[pa.RecordBatch]:
    """Cells whose minimizer is wanted, packed for their partitions: number of cells; of each its minimizer, document, first word and passages; words.

    Of cells with equal words only those of the least document (within: the one at the least place) travel. Of the others it is
    known here that they stand elsewhere, and at a lesser place: they are sent as spans, -1 and arrays of document, kind, start and end.
    """
    held = []
    for row, w in word_chunks(texts):
        doc, start, count, key, place = cells(w, length)
        ok = wanted(key) if len(doc) else np.zeros(0, bool)
        if ok.any():
            doc, start, count, key, place = doc[ok], start[ok], count[ok], key[ok], place[ok]
            up, down = powers(len(w.hashes) + 1)
            sums = np.concatenate((np.zeros(1, U64), np.cumsum((w.hashes + U64(1)) * up[: len(w.hashes)], dtype=U64)))
            between = partial(_between, sums, down)
            which, start, count, key = parted(start, count, key, place, hot(key), length, between)
            doc = doc[which]
            content = between(start, start + count + length - 1) ^ mix64(count.astype(U64))
            held.append((w, ids[row + doc], start, start - w.first[doc], count, key, content))
    if not held:
        return
    own, first, count, content = (np.concatenate([h[k] for h in held]) for k in (1, 3, 4, 6))
    order = np.lexsort((first, own, content))
    new = np.concatenate(([True], content[order][1:] != content[order][:-1]))
    group = np.cumsum(new) - 1
    head = order[new][group]
    at_home = own[order] == own[head]
    at_head = at_home & (first[order] == first[head])
    told = ~(at_head if within else at_home)
    travels = np.zeros(len(order), bool)
    travels[order] = new if within else at_home
    known = np.concatenate((order[told], order[told], order[~told & (np.bincount(group, told)[group] > 0)]))
    if len(known):
        kind = np.concatenate((np.zeros(told.sum(), np.int64), np.ones(told.sum(), np.int64), np.zeros(len(known) - 2 * told.sum(), np.int64)))
        part = (mix64(own[known].view(U64)) % U64(parts)).astype(np.int64)
        spans = np.stack((own[known], kind, first[known], first[known] + count[known] + length - 1))
        yield blob_rows([(int(p), np.int64(-1).tobytes() + spans[:, part == p].tobytes()) for p in np.unique(part)])
    begin = 0
    for w, own, start, first, count, key, _ in held:
        go = np.flatnonzero(travels[begin : begin + len(own)])
        begin += len(own)
        short, out = (w.hashes >> U64(32)).astype(np.uint32), []
        for p, at in _by_part(key[go], parts):
            at = go[at]
            size = count[at] + length - 1
            words = short[np.repeat(start[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
            out.append((p, b"".join((np.int64(len(at)).tobytes(), key[at].tobytes(), own[at].tobytes(), first[at].astype(np.int32).tobytes(), count[at].astype(np.int32).tobytes(), words.tobytes()))))
        yield blob_rows(out)


def _unpacked(blob: bytes):
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    take = lambda kind, at, count: np.frombuffer(blob, kind, count, at)
    return take(U64, 8, n), take(np.int64, 8 + 8 * n, n), take(np.int32, 8 + 16 * n, n), take(np.int32, 8 + 20 * n, n), take(np.uint32, 8 + 24 * n, -1)


def parsed_order(words: np.ndarray, begin: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """suffixes (places in words; each of more than TRIGGER words to the end of its cell) in the order of what begins there, by
    prefix-free parsing. begin: where each cell begins, and the end of the last. Cells end with signs of their own."""
    n = len(words)
    vocabulary, ids = np.unique(words, return_inverse=True)
    ids = ids.astype(np.int64)
    # phrases begin at triggers and at cells; a phrase reaches TRIGGER words into the next, or to the end of the cell
    is_first = np.zeros(n + 1, bool)
    is_first[begin] = True
    cell_end = np.repeat(begin[1:], np.diff(begin))
    cut = is_first[:n].copy()
    if n >= TRIGGER:
        h = run_hashes(words.astype(U64), TRIGGER)
        cut[: len(h)] |= (h % U64(TRIGGER_EVERY) == 0) & (np.arange(len(h)) + TRIGGER < cell_end[: len(h)])
    start = np.flatnonzero(cut)
    nxt = np.append(start[1:], n)
    last = is_first[nxt]
    end = np.where(last, nxt, nxt + TRIGGER)
    # the dictionary: distinct phrases, told apart by hash, length and whether a cell ends there
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((words.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    between = lambda a, b: mix64((sums[b] - sums[a]) * down[a])
    print_ = between(start, end) ^ mix64((end - start).astype(U64) * U64(2) + last.astype(U64))
    _, example, phrase = np.unique(print_, return_index=True, return_inverse=True)
    size = (end - start)[example]
    d_off = np.concatenate(([0], np.cumsum(size + 1)))
    count = len(example)
    body = np.repeat(start[example] - d_off[:-1], size + 1) + np.arange(d_off[-1])
    d_text = np.empty(d_off[-1], np.int64)
    ends = d_off[1:] - 1
    inner = np.ones(d_off[-1], bool)
    inner[ends] = False
    d_text[inner] = ids[body[inner]] + count
    d_text[ends] = np.arange(count)
    d_order = suffix_array(d_text, count + len(vocabulary))
    # equal suffixes of phrases have one rank
    d_end = np.repeat(end[example], size + 1)
    left = (d_end - body)[d_order]
    mark = between(np.minimum(body, d_end), d_end)[d_order]
    new = np.ones(len(d_order), bool)
    new[1:] = (left[1:] != left[:-1]) | (mark[1:] != mark[:-1])
    rank = np.empty(len(d_order), np.int64)
    rank[d_order] = np.cumsum(new)
    # the parse: phrases by rank, each cell ended by a sign of its own
    by = np.argsort(rank[d_off[:-1]], kind="stable")
    name = np.empty(count, np.int64)
    name[by] = np.arange(count)
    n_cells = len(begin) - 1
    cell = np.searchsorted(begin, start, "right") - 1
    place = np.arange(len(start)) + cell
    parse = np.empty(len(start) + n_cells, np.int64)
    parse[place] = name[phrase] + n_cells
    stop = place[np.append(np.flatnonzero(np.diff(cell)), len(start) - 1)] + 1
    parse[stop] = np.arange(n_cells)
    parse_rank = np.empty(len(parse), np.int64)
    parse_rank[suffix_array(parse, n_cells + count)] = np.arange(len(parse))
    # both together
    j = np.searchsorted(start, suffixes, "right") - 1
    alpha = rank[d_off[phrase[j]] + suffixes - start[j]]
    return suffixes[np.lexsort((parse_rank[place[j] + 1], alpha))]


def prefix_runs(words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where in suffix order a new prefix of `length` words begins: where a suffix has less in common with the one before it. Words are
    compared one by one, of those pairs that are still alike."""
    new = np.ones(len(order), bool)
    alike = np.arange(1, len(order))
    for k in range(length):
        alike = alike[words[order[alike] + k] == words[order[alike - 1] + k]]
        if not len(alike):
            break
    new[alike] = False
    return np.flatnonzero(new)


def shared_in(key, doc, first, count, words, length: int, within: bool = False) -> tuple[np.ndarray, ...]:
    """Document, kind (0: in some other document too; 1: in one of a lesser id too), first word and end of the shared passages of cells.
    within: places (document, first word) count in place of documents."""
    size = count.astype(np.int64) + length - 1
    begin = np.concatenate(([0], np.cumsum(size)))
    offset = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
    cell = np.repeat(np.arange(len(count)), count)
    suffixes = begin[cell] + np.arange(offset[-1]) - offset[cell]
    order = parsed_order(words, begin, suffixes)
    of = np.searchsorted(begin, order, "right") - 1
    own = doc[of]
    at = prefix_runs(words, order, length)
    per = np.diff(np.append(at, len(order)))
    least, most = np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)
    several, earlier = np.repeat(least != most, per), np.repeat(least, per) < own
    if within:
        word = first[of] + order - begin[of]
        in_least = own == np.repeat(least, per)
        least_word = np.minimum.reduceat(np.where(in_least, word, np.iinfo(np.int64).max), at)
        most_word = np.maximum.reduceat(np.where(in_least, word, -1), at)
        several |= np.repeat(least_word != most_word, per)
        earlier |= in_least & (np.repeat(least_word, per) < word)
    shared, lesser = np.zeros(len(words), bool), np.zeros(len(words), bool)
    shared[order], lesser[order] = several, earlier
    out = []
    for kind, flag in enumerate((shared, lesser)):
        hit = np.flatnonzero(flag)
        if not len(hit):
            continue
        in_cell = np.searchsorted(begin, hit, "right") - 1
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (in_cell[1:] != in_cell[:-1])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(hit)) - 1
        c = in_cell[a]
        word = first[c] + hit[a] - begin[c]
        out.append((doc[c], np.full(len(a), kind, np.int32), word, word + (z - a) + length))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def intervals(blobs: list[bytes], length: int, within: bool = False) -> Iterator[pa.RecordBatch]:
    """The shared passages of a partition's cells, in groups of about GROUP_WORDS words, and what is known before."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    for b in blobs:
        if np.frombuffer(b, np.int64, 1)[0] < 0:
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(k) for x, k in zip(np.frombuffer(b, np.int64, -1, 8).reshape(4, -1), kinds)], ["doc_id", "kind", "start", "end"])
    blobs = [b for b in blobs if np.frombuffer(b, np.int64, 1)[0] >= 0]
    if not blobs:
        return
    key, doc, first, count, _ = (np.concatenate(x) for x in zip(*((k, d, f, c, np.zeros(0)) for k, d, f, c, _ in map(_unpacked, blobs))))
    words = np.concatenate([_unpacked(b)[4] for b in blobs])
    size = count.astype(np.int64) + length - 1
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    group = np.cumsum(size[order]) // GROUP_WORDS
    group = np.maximum.accumulate(np.where(new, group, 0))  # that of the key's first cell
    cut = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(order))
    for a, b in zip(cut[:-1], cut[1:]):
        at = order[a:b]
        s = size[at]
        text = words[np.repeat(begin[at] - np.concatenate(([0], np.cumsum(s)[:-1])), s) + np.arange(s.sum())]
        found = shared_in(key[at], doc[at], first[at], count[at], text, length, within)
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds)], ["doc_id", "kind", "start", "end"])


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """doc_id, repeated, removable: a row for each document with a passage of `length` words that another document has too
    or, with within, that stands at another place of its own.

    repeated and removable are arrays of (start, end), in order and apart: words of the lower-cased text, counted from 0. repeated covers
    every such passage, removable those that a document of a lesser id has (within: or that stand at a lesser word of the same), so that
    one copy of each stays when these are cut; of a passage that overlaps its own copy, only the words before the second stay.
    Whatever stands between words is left out of account. Without within, passages that only one document repeats don't count. Null, empty and
    short texts have none; long texts are read whole; rows with a null id are left out; rows of one id are one document, whose texts'
    spans lie together, so that ids are never tied; extra columns are left out; an empty table gives an empty result. Ids that aren't
    integers are numbered in their order while passages meet.
    """
    parts = parts_for(docs)
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = None
    if not isinstance(base.schema["doc_id"].dataType, IntegralType):
        ordered = written(base.select(F.col("doc_id").alias("name")).distinct().orderBy("name"), "ids")
        names = written(ordered.orderBy("name").select("name", F.monotonically_increasing_id().alias("number")), "numbers")
        base = base.join(names, F.col("doc_id") == F.col("name")).select(F.col("number").alias("doc_id"), "text")
    kind = base.schema["doc_id"].dataType
    base = base.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    place = shared_keys(base, length, parts, within)

    def spread(batches: Batches) -> Batches:
        return rows_of(batches, lambda b: cell_blobs(b.column(0).to_numpy(), b.column(1), lambda key: is_in(place, "keys", key, parts), lambda key: is_in(place, "hot", key, parts), length, parts, within), CELL_STEP)

    blobs = base.mapInArrow(spread, BLOBS)

    def meet(batches: Batches) -> Batches:
        got = [x.as_buffer().to_pybytes() for b in batches for x in b.column(1)]
        return intervals(got, length, within) if got else iter(())

    found = exchange(blobs, parts).mapInArrow(meet, "doc_id bigint, kind int, start int, end int")
    w = Window.partitionBy("doc_id", "kind").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.repartition("doc_id").withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    spans = runs.groupBy("doc_id", "kind", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end"))))
    found = spans.groupBy("doc_id").agg(of(0).alias("repeated"), of(1).alias("removable"))
    if names is None:
        return found.withColumn("doc_id", F.col("doc_id").cast(kind))
    return found.join(names, F.col("doc_id") == F.col("number")).select(F.col("name").alias("doc_id"), "repeated", "removable")


def query(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), within=True)
