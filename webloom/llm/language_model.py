"""Perplexity under an interpolated modified Kneser-Ney trigram model (Chen and Goodman, 1999) of the whole corpus.

A first job gathers the distinct words (64-bit hashes) in sorted shards; a word's place there is its number, so that all that follows
tells words apart by no more bits than there are words. Counting then takes one job of three exchanges. Trigrams (u, v, w) go to the
partition of (u, v), which adds up the counts and writes its shard: sorted hashes of contexts with counts of their followers, and of
each context the numbers of its followers in order. Every distinct trigram then tells the partition of (v, w) of one left context;
distinct bigrams tell the partitions of their words. Shards hold counts, and discounts are applied when texts are scored, so that no
pass goes back over a shard.

Workers map the shards into memory (from the shared folder, or from a copy on their disk where that folder isn't a file system) and look
up the distinct bigrams and words of many texts at once, in sorted order. The hash of a context is a bijection of its two words'
numbers, and followers are stored whole: no context and no trigram is taken for another, at any size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLOBS, Batches, blob_rows, exchange, least_type, mapped, new_place, packed, parts_for, released, rows_of, save, typed, unpacked
from .text import U64, Words, mix64, word_chunks

UNKNOWN, BOS, EOS, NONE, FIRST = 0, 1, 2, 3, 4
#: Words whose trigrams a task counts before it sends them; words that are scored at once.
COUNT_WORDS, SCORE_BYTES = 4_000_000, 4 << 20
_U32 = np.uint32


def word_numbers(words: dict, hashes: np.ndarray) -> np.ndarray:
    """The number of each word, UNKNOWN for those that aren't among words."""
    each, which = np.unique(hashes, return_inverse=True)
    out = np.full(len(each), UNKNOWN, _U32)
    for p, s in _sharded(each, words["parts"], 64):
        have = mapped(words["place"], f"vocabulary-{p}")
        if have is not None and len(have):
            k = np.minimum(np.searchsorted(have, each[s]), len(have) - 1)
            out[s] = np.where(have[k] == each[s], k + (words["before"][p] + FIRST), UNKNOWN)
    return out[which]


def tokens(w: Words, words: dict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all documents that have any, each document between two BOS and one EOS; of each document where its begin (n + 1)."""
    count = np.diff(w.first)
    size = np.where(count > 0, count + 3, 0)
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.full(begin[-1], BOS, _U32)
    out[begin[1:][count > 0] - 1] = EOS
    out[np.arange(len(w.hashes)) + np.repeat(begin[:-1] + 2 - w.first[:-1], count)] = word_numbers(words, w.hashes)
    return out, begin


def pair(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """A hash of two numbers of `bits` bits in a row: a bijection of 2 * bits bits."""
    half, mask = U64(bits), U64((1 << 2 * bits) - 1)
    x = (a.astype(U64) << half) | b.astype(U64)
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x ^= x >> half
        x = (x * U64(k)) & mask
    return x ^ (x >> half)


def shard_of(h: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Shards are ranges of hashes of so many bits."""
    top = h >> U64(bits - 32) if bits >= 32 else h << U64(32 - bits)
    return ((top * U64(parts)) >> U64(32)).astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where in sorted rows a new one begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _added(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at) if len(at) else values[:0]


def _numbered(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Some columns of words in small numbers, the lowest for the most frequent; the words that occur twice or more by number, and the
    gaps between the others."""
    words, count = np.unique(np.concatenate(columns), return_counts=True)
    often = np.flatnonzero(count > 1)
    order = np.concatenate((often[np.argsort(-count[often], kind="stable")], np.flatnonzero(count == 1)))
    number = np.empty(len(words), _U32)
    number[order] = np.arange(len(words), dtype=_U32)
    if words[-1] < 1 << 24:  # a table is faster than a search
        table = np.empty(int(words[-1]) + 1, _U32)
        table[words] = number
        numbered = [table[c] for c in columns]
    else:
        numbered = [number[np.searchsorted(words, c)] for c in columns]
    return numbered, words[order[: len(often)]], np.diff(words[order[len(often) :]], prepend=_U32(0))


def _named(often: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The word of each number."""
    return np.concatenate((often, np.cumsum(gaps, dtype=_U32)))


def _sent_pairs(shard: np.ndarray, parts: int, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows of two words and a number, packed by shard."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(cut)):
        at = order[cut[p] : cut[p + 1]]
        (of_v, of_w), often, gaps = _numbered(v[at], w[at])
        by = np.argsort(of_v, kind="stable")
        out.append((int(p), packed(often, gaps, np.diff(of_v[by], prepend=_U32(0)), of_w[by], n[at[by]])))
    return out


def _pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    often, gaps, v, w, n = unpacked(blob, *[_U32] * 5)
    name = _named(often, gaps)
    return name[np.cumsum(v, dtype=_U32)], name[w], n


def _sent(shard: np.ndarray, parts: int, words: np.ndarray, *numbers: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows of a word and numbers, packed by shard."""
    order = np.lexsort((words, shard))
    cut = np.searchsorted(shard[order], np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(cut)):
        at = order[cut[p] : cut[p + 1]]
        out.append((int(p), packed(np.diff(words[at], prepend=_U32(0)), *(x[at] for x in numbers))))
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _counted(v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams in the order of (v, u, w), as v << 32 | u and w, with their counts (of None, one each) added up."""
    if 3 * bits <= 64:  # three numbers fit one, which sorts faster
        key = (v.astype(U64) << U64(2 * bits)) | (u.astype(U64) << U64(bits)) | w.astype(U64)
        order = None if count is None else np.argsort(key)
        key = np.sort(key) if order is None else key[order]
        first = _runs(key)
        mask, k = U64((1 << bits) - 1), key[first]
        ctx, last = ((k >> U64(2 * bits)) << U64(32)) | ((k >> U64(bits)) & mask), (k & mask).astype(_U32)
    else:
        key = (v.astype(U64) << U64(32)) | u.astype(U64)
        order = np.lexsort((w, key))
        key, w = key[order], w[order]
        first = _runs(key, w)
        ctx, last = key[first], w[first]
    return ctx, last, np.diff(np.append(first, len(key))) if count is None else _added(count[order], first)


def trigram_blobs(tok: np.ndarray, begin: np.ndarray, parts: int, bits: int) -> list[tuple[int, bytes]]:
    """Counted trigrams by the shard of their context: words by number, contexts (v, u), their numbers of followers, followers, counts."""
    n = np.diff(begin)
    live = np.repeat(n, n)
    inside = np.arange(len(tok)) - np.repeat(begin[:-1], n)
    at = np.flatnonzero(inside < live - 1)  # pairs within a document
    nxt = np.minimum(at + 2, len(tok) - 1)
    last = inside[at] == live[at] - 2
    ctx, w, count = _counted(tok[at + 1], tok[at], np.where(last, _U32(NONE), tok[nxt]), None, bits)
    count = count.astype(_U32)
    head = _runs(ctx)
    size = np.diff(np.append(head, len(ctx)))
    ctx = ctx[head]
    v, u = (ctx >> U64(32)).astype(_U32), ctx.astype(_U32)
    shard = shard_of(pair(u, v, bits), parts, 2 * bits)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(cut)):
        c = order[cut[p] : cut[p + 1]]
        rows = _ranges(head[c], size[c])
        (of_v, of_u, of_w), often, gaps = _numbered(v[c], u[c], w[rows])
        by = np.argsort(of_v, kind="stable")
        inner = _ranges((np.cumsum(size[c]) - size[c])[by], size[c][by])
        out.append((int(p), packed(often, gaps, np.diff(of_v[by], prepend=_U32(0)), of_u[by], size[c][by].astype(_U32), of_w[inner], count[rows[inner]])))
    return out


# ---------------------------------------------------------------- shards


def _narrow(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, 255 for those of 255 or more, and (place, count) of these."""
    at = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), np.stack((at, counts[at].astype(np.int64)))


def _wide(place: str, name: str, at: np.ndarray) -> np.ndarray:
    """Counts at some places of an array that _narrow() stored."""
    out = mapped(place, name)[at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        where, value = mapped(place, f"{name}-wide")
        out[big] = value[np.searchsorted(where, at[big])]
    return out


def _save_counts(place: str, name: str, counts: np.ndarray) -> None:
    low, high = _narrow(counts)
    save(place, name, low)
    save(place, f"{name}-wide", high)


def _of_counts(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64)


#: Contexts to each of which the place of its first follower is stored; in between, numbers of followers are added up.
_BLOCK = 8


def add_trigrams(blobs: list[bytes], place: str, p: int, parts: int, bits: int) -> list[tuple[int, bytes]]:
    """Writes shard p of contexts and followers; what it tells of bigrams: v, w, number of left contexts, by shard."""
    got = []
    for b in blobs:
        often, gaps, v, u, n, w, c = unpacked(b, *[_U32] * 7)
        name = _named(often, gaps)
        got.append((np.repeat(name[np.cumsum(v, dtype=_U32)], n), np.repeat(name[u], n), name[w], c))
    v, u, w, count = (np.concatenate(x) for x in zip(*got))
    got = None
    ctx, w, count = _counted(v, u, w, count.astype(np.int64), bits)
    head = _runs(ctx)
    real = w != NONE
    v, u = (ctx >> U64(32)).astype(_U32), ctx.astype(_U32)
    # contexts in the order of their hashes
    key = pair(u[head], v[head], bits)
    by = np.argsort(key)
    size = np.diff(np.append(head, len(ctx)))
    n1, n2, n3, total = (_added(x.astype(np.int64), head)[by] for x in (real & (count == 1), real & (count == 2), real & (count > 2), np.where(real, count, 0)))
    rows = _ranges(head[by], size[by])
    rows = rows[real[rows]]
    k = key[by]
    high, low = _halves(k, bits)
    save(place, f"ctx-{p}-hi", high)
    save(place, f"ctx-{p}-lo", low)
    for name, x in (("n1", n1), ("n2", n2), ("n3", n3)):
        _save_counts(place, f"ctx-{p}-{name}", x)
    more = np.flatnonzero(n3)  # other totals follow from n1 and n2
    save(place, f"ctx-{p}-total", np.stack((more, total[more])))
    save(place, f"ctx-{p}-first", np.concatenate(([0], np.cumsum(n1 + n2 + n3)))[::_BLOCK].astype(least_type(len(rows))))
    save(place, f"next-{p}-hi", (w[rows] >> _U32(8)).astype(least_type((1 << bits) >> 8)))
    save(place, f"next-{p}-lo", (w[rows] & _U32(255)).astype(np.uint8))
    _save_counts(place, f"next-{p}-count", count[rows])
    save(place, f"stats3-{p}", _of_counts(count[real]))
    # a trigram at the beginning of a text has no left contexts to count: its own count stands in
    u, v, w, told = u[real], v[real], w[real], np.where((u == BOS) & (v == BOS), count, 1)[real]
    both = (v.astype(U64) << U64(32)) | w.astype(U64)
    order = np.argsort(both, kind="stable")
    both, told = both[order], told[order]
    first = _runs(both)
    v, w, told = (both[first] >> U64(32)).astype(_U32), both[first].astype(_U32), _added(told, first).astype(_U32)
    return _sent_pairs(shard_of(pair(v, w, bits), parts, 2 * bits), parts, v, w, told)


def _halves(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 32 of 2 * bits bits, and the others in as few bytes as they need."""
    rest = max(2 * bits - 32, 0)
    return (keys >> U64(rest)).astype(_U32), (keys & U64((1 << rest) - 1)).astype(least_type((1 << rest) - 1))


def find(place: str, p: int, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted hashes among the contexts of shard p, and which are there."""
    hi, lo = mapped(place, f"ctx-{p}-hi"), mapped(place, f"ctx-{p}-lo")
    if hi is None or not len(hi):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    want, want_lo = _halves(keys, bits)
    at = np.searchsorted(hi, want)
    end = len(hi) - 1
    while True:
        c = np.minimum(at, end)
        on = (at <= end) & (hi[c] == want) & (lo[c] < want_lo)
        if not on.any():
            return c, (at <= end) & (hi[c] == want) & (lo[c] == want_lo)
        at = at + on


def add_bigrams(blobs: list[bytes], place: str, p: int, parts: int, bits: int) -> list[tuple[int, bytes]]:
    """Writes the left contexts of shard p's bigrams; what it tells of words, by shard: word, as first word total and numbers of 1, 2, more; left contexts as second."""
    got = [_pairs(b) for b in blobs]
    both = np.concatenate([(v.astype(U64) << U64(32)) | w.astype(U64) for v, w, _ in got])
    told = np.concatenate([g[2] for g in got]).astype(np.int64)
    order = np.argsort(both, kind="stable")
    both, told = both[order], told[order]
    first = _runs(both)
    both, told = both[first], _added(told, first)
    v, w = (both >> U64(32)).astype(_U32), both.astype(_U32)
    key = pair(v, w, bits)
    by = np.argsort(key)
    at, there = find(place, p, key[by], bits)
    size = mapped(place, f"ctx-{p}-hi")
    left = np.zeros(0 if size is None else len(size), np.int64)
    left[at[there]] = told[by][there]
    _save_counts(place, f"ctx-{p}-left", left)
    save(place, f"stats2-{p}", _of_counts(told))
    head = _runs(v)
    per = [_added(x.astype(np.int64), head) for x in (told, told == 1, told == 2, told > 2)]
    w = np.sort(w)
    as_second = _runs(w)
    number = np.diff(np.append(as_second, len(w)))
    words = np.concatenate((v[head], w[as_second]))
    zeros = np.zeros(len(as_second), np.int64)
    cols = [np.concatenate((x, zeros)) for x in per] + [np.concatenate((np.zeros(len(head), np.int64), number))]
    return _sent(shard_of(mix64(words.astype(U64)), parts, 64), parts, words, *cols)


def add_words(blobs: list[bytes], place: str, p: int) -> np.ndarray:
    """Writes shard p of words; numbers of words, of bigrams, and of words with 1, 2, 3, 4, more left contexts."""
    got = [unpacked(b, _U32, *[np.int64] * 5) for b in blobs]
    cols = [np.concatenate([np.cumsum(g[0], dtype=_U32) if k == 0 else g[k] for g in got]) for k in range(6)]
    order = np.argsort(cols[0], kind="stable")
    cols = [c[order] for c in cols]
    first = _runs(cols[0])
    words, rest = cols[0][first], np.stack([_added(c, first) for c in cols[1:]])
    key = mix64(words.astype(U64))
    by = np.argsort(key)
    save(place, f"word-{p}-key", key[by])
    save(place, f"word-{p}-counts", rest[:, by].astype(least_type(int(rest.max(initial=0)))))
    left = rest[4][rest[4] > 0]
    return np.concatenate(([len(left), left.sum()], _of_counts(left), [(left > 4).sum()]))


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from how many counts are 1 to 4. Where some number is missing, as in tiny corpora, half of one count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(min(max(k - (k + 1) * y * b / a, 0.05), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def vocabulary(docs: DataFrame, place: str, parts: int) -> dict:
    """Writes the distinct words of the texts, by ranges of their hashes; how many there are before each range, and in all."""

    def spread(batches: Batches) -> Batches:
        held, size = [], 0

        def flush():
            each = np.unique(np.concatenate(held))
            return blob_rows([(p, packed(np.diff(each[s], prepend=U64(0)))) for p, s in _sharded(each, parts, 64)])

        for b in batches:
            for _, w in word_chunks(b.column(0)):
                held.append(np.unique(w.hashes))
                size += len(held[-1])
                if size > COUNT_WORDS:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > COUNT_WORDS // 2:
                        yield flush()
                        held = []
                    size = sum(map(len, held))
        if size:
            yield flush()
        held = []
        released()

    def meet(batches: Batches) -> Batches:
        got: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                got.setdefault(p, []).append(np.cumsum(unpacked(x.as_buffer().to_pybytes(), U64)[0], dtype=U64))
        for p, each in got.items():
            words = np.unique(np.concatenate(each))
            save(place, f"vocabulary-{p}", words)
            yield blob_rows([(p, np.int64(len(words)).tobytes())])
        released()

    before = np.zeros(parts + 1, np.int64)
    for r in exchange(docs.mapInArrow(spread, BLOBS), parts).mapInArrow(meet, BLOBS).collect():  # a number of each shard
        before[r["part"] + 1] = np.frombuffer(r["blob"], np.int64)[0]
    before = np.cumsum(before)
    if before[-1] + FIRST >= 1 << 32:
        raise ValueError(f"{before[-1]} distinct words are more than 32 bits can number")
    return {"place": place, "parts": parts, "before": before, "bits": int(before[-1] + FIRST).bit_length()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model of all texts: where its shards are and the numbers that hold for all of them. Null, empty and wordless texts count
    nothing; without any words all texts are scored as unknown. Long texts count to their end, repeated rows as often as they are."""
    spark = docs.sparkSession
    parts = parts_for(docs)
    place = new_place(spark, "ngrams")
    texts = docs.select(F.col(text_col))
    known = vocabulary(texts, place, parts)
    bits = known["bits"]

    def count(batches: Batches) -> Batches:
        held, size = [], 0

        def flush():
            begin = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(b) for _, b in held]))))
            return blob_rows(trigram_blobs(np.concatenate([t for t, _ in held]), begin, parts, bits))

        for b in batches:
            for _, w in word_chunks(b.column(0)):
                tok, begin = tokens(w, known)
                if len(tok):
                    held.append((tok, begin))
                    size += len(tok)
                if size > COUNT_WORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        held = []
        released()

    def by_shard(batches: Batches) -> dict[int, list[bytes]]:
        out: dict[int, list[bytes]] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                out.setdefault(p, []).append(x.as_buffer().to_pybytes())
        return out

    def trigrams(batches: Batches) -> Batches:
        for p, blobs in by_shard(batches).items():
            yield blob_rows(add_trigrams(blobs, place, p, parts, bits))
        released()

    def bigrams(batches: Batches) -> Batches:
        for p, blobs in by_shard(batches).items():
            yield blob_rows(add_bigrams(blobs, place, p, parts, bits))
        released()

    def words(batches: Batches) -> Batches:
        for p, blobs in by_shard(batches).items():
            yield blob_rows([(p, add_words(blobs, place, p).tobytes())])

    told = exchange(texts.mapInArrow(count, BLOBS), parts).mapInArrow(trigrams, BLOBS)
    told = exchange(exchange(told, parts).mapInArrow(bigrams, BLOBS), parts).mapInArrow(words, BLOBS)
    sums = np.zeros(7, np.int64)
    for r in told.collect():  # a few numbers of each shard
        sums += np.frombuffer(r["blob"], np.int64)
    every = [np.zeros(4, np.int64), np.zeros(4, np.int64)]
    for p in range(parts):
        for k, name in enumerate(("stats3", "stats2")):
            got = mapped(place, f"{name}-{p}")
            if got is not None:
                every[k] += got
    d1 = discounts(sums[2:6])
    rest = d1[1] * sums[2] + d1[2] * sums[3] + d1[3] * (sums[4:7].sum())
    return {"place": place, "parts": parts, "known": known, "words": int(sums[0]), "bigrams": int(sums[1]), "d": (d1, discounts(every[1]), discounts(every[0])), "rest": float(rest)}


def _mass(d: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> np.ndarray:
    return d[1] * n1 + d[2] * n2 + d[3] * n3


def _less(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.maximum(count - d[np.minimum(count, 3)], 0)


def _sharded(keys: np.ndarray, parts: int, bits: int):
    """Shards of sorted hashes of so many bits, with their ranges."""
    cut = np.searchsorted(shard_of(keys, parts, bits), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), slice(cut[p], cut[p + 1])


def log_probs(model: dict, tok: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the probability of each word and EOS in order, and the document of each."""
    place, parts, bits, (d1, d2, d3) = model["place"], model["parts"], model["known"]["bits"], model["d"]
    n = np.diff(begin)
    inside = np.arange(len(tok)) - np.repeat(begin[:-1], n)
    at = np.flatnonzero(inside >= 2)  # what is scored
    doc = np.repeat(np.arange(len(n)), n)[at]
    # words
    word, which = np.unique(tok, return_inverse=True)
    key = mix64(word.astype(U64))
    by = np.argsort(key)
    counts = np.zeros((5, len(word)), np.int64)
    for p, s in _sharded(key[by], parts, 64):
        have = mapped(place, f"word-{p}-key")
        if have is not None and len(have):
            k = np.minimum(np.searchsorted(have, key[by[s]]), len(have) - 1)
            ok = have[k] == key[by[s]]
            counts[:, by[s][ok]] = mapped(place, f"word-{p}-counts")[:, k[ok]].astype(np.int64)
    total = max(model["bigrams"], 1)
    flat = 1.0 / (model["words"] + 1)
    p1 = (_less(d1, counts[4]) + model["rest"] * flat) / total if model["bigrams"] else np.full(len(word), flat)
    # pairs: as contexts of what follows, and as bigrams
    pairs, pair_of = np.unique(pair(tok[:-1], tok[1:], bits), return_inverse=True)
    ctx = np.zeros((5, len(pairs)), np.int64)  # n1, n2, n3, total, left
    start, shard = np.zeros(len(pairs), np.int64), np.full(len(pairs), -1)
    for p, s in _sharded(pairs, parts, 2 * bits):
        k, ok = find(place, p, pairs[s], bits)
        k = k[ok]
        mine = np.flatnonzero(ok) + s.start
        if not len(mine):
            continue
        shard[mine] = p
        for j, name in ((0, "n1"), (1, "n2"), (2, "n3"), (4, "left")):
            if mapped(place, f"ctx-{p}-{name}") is not None:
                ctx[j, mine] = _wide(place, f"ctx-{p}-{name}", k)
        ctx[3, mine] = ctx[0, mine] + 2 * ctx[1, mine]
        more = np.flatnonzero(ctx[2, mine])
        where, value = mapped(place, f"ctx-{p}-total")
        ctx[3, mine[more]] = value[np.searchsorted(where, k[more])]
        block = k // _BLOCK * _BLOCK
        places = block[:, None] + np.arange(_BLOCK)
        before = places < k[:, None]
        inner = np.zeros(len(k), np.int64)
        for name in ("n1", "n2", "n3"):
            low = mapped(place, f"ctx-{p}-{name}")
            each = low[np.minimum(places, len(low) - 1)].astype(np.int64) * before
            big = np.flatnonzero((each == 255).any(axis=1))
            inner += each.sum(axis=1)
            if len(big):
                r, c = np.nonzero(each[big] == 255)
                inner += np.bincount(big[r], _wide(place, f"ctx-{p}-{name}", places[big[r], c]) - 255, len(k)).astype(np.int64)
        start[mine] = mapped(place, f"ctx-{p}-first")[k // _BLOCK] + inner
    # probabilities
    w, v, uv, vw = which[at], which[at - 1], pair_of[at - 2], pair_of[at - 1]
    t2 = counts[0, v]
    p2 = np.where(t2 > 0, (_less(d2, ctx[4, vw]) + _mass(d2, *counts[1:4, v]) * p1[w]) / np.maximum(t2, 1), p1[w])
    t3 = ctx[3, uv]
    p3 = np.where(t3 > 0, (_less(d3, followers(place, shard[uv], start[uv], ctx[:3, uv].sum(axis=0), tok[at])) + _mass(d3, *ctx[:3, uv]) * p2) / np.maximum(t3, 1), p2)
    return np.log(p3), doc


def followers(place: str, shard: np.ndarray, start: np.ndarray, size: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Count of each word w among the `size` followers from `start` on in a shard, by binary search of all at once."""
    out = np.zeros(len(w), np.int64)
    order = np.argsort(shard, kind="stable")
    order = order[np.searchsorted(shard[order], 0) :]
    order = order[size[order] > 0]
    at = _runs(shard[order]) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(at, np.append(at[1:], len(order))):
        mine = order[a:b]
        p = int(shard[mine[0]])
        hi, lo = mapped(place, f"next-{p}-hi"), mapped(place, f"next-{p}-lo")
        value = lambda k: (hi[k].astype(_U32) << _U32(8)) | lo[k]  # noqa: B023, E731
        want = w[mine]
        left, right = start[mine].copy(), start[mine] + size[mine] - 1
        todo = np.flatnonzero(left < right)
        while len(todo):
            mid = (left[todo] + right[todo]) // 2
            less = value(mid) < want[todo]
            left[todo[less]] = mid[less] + 1
            right[todo[~less]] = mid[~less]
            todo = todo[left[todo] < right[todo]]
        ok = value(left) == want
        out[mine[ok]] = _wide(place, f"next-{p}-count", left[ok])
    return out


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (words and the end), log_prob (natural), perplexity: a row for each row of docs, extra columns left out.

    Null, empty and wordless texts have 0 tokens, log_prob 0 and null perplexity; long texts are scored to their end. Ids stay as they
    are, null or not; repeated rows are scored each, alike; nothing is ranked, so there are no ties; an empty table gives an empty result.
    """

    def run(batches: Batches) -> Batches:
        def step(b: pa.RecordBatch):
            for row, w in word_chunks(b.column(1), SCORE_BYTES):
                tok, begin = tokens(w, model["known"])
                count = len(begin) - 1
                n = np.maximum(np.diff(begin) - 2, 0)
                total = np.zeros(count)
                if len(tok):
                    logs, doc = log_probs(model, tok, begin)
                    total = np.bincount(doc, logs, count)
                with np.errstate(over="ignore"):
                    perplexity = pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, count), pa.array(n), pa.array(total), perplexity], ["doc_id", "n_tokens", "log_prob", "perplexity"])

        return rows_of(batches, step)

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, typed(base, "doc_id", "n_tokens long, log_prob double, perplexity double"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs))
