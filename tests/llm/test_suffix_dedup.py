import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import suffix_dedup
from webloom.llm.text import word_chunks


def brute(rows, length):
    """Every passage of every document against all others."""
    held = defaultdict(set)
    words = []
    for i, t in rows:
        ws = [] if t is None else next(iter(word_chunks(pa.array([t]))))[1].hashes.tolist() if t else []
        words.append((i, ws))
        for k in range(len(ws) - length + 1):
            held[tuple(ws[k : k + length])].add(i)
    out = defaultdict(lambda: ([], []))
    for i, ws in words:
        if i is None:
            continue
        for k in range(len(ws) - length + 1):
            ids = held[tuple(ws[k : k + length])] - {None}
            if len(ids) > 1:
                out[i][0].append((k, k + length))
            if min(ids) < i:
                out[i][1].append((k, k + length))

    def joined(spans):
        done = []
        for a, b in sorted(spans):
            if done and a <= done[-1][1]:
                done[-1] = (done[-1][0], max(b, done[-1][1]))
            else:
                done.append((a, b))
        return done

    return {i: (joined(a), joined(b)) for i, (a, b) in out.items() if a}


def got(df):
    return {r.doc_id: ([tuple(s) for s in r.repeated], [tuple(s) for s in r.removable]) for r in df.collect()}


def corpus(seed, vocabulary, docs=60):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    shared = [[word() for _ in range(r.randrange(8, 60))] for _ in range(6)]
    rows = []
    for i in range(docs):
        ws = [word() for _ in range(r.randrange(0, 80))]
        if r.random() < 0.5:
            at = r.randrange(len(ws) + 1)
            ws[at:at] = r.choice(shared)
        if r.random() < 0.1 and rows:
            ws = rows[r.randrange(len(rows))][1].split()
        rows.append((i, " ".join(ws)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "same " * 70), (1003, "same " * 65), (1004, "alone again " * 60), (1005, "x"), (5, rows[5][1]), (1006, "Ünï, " + " ".join(f"long{k}" for k in range(30000))), (1007, " ".join(f"long{k}" for k in range(29000, 30000)))]
    return rows


@pytest.mark.parametrize("seed,vocabulary,length", [(1, 5000, 12), (2, 3, 16), (3, 40, 50), (4, 5000, 9), (5, 2, 20)])
def test_equals_brute_force(spark, seed, vocabulary, length):
    rows = corpus(seed, vocabulary)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, start int, keys string")
    assert got(suffix_dedup.repeats(docs, length)) == brute(rows, length)


def test_groups_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_WORDS", 200)
    rows = corpus(9, 300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(suffix_dedup.repeats(docs, 12)) == brute(rows, 12)
    assert suffix_dedup.repeats(docs.where("false")).count() == 0


def test_order_is_that_of_suffixes():
    """parsed_order() against sorting; an order by hashes, say, would fail."""
    r = np.random.default_rng(6)
    for vocabulary, cells in ((2, 30), (5, 20), (1000, 10)):
        size = r.integers(12, 60, cells)
        begin = np.concatenate(([0], np.cumsum(size)))
        words = r.integers(0, vocabulary, begin[-1]).astype(np.uint32)
        words[begin[1] : begin[1] + 12] = words[:12]
        ends = np.repeat(begin[1:], size)
        suffixes = np.flatnonzero(np.arange(begin[-1]) + 8 <= ends)
        got = suffix_dedup.parsed_order(words, begin, suffixes)
        cell = np.searchsorted(begin, np.arange(begin[-1]), "right") - 1
        # words in the order of numbers, the ends of cells before all words and in their own order
        want = sorted(suffixes.tolist(), key=lambda k: [(1, w) for w in words[k : ends[k]].tolist()] + [(0, int(cell[k]))])
        assert got.tolist() == want
        runs = suffix_dedup.prefix_runs(words, got, 8)
        assert len(runs) == len({tuple(words[k : k + 8].tolist()) for k in suffixes})
        shuffled = r.permutation(got)
        assert len(suffix_dedup.prefix_runs(words, shuffled, 8)) >= len(runs)


def test_equal_cells_are_made_one(spark):
    """Passages that most documents have, in one task and in several, and rows that are repeated."""
    text = " ".join(f"b{k}" for k in range(90))
    rows = [(i, f"{text} tail{i}" if i % 3 else f"head{i} {text} {text}") for i in range(200)] + [(7, f"{text} tail7"), (7, "other " + text)]
    for docs in (spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)):
        assert got(suffix_dedup.repeats(docs, 20)) == brute(rows, 20)
        assert got(suffix_dedup.repeats(docs, 20, within=True)) == brute_within(rows, 20)


@pytest.mark.parametrize("seed,vocabulary,length", [(1, 5000, 12), (2, 3, 16), (3, 40, 50), (5, 2, 20), (6, 300, 9)])
def test_hot_minimizers_are_parted(spark, monkeypatch, seed, vocabulary, length):
    rows = corpus(seed, vocabulary)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(suffix_dedup, "HOT_CELLS", 0)
    assert got(suffix_dedup.repeats(docs, length)) == brute(rows, length)
    assert got(suffix_dedup.repeats(docs, length, within=True)) == brute_within(rows, length)


def test_a_common_line_meets_in_many_groups():
    """Cells around one line in unlike surroundings have unlike keys once it is hot."""
    every = lambda key: np.ones(len(key), bool)
    most = {True: [], False: []}
    for v in range(40):  # some of the lines are minimizers
        line = " ".join(f"line{v}x{k}" for k in range(10))
        texts = pa.array([" ".join([*(f"a{i}x{k}" for k in range(60)), line, *(f"b{i}x{k}" for k in range(60))]) for i in range(20)])
        for hot in (True, False):
            told = every if hot else lambda key: ~every(key)
            blobs = [suffix_dedup._unpacked(b.as_py()) for batch in suffix_dedup.cell_blobs(np.arange(20), texts, every, told, 50, 1, True) for b in batch.column(1)]
            most[hot].append(np.unique(np.concatenate([b[0] for b in blobs]), return_counts=True)[1].max())
    assert max(most[False]) >= 15 and set(most[True]) == {1}


def test_ids_of_other_types(spark):
    rows = corpus(3, 300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    named = docs.select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("doc_id"), "text")
    assert {int(k): v for k, v in got(suffix_dedup.repeats(named, 12)).items()} == brute(rows, 12)


def brute_within(rows, length):
    """Every passage against all places, (doc_id, first word), that have it."""
    held = defaultdict(set)
    for i, t in rows:
        ws = next(iter(word_chunks(pa.array([t]))))[1].hashes.tolist() if t and i is not None else []
        for k in range(len(ws) - length + 1):
            held[tuple(ws[k : k + length])].add((i, k))
    out = defaultdict(lambda: [set(), set()])
    for places in held.values():
        if len(places) > 1:
            for i, k in places:
                out[i][0].update(range(k, k + length))
                if (i, k) != min(places):
                    out[i][1].update(range(k, k + length))

    def joined(words):
        edges = sorted(w for w in words if w - 1 not in words), sorted(w + 1 for w in words if w + 1 not in words)
        return list(zip(*edges))

    return {i: (joined(a), joined(b)) for i, (a, b) in out.items()}


@pytest.mark.parametrize("seed,vocabulary,length", [(1, 5000, 12), (2, 3, 16), (3, 40, 50), (4, 5000, 9), (5, 2, 20)])
def test_repeats_within_a_document(spark, seed, vocabulary, length):
    rows = corpus(seed, vocabulary)
    own = [f"own{k}" for k in range(60)]
    rows += [(2000, " ".join([*own, "between", *own])), (2001, " ".join(f"once{k}" for k in range(200))), (3, " ".join(["again", *own[:55], "x", *own[:55]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = got(suffix_dedup.repeats(docs, length, within=True))
    assert found == brute_within(rows, length)
    assert 1004 in found and 2000 in found and 2001 not in found


def test_query_lists_repeats_within_a_document(spark, tmp_path):
    own = [f"own{k}" for k in range(60)]
    rows = [(1, " ".join([*own, "between", *own])), (2, " ".join(f"once{k}" for k in range(200)))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(suffix_dedup.query(spark, str(tmp_path))) == {1: ([(0, 60), (61, 121)], [(61, 121)])}
