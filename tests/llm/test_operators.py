import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from webloom.llm import chat_format, decontaminate, fingerprints, fm_index, golay, language_id, mixing, near_dedup

from . import brute
from .cases import LONG, awkward, empty

DATA = "/root/testdata/sf0.001"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


# ---------------------------------------------------------------- 1


def test_language_by_brute_compression(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    dicts = language_id.dictionaries(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, dicts).collect()}
    right = sure = 0
    for r in docs.collect():
        raw = (r.text or "").lower().encode()
        sizes = []
        for name, d in dicts.items():
            whole = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            whole.precompute_compress(level=9)
            c = zstandard.ZstdCompressor(dict_data=whole, level=9, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(c.compress(raw[k : k + 4096])) for k in range(0, len(raw), 4096)), name))
        best, second = sorted(sizes)[:2]
        gap = (second[0] - best[0]) / second[0] if second[0] else 0.0
        assert (got[r.doc_id].size, got[r.doc_id].runner_up, got[r.doc_id].margin) == (best[0], second[1], gap)
        assert got[r.doc_id].lang == (best[1] if gap >= 0.02 else None)
        sure += got[r.doc_id].accepted
        right += got[r.doc_id].accepted and got[r.doc_id].lang == r.lang
    assert sure > 0.9 * len(got) and right > 0.97 * sure


def test_language_of_texts_not_trained_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    got = language_id.identify(docs.where(odd), language_id.dictionaries(docs.where(~odd))).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    n, accepted, right = got.agg(F.count("*"), F.count_if("accepted"), F.count_if(F.col("lang") == F.col("truth"))).first()
    assert accepted > 0.95 * n and right > 0.98 * accepted


def test_dictionaries_hold_whole_texts(spark):
    docs = spark.createDataFrame([(k, f"text {k} " + "long " * 3000 + f"end {k}", "x") for k in range(30)] + [(0, "other text of id 0", "x"), (50, "y", "y")], "doc_id bigint, text string, lang string")
    dicts = language_id.dictionaries(docs)
    assert all(f"end {k}\n".encode() in dicts["x"] for k in range(30)) and len(dicts["x"]) > 30 * 15_000 and dicts["y"] == b"y\n"
    assert len(language_id.dictionaries(docs, sample_docs=7)["x"].splitlines()) == 7
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = language_id.identify(named, dicts).where("doc_id = 'd50'").first()
    assert got.size > 0


def test_language_awkward(spark):
    docs = awkward(spark)
    dicts = language_id.dictionaries(docs)
    got = language_id.identify(docs, dicts).collect()
    assert len(got) == docs.count() and all(not r.accepted and r.size == 0 for r in got if r.doc_id in (2, 3))
    assert language_id.identify(empty(spark), dicts).count() == 0
    assert {r.size for r in language_id.identify(docs, {}).collect()} == {None}
    assert len({tuple(r) for r in got if r.doc_id == 1}) == 1 and len([r for r in got if r.doc_id == 1]) == 2
    assert language_id.dictionaries(empty(spark)) == {}
    tie = language_id.identify(docs, {"a": b"some words" * 9, "b": b"some words" * 9}).collect()
    assert not any(r.accepted for r in tie)


# ---------------------------------------------------------------- 2


def test_chat_round_trip(spark):
    conversations = spark.read.parquet(f"{DATA}/conversations.parquet")
    told = chat_format.canonical(chat_format.records(conversations))
    assert told.where("mapping is null").count() == 0 and told.select("mapping").distinct().count() > 3
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in told.collect()}
    want = {}
    for r in conversations.orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == want


def test_chat_layouts(spark):
    rows = [
        ('{"messages":[{"role":"USER ","content":"a"},{"role":"assistant","content":null}]}', "messages", [("user", "a")]),
        ('{"prompt":"p","completion":"c"}', "prompt", [("user", "p"), ("assistant", "c")]),
        ('{"instruction":"i","input":"x","output":"o"}', "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ('{"instruction":"i","output":"o","history":[["q","r"]]}', "instruction", [("user", "q"), ("assistant", "r"), ("user", "i"), ("assistant", "o")]),
        ('{"output":"o","instruction":"i"}', "instruction", [("user", "i"), ("assistant", "o")]),
        ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}],"id":"7"}', "conversations", [("user", "h"), ("assistant", "g")]),
        ('{"messages":[{"content":"a"},{"content":"b"}],"id":1}', "messages", [("user", "a"), ("user", "b")]),
        ('{"conversations":[{"value":"h"}]}', "conversations", [("user", "h")]),
        ('{"dialog":{"turns":[{"utterance":"h","speaker":null},{"utterance":"h","speaker":null}]}}', "dialogue", [("user", "h"), ("user", "h")]),
        ('{"prompt":"' + "long " * 40_000 + '","completion":"c"}', "prompt", [("user", "long " * 40_000), ("assistant", "c")]),
        ('{"unknown":1}', None, None),
        ("no json", None, None),
        ("", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(r[0], 1, "x") for r in rows], "record string, fingerprint int, turns string")
    got = chat_format.canonical(df)
    assert got.columns == ["record", "fingerprint", "turns", "fingerprint_", "mapping", "turns_"]
    for r, (record, mapping, turns) in zip(got.collect(), rows):
        assert (r.mapping, r.turns_ and [(t.role, t.text) for t in r.turns_]) == (mapping, turns), record
        assert (r.fingerprint_ is None) == (record in (None, "", "no json"))
    assert chat_format.canonical(df.where("false")).count() == 0


def test_chat_awkward(spark):
    rows = [(1, 0, None, "a"), (1, 1, None, "b"), (2, 0, "user", None), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 1, "assistant", LONG), (None, 0, "user", "n"), (4, None, "USER ", "q"), (5, 0, "user", "p"), (5, 1, "assistant", ""), (6, 0, "user", "p"), (6, 1, "assistant", "r")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, said string")
    got = {}
    for r in chat_format.canonical(chat_format.records(table)).collect():
        got[r.conv_id] = [(t.role, t.text) for t in r.turns]
    assert got == {1: [("user", "a"), ("user", "b")], 3: [("user", "x"), ("user", "x"), ("assistant", LONG)], None: [("user", "n")], 4: [("user", "q")], 5: [("user", "p"), ("assistant", "")], 6: [("user", "p"), ("assistant", "r")]}
    assert chat_format.canonical(chat_format.records(table.where("false"))).count() == 0


def test_chat_plan_parses_once(spark):
    plan = chat_format.canonical(chat_format.records(spark.read.parquet(f"{DATA}/conversations.parquet")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") <= 2 and len(plan) < 60_000


# ---------------------------------------------------------------- 3


def test_sketch_by_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(0, 300))) for _ in range(40)] + [LONG]
    got = {x.doc_id: x for x in fingerprints.sketch(docs_of(spark, texts), scale=1).collect()}
    for i, t in enumerate(texts):
        ws = [h for h, _, _ in brute.word_spans(t)]
        grams = {tuple(ws[k : k + 5]) for k in range(max(len(ws) - 4, min(len(ws), 1)))}
        assert got[i].n_shingles == len(grams) == len(got[i].sketch)
    part = {x.doc_id: x for x in fingerprints.sketch(docs_of(spark, texts), scale=8).collect()}
    for i in part:
        assert part[i].sketch == [h for h in got[i].sketch if h % (1 << 64) < (1 << 64) // 8] or set(part[i].sketch) == {h for h in got[i].sketch if h % (1 << 64) < (1 << 64) // 8}


def test_sketches_merge_and_contain(spark):
    words = LONG.split()
    r = random.Random(1)
    book = " ".join(f"t{r.randrange(9000)}" for _ in range(30000))
    texts = [book, " ".join(book.split()[:3000]), " ".join(book.split()[3000:]), " ".join(words[:500])]
    s = fingerprints.sketch(docs_of(spark, texts), scale=16)
    a, b = s.alias("a"), s.alias("b")
    c = {(r.x, r.y): r.c for r in a.crossJoin(b).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), fingerprints.containment(F.col("a.sketch"), F.col("b.sketch")).alias("c")).collect()}
    assert c[1, 0] == 1.0 and abs(c[0, 1] - 0.1) < 0.03 and c[3, 0] in (0.0, None)
    pairs = {(r.part, r.whole): r.containment for r in fingerprints.contained(s, s, 0.05).collect()}
    assert pairs == {k: v for k, v in c.items() if v and v >= 0.05}
    both = fingerprints.merge(s.where("doc_id in (1, 2)").withColumn("g", F.lit(1)), "g").first().sketch
    assert len(set(s.where("doc_id = 0").first().sketch) - set(both)) <= 2
    got = fingerprints.sketch(awkward(spark)).collect()
    assert {r.n_shingles for r in got if r.doc_id in (2, 3, 5)} == {0} and len(got) == 8
    assert fingerprints.sketch(empty(spark)).count() == 0


# ---------------------------------------------------------------- 4


def test_suffix_array_and_fm_index():
    r = np.random.default_rng(3)
    for n, top in ((0, 3), (1, 3), (200, 2), (500, 40), (300, 0)):
        s = r.integers(0, top + 1, n)
        assert fm_index.suffix_array(s, top).tolist() == sorted(range(n), key=lambda k: s[k:].tolist())
    hashes = r.integers(1, 6, 400).astype(np.uint64)
    first = np.array([0, 0, 100, 101, 400])
    index = fm_index.FMIndex(hashes, first)
    for size in (1, 2, 3, 5):
        phrase = hashes[150 : 150 + size]
        low, high = index.search(index.symbols(phrase)[None], np.array([size]))
        doc, at = index.locate(np.arange(low[0], high[0]))
        want = {(d, k - first[d]) for d in range(4) for k in range(first[d], first[d + 1] - size + 1) if (hashes[k : k + size] == phrase).all()}
        assert set(zip(doc.tolist(), at.tolist())) == want


@pytest.mark.parametrize("shard_words", [50, 1 << 20])
def test_contaminated_by_brute_force(spark, shard_words):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(30)}"
    bench = [" ".join(word() for _ in range(n)) for n in (3, 5, 8, 12, 30)] + ["", None, "w1 w2 w3 w4 w5 w6 w7 w8 w9", "w1 w2 w3 w4 w5 w6 w7 w8 w9"]
    texts = [None, "", "w1, W2; w3 - w4 é w5 w6 w7 w8 w9", LONG]
    for _ in range(60):
        ws = [word() for _ in range(r.randrange(60))]
        if r.random() < 0.6:
            at = r.randrange(len(ws) + 1)
            ws[at:at] = (r.choice(bench[:5]) or "").split()
        texts.append("  ".join(ws).upper() if r.random() < 0.3 else " ".join(ws))
    phrases = brute.benchmark_phrases(bench, 8, 4)
    benchmark = spark.createDataFrame([(k, b) for k, b in enumerate(bench)], "item_id bigint, text string")
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in decontaminate.contaminated(docs_of(spark, texts), benchmark, shard_words=shard_words).collect()}
    want = {i: s for i, t in enumerate(texts) if t and (s := brute.contaminated(t, phrases))}
    assert got == want and len(want) > 20
    kept = {x.doc_id: x.text for x in decontaminate.remove(docs_of(spark, texts), benchmark, shard_words=shard_words).collect()}
    assert kept == {i: brute.cut(t, want[i]) if i in want else t for i, t in enumerate(texts)}


def test_decontaminate_passes_and_awkward(spark, monkeypatch):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    once = sorted(map(str, decontaminate.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "PHRASE_WORDS", 3000)
    assert decontaminate.phrase_blocks(benchmark, 8, 4, "text")[1] > 1
    assert sorted(map(str, decontaminate.contaminated(docs, benchmark).collect())) == once and once
    assert decontaminate.remove(awkward(spark), benchmark).columns == awkward(spark).columns
    assert sorted(map(str, decontaminate.remove(awkward(spark), benchmark).collect())) == sorted(map(str, awkward(spark).collect()))
    assert decontaminate.remove(empty(spark), benchmark).count() == decontaminate.contaminated(docs, benchmark.where("false")).count() == 0


# ---------------------------------------------------------------- 5


def test_mixing_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    got = mixing.mix(docs, mixing.WEIGHTS).groupBy("doc_id", "source").agg(F.max("copy_no").alias("n"), F.count("*").alias("rows"))
    want = {}
    for i, n in brute.mixed([(r.doc_id, r.source, r.text) for r in docs.collect()], mixing.WEIGHTS, mixing.SEED):
        want[i] = want.get(i, 0) + n
    have = {}
    for r in got.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + r.rows
    assert have == {i: n for i, n in want.items() if n}


def test_mixing_awkward(spark, monkeypatch):
    got = mixing.mix(awkward(spark), factor=20.0)
    assert "copy_no_" in got.columns and got.where("doc_id = 2").count() > 0
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    assert mixing.mix(awkward(spark), factor=20.0).count() == got.count()
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(awkward(spark), {"a": 0.0, "b": -1.0}).where("source in ('a', 'b')").count() == 0


# ---------------------------------------------------------------- 10


def test_golay_keys():
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 23, 4000)
    for errors in (0, 1, 2):
        y = x.copy()
        for k in range(len(y)):
            for b in r.choice(23, errors, replace=False):
                y[k] ^= 1 << int(b)
        a, b = golay.keys(x), golay.keys(y)
        assert all(set(p) & set(q) - {-1} for p, q in zip(a.tolist(), b.tolist()))


def near_texts(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        ws = [f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(r.randrange(30, 400))]
        texts.append(" ".join(ws))
        for _ in range(r.choice([0, 0, 0, 1, 3, 30])):
            edited = [w if r.random() > 0.02 else f"e{r.randrange(5000)}" for w in ws]
            texts.append(" ".join(edited))
    r.shuffle(texts)
    return texts


def groups_by_keys(texts):
    """Row to the least row of its group, and how many pairs within MOST_BITS share no key, from all pairs."""
    fp, some = near_dedup.fingerprints(pa.array(texts, pa.string()))
    ints = [int(a) << 64 | int(b) for a, b in fp.tolist()]
    keys = [set(k) - {-1} for k in near_dedup.key_matrix(fp[:, 0].view(np.int64), fp[:, 1].view(np.int64)).tolist()]
    inner = sum(((1 << 46) - 1) << s for s in (0, 64))  # the bits of the segments
    root, missed = list(range(len(texts))), 0

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if some[i] and some[j]:
                apart = (ints[i] ^ ints[j]).bit_count()
                if ((ints[i] ^ ints[j]) & inner).bit_count() <= 8:
                    assert keys[i] & keys[j]
                if apart <= near_dedup.MOST_BITS:
                    if ints[i] == ints[j] or keys[i] & keys[j]:
                        a, b = sorted((top(i), top(j)))
                        root[b] = a
                    else:
                        missed += 1
    return {i: top(i) for i in range(len(texts)) if some[i]}, missed


@pytest.mark.parametrize("seed,wide", [(1, 24), (2, 2), (3, 24)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, seed, wide):
    monkeypatch.setattr(near_dedup, "WIDE_RUN", wide)
    texts = near_texts(seed)
    exact, _ = groups_by_keys(texts)
    got = {r.doc_id: r.duplicate_of for r in near_dedup.duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: g for i, g in exact.items() if i != g} and len(got) > 100
    want = {i: g for i, g in brute.near_groups(list(enumerate(texts))).items() if i != g}
    assert sum(got.get(i) == g for i, g in want.items()) >= 0.95 * len(want)  # the search is approximate beyond 8 bits


def test_near_pairs_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    exact, missed = groups_by_keys([r.text for r in rows])
    got = {r.doc_id: r.duplicate_of for r in near_dedup.duplicates(docs).collect()}
    assert got == {rows[i].doc_id: rows[g].doc_id for i, g in exact.items() if i != g} and missed <= 6


def test_distance_counts_every_bit():
    a = np.array([[-1, 0], [1 << 62, -(1 << 63)], [-5, 7]])
    b = np.array([[0, 0], [-(1 << 63), 1], [5, -7]])
    want = [sum(((int(x) ^ int(y)) & (2**64 - 1)).bit_count() for x, y in zip(p, q)) for p, q in zip(a, b)]
    assert near_dedup.distance(a, b).tolist() == want == [64, 4, 126]


def test_forest():
    r = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 20), (300, 290), (300, 2000)):
        pairs = r.integers(0, n, (m, 2))
        root = list(range(n))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs.tolist():
            a, b = sorted((top(a), top(b)))
            root[b] = a
        assert near_dedup.forest(pairs, n).tolist() == [top(i) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 7, 9000])
def test_keys_survive_packing(parts):
    hi, lo = np.random.default_rng(parts).integers(-(1 << 63), 1 << 63, (2, 200))
    got = set()
    for _, blob in near_dedup.key_blobs(hi, lo, parts):
        fp, row, keys = near_dedup.unpacked(blob)
        got |= set(zip(*fp[row].T.tolist(), keys.tolist()))
    want = {(h, x, k) for h, x, ks in zip(hi.tolist(), lo.tolist(), near_dedup.key_matrix(hi, lo).tolist()) for k in ks if k >= 0}
    assert got == want


def test_near_awkward(spark):
    docs = awkward(spark)
    assert near_dedup.duplicates(docs).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1  # the repeated row
    assert near_dedup.keep_one(empty(spark)).count() == 0 and near_dedup.duplicates(empty(spark)).count() == 0
    twice = docs_of(spark, ["one and the same text", "one and the same text", "One,  and the same TEXT!", "another thing altogether, of other words"])
    assert sorted((r.doc_id, r.duplicate_of) for r in near_dedup.duplicates(twice).collect()) == [(1, 0), (2, 0)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(500, 501), (501, 501)], "a bigint, b bigint")
    roots = {r.node: r.root for r in near_dedup.components(chain).collect()}
    assert roots == {k: 0 for k in range(1, 301)} | {501: 500}


def test_near_rows_without_ids_and_of_one_id(spark):
    same, other, third = "one and the same text of some words", "another thing altogether, of other words", "a third matter without anything of these"
    rows = [(None, same), (None, same), (4, same), (2, other), (2, third), (7, third), (8, other), (None, "a lone one, quite unlike"), (None, "a lone one, quite unlike"), (9, None), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "x", {"a": 1}) for i, t in rows], "doc_id bigint, text string, keeper string, group map<string,int>")
    assert sorted((r.doc_id, r.duplicate_of) for r in near_dedup.duplicates(docs).collect()) == [(7, 2), (8, 2)]
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect()), key=str)
    assert kept == sorted([(4, same), (2, third), (None, "a lone one, quite unlike"), (9, None), (9, None), (9, "")], key=str)
    named = docs.select(F.concat(F.lit("d"), F.coalesce("doc_id", F.lit(0))).alias("doc_id"), "text")
    assert {(r.doc_id, r.duplicate_of) for r in near_dedup.duplicates(named).collect()} == {("d4", "d0"), ("d7", "d2"), ("d8", "d2")}


def test_no_local_checkpoint_or_temporary_folder():
    from pathlib import Path

    for p in Path(near_dedup.__file__).parent.glob("*.py"):
        assert not re.search(r"localCheckpoint\(", p.read_text())
    assert pa is not None
