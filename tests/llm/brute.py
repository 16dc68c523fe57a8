"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa

from webloom.llm import near_dedup
from webloom.llm.text import word_chunks


def word_spans(text):
    """Hash, start and end (characters) of each word."""
    if not text:
        return []
    out = []
    for _, w in word_chunks(pa.array([text])):
        raw = bytes(w.data)
        out += [(h, len(raw[:a].decode()), len(raw[:b].decode())) for h, a, b in zip(w.hashes.tolist(), w.starts, w.ends)]
    return out


def benchmark_phrases(texts, n, least):
    out = set()
    for t in texts:
        hs = [h for h, _, _ in word_spans(t)]
        if len(hs) >= n:
            out |= {tuple(hs[k : k + n]) for k in range(len(hs) - n + 1)}
        elif len(hs) >= least:
            out.add(tuple(hs))
    return out


def contaminated(text, phrases):
    """Merged spans in characters."""
    ws = word_spans(text)
    sizes = {len(p) for p in phrases}
    found = sorted((k, k + n) for n in sizes for k in range(len(ws) - n + 1) if tuple(h for h, _, _ in ws[k : k + n]) in phrases)
    joined = []
    for a, b in found:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    return [(ws[a][1], ws[b - 1][2]) for a, b in joined]


def cut(text, spans):
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return text


def near_groups(rows, most=near_dedup.MOST_BITS):
    """Id to the least id of its group, for (id, text), by comparing all fingerprints with all."""
    fp, some = near_dedup.fingerprints(pa.array([t for _, t in rows], pa.string()))
    use = [k for k, (i, _) in enumerate(rows) if some[k] and i is not None]
    root = {rows[k][0]: rows[k][0] for k in use}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k in use:
        near = np.bitwise_count(fp[use] ^ fp[k]).sum(axis=1) <= most
        for j in np.flatnonzero(near):
            a, b = sorted((top(rows[k][0]), top(rows[use[j]][0])))
            root[b] = a
    return {i: top(i) for i in root}


def mixed(rows, weights, seed):
    """(id, copies) for (id, source, text)."""
    count = lambda t: len(re.findall(r"[^ \t\n\r\f]+", t or ""))
    total = {}
    for _, s, t in rows:
        total[s] = total.get(s, 0) + count(t)
    weight = {s: weights.get(s, 1.0) if n else 0.0 for s, n in total.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(total.values()) / n if n else 0.0 for s, n in total.items()}
    out = []
    for i, s, _ in rows:
        draw = int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) / 4294967296
        out.append((i, math.floor(rate[s]) + (draw < rate[s] - math.floor(rate[s]))))
    return out
