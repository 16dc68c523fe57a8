"""PII: a character-level bidirectional LSTM with a CRF over its outputs, trained in numpy.

Labelled spans for training are written by a seeded generator: values of every kind of KINDS set into invented prose, beside
look-alikes that aren't private (versions, years, counts, licence lines, names, plain assignments). The network reads character
classes, so that it carries over to any words and digits.

Texts are decoded in windows of WINDOW characters; each reaches MARGIN characters into its neighbours, and a character is labelled by
the window that has it in its middle, so that spans that run through several windows come out whole. Every character of every text
is read by the network, and nothing but the network decides. Only the search for the best tags is spared where it can't matter: a bound on
what any path of tags can gain over "nothing private here" shows for most windows that this is the best one.
"""

from __future__ import annotations

import hashlib
import random
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Batches, free_name, mapped, rows_of, save, shared_dir

KINDS = ("email", "phone", "ip", "card", "key")
#: "O", then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, MARGIN = 384, 48
SPANS = "array<struct<start:int,end:int,kind:string>>"

_OWN = " .@-+()=\"'_:/\n,"
#: Classes: digit, lower, upper, other letter, other, letters of hexadecimal numbers, each of _OWN, and letters of signal words.
_SIGNAL = "tokenpaswrdmilAKI"
CLASSES = 6 + len(_OWN) + len(_SIGNAL)


@cache
def _classes() -> np.ndarray:
    t = np.full(0x10000, 4, np.int64)
    for i in range(0x250):
        c = chr(i)
        t[i] = 0 if c in "0123456789" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if c.isalpha() else 4
    t[0x250:][[chr(i).isalpha() for i in range(0x250, 0x10000)]] = 3
    for i, c in enumerate("bcf"):
        t[ord(c)] = 5
    for i, c in enumerate(_OWN):
        t[ord(c)] = 6 + i
    for i, c in enumerate(_SIGNAL):
        t[ord(c)] = 6 + len(_OWN) + i
    return t


def classes(points: np.ndarray) -> np.ndarray:
    return _classes()[np.minimum(points, 0xFFFF)]


class Network:
    """Weights, by direction d of "f" and "b": x (4 hidden, classes), h (4 hidden, hidden), the input, forget and output gates' rows before
    those of the cell, halved (a sigmoid is a tanh of the half); o (tags, hidden). c (tags); t (tags, tags), from row to column."""

    def __init__(self, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        w = lambda *shape: (r.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        self.hidden = hidden
        self.w = {k + d: v for d in "fb" for k, v in (("x", w(4 * hidden, CLASSES)), ("h", w(4 * hidden, hidden)), ("o", w(TAGS, hidden)))}
        for d in "fb":
            self.w["x" + d][hidden : 2 * hidden] += 0.5  # forget gates begin open
        self.w |= {"c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}

    def states(self, x: np.ndarray, d: str, kept: list | None = None) -> np.ndarray:
        """Hidden states (time, hidden, batch) after each of x (time, batch), read in this order; kept gets what the backward pass needs."""
        (n, batch), hid = x.shape, self.hidden
        wx, wh = self.w["x" + d].T.copy(), self.w["h" + d]
        out = np.empty((n, hid, batch), np.float32)
        h, c, z, part = np.zeros((hid, batch), np.float32), np.zeros((hid, batch), np.float32), np.empty((4 * hid, batch), np.float32), np.empty((hid, batch), np.float32)
        for t in range(n):
            if kept is not None:
                z = np.empty_like(z)
            np.matmul(wh, h, out=z)
            z += wx[x[t]].T
            np.tanh(z, out=z)
            gate = z[: 3 * hid]
            gate *= np.float32(0.5)
            gate += np.float32(0.5)
            old = c
            c = z[hid : 2 * hid] * c
            np.multiply(z[:hid], z[3 * hid :], out=part)
            c += part
            np.tanh(c, out=part)
            h = out[t]
            np.multiply(z[2 * hid : 3 * hid], part, out=h)
            if kept is not None:
                kept.append((z, old, part.copy()))
        return out

    def emissions(self, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores (time, tags, batch) of sequences: first holds their classes from the beginning on, last from the end back, size how many
        there are of each; what is beyond a sequence's end counts for nothing."""
        e = np.matmul(self.w["of"], self.states(first, "f")) + self.w["c"][:, None]
        back = np.matmul(self.w["ob"], self.states(last, "b"))
        if len(size) and size.min() == len(first):
            e += back[::-1]
        else:
            at = np.maximum(size - 1 - np.arange(len(first))[:, None], 0)
            e += np.take_along_axis(back, np.broadcast_to(at[:, None, :], e.shape), axis=0)
        return e

    def sure(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which sequences have, for certain, no better tags than O throughout: where no run of other tags, each of its steps at the most
        that any tag can gain there over O, gains anything with its way in and its way out."""
        t = self.w["t"] - self.w["t"][0, 0]
        out = max(0.0, float(t[1:, 0].max()))
        begins, goes_on = e[:, 1:].max(axis=1) - e[:, 0], (e[:, 1:] + t[1:, 1:].max(axis=0)[:, None]).max(axis=1) - e[:, 0]
        enters = (e[:, 1:] + t[0, 1:, None]).max(axis=1) - e[:, 0]
        gain = begins[0]
        ok = gain + out < -1e-3
        for k in range(1, len(e)):
            gain = np.maximum(enters[k], gain + goes_on[k])
            ok &= (gain + out < -1e-3) | (k >= size)
        return ok

    def best(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best tags (time, batch) by scores e: Viterbi. What is beyond a sequence's end has the tag O."""
        n, _, batch = e.shape
        score, back = e[0], np.empty(e.shape, np.int8)
        for t in range(1, n):
            each = score[:, None, :] + self.w["t"][:, :, None]
            back[t] = each.argmax(axis=0)
            score = np.where(t < size, each.max(axis=0) + e[t], score)
        tags = np.zeros((n, batch), np.int8)
        now, rows = score.argmax(axis=0), np.arange(batch)
        for t in range(n - 1, -1, -1):
            live = t < size
            tags[t, live] = now[live]
            if t:
                now = np.where(live, back[t][now, rows], now)
        return tags

    def decode(self, first: np.ndarray, last: np.ndarray, size: np.ndarray, bound: bool = True) -> np.ndarray:
        """The best tags (time, batch). Without bound, the search is made for all sequences."""
        e = self.emissions(first, last, size)
        tags = np.zeros((len(e), e.shape[2]), np.int8)
        todo = np.flatnonzero(~self.sure(e, size)) if bound else np.arange(e.shape[2])
        if len(todo):
            tags[:, todo] = self.best(e[:, :, todo], size[todo])
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y given x (time, batch), and its gradients."""
        n, batch = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        hs = {"f": self.states(x, "f", kept["f"]), "b": self.states(x[::-1], "b", kept["b"])}
        e = np.matmul(self.w["of"], hs["f"]) + np.matmul(self.w["ob"], hs["b"])[::-1] + self.w["c"][:, None]
        # forward and backward sums of the CRF, scaled at each step
        top = e.max(axis=1, keepdims=True)
        p, tr = np.exp(e - top), np.exp(self.w["t"])
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((n, batch), np.float32)
        for t in range(n):
            a = p[t] if t == 0 else (tr.T @ alpha[t - 1]) * p[t]
            scale[t] = a.sum(axis=0)
            alpha[t] = a / scale[t]
        ahead = np.empty_like(e)
        for t in range(n - 1, 0, -1):
            ahead[t] = p[t] * beta[t] / scale[t]
            beta[t - 1] = tr @ ahead[t]
        steps, rows = np.arange(n)[:, None], np.arange(batch)
        gold = e[steps, y, rows].sum() + self.w["t"][y[:-1], y[1:]].sum()
        loss = float((np.log(scale).sum() + top.sum() - gold) / batch)
        de = alpha * beta
        flat = lambda a: a.transpose(1, 0, 2).reshape(a.shape[1], -1)
        dt = tr * (flat(alpha[:-1]) @ flat(ahead[1:]).T)
        np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1)
        de[steps, y, rows] -= 1
        de /= batch
        g = {"t": dt / batch, "c": de.sum(axis=(0, 2))}
        hid = self.hidden
        for d, xs, des in (("f", x, de), ("b", x[::-1], de[::-1])):
            g["o" + d] = flat(des) @ flat(hs[d]).T
            dh = np.matmul(self.w["o" + d].T, des)
            h_next, c_next = np.zeros((hid, batch), np.float32), np.zeros((hid, batch), np.float32)
            dzs, wh = np.empty((n, 4 * hid, batch), np.float32), self.w["h" + d].T.copy()
            for t in range(n - 1, -1, -1):
                z, old, th = kept[d][t]
                i, f, o, cell = z[:hid], z[hid : 2 * hid], z[2 * hid : 3 * hid], z[3 * hid :]
                h = dh[t] + h_next
                c = c_next + h * o * (1 - th * th)
                dz = dzs[t]
                dz[:hid], dz[hid : 2 * hid], dz[2 * hid : 3 * hid] = c * cell, c * old, h * th
                gate = z[: 3 * hid]
                dz[: 3 * hid] *= 2 * gate * (1 - gate)
                dz[3 * hid :] = c * i * (1 - cell * cell)
                h_next, c_next = wh @ dz, c * f
            before = np.concatenate((np.zeros((1, hid, batch), np.float32), hs[d][:-1]))
            one = np.zeros((n * batch, CLASSES), np.float32)
            one[np.arange(n * batch), xs.ravel()] = 1
            g["h" + d], g["x" + d] = flat(dzs) @ flat(before).T, flat(dzs) @ one
        return loss, g


_LOWER, _DIGITS, _HEXA = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_UPPER = _LOWER.upper()
_FAR = 0.05  # share of e-mail addresses that reach far


def _value(r: random.Random, kind: str) -> tuple[str, str, str]:
    """What comes before a value (its label, no part of it), the value, and what comes after."""
    pick = lambda s, a, b=None: "".join(r.choices(s, k=a if b is None else r.randrange(a, b)))
    if kind == "email":
        many = r.randrange(3, 8) if r.random() < _FAR else 0  # some reach far on either side of the @
        user = "".join(pick(_LOWER, 4, 12) + "." for _ in range(many)) + pick(_LOWER, 2, 9) + (r.choice("._-+") + pick(_LOWER + _DIGITS, 2, 6) if r.random() < 0.6 else "")
        if r.random() < 0.4:
            user += pick(_DIGITS, 1, 4)
        host = ".".join(pick(_LOWER, 3, 9) + (pick(_DIGITS, 1) if r.random() < 0.3 else "") for _ in range(r.randrange(1, 3) + (many if r.random() < 0.5 else 0)))
        return "", f"{user}@{host}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'edu'])}", ""
    if kind == "phone":
        a, b, c = pick(_DIGITS, 3), pick(_DIGITS, 3), pick(_DIGITS, 4)
        cc = f"+{r.randrange(1, 99)} "
        return "", r.choice([f"{cc}({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{cc}{a} {b} {c}", f"{cc}{a}-{b}-{c}"]), ""
    if kind == "ip":
        return "", ".".join(str(r.randrange(0 if k else 1, 256)) for k in range(4)), ""
    if kind == "card":
        d = [r.choice("453") + pick(_DIGITS, 3)] + [pick(_DIGITS, 4) for _ in range(3)]
        return "", r.choice(["", "", " ", "-"]).join(d), ""
    form = r.randrange(4)
    signs = r.choice([_LOWER, _HEXA, _LOWER + _DIGITS, _LOWER + _UPPER, _LOWER + _UPPER + _DIGITS])
    if form == 0:
        return "", "AKIA" + pick(_UPPER + r.choice(["", "234567", _DIGITS]), 16), ""
    if form == 1:
        return r.choice(["password", "passwd", "pwd", "pass", "Password"]) + r.choice(["=", "=", ": "]), pick(signs, 8, 25) if r.random() < 0.7 else "".join(r.choices(_SYLLABLES[:32], k=r.randrange(4, 9))), ""
    if form == 2:
        mark = r.choice(["\"", "\"", "'"])
        return r.choice(["token", "secret", "api_key", "key"]) + r.choice([" = ", " = ", "=", ": "]) + mark, pick(signs, 16, 41), mark
    return r.choice(["sk-", "ghp_"]), pick(signs if r.random() < 0.3 else _LOWER + _UPPER + r.choice(["", _DIGITS]), 16, 40), ""


def _plain(r: random.Random) -> str:
    """A look-alike that isn't private, or a word."""
    pick = lambda s, n: "".join(r.choices(s, k=n))
    d = _DIGITS
    if r.random() < 0.92:
        form = r.random()
        if form < 0.6:
            word = "".join(r.choices(_SYLLABLES, k=r.randrange(1, 7)))
        elif form < 0.85:  # of any letters
            word = "".join(r.choice(_LOWER) + r.choice("aeiouy") + r.choice(["", "", r.choice(_LOWER)]) for _ in range(r.randrange(1, 5)))
        else:
            word = pick(_LOWER, r.randrange(1, 14))
        style = r.random()
        word = word.capitalize() if style < 0.12 else word.upper() if style < 0.16 else word
        return word + r.choice(["", "", "", "", "", ",", ".", "!!", "###", "%%%", "$$$", " |", ":", ";"])
    word = lambda: "".join(r.choices(_SYLLABLES, k=r.randrange(1, 5)))
    return r.choice([f"Version {pick(d, 1)}.{pick(d, 1)}.", f"version {pick(d, 1)}.", f"4.{pick(d, 1)}.", str(r.randrange(1900, 2100)), pick(d, r.randrange(1, 5)), f"{pick(d, 2)}:{pick(d, 2)}", f"{r.randrange(1, 32)}-{r.randrange(1, 13)}-{r.randrange(1990, 2030)}", f"BY-NC {pick(d, 1)}.0.", f"{pick(d, 1)},{pick(d, 3)}", f"${pick(d, 2)}.{pick(d, 2)}", "v" + pick(d, 1) + "." + pick(d, 1), "@", "= ", f"{word()}{pick(d, r.randrange(1, 4))}", f"{word()}{pick(d, r.randrange(1, 4))}", f"{word()}-{word()}", f"{word()}_{word()}", f"{word()}.{word()}", f"{pick(_LOWER, r.randrange(3, 9))}.{pick(_LOWER, r.randrange(2, 9))}", pick(_UPPER, r.randrange(3, 21)), f"{word()}/{word()}", f"{word()} = {word()}", f"{word()}: {word()}", f'"{word()}"', f"({word()} {word()})", r.choice(["password", "token", "secret", "key", "mail", "the token of", "a key to"]), word().upper() + word().upper()])


_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción mente ñ ado os as ez qu ía ó eau eux ment tion é è ê ç oi ai ou ch sch ung keit heit ü ö ä ß lich ein ver be ge pf tz ie zu ing ly ble able wh ful ness eaux ville pre con".split()


def labelled(r: random.Random, size: int) -> tuple[str, list[tuple[int, int, int]]]:
    """Prose of at least size characters and its spans (start, end, kind)."""
    pieces: list[str] = []
    spans, often, at = [], 0.06, 0

    def put(piece: str) -> None:
        nonlocal at
        pieces.append(piece)
        at += len(piece)

    while at < size:
        if r.random() < often:
            kind = r.randrange(len(KINDS) + 1) % len(KINDS) if r.random() < 0.8 else len(KINDS) - 1
            before, value, after = _value(r, KINDS[kind])
            spans.append((at + len(before), at + len(before) + len(value), kind))
            put(before + value + after + r.choice(["", "", "", ".", ",", "!!", "###"]))
            often = 0.25  # values often come together
        else:
            put(_plain(r))
            often = 0.06 if r.random() < 0.8 else 0.0  # and some prose has none for long
        put("\n" if r.random() < 0.03 else " ")
    return "".join(pieces), spans


def tags_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(size, np.int64)
    for a, b, k in spans:
        y[a:b] = 2 + 2 * k
        y[a : a + 1] = 1 + 2 * k
    return y


@cache
def train(hidden: int = 12, chars: int = 2_000_000, steps: int = 1200, batch: int = 128, length: int = 144, rate: float = 0.02, seed: int = 5) -> Network:
    """A network of the generator's labelled spans, by Adam on random windows; the same for the same arguments."""
    text, spans = labelled(random.Random(seed), chars)
    x, y = classes(np.frombuffer(text.encode("utf-32-le"), np.uint32)), tags_of(len(text), spans)
    r = np.random.default_rng(seed)
    # windows begin with words, and not with a key whose label stands before them
    starts = np.flatnonzero((x[:-length] == int(_classes()[32])) & (y[1 : len(y) - length + 1] != 1 + 2 * KINDS.index("key"))) + 1
    net = Network(hidden, seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    for k in range(1, steps + 1):
        at = r.choice(starts, batch) + np.arange(length)[:, None]
        _, g = net.gradients(x[at], y[at])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        lr = rate * min(1, k / 20) * (1 - k / (steps + 1))
        for name, a in g.items():
            a = a * min(1.0, 5 / (norm + 1e-9))
            m[name] = 0.9 * m[name] + 0.1 * a
            v[name] = 0.99 * v[name] + 0.01 * a * a
            net.w[name] -= (lr * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def network(spark: SparkSession) -> Network:
    """The trained network, from the shared folder if this code has put it there before; else it is trained and put there."""
    mark = hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:16]
    place = f"{shared_dir(spark)}/pii-network-{mark}"
    names = list(Network(1, 0).w)
    if mapped(place, names[-1]) is None:
        for name, w in train().w.items():  # the last name comes last
            save(place, name, w)
    net = Network(1, 0)
    net.w = {name: np.array(mapped(place, name)) for name in names}
    net.hidden = net.w["hf"].shape[1]
    return net


def spans_in(texts: list[str | None], net: Network, bound: bool = True, rows: int = 1024) -> dict[int, list[tuple[int, int, int]]]:
    """Text number to its spans (start, end, kind). bound: as for Network.decode()."""
    inner = WINDOW - 2 * MARGIN
    size = np.array([len(t or "") for t in texts], np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = classes(points).astype(np.int8)
    count = -(-size // inner)
    doc = np.repeat(np.arange(len(texts)), count)
    begin = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * inner
    start, end = np.maximum(begin - MARGIN, off[doc]), np.minimum(begin + inner + MARGIN, off[doc + 1])
    order = np.argsort(end - start, kind="stable")
    marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(order), rows):
        at = order[a : a + rows]
        s, e = start[at], end[at]
        step = np.arange(int((e - s).max()))[:, None]
        tags = net.decode(x[np.minimum(s + step, e - 1)], x[np.maximum(e - 1 - step, s)], e - s, bound)
        t, w = np.nonzero(tags)
        place = s[w] + t
        ok = (place >= begin[at[w]]) & (place < begin[at[w]] + inner)
        marks.append((place[ok], doc[at[w[ok]]], tags[t[ok], w[ok]].astype(np.int64)))
    place, d, tag = (np.concatenate(z) for z in zip(*marks)) if marks else (np.zeros(0, np.int64),) * 3
    if not len(place):
        return {}
    order = np.argsort(place)
    place, d, tag = place[order], d[order], tag[order]
    kind = (tag - 1) // 2
    new = np.ones(len(place), bool)  # a span goes on while neighbours are of one kind and none begins anew
    new[1:] = (place[1:] != place[:-1] + 1) | (d[1:] != d[:-1]) | (kind[1:] != kind[:-1]) | (tag[1:] % 2 == 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(place)) - 1
    out: dict[int, list[tuple[int, int, int]]] = {}
    for i, j in zip(at, last):
        k = int(d[i])
        out.setdefault(k, []).append((int(place[i] - off[k]), int(place[j] + 1 - off[k]), int(kind[i])))
    return out


def with_spans(docs: DataFrame, net: Network, text_col: str, name: str, redact: bool) -> DataFrame:
    """docs with spans (null for none) under name; with redact the values in the texts are replaced by their kinds."""
    place = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def step(b: pa.RecordBatch):
        texts = b.column(place).to_pylist()
        found = spans_in(texts, sent.value)
        col = [None] * len(texts)
        cols = list(b.columns)
        for k, spans in found.items():
            col[k] = [{"start": s, "end": e, "kind": KINDS[i]} for s, e, i in spans]
            if redact:
                t, at, kept = texts[k], 0, []
                for s, e, i in spans:
                    kept += [t[at:s], f"[{KINDS[i].upper()}]"]
                    at = e
                texts[k] = "".join(kept) + t[at:]
        if redact and found:
            cols[place] = pa.array(texts, b.schema.types[place])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        yield pa.RecordBatch.from_arrays([*cols, pa.array(col, kind)], [*b.schema.names, name])

    def run(batches: Batches) -> Batches:
        return rows_of(batches, step)

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, StructType.fromDDL(f"x {SPANS}")["x"].dataType))


def private(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as it is), spans (start, end in characters, kind; in order): a row for each row of docs that holds private data.

    Null and empty texts hold none; long ones are read to their end, window by window. Where two kinds are equally good, the one that
    comes first in KINDS is taken. Null ids and repeated rows are kept as they are, equal texts have equal spans; extra columns are
    left out; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_spans(base, net or network(docs.sparkSession), "text", "spans", False).where("spans is not null").select("doc_id", "spans")


def redacted(docs: DataFrame, net: Network | None = None, text_col: str = "text") -> DataFrame:
    """docs with private values in the texts replaced by [KIND]: all rows and columns stay, other texts are untouched. Cases as for private()."""
    return with_spans(docs, net or network(docs.sparkSession), text_col, free_name(docs, "spans"), True).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
