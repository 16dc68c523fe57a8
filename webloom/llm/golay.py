"""The perfect binary Golay code of length 23: nearest codewords of 23-bit vectors, in numpy."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

_POLY = 0b110001110101


def _parity(info: int) -> int:
    """Remainder of info * x**11 by the generator polynomial."""
    r = info << 11
    for k in range(22, 10, -1):
        if r >> k & 1:
            r ^= _POLY << (k - 11)
    return r


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """parity: check bits of 12 information bits. flips: for each syndrome the information bits to flip to get the codeword of
    each key: that of the nearest codeword and, when it is three errors away, of the five at four errors; -1 for no key."""
    parity = np.array([_parity(i) for i in range(4096)], np.int32)
    sevens = [w for w in (i << 11 | int(parity[i]) for i in range(4096)) if w.bit_count() == 7]
    flips = np.full((2048, 6), -1, np.int32)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            near = [e] + [e ^ w for w in sevens if w & e == e] * (weight == 3)
            flips[int(parity[e >> 11]) ^ (e & 2047), : len(near)] = [x >> 11 for x in near]
    return parity, flips


def keys(segments: np.ndarray) -> np.ndarray:
    """Up to six codeword indices (12 bits; -1 for none) of each 23-bit vector. Vectors that differ in at most two bits share one."""
    parity, flips = tables()
    info = segments >> 11
    flip = flips[parity[info] ^ (segments & 2047)]
    return np.where(flip < 0, -1, info[..., None] ^ flip)
