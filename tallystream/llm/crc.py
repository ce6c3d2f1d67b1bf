"""CRC-32 of joined byte strings from those of their parts, for whole arrays at once."""

from __future__ import annotations

import zlib

import numpy as np

_POLY = np.uint32(0xEDB88320)
_PLACES = np.arange(256, dtype=np.uint32)


def _one_byte() -> np.ndarray:
    """What a zero byte makes of a state, as four tables of 256 (one for each byte of the state) that are xor-ed."""
    t = _PLACES.copy()
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), _POLY, np.uint32(0))
    return np.stack([t, _PLACES, _PLACES << np.uint32(8), _PLACES << np.uint32(16)])


def _through(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    byte = lambda k: (state >> np.uint32(8 * k)) & np.uint32(255)
    return tables[0][byte(0)] ^ tables[1][byte(1)] ^ tables[2][byte(2)] ^ tables[3][byte(3)]


_POWERS: list[np.ndarray] = [_one_byte()]
_BY_LENGTH: dict[int, np.ndarray] = {}
#: Lengths whose tables are kept (4 KB each); those of longer parts are made anew.
KEPT = 256


def _zeros(n: int) -> np.ndarray:
    """Tables of n zero bytes, by squaring."""
    if n in _BY_LENGTH:
        return _BY_LENGTH[n]
    out = np.stack([_PLACES << np.uint32(8 * k) for k in range(4)])
    bit, rest = 0, n
    while rest:
        if bit == len(_POWERS):
            _POWERS.append(_through(_POWERS[-1], _POWERS[-1]))
        if rest & 1:
            out = _through(_POWERS[bit], out)
        rest, bit = rest >> 1, bit + 1
    if n <= KEPT:
        _BY_LENGTH[n] = out
    return out


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the strings left + right, from those of both and the byte lengths of the right ones."""
    out = right.astype(np.uint32)
    if not len(out):
        return out
    if int(length.max()) > KEPT:  # a group for each length
        order = np.argsort(length, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            out[at] ^= _through(_zeros(int(length[at[0]])), left[at].astype(np.uint32))
        return out
    there = np.flatnonzero(np.bincount(length))
    which = np.zeros(int(there[-1]) + 1, np.int64)
    which[there] = np.arange(len(there))
    which, tables, state = which[length], np.stack([_zeros(n) for n in there.tolist()]), left.astype(np.uint32)
    for k in range(4):
        out ^= tables[:, k][which, (state >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def of_each(values: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(v) for v in values), np.uint32, len(values))
