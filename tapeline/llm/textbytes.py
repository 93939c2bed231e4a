"""Whole batches of texts as one byte buffer: word bounds and 64-bit hashes of spans, all in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=_U) * _U(0xBF58476D1CE4E5B9)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUES = _byte_values()

IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n. Not kept: module state would travel with pickled functions."""
    out = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(n, base, dtype=_U)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def pack(texts: list[bytes], fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each followed by a newline, and the places where they begin (one more than texts)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, dtype=np.uint8)
    if fold_case:
        buf = LOWER[buf]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buf, starts


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't blank. The buffer ends with a newline."""
    blank = IS_BLANK[buf]
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(buf) and not blank[0]:
        change = np.concatenate(([0], change))
    return change[0::2], change[1::2]


class SpanHash:
    """Hashes of any spans of a buffer; equal bytes give equal hashes, wherever they stand and in any buffer."""

    def __init__(self, buf: np.ndarray, salt: int = 0):
        up, self.down = powers(len(buf) + 1)
        values = BYTE_VALUES if not salt else mix(BYTE_VALUES + _U(salt))
        self.sums = np.zeros(len(buf) + 1, dtype=_U)
        np.cumsum(values[buf] * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
