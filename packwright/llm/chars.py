"""Texts as flat numpy arrays of code points, with the words in them."""

from __future__ import annotations

import numpy as np

from packwright.llm.common import starts_of, worker_cache

_BMP = 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(_BMP, dtype=np.uint32)
    letter = np.zeros(_BMP, bool)
    digit = np.zeros(_BMP, bool)
    for i in range(_BMP):
        c = chr(i)
        low = c.lower()
        lower[i] = ord(low) if len(low) == 1 else i
        letter[i] = c.isalpha()
        digit[i] = c.isdigit()
    return lower, letter, digit


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts in a row, and where each text starts (with the end)."""
    lower = worker_cache("tables", _tables)[0]
    starts = starts_of(np.array([len(t) for t in texts], np.int64))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.size and codes.max() >= _BMP:
        high = codes >= _BMP
        return np.where(high, codes, lower[np.where(high, 0, codes)]), starts
    return lower[codes], starts


def letters(codes: np.ndarray, digits: bool = False) -> np.ndarray:
    """Which code points are letters (or digits as well)."""
    _, letter, digit = worker_cache("tables", _tables)
    table = letter | digit if digits else letter
    if codes.size and codes.max() >= _BMP:
        high = codes >= _BMP
        out = table[np.where(high, 0, codes)]
        kinds, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([chr(k).isalnum() if digits else chr(k).isalpha() for k in kinds], bool)[at]
        return out
    return table[codes]


def runs(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of true values, none across the start of a text."""
    if not mask.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = starts[(starts > 0) & (starts < mask.size)]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    begins[inner] |= mask[inner]
    ends = np.zeros(mask.size + 1, bool)
    ends[1:-1] = mask[:-1] & ~mask[1:]
    ends[-1] = mask[-1]
    ends[inner] |= mask[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def run_hashes(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run, equal for equal runs wherever they are."""
    def make():
        return {"n": -1}
    kept = worker_cache("powers", make)
    if kept["n"] < codes.size:
        n = max(codes.size, 1 << 20)
        kept |= {"n": n, "up": _powers(_BASE, n), "down": _powers(_INVERSE, n)}
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * kept["up"][:codes.size])])
        return mix((sums[ends] - sums[begins]) * kept["down"][begins] + (ends - begins).astype(np.uint64))
