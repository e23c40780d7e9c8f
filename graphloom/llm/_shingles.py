"""Distinct word shingles of whole texts as 64-bit numbers, and their minwise values."""

from __future__ import annotations

import numpy as np

SIZE = 5


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE, _STEP = _constants(256, 1), _constants(SIZE, 2)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    """The first n powers of an odd number."""
    global _powers
    if len(_powers) < n:
        _powers = np.r_[np.uint64(1), np.cumprod(np.full(max(n, 64) * 2, _P, np.uint64))]
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    ink = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.r_[False, ink].astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    at = np.flatnonzero(ink)
    sizes = stops - starts
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(begin, sizes)
    h = mixed(np.add.reduceat(_BYTE[_LOWER[b[at]]] * _power(int(sizes.max()))[place], begin))
    return h, np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(raw))


def _parts(text: str, chars: int) -> list[str]:
    """The text, cut at blanks into parts of about ``chars`` characters (a single longer word stays whole)."""
    out, at = [], 0
    while len(text) - at > chars:
        cut = min((i for i in (text.find(b, at + chars) for b in " \n\t\r\x0b\x0c") if i >= 0), default=len(text))
        out.append(text[at:cut])
        at = cut
    return out + [text[at:]]


def shingle_sets(texts: list[str | None], size: int = SIZE, chars: int = 1_000_000) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of ``size`` words; with fewer words, the whole
    sequence as one; without words none. Words are hashed about ``chars`` characters at a time (each takes some 40 bytes)."""
    whole, out, held, n = [t or "" for t in texts], [], [], 0
    for t in whole:
        if held and n + len(t) > chars:
            out += _sets(*word_hashes(held), size)
            held, n = [], 0
        if len(t) > chars:
            h, _ = zip(*(word_hashes([p]) for p in _parts(t, chars)))
            out += _sets(np.concatenate(h), np.array([sum(map(len, h))]), size)
        else:
            held.append(t)
            n += len(t)
    return out + _sets(*word_hashes(held), size) if held else out


def _sets(h: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """Shingles of texts whose word hashes follow each other."""
    step = _STEP if size == SIZE else _constants(size, 2)
    n = len(h) - size + 1
    every = np.zeros(max(0, n), np.uint64)
    for j in range(size):
        every += h[j : j + n] * step[j] if n > 0 else every
    every = mixed(every)
    out, at = [], 0
    for k in counts.tolist():
        if k >= size:
            out.append(np.unique(every[at : at + k - size + 1]))
        elif k:
            out.append(mixed((h[at : at + k] * step[:k]).sum(keepdims=True, dtype=np.uint64) + np.uint64(k * int(_P) & 0xFFFFFFFFFFFFFFFF)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def minwise(sets: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """Minwise value of each non-empty set for each seed: (sets, seeds)."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat((flat ^ s) * (s | np.uint64(1)), begin) for s in seeds], axis=1)
