"""Vectorised work on the words of many texts at once: finding them, hashing them and runs of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about most; an item is never split."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def joined(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, each followed by one space, as bytes; where each word starts and ends; the text it is of."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    ends_word = space.copy()
    ends_word[0] = False
    ends_word[1:] &= ~space[:-1]
    keep = ~space | ends_word
    after = np.nonzero(ends_word[keep])[0]
    starts = np.concatenate([[0], after[:-1] + 1]) if len(after) else after
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(text_ends - 1, np.nonzero(ends_word)[0], side="left")
    flat = np.where(space, U(0x20).astype(np.uint8), raw)[keep]
    if lower:
        flat = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat).astype(np.uint8)
    return flat, starts, after, of


def _rol(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rol(acc + lane * _P2, 31) * _P1


def xxh64(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each of the byte ranges."""
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    at8 = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(flat) + 1,), (1,))
    at4 = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), (len(flat) + 1,), (1,))
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    cuts = np.nonzero(np.diff(lengths[order]))[0] + 1
    raw = flat.tobytes() if len(flat) else b""
    for group in np.split(order, cuts) if len(order) else []:
        n = int(lengths[group[0]])
        if len(group) < 4 or n > 4096:
            out[group] = [xxhash.xxh64_intdigest(raw[starts[g] : ends[g]], seed) for g in group]
            continue
        p, k = starts[group], 0
        if n >= 32:
            v = [np.full(len(p), x % (1 << 64), np.uint64) for x in (seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1))]
            while n - k >= 32:
                v = [_round(v[i], at8[p + k + 8 * i]) for i in range(4)]
                k += 32
            h = _rol(v[0], 1) + _rol(v[1], 7) + _rol(v[2], 12) + _rol(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros_like(x), x)) * _P1 + _P4
        else:
            h = np.full(len(p), seed + int(_P5), np.uint64)
        h = h + U(n)
        while n - k >= 8:
            h = _rol(h ^ _round(np.zeros_like(h), at8[p + k]), 27) * _P1 + _P4
            k += 8
        if n - k >= 4:
            h = _rol(h ^ (at4[p + k].astype(np.uint64) * _P1), 23) * _P2 + _P3
            k += 4
        while k < n:
            h = _rol(h ^ (flat[p + k].astype(np.uint64) * _P5), 11) * _P1
            k += 1
        h = (h ^ (h >> U(33))) * _P2
        h = (h ^ (h >> U(29))) * _P3
        out[group] = h ^ (h >> U(32))
    return out
