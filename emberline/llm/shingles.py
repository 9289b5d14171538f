"""Word-shingle hashes of whole texts, computed over a few megabytes of texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
_SPACES = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
CHUNK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, _P_INVERSE)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers


def chunks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Folded texts (A-Z lower-cased, white space as blanks) in lists of about CHUNK bytes; a longer text comes alone."""
    part, size = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass").translate(_SPACES)
        if part and size + len(b) > CHUNK:
            yield part
            part, size = [], 0
        part.append(b)
        size += len(b) + 1
    if part:
        yield part


def shingle_sets(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text in turn the sorted distinct hashes of its k-word shingles; with fewer words, of the whole."""
    for part in chunks(texts):
        a = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        power, inverse = _up_to(len(a) + 1)
        inside = np.concatenate([[False], a != 32])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[0::2], edge[1::2]
        if len(last) < len(first):
            last = np.append(last, len(a))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * power[: len(a)])])
        word = mix((total[last] - total[first]) * inverse[first])
        offsets = np.cumsum([0, *(len(b) + 1 for b in part)])
        at = np.searchsorted(first, offsets)  # words before each text
        many = len(word) - k + 1
        run = word[: max(many, 0)] * _BYTE[0]
        for i in range(1, k):
            run = run + word[i : i + max(many, 0)] * _BYTE[i]
        run = mix(run)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            n = e - s
            if n >= k:
                yield np.unique(run[s : e - k + 1])
            elif n:
                yield mix((word[s:e] * _BYTE[32 : 32 + n]).sum(dtype=np.uint64, keepdims=True) + _U(n))
            else:
                yield np.empty(0, np.uint64)
