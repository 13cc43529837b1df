"""Vectorised word and shingle hashes of whole texts, for use inside Arrow tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
#: Texts are hashed in pieces of about this many bytes, so that temporary arrays stay small.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=np.int8)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 1
_COEFFICIENT = mix(np.arange(1000, 1064, dtype=np.uint64)) | _U(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(n + PIECE, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1]


def _words_of(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a piece of bytes; A-Z count as a-z."""
    edge = np.diff(np.concatenate(([1], _SPACE[piece], [1])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(piece))
    total = np.zeros(len(piece) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[piece] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start] if len(start) else np.zeros(0, np.uint64)), start


def _pieces(data: bytes) -> Iterator[bytes]:
    """Cuts of a long text that fall on white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text, the 64-bit hashes of its words in order; a null text has none. Short texts are hashed together."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if not held:
            return
        h, start = _words_of(np.frombuffer(b"\n".join(held), dtype=np.uint8))
        bounds = np.cumsum([0] + [len(x) + 1 for x in held])
        cut = np.searchsorted(start, bounds)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield h[a:b]

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > PIECE:
            yield from flush()
            held, size = [], 0
            yield np.concatenate([_words_of(np.frombuffer(p, dtype=np.uint8))[0] for p in _pieces(data)])
            continue
        if size + len(data) > PIECE:
            yield from flush()
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    yield from flush()


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter, non-empty text is one shingle."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    width = min(n, k)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * _COEFFICIENT[j]
    return np.unique(mix(total + _U(width)))


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a sorted set."""
    d = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
