"""Vectorised words and shingles over batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += U(32)
#: Bytes that are hashed at once; of a longer text one piece after the other.
PIECE = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, PIECE + 4096) + 1
        _powers[:] = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def _word_sums(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial sum, length and start of each word of a buffer, A-Z lower-cased."""
    raw = np.frombuffer(buffer, np.uint8)
    word = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw] + U(1)) * up[: len(raw)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts], (ends - starts).astype(np.uint64), starts


def _finished(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(sums + lengths * U(0xD6E8FEB86659FD93))


def _hash_buffer(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a buffer, A-Z lower-cased."""
    sums, lengths, starts = _word_sums(buffer)
    return _finished(sums, lengths), starts


def _hash_long(data: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, PIECE bytes at a time; a word that a piece's end cuts is carried on."""
    out, carried, size = [], 0, 0
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        sums, lengths, starts = _word_sums(piece)
        if size:
            if len(starts) and starts[0] == 0:
                sums[0] = U((carried + int(sums[0]) * pow(_BASE, size, 1 << 64)) % (1 << 64))
                lengths[0] += U(size)
            else:
                out.append(_finished(np.array([carried], np.uint64), np.array([size], np.uint64)))
            carried = size = 0
        if len(starts) and not _SPACE[piece[-1]] and at + len(piece) < len(data):
            carried, size = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        out.append(_finished(sums, lengths))
    return np.concatenate(out)


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashes of the words in order) of every text, in order."""
    batch: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        if not batch:
            return
        joined = b"\n".join(x for _, x in batch)
        hashes, starts = _hash_buffer(joined)
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for _, x in batch]))
        begin = 0
        for (i, _), end in zip(batch, cuts, strict=True):
            yield i, hashes[begin:end]
            begin = end
        batch.clear()

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > PIECE:
            yield from flush()
            size = 0
            yield i, _hash_long(data)
            continue
        if size + len(data) > PIECE:
            yield from flush()
            size = 0
        batch.append((i, data))
        size += len(data) + 1
    yield from flush()


_STEPS = np.array([0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0x27D4EB2F165667C5], np.uint64)


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of fewer words, the whole sequence is one."""
    n = len(words)
    if not n:
        return words
    steps = _STEPS if width == 5 else mix(np.arange(1, width + 1, dtype=np.uint64) * _STEPS[0]) | U(1)
    if n < width:
        return mix((words * steps[:n]).sum(dtype=np.uint64, keepdims=True) + U(n))
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * steps[j]
    return np.unique(mix(total))


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    for i, words in word_hashes(texts):
        yield i, shingle_set(words, width)
