"""Word hashes and shingle sets of texts, computed with numpy over batches of whole texts.

Words are runs of characters other than ASCII white space, with A-Z lower-cased. A word's hash is a polynomial over random 64-bit
values of its bytes, so it does not depend on process, batch or position; a shingle's hash combines its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_LETTERS = _RANDOM.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_PLACES = _RANDOM.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text hashed at once; a longer text is hashed alone.
BATCH_BYTES = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << (n - 1).bit_length()
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def powers(n: int) -> np.ndarray:
    return _power(_BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _power(_INVERSE, n)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def words_with_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, stop) of each word, in bytes."""
    data = np.frombuffer(b" " + data + b" ", np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, stops = edges[::2], edges[1::2]
    sums = _LETTERS[data]
    sums *= _power(_BASE, len(data))
    np.add.accumulate(sums, out=sums)
    return mixed((sums[stops - 1] - sums[starts - 1]) * _power(_INVERSE, len(data))[starts]), starts - 1, stops - 1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    words, starts, _ = words_with_places(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, ends), prepend=0) if texts else np.zeros(0, np.int64)


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle that begins at each word."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        out += words[j : j + len(out)] * _PLACES[j]
    return mixed(out)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words has one, of all its words; none without words."""
    held, total = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if held and total + len(data) > BATCH_BYTES:
            yield from _sets(held, size)
            held, total = [], 0
        held.append(data)
        total += len(data)
    yield from _sets(held, size)


def _sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    if not texts:
        return
    words, counts = word_hashes(texts)
    every, at = rolled(words, size), 0
    for n in counts.tolist():
        if n >= size:
            yield np.unique(every[at : at + n - size + 1])
        elif n:
            yield mixed((words[at : at + n] * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n) * _PLACES[63])
        else:
            yield np.zeros(0, np.uint64)
        at += n
