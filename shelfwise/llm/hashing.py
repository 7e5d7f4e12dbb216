"""Vectorised word and shingle hashing for the tasks of the Python operators.

A batch of texts is laid out as one byte buffer; the hash of a word is a sum of
keyed bytes, each weighted by an unrelated number for its place in the word, so
the cost is a few numpy passes and no Python work per word. (A polynomial in
one base would collide for every base modulo 2**64, on Thue-Morse words.) Lines
are few and get a 128-bit BLAKE2b digest of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD_BYTES, _LINE_SPACE = _FOLD.tobytes(), b" \t\n\x0b\x0c\r"
#: Bytes of text that are hashed at once; a longer text is a buffer of its own.
BUFFER_BYTES = 1 << 21

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), so that close inputs get unrelated values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_KEY = mix(np.arange(1, 257, dtype=np.uint64))
#: Weights of the first bytes of a word; those of later bytes are made as needed.
_WEIGHTS = mix(np.arange(5001, 5001 + 4096, dtype=np.uint64)) | np.uint64(1)


def _weights(place: np.ndarray) -> np.ndarray:
    """The weight of each place within a word: unrelated odd numbers, not powers of one base."""
    if not len(place) or place.max() < len(_WEIGHTS):
        return _WEIGHTS[place]
    return mix(place.astype(np.uint64) + np.uint64(5001)) | np.uint64(1)


def buffers(texts: Iterable[str | None], limit: int = BUFFER_BYTES) -> Iterator[list[bytes]]:
    """The texts as UTF-8, in order, in lists of about ``limit`` bytes."""
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield held


def word_hashes(raws: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the offsets of each text's first word (one more than texts)."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    blank = _SPACE[data]
    if fold:
        data = _FOLD[data]
    before = np.empty_like(blank)
    before[0] = True
    before[1:] = blank[:-1]
    starts = np.flatnonzero(before & ~blank)
    ends = np.flatnonzero(blank & ~before)
    place = np.arange(len(data), dtype=np.int64)
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    place -= first
    place[blank] = 0
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_KEY[data] * _weights(place), out=sums[1:], dtype=np.uint64)
    h = mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))
    edges = np.concatenate(([0], np.cumsum(lengths)))
    return h, np.searchsorted(starts, edges)


def line_hashes(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the 128-bit hashes (rows of two numbers) and lengths in code points of its lines' keys, in order.

    A key is a line without white space at both ends and with A-Z folded; a text without line feeds is one line.
    """
    for raw in raws:
        keys = [line.strip(_LINE_SPACE) for line in raw.translate(_FOLD_BYTES).split(b"\n")]
        digests = b"".join([blake2b(key, digest_size=16).digest() for key in keys])
        lengths = [len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass")) for key in keys]
        yield np.frombuffer(digests, np.uint64).reshape(-1, 2), np.array(lengths, np.int64)


def shingle_sets(raws: list[bytes], width: int, fold: bool = True) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has its whole word sequence as its one shingle; a
    text without words has none.
    """
    h, offsets = word_hashes(raws, fold)
    keys = mix(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(h) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(width):
        mixed += h[j : j + n] * keys[j]
    mixed = mix(mixed)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= width:
            yield np.unique(mixed[a : b - width + 1])
        elif b > a:
            short = (h[a:b] * keys[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values that two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
