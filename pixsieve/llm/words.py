"""Words of whole texts as 64-bit numbers, worked out for a slice of texts at once on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text handled at once, just below a power of two: tables of powers are kept in such sizes.
SLICE_BYTES = (2 << 20) - (64 << 10)
#: Word breaks: space and the control characters 9 to 13. Lower case of A to Z. ASCII punctuation.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def room(n: int) -> int:
    return 1 << max(16, int(n + 1).bit_length())


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about limit bytes together, one text at least."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + limit, "right")) - 1)
        yield at, to
        at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column without nulls, and where each text begins, with the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def word_hashes(texts: pa.Array, strip: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words, words per text, and each word's first byte and end in the slice.

    Words are runs without white space, A to Z lower-cased; strip leaves out ASCII punctuation (places then count the
    bytes that stay).
    """
    body, offsets = bytes_of(texts)
    body = LOWER[body]
    if strip:
        stays = ~PUNCTUATION[body]
        kept = np.concatenate([[0], np.cumsum(stays)])
        body, offsets = body[stays], kept[offsets]
    n = len(body)
    inside = ~SPACE[body]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= SPACE[body[:-1]] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= SPACE[body[1:]] | edge[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = room(n)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(BASE, size)[:n], out=running[1:])
    h = (running[last] - running[first]) * powers(INVERSE, size)[first]
    words = mixed(h + (last - first).astype(np.uint64))
    counts = np.diff(np.searchsorted(first, offsets))
    return words, counts, first, last


def shingles(words: np.ndarray, counts: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all runs of k words inside a text, and how many each text has.

    short: a text of fewer than k words, but one at least, has one shingle of them all.
    """
    n = len(words)
    starts = np.cumsum(counts) - counts
    per = np.maximum(counts - k + 1, 0)
    if short:
        per = np.where(counts > 0, np.maximum(per, 1), 0)
    out = np.zeros(n, np.uint64)
    with_rest = np.zeros(n + k, np.uint64)
    with_rest[:n] = words
    for j in range(k):
        out = out * np.uint64(BASE) + with_rest[j : j + n]
    if short:  # words beyond the text's end must not enter
        for t in np.flatnonzero((counts > 0) & (counts < k)):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in [*words[starts[t] : starts[t] + counts[t]], *[np.uint64(0)] * (k - int(counts[t]))]:
                    h = h * np.uint64(BASE) + w
            out[starts[t]] = h
    ends = np.cumsum(per)
    at = np.repeat(starts - (ends - per), per) + np.arange(ends[-1] if len(ends) else 0)
    return mixed(out[at]), per
