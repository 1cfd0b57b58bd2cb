"""Word spans and hashes of UTF-8 texts, one numpy pass for many texts.

Texts are handled as bytes. Every word class used here treats the bytes of
non-ASCII characters alike, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that one numpy pass takes; temporaries are about 40 times this.
CHUNK_BYTES = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_WORD_POWERS = powers(_BASE, 256)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: Sequence[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text stands alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


@dataclass
class Words:
    """Words of several texts, in order. ``first[i]:first[i + 1]`` are text i's."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray

    def text(self, begin: int, end: int) -> bytes:
        """Words begin .. end - 1 joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[begin:end].tolist(), self.ends[begin:end].tolist()))


def words_of(texts: Sequence[bytes], word_bytes: np.ndarray, lower: bool) -> Words:
    """Find and hash the words of all ``texts``."""
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", dtype=np.uint8)
    if lower:
        data = LOWER[data]
    inside = word_bytes[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    text_ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    first = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, starts, ends, first, doc, _hashes(data[inside], ends - starts))


def _hashes(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(lengths):
        return np.zeros(0, dtype=U64)
    begins = np.cumsum(lengths) - lengths
    offsets = np.arange(len(letters)) - np.repeat(begins, lengths)
    longest = int(lengths.max())
    table = _WORD_POWERS if longest <= len(_WORD_POWERS) else powers(_BASE, longest)
    values = table[offsets]
    values *= letters.astype(U64) + U64(1)
    return mix64(np.add.reduceat(values, begins) + lengths.astype(U64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words, across text bounds too; see ``gram_inside``."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(count, dtype=U64)
    for k, p in enumerate(powers(0xD6E8FEB86659FD93, n)):
        out += hashes[k : k + count] * p
    return mix64(out)


def gram_inside(doc: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each position on belong to one text."""
    count = len(doc) - n + 1
    return doc[:count] == doc[n - 1 :] if count > 0 else np.zeros(0, dtype=bool)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
