"""64-bit hashes of words and word n-grams, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_P = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes of text hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, CHUNK_BYTES + 4096)
            grow = lambda x: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)]))
            self.up, self.down = grow(_P), grow(_INVERSE)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and each text's number of words.

    Words are runs of bytes other than the six ASCII white spaces. A word's hash is a polynomial of
    its bytes, from differences of one running sum, then mixed.
    """
    joined = b"\n".join([b"", *texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, stop = turns[::2], turns[1::2]
    up, down = _powers.upto(len(raw))
    sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up)
    out = (sums[stop - 1] - sums[start - 1]) * down[start]
    out ^= out >> np.uint64(32)
    out *= _MIX[0]
    out ^= out >> np.uint64(29)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return out, np.diff(np.searchsorted(start, ends, side="right"), prepend=0)


def hashed_texts(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Word hashes of each text, hashed a chunk of texts at a time."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= CHUNK_BYTES:
            size += len(texts[end])
            end += 1
        hashes, counts = word_hashes(texts[at:end])
        yield from np.split(hashes, np.cumsum(counts)[:-1])
        at = end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words; of the whole sequence when there are fewer."""
    n = min(n, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ words[k : len(words) - n + 1 + k]) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[at], np.diff(np.append(at, len(values)))
