"""A word-level FM-index for one shard: suffix order, wavelet matrix, and matching statistics."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: Rows of a block of the owners' range minima.
SAMPLE = 16
_STEPS = np.arange(SAMPLE)
_NONE = np.int32(np.iinfo(np.int32).max)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` sorted by their first ``depth`` symbols, by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, span = rank.astype(np.int64) + 1, 1
    while span < depth:
        follow = np.zeros(n, np.int64)
        follow[: n - span] = rank[span:]
        keys, new = np.unique(rank * (n + 2) + follow, return_inverse=True)
        rank, span = new.astype(np.int64) + 1, span * 2
        if len(keys) == n:
            break
    return np.argsort(rank, kind="stable")


class Bits:
    """A packed bit vector with a rank directory."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int64)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        low = self.words[w] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE)
        return self.before[w] + np.bitwise_count(low)


class FmIndex:
    """Backward search over segments joined by separators (symbol 0).

    ``owners`` gives each position of ``text`` its document's rank; searches keep only matches that
    some document of a lower rank holds as well.
    """

    def __init__(self, text: np.ndarray, owners: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        bwt = text[order - 1]
        symbols = int(text.max()) + 1
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((row >> level) & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]]).astype(np.int64)
        every = np.arange(symbols, dtype=np.int64)
        self.base = np.zeros(symbols, np.int64)
        self.base = starts - self.step(every, np.zeros(symbols, np.int64))
        # range minima of the owners in suffix order, sampled: a table over blocks, and the owners themselves
        blocks = -(-len(text) // SAMPLE)
        self.owners = np.full((blocks + 1) * SAMPLE, np.iinfo(np.int32).max, np.int32)
        self.owners[: len(text)] = owners[order]
        self.minima = [self.owners.reshape(-1, SAMPLE).min(axis=1)]
        span = 1
        while 2 * span <= blocks:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-span], last[span:]))
            span *= 2
        self.size = len(text)

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Row of the suffixes that start with ``symbol`` and go on below row i."""
        for bits, zeros, level in zip(self.bits, self.zeros, range(self.levels - 1, -1, -1), strict=True):
            ones = bits.ones(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return self.base[symbol] + i

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner of the rows from lo to below hi, of which there is one at least."""
        head = lo[:, None] + _STEPS
        out = np.where(head < hi[:, None], self.owners[np.minimum(head, self.size)], _NONE).min(axis=1)
        more = np.flatnonzero(hi - lo > SAMPLE)
        if len(more):
            end = hi[more]
            out[more] = np.minimum(out[more], self.owners[end[:, None] - 1 - _STEPS].min(axis=1))
            first, last = lo[more] // SAMPLE + 1, end // SAMPLE
            whole = last > first
            more, first, last = more[whole], first[whole], last[whole]
            level = np.frexp((last - first).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                at = level == k
                table = self.minima[k]
                out[more[at]] = np.minimum(out[more[at]], np.minimum(table[first[at]], table[last[at] - (1 << k)]))
        return out


def matched_windows(index: FmIndex, text: np.ndarray, starts: np.ndarray, counts: np.ndarray, ranks: np.ndarray, window: int) -> list[np.ndarray]:
    """For each streamed segment the windows, as booleans, that a document of a rank below ``ranks[k]`` holds.

    Segment k has windows at starts[k] ... starts[k] + counts[k] - 1 of ``text``; two may be one place of it. Matches are grown
    backwards, all segments at once. A match over several windows settles all of them; one that
    fails at word s settles the windows it held whole; and a single window that fails at s settles
    every window from it to s, for they all hold the failed piece.
    """
    state = [np.full(c, -1, np.int8) for c in counts.tolist()]
    first = np.zeros(len(starts), np.int64)
    last = counts - 1
    lane = np.arange(len(starts))
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), index.size, np.int64)
    at = last + window - 1
    while len(lane):
        symbol = text[starts[lane] + at]
        a, b = np.split(index.step(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])), 2)
        grows = b > a
        if grows.any():
            grows[grows] = index.least_owner(a[grows], b[grows]) < ranks[lane[grows]]
        over = ~grows | (at == first[lane])
        for k in np.flatnonzero(over).tolist():
            s, ok, i, j = int(lane[k]), bool(grows[k]), int(first[lane[k]]), int(last[lane[k]])
            known = state[s]
            if ok:
                known[i : j + 1] = 1
            elif at[k] < j:
                known[at[k] + 1 : j + 1] = 1
            elif i == j:
                known[i : at[k] + 1] = np.where(known[i : at[k] + 1] < 0, 0, known[i : at[k] + 1])
            open_at = np.flatnonzero(known < 0)
            if not len(open_at):
                first[s] = -1
                continue
            i2 = int(open_at[0])
            gap = np.flatnonzero(known[i2:] >= 0)
            j2 = i2 + int(gap[0]) - 1 if len(gap) else len(known) - 1
            if not ok and at[k] >= j and i != j:
                j2 = min(j2, (i + j) // 2)
            first[s], last[s] = i2, j2
        lo, hi, at = np.where(over, 0, a), np.where(over, index.size, b), np.where(over, last[lane] + window - 1, at - 1)
        live = first[lane] >= 0
        if not live.all():
            lane, lo, hi, at = lane[live], lo[live], hi[live], at[live]
    return [s == 1 for s in state]
