"""Alignment of two strings: edit counts, OSA distance, and weighted multi-character alignment.

Each function serves Arrow batches of pairs that Spark has partitioned; identical pairs are settled
by Spark before they get here.
"""

from __future__ import annotations

import numpy as np

TRANSPOSE, INSERT, DELETE, UNMAPPED = 0.80, 1.0, 1.0, 1.20


def edit_counts(a, b) -> tuple[int, int, int, int]:
    """(substitutions, deletions, insertions, hits); on ties a match or substitution is preferred
    to a deletion and a deletion to an insertion.

    The table is kept as two bits a cell in whole numbers, one for each item of ``b``: whether a cell costs what the one
    on its diagonal costs, and whether it costs more than the one above."""
    at: dict = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    up, down, table = full, 0, []
    for x in b:
        same = at.get(x, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right, left = down | (full ^ ((diagonal | up) & full)), up & diagonal
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down = left | (full ^ ((diagonal | right) & full)), right & diagonal
        table.append((diagonal, up))
    s = d = h = 0
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            h, i, j = h + 1, i - 1, j - 1
            continue
        diagonal, up = table[j - 1]
        if not diagonal >> (i - 1) & 1:
            s, i, j = s + 1, i - 1, j - 1
        elif up >> (i - 1) & 1:
            d, i = d + 1, i - 1
        else:
            j -= 1
    d += i
    return s, d, len(b) - s - h, h


def edit_distance(a, b) -> int:
    """Levenshtein distance of two sequences without their common ends, a bit for each item of the
    shorter one in whole numbers, so that a row of the table costs a few operations."""
    if len(a) > len(b):
        a, b = b, a
    start, m, n = 0, len(a), len(b)
    while start < m and a[start] == b[start]:
        start += 1
    while m > start and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[start:m], b[start:n]
    if not len(a):
        return len(b)
    at: dict = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << k)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, cost = full, 0, len(a)
    for x in b:
        same = at.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (full ^ ((diagonal | up) & full)), up & diagonal
        cost += bool(right & top) - bool(left & top)
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down = left | (full ^ ((diagonal | right) & full)), right & diagonal
    return cost


def _codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Items of all sequences, one after another, as whole numbers, and where each begins; the last number is the end."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), at


def _char_codes(first: list[str], second: list[str]) -> tuple:
    """``_codes`` of both sides with the characters numbered from 0, and the number of a space."""
    (x, x_at), (y, y_at) = _codes(first), _codes(second)
    seen = np.zeros(max(32, int(x.max(initial=0)), int(y.max(initial=0))) + 1, bool)
    seen[x] = seen[y] = seen[32] = True
    number = np.cumsum(seen) - 1
    return number[x], x_at, number[y], y_at, int(number[32])


def _word_codes(first: list[list[str]], second: list[list[str]]) -> tuple:
    known: dict[str, int] = {}
    out = []
    for side in (first, second):
        at = np.zeros(len(side) + 1, np.int64)
        np.cumsum([len(t) for t in side], out=at[1:])
        out += [np.fromiter((known.setdefault(w, len(known)) for t in side for w in t), np.int64, at[-1]), at]
    return *out, None


def _places(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``sizes``: the run of each item, and ``starts`` of its run plus its place there."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    before = np.cumsum(sizes) - sizes
    return run, np.arange(len(run)) - before[run] + starts[run]


#: Items of a slice of pairs, so that its tables stay small, and of a pair that is measured alone.
SLICE, ALONE = 1 << 16, 1 << 15


def edit_distances(a: list, b: list) -> np.ndarray:
    """``edit_distance`` of many pairs at a time, of texts or of lists of words.

    Common ends go first. Differing places of a pair of one length, and the sum over words of texts of as many words, are upper bounds:
    they settle a pair if one side has as many items that the other lacks. What is left is filled by bits, a column of all pairs of
    about one size at a time."""
    out, sizes = np.zeros(len(a), np.int64), np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    for k in np.flatnonzero(sizes > ALONE):
        out[k] = edit_distance(a[k], b[k])
    rest = np.flatnonzero(sizes <= ALONE)
    slices = np.split(rest, np.flatnonzero(np.diff(np.cumsum(sizes[rest]) // SLICE)) + 1)
    for part in slices:
        if len(part):
            x, y = [a[k] for k in part], [b[k] for k in part]
            u, u_at, v, v_at, cut = _char_codes(x, y) if isinstance(x[0], str) else _word_codes(x, y)
            out[part] = _distances(u, u_at[:-1], np.diff(u_at), v, v_at[:-1], np.diff(v_at), cut)
    return out


def _unmatched(run: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray, pairs: int) -> np.ndarray:
    """For each pair the items that one side has and the other lacks, copies counted, of the side with more of them."""
    wide = int(max(x.max(initial=0), y.max(initial=0))) + 1
    a, b = run * wide + x, other * wide + y
    if pairs * wide <= 4 * (len(a) + len(b)) + SLICE:
        net, of = np.bincount(a, minlength=pairs * wide) - np.bincount(b, minlength=pairs * wide), np.repeat(np.arange(pairs), wide)
    else:
        items, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        net, of = np.bincount(at[: len(a)], minlength=len(items)) - np.bincount(at[len(a) :], minlength=len(items)), items // wide
    return np.maximum(*(np.bincount(of, np.maximum(side, 0), pairs) for side in (net, -net))).astype(np.int64)


def _distances(x: np.ndarray, x0: np.ndarray, n: np.ndarray, y: np.ndarray, y0: np.ndarray, m: np.ndarray, cut: int | None) -> np.ndarray:
    p, least = len(n), np.minimum(n, m)

    def common(from_x: np.ndarray, from_y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many items are equal from a place on, by differing ones."""
        run, k = _places(np.zeros(p, np.int64), most)
        differ = np.flatnonzero(x[from_x[run] + step * k] != y[from_y[run] + step * k])
        found = most.copy()
        np.minimum.at(found, run[differ], k[differ])
        return found

    start = common(x0, y0, least, 1)
    end = common(x0 + n - 1, y0 + m - 1, least - start, -1)
    x0, y0, n, m = x0 + start, y0 + start, n - start - end, m - start - end
    out = np.maximum(n, m)
    open_ = (n > 0) & (m > 0)
    same = np.flatnonzero(open_ & (n == m))
    if len(same):
        run, i = _places(x0[same], n[same])
        j = _places(y0[same], n[same])[1]
        d = x[i] != y[j]
        run, i, j = run[d], i[d], j[d]
        out[same] = np.bincount(run, minlength=len(same))
        open_[same[_unmatched(run, x[i], run, y[j], len(same)) == out[same]]] = False
    if cut is not None:
        _by_words(x, x0, n, y, y0, m, cut, out, open_)
    left = np.flatnonzero(open_)
    if len(left):
        swap = n[left] > m[left]
        short0, short_n = np.where(swap, y0[left] + len(x), x0[left]), np.minimum(n, m)[left]
        long0, long_n = np.where(swap, x0[left], y0[left] + len(x)), np.maximum(n, m)[left]
        both, blocks = np.concatenate([x, y]), (short_n + 63) // 64
        for size in np.unique(blocks):
            k = np.flatnonzero(blocks == size)
            if len(k) < 8 * size:  # too few to be worth a column of arrays
                out[left[k]] = [edit_distance(both[s : s + c].tolist(), both[t : t + e].tolist()) for s, c, t, e in zip(short0[k], short_n[k], long0[k], long_n[k], strict=True)]
            else:
                k = k[np.argsort(-long_n[k], kind="stable")]
                out[left[k]] = _by_bits(both, short0[k], short_n[k], long0[k], long_n[k], int(size))
    return out


def _by_words(x, x0, n, y, y0, m, cut: int, out: np.ndarray, open_: np.ndarray) -> None:
    """Settles pairs of as many words on both sides whose words' distances add up to their items without a match."""
    left = np.flatnonzero(open_)
    (run, i), (other, j) = _places(x0[left], n[left]), _places(y0[left], m[left])
    ends, other_ends = np.flatnonzero(x[i] == cut), np.flatnonzero(y[j] == cut)
    words = np.bincount(run[ends], minlength=len(left))
    even = (words == np.bincount(other[other_ends], minlength=len(left))) & (words > 0)
    if not even.any():
        return
    pieces, of = [], None
    for side, at, first, size, stops in ((run, i, x0, n, ends), (other, j, y0, m, other_ends)):
        stops = stops[even[side[stops]]]
        k = np.flatnonzero(even)
        of = np.concatenate([side[stops], k])
        stop = np.concatenate([at[stops], (first + size)[left[k]]])
        order = np.lexsort((stop, of))
        of, stop = of[order], stop[order]
        begin = np.where(np.concatenate([[True], of[1:] != of[:-1]]), first[left[of]], np.concatenate([[0], stop[:-1] + 1]))
        pieces += [begin, stop - begin]
    total = np.bincount(of, _distances(x, pieces[0], pieces[1], y, pieces[2], pieces[3], None), len(left)).astype(np.int64)
    lower = _unmatched(run, x[i], other, y[j], len(left))
    done = even & (total == lower)
    out[left[done]] = total[done]
    open_[left[done]] = False


def _by_bits(items: np.ndarray, short0: np.ndarray, short_n: np.ndarray, long0: np.ndarray, long_n: np.ndarray, blocks: int) -> np.ndarray:
    """Distances of pairs in falling order of the longer side, whose shorter sides fill ``blocks`` words of 64 bits: a step takes
    the next item of all longer sides that have one."""
    one, top = np.uint64(1), np.uint64(63)
    wide, (run, at) = int(items.max()) + 1, _places(short0, short_n)
    place = at - short0[run]
    keys, of = np.unique(run * wide + items[at], return_inverse=True)
    masks = np.zeros((blocks, len(keys) + 1), np.uint64)  # the last one is that of items that the shorter side lacks
    np.bitwise_or.at(masks, (place >> 6, of), one << (place & 63).astype(np.uint64))
    long_run, long_at = _places(long0, long_n)
    asked = long_run * wide + items[long_at]
    found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    found = np.where(keys[found] == asked, found, len(keys))
    first = np.cumsum(long_n) - long_n
    p = len(short_n)
    up, down, cost = np.full((blocks, p), ~np.uint64(0)), np.zeros((blocks, p), np.uint64), short_n.copy()
    last = ((short_n - 1) & 63).astype(np.uint64)
    active = p
    for step in range(int(long_n[0])):
        while long_n[active - 1] <= step:
            active -= 1
        at_ = found[first[:active] + step]
        more, less = np.ones(active, np.uint64), np.zeros(active, np.uint64)
        for w in range(blocks):
            same, u, d = masks[w][at_], up[w, :active], down[w, :active]
            across = same | d
            same = same | less
            diagonal = (((same & u) + u) ^ u) | same
            plus, minus = d | ~(diagonal | u), u & diagonal
            if w == blocks - 1:
                cost[:active] += ((plus >> last[:active]) & one).astype(np.int64) - ((minus >> last[:active]) & one).astype(np.int64)
            plus_out, minus_out = plus >> top, minus >> top
            plus, minus = (plus << one) | more, (minus << one) | less
            up[w, :active], down[w, :active] = minus | ~(across | plus), plus & across
            more, less = plus_out, minus_out
    return cost


def osa_within(a: list[str], b: list[str], most: int) -> np.ndarray:
    """``osa_distance`` of many pairs at a time; ``most + 1`` for all that are further apart. Only cells at most ``most`` beside
    the diagonal are filled, a row of all pairs at a time."""
    p, wide = len(a), 2 * most + 1
    n, m = (np.array([len(t) for t in side], np.int64) for side in (a, b))
    rows = int(n.max(initial=0))

    def table(texts: list[str], sizes: np.ndarray, before: int, width: int, fill: int) -> np.ndarray:
        out = np.full((before + width, p), fill, np.int64)
        run, k = _places(np.zeros(p, np.int64), sizes)
        fits = k < width
        out[before + k[fits], run[fits]] = _codes(texts)[0][fits]
        return out

    # row i of x is character i, row most + j of y is character j, counted from 1; fillings match nothing
    x, y = table(a, n, 1, rows, -1), table(b, m, most + 1, rows + most, -2)
    far = np.int8(most + 1)
    older = last = None
    row = np.stack([np.full(p, min(j, most + 1) if j >= 0 else most + 1, np.int8) for j in range(-most, most + 1)])
    out = np.where(n == 0, np.minimum(m, most + 1), most + 1).astype(np.int64)
    for i in range(1, rows + 1):
        older, last, row = last, row, np.full((wide, p), far, np.int8)
        for k in range(wide):
            j = i + k - most
            if j < 0:
                continue
            if not j:
                row[k] = min(i, most + 1)
                continue
            best = last[k] + (x[i] != y[most + j])
            if k + 1 < wide:
                best = np.minimum(best, last[k + 1] + np.int8(1))
            if k:
                best = np.minimum(best, row[k - 1] + np.int8(1))
            if i > 1 and j > 1:
                turned = (x[i] == y[most + j - 1]) & (x[i - 1] == y[most + j])
                best = np.where(turned, np.minimum(best, older[k] + np.int8(1)), best)
            row[k] = np.minimum(best, far)
        ends = np.flatnonzero((n == i) & (np.abs(m - i) <= most))
        out[ends] = row[(m[ends] - i + most), ends]
    return out


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: Levenshtein with transposition of neighbours, each piece edited once."""
    older, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        older, last = last, row
    return last[-1]


def align(a: str, b: str, costs: dict[tuple[str, str], float], longest: int = 3) -> tuple[float, list[tuple[str, str, str, float]]]:
    """(cost, steps) of the cheapest alignment; steps are (op, source, target, cost) in order.

    Steps may take up to ``longest`` characters on either side. Pairs in ``costs`` cost what it says;
    other single characters cost ``UNMAPPED``; other multi-character pairs are not possible. Ties go to the
    first of: match or substitution, 2:1, 1:2, 2:2, 3:1, 1:3, 3:2, 2:3, 3:3, transposition, deletion, insertion.
    This is the form for a single pair; ``multigram`` has that for many.
    """
    rows, columns = len(a) + 1, len(b) + 1
    best = np.full((rows, columns), np.inf)
    move = np.zeros((rows, columns, 2), np.int8)
    best[0, 0] = 0
    shapes = [s for s in ((1, 1), (2, 1), (1, 2), (2, 2), (3, 1), (1, 3), (3, 2), (2, 3), (3, 3)) if max(s) <= longest]
    for i in range(rows):
        for j in range(columns):
            if not i and not j:
                continue
            options = []
            for di, dj in shapes:
                if i >= di and j >= dj:
                    source, target = a[i - di : i], b[j - dj : j]
                    price = 0.0 if (di, dj) == (1, 1) and source == target else costs.get((source, target))
                    if price is None and (di, dj) == (1, 1):
                        price = UNMAPPED
                    if price is not None and (source != target or di == dj == 1):
                        options.append((best[i - di, j - dj] + price, di, dj))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] != a[i - 2] == b[j - 1] and (a[i - 2 : i], b[j - 2 : j]) not in costs:
                options.append((best[i - 2, j - 2] + TRANSPOSE, 2, 2))
            if i:
                options.append((best[i - 1, j] + DELETE, 1, 0))
            if j:
                options.append((best[i, j - 1] + INSERT, 0, 1))
            least = min(options, key=lambda o: o[0])
            best[i, j], move[i, j] = least[0], least[1:]
    steps, i, j = [], rows - 1, columns - 1
    while i or j:
        di, dj = (int(v) for v in move[i, j])
        source, target = a[i - di : i], b[j - dj : j]
        op = "match" if source == target else "delete" if not dj else "insert" if not di else "substitute"
        steps.append((op, source, target, float(best[i, j] - best[i - di, j - dj])))
        i, j = i - di, j - dj
    return float(best[-1, -1]), steps[::-1]
