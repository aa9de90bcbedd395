"""Suffix arrays by induced sorting, and permuted common prefixes.

A suffix is S-type if it is smaller than the one after it, else L-type; an S-type one behind an
L-type one is leftmost-smaller. Their substrings are sorted by one round of induction, named, and,
where names repeat, sorted by the same method on the string of names; a second round induces all
suffixes from them. Small alphabets are induced a bucket at a time in numpy: what a bucket holds
when its turn comes is final but for suffixes that it induces into itself, which follow in waves.
Large alphabets, as the names have, are induced a run of
places at a time, each run up to the first place that it fills itself.
"""

from __future__ import annotations

import numpy as np

_BY_BUCKET = 1024


def s_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last symbol is the only least one."""
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]  # equal neighbours have the type of the next step
    return np.append(step[following] > 0, True)


def _spread(out: np.ndarray, where: np.ndarray, found: np.ndarray, symbols: np.ndarray, way: int) -> None:
    """Puts found, in order, at the open ends of their symbols' buckets and moves the ends."""
    order = np.argsort(symbols, kind="stable")
    c = symbols[order]
    count = np.bincount(c, minlength=len(where))
    rank = np.arange(len(c)) - (np.cumsum(count) - count)[c]
    out[where[c] + way * rank] = found[order]
    where += way * count


def _induced_by_bucket(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = len(s)
    end = np.cumsum(size)
    start = end - size
    out = np.zeros(n, dtype=np.int64)
    c = s[seeds]
    ordered = seeds[np.argsort(c, kind="stable")]
    first = np.searchsorted(s[ordered], np.arange(len(size) + 1))
    large = ~small
    head = start.copy()
    for b in range(len(size)):
        done = start[b]
        while done < head[b]:  # the L-type part, wave by wave
            found = out[done : head[b]] - 1
            done = head[b]
            found = found[large[found]]
            if len(found):
                _spread(out, head, found, s[found], 1)
        found = ordered[first[b] : first[b + 1]] - 1
        if len(found):
            _spread(out, head, found, s[found], 1)  # before a leftmost-smaller suffix stands an L-type one
    small = small.copy()
    small[-1] = False  # nothing stands before the first suffix; the last one is in its place
    tail = end - 1
    out[0] = n - 1
    tail[0] -= 1
    for b in range(len(size) - 1, -1, -1):
        done = end[b] - 1
        while done > tail[b]:
            found = out[done : tail[b] : -1] - 1 if tail[b] >= 0 else out[done::-1] - 1
            done = tail[b]
            found = found[small[found]]
            if len(found):
                _spread(out, tail, found, s[found], -1)
        found = out[start[b] : head[b]][::-1] - 1
        found = found[small[found]]
        if len(found):
            _spread(out, tail, found, s[found], -1)
    return out


def _scan(out: np.ndarray, wanted: np.ndarray, s: np.ndarray, head: np.ndarray) -> None:
    """One scan over out from its start: puts the suffix before each one, if wanted, at the head of its bucket.

    A run of places is taken at once, up to the first place that a suffix of the run is put in.
    """
    n, p, m = len(out), 0, 64
    while p < n:
        q = min(p + m, n)
        at = np.flatnonzero(out[p:q] > 0)
        found = out[p:q][at] - 1
        some = wanted[found]
        at, found = at[some], found[some]
        m = min(2 * m, 1 << 14)
        if len(found):
            c = s[found]
            order = np.argsort(c, kind="stable")
            k = np.arange(len(c))
            new = np.ones(len(c), dtype=bool)
            new[1:] = c[order[1:]] != c[order[:-1]]
            place = np.empty(len(c), dtype=np.int64)
            place[order] = head[c[order]] + k - np.maximum.accumulate(np.where(new, k, 0))
            low = int(place.min())
            if low < q:
                safe = np.searchsorted(at, low - p)
                found, place, c = found[:safe], place[:safe], c[:safe]
                q, m = low, max(m // 4, 16)
            out[place] = found
            head[c] = place + 1  # the last one of a symbol stands
        p = q


def _induced_by_run(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = len(s)
    end = np.cumsum(size)
    out = np.full(n, -1, dtype=np.int64)
    c = s[seeds]
    order = np.argsort(c, kind="stable")
    count = np.bincount(c, minlength=len(size))
    out[end[c[order]] - np.repeat(count, count) + np.arange(len(seeds)) - np.repeat(np.cumsum(count) - count, count)] = seeds[order]
    _scan(out, ~small, s, end - size)
    _scan(out[::-1], small, s, n - end)
    out[0] = n - 1
    return out


def _named(s: np.ndarray, marks: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each mark to the next, by mark; order: the marks, sorted by substring."""
    length = np.append(np.diff(marks), 0) + 1
    of = np.empty(len(s), dtype=np.int64)
    of[marks] = np.arange(len(marks))
    which = of[order]
    a, b, most = order[:-1], order[1:], length[which]
    same = most[:-1] == most[1:]
    pair = np.flatnonzero(same)
    k = 0
    while len(pair):
        equal = s[a[pair] + k] == s[b[pair] + k]
        same[pair[~equal]] = False
        k += 1
        pair = pair[equal & (most[pair] > k)]
    names = np.empty(len(marks), dtype=np.int64)
    names[which] = np.concatenate([[0], np.cumsum(~same)])
    return names


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of s in order. s: whole numbers from 0 on, the last one 0 and the only 0."""
    if len(s) == 1:
        return np.zeros(1, dtype=np.int64)
    small = s_types(s)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = np.bincount(s)
    induced = _induced_by_bucket if len(size) <= _BY_BUCKET else _induced_by_run
    marked = np.zeros(len(s), dtype=bool)
    marked[marks] = True
    order = induced(s, small, marks, size)
    order = order[marked[order]]
    names = _named(s, marks, order)
    if names.max() + 1 < len(marks):
        order = marks[suffix_array(names)]
    return induced(s, small, order, size)


def common_prefixes(s: np.ndarray, order: np.ndarray, stop: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """By suffix, the length of its common prefix with the suffix before it in order, up to its stop (symbols that count from there on).

    Permuted common prefixes: where the symbols before a suffix and before its predecessor agree,
    the length is one less than that of the suffix before it in the text, so only the others are
    compared. fresh: suffixes to be compared in any case, as stops are counted anew there.
    """
    n = len(s)
    before = np.empty(n, dtype=np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n - 1
    compared = fresh.copy()
    compared[0] = True
    inner = np.arange(1, n)
    compared[1:] |= (before[inner] == 0) | (s[inner - 1] != s[before[inner] - 1])
    at = np.flatnonzero(compared)
    length = np.zeros(len(at), dtype=np.int64)
    padded = np.concatenate([s.astype(np.uint16), np.zeros(4, np.uint16)])
    four = np.ndarray((n + 1,), dtype="<u8", buffer=padded.data, strides=(2,))
    left = np.arange(len(at))
    while len(left):
        a, b = at[left] + length[left], before[at[left]] + length[left]
        differ = four[np.minimum(a, n)] ^ four[np.minimum(b, n)]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        more = np.where(differ == 0, 4, (low > 0xFFFF).astype(np.int64) + (low > 0xFFFFFFFF) + (low > 0xFFFFFFFFFFFF))
        length[left] += more
        left = left[(more == 4) & (length[left] < stop[at[left]])]
    last = np.cumsum(compared) - 1
    return np.minimum(length[last] - (np.arange(n) - at[last]), stop)
