"""Suffix array of one shard of text by induced sorting, and its permuted common prefixes.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost-smaller
substrings are sorted by one induction, named, and the string of names is sorted by the same division;
a second induction then yields the whole array in linear work. On bytes, inductions go bucket by
bucket, a bucket's suffixes at once, so the work is done by array operations. A string of names has
too many letters for that: there, leftmost-smaller substrings are told apart by doubling ranks only as
far as they reach, the names are sorted recursively, and every other suffix is placed by the ranks of
its letters up to the next leftmost-smaller suffix and by that suffix's place.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the empty suffix after the end is least."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1])
    step[-1] = -1
    told = np.where(step != 0, np.arange(n), n - 1)
    first = np.minimum.accumulate(told[::-1])[::-1]  # next place at which neighbours differ
    return step[first] > 0


def _scatter(held: list[list[np.ndarray]], letters: np.ndarray, items: np.ndarray) -> None:
    """Appends items to the lists of their letters, in order."""
    if not len(items):
        return
    order = np.argsort(letters, kind="stable")
    letters, items = letters[order], items[order]
    cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    for c, part in zip(letters[np.concatenate(([0], cuts))].tolist(), np.split(items, cuts), strict=True):
        held[c].append(part)


def _sweep(seeds: list[np.ndarray], letter_before: np.ndarray, letters: range, last: np.ndarray | None) -> list[np.ndarray]:
    """One induction: for each letter, the suffixes put there, in the order of arrival.

    letter_before[j] is the letter of suffix j-1 if that suffix is to be induced, else -1. seeds[c] are
    the sorted suffixes of letter c that stand after the induced ones in reading order.
    """
    held: list[list[np.ndarray]] = [[] for _ in seeds]
    if last is not None:
        _scatter(held, letter_before[last], last - 1)
    done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(seeds)
    for c in letters:
        batch = np.concatenate(held[c]) if held[c] else np.zeros(0, np.int32)
        own = [batch]
        while len(batch):
            before = letter_before[batch]
            same, other = batch[before == c] - 1, (before >= 0) & (before != c)
            _scatter(held, before[other], batch[other] - 1)
            batch = same
            own.append(batch)
        done[c] = np.concatenate(own)
        if len(seeds[c]):
            before = letter_before[seeds[c]]
            known = before >= 0
            _scatter(held, before[known], seeds[c][known] - 1)
    return done


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in order (of their substrings, or fully sorted)."""
    n = len(s)
    before = np.full(n, -1, np.int16)
    to_large = np.zeros(n, bool)
    to_large[1:] = ~small[:-1]
    before[1:] = s[:-1]
    letter = s[lms]
    seeds = [np.zeros(0, np.int32)] * size
    order = np.argsort(letter, kind="stable")
    cuts = np.searchsorted(letter[order], np.arange(size + 1))
    for c in range(size):
        seeds[c] = lms[order[cuts[c] : cuts[c + 1]]]
    end = np.array([n - 1], np.int32)  # larger than the empty suffix after it, so the first that is induced
    start: list[np.ndarray] = seeds
    held_large = _sweep_large(start, np.where(to_large, before, -1), size, end, s)
    reverse = [x[::-1] for x in held_large]
    held_small = _sweep(reverse, np.where(to_large, -1, before), range(size - 1, -1, -1), None)
    return np.concatenate([x for c in range(size) for x in (held_large[c], held_small[c][::-1])])


def _sweep_large(seeds, letter_before, size, end, s):
    """The induction from the left, which the last suffix begins."""
    letter_before = np.append(letter_before, s[-1]).astype(np.int16)  # the empty suffix, at len(s)
    return _sweep(seeds, letter_before, range(size), end + 1)


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Suffixes of s (letters 0 .. size - 1) in order."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = smaller_types(s)
    lms = leftmost_smaller(small)
    if not len(lms):
        return _induce(s, small, lms, size)
    ordered = _induce(s, small, lms, size)
    ordered = ordered[_mask(n, lms)[ordered]]
    ends = np.full(n, n - 1, np.int32)
    ends[lms[:-1]] = lms[1:]
    length = ends[ordered] - ordered + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[:-1] == length[1:]
    live, d = np.flatnonzero(same).astype(np.int32), 0
    while len(live):
        live = live[d < length[live]]
        differ = s[a[live] + d] != s[b[live] + d]
        same[live[differ]] = False
        live = live[~differ]
        d += 1
    same[(ends[a] == n - 1) | (ends[b] == n - 1)] = False  # the last substring ends with the text
    name = np.zeros(n, np.int32)
    name[ordered] = np.concatenate(([0], np.cumsum(~same)))
    names = name[lms]
    del ordered, ends, length, a, b, same, name
    return _induce(s, small, lms[sort_names(names)], size)


def _mask(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def leftmost_smaller(small: np.ndarray) -> np.ndarray:
    """Places of the suffixes that are smaller than the next one, where the one before is larger."""
    return (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)


def _split(rank: np.ndarray, live: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Parts the groups of equal rank among live by value, and returns what is still tied.

    A rank is the number of suffixes in the groups before, so it never changes once a suffix stands alone.
    """
    key = rank[live].astype(np.int64) << 32 | value
    order = np.argsort(key)
    live, key = live[order], key[order]
    at = np.arange(len(live), dtype=np.int32)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    group = key >> 32
    begins = np.concatenate(([True], group[1:] != group[:-1]))
    rank[live] += np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(begins, at, 0))
    return live[~new | np.append(~new[1:], False)]


def sort_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names (of any number of letters) in order."""
    n = len(names)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = smaller_types(names)
    lms = leftmost_smaller(small)
    at = np.full(n + 1, n, np.int32)
    at[lms] = lms
    stop = np.minimum.accumulate(at[::-1])[::-1][1:]  # the next leftmost-smaller suffix after each place
    is_lms = _mask(n, lms)
    rank = np.zeros(n + 1, np.int32)  # the empty suffix has rank 0, so the others are read one higher
    live = _split(rank, np.arange(n, dtype=np.int32), names.astype(np.int64) << 1 | small)
    after = lambda at: np.where(at < n, rank[np.minimum(at, n)] + 1, 0)
    d = 1
    # groups agree in d letters: go on until tied leftmost-smaller substrings are seen whole
    while len(live) and (stop[live[is_lms[live]]] >= live[is_lms[live]] + d).any():
        live, d = _split(rank, live, after(live + d)), 2 * d
    place = np.zeros(n + 1, np.int32)
    if len(live) and len(lms):
        place[lms[sort_names(np.unique(rank[lms], return_inverse=True)[1].astype(np.int32))]] = np.arange(len(lms))
    while len(live):
        near = (stop[live] < live + d) & (stop[live] < n)
        live, d = _split(rank, live, np.where(near, place[stop[live]], after(live + d))), 2 * d
    out = np.empty(n, np.int32)
    out[rank[:n]] = np.arange(n, dtype=np.int32)
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, room: np.ndarray, cap: int = 1024) -> np.ndarray:
    """Length of the prefix that each suffix, by text position, shares with the one before it in order.

    Lengths of cap and more may be told as any length of cap and more.

    room is how far each suffix may be read (to the end of its piece). Only where the letters before
    two neighbours differ is there anything to compare; elsewhere the length is one less than that of
    the suffix one to the left.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int32)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    bound = np.where(before >= 0, np.minimum(room, room[np.maximum(before, 0)]), 0).astype(np.int32)
    found = np.zeros(n, np.int32)
    follows = np.zeros(n, bool)
    b = before[1:]
    follows[1:] = (b > 0) & (before[:-1] == b - 1) & (text[:-1] == text[np.maximum(b - 1, 0)]) & (bound[:-1] > 0)
    # comparisons stop at twice the cap, so a chain begins anew before its bound falls below the cap
    follows &= (at - np.maximum.accumulate(np.where(follows, np.int32(-1), at))) % cap != 0
    words = np.zeros(n, np.uint64)
    padded = np.concatenate((text.astype(np.uint8), np.zeros(8, np.uint8)))
    for k in range(8):
        words |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    live = np.flatnonzero(~follows & (bound > 0)).astype(np.int32)
    p, q, most = live.copy(), before[live], np.minimum(bound[live], 2 * cap)
    done = np.zeros(len(live), np.int32)
    while len(live):
        x = words[p + done] ^ words[q + done]
        low = x & (~x + np.uint64(1))
        step = np.where(x == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(float))).astype(np.int32) >> 3)
        done += step
        going = (x == 0) & (done < most)
        stop = ~going
        found[live[stop]] = np.minimum(done, most)[stop]
        live, p, q, most, done = live[going], p[going], q[going], most[going], done[going]
    del words, padded, bound
    # where a suffix follows its left neighbour, the common end of both stays where it was
    chain = np.maximum.accumulate(np.where(follows, np.int32(-1), at))
    return np.maximum(found[chain] - (at - chain), 0)
