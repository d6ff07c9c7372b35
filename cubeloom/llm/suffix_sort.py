"""Two-stage suffix sorting of many short byte strings at once, in numpy.

Only suffixes smaller than their successor (and the ends of the strings) are sorted directly; all
others are induced by scanning the buckets of first symbols in ascending order. Strings are separated by
a symbol smaller than any other; suffixes compare up to their string's end and equal ones may stand in
either order.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text with separator 0 after each string, and the distance of each place to its string's end. Strings must be
    UTF-8 pieces: byte 0 is written as 255, which UTF-8 does not use; only equality matters here, not the order of symbols."""
    text = np.frombuffer(b"".join(s.replace(b"\0", b"\xff") + b"\0" for s in strings), np.uint8)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    rest = np.repeat(ends, [len(s) + 1 for s in strings]) - np.arange(len(text))
    return text, rest


#: MASKS[k] keeps the first k symbols of a word.
MASKS = np.array([0] + [(1 << 64) - (1 << (8 * (WORD - k))) for k in range(1, WORD + 1)], np.uint64)


def words_of(text: np.ndarray) -> np.ndarray:
    """For each place, and the one after the last, the next eight symbols as one number."""
    padded = np.append(text, np.zeros(WORD + 1, np.uint8)).astype(np.uint64)
    out = np.zeros(len(text) + 1, np.uint64)
    for k in range(WORD):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def words_at(words: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The words at some places, zero beyond the string's end."""
    return words[at] & MASKS[np.clip(rest, 0, WORD)]


def sort_directly(text: np.ndarray, rest: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` in the order of the suffixes that begin there: by eight symbols, then ties by the next eight."""
    words = words_of(text)
    key = words_at(words, at, rest[at])
    order = np.argsort(key, kind="stable")
    key, order = key[order], at[order]
    group = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(order) else key.astype(np.int64)
    depth, tied = WORD, np.arange(len(order))
    while len(tied):
        size = np.bincount(group[tied])
        tied = tied[(size[group[tied]] > 1) & (rest[order[tied]] >= depth)]
        if not len(tied):
            break
        places = order[tied]
        key = words_at(words, np.minimum(places + depth, len(text)), rest[places] - depth)
        inner = np.lexsort((key, group[tied]))
        order[tied] = places[inner]
        key, own = key[inner], group[tied]
        # within a group the members of a new word get a number of their own, beyond all numbers so far
        new = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))
        group[tied] = np.cumsum(new) - 1
        depth += WORD
    return order


def suffix_array(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # larger[i]: suffix i is larger than suffix i+1; equal symbols take the kind of the next place.
    differ = np.append(text[:-1] != text[1:], True)
    gt = np.append(text[:-1] > text[1:], False)
    nearest = np.minimum.accumulate(np.where(differ, np.arange(n), n)[::-1])[::-1]
    larger = gt[nearest] & (text > 0)
    direct = sort_directly(text, rest, np.flatnonzero(~larger))
    counts = np.bincount(text, minlength=256)
    begin = np.cumsum(counts) - counts
    induced = np.bincount(text[larger], minlength=256)
    out = np.full(n, -1, np.int64)
    kinds = np.bincount(text[direct], minlength=256)
    first = np.cumsum(kinds) - kinds
    head = begin.copy()  # next free place of the induced part of each bucket
    for c in np.flatnonzero(counts):
        done = begin[c]
        while done < head[c]:  # induced members may add more to their own bucket
            wave = out[done : head[c]]
            done = head[c]
            _induce(text, larger, wave, out, head)
        own = direct[first[c] : first[c] + kinds[c]]
        out[begin[c] + induced[c] : begin[c] + counts[c]] = own
        _induce(text, larger, own, out, head)
    return out


def _induce(text, larger, wave, out, head) -> None:
    before = wave[wave > 0] - 1
    before = before[larger[before]]
    if not len(before):
        return
    symbol = text[before]
    order = np.argsort(symbol, kind="stable")
    before, symbol = before[order], symbol[order]
    kinds, start, size = np.unique(symbol, return_index=True, return_counts=True)
    out[np.repeat(head[kinds] - start, size) + np.arange(len(before))] = before
    head[kinds] += size


def common_prefixes(text: np.ndarray, rest: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place of ``sa`` but the first, the prefix that it shares with the one before, ``most`` at most."""
    words = words_of(text)
    a, b = sa[:-1], sa[1:]
    room = np.minimum(np.minimum(rest[a], rest[b]), most)
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(room > 0)
    for depth in range(0, most, WORD):
        left = np.minimum(room[live] - depth, WORD)
        x = words_at(words, a[live] + depth, left) ^ words_at(words, b[live] + depth, left)
        same = np.full(len(live), WORD)
        for k in reversed(range(WORD)):  # the first symbol that differs
            same[(x >> np.uint64(8 * (WORD - 1 - k))) & np.uint64(255) > 0] = k
        out[live] = depth + np.minimum(same, left)
        live = live[(same == WORD) & (room[live] > depth + WORD)]
    return out
