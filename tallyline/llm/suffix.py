"""Maximal repeats of many byte strings by an enhanced suffix array and its interval tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64

GRAM = 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte substrings."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    low, high = (np.ndarray((n,), "<u8", data, at, (1,)) for at in (0, 8))
    high = high ^ (high >> np.uint64(29))
    high *= _B
    high += low * _A
    return mix64(high)


def range_hashes(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """Hashes of byte ranges of GRAM to ``longest`` bytes, from the grams that cover them."""
    out = (ends - starts).astype(np.uint64)
    last = ends - GRAM
    for step in range(0, longest, GRAM):
        out = mix64(out ^ (grams[np.minimum(starts + step, last)] + _A))
    return mix64(out ^ grams[last])


class Suffixes:
    """Suffixes of ``least`` bytes or more that another one's first ``least`` bytes equal.

    ``texts`` are ranges [starts, ends) of ``data``; a suffix ends with its text. Order: by
    the leading ``least`` bytes (equal ones together), then by what follows. ``lcp[i]`` is the
    length that suffixes i - 1 and i share.

    Suffixes whose leading bytes always follow the same byte are left out: whatever repeats
    there repeats one byte longer from the position before. A text's first byte follows
    nothing, which differs from everything.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int):
        count = ends - starts - least + 1
        text = np.repeat(np.arange(len(starts)), count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
        left = np.where(at > starts[text], data[at - 1].astype(np.int16), np.int16(-1))
        head = range_hashes(gram_hashes(data), at, at + least, least)
        order = np.argsort(head, kind="stable")
        first = np.concatenate([[True], head[order][1:] != head[order][:-1]]) if len(order) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        opens = np.flatnonzero(first)
        seen = left[order]
        if len(opens):
            low, high = np.minimum.reduceat(seen, opens), np.maximum.reduceat(seen, opens)
            keep = ((size > 1) & ((low != high) | (low < 0)))[group]
            order, group = order[keep], group[keep]
        self.at, self.text = at[order], text[order]
        self.left = left[order]
        self.rest = ends[self.text] - self.at
        # what follows the leading bytes, eight at a time, with nothing past a text's end
        longest = int(self.rest.max(initial=least))
        columns = [self._word(data, 8 * j) for j in range((longest + 7) // 8)]
        by = np.lexsort([*columns[least // 8:][::-1], group]) if len(order) else np.zeros(0, np.int64)
        self.at, self.text, self.left, self.rest = (x[by] for x in (self.at, self.text, self.left, self.rest))
        group = group[by]
        columns = [c[by] for c in columns]
        lcp = np.zeros(len(by), np.int64)
        open_ = np.concatenate([[False], group[1:] == group[:-1]]) if len(by) else np.zeros(0, bool)
        for c in columns:
            differ = np.zeros(len(by), np.uint64)
            differ[1:] = c[1:] ^ c[:-1]
            same = open_ & (differ == 0)
            lcp[same] += 8
            stop = np.flatnonzero(open_ & (differ != 0))
            for byte in range(7):
                stop = stop[differ[stop] >> np.uint64(56 - 8 * byte) == 0]
                lcp[stop] += 1
            open_ = same
        lcp[1:] = np.minimum(lcp[1:], np.minimum(self.rest[1:], self.rest[:-1]))
        self.lcp = lcp

    def _word(self, data: np.ndarray, skip: int) -> np.ndarray:
        """The eight bytes from ``skip`` on of every suffix, as a big-endian number."""
        out = np.zeros(len(self.at), np.uint64)
        for byte in range(8):
            inside = self.rest > skip + byte
            value = data[np.where(inside, self.at + skip + byte, 0)].astype(np.uint64)
            out = out << np.uint64(8) | np.where(inside, value, np.uint64(0))
        return out


def maximal_repeats(s: Suffixes, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, past): suffixes first to past - 1 are all occurrences of one maximal repeat.

    A scan with a stack walks the tree of common-prefix intervals bottom-up. An interval's
    prefix can't be longer for all its members; it is a maximal repeat if it can't be longer
    to the left either, that is if its members follow different bytes (or a text's start).
    """
    lcp = np.append(s.lcp, 0).tolist()
    left = s.left.tolist()
    # per open interval: length, first member, the byte all members follow (-1: they differ)
    stack: list[list[int]] = []
    for i in range(1, len(lcp)):
        first, after = i - 1, left[i - 1]
        while stack and stack[-1][0] > lcp[i]:
            length, first, mine = stack.pop()
            after = mine if mine == after else -1
            if after < 0:
                yield length, first, i
        if lcp[i] >= least:
            if not stack or stack[-1][0] < lcp[i]:
                stack.append([lcp[i], first, after])
            elif stack[-1][2] != after:
                stack[-1][2] = -1
        else:
            stack.clear()
