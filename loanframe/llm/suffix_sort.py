"""Two-stage suffix sorting of a byte string, to a bounded depth.

Only suffixes that are smaller than their successors are sorted directly, by
ordered names of 64-byte pieces; the others are induced by one pass over the
buckets of first bytes, from the smallest bucket to the largest.
"""

from __future__ import annotations

import numpy as np


def piece_names(text: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """(order-preserving numbers of the piece at each place, length of a piece); the end counts as smallest.

    Bytes are coded densely, so one word holds seven or more of them; three doublings follow.
    A piece is ``most`` bytes long at most."""
    n = len(text)
    used = np.zeros(257, bool)
    used[text] = True
    code = np.cumsum(used).astype(np.uint64)  # from 1; 0 stands past the end
    bits = int(code[-1]).bit_length()
    size = max(1, min(63 // bits, most // 8))
    wide = np.concatenate([code[text], np.zeros(9 * size, np.uint64)])
    name = np.zeros(n + 8 * size, np.uint64)
    for k in range(size):
        name = (name << np.uint64(bits)) | wide[k:k + len(name)]
    name = _rank(name)
    for _ in range(3):
        later = np.concatenate([name[size:], np.zeros(size, np.int64)])
        name, size = _rank((name.astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64)), size * 2
    return name[:n], size


def _rank(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    up = np.concatenate([[0], (np.diff(keys[order]) != 0).cumsum()])
    out = np.empty(len(keys), np.int64)
    out[order] = up
    return out


def _is_small(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than its successor (a run takes after its end)."""
    n = len(text)
    step = np.concatenate([np.sign(np.diff(text.astype(np.int16))), [-1]])  # 1: rises, -1: falls, 0: a run goes on
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _sort_small(places: np.ndarray, names: np.ndarray, piece: int, depth: int) -> np.ndarray:
    """Places sorted by their first ``depth`` bytes (at least), piece by piece among those still equal."""
    padded = np.concatenate([names, np.full(depth + piece, -1)])
    order = places[np.argsort(padded[places], kind="stable")]
    group = np.concatenate([[0], (np.diff(padded[order]) != 0).cumsum()])
    for at in range(piece, depth, piece):
        many = np.bincount(group)[group] > 1
        if not many.any():
            break
        tied = np.flatnonzero(many)
        key, old = padded[order[tied] + at], group[tied]
        # Only groups whose members part here are sorted again; equal strings stay in the order they have.
        parts = (np.diff(key) != 0) & (np.diff(old) == 0)
        if not parts.any():
            continue
        parting = np.zeros(group[-1] + 1, bool)
        parting[old[1:][parts]] = True
        tied = tied[parting[old]]
        key, old = padded[order[tied] + at], group[tied]
        new = np.lexsort((key, old))
        order[tied], key = order[tied][new], key[new]
        fresh = np.zeros(len(group), bool)
        fresh[1:] = np.diff(group) != 0
        inner = np.concatenate([[False], (np.diff(key) != 0) & (np.diff(old) == 0)])
        fresh[tied[inner]] = True
        group = fresh.cumsum()
    return order


def suffix_order(text: np.ndarray, names: np.ndarray, piece: int, depth: int) -> np.ndarray:
    """Places of all suffixes, sorted by their first ``depth`` bytes."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    small = np.flatnonzero(_is_small(text))
    sorted_small = _sort_small(small, names, piece, depth) if len(small) else small
    first = text[sorted_small]
    cuts = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    out = []
    for c in range(256):
        mine = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        runs = mine
        while len(runs):  # a run of c: each suffix induces the one before it
            before = runs[runs > 0] - 1
            runs = before[text[before] == c]
            mine = np.concatenate([mine, runs])
        bucket = np.concatenate([mine, sorted_small[cuts[c]:cuts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            chars = text[before]
            order = np.argsort(chars, kind="stable")
            chars, before = chars[order], before[order]
            for part in np.split(before, np.flatnonzero(np.diff(chars)) + 1):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def equal_neighbours(order: np.ndarray, names: np.ndarray, piece: int, length: int) -> np.ndarray:
    """Whether each suffix of the order shares its first ``length`` bytes with the one before it.

    The places must have ``length`` bytes left, a piece no more than that; pieces overlap at the end to cover the length exactly."""
    same = np.ones(len(order), bool)
    same[:1] = False
    for at in sorted({*range(0, length - piece, piece), length - piece}):
        same[1:] &= names[order[1:] + at] == names[order[:-1] + at]
    return same


def repeated(cells: list[bytes], length: int) -> list[np.ndarray]:
    """For each byte string, the places whose next ``length`` bytes also start somewhere else in the strings."""
    text = np.frombuffer(b"".join(cells), np.uint8)
    size = np.array([len(c) for c in cells])
    begin = np.cumsum(size) - size
    windows = np.maximum(size - length + 1, 0)
    starts = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    names, piece = piece_names(text, length)
    allowed = np.zeros(len(text), bool)
    allowed[starts] = True
    order = suffix_order(text, names, piece, length)
    order = order[allowed[order]]
    same = equal_neighbours(order, names, piece, length)
    twice = same | np.concatenate([same[1:], [False]])
    hit = np.zeros(len(text), bool)
    hit[order[twice]] = True
    return [np.flatnonzero(hit[b:b + w]) for b, w in zip(begin, windows)]
