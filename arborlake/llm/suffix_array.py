"""Suffix arrays by induced sorting, a bucket at a time.

Suffixes are classed as S (smaller than the next) or L (larger). The leftmost S suffixes of each S run cut the text
into substrings; these are sorted by inducing from their first letters, named by rank, and if names repeat, the
text of names is sorted in turn. From the sorted leftmost suffixes all L suffixes follow in one scan to the right,
and all S suffixes in one to the left. A scan takes what stands in a bucket as one array; what it induces into the
same bucket is the next array.

A text of names over a large alphabet is ranked by doubling, up to the length that the caller needs sorted.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are scanned bucket by bucket.
SCANNED = 600


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S. The last letter is a unique smallest one, whose suffix is S."""
    n = len(text)
    out = np.ones(n, bool)
    if n > 1:
        change = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
        turn = np.minimum.accumulate(change[::-1])[::-1]
        out[:-1] = text[turn] < text[np.minimum(turn + 1, n - 1)]
    return out


def _ranked(letters: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order of letters, each one's place among its equals, and the letters' counts."""
    order = np.argsort(letters, kind="stable")
    counts = np.bincount(letters, minlength=alphabet)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order, place, counts


def _induce(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array that follows from an order of the leftmost S suffixes (sorted within each letter)."""
    n = len(text)
    sizes = np.bincount(text, minlength=alphabet)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(n, -1, np.int64)
    seeds = leftmost[np.argsort(text[leftmost], kind="stable")]
    seed_ends = np.cumsum(np.bincount(text[seeds], minlength=alphabet))
    letters = np.flatnonzero(sizes).tolist()

    head = starts.copy()

    def larger(suffixes: np.ndarray) -> None:
        before = suffixes - 1
        before = before[before >= 0]
        before = before[~small[before]]
        if len(before):
            found = text[before]
            order, place, counts = _ranked(found, alphabet)
            out[head[found[order]] + place] = before[order]
            np.add(head, counts, out=head)

    for c in letters:
        done = starts[c]
        while done < head[c]:
            upto = head[c]
            larger(out[done:upto])
            done = upto
        first = seed_ends[c - 1] if c else 0
        if first < seed_ends[c]:
            larger(seeds[first : seed_ends[c]])

    tail = ends.copy()
    out[0] = n - 1
    tail[text[n - 1]] -= 1

    def smaller(suffixes: np.ndarray) -> None:
        before = suffixes[::-1] - 1
        before = before[before >= 0]
        before = before[small[before]]
        if len(before):
            found = text[before]
            order, place, counts = _ranked(found, alphabet)
            out[tail[found[order]] - 1 - place] = before[order]
            np.subtract(tail, counts, out=tail)

    for c in reversed(letters):
        done = ends[c]
        while done > tail[c]:
            upto = tail[c]
            smaller(out[upto:done])
            done = upto
        if head[c] > starts[c]:
            smaller(out[starts[c] : head[c]])
    return out


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a text of names by their first ``depth`` names at least."""
    rank, length = names.astype(np.int64), 1
    n = len(names)
    while True:
        order = np.argsort(rank, kind="stable")
        if length >= depth or rank[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[: n - length] = rank[length:] + 1
        pairs = rank * (n + 1) + follow
        order = np.argsort(pairs, kind="stable")
        step = pairs[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(step[1:] != step[:-1])])
        length *= 2


def suffix_array(text: np.ndarray, alphabet: int, depth: int) -> np.ndarray:
    """Places of the suffixes in order, right for their first ``depth`` letters at least.

    ``text`` holds letters below ``alphabet`` and ends with a smallest letter that stands nowhere else.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(text)
    is_leftmost = small.copy()
    is_leftmost[0] = False
    is_leftmost[1:] &= ~small[:-1]
    leftmost = np.flatnonzero(is_leftmost)
    first = _induce(text, small, leftmost, alphabet)
    order = first[is_leftmost[first]]
    # substrings reach to the next leftmost suffix; equal neighbours get one name
    length = np.zeros(n, np.int64)
    length[leftmost] = np.append(leftmost[1:], n - 1) - leftmost + 1
    a, b = order[:-1], order[1:]
    differ = length[a] != length[b]
    alive, at = np.flatnonzero(~differ), 0
    while len(alive):
        other = text[a[alive] + at] != text[b[alive] + at]
        differ[alive[other]] = True
        alive = alive[~other]
        at += 1
        alive = alive[length[a[alive]] > at]
    names = np.empty(n, np.int64)
    names[order] = np.concatenate([[0], np.cumsum(differ)])
    reduced = names[leftmost]
    count = int(reduced.max()) + 1
    if count < len(leftmost):
        # a leftmost suffix is at least two letters before the next
        if count <= SCANNED:
            sub = suffix_array(reduced, count, -(-depth // 2) + 1)
        else:
            sub = _doubled(reduced, -(-depth // 2) + 1)
        order = leftmost[sub]
    return _induce(text, small, order, alphabet)


def repeats(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment the places where a string of ``length`` bytes begins that also begins earlier: in a
    segment before it, or before in the same one."""
    if not segments:
        return []
    sizes = np.array([len(s) for s in segments], np.int64)
    body = np.frombuffer(b"\0".join([*segments, b""]), np.uint8).astype(np.uint16) + np.uint16(2)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    body[begins[1:] - 1] = 1
    text = np.append(body, np.uint16(0))
    order = suffix_array(text, 258, length)
    # strings that fit into their segment
    fits = np.zeros(len(text) + 1, np.int64)
    whole = np.maximum(sizes - length + 1, 0)
    np.add.at(fits, begins[:-1], whole > 0)
    np.add.at(fits, begins[:-1] + whole, -(whole > 0).astype(np.int64))
    fits = np.cumsum(fits)[:-1] > 0
    order = order[fits[order]]
    # permuted common prefixes, as far as the length: each place against the one before it in order
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(before >= 0)
    packed = np.zeros(len(text) + 8, np.uint64)
    padded = np.concatenate([text, np.zeros(4, np.uint16)]).astype(np.uint64)
    words = padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    packed[: len(words)] = words
    alive = places
    for at in [*range(0, length - 3, 4), length - 4]:
        if not len(alive):
            break
        alive = alive[packed[alive + at] == packed[before[alive] + at]]
    equal = np.zeros(len(text), bool)
    equal[alive] = True
    # a run of equal strings: its first place in the text stays
    group = np.cumsum(~equal[order])
    repeated = np.zeros(len(text), bool)
    if len(order):
        least = np.full(group[-1] + 1, len(text), np.int64)
        np.minimum.at(least, group, order)
        repeated[order[order != least[group]]] = True
    found = np.flatnonzero(repeated)
    cut = np.searchsorted(found, begins)
    return [found[a:b] - o for a, b, o in zip(cut[:-1], cut[1:], begins[:-1])]
