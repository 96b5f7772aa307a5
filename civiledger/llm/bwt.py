"""Burrows-Wheeler transforms of shards of a string collection, merged by refining their interleave.

A symbol is a word of ``width`` bytes together with its distance from its
string's anchor (and the string's group), so only stretches at equal distances
from the anchors of one group are ever compared. A string stands for ``width``
sequences of words, one for each place modulo ``width``.

Each shard is sorted on its own: suffixes by their words, from the ends on. Its
transform is the word before each suffix in that order, and ``earlier`` leads
from each suffix to the one that begins with this word (the step of a backward
search). Shards are merged without sorting suffixes again. The interleave is
held as blocks, and of each block and shard the interval of the shard's order:
because a shard is sorted, the suffixes that begin with one word before a block
are again an interval of it. At first a block is all that stands at one
distance; each round splits the blocks by the word before them and so makes the
common prefix one word longer. A block is open while it has two suffixes and one
that is not known as repeated; all others are closed for good, as whatever
begins earlier is as single. The round in which a block closes is the length of
its common prefix; blocks open at the full depth are the repeated intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a symbol: a multiple of 8 that divides the depth. Each round refines by one symbol.
WIDTH = 40
#: Bytes of strings in a shard.
SHARD_BYTES = 1 << 18


@dataclass
class Shards:
    """The suffixes of all shards, column by column, in each shard's order within a column.

    ``place`` is the byte at which a suffix starts, ``block`` its column and
    group, ``shard`` its shard, ``transform`` the word before it (0: none),
    ``earlier`` the suffix that begins with that word.
    """

    place: np.ndarray
    block: np.ndarray
    shard: np.ndarray
    transform: np.ndarray
    earlier: np.ndarray


def _sorted(*keys: np.ndarray) -> np.ndarray:
    """Stable order by the first key, then the second and so on; keys are not negative."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 62:
        return np.lexsort(keys[::-1])
    whole = keys[0].astype(np.int64)
    for k, b in zip(keys[1:], bits[1:], strict=True):
        whole = (whole << b) | k
    return np.argsort(whole, kind="stable")


def _by_symbol(symbol: np.ndarray, top: int) -> np.ndarray:
    """Stable order of symbols, by distribution of 16 bits at a time."""
    if top < 1 << 16:
        return np.argsort(symbol.astype(np.uint16), kind="stable")
    order = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((symbol[order] >> 16).astype(np.uint16), kind="stable")]


def word_codes(raw: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Small numbers for the words of ``width`` bytes from each start on: equal just for equal words."""
    parts = [np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[starts + k] for k in range(0, width, 8)]
    mixed = parts[0]
    for part in parts[1:]:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + part
    _, first, code = np.unique(mixed, return_index=True, return_inverse=True)
    if len(parts) > 1 and any(not np.array_equal(part, part[first][code]) for part in parts):  # two words of one hash
        code = np.unique(np.stack(parts, axis=1), axis=0, return_inverse=True)[1].ravel()
    return code


def transforms(raw: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, groups: np.ndarray, shards: np.ndarray, width: int = WIDTH) -> Shards:
    """Sort each shard and transform it. Strings lie side by side in ``raw``."""
    # a suffix may be empty: one place more than bytes for each string
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    at = np.arange(len(owner)) - firsts[owner]
    byte = np.cumsum(sizes) - sizes
    left = sizes[owner] - at
    word = np.zeros(len(owner), np.int64)
    full = left >= width
    if full.any():
        word[full] = word_codes(raw, (byte[owner] + at)[full], width) + 1
    column = at + (int(anchors.max(initial=0)) - anchors)[owner]
    step, phase = column // width, column % width
    ahead = np.zeros(len(owner), np.int64)  # rank of the suffix one word later
    order = np.argsort(step, kind="stable")
    ends = np.searchsorted(step[order], np.arange(int(step.max(initial=-1)) + 2))
    kind = (groups[owner] * width + phase) * (int(shards.max(initial=0)) + 1) + shards[owner]
    suffix = np.zeros(len(owner), np.int64)
    for t in range(len(ends) - 2, -1, -1):
        here = order[ends[t] : ends[t + 1]]
        here = here[_sorted(kind[here], word[here], ahead[here])]
        suffix[ends[t] : ends[t + 1]] = here
        rank = np.arange(1, len(here) + 1)
        has = at[here] >= width
        ahead[here[has] - width] = rank[has]
    number = np.empty(len(owner), np.int64)
    number[suffix] = np.arange(len(suffix))
    has = at[suffix] >= width
    before = suffix[has] - width
    transform, earlier = np.zeros(len(suffix), np.int32), np.zeros(len(suffix), np.int32)
    transform[has], earlier[has] = word[before], number[before]
    blocks = step[suffix] * (int(groups.max(initial=0)) + 1) * width + groups[owner[suffix]] * width + phase[suffix]
    return Shards(suffix, blocks, shards[owner[suffix]].astype(np.int32), transform, earlier)


def merged(shards: Shards, known: np.ndarray, depth: int, width: int = WIDTH) -> tuple[np.ndarray, list[int]]:
    """Suffixes in blocks with a common prefix of ``depth`` bytes, and the open suffixes in each round.

    ``known`` marks suffixes whose repeats are known already: they keep blocks
    open for others only.
    """
    top = int(shards.transform.max(initial=0))
    change = lambda x: np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)

    fresh = (~known).astype(np.int32)

    def opened(starts: np.ndarray, new: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (first suffix, size, block) of the blocks that stay open; ``at`` are the suffixes by block, then shard."""
        heads = np.flatnonzero(starts)
        if not len(heads):
            return at[:0], at[:0], at[:0]
        tails = np.append(heads[1:], len(at)) - 1
        upto = np.cumsum(fresh[at], dtype=np.int32)
        good = (tails > heads) & (upto[tails] - upto[heads] + fresh[at[heads]] > 0)
        begins = np.flatnonzero(new)
        size = np.diff(np.append(begins, len(at))).astype(np.int32)
        number = np.cumsum(starts[begins], dtype=np.int32) - 1
        stay = good[number]
        return at[begins[stay]], size[stay], number[stay]

    every = np.arange(len(shards.place), dtype=np.int32)
    starts = change(shards.block)
    first, size, block = opened(starts, starts | change(shards.shard), every)
    sizes = []
    for _ in range(depth // width):
        total = int(size.sum())
        sizes.append(total)
        if not total:
            break
        interval = np.repeat(every[: len(size)], size)
        at = every[:total] + np.repeat(first - (np.cumsum(size, dtype=np.int32) - size), size)
        symbol = shards.transform[at]
        has = np.flatnonzero(symbol)
        symbol = symbol[has]
        order = _by_symbol(symbol, top)
        symbol, order = symbol[order], has[order]
        interval = interval[order]
        other = change(symbol)
        new = other | change(interval)
        # a shard's suffixes that one word puts before an interval are an interval: its first one and its size say all
        begins = np.flatnonzero(new)
        lengths = np.diff(np.append(begins, len(order)))
        heads = shards.earlier[at[order[begins]]]
        own = block[interval[begins]]
        starts = np.zeros(len(order), bool)
        starts[begins] = other[begins] | change(own)
        first, size, block = opened(starts, new, every[: len(order)] + np.repeat(heads - begins.astype(np.int32), lengths))
    total = int(size.sum())
    out = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total) if total else np.zeros(0, np.int64)
    return out, [*sizes, total]


def repeated(strings: list[bytes], anchors: np.ndarray, groups: np.ndarray, known: np.ndarray, depth: int, n_shards: int | None = None, width: int = WIDTH) -> list[np.ndarray]:
    """For each string, the starts of ``depth`` bytes that another string of its group has at the same distance from its anchor.

    Strings of a group that are ``known`` as repeated answer nothing themselves.
    Groups are numbered from 0 on and lie together. ``depth`` is a multiple of
    ``width``.
    """
    if depth % width or width % 8:
        raise ValueError("the width must be a multiple of 8 and divide the depth")
    sizes = np.array([len(s) for s in strings], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in strings]
    raw = np.frombuffer(b"".join(strings), np.uint8)
    n = n_shards or max(2, -(-len(raw) // SHARD_BYTES))
    found = transforms(raw, sizes, anchors, groups, np.arange(len(sizes)) % n, width)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)[found.place]
    hits, _ = merged(found, known[owner], depth, width)
    hits = np.sort(found.place[hits[~known[owner[hits]]]])
    firsts = np.cumsum(sizes + 1) - sizes - 1
    cuts = np.searchsorted(hits, np.append(firsts, len(owner)))
    return [hits[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], firsts, strict=True)]
