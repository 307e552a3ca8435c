"""Cuckoo filters over 128-bit line digests, in numpy.

A filter has buckets of four 16-bit fingerprints. An item lies in one of two buckets; the second is the first one's
number xor a hash of the fingerprint, so an item can be moved, and removed, without its digest. Insertion runs in
rounds over all pending items at once: each takes a free slot of its bucket, and where none is free one of the four is
put out and tries its other bucket. A filter that cannot take all items is built anew at twice the size, so it holds
every item. The items of a filter are distinct; no more than eight could share both their buckets.
"""

import numpy as np

from paywatch.llm.tokens import mix

SLOTS = 4
ROUNDS = 200
LOAD = 0.85


def _print(low):
    """A fingerprint from 1 to 65535 of the digest's low half."""
    return ((mix(low) >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _other(bucket, prints, mask):
    return (bucket ^ (mix(prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & mask)).astype(np.uint64)


def _rank(sorted_keys):
    """Position of each element inside its run of equal keys."""
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return np.arange(len(sorted_keys)) - np.repeat(first, np.diff(np.r_[first, len(sorted_keys)]))


def _place(table, bucket, prints, mask, rng):
    """Puts items in; gives back those that found no place."""
    move = False
    for _ in range(ROUNDS):
        if not len(prints):
            break
        if move:
            bucket = _other(bucket, prints, mask)
        order = np.argsort(bucket, kind="stable")
        bucket, prints = bucket[order], prints[order]
        rank = _rank(bucket)
        free = table[bucket] == 0
        fits = rank < free.sum(1)
        slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
        table[bucket[fits], slot] = prints[fits]
        bucket, prints = bucket[~fits], prints[~fits]
        if move and len(prints):
            one = _rank(bucket) == 0  # one exchange for each bucket and round
            out = rng.integers(0, SLOTS, int(one.sum()))
            taken = table[bucket[one], out]
            table[bucket[one], out] = prints[one]
            prints = prints.copy()
            prints[one] = taken
        move = True
    return bucket, prints


def build(high, low):
    """A filter that holds all items given by the two halves of their digests."""
    size = 1
    while size * SLOTS * LOAD < max(1, len(low)):
        size *= 2
    while True:
        table = np.zeros((size, SLOTS), dtype=np.uint16)
        mask = np.uint64(size - 1)
        prints = _print(low)
        _, left = _place(table, high & mask, prints, mask, np.random.default_rng(size))
        if not len(left):
            return table
        size *= 2


def insert(table, high, low):
    """The filter with more items, or None if it has no room and must be built anew."""
    out, mask = table.copy(), np.uint64(len(table) - 1)
    _, left = _place(out, high & mask, _print(low), mask, np.random.default_rng(len(low)))
    return None if len(left) else out


def contains(table, high, low):
    """Whether each item may be in the filter; an item that was put in always is."""
    mask, prints = np.uint64(len(table) - 1), _print(low)
    first = high & mask
    return (table[first] == prints[:, None]).any(1) | (table[_other(first, prints, mask)] == prints[:, None]).any(1)


def delete(table, high, low):
    """The filter without one slot for each given item; all must have been put in before."""
    out, mask, prints = table.copy(), np.uint64(len(table) - 1), _print(low)
    bucket = high & mask
    for second in (False, True):
        if second:
            bucket = _other(bucket, prints, mask)
        # Equal prints in one bucket are alike: the k-th such item clears the k-th such slot.
        order = np.lexsort((prints, bucket))
        bucket, prints = bucket[order], prints[order]
        rank = _rank(bucket * np.uint64(65536) + prints)
        same = out[bucket] == prints[:, None]
        fits = rank < same.sum(1)
        slot = np.argsort(~same[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
        out[bucket[fits], slot] = 0
        bucket, prints = bucket[~fits], prints[~fits]
    if len(prints):
        raise ValueError(f"{len(prints)} items were never in the filter")
    return out
