"""Words of a batch of texts as 64-bit numbers, in numpy over the batch's UTF-8 bytes.

A word's number is a polynomial over its bytes modulo 2**64, mixed to spread over all bits. Two different words share a
number with a chance of about 2**-64. Words of any length and texts of any length are handled; memory follows the
chunk, not the text.
"""

import functools

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 18
WHITE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x):
    """Spreads 64-bit numbers: the finalizer of splitmix64."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n, inverse):
    base = pow(BASE, -1, 1 << 64) if inverse else BASE
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
    return out


def powers(n, inverse=False):
    size = CHUNK
    while size < n:
        size *= 2
    return _powers(size, inverse)[:n]


@functools.lru_cache(maxsize=4)
def byte_table(lower, separators):
    """Maps a byte to itself or its lower case, and separators to 0."""
    kind = np.arange(256, dtype=np.uint8)
    if lower:
        kind[65:91] += 32
    kind[list(separators)] = 0
    kind[0] = 0x20  # NUL is no separator, and the space's number is free
    return kind


@functools.lru_cache(maxsize=1)
def punctuation():
    """All ASCII bytes but letters and digits."""
    return tuple(b for b in range(1, 128) if not chr(b).isalnum())


def flat(column):
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset:]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _edges(raw, offsets, table):
    """Chunks of about CHUNK bytes that begin and end between words."""
    start, end = 0, len(raw)
    while start < end:
        stop = min(start + CHUNK, end)
        if stop < end:
            step = stop
            while step < end:
                separators = np.flatnonzero(table[raw[step:step + 4096]] == 0)
                nearest = step + int(separators[0]) if len(separators) else end
                k = int(np.searchsorted(offsets, step))
                if k < len(offsets) and offsets[k] <= min(nearest, step + 4096):
                    nearest = min(nearest, int(offsets[k]))
                if nearest < end or step + 4096 >= end:
                    break
                step += 4096
            stop = nearest
        yield start, stop
        start = stop


def words(raw, offsets, lower=True, separators=WHITE_BYTES):
    """Numbers of all words in order, and the number of words of each text."""
    table = byte_table(lower, tuple(separators))
    found, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    for a, b in _edges(raw, offsets, table):
        kind = table[raw[a:b]]
        inside = kind != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        lo, hi = np.searchsorted(offsets, (a, b))
        cuts = offsets[lo:hi] - a
        first[cuts] |= inside[cuts]
        cuts = cuts[cuts > 0] - 1
        last[cuts] |= inside[cuts]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(begin):
            continue
        with np.errstate(over="ignore"):
            sums = np.empty(b - a + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(kind * powers(b - a), out=sums[1:])
            number = (sums[end] - sums[begin]) * powers(b - a, True)[begin]
            found.append(mix(number + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        text = np.searchsorted(offsets, begin + a, side="right") - 1
        counts += np.bincount(text, minlength=len(counts))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def windows(numbers, counts, length):
    """Numbers of all runs of ``length`` words inside a text, a shorter text's whole run, and the runs of each text."""
    runs = np.where(counts >= length, counts - length + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), runs)
    begin = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
    size = np.minimum(counts[text], length)
    out = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            if len(begin):
                value = numbers[np.minimum(begin + k, len(numbers) - 1)] + np.uint64(k + 1)
                out = np.where(k < size, mix(out * np.uint64(BASE) + value), out)
    return out, runs
