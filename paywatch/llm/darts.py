"""Signatures by throwing darts (DartMinHash), in numpy.

Darts fall on the plane of (element's weight, time) as a Poisson process of rate one, each with a coordinate. Which darts
fall is a function of the element alone: every unit cell of weight by time has its own hashed number of darts and their
places. A set owns the darts in the regions [0, weight) of its elements; its signature holds, for every coordinate, the
earliest of its darts. Two sets have the same entry with a probability equal to their weighted Jaccard similarity, as the
earliest dart of the union lies in the intersection just then.

With n coordinates and total weight W only darts earlier than (n ln n + 2 n) / W are thrown, about n ln n + 2 n of them
whatever the size of the set. Where a coordinate is left empty, the time doubles and more darts are thrown; as only the
earliest counts, when a set stops throwing does not change its signature.
"""

import numpy as np

from paywatch.llm.tokens import mix

#: A dart's time is its cell and this many binary digits.
FINE = 40
EMPTY = np.uint64((1 << 64) - 1)
#: Cells (of weight by time) that are thrown into at once.
BLOCK = 1 << 19


def _poisson():
    """Thresholds of a hashed 64-bit number for one dart, two darts and so on in a unit cell."""
    chance, total, out = float(np.exp(-1.0)), 0.0, []
    for k in range(20):
        total += chance
        out.append(min(total, 1.0 - 2.0**-53))
        chance /= k + 1
    return (np.array(out) * 2.0**64).astype(np.uint64)


THRESHOLDS = _poisson()


def _throw(table, owner, element, weight_cell, top, time_cell, limit, coordinates):
    """Throws into unit cells and keeps each owner's earliest dart of a coordinate in ``table``."""
    with np.errstate(over="ignore"):
        cell = mix(element + mix(weight_cell * np.uint64(0x9E3779B97F4A7C15) + time_cell + np.uint64(1)))
    darts = np.searchsorted(THRESHOLDS, cell, side="right")
    at = np.repeat(np.arange(len(cell)), darts)
    nth = (np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(np.uint64)
    with np.errstate(over="ignore"):
        own = mix(cell[at] + (nth + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        time = (time_cell[at] << np.uint64(FINE)) | (own >> np.uint64(64 - FINE))
        early = time < limit[owner[at]]
        at, time = at[early], time[early]
        second = mix(own[early] ^ np.uint64(0xA0761D6478BD642F))
    cut = top[at] < 1.0  # the last cell of a weight that is no whole number
    if cut.any():
        inside = ~cut | ((second & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32 < top[at])
        at, time, second = at[inside], time[inside], second[inside]
    coordinate = ((second >> np.uint64(32)) % np.uint64(coordinates)).astype(np.int64)
    np.minimum.at(table, owner[at] * coordinates + coordinate, time)


def signatures(elements, sizes, coordinates, weights=None):
    """A row of ``coordinates`` numbers for every set; sets without elements get EMPTY everywhere.

    ``elements``: 64-bit numbers of all sets one after another. ``sizes``: elements of each set; the same element twice
    in a set counts once. ``weights``: positive, of each element; one each if left out.
    """
    sets = len(sizes)
    table = np.full(sets * coordinates, EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(sets), sizes)
    if weights is None:
        weights = np.ones(len(elements))
    total = np.bincount(owner, weights=weights, minlength=sets)
    with np.errstate(divide="ignore"):
        until = np.where(total > 0, (coordinates * np.log(coordinates) + 2 * coordinates) / total, 0.0)
    thrown = np.zeros(sets, dtype=np.int64)  # time cells done
    open_ = total > 0
    rows = np.ceil(weights).astype(np.int64)
    while open_.any():
        cells = np.where(open_, np.ceil(until).astype(np.int64) - np.maximum(thrown - 1, 0), 0)
        limit = np.minimum(until * 2.0**FINE, 2.0**63).astype(np.uint64)
        # Whole unit cells of time, from the last one that was not finished.
        work = rows * cells[owner]
        ends = np.cumsum(work)
        a = 0
        while a < len(work):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, side="right")))
            part = np.repeat(np.arange(a, b), work[a:b])
            k = np.arange(len(part)) - np.repeat(ends[a:b] - work[a:b] - (ends[a - 1] if a else 0), work[a:b])
            mine = owner[part]
            row = k // np.maximum(cells[mine], 1)
            time_cell = (k % np.maximum(cells[mine], 1) + np.maximum(thrown[mine] - 1, 0)).astype(np.uint64)
            _throw(table, mine, elements[part], row.astype(np.uint64), weights[part] - row, time_cell, limit, coordinates)
            a = b
        thrown = np.where(open_, np.ceil(until).astype(np.int64), thrown)
        open_ &= (table.reshape(sets, coordinates) == EMPTY).any(1)
        until = np.where(open_, until * 2, until)
    return table.reshape(sets, coordinates)


def bands(table, count, rows):
    """One number for each band of ``rows`` coordinates."""
    out = np.empty((len(table), count), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(count):
            value = np.full(len(table), b + 1, dtype=np.uint64)
            for r in range(rows):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + table[:, b * rows + r])
            out[:, b] = value
    return out
