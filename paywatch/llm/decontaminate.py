"""Benchmark decontamination by edit distance: intact segments, exact verification.

Texts are sequences of words (A-Z in lower case, white space and ASCII punctuation between them). An item of n words may
differ from a document's passage by at most ``limit`` = ``rate`` times n edits. It is cut into limit + 1 segments of equal
length. An edit falls into one segment at most, so wherever the item occurs within its limit, some segment stands there
word for word. Runs of words of the segments' lengths, hashed at every word of a document, are looked up among the
segments; a run that is found says where the item would lie, give or take the limit. No occurrence within the limit is
left out, whatever the item's length. At the default rate segments have five to nine words; an item below ten words has the
limit 0 and is one segment, which is found word for word.

Every candidate is verified: the word edit distance between the whole item and the best part of the document around the
run, which must not exceed the limit. Candidates of an item that lie close together are verified at once, and given up
when no part can come within the limit any more. Items are sent to the tasks in blocks of bounded bytes, and all
documents are compared with every block.

Defined results: a null or empty text has no matches; an item of fewer than ``min_words`` words is never searched, nor is
a null one; items with equal words match alike; of several places in a document the one with the smallest distance
counts, the first of them on ties; repeated rows are judged one by one. Extra columns stay.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paywatch.llm import tokens

RATE = 0.1
MIN_WORDS = 1
#: Words of a segment that are hashed, from its first.
SEGMENT_WORDS = 16
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 2 << 20
TABLE_BITS = 18
#: Run and segment pairs taken at a time; cells of the distance table's rows held at a time; its rows between two looks at the limit.
PAIRS = 1 << 20
CELLS = 1 << 18
LOOK = 32
#: Stands between texts; no item has it.
END = np.uint64(1)
SEPARATORS = tuple(sorted({*tokens.WHITE_BYTES, *tokens.punctuation()}))
FOUND = "array<struct<item: long, start: long, distance: long>>"


def sequence(column):
    """Words of all texts with an END after each, and where each text starts."""
    raw, offsets = tokens.flat(column)
    numbers, counts = tokens.words(raw, offsets, lower=True, separators=SEPARATORS)
    start = np.cumsum(counts) - counts + np.arange(len(counts))
    out = np.full(len(numbers) + len(counts), END, dtype=np.uint64)
    at = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(len(numbers))
    out[at] = np.maximum(numbers, np.uint64(2))
    return out, start, counts


def runs(words, longest):
    """Keys of the runs of 1, 2, ... ``longest`` words that start at each word."""
    keys = np.zeros(len(words), dtype=np.uint64)
    for length in range(1, min(longest, len(words)) + 1):
        with np.errstate(over="ignore"):
            keys = tokens.mix(keys[:len(words) - length + 1] * np.uint64(0x9E3779B97F4A7C15) + words[length - 1:])
        yield length, keys


def slots(keys):
    return (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Items:
    """A block of items, ready to search; what the tasks receive."""

    def __init__(self, ids, texts, rate=RATE, min_words=MIN_WORDS):
        if not 0 <= rate < 1:
            raise ValueError("rate must be at least 0 and below 1")
        words, start, counts = sequence(pa.array(texts, pa.large_string()))
        use = counts >= max(1, min_words)
        self.ids = np.asarray(ids, dtype=object)[use]
        self.words, self.start, self.counts = words, start[use], counts[use]
        self.limit = np.floor(self.counts * rate).astype(np.int64)
        #: Per run length: a table of the segments' slots, their keys in order, and item and offset of each.
        self.segments = {}
        parts = self.limit + 1
        item = np.repeat(np.arange(len(parts)), parts)
        number = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        offset = number * self.counts[item] // parts[item]
        size = np.minimum(self.counts // parts, SEGMENT_WORDS)[item]
        for length, keys in runs(words, int(size.max(initial=0))):
            of = np.flatnonzero(size == length)
            if len(of):
                own = keys[self.start[item[of]] + offset[of]]
                sieve = np.zeros(1 << TABLE_BITS, dtype=bool)
                sieve[slots(own)] = True
                order = np.argsort(own, kind="stable")
                self.segments[length] = sieve, own[order], item[of][order], offset[of][order]


def distances(items, words, low, high, which, limit=None):
    """Edit distance of item ``which`` to the best part of words[low:high], and where that part ends; all one length.

    With a ``limit``, rows that are above it for good are given up, with limit + 1 as their distance.
    """
    length, width = int(items.counts[which[0]]), int((high - low).max())
    column = low[:, None] + np.arange(width)
    region = np.where(column < high[:, None], words[np.minimum(column, len(words) - 1)], END)
    ramp = np.arange(width + 1)
    row = np.zeros((len(which), width + 1), dtype=np.int32)
    alive = np.arange(len(which))
    for i in range(length):
        symbol = items.words[items.start[which[alive]] + i][:, None]
        step = np.empty_like(row)
        step[:, 0] = i + 1
        np.minimum(row[:, :-1] + (region != symbol), row[:, 1:] + 1, out=step[:, 1:])
        row = np.minimum.accumulate(step - ramp, axis=1) + ramp
        if limit is not None and i % LOOK == LOOK - 1:
            near = row.min(1) <= limit
            if not near.all():
                alive, row, region = alive[near], row[near], region[near]
                if not len(alive):
                    break
    distance, end = np.full(len(which), 0 if limit is None else limit + 1, dtype=np.int64), low.copy()
    best = row.argmin(1)
    distance[alive] = row[np.arange(len(alive)), best]
    end[alive] += best
    return distance, end


def candidates(items, words, start, counts):
    """Regions to verify: (text, item, first word, word after the last), each pair of text and item as often as it needs."""
    out = [np.zeros((0, 3), dtype=np.int64)]
    for length, found in runs(words, max(items.segments, default=0)):
        if length not in items.segments:
            continue
        sieve, keys, members, offsets = items.segments[length]
        at = np.flatnonzero(sieve[slots(found)])
        left, right = np.searchsorted(keys, found[at]), np.searchsorted(keys, found[at], side="right")
        at, left, many = at[right > left], left[right > left], (right - left)[right > left]
        upto = np.cumsum(many)
        cuts = np.unique([0, *np.searchsorted(upto, np.arange(PAIRS, upto[-1] if len(upto) else 0, PAIRS)), len(at)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            each = many[a:b]
            segment = np.repeat(left[a:b] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            which = members[segment]
            place = np.repeat(at[a:b], each) - offsets[segment]
            # The run's own text: the place may lie before it, if the text begins inside the item.
            text = np.repeat(np.searchsorted(start, at[a:b], side="right") - 1, each)
            out.append(np.unique(np.stack([text, which, place // (items.counts[which] // 4 + 1)], 1), axis=0))
    text, which, lot = np.unique(np.concatenate(out), axis=0).T
    step, limit = items.counts[which] // 4 + 1, items.limit[which]
    low = np.maximum(lot * step - limit, start[text])
    high = np.minimum(lot * step + step + items.counts[which] + limit, start[text] + counts[text])
    return text, which, low, high


def search(items, column):
    """Matches of each text: (text, item, first word of the part that matches, distance)."""
    words, start, counts = sequence(column)
    text, which, low, high = candidates(items, words, start, counts)
    limit, length = items.limit[which], items.counts[which]
    out = []
    for size in np.unique(length):
        of = np.flatnonzero((length == size) & (high > low))
        rows = int(max(1, CELLS // (2 * size + 1)))
        for a in range(0, len(of), rows):
            part = of[a:a + rows]
            distance, end = distances(items, words, low[part], high[part], which[part], int(limit[part[0]]))
            good = distance <= limit[part]
            first = np.maximum(end[good] - size - start[text[part][good]], 0)
            out.append(np.stack([text[part][good], which[part][good], first, distance[good]], 1))
    found = np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)
    found = found[np.lexsort((found[:, 2], found[:, 3], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def _pieces(column):
    """Runs of texts of about CHUNK_BYTES."""
    raw, offsets = tokens.flat(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES)) - 1)
        yield a, column.slice(a, b - a)
        a = b


def blocks(items, text="text", key="item_id", block_bytes=BLOCK_BYTES, **options):
    """The items as searchable blocks of bounded size, one after another."""
    known = items.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = max(1, -(-int(total) // block_bytes))
    for lot in range(lots):
        rows = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(lots)) == lot).orderBy("id", "text").collect()
        block = Items([r.id for r in rows], [r.text for r in rows], **options)
        if block.segments:
            yield block


def _searcher(spark, block):
    shared = spark.sparkContext.broadcast(block)

    @F.arrow_udf(FOUND)
    def look(texts: pa.Array) -> pa.Array:
        items = shared.value
        out = [[] for _ in range(len(texts))]
        for a, piece in _pieces(texts):
            for text, item, first, distance in search(items, piece):
                out[a + text].append({"item": items.ids[item], "start": int(first), "distance": int(distance)})
        return pa.array(out, pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("distance", pa.int64())])))

    return look.asNondeterministic()


def matched(docs, items, text="text", item_text="text", item_key="item_id", result="leaks", **options):
    """``docs`` with ``result``: an array of (item, start, distance)."""
    out = docs.withColumn(result, F.array().cast(FOUND))
    for block in blocks(items, item_text, item_key, **options):
        out = out.withColumn("__leak_block", _searcher(docs.sparkSession, block)(F.col(text)))
        out = out.withColumn(result, F.concat(result, "__leak_block")).drop("__leak_block")
    return out


def clean(docs, items, **options):
    """The documents in which no item is found."""
    return matched(docs, items, result="__leaks", **options).where(F.size("__leaks") == 0).drop("__leaks")
