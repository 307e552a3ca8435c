"""Personal data: fixed patterns, and spans added by a conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers; each kind is searched by itself, leftmost
matches without overlaps, and a match that fails its check (range, Luhn, number of digits) is dropped.

The linear-chain conditional random field labels the words of a line by their shapes: runs of letters are one sign, runs
of digits their length, all else stands for itself. Features are the word's shape, its coarse class and those of the
words beside it; a word without a digit or @ is outside by definition, so a line falls into independent runs of words
that have one. It is trained on a small labelled table (``pii_labels``, or any table of text and spans given to ``fit``)
by gradient ascent on the likelihood, and decoded by Viterbi over all runs of a batch at once. A span that it finds is
trimmed to the characters its kind may begin and end with, must pass the kind's check, and is added where it overlaps no
pattern's span: phone numbers without a plus sign and cards with unusual separators.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive; texts are read whole and one
by one, so repeated rows do not matter. Extra columns stay.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paywatch.llm.pii_labels import LABELLED

KINDS = ("email", "ip", "card", "phone")
#: Most labelled rows that are trained on.
LABELLED_ROWS = 1000
STATES = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
ROUNDS = 200
PENALTY = 1e-3
NEVER = -1e9

EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits has one possible start and end in an address, so nothing has to be tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNS = re.compile(r"[0-9@]")
REST = re.compile(r"[^\x20\x09-\x0D]*")
WHITE = frozenset(" \t\n\x0b\x0c\r")
RUNS = re.compile(r"[0-9]+|[^\W0-9_]+")
MARK = re.compile(r"\[(email|ip|card|phone)\|([^\]]*)\]")


def digits(text):
    return [int(c) for c in text if "0" <= c <= "9"]


def luhn(numbers):
    total = 0
    for k, n in enumerate(reversed(numbers)):
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def valid_ip(text):
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def valid_card(text):
    numbers = digits(text)
    return 14 <= len(numbers) <= 19 and luhn(numbers)


def emails(text):
    """Leftmost addresses: from each @ back over the name's characters, not beyond the address before."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_NAME:
            start -= 1
        host = EMAIL_HOST.match(text, at) if start < at else None
        if host:
            yield start, host.end()
            last = host.end()
        at = text.find("@", max(at + 1, last))


def patterns(text):
    """(start, number of the kind, end) of all spans that the patterns find, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if valid_ip(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if valid_card(m[0])]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


def shape(word):
    """Runs of letters as one a, runs of digits as their length, and everything else."""
    return RUNS.sub(lambda m: f"<{min(len(m[0]), 20)}>" if "0" <= m[0][0] <= "9" else "a", word)[:64]


def coarse(word):
    """0: no neighbour; 1 to 8: what kinds of characters the word has."""
    if "@" in word:
        return 1
    if any(c.isalpha() for c in word):
        return 2
    n = len(digits(word))
    if word.startswith("+"):
        return 3
    if "(" in word:
        return 4
    if "." in word.strip(".,"):
        return 5
    if "-" in word:
        return 6
    return 7 if n >= 5 else 8


CLASSES = 9


def runs(text):
    """Runs of neighbouring words of a line that have a digit or @: lists of (start, end)."""
    out, last, at = [], -1, SIGNS.search(text)
    while at:
        start = at.start()
        while start > 0 and text[start - 1] not in WHITE:
            start -= 1
        end = REST.match(text, at.start()).end()
        between = text[last:start] if last >= 0 else "\n"
        if last >= 0 and not between.strip(" \t"):
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
        last, at = end, SIGNS.search(text, end)
    return out


class Field:
    """Weights of the conditional random field."""

    def __init__(self, shapes):
        self.shapes = {s: k + 1 for k, s in enumerate(shapes)}  # 0: unknown
        rng = np.random.default_rng(0)
        self.weights = {
            "shape": np.zeros((len(self.shapes) + 1, STATES)), "own": np.zeros((CLASSES, STATES)), "before": np.zeros((CLASSES, STATES)),
            "after": np.zeros((CLASSES, STATES)), "move": rng.normal(0, 1e-3, (STATES, STATES)), "first": np.zeros((1, STATES)), "last": np.zeros((1, STATES)),
        }

    def features(self, words):
        """Numbers of the features of each word of each run, and the lengths; runs are padded to the longest."""
        size = np.array([len(w) for w in words])
        at = np.zeros((len(words), int(size.max()), 4), np.int64)
        for k, run in enumerate(words):
            classes = [coarse(w) for w in run]
            for t, word in enumerate(run):
                at[k, t] = (
                    self.shapes.get(shape(word), 0), classes[t], classes[t - 1] if t else 0, classes[t + 1] if t + 1 < len(run) else 0,
                )
        return at, size

    def emissions(self, at):
        w = self.weights
        return w["shape"][at[..., 0]] + w["own"][at[..., 1]] + w["before"][at[..., 2]] + w["after"][at[..., 3]]

    def decode(self, words):
        """The most likely states of each run, by Viterbi over all runs at once."""
        out = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for a in range(0, len(order), 512):
            part = order[a:a + 512]
            at, size = self.features([words[k] for k in part])
            score = self.emissions(at)
            move = np.where(ALLOWED, self.weights["move"], NEVER)
            best = score[:, 0] + self.weights["first"] + np.where(STARTS, 0, NEVER)
            back = np.zeros((len(part), int(size.max()), STATES), np.int64)
            final = np.where((size == 1)[:, None], best, 0.0)
            for t in range(1, int(size.max())):
                step = best[:, :, None] + move
                back[:, t] = step.argmax(1)
                best = step.max(1) + score[:, t]
                final = np.where((size == t + 1)[:, None], best, final)
            state = (final + self.weights["last"]).argmax(1)
            path = np.zeros((len(part), int(size.max())), np.int64)
            for t in reversed(range(int(size.max()))):
                path[:, t] = np.where(t < size, state, 0)
                state = np.where((t < size) & (t > 0), back[np.arange(len(part)), t, state], state)
            for k, row, n in zip(part, path, size, strict=True):
                out[k] = row[:n]
        return out

    def train(self, words, states, rounds=ROUNDS, penalty=PENALTY):
        """Gradient ascent on the penalized log-likelihood with steps scaled to each weight."""
        at, size = self.features(words)
        n, length = at.shape[:2]
        gold = np.zeros((n, length), np.int64)
        for k, s in enumerate(states):
            gold[k, :len(s)] = s
        inside = np.arange(length) < size[:, None]
        mean = {k: np.zeros_like(w) for k, w in self.weights.items()}
        square = {k: np.zeros_like(w) for k, w in self.weights.items()}
        for step in range(1, rounds + 1):
            gradient = self.gradient(at, size, gold, inside)
            for k, w in self.weights.items():
                g = gradient[k] - penalty * n * w
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                w += 0.1 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def gradient(self, at, size, gold, inside):
        score, w = self.emissions(at), self.weights
        n, length = gold.shape
        move = np.where(ALLOWED, w["move"], NEVER)
        ahead = np.full((n, length, STATES), NEVER)
        ahead[:, 0] = score[:, 0] + w["first"] + np.where(STARTS, 0, NEVER)
        for t in range(1, length):
            ahead[:, t] = _sum(ahead[:, t - 1][:, :, None] + move, 1) + score[:, t]
        behind = np.zeros((n, length, STATES))
        for t in reversed(range(length)):
            end = np.broadcast_to(w["last"], (n, STATES))
            if t + 1 < length:
                later = _sum(move[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
                end = np.where((t + 1 < size)[:, None], later, end)
            behind[:, t] = end
        total = _sum(ahead[:, 0] + behind[:, 0], 1)
        share = np.exp(ahead + behind - total[:, None, None]) * inside[..., None]
        truth = np.eye(STATES)[gold] * inside[..., None]
        left = truth - share
        out = {k: np.zeros_like(v) for k, v in w.items()}
        for f, name in enumerate(("shape", "own", "before", "after")):
            np.add.at(out[name], at[..., f].ravel(), left.reshape(-1, STATES))
        rows = np.arange(n)
        out["first"][0] = left[:, 0].sum(0)
        out["last"][0] = left[rows, size - 1].sum(0)
        for t in range(1, length):
            both = ahead[:, t - 1][:, :, None] + move + (score[:, t] + behind[:, t])[:, None, :] - total[:, None, None]
            expected = (np.exp(both) * inside[:, t][:, None, None]).sum(0)
            seen = np.zeros((STATES, STATES))
            np.add.at(seen, (gold[inside[:, t], t - 1], gold[inside[:, t], t]), 1)
            out["move"] += seen - expected
        out["move"] *= ALLOWED
        return out


def _sum(values, axis):
    top = values.max(axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis)) + np.squeeze(top, axis)


#: Inside follows begin or inside of its own kind only.
ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) and a > 0 for b in range(STATES)] for a in range(STATES)])
STARTS = np.array([b == 0 or b % 2 == 1 for b in range(STATES)])


def marked(line):
    """Text and spans of a line of the labelled table."""
    text, spans, at = "", [], 0
    for m in MARK.finditer(line):
        text += line[at:m.start()]
        spans.append((len(text), KINDS.index(m[1]), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


def fit(labelled=None, most=LABELLED_ROWS):
    """A field trained on (text, [(start, kind number, end)]) rows, ``most`` of them at most."""
    rows = [marked(line) for line in LABELLED] if labelled is None else list(labelled)[:most]
    words, states = [], []
    for text, spans in rows:
        for run in runs(text):
            words.append([text[a:b] for a, b in run])
            own = []
            for a, b in run:
                hit = next(((s, k, e) for s, k, e in spans if s < b and a < e), None)
                own.append(0 if hit is None else 1 + 2 * hit[1] + (hit[0] < a))
            states.append(own)
    shapes = sorted({shape(w) for run in words for w in run})
    return Field(shapes).train(words, states)


EDGES = {0: (r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"), 1: ("[0-9]", "[0-9]"), 2: ("[0-9]", "[0-9]"), 3: (r"[+(0-9]", "[0-9]")}
EDGES = {k: (re.compile(a), re.compile(b)) for k, (a, b) in EDGES.items()}


def passes(kind, text):
    if kind == 0:
        return next(emails(text), None) == (0, len(text))
    if kind == 1:
        return valid_ip(text)
    if kind == 2:
        return valid_card(text) and not re.search(r"[^0-9 .\-/]", text)
    return 10 <= len(digits(text)) <= 15 and not re.search(r"[^0-9 ().+\-/]", text)


def trimmed(kind, text, start, end):
    first, last = EDGES[kind]
    while start < end and not first.match(text[start]):
        start += 1
    while end > start and not last.match(text[end - 1]):
        end -= 1
    return start, end


def added(field, texts, base):
    """Spans of each text that the field finds beside those of the patterns."""
    out = [[] for _ in texts]
    where = [(n, run) for n, text in enumerate(texts) for run in (runs(text) if text else ())]
    if not where:
        return out
    paths = field.decode([[texts[n][a:b] for a, b in run] for n, run in where])
    for (n, run), path in zip(where, paths, strict=True):
        t = 0
        while t < len(path):
            if not path[t]:
                t += 1
                continue
            stop = t + 1
            while stop < len(path) and path[stop] == path[t] + 1:
                stop += 1
            kind = (int(path[t]) - 1) // 2
            start, end = trimmed(kind, texts[n], run[t][0], run[stop - 1][1])
            if passes(kind, texts[n][start:end]) and not any(s < end and start < e for s, _, e in base[n]):
                out[n].append((start, kind, end))
            t = stop
    return out


SPANS = "array<struct<start: long, kind: int, end: long, added: boolean>>"


def found(docs, field=None, text="text", result="pii"):
    """``docs`` with ``result``, which replaces a column of that name: all spans by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(field or fit())
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("added", pa.bool_())]))

    @F.arrow_udf(SPANS)
    def look(texts: pa.Array) -> pa.Array:
        able = pa.compute.fill_null(pa.compute.match_substring_regex(texts, "[0-9@]"), False).to_pylist()
        whole = [texts[k].as_py() if ok else "" for k, ok in enumerate(able)]
        base = [patterns(t) if t else [] for t in whole]
        more = added(shared.value, whole, base)
        return pa.array([
            [{"start": s, "kind": k, "end": e, "added": x} for s, k, e, x in sorted([(*b, False) for b in own] + [(*m, True) for m in new])]
            for own, new in zip(base, more, strict=True)
        ], kinds)

    return docs.withColumn(result, look.asNondeterministic()(F.col(text)))
