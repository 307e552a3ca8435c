"""Word numbers, language ID, n-gram scores, personal data and main text against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paywatch.llm import language, main_text, ngrams, pii, tokens
from paywatch.llm.common import remainder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "a", " Über straße\tÉ\x0bx\x00y \n", "x" * 3_000_000, "b c d", "tail "]


def test_words_and_runs_in_small_chunks(monkeypatch):
    for chunk in (16, 1 << 20):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        raw, offsets = tokens.flat(pa.array([*ODD[:5], "y" * 500, *ODD[6:]] if chunk == 16 else ODD))
        numbers, counts = tokens.words(raw, offsets)
        texts = [t or "" for t in ([*ODD[:5], "y" * 500, *ODD[6:]] if chunk == 16 else ODD)]
        plain = [WORDS.findall(t.translate(LOWER)) for t in texts]
        assert counts.tolist() == [len(w) for w in plain]
        known = {}
        for word, number in zip((w for ws in plain for w in ws), numbers.tolist(), strict=True):
            assert known.setdefault(word, number) == number
        assert len(set(known.values())) == len(known)
    sliced = pa.array(["zero", *ODD[:5]]).slice(1)
    assert tokens.words(*tokens.flat(sliced))[1].tolist() == counts.tolist()[:5]
    runs, sizes = tokens.windows(*tokens.words(*tokens.flat(pa.array(["a b c d e f", "a b", "", "b c d e f"]))), 5)
    assert sizes.tolist() == [2, 1, 0, 1] and runs[1] == runs[3] and len(set(runs.tolist())) == 3


def ppm_bits(texts, text, order=3, min_count=1):
    """Code length by following escapes one by one, with exclusion."""
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        data = t.encode()
        for k, byte in enumerate(data):
            for o in range(min(order, k) + 1):
                seen[data[k - o:k]][byte] += 1
    seen = {c: n for c, n in seen.items() if len(c) < 2 or sum(n.values()) >= min_count}
    bits, data = 0.0, text.encode()
    for k, byte in enumerate(data):
        excluded, p = set(), 1.0
        for o in range(min(order, k), -1, -1):
            counts = seen.get(data[k - o:k])
            if counts is None:
                continue
            left = {b: n for b, n in counts.items() if b not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if byte in left:
                p *= left[byte] / total
                break
            p *= len(left) / total
            excluded |= set(left)
        else:
            p /= 256 - len(excluded)
        bits -= math.log2(p)
    return bits


def labelled(spark):
    rng = random.Random(1)
    parts = {"xx": ["the", "ing", "er", "th", "on"], "yy": ["lich", "sch", "ü", "ung", "der"]}
    rows = []
    for n in range(120):
        lang = "xx" if n % 2 else "yy"
        rows.append((n, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(30)), lang, "doc"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")


def test_language_code_lengths_are_exact(spark):
    docs = labelled(spark)
    model = language.fit(docs, min_count=3)
    rows = docs.collect()
    probes = [rows[0].text, rows[1].text, "thing 7 schön!", "é", "q", "thththth" * 20_000]
    raw, offsets = tokens.flat(pa.array(probes))
    bits = language.code_lengths(model, raw, offsets)
    for k, probe in enumerate(probes[:5]):
        for which, lang in enumerate(model.languages):
            want = ppm_bits([r.text for r in rows if r.lang == lang], probe, min_count=3)
            assert bits[k, which] == pytest.approx(want, rel=1e-5)
    judged = language.predicted(docs, model)
    assert judged.columns == docs.columns
    assert all(r.language.lang == r.lang and 0.5 < r.language.score <= 1 for r in judged.collect())


def test_language_of_odd_texts(spark):
    model = language.fit(labelled(spark))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "123 !!", "ü", "th" * 700_000])], "doc_id long, text string")
    got = [(r.language.lang, r.language.score) for r in language.predicted(docs, model).orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] == "yy" and got[4] == ("xx", 1.0)
    empty = language.fit(labelled(spark).limit(0))
    assert {r.language.lang for r in language.predicted(docs, empty).collect()} == {"und"}
    assert language.predicted(docs.limit(0), model).count() == 0


def test_bounded_tree(spark):
    small = language.fit(labelled(spark), max_contexts=20)
    assert len(small.cost) // (small.kind.max() + 1) <= 1 + 30 + 20
    assert {r.language.lang for r in language.predicted(labelled(spark), small).where("lang = 'xx'").collect()} == {"xx"}


def test_labels_with_few_texts_keep_their_trees():
    rng = random.Random(12)
    rows = []
    for lang, texts in {"common": 400, "rare": 8}.items():
        # The two differ in their pairs and triples of letters only.
        own = ["abc", "bca", "cab"] if lang == "common" else ["acb", "bac", "cba"]
        seen = collections.Counter()
        for _ in range(texts):
            data = (rng.choice(own) * 8 + "".join(rng.choices("abcdefgh", k=40))).encode()
            for order in range(4):
                for k in range(order, len(data)):
                    seen[order, sum((b + 1) << (9 * n) for n, b in enumerate(reversed(data[k - order:k]))), data[k]] += 1
        total = collections.Counter()
        for (order, context, _), n in seen.items():
            total[order, context] += n
        rows += [(lang, order, context, byte, n, total[order, context]) for (order, context, byte), n in seen.items()]
    counts = pd.DataFrame(rows, columns=["lang", "seen_in", "context", "byte", "n", "total"])
    for most in (10, 100):
        got = language.bounded(counts, most)
        for lang, own in got[got.seen_in > 1].groupby("lang"):
            all_ = counts[(counts.lang == lang) & (counts.seen_in > 1)].drop_duplicates(["seen_in", "context"])
            left = own.drop_duplicates(["seen_in", "context"])
            assert len(left) == min(most, len(all_)) and sorted(left.total) == sorted(all_.total)[-len(left):]
        assert set(got[got.seen_in > 1].lang) == {"common", "rare"}
        assert len(got[got.seen_in < 2]) == len(counts[counts.seen_in < 2])
    model = language.tables(counts, max_contexts=100)
    raw, offsets = tokens.flat(pa.array(["acbacbacbacb", "abcabcabcabc"]))
    bits = language.code_lengths(model, raw, offsets)
    assert [model.languages[k] for k in bits.argmin(1)] == ["rare", "common"]
    assert language.bounded(counts, 10_000) is counts


def test_scores_against_plain_counts(spark):
    rng = random.Random(4)
    vocabulary = [f"W{k}" for k in range(60)]
    rows = []
    for n in range(150):
        walk = [rng.choice(vocabulary)]
        for _ in range(rng.randint(0, 60)):
            walk.append(vocabulary[(vocabulary.index(walk[-1]) * 7 + rng.randint(0, 3)) % 60])
        rows.append((n, " ".join(walk), "t"))
    rows += [(1000, None, "t"), (1001, "", "t"), (1002, "unknown words here", "t"), (None, "w1 w2", "t"), (5, rows[5][1], "t"), (1003, "w1 " * 30_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string").repartition(4)
    got = ngrams.score(docs, remainder("doc_id", 7) == 2, block_bytes=4000, shards=5).collect()
    assert len(got) == len(rows)

    tokens_of = lambda t: WORDS.findall((t or "").translate(LOWER)) + [None]
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 7 == 2
    one, two = collections.Counter(), collections.Counter()
    for k, t, _ in rows:
        if not held(k):
            words = tokens_of(t)
            one.update(words)
            two.update(zip([None, *words], words))
    total, known = sum(one.values()), len(one)
    # The grid of held-out counts, then the same expectation-maximisation over it.
    cells = collections.Counter()
    for k, t, _ in rows:
        if not held(k):
            words = tokens_of(t)
            for a, b in zip([None, *words], words):
                args = [np.array([x]) for x in (two[a, b] - 1, one[a] - 1, one[b] - 1)]
                first, second = ngrams.estimates(*args, total - 1, known)
                cells[int((ngrams.bucket(args[1]) * ngrams.REACH + ngrams.grid_step(first))[0] * ngrams.REACH + ngrams.grid_step(second)[0])] += 1
    mixture = ngrams.weights(np.array(list(cells)), np.array(list(cells.values()), float))
    assert np.allclose(mixture.sum(1), 1) and (mixture[:, 2] > 0).all()
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc].append(r)
    better = [0.0, 0.0]
    for k, t, _ in rows:
        words, r = tokens_of(t), by_id[k][0]
        assert (r.held, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(words), sum(one[w] > 0 for w in words), total)
        assert r.base == pytest.approx(sum(math.log10((one[w] + 1) / (total + known + 1)) for w in words))
        want = 0.0
        for a, b in zip([None, *words], words):
            part = mixture[int(ngrams.bucket(np.array([one[a]]))[0])]
            pair = two[a, b] / one[a] if one[a] else 0.0
            want += math.log10(part[0] * pair + part[1] * one[b] / total + part[2] / (known + 1))
        assert r.score == pytest.approx(want)
        if held(k):
            better[0] += r.base
            better[1] += r.score
    assert better[1] > better[0] + 100


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 50, 30)
    pairs = rng.multinomial(7, np.ones(30) / 30)
    mixture = ngrams.weights(np.array([3 * ngrams.REACH**2 + 300 * ngrams.REACH + 280]), np.array([5.0]))
    part = mixture[ngrams.bucket(np.array([7]))[0]]
    first, second = ngrams.estimates(pairs, np.full(30, 7), words, words.sum(), 30)
    chance = (part[0] * first + part[1] * second + part[2]) / 31
    assert chance.sum() + part[2] / 31 == pytest.approx(1)


def test_scores_of_nothing(spark):
    docs = spark.createDataFrame([(3, "a b")], "doc_id long, text string")
    assert ngrams.score(docs.limit(0), F.lit(False)).count() == 0
    row = ngrams.score(docs, F.lit(True)).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.score == pytest.approx(0.0) and row.base == pytest.approx(0.0)


BASE = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda t: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda t: all(int(p) <= 255 for p in t.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda t: 14 <= sum(map(str.isdigit, t)) <= 19 and luhn(re.sub(r"\D", "", t))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda t: 10 <= sum(map(str.isdigit, t)) <= 15),
]


def luhn(text):
    odd, even = text[-1::-2], text[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def test_patterns_equal_plain_search():
    rng = random.Random(9)
    for n in range(30_000):
        text = "".join(rng.choice("aé.@-1 +2()905%\n") for _ in range(rng.randint(0, 45)))
        want = sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(BASE) for m in p.finditer(text) if good(m[0]))
        assert pii.patterns(text) == want, text


def test_field_learns_and_adds():
    field = pii.fit()
    rows = [pii.marked(line) for line in pii.LABELLED]
    base = [pii.patterns(t) for t, _ in rows]
    for (text, spans), b, more in zip(rows, base, pii.added(field, [t for t, _ in rows], base), strict=True):
        assert sorted(b + more) == sorted(spans), text
    # Forms like those of the table, with other numbers and words, and texts without personal data.
    probes = ["Please dial (415) 555-0123 or 415-555-0100 soon", "Tél. 415.555.0177\nno 12 of 400 on 2024-05-06, page 3-4", "plain words only", ""]
    found = pii.added(field, probes, [pii.patterns(t) for t in probes])
    texts = [[t[a:b] for a, _, b in spans] for t, spans in zip(probes, found, strict=True)]
    assert texts[0] == ["(415) 555-0123", "415-555-0100"] and texts[1] == ["415.555.0177"] and texts[2:] == [[], []]


def test_viterbi_equals_trying_all_paths():
    import itertools

    field = pii.fit()
    rng = random.Random(2)
    words = [["+1", "(988)", "555-0148"], ["12"], ["4111", "1111", "1111", "1111"], ["a@b.c", "1.2.3.4"], ["7", "+9"]]
    words += [[rng.choice(["12", "(3)", "5-6", "x@y", "1.1.1.1"]) for _ in range(4)] for _ in range(6)]
    at, size = field.features(words)
    score = field.emissions(at)
    for k, path in enumerate(field.decode(words)):
        def value(states):
            total = field.weights["first"][0, states[0]] + field.weights["last"][0, states[-1]] + sum(score[k, t, s] for t, s in enumerate(states))
            return total + sum(field.weights["move"][a, b] for a, b in itertools.pairwise(states))
        legal = [s for s in itertools.product(range(pii.STATES), repeat=len(words[k]))
                 if pii.STARTS[s[0]] and all(pii.ALLOWED[a, b] for a, b in itertools.pairwise(s))]
        assert value(tuple(path)) == pytest.approx(max(map(value, legal)))


def test_personal_data_of_odd_texts(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "é a@b.cd é", 0), (3, "é a@b.cd é", 0), (4, "x" * 500_000 + " 10.0.0.1 " + "1" * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii int")
    got = sorted((r.doc_id, [tuple(s) for s in r.pii]) for r in pii.found(docs).collect())
    assert got == [(1, []), (2, []), (3, [(2, 0, 8, False)]), (3, [(2, 0, 8, False)]), (4, [(500_001, 1, 500_009, False)])]
    assert pii.found(docs.limit(0)).count() == 0


def test_personal_data_query_counts_each_kind(spark, tmp_path):
    import hashlib

    from paywatch.llm.pii_query import personal_data

    rng = random.Random(4)
    parts = ["a@b.cd", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (415) 555-0123", "+12", "é\U0001f600", "word\n", "(415) 555-0123"]
    rows = [(1, None), (2, ""), (3, "no"), (4, "a@b.cd b@c.de 1.2.3.4 4111111111111111 +14155550123 +14155550124")]
    rows += [(k, " x ".join(rng.choices(parts, k=rng.randint(1, 8)))) for k in range(5, 60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in personal_data(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        want = sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(BASE) for m in p.finditer(text or "") if good(m[0]))
        row = got[key]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in want) for k in range(4)], text
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text


ARTICLE = (
    "<h1>Title here</h1><p>First paragraph of the article, long enough &amp; more.</p><p>Short.</p><p>Another <b>bo</b>ld paragraph"
    " with<br>many\n  words that make up the body, quite long.</p>"
)
TEXT = "Title here First paragraph of the article, long enough & more. Short. Another bold paragraph with many words that make up the body, quite long."


@pytest.mark.parametrize("page", [
    "<html><head><title>No</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>No</a><li><a>No</a></ul></nav>"
    "<div class='ad'>Buy this very nice thing that you want to have today.</div><article>%s</article><footer>No &copy;</footer></body></html>",
    "<body><header><h2>Site</h2></header><div id=content>%s</div><div class='comments'><p>I like this article, says a reader with very many words.</p></div></body>",
    "<div class=wrapper><div class='sidebar left'><ul><li><a>One</a><li><a>Two</a></ul></div><main>%s</main></div>",
    "<div id='cookie-notice'>We use cookies to make this site work better, please accept.</div><article>%s<section class=comments><article><p>A reader"
    " says hi at some length, with more words.</p></article></section></article><form>Subscribe <input><button>Go</button></form>",
    "<nav><ul><li>a<li>b<article>%s</article>", "<table><tr><td>%s</td></tr></table>", "<div class='post has-sidebar'>%s</div><aside>No no</aside>",
    "<article><header class='post-header'></header>%s<div class='ad'>Buy now, it is cheap and very good for you.</div></article>",
    "<article>%s<!-- no --><template><p>no</p></template><p hidden>no</p></article>",
])
def test_main_text(page):
    assert main_text.main_text(page % ARTICLE) == TEXT


LONG = "A long line of the article's own text, which goes on for many words and has no tags at all inside it, as paragraphs do."


@pytest.mark.parametrize("part, text", [
    (f"<section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section>", f"Discussion {LONG}"),
    (f"<section id='pagination'><p>{LONG}</p><ul class='pager'><li><a>2</a></ul></section>", LONG),
    ("<h2 id='related-work'>Related work</h2>", "Related work"), ("<h2 id='social-impact'>Social impact</h2>", "Social impact"),
    ("<h3 id=comments>Comments on this</h3>", "Comments on this"), ("<h2 id='alert-levels'>Alert levels</h2>", "Alert levels"),
    (f"<section id='notice-period'><p>{LONG}</p></section>", LONG), (f"<p class='side-effects'>{LONG}</p>", LONG),
    (f"<div class='side-by-side'><p>{LONG}</p></div>", LONG), ("<p>The <a class='share-price' href=x>price</a> rose.</p>", "The price rose."),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, say.</p>", "Let x=1, say."),
    ("<div class='share-buttons'><a>Tell all of your friends about this article now</a></div>", ""), ("<div class='post-sidebar'>No</div>", ""),
    (f"<section id='comments'><article><p>{LONG}</p></article></section>", ""), (f"<div id='ad-slot-1'>{LONG}</div>", ""),
    ("<div id='share'><ul><li><a href=x><b>Mail</b></a><li><a href=x><b>Print</b></a></ul></div>", ""),
    (f"<div class='related-posts'><article><p>{LONG}</p></article></div>", ""), (f"<p id='x' class='sponsored'>{LONG}</p>", ""),
])
def test_main_text_keeps_parts_with_ids_and_classes_of_their_own(part, text):
    for tag in ("article", "main"):
        got = main_text.main_text(f"<nav><a>No</a></nav><{tag}>{ARTICLE}{part}<p>{LONG}</p></{tag}>")
        assert got == " ".join(t for t in (TEXT, text, LONG) if t)


def test_main_text_of_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "no tags &lt; at all"), (4, "<p></p><br>"), (5, "<nav>only</nav>"), (6, "<article>" + "<p>word word</p>" * 20_000), (7, "<p>a<p>b</ul></div>&#x41;")]
    pages = spark.createDataFrame([(k, h, "x") for k, h in rows], "page_id long, html string, main_text string")
    got = {r.page_id: r.main_text for r in main_text.extract(pages).collect()}
    assert got[1] == got[2] == got[4] == got[5] == "" and got[3] == "no tags < at all" and got[7] == "a b A"
    assert got[6] == " ".join(["word word"] * 20_000)
    assert main_text.extract(pages.limit(0)).count() == 0
