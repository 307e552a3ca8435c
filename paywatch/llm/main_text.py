"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events; nothing of the page is kept but its lines. A line is the text
between two block boundaries. Its text-to-tag ratio is its length over the number of tags met since the line before.
The ratios along the page are smoothed with a Gaussian, and a threshold, the standard deviation of the smoothed ratios,
parts lines into content and the rest.

Single short lines of an article have low ratios, and an advert's sentence has a high one, so the threshold selects
regions, not lines. A region is the innermost enclosing ``article`` or ``main``, else the innermost block that holds the
line directly. A region with content lines is kept whole, without what its markup says is no text of the article:
menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments. Inside an
``article`` or ``main`` a class or id says so only if it is such a word as a whole or a compound of such words and usual
additions (share-buttons, but not share-price). Ids there are mostly made from headings: those of headings say nothing, and
other parts marked by an id alone, but for comments and adverts, are dropped only if none of their lines has the ratio of
content. Where regions are
nested or follow one another, all with content are kept, in page order. If an ``article`` or ``main`` has content, other
regions count as surroundings.

Defined results: a null or empty page, and one without any text, has the empty text; character references are decoded;
white space inside a block becomes one space; broken and unclosed markup is read as the parser reads it, and an
unclosed menu or advert ends where an article begins; pages are read one by one, so repeated rows do not matter. Extra
columns stay.
"""

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIGMA = 1.0
RADIUS = 2

#: Elements without text of the article.
SKIPPED = frozenset(
    "head title script style noscript template svg annotation annotation-xml canvas object iframe audio video nav footer aside form button select textarea "
    "option menu dialog datalist map".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img "
    # Parts of a formula.
    "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mstyle mpadded "
    "menclose merror semantics".split()
)
CONTAINER = frozenset("body article main section div td th center blockquote fieldset details figure".split())
MAIN = frozenset(("article", "main"))
#: Words of a class or id that mark surroundings.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored promo promos promotion nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidebars side aside widget widgets footer footers foot masthead topbar cookie cookies consent gdpr notice "
    "notices alert popup modal overlay comment comments disqus respond reply replies discussion share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login form toolbar pagination pager skip header headers".split()
)
#: Marks that an article's own parts may carry.
WITHIN = frozenset(("header", "headers"))
#: Marks of surroundings that hold articles of other writers.
READERS = frozenset("comment comments disqus respond reply replies discussion related recommended recommendations".split())
#: Marks that hold for an id inside an article, where most ids are made from headings; the second ones not on a section.
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements sponsored sidebar sidebars".split())
#: Words that make a compound with a mark, as in share-buttons.
ADDITIONS = frozenset(
    "area article articles author b bar block blocks body bottom box button buttons c container content count div entry entries fixed "
    "google gpt group holder icon icons inline inner item items js l label left link links list main media middle mobile module o outer "
    "page pages panel placeholder post posts reader readers right row section site slot story stories tag text thread title toggle top "
    "unit user users wp wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: First words that tell of a part elsewhere, as in has-sidebar.
ABOUT = frozenset("has with no without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)


def class_words(value):
    """Words of a class or id that may mark surroundings."""
    out = set()
    for token in value.split():
        words = PART.findall(CAMEL.sub(" ", token).lower())
        if words and words[0] not in ABOUT:
            out.update(words)
    return out


def whole_marks(value):
    """Marks of a class or id whose words are all marks or additions to one."""
    out = set()
    for token in value.split():
        words = PART.findall(CAMEL.sub(" ", token).lower())
        if words and words[0] not in ABOUT and all(w in MARKS or w in ADDITIONS for w in words):
            out.update(words)
    return (out & MARKS) - WITHIN


class Lines(HTMLParser):
    """Collects (text, tags, region, skipped, doubt) of every line of a page.

    ``doubt`` numbers the part of an article around the line that an id alone marks, 0 for none.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.part, self.tags = [], [], 0
        self.stack = []  # (tag, skipped, region, doubt)
        self.skipped, self.region, self.regions = 0, (0, False), 0
        self.doubt, self.doubts = 0, 0

    def end_line(self):
        if self.part:
            text = " ".join("".join(self.part).split())
            self.part = []
            if text:
                self.lines.append((text, max(1, self.tags), self.region, self.skipped, self.doubt))
                self.tags = 0

    def marked(self, tag, attributes, inside_main):
        """0: text; 1: surroundings; 2: surroundings that may hold articles of their own; -1: surroundings if without content."""
        if tag in SKIPPED:
            return 1
        if tag == "header":
            return int(not inside_main)
        doubt = 0
        for name, value in attributes:
            if name in ("class", "id") and value and tag not in ("body", "html") and not (name == "id" and tag in HEADINGS):
                words = whole_marks(value) if inside_main or tag in MAIN else class_words(value) & MARKS
                if tag in MAIN:
                    words &= COMMENTS if name == "id" else READERS
                elif inside_main and name == "id" and words and not words & (COMMENTS if tag == "section" else COMMENTS | ADVERTS):
                    doubt, words = -1, ()
                if words:
                    return 2 if words & READERS else 1
            elif name == "role" and value and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return 1
            elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return 1
        return doubt

    def handle_starttag(self, tag, attributes):
        self.tags += 1
        if tag == "br":
            self.part.append(" ")
            return
        if tag in INLINE:
            if not attributes or tag in VOID:
                return
        else:
            self.end_line()
        if tag in VOID:
            return
        if tag in CLOSES_P and self.stack and self.stack[-1][0] == "p":
            self.pop()
        elif tag == "li" and any(t == "li" for t, *_ in self.stack[-1:]):
            self.pop()
        if tag in MAIN and self.skipped == 1 and not self.region[1]:
            # The menu or advert around it was not closed.
            while self.skipped:
                self.pop()
        skip = self.skipped or self.marked(tag, attributes, self.region[1])
        if tag in INLINE:
            if not skip:
                return
            self.end_line()
        self.stack.append((tag, self.skipped, self.region, self.doubt))
        if skip == -1:
            if not self.doubt:
                self.doubts += 1
                self.doubt = self.doubts
            skip = 0
        self.skipped = skip
        if tag in MAIN and not skip:
            self.regions += 1
            self.region = (self.regions, True)
        elif tag in CONTAINER and not self.region[1]:
            self.regions += 1
            self.region = (self.regions, False)

    def pop(self):
        _, self.skipped, self.region, self.doubt = self.stack.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in INLINE and not any(t == tag for t, *_ in self.stack):
            return
        self.end_line()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                while len(self.stack) > depth:
                    self.pop()
                return

    def handle_data(self, data):
        self.part.append(data)


def smoothed(ratios, sigma=SIGMA, radius=RADIUS):
    """Gaussian smoothing; at the ends the weights inside the page are scaled to one."""
    weights = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma**2))
    return np.convolve(ratios, weights, "same")[:len(ratios)] / np.convolve(np.ones(len(ratios)), weights, "same")[:len(ratios)]


def main_text(html):
    """The main text of one page."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    ratios = np.array([0.0 if skipped else len(text) / tags for text, tags, _, skipped, _ in lines])
    own = ratios
    if len(ratios) < 2 * RADIUS + 1:
        ratios = np.pad(ratios, (0, 2 * RADIUS + 1 - len(ratios)))
    level = smoothed(ratios)[:len(lines)]
    threshold = min(level.std(), level.max())
    sure = {0, *(doubt for (*_, skipped, doubt), ratio in zip(lines, own, strict=True) if not skipped and ratio >= threshold)}
    lines = [(text, region, skipped or doubt not in sure) for text, _, region, skipped, doubt in lines]
    kept = {region for (_, region, skipped), good in zip(lines, level >= threshold, strict=True) if good and not skipped}
    if any(main for _, main in kept):
        kept = {region for region in kept if region[1]}
    return " ".join(text for text, region, skipped in lines if region in kept and not skipped)


@F.arrow_udf(StringType())
def extracted(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(page.as_py()) for page in pages], pa.string())


def extract(pages, html="html", result="main_text"):
    """``pages`` with ``result``; a column of that name is replaced."""
    return pages.withColumn(result, extracted.asNondeterministic()(F.col(html)))
