"""Main text of HTML pages by the maximum-scoring subsequence of their tokens.

Words score positive and tags negative, and one linear scan finds the run of tokens with the largest sum. The weights are
learned from labelled pages: pages whose author marked the content with an article or main element, out of `max_pages`
pages by id hash. The marks are no tokens, and names of classes and roles are not looked at in learning, so that pages
without any are judged by the same signs. These are a word's block: its element, its length, its share of words in links,
and the same of the blocks before and after it. A ridge-regularised logistic regression tells how much each sign takes from
a word's score; a tag's weight is its log odds of standing inside or outside the content.

How much an author's mark says is learned as well: the weights so far are applied to the labelled pages without regard
to marks, and the words inside, beside and (in a main element around articles) near the marks are counted inside and
outside the runs. Where a page has marks, those log odds raise or lower its words' scores. If no word is left above zero, the
signs of blocks are left out for that page.

The run's borders are the content's, but for what it starts and ends in the middle of: an article or main element that holds
the whole run is taken as a whole; without one, the innermost element around the run adds its blocks of a positive score,
unless it is the whole page. Parts that by element, role or class words are no content (menus, adverts, forms, comments
and the like) score less by a weight of their own and are left out of the result, as are scripts; and outside articles so is a
block with more than half its words in links if it stands outside the run, or if it is neither a heading nor a paragraph
and its list, table or other container has more than half its words in links as a whole.

Time and memory grow with the page's length, however its tags are nested or broken.

Edge cases: null or empty html, and a page without a run of positive sum, give an empty text; unclosed and stray tags are
taken as browsers mostly do; html without tags is one block; repeated rows get a row each; a null id or url is passed
through; `out` replaces a column of that name, and all other columns are passed through.
"""

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import hash_cutoff, one_by_one
from lexmill.storage import materialize

#: A tag ends before the next "<" outside quotes, so that unclosed ones cost no more than their length.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([A-Za-z][^\s/<>]*)((?>=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^<>])*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)

#: Element names by what they mean here.
RAW = {"script", "style", "textarea", "title", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE = set("a b i em strong span small code u s sup sub q cite time mark font abbr label kbd".split())
NEVER = set("head nav footer aside form dialog menu button select option datalist noscript template iframe object applet svg math canvas audio video map".split())
MARKS = {"main": 1, "article": 2}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
OPEN_PARAGRAPH = BLOCK - {"html", "body"}
LEAVES = set("p h1 h2 h3 h4 h5 h6 li ul ol dt dd dl pre blockquote".split()) | INLINE
CELLS = set("td th tr tbody thead table".split())
ALWAYS_SAID = set("h1 h2 h3 h4 h5 h6 p".split())
PARTS = set("li dt dd tr td th tbody thead tfoot caption".split())
WHOLE_PAGE = {"", "html", "body"}
#: Words of class and id attributes, and roles, of parts that aren't content.
NOT_CONTENT = set("ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted sidebar sidebars rail cookie cookies consent gdpr notice notices popup modal overlay lightbox newsletter subscribe subscription signup menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond discussion social share sharing sharebar related recommended recommendations widget widgets footer masthead toolbar topbar pagination pager login search skip hidden".split())
HEADS = {"header", "head", "site-header", "page-header", "top-header", "main-header", "global-header"}
ABOUT = {"has", "with", "no", "without"}  # a class such as has-sidebar says something about the content
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())

#: Kinds of words. A word in a link, or in a part that is no content, scores that kind's weight less than others.
WORD, LINK, OUT, OTHER = "word", "link", "out", "other"
#: Where a word of a page with marks stands: inside, only in a main element around the marked articles, or elsewhere.
IN, NEAR, BESIDE = "in", "near", "beside"
#: Weights without labelled pages, and what learned ones are shrunk to.
PLAIN = {WORD: 1.0, LINK: -1.5, OUT: -2.0, OTHER: -0.4, BESIDE: -3.0}
#: What a word's block is told by, each with its values.
SIGNS = {
    "element": ["p", "heading", "item", "cell", "quote", "box"],
    "length": [str(i) for i in range(8)],
    "links": ["none", "some", "most"],
    "before": ["none", "links", "short", "long"],
    "after": ["none", "links", "short", "long"],
}
ELEMENTS = {"p": "p", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "item", "dt": "item", "dd": "item", "td": "cell", "th": "cell", "caption": "cell", "blockquote": "quote", "pre": "quote"}
LONG = 16  # words from which a neighbour is long


class Element:
    """An element; number counts elements in page order and last is the largest number inside it."""

    __slots__ = ("name", "parent", "number", "last", "out", "link", "mark", "block", "holder")

    def __init__(self, name: str, parent: "Element | None", number: int, out: bool, mark: "Element | None"):
        self.name, self.parent, self.number, self.last, self.out = name, parent, number, number, out
        self.link = name == "a" or bool(parent and parent.link)
        is_block = parent is None or name in BLOCK
        self.block = self if is_block else parent.block  # the block element around it
        self.holder = self if is_block and name not in PARTS else parent.holder  # the same, other than a part of a list or table
        self.mark = self if name in MARKS and not out and MARKS[name] >= _level(mark) else mark

    def holds(self, other: "Element") -> bool:
        return self.number <= other.number <= self.last


class Block:
    """A run of text between block tags; size and linked count words of parts that are no content too."""

    __slots__ = ("element", "parts", "words", "links", "size", "linked")

    def __init__(self, element: Element):
        self.element, self.parts, self.words, self.links, self.size, self.linked = element, [], 0, 0, 0, 0

    def as_neighbour(self) -> str:
        return "links" if 2 * self.linked > self.size else "long" if self.size >= LONG else "short"


def _level(mark: Element | None) -> int:
    return MARKS[mark.name] if mark else 0


def _not_content(name: str, attributes: str, in_article: bool) -> bool:
    if name in NEVER or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    names = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower().split()
    words = {w for n in names if (parts := re.split(r"[^a-z0-9]+", n))[0] not in ABOUT for w in parts}
    return bool(words & NOT_CONTENT) or not in_article and bool(HEADS.intersection(names))


class Page:
    """A page's blocks, its elements in page order, and its tokens: (kind, number, block number, mark's level)."""

    def __init__(self, page: str, free: bool = False):
        """free: the first mark inside a part that is no content is content nevertheless."""
        root = Element("", None, 0, False, None)
        self.elements, self.blocks, self.tokens = [root], [Block(root)], []
        self.out_words: list[tuple[int, int]] = []  # element's number, words
        self.lost: Element | None = None
        here, opened, seen, at = root, Counter(), False, 0
        while at < len(page):
            m = TOKEN.match(page, at)
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                self._said(m[0], here)
            elif m[1]:
                if opened[name]:
                    was_out, top = here.out, here
                    while top.name != name:
                        opened[top.name] -= 1
                        top.last, top = len(self.elements) - 1, top.parent
                    opened[name] -= 1
                    top.last, here = len(self.elements) - 1, top.parent
                    self._tag(name, here)
                    if name in BLOCK or was_out != here.out:
                        self.blocks.append(Block(here))
                elif name in BLOCK:
                    self.blocks.append(Block(here))
            elif name in RAW:
                end = re.compile(rf"</{name}\b[^<>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name in VOID:
                self._tag(name, here)
                if name == "hr":
                    self.blocks.append(Block(here))
                self.blocks[-1].parts.append(" ")
            else:
                shut = CLOSES.get(name, set()) | ({"p"} if name in OPEN_PARAGRAPH else set())
                if here.block.name in shut:
                    top = here.block
                    while here is not top.parent:
                        opened[here.name] -= 1
                        here.last, here = len(self.elements) - 1, here.parent
                out = _not_content(name, m[3], here.mark is not None)
                first = name in MARKS and not seen and not out
                self.elements.append(Element(name, here, len(self.elements), (here.out and not (first and free)) or out, here.mark))
                parent, here = here, self.elements[-1]
                if first:
                    seen, self.lost = True, here if here.out else None
                opened[name] += 1
                if name in BLOCK or here.out != parent.out:
                    self.blocks.append(Block(here))
                self._tag(name, here)
        while here:
            here.last, here = len(self.elements) - 1, here.parent
        self.marked = max((x[3] for x in self.tokens), default=0)

    @classmethod
    def of(cls, page: str) -> "Page":
        """The page; where its first article or main element stands in a part that is no content, such as an unclosed
        advert, and holds more words than the page has otherwise, that one is content."""
        found = cls(page)
        if found.lost and sum(n for at, n in found.out_words if found.lost.number <= at <= found.lost.last) > sum(b.words for b in found.blocks):
            found = cls(page, free=True)
        return found

    def _tag(self, name: str, here: Element) -> None:
        if name not in MARKS:
            self.tokens.append((name if name in BLOCK or name in VOID or name in INLINE else OTHER, 1, len(self.blocks) - 1, 0 if here.out else _level(here.mark)))

    def _said(self, said: str, here: Element) -> None:
        if said.startswith("<![CDATA["):
            said = said[9:].removesuffix("]]>")
        elif said != "<" and said[0] == "<":
            return
        said = entities.unescape(said)
        block = self.blocks[-1]
        if n := len(said.split()):
            self.tokens.append((OUT if here.out else LINK if here.link else WORD, n, len(self.blocks) - 1, 0 if here.out else _level(here.mark)))
            block.size += n
            block.linked += n * here.link
        if here.out:
            self.out_words.append((here.number, n))
        else:
            block.words += n
            block.links += n * here.link
            block.parts.append(said)

    def link_dense(self) -> set[int]:
        """Numbers of the elements with more than half their words in links."""
        words, links = [0] * len(self.elements), [0] * len(self.elements)
        for block in self.blocks:
            words[block.element.number] += block.words
            links[block.element.number] += block.links
        for x in reversed(self.elements[1:]):
            words[x.parent.number] += words[x.number]
            links[x.parent.number] += links[x.number]
        return {i for i, n in enumerate(words) if 2 * links[i] > n}


    def signs(self) -> list[tuple[str, ...]]:
        """What each block is told by, in the order of SIGNS; nothing for blocks without words."""
        said = [i for i, b in enumerate(self.blocks) if b.size]
        out: list[tuple[str, ...]] = [()] * len(self.blocks)
        kinds = ["none", *(self.blocks[i].as_neighbour() for i in said), "none"]
        for at, i in enumerate(said):
            b = self.blocks[i]
            links = "none" if not b.linked else "most" if 2 * b.linked > b.size else "some"
            out[i] = (ELEMENTS.get(b.element.block.name, "box"), str(min(b.size.bit_length(), 7)), links, kinds[at], kinds[at + 2])
        return out

    def place(self, level: int) -> str | None:
        """Where a word stands, by the level of the mark around it; None on pages without marks."""
        return None if not self.marked else IN if level == self.marked else NEAR if level else BESIDE


def scores(page: Page, weights: dict[str, float], signs: bool = True, marks: bool = True) -> list[float]:
    """Each token's score. A mark's weight is in units of a word's, so that all that words gain is in proportion to it."""
    lower = [0.0] * len(page.blocks)
    if signs:
        known: dict[tuple[str, ...], float] = {}
        for i, told in enumerate(page.signs()):
            if told and told not in known:
                known[told] = sum(weights.get(f"{sign} {value}", 0.0) for sign, value in zip(SIGNS, told, strict=True))
            lower[i] = known.get(told, 0.0)
    out = []
    for kind, n, at, level in page.tokens:
        if kind in (WORD, LINK, OUT):
            lift = weights.get(page.place(level), 0.0) if marks else 0.0
            out.append(n * (weights[WORD] * (1 + lift) + lower[at] + (0.0 if kind == WORD else weights[kind])))
        else:
            out.append(n * weights.get(kind, weights[OTHER]))
    return out


def best_run(values: list[float]) -> tuple[int, int] | None:
    """First and last place of the run with the largest sum, if that is above zero; the earliest and shortest of equal ones."""
    best, total, start, found = 0.0, 0.0, 0, None
    for i, value in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += value
        if total > best:
            best, found = total, (start, i)
    return found


def _container(page: Page, first: int, last: int) -> Element:
    """What holds the run's blocks: their article or main element, else the innermost element that isn't a mere part of a text."""
    held = [b.element for b in page.blocks[first : last + 1] if b.words]
    if not held:
        return page.elements[0]
    mark, at = held[0].mark, held[0]
    if mark and all(mark.holds(x) for x in held):
        return mark
    for x in held:
        while not at.holds(x):
            at = at.parent
    inner = LEAVES | CELLS if len(held) == 1 else LEAVES
    while at.parent and at.name in inner:
        at = at.parent
    return at


def extract(html: str | None, weights: dict[str, float]) -> str:
    page = Page.of(html or "")
    values = scores(page, weights)
    run = best_run(values)
    if run is None:
        values = scores(page, weights, signs=False)
        run = best_run(values)
    if run is None:
        return ""
    first, last = (page.tokens[i][2] for i in run)
    said = [0.0] * len(page.blocks)
    for value, (kind, _, at, _) in zip(values, page.tokens, strict=True):
        if kind in (WORD, LINK):
            said[at] += value
    whole = _container(page, first, last)
    strict = whole.name not in MARKS
    dense = page.link_dense() if strict and any(b.links for b in page.blocks) else set()
    kept = []
    for i, block in enumerate(page.blocks):
        inside = first <= i <= last
        if not (inside if whole.name in WHOLE_PAGE else whole.holds(block.element)):
            continue
        if strict and not inside and said[i] <= 0 and not block.links:
            continue
        if strict and 2 * block.links > block.words:
            holder = block.element.holder
            holder = holder if whole.holds(holder) else whole
            if not inside or block.element.block.name not in ALWAYS_SAID and holder.number in dense:
                continue
        if text := " ".join("".join(block.parts).split()):
            kept.append(text)
    return "\n\n".join(kept)


def fit_weights(pages: DataFrame, html: str = "html", page_id: str = "page_id", max_pages: int = 2000, doubt: float = 20.0) -> dict[str, float]:
    """Weights of words, signs of blocks, tags and marks, from the labelled ones of max_pages pages by id hash.

    Tokens are counted inside and outside the marked content, each side scaled to 1000; doubt is how many of these the
    weights of PLAIN count for. The driver gets a row a combination of signs, whose number doesn't depend on the pages.
    """
    cutoff = hash_cutoff(pages.select(page_id), F.col(page_id), max_pages)
    sample = pages.filter((F.xxhash64(F.col(page_id)) <= F.lit(cutoff)) & F.col(html).rlike("(?i)<(article|main)[\\s>]")).select(html)
    sample = materialize(sample, "labelled")

    def counted(keys: Callable[[Page], Iterator[tuple[str, bool, int]]]) -> dict[tuple[str, bool], int]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums: Counter = Counter()
                for text in one_by_one(batch.column(0)):
                    for key, inside, n in keys(Page.of(text)):
                        sums[key, inside] += n
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.string()), pa.array([x for _, x in sums], pa.bool_()), pa.array(list(sums.values()), pa.int64())], ["kind", "inside", "n"])

        rows = sample.mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
        return {(r["kind"], r["inside"]): r["n"] for r in rows}

    weights = weights_of(counted(_told), doubt)
    return weights | marks_of(counted(lambda page: _agreeing(page, weights)), weights[WORD], doubt)


def _told(page: Page) -> Iterator[tuple[str, bool, int]]:
    """Tokens inside or outside the marks: a tag by its name, words by their kind and their block's signs."""
    signs = page.signs()
    for kind, n, at, level in page.tokens:
        yield " ".join((kind, *signs[at])) if kind in (WORD, LINK, OUT) else kind, page.place(level) == IN, n


def _agreeing(page: Page, weights: dict[str, float]) -> Iterator[tuple[str, bool, int]]:
    """Words by where they stand, inside or outside the run that is found without regard to marks."""
    first, last = best_run(scores(page, weights, marks=False)) or (0, -1)
    for i, (kind, n, _, level) in enumerate(page.tokens):
        if page.marked and kind in (WORD, LINK, OUT):
            yield page.place(level), first <= i <= last, n


def _odds(counts: dict[tuple[str, bool], int], total: dict[bool, int], key: str, doubt: float, prior: float) -> float:
    """Log odds of the key inside against outside, shrunk to the prior's."""
    p = 1 / (1 + math.exp(-prior))
    return math.log((counts.get((key, True), 0) / total[True] * 1000 + doubt * p) / (counts.get((key, False), 0) / total[False] * 1000 + doubt * (1 - p)))


def weights_of(counts: dict[tuple[str, bool], int], doubt: float = 20.0) -> dict[str, float]:
    """Weights from the counts of _told: as the method asks, a word weighs more than nothing, before the signs of its
    block take something away, and a tag less. Without counts, PLAIN."""
    if not counts:
        return dict(PLAIN)
    total = {x: sum(n for (_, i), n in counts.items() if i == x) + 1 for x in (True, False)}
    weights = {tag: min(_odds(counts, total, tag, doubt, PLAIN[OTHER]), -0.01) for tag in sorted(BLOCK | VOID | INLINE - set(MARKS)) + [OTHER]}
    words = {key: n for key, n in counts.items() if " " in key[0]}
    named = Counter()
    for (key, inside), n in words.items():
        named[key.split(" ", 1)[0], inside] += n
    weights[OUT] = min(_odds(named, total, OUT, doubt, PLAIN[OUT]), 0.0)
    return weights | _fit_signs(words, doubt)


def _fit_signs(words: dict[tuple[str, bool], int], doubt: float) -> dict[str, float]:
    """The most a word scores, and what links and signs take away, by logistic regression on the combinations' counts.

    Newton's steps on a ridge-penalised likelihood; the sides have equal totals, so the score says nothing of how much of
    a page is content. What is taken away is told from the value of a sign that takes least.
    """
    names = [LINK] + [f"{sign} {value}" for sign, values in SIGNS.items() for value in values]
    places = {name: i for i, name in enumerate(names)}
    rows = sorted(words.items())
    x, y, n = np.zeros((len(rows), len(names) + 1)), np.array([key[1] for key, _ in rows], float), np.array([n for _, n in rows], float)
    x[:, -1] = 1.0
    for row, ((key, _), _) in enumerate(rows):
        kind, *told = key.split(" ")
        x[row, [places[f"{sign} {value}"] for sign, value in zip(SIGNS, told, strict=True)]] = 1.0
        x[row, 0] = kind == LINK
    for side in (0.0, 1.0):
        n[y == side] *= 500 / max(n[y == side].sum(), 1.0)
    start = np.zeros(len(names) + 1)
    start[[0, -1]] = PLAIN[LINK], PLAIN[WORD]
    ridge, beta = np.full(len(names) + 1, doubt / 20), start.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ beta)))
        slope = x.T @ (n * (y - p)) - ridge * (beta - start)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(ridge), slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    weights = {LINK: min(float(beta[0]), 0.0)}
    most = float(beta[-1])
    for sign, values in SIGNS.items():
        best = max(beta[places[f"{sign} {v}"]] for v in values)
        most += float(best)
        weights |= {f"{sign} {v}": float(beta[places[f"{sign} {v}"]] - best) for v in values}
    return weights | {WORD: max(most, 0.01)}


def marks_of(counts: dict[tuple[str, bool], int], word: float, doubt: float = 20.0) -> dict[str, float]:
    """What marks say, in units of a word's weight, from the counts of _agreeing. Without counts, as in PLAIN."""
    if not counts:
        return {BESIDE: PLAIN[BESIDE]}
    total = {x: sum(n for (_, i), n in counts.items() if i == x) + 1 for x in (True, False)}
    return {place: _odds(counts, total, place, doubt, 0.0) / word for place in (IN, NEAR, BESIDE)}


def main_text(pages: DataFrame, html: str = "html", page_id: str = "page_id", out: str = "text", **fit) -> DataFrame:
    """pages with the column out: each page's main text."""
    weights = fit_weights(pages, html, page_id, **fit)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([extract(x, weights) for x in one_by_one(column)], pa.string())

    return pages.withColumn(out, text(html))
