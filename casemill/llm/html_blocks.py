"""Main text of web pages: a conditional random field over the leaf blocks of the DOM.

A page is scanned once into leaf blocks: runs of text between the edges of block elements, each
with its open elements. Features are the tags among a block's ancestors, what their class, id and
role say, and the look of the text and of its neighbours; the field labels the whole sequence by
Viterbi. It is trained on labelled pages that a seeded generator draws.

Pages are independent: one pass, no shuffle, memory bounded by a batch of pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.arrow import arrow_map
from casemill.llm.crf import LinearChainCRF
from casemill.llm.html_samples import labelled_pages

_NAME = re.compile(r"[^\s/>]*+")
_STOP = re.compile("[>\"']")
_BIG_REFERENCE = re.compile(r"&#(?:0*([0-9]*)|[xX]0*([0-9a-fA-F]*));?")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORD = re.compile(r"[a-z]+")

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without markup inside: those that run to the end of the page if they are not closed, and those that then have no extent.
RAW = frozenset("script style textarea title xmp".split())
HIDDEN = frozenset("noscript template iframe".split())
CONTROLS = frozenset("select option optgroup textarea datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# End of fixed values.
_ENDS_P = BLOCK - {"button", "label", "legend", "optgroup", "option", "select", "summary", "textarea", "title"}
_SCOPE = frozenset("ul ol table div section article main body html aside nav form td".split())

ANCESTORS = ("article", "main", "nav", "header", "footer", "aside", "form", "head", "li", "ul", "ol", "table", "section", "figure", "blockquote", "button", "label", "a", "div", "p", "pre", "dialog")
HINTS = {
    "content": "article content post entry story body main text page".split(),
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner".split(),
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination".split(),
    "head": "header masthead topbar".split(),
    "foot": "footer copyright colophon legal".split(),
    "side": "sidebar widget related recommended aside more".split(),
    "talk": "comment comments reply replies discussion responses respond thread".split(),
    "notice": "cookie cookies consent notice gdpr popup modal newsletter subscribe alert dialog overlay".split(),
    "share": "share sharing social follow".split(),
    "form": "login search contact signup form".split(),
}
_HINT_OF = {w: i for i, ws in enumerate(HINTS.values()) for w in ws}
_TAG_OF = {t: i for i, t in enumerate(ANCESTORS)}
LEAF = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "div", "article", "main", "section", "title", "a", "pre", "blockquote", "figcaption", "button", "label", "footer", "body")
_LEAF_OF = {t: i + 1 for i, t in enumerate(LEAF)}
_LENGTHS = np.array([1, 10, 25, 50, 100, 200, 400, 800])
_LINKS = np.array([0.01, 0.3, 0.6, 0.95])
_N_OWN = 2 * len(ANCESTORS) + 3 * len(HINTS) + (len(LEAF) + 1) + 9 + 5 + 3 + 2 + 4 + 12
_SIDE = len(LEAF) + 1 + 9 + 5 + 1
N_FEATURES = _N_OWN + 2 * _SIDE

Block = tuple[str, tuple]


class _Tags:
    """Where tags end: the next > outside quotes, or else the next one; every quote is followed once."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.after: dict[int, int] = {}  # of an opening quote: where the tag that it stands in ends
        self.unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """The end of a tag whose name ends at ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        page, start, path = self.page, at, []
        while True:
            m = _STOP.search(page, at)
            if m is None:
                end = -1
            elif m[0] == ">":
                end = m.start()
            elif (quote := m.start()) in self.after:
                end = self.after[quote]
            else:
                path.append(quote)
                at = page.find(m[0], quote + 1) + 1
                if at:
                    continue
                end = -1
            break
        for quote in path:
            self.after[quote] = end
        return end if end >= 0 else page.find(">", start)

    def close(self, tag: str, at: int) -> tuple[int, int]:
        """Where the end tag of a raw element begins and ends; -1, -1 if it is never closed."""
        if tag in self.unclosed:
            return -1, -1
        m = _raw_end(tag).search(self.page, at)
        if m is None:
            self.unclosed.add(tag)
            return -1, -1
        end = self.page.find(">", m.end() - 1)
        return m.start(), end + 1 if end >= 0 else len(self.page)


class _Stack:
    """Open elements: tag, ancestor tags and hints so far as bits, leaf tag, hints of the nearest named one."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, int, str, int]] = [("", 0, 0, "body", 0)]
        self.at: dict[str, list[int]] = {}  # of each tag, and of "scope": places in the stack

    def push(self, tag: str, hints: int) -> None:
        _, tags, above, leaf, near = self.open[-1]
        as_ = "form" if tag in CONTROLS else tag
        for key in (tag, "scope") if tag in _SCOPE else (tag,):
            self.at.setdefault(key, []).append(len(self.open))
        self.open.append((tag, tags | (1 << _TAG_OF[as_] if as_ in _TAG_OF else 0), above | hints, tag if tag in BLOCK else leaf, hints or near))

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            tag = self.open.pop()[0]
            self.at[tag].pop()
            if tag in _SCOPE:
                self.at["scope"].pop()

    def nearest(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def pop(self, tag: str) -> None:
        if k := self.nearest((tag,)):
            self.cut(k)

    def end_by(self, tags) -> None:
        """Close the nearest of ``tags``, if no element that bounds their scope lies between."""
        k = self.nearest(tags)
        if k and k >= self.nearest(("scope",)):
            self.cut(k)


def _decoded(text: str) -> str:
    """Character references decoded; numbers too large for any character as U+FFFD."""

    def checked(m: re.Match) -> str:
        digits = m[1] if m[1] is not None else m[2]
        return m[0] if len(m[0]) < 12 else "\ufffd" if len(digits) > 7 else f"&#{'' if m[1] is not None else 'x'}{digits or 0};"

    return html.unescape(_BIG_REFERENCE.sub(checked, text) if "&#" in text else text)


def leaf_blocks(page: str) -> list[Block]:
    """``(text, codes)`` of each leaf block: white space turned to one space, references decoded.

    Scripts, styles, comments and other hidden elements have no text. Unclosed and stray tags are
    read as browsers do in the common cases: an end tag closes what is open inside its element.
    The time is in proportion to the page, whatever is in it.
    """
    out: list[Block] = []
    stack, tags = _Stack(), _Tags(page)
    pieces: list[str] = []
    linked = 0
    context: tuple[str, int, int, int] | None = None  # leaf tag, tags, hints, hints of the nearest named

    def flush() -> None:
        nonlocal linked, context
        if pieces:
            text = " ".join(_decoded("".join(pieces)).split())
            if text:
                out.append((text, (*context, linked, len(stack.open))))
            pieces.clear()
        linked, context = 0, None

    def text_at(a: int, b: int) -> None:
        nonlocal linked, context
        if a < b:
            piece = page[a:b]
            _, bits, hints, leaf, near = stack.open[-1]
            if context is None:
                if piece.isspace():
                    if pieces:
                        pieces.append(" ")
                    return
                context = (leaf, bits, hints, near)
            pieces.append(piece)
            if bits & _A_BIT:
                linked += b - a

    at = look = 0  # text is read up to ``at``; the next tag is looked for from ``look``
    while (lt := page.find("<", look)) >= 0:
        look = lt + 1
        lead = page[lt + 1 : lt + 3]
        if lead[:1] in ("!", "?"):
            text_at(at, lt)
            closer = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = page.find(closer, lt + 2)
            at = look = end + len(closer) if end >= 0 else len(page)
            continue
        closing = lead[:1] == "/"
        letter = lead[1:2] if closing else lead[:1]
        if not ("a" <= letter <= "z" or "A" <= letter <= "Z"):
            continue
        begin = lt + 1 + closing
        if begin > tags.last:
            break
        name_end = _NAME.match(page, begin).end()
        end = tags.end(name_end)
        tag, rest = page[begin:name_end].lower(), page[name_end:end]
        text_at(at, lt)
        at = look = end + 1
        if closing:
            if tag in BLOCK:
                flush()
            stack.pop(tag)
            continue
        if tag in HIDDEN:
            start, end = tags.close(tag, at)
            if start >= 0:
                at = look = end
            continue
        if tag == "br" or tag == "hr" or tag == "img":
            if tag == "hr":
                flush()
            elif pieces:
                pieces.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            flush()
            if tag in _ENDS_P:
                stack.end_by(("p",))
            if tag in CLOSES:
                stack.end_by(CLOSES[tag])
        if rest.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        hints = 0
        if "=" in rest:
            for names in _NAMES.findall(rest):
                for word in _NAME_WORD.findall("".join(names).lower()):
                    if word in _HINT_OF:
                        hints |= 1 << _HINT_OF[word]
        stack.push(tag, hints)
        if tag in RAW:  # its text, then its end
            start, end = tags.close(tag, at)
            stop = start if start >= 0 else len(page)
            if tag in ("title", "xmp"):
                text_at(at, stop)
                flush()
            stack.pop(tag)
            at = look = end if start >= 0 else len(page)
    text_at(at, len(page))
    flush()
    return out


_A_BIT = 1 << _TAG_OF["a"]


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[\s/>]", re.I)


_IN = sum(1 << _TAG_OF[t] for t in ("article", "main"))
_SIDES = sum(1 << _TAG_OF[t] for t in ("nav", "header", "footer", "aside", "form", "head", "button", "label", "dialog"))
_TAG_BITS, _HINT_BITS = 1 << np.arange(len(ANCESTORS)), 1 << np.arange(len(HINTS))


def codes_of(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
    """Active features of all blocks of the pages, and the number of blocks of each."""
    lengths = np.fromiter(map(len, pages), np.int64, len(pages))
    blocks = [b for page in pages for b in page]
    n = len(blocks)
    cols: list[np.ndarray] = []
    at = 0

    def add(values: np.ndarray, size: int) -> None:
        nonlocal at
        cols.append((at + values).astype(np.int16))
        at += size

    leaf = np.fromiter((_LEAF_OF.get(c[0], 0) for _, c in blocks), np.int64, n)
    tags, hints, near, linked, depth = (np.fromiter((c[k] for _, c in blocks), np.int64, n) for k in range(1, 6))
    size = np.fromiter((len(t) for t, _ in blocks), np.int64, n)
    for bit in _TAG_BITS:
        add((tags & bit) != 0, 2)
    for bit in _HINT_BITS:  # on the nearest named ancestor, on another one, on none
        add(np.where(near & bit, 2, np.where(hints & bit, 1, 0)), 3)
    add(leaf, len(LEAF) + 1)
    long = np.searchsorted(_LENGTHS, size, "right")
    add(long, 9)
    dense = np.searchsorted(_LINKS, linked / np.maximum(size, 1), "right")
    add(dense, 5)
    add(np.fromiter((2 if t[-1] in ".!?:;\"”»…" else 1 if t[-1].isalnum() else 0 for t, _ in blocks), np.int64, n), 3)
    add(np.fromiter(("©" in t or "(c)" in t.lower()[:80] for t, _ in blocks), np.int64, n), 2)
    add(np.minimum(depth // 3, 3), 4)
    # inside an article, with or without a telling name or a side element between
    inside = np.where(tags & _IN, 1, 0) + np.where(hints & 1, 1, 0)
    add(inside * 4 + 2 * ((near & ~1) != 0) + ((tags & _SIDES) != 0), 12)
    starts = np.cumsum(lengths) - lengths
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[starts[lengths > 0]] = True
    last[(starts + lengths - 1)[lengths > 0]] = True
    for missing, shift in ((first, 1), (last, -1)):
        for values, count in ((leaf, len(LEAF) + 1), (long, 9), (dense, 5)):
            other = np.roll(values, shift)
            cols.append(np.where(missing, at, at + 1 + other).astype(np.int16) if count == len(LEAF) + 1 else np.where(missing, at - 1, at + other).astype(np.int16))
            at += count + (count == len(LEAF) + 1)
    return np.stack(cols, 1) if n else np.zeros((0, len(cols)), np.int16), lengths


def train(pages: int = 1200, seed: int = 11) -> LinearChainCRF:
    """A field trained on ``pages`` generated pages; the same arguments give the same field."""
    parsed, labels = [], []
    for page, blocks in labelled_pages(pages, seed):
        own = leaf_blocks(page)
        if [t for t, _ in own] == [t for t, _ in blocks]:  # pages that read otherwise have no sure labels
            parsed.append(own)
            labels += [y for _, y in blocks]
    x, lengths = codes_of(parsed)
    return LinearChainCRF.fit(x, np.array(labels), lengths, N_FEATURES, penalty=0.5)


@lru_cache(maxsize=2)
def trained(pages: int = 1200, seed: int = 11) -> LinearChainCRF:
    return train(pages, seed)


def main_texts(pages: list[str], field: LinearChainCRF) -> list[str]:
    """The blocks labelled as main text of each page, joined by one space."""
    parsed = [leaf_blocks(p) for p in pages]
    x, lengths = codes_of(parsed)
    labels = iter(field.decode(x, lengths).tolist())
    return [" ".join([text for (text, _), y in zip(own, labels) if y]) if own else "" for own in parsed]  # noqa: B905


def extract(pages: DataFrame, field: LinearChainCRF | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``.

    ``text`` is the article without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, markup and reader comments; empty if there is none or html is null. Null ids and
    urls and repeated rows pass as they are; other columns do not matter.
    """
    sent = pages.sparkSession.sparkContext.broadcast(field or trained())

    def kernel(ids: list, urls: list, htmls: list) -> Iterator[tuple]:
        for k in range(0, len(ids), 500):
            part = slice(k, k + 500)
            for page_id, url, text in zip(ids[part], urls[part], main_texts(htmls[part], sent.value), strict=True):
                yield page_id, url, text, len(text)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")))
    return arrow_map(rows, kernel, "page_id long, url string, text string, n_chars long")
