"""Labelled pages to train the HTML extractor on: drawn from a seed, labels known by construction.

A page is a list of parts; each part is markup with the text blocks in it and whether they belong
to the main text. The parts follow common habits of page authors: semantic elements or plain
divisions with telling (or random) class names, side parts before, inside and after the article.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable

_SYLLABLES = "a an ar be ca co da de di en er es ha in is it la le lo ma me na ne no on or pa per ra re ri sa se si so ta te ti to tu un ver"


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.blocks: list[tuple[str, int]] = []

    def words(self, low: int, high: int) -> str:
        syllables = _SYLLABLES.split()
        words = ["".join(self.rng.choices(syllables, k=self.rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.1:
            words = [w + self.rng.choice(["###", "***", "&&&", "!!", "<"]) for w in words]
        if self.rng.random() < 0.05:
            words = [w.upper() for w in words]
        return " ".join(words)

    def prose(self, low: int = 4, high: int = 90) -> str:
        text = self.words(low, high).capitalize()
        return text + self.rng.choice([".", ".", ".", "", "!", "?"])

    def block(self, text: str, main: int) -> str:
        """Escaped text, noted as a block with its label."""
        text = " ".join(text.split())
        if text:
            self.blocks.append((text, main))
        return html.escape(text, quote=self.rng.random() < 0.5)

    def named(self, *names: str) -> str:
        """An attribute that tells what a part is, more or less."""
        name = self.rng.choice(names)
        name = self.rng.choice([name, name, f"{name}-{self.rng.randint(1, 99)}", f"site-{name}", f"{name} wide", name.upper()])
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"'

    def links(self, main: int, low: int = 3, high: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.block(self.words(1, 3), main)}</a></li>' for i in range(self.rng.randint(low, high))) + "</ul>"

    # parts that are not main text

    def nav(self) -> str:
        if self.rng.random() < 0.6:
            return f"<nav>{self.links(0)}</nav>"
        if self.rng.random() < 0.4:
            crumbs = " &gt; ".join(f'<a href="#">{html.escape(self.words(1, 2))}</a>' for _ in range(3))
            text = html.unescape(crumbs)
            self.blocks.append((" ".join(re.sub("<[^>]*>", "", text).split()), 0))
            return f"<div{self.named('breadcrumb', 'breadcrumbs')}>{crumbs}</div>"
        return f"<div{self.named('nav', 'menu', 'navbar', 'navigation')}>{self.links(0)}</div>"

    def header(self) -> str:
        inner = f"<{(t := self.rng.choice(['h1', 'h2', 'p', 'div']))}>{self.block(self.words(1, 5), 0)}</{t}>"
        return f"<header>{inner}</header>" if self.rng.random() < 0.6 else f"<div{self.named('header', 'masthead', 'topbar')}>{inner}</div>"

    def footer(self) -> str:
        inner = self.block("© " * (self.rng.random() < 0.6) + self.prose(3, 40), 0)
        if self.rng.random() < 0.4:
            inner = f"<p>{inner}</p>" + (self.links(0, 2, 4) if self.rng.random() < 0.5 else "")
        return f"<footer>{inner}</footer>" if self.rng.random() < 0.7 else f"<div{self.named('footer', 'copyright', 'colophon')}>{inner}</div>"

    def advert(self) -> str:
        inner = self.block(self.prose(2, 40), 0)
        tag = self.rng.choice(["div", "div", "aside", "section", "p"])
        return f"<{tag}{self.named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{inner}</{tag}>"

    def sidebar(self) -> str:
        inner = f"<h3>{self.block(self.words(1, 3), 0)}</h3>" + (self.links(0) if self.rng.random() < 0.6 else f"<p>{self.block(self.prose(3, 30), 0)}</p>")
        return f"<aside>{inner}</aside>" if self.rng.random() < 0.5 else f"<div{self.named('sidebar', 'related', 'widget', 'recommended')}>{inner}</div>"

    def notice(self) -> str:
        inner = f"<p>{self.block(self.prose(4, 30), 0)}</p><button>{self.block(self.words(1, 2), 0)}</button>"
        role = self.rng.choice(["", ' role="dialog"', ' role="alert"'])
        return f"<div{self.named('cookie', 'consent', 'notice', 'gdpr', 'popup', 'modal', 'newsletter', 'subscribe', 'alert')}{role}>{inner}</div>"

    def form(self) -> str:
        if self.rng.random() < 0.5:
            fields = "".join(f'<label>{self.block(self.words(1, 3), 0)}</label><input name="x">' for _ in range(self.rng.randint(1, 3)))
        else:
            fields = f"<p>{self.block(self.prose(2, 12), 0)}</p><textarea>{html.escape(self.words(1, 5))}</textarea>"
        return f"<form{self.named('login', 'search', 'contact')} action='/f'>{fields}<button>{self.block(self.words(1, 1), 0)}</button></form>"

    def comments(self) -> str:
        tag = self.rng.choice(["section", "div", "ol"])
        head = f"<h3>{self.block(self.words(1, 2), 0)}</h3>" if tag != "ol" else ""
        one = "".join(
            f"<{(t := self.rng.choice(['div', 'li', 'article']))}{self.named('comment', 'reply')}><p>{self.block(self.prose(2, 60), 0)}</p></{t}>"
            for _ in range(self.rng.randint(1, 5))
        )
        return f"<{tag}{self.named('comments', 'discussion', 'replies', 'responses')}>{head}{one}</{tag}>"

    def share(self) -> str:
        return f"<div{self.named('share', 'social', 'sharing')}>{self.block(self.words(1, 4), 0)}</div>"

    def script(self) -> str:
        return self.rng.choice(['<script>var t="</p>";go(1<2);</script>', "<style>p{margin:0}</style>", "<!-- note <p>x</p> -->", "<noscript></noscript>"])

    # the article

    def paragraph(self) -> str:
        text = self.block(self.prose(), 1)
        kind = self.rng.random()
        if kind < 0.1:
            text = f"<b>{text}</b>"
        elif kind < 0.2:
            text += "<br>"
        return f"<p>{text}" + ("</p>" if self.rng.random() < 0.85 else "")

    def body_part(self) -> str:
        r = self.rng.random()
        if r < 0.72:
            return self.paragraph()
        if r < 0.8:
            return f"<h{(n := self.rng.randint(2, 4))}>{self.block(self.words(1, 9), 1)}</h{n}>"
        if r < 0.86:
            items = "".join(f"<li>{self.block(self.prose(2, 20), 1)}</li>" for _ in range(self.rng.randint(2, 5)))
            return f"<ul>{items}</ul>"
        if r < 0.9:
            return f"<blockquote><p>{self.block(self.prose(), 1)}</p></blockquote>"
        if r < 0.93:
            return f"<pre>{self.block(self.words(3, 30), 1)}</pre>"
        if r < 0.96:
            return f'<figure><img src="a.png" alt="x"><figcaption>{self.block(self.prose(2, 12), 1)}</figcaption></figure>'
        return f"<div>{self.block(self.prose(), 1)}</div>"

    def article(self) -> str:
        parts = []
        if self.rng.random() < 0.8:
            parts.append(f"<h1>{self.block(self.words(1, 14), 1)}</h1>")
        inside: list[Callable[[], str]] = [self.advert, self.share, self.form, self.sidebar, self.notice, self.script]
        for _ in range(self.rng.choice([0, 1, 2, 4, 8, 14, 25])):
            parts.append(self.body_part())
            if self.rng.random() < 0.06:
                parts.append(self.rng.choice(inside)())
        if len(parts) < 2:
            parts.append(self.paragraph())
        if self.rng.random() < 0.1:
            parts.append(self.comments())
        body = "".join(parts)
        r = self.rng.random()
        if r < 0.45:
            return f"<article>{body}</article>"
        if r < 0.6:
            return f"<main>{body}</main>"
        if r < 0.85:
            return f"<div{self.named('article', 'content', 'post', 'entry', 'story', 'main-text', 'post-body')}>{body}</div>"
        if r < 0.92:
            return f"<main><article{self.named('post', 'x', 'story')}>{body}</article></main>"
        return f"<div>{body}</div>"

    def build(self) -> str:
        r = self.rng
        if r.random() < 0.08:  # a fragment
            return self.article()
        head = f"<title>{self.block(self.words(1, 10), 0)}</title>"
        pick = lambda part, p: part() if r.random() < p else ""
        top = pick(self.notice, 0.2) + pick(self.header, 0.4) + pick(self.nav, 0.85) + pick(self.script, 0.5) + pick(self.advert, 0.4) + pick(self.form, 0.12)
        body = top + pick(self.sidebar, 0.2) + self.article()
        rest = pick(self.share, 0.15) + pick(self.comments, 0.3) + pick(self.sidebar, 0.25) + pick(self.advert, 0.2) + pick(self.form, 0.15)
        body += rest + pick(self.footer, 0.9) + pick(self.notice, 0.1)
        return f'<!DOCTYPE html><html lang="x"><head><meta charset="utf-8">{head}<style>p{{}}</style></head><body>{body}</body></html>'


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """``n`` pages, each with its text blocks in page order and whether they are main text."""
    out = []
    for k in range(n):
        page = _Page(random.Random(f"{seed}:{k}"))
        out.append((page.build(), page.blocks))
    return out
