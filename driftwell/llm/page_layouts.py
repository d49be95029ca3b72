"""Labelled pages to train the page model on: common layouts filled with invented words, labelled region by region.

Regions of the article carry ``data-label="content"``, what is not read as its text ``data-label="other"``.  A page is
made of its number alone, so the set is the same in every run.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu ar en is ol un".split()
#: How each kind of region is written on the web: a start tag each.  Fixed values.
BODIES = (
    "<article>", "<article>", "<article>", "<article class='post hentry'>", "<main>", "<main>", "<main id=main>", "<div class='content'>", "<div id='main-content'>", "<div class=post-body>",
    "<div class='entry-content'>", "<section class='story'>", "<div itemprop=articleBody>", "<div>", "<div class='col-8'>", "<section>", "<div class='text'>",
)
REGIONS = {
    "header": ("<header>", "<header class=site-header>", "<div id=header>", "<div class='masthead'>", "<div class='top-banner'>", "<div class=branding>"),
    "menu": ("<nav>", "<nav class=breadcrumbs>", "<div class='menu'>", "<ul id='main-nav'>", "<menu>", "<div role=navigation>", "<div class=toc>", "<ul>"),
    "side": ("<aside>", "<aside class='widget'>", "<div class=sidebar>", "<div id='right-column'>", "<section class='side'>", "<div class='secondary'>"),
    "advert": ("<div class=ad>", "<div class='advert'>", "<div id=ad-top>", "<div class='sponsored'>", "<aside class='promo'>", "<div class='banner-ads'>", "<section class=advertisement>"),
    "notice": ("<div class='cookie-banner'>", "<div role=alert>", "<div class=notice>", "<div id='consent'>", "<section class='gdpr popup'>", "<div class=alert-message>", "<dialog open>"),
    "form": ("<form>", "<form class='newsletter'>", "<div class='subscribe'>", "<form id=search>", "<div class='login-form'>"),
    "share": ("<div class=share>", "<ul class='social'>", "<div class='sharing-buttons'>", "<div class='like-bar'>"),
    "related": ("<div class=related>", "<section class='recommended'>", "<div class='more-stories'>", "<ul class=tags>", "<aside class='also-popular'>"),
    "comments": ("<section id=comments>", "<div class='comments'>", "<ol class=commentlist>", "<div class='discussion'>", "<section class='reader-comments'>", "<div class='responses'>"),
    "footer": ("<footer>", "<footer class='site-footer'>", "<div id=footer>", "<div class='colophon'>", "<div class=copyright>", "<div role=contentinfo>"),
}
_BEFORE, _WITHIN, _AFTER = ("header", "menu", "notice", "advert", "form"), ("advert", "related", "share", "form", "notice", "side"), ("related", "comments", "side", "advert", "form", "share", "footer")


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: Some pages are junk all through, and their article is the main text all the same.
        self.junk = self.r.choices(("", "marks", "bars", "bare", "twice"), (8, 1, 1, 1, 1))[0]

    def word(self) -> str:
        w = "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))
        return w + self.r.choice(("###", "$$$", "***", "%", "&amp;")) if self.junk == "marks" else f"{w} {w}" if self.junk == "twice" else w

    def words(self, least: int, most: int) -> str:
        return (" | " if self.junk == "bars" else " ").join(self.word() for _ in range(self.r.randint(least, most))).capitalize()

    def sentences(self, least: int, most: int) -> str:
        n = self.r.randint(least, most)
        if self.junk in ("bars", "bare"):
            return self.words(n, 14 * n)
        return " ".join(self.words(1, 14) + self.r.choice("....!?" if self.r.random() < 0.95 else ":,") for _ in range(n))

    def inline(self, text: str) -> str:
        if self.r.random() > 0.2:
            return text
        a, _, b = text.partition(" ")
        tag = self.r.choice(("a href='/x'", "em", "b", "span class=x", "code", "strong"))
        return f"<{tag}>{a}</{tag.split()[0]}> {b}"

    def link(self) -> str:
        return f"<a href='/{self.word()}'>{self.words(1, 6)}</a>"

    def links(self, wrapped: bool = False) -> str:
        items = "".join(f"<li>{self.link()}{self.r.choice(('', '', '</li>'))}" for _ in range(self.r.randint(2, 8)))
        return items if wrapped else self.r.choice((f"<ul>{items}</ul>", " | ".join(self.link() for _ in range(4)), f"<ol>{items}</ol>"))

    def paragraph(self) -> str:
        kind = self.r.random()
        text = self.inline(self.sentences(1, 1 if kind < 0.2 else 9))
        if kind < 0.7:
            return f"<p>{text}" + self.r.choice(("</p>", "</p>\n", ""))
        if kind < 0.78:
            return f"<p><b>{text}<br>"
        if kind < 0.84:
            return f"<h{(k := self.r.randint(2, 4))}>{self.words(1, 8)}</h{k}>"
        if kind < 0.88:
            tag = self.r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.sentences(1, 2) if self.r.random() < 0.5 else self.words(1, 8))}</li>" for _ in range(self.r.randint(1, 6))) + f"</{tag}>"
        if kind < 0.91:
            return f"<blockquote>{self.r.choice(('', '<p>'))}{text}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}<td>{self.words(1, 5)}</tr>" for _ in range(self.r.randint(1, 5))) + "</table>"
        if kind < 0.96:
            return f"<figure><img src=x><figcaption>{self.words(2, 12)}.</figcaption></figure>"
        return self.r.choice((f"<pre>{self.words(3, 20)}</pre>", f"{text}<br><br>", f"<div>{text}</div>", f"<dl><dt>{self.words(1, 2)}<dd>{text}</dl>"))

    def region(self, kind: str) -> str:
        r = self.r
        start = r.choice(REGIONS[kind])
        tag = start[1:].split(" ")[0].rstrip(">")
        wrapped = tag in ("ul", "ol", "menu")
        one = (lambda x: f"<li>{x}</li>") if wrapped else (lambda x: x)
        if kind in ("menu", "share", "related"):
            inner = self.links(wrapped) if kind != "related" or r.random() < 0.6 else "".join(one(f"<h4>{self.link()}</h4><p>{self.sentences(1, 2)}</p>") for _ in range(r.randint(1, 4)))
            inner = r.choice(("", "<h3>" + self.words(1, 3) + "</h3>")) * (not wrapped) + inner
        elif kind == "header":
            inner = r.choice((self.link(), f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 9)}</p>", f"<div>{self.link()}</div>")) + r.choice(("", self.region("menu")))
        elif kind == "advert":
            inner = r.choice((self.sentences(1, 4), f"<p>{self.sentences(1, 3)}</p>", f"<h4>{self.words(1, 5)}</h4><p>{self.sentences(1, 2)}</p>", self.link(), self.link() + " " + self.sentences(1, 2)))
        elif kind == "notice":
            inner = r.choice(("", "<p>")) + self.sentences(1, 4) + r.choice(("", f"<button>{self.words(1, 2)}</button>", self.link()))
        elif kind == "form":
            inner = r.choice(("", f"<p>{self.sentences(1, 2)}</p>", f"<h3>{self.words(1, 4)}</h3>")) + f"<label>{self.words(1, 3)}</label><input name=q>" + r.choice(
                ("<textarea>Text</textarea>", "<select><option>One<option>Two</select>", "")) + f"<button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            each = lambda: r.choice(("<div class=comment>", "<div>", "<article class='comment'>")) if not wrapped else "<li class=comment>"
            inner = r.choice(("", f"<h3>{self.words(1, 3)}</h3>")) * (not wrapped)
            for _ in range(r.randint(1, 5)):
                head = each()
                inner += head + r.choice(("", f"<b>{self.word()}</b> ", f"<h4>{self.word()}</h4>")) + f"<p>{self.sentences(1, 6)}</p></{head[1:].split(' ')[0].rstrip('>')}>"
            inner += r.choice(("", self.region("form"))) * (not wrapped)
        elif kind == "side":
            inner = f"<h3>{self.words(1, 3)}</h3>" + r.choice((self.links(), f"<p>{self.sentences(1, 4)}</p>", f"<p>{self.sentences(1, 2)}</p>{self.link()}"))
        else:
            inner = r.choice((f"&copy; {self.word()} &middot; {self.sentences(1, 2)}", f"<p>&copy; 2020 {self.words(1, 4)}.</p>", self.links() + f"<p>{self.words(2, 8)}</p>", f"<div>{self.sentences(1, 3)}</div>"))
        return f"{start[:-1]} data-label=other>{inner}</{tag}>"

    def page(self) -> str:
        r = self.r
        title = self.words(2, 16) + r.choice(("", "."))
        start = r.choice(BODIES)
        tag = start[1:].split(" ")[0].rstrip(">")
        blocks = [r.choice((f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header data-label=content><h1>{title}</h1></header>", f"<h2>{title}</h2>", ""))]
        blocks += [self.paragraph() for _ in range(r.choice((1, 1, 1, 2, 3, 5, 8, 12, 20)))]
        if r.random() < 0.1:  # hardly more than a title
            title = self.words(1, 3) + "."
            blocks = [f"<h1>{title}</h1>" + r.choice((f"<p>{title}</p>", f"<p><b>{title}<br>", f"<p>{self.words(1, 6)}</p>"))]
        for kind in r.sample(_WITHIN, r.choice((0, 0, 0, 1, 1, 2))):
            blocks.insert(r.randint(1, len(blocks)), self.region(kind))
        if r.random() < 0.15:
            blocks.append(self.region("comments"))
        inner = "".join(blocks)
        if r.random() < 0.25:
            inner = f"<div{r.choice(('', ' class=inner', ' class=prose'))}>{inner}</div>"
        body = f"{start[:-1]} data-label=content>{inner}</{tag}>" if r.random() > 0.04 else ""
        if r.random() < 0.3:
            name = r.choice(("<div class=container>", "<div id=page>", "<div class=wrapper>", "<div class=row>", "<main>"))
            side = self.region("side") if r.random() < 0.5 else ""
            body = f"{name}{r.choice((body + side, side + body))}</{name[1:].split(' ')[0].rstrip('>')}>"
        before = "".join(self.region(k) for k in _BEFORE if r.random() < 0.5)
        after = "".join(self.region(k) for k in r.sample(_AFTER, len(_AFTER)) if r.random() < 0.35)
        after += self.region("footer") if r.random() < 0.6 else ""
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{before}{body}{after}<script>x('</p>')</script></body></html>"


def labelled_pages(count: int = 600, first: int = 0) -> list[str]:
    """Pages ``first`` to ``first + count - 1`` of an endless series."""
    return [_Writer(i).page() for i in range(first, first + count)]
