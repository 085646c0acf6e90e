"""Labelled pages to train page extraction on: a grammar of page parts and their markup.

An element marked ``data-main="1"`` is main text, one marked ``data-main="0"`` is not; unmarked elements follow
the element around them.  Layouts mix sectioning elements, named containers and bare ones, with
boilerplate around and inside the article, so that no single cue decides.
"""

from __future__ import annotations

import random

# Fixed names that pages give to their parts.
NAMES = {
    "nav": "nav menu navbar navigation topnav main-menu site-nav links breadcrumb breadcrumbs pagination pager tabs toc skip-link",
    "header": "header site-header masthead branding top-bar topbar page-header logo site-title",
    "footer": "footer site-footer colophon copyright legal bottom imprint credits page-footer",
    "sidebar": "sidebar widget widget-area rail secondary side right-column related related-posts recommended most-read trending popular archive tags tag-list categories teaser more-stories",
    "ad": "ad ads advert adverts advertisement ad-slot ad-banner banner sponsor sponsored promo promotion adbox dfp affiliate",
    "notice": "notice cookie cookies cookie-banner cookie-notice consent gdpr alert popup modal overlay paywall disclaimer message announcement privacy warning",
    "form": "form search search-box login newsletter subscribe signup contact register survey poll",
    "share": "share sharing social social-links follow toolbar print-tools",
    "comments": "comments comment comment-list commentlist comments-area responses replies reply discussion disqus respond reader-comments feedback",
    "main": "content main article post entry entry-content post-content article-body article-content story story-body post-body body-text main-content text articleBody blog-post page-content hentry",
}
NEUTRAL = "row col col-md-8 container wrapper inner box clearfix section block grid item wrap outer page x1 module left center".split()


class Maker:
    """Pages drawn from the grammar by one seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choices(("an", "er", "to", "li", "re", "sch", "ou", "é", "ta", "mo", "st", "en"), k=k % 4 + 1)) for k in range(400)]
        self.terse = False

    def word(self) -> str:
        return self.r.choice(self.words)

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randint(low, high))).capitalize()

    def sentence(self) -> str:
        out = self.phrase(1, 5 if self.r.random() < 0.2 else 18)
        if self.r.random() < 0.4:
            out += ", " + self.phrase(2, 8).lower()
        return out + self.r.choice("....?!")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.word()}">{self.phrase(low, high)}</a>'

    def name(self, kind: str) -> str:
        names = self.r.choice(NAMES[kind].split())
        if self.r.random() < 0.3:
            names += " " + self.r.choice(NEUTRAL)
        return f' {self.r.choice(("class", "class", "id"))}="{names}"'

    def boiler(self, kind: str) -> str:
        r = self.r
        links = "".join(f"<li>{self.link()}</li>" for _ in range(r.choices((2, 4, 8, 40, 150), (4, 4, 4, 1, 0.3))[0]))
        menu = r.choice((f"<ul>{links}</ul>", " | ".join(self.link() for _ in range(r.randint(2, 7))), f"<div>{self.link()}</div>" * r.randint(2, 4)))
        words = r.choice((self.prose(1, 3), self.phrase(2, 8), self.prose(1, 1), self.prose(3, 6)))
        body = {
            "nav": menu,
            "header": r.choice((f"<h1>{self.phrase(1, 4)}</h1>", f"<div>{self.phrase(1, 4)}</div><p>{words}</p>", f"<a href='/'>{self.phrase(1, 3)}</a>{menu}", self.phrase(1, 6))),
            "footer": r.choice((f"&copy; {self.phrase(1, 3)} &middot; {words}", f"<p>{words}</p>{menu}", f"<p>{words}</p>", self.phrase(2, 8))),
            "sidebar": r.choice((f"<h3>{self.phrase(1, 3)}</h3><ul>{links}</ul>", f"<h3>{self.phrase(1, 4)}</h3><p>{words}</p>", f"<p>{words}</p>", "".join(f"<div><h4>{self.link(3, 9)}</h4><p>{self.sentence()}</p></div>" for _ in range(r.randint(1, 4))))),
            "ad": r.choice((words, f"<p>{words}</p>", f"{self.link(2, 6)} {words}", f"<div><b>{self.phrase(1, 4)}</b> {words}</div>")),
            "notice": r.choice((words, f"<p>{words} {self.link()}</p>", f"<p>{words}</p><button>OK</button>", f"<div>{words}</div>")),
            "form": r.choice((f"<label>{self.phrase(1, 3)}</label><input name='q'><p>{words}</p>", f"<p>{words}</p><input type=text> {self.phrase(1, 2)}", f"<fieldset><legend>{self.phrase(1, 3)}</legend><label>{self.phrase(1, 4)}</label></fieldset>")),
            "share": r.choice((menu, f"{self.phrase(1, 3)}: {self.link(1, 1)} {self.link(1, 1)}", f"<span>{self.phrase(1, 3)}</span>")),
            "comments": f"<h2>{self.phrase(1, 3)}</h2>" * r.randint(0, 1)
            + f"<article><h4>{self.phrase(1, 2)}</h4><p>{self.prose(1, 4)}</p></article>" * (r.random() < 0.1)
            + "".join(r.choice(("<div class='comment'><p class='author'>{a}</p><p>{t}</p></div>", "<li><b>{a}</b><p>{t}</p></li>", "<p>{a}: {t}</p>", "<div><div>{a}</div><div>{t}</div></div>", "<div><p>{t}</p></div>")).format(a=self.phrase(1, 2), t=self.prose(1, 4)) for _ in range(r.choices((1, 2, 4, 30, 100), (4, 4, 4, 1, 0.3))[0])),
        }[kind]
        element = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        if element and r.random() < 0.5:
            return f'<{element}{self.name(kind) if r.random() < 0.4 else ""} data-main="0">{body}</{element}>'
        element = r.choice(("div", "div", "section", "ul" if body.startswith("<li") else "div", element or "div"))
        return f'<{element}{self.name(kind)} data-main="0">{body}</{element}>'

    def part(self) -> str:
        """A part of the article."""
        r = self.r
        inline = lambda t: r.choice(("{}", "{}", "{}", "<b>{}</b>", "<span>{}</span>", "<em>{}</em> ", "{} " + self.link(1, 3) + " " + self.sentence())).format(t)
        lead = r.choice(("", "", "", ' class="lead"', ' class="intro"', ' class="p1"'))
        if self.terse and r.random() < 0.8:
            # short lines, lists of names, repeated words
            return r.choice((f"<p>{self.sentence()}</p>", f"<p>{self.phrase(1, 4)}{r.choice(('.', '', ','))}</p>", f"<p>{' '.join([self.word()] * r.randint(5, 60))}</p>", f"<p>{self.phrase(10, 60)}</p>"))
        return r.choices(
            (
                f"<p{lead}>{inline(self.prose(1, 8))}</p>",
                f"<p>{self.phrase(1, 3)}{r.choice(('.', '', ':'))}</p>",
                f"<h{(k := r.randint(2, 4))}>{self.phrase(1, 7)}</h{k}>",
                "<ul>" + "".join(f"<li>{r.choice((self.sentence(), self.phrase(1, 6)))}" for _ in range(r.randint(1, 5))) + "</ul>",
                f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>",
                f"<pre>{self.prose(1, 3)}</pre>",
                "<table>" + "".join("<tr>" + "".join(f"<td>{self.phrase(1, 3)}" for _ in range(3)) for _ in range(r.randint(1, 4))) + "</table>",
                f"<figure><img src=x><figcaption>{r.choice((self.phrase(2, 8), self.sentence()))}</figcaption></figure>",
                f"<p><b>{self.prose(1, 2)}<br><p>{self.prose(1, 4)}</p>",
                f"<div>{self.prose(1, 6)}</div>",
                f"<section><h2>{self.phrase(1, 5)}</h2><p>{self.prose(1, 5)}</p></section>",
            ),
            (12, 3, 2, 1, 1, 0.5, 0.5, 0.5, 1, 1, 1),
        )[0]

    def article(self) -> str:
        r = self.r
        title = f"<h1>{self.phrase(2, 12)}{r.choice(('', '', '.'))}</h1>"
        head = r.choices(("", title, f"<header>{title}</header>", f'<header class="entry-header">{title}<p>{self.phrase(2, 6)}</p></header>'), (1, 5, 1, 1))[0]
        self.terse = r.random() < 0.2
        parts = [self.part() for _ in range(r.choices((1, 2, 3, 5, 8, 12, 40, 150), (4, 4, 3, 3, 3, 3, 1, 0.7 + self.terse))[0])]
        if r.random() < 0.2:
            parts = [f"{self.prose(2, 6)}<br><br>{self.prose(1, 6)}"]
        for kind in ("ad", "share", "sidebar", "notice", "nav", "form", "comments"):
            if r.random() < 0.08:
                parts.insert(r.randint(0, len(parts)), self.boiler(kind))
        if r.random() < 0.15:
            parts.append(self.boiler(r.choice(("footer", "share", "sidebar"))))
        return head + "".join(parts)

    def page(self) -> str:
        r = self.r
        wrap = r.choices(("<article{0}>{1}</article>", "<main{0}>{1}</main>", "<main><article{0}>{1}</article></main>", "<div{2}{0}>{1}</div>", "<section{2}{0}>{1}</section>", "<div{0}>{1}</div>", "<table><tr><td{0}>{1}</td></tr></table>"), (5, 2, 1, 5, 1, 1.5, 0.5))[0]
        body = wrap.format(' data-main="1"', self.article(), self.name("main"))
        before = [self.boiler(k) for k in ("notice", "header", "nav", "ad", "form", "share", "nav") if r.random() < 0.4]
        after = [self.boiler(k) for k in ("comments", "sidebar", "ad", "share", "form", "footer", "notice", "sidebar") if r.random() < 0.4]
        r.shuffle(before)
        if r.random() < 0.4:
            keep = after.pop(0) if after and r.random() < 0.5 else ""
            body = f'<div{self.name("main") if r.random() < 0.3 else f" class={chr(34)}{r.choice(NEUTRAL)}{chr(34)}"}>{body}{keep}</div>'
        if r.random() < 0.2:
            before = after = []
        tail = r.choice(("</body></html>", ""))
        if r.random() < 0.1:
            # no container: text, paragraphs and headings stand in the body
            return f'<html><body data-main="1">{"".join(before)}{r.choice((self.prose(1, 6), self.article(), self.phrase(3, 9)))}{"".join(after)}{tail}'
        return f"<!DOCTYPE html><html><head><title>{self.phrase(1, 5)}</title></head><body>{''.join(before)}{body}{''.join(after)}{tail}"


def pages(n: int, seed: int = 1) -> list[str]:
    make = Maker(seed)
    return [make.page() for _ in range(n)]
