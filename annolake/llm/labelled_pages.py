"""Labelled pages to train block labelling on: written out by rules over common page layouts, so that each block's
label (1: main text) is known. Deterministic; ``PAGES`` bounds their number."""

from __future__ import annotations

import random

PAGES = 600
_SYLLABLES = "an ar ba be ca ce co da de di en er es fa fi ga ge in is ka la le li lo ma mi mo na ne no on or pa pe po ra re ri ro sa se si so ta te ti to un ur va ve vi é ä ü ñ".split()
_NAV = ("nav", "menu", "navbar", "navigation", "main-menu", "topnav", "breadcrumbs", "site-nav", "nav-links", "tabs", "toolbar")
_HEAD = ("header", "site-header", "masthead", "top-bar", "banner", "branding", "page-header", "logo")
_FOOT = ("footer", "site-footer", "bottom", "colophon", "legal", "copyright", "page-footer", "foot")
_SIDE = ("sidebar", "aside", "widget", "related", "recommended", "more-stories", "right-rail", "secondary", "tag-cloud", "popular", "trending", "side")
_NOTICE = ("cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "message", "toast")
_AD = ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "promotion", "banner-ad", "sponsor", "adsbygoogle")
_FORM = ("newsletter", "subscribe", "signup", "search-form", "login", "contact-form", "subscription")
_COMMENT = ("comments", "comment-list", "comment", "discussion", "responses", "disqus", "reader-comments", "replies", "reply")
_SHARE = ("share", "social", "share-buttons", "social-links", "follow-us")
_MAIN = ("article", "content", "post", "entry-content", "main-content", "story", "article-body", "post-body", "text", "prose", "entry", "page-content")
_COOKIE = ("We use cookies to improve your experience.", "This site uses cookies. By continuing you accept our policy.", "Accept all", "Cookie settings", "Please enable JavaScript", "Diese Website verwendet Cookies.", "Nous utilisons des cookies.", "Usamos cookies.")


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[tuple[str, int | None]] = []  # source, label of the block that its text makes; None: markup alone

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self) -> str:
        def sentence() -> str:
            return self.phrase(1, 22).capitalize() + self.r.choice("...,?!").replace(",", ".")

        count = self.r.choice((1, 1, 2, 3, 4, 6, 9))
        text = " ".join(sentence() for _ in range(count))
        if self.r.random() < 0.25:
            words = text.split(" ")
            i = self.r.randrange(len(words))
            words[i] = f"{self.r.choice(('<a href=/x>', '<b>', '<em>', '<span>'))}{words[i]}"
            words[i] += {"<a": "</a>", "<b": "</b>", "<e": "</em>", "<s": "</span>"}[words[i][:2]]
            text = " ".join(words)
        return text

    def raw(self, source: str) -> None:
        self.out.append((source, None))

    def block(self, source: str, label: int) -> None:
        self.out.append((source, label))

    def open(self, tags, classes, bare: float = 0.2) -> str:
        tag, name = self.r.choice(tags), self.r.choice(classes)
        attrs = "" if self.r.random() < bare and tag not in ("div", "section", "ul", "p") else self.r.choice((f' class="{name}"', f" id='{name}'", f' class="x1 {name} box"', f' class="{name}-wrap"'))
        self.raw(f"<{tag}{attrs}>")
        return f"</{tag}>"

    def links(self, n: int) -> None:
        plain = self.r.random() < 0.2
        listed = self.r.random() < 0.8
        self.raw("<ul>" if listed else "")
        for _ in range(n):
            text = self.r.choice((self.phrase(1, 3), self.phrase(1, 1).capitalize(), self.phrase(3, 9)))
            text = text if plain else f'<a href="/{self.word()}">{text}</a>'
            self.block(f"<li>{text}</li>" if listed else f"<div>{text}</div>", 0)
        self.raw("</ul>" if listed else "")

    def nav(self) -> None:
        end = self.open(("nav", "div", "ul", "header"), _NAV)
        self.links(self.r.randint(2, 9))
        self.raw(end)

    def header(self) -> None:
        end = self.open(("header", "div", "section"), _HEAD)
        for _ in range(self.r.randint(1, 3)):
            self.block(self.r.choice(("<div>{}</div>", "<p>{}</p>", "<h1>{}</h1>", '<a href="/"><div>{}</div></a>')).format(self.phrase(1, 7).capitalize()), 0)
        if self.r.random() < 0.5:
            self.links(self.r.randint(2, 6))
        self.raw(end)

    def footer(self) -> None:
        end = self.open(("footer", "div", "section"), _FOOT, 0.5)
        if self.r.random() < 0.4:
            self.links(self.r.randint(2, 6))
        mark = self.r.choice(("&copy; 2021 {}", "Copyright {} 2019", "&copy; {}.example.org &middot; " + self.prose(), "{} All rights reserved.", self.prose() + " {}"))
        self.block(self.r.choice(("<p>{}</p>", "<div>{}</div>", "{}")).format(mark.format(self.word())), 0)
        self.raw(end)

    def side(self) -> None:
        end = self.open(("aside", "div", "section"), _SIDE)
        self.block(f"<h3>{self.phrase(1, 3).capitalize()}</h3>", 0)
        if self.r.random() < 0.6:
            self.links(self.r.randint(2, 8))
        else:
            for _ in range(self.r.randint(1, 3)):
                self.block(f"<p>{self.prose()}</p>", 0)
        self.raw(end)

    def boxed(self, tags, classes, text) -> None:
        end = self.open(tags, classes, 0)
        for _ in range(self.r.choice((1, 1, 1, 2))):
            self.block(self.r.choice(("{}", "<p>{}</p>", "<div>{}</div>", "<span>{}</span>")).format(text()), 0)
            self.raw("<hr>")
        self.raw(end)

    def notice(self) -> None:
        self.boxed(("div", "section", "aside"), _NOTICE, lambda: self.r.choice((self.r.choice(_COOKIE), self.prose())))

    def ad(self) -> None:
        self.boxed(("div", "aside", "section"), _AD, lambda: self.r.choice((self.prose(), self.phrase(1, 4), f'<a href="/ad">{self.phrase(2, 6)}</a>')))

    def share(self) -> None:
        end = self.open(("div", "ul"), _SHARE)
        self.links(self.r.randint(2, 4))
        self.raw(end)

    def form(self) -> None:
        self.raw(self.r.choice(("<form>", f'<form class="{self.r.choice(_FORM)}">', f'<div class="{self.r.choice(_FORM)}"><form>')))
        for _ in range(self.r.randint(1, 3)):
            self.block(self.r.choice(("<label>{}</label>", "<p>{}</p>", "<button>{}</button>", "<div>{}</div>", "<legend>{}</legend>", "<option>{}</option>")).format(self.r.choice((self.phrase(1, 4), self.prose()))), 0)
        self.raw("</form>")

    def comments(self) -> None:
        end = self.open(("section", "div", "ol"), _COMMENT, 0)
        self.block(f"<h3>{self.phrase(1, 3)}</h3>", 0)
        for _ in range(self.r.randint(1, 6)):
            inner = self.open(("div", "li", "article"), _COMMENT, 0.3)
            self.block(f"<p>{self.phrase(1, 2)}</p>", 0)
            for _ in range(self.r.randint(1, 3)):
                self.block(f"<p>{self.prose()}</p>", 0)
            self.raw(inner)
        self.raw(end)

    def main(self) -> None:
        ends = []
        if self.r.random() < 0.3:
            ends.append(self.open(("main", "div"), _MAIN, 0.6))
        ends.append(self.open(("article", "article", "div", "section", "main", "td"), _MAIN, 0.6))
        title = self.phrase(2, 10).capitalize() + "."
        if self.r.random() < 0.85:
            self.block(f"<h1>{title}</h1>", 1)
        unclosed = self.r.random() < 0.35
        for _ in range(self.r.choice((1, 2, 3, 4, 6, 9, 14, 25))):
            kind = self.r.random()
            if kind < 0.66:
                self.block(f"<p>{self.prose()}" + ("" if unclosed else "</p>"), 1)
            elif kind < 0.74:
                self.block(f"<h{self.r.randint(2, 4)}>{self.phrase(1, 6).capitalize()}</h2>".replace("</h2>", ""), 1)
                self.raw("<p>")
            elif kind < 0.8:
                self.block(f"<p><b>{self.r.choice((title, self.phrase(1, 4).capitalize() + '.'))}<br>", 1)
                self.raw("<p>")
            elif kind < 0.85:
                self.raw("<ul>")
                for _ in range(self.r.randint(1, 5)):
                    self.block(f"<li>{self.r.choice((self.prose(), self.phrase(1, 4)))}</li>", 1)
                self.raw("</ul>")
            elif kind < 0.89:
                self.raw("<blockquote>")
                self.block(f"<p>{self.prose()}</p>", 1)
                self.raw("</blockquote>")
            elif kind < 0.91:
                self.block(f"<pre>{self.phrase(3, 20)}</pre>", 1)
            elif kind < 0.93:
                self.raw("<table><tr>")
                for _ in range(self.r.randint(2, 6)):
                    self.block(f"<td>{self.phrase(1, 3)}</td>", 1)
                self.raw("</tr></table>")
            elif kind < 0.95:
                self.block(f"<figure><figcaption>{self.phrase(2, 9)}.</figcaption></figure>", 1)
            else:
                self.r.choice((self.ad, self.side, self.form, self.share, self.notice, self.ad))()
        if self.r.random() < 0.12:
            self.comments()
        for end in reversed(ends):
            self.raw(end)

    def made(self) -> list[tuple[str, int | None]]:
        self.raw('<!DOCTYPE html><html><head><meta charset="utf-8"><title>t</title><style>p{}</style></head><body>')
        for part, often in ((self.notice, 0.25), (self.header, 0.4), (self.nav, 0.8), (self.ad, 0.4), (self.side, 0.2), (self.form, 0.15)):
            if self.r.random() < often:
                part()
        self.main()
        for part, often in ((self.share, 0.2), (self.comments, 0.35), (self.side, 0.3), (self.ad, 0.2), (self.form, 0.25), (self.nav, 0.15), (self.footer, 0.85), (self.notice, 0.15)):
            if self.r.random() < often:
                part()
        return self.out


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """Source and the labels of its leaf blocks in order."""
    made = _Page(seed).made()
    return "".join(s for s, _ in made), [label for _, label in made if label is not None]
