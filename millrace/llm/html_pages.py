"""Labelled pages to train main-text extraction from, composed from a seed.

Every page mixes an article (headings, paragraphs, lists, quotations, tables, figures, code) with
the parts around it (menus, headers, footers, sidebars, notices, adverts, forms, related links and
reader comments) in varying markup and order. ``page`` gives the HTML and, for each text run in
page order, whether it belongs to the article.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu la me ni or pa re si ta un ve wi".split()
#: Class names, by the part of a page that they are given to.
_NAMES = {
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "navigation", "toc", "pagination"],
    "header": ["header", "site-header", "masthead", "topbar", "branding", "logo"],
    "footer": ["footer", "site-footer", "copyright", "legal", "colophon", "bottom"],
    "sidebar": ["sidebar", "widget", "side", "aside", "related", "trending", "popular", "recommended", "more-stories"],
    "notice": ["cookie-notice", "consent", "banner", "alert", "notice", "gdpr", "popup", "paywall", "subscribe", "newsletter"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor"],
    "form": ["form", "search", "search-form", "login", "signup", "contact-form"],
    "comments": ["comments", "comment", "comment-list", "replies", "disqus", "discussion", "reader-comments"],
    "share": ["share", "social", "share-buttons", "tags", "byline-tools", "follow"],
    "article": ["article", "content", "post", "entry-content", "main", "story", "article-body", "post-body", "text", "page-content"],
    "plain": ["", "wrap", "container", "row", "col", "inner", "box", "section", "block", "grid"],
}


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[tuple[str, bool]] = []

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))

    def sentence(self, long: bool = True) -> str:
        s = self.words(self.r.randint(6, 22) if long else self.r.randint(1, 6))
        return s.capitalize() + (self.r.choice([".", ".", ".", "!", "?"]) if long or self.r.random() < 0.3 else "")

    def named(self, kind: str, tag: str = "div") -> str:
        r = self.r
        name = r.choice(_NAMES[kind])
        telling = tag in ("nav", "header", "footer", "aside", "form") or kind == "article" and tag in ("article", "main")
        if not name or telling and r.random() < 0.5:
            return f"<{tag}>"
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}{r.choice(["", "", " " + r.choice(_NAMES["plain"]) ])}">'

    def run(self, tag: str, text: str, content: bool) -> None:
        self.out.append(f"<{tag}>{text}</{tag.split()[0]}>")
        self.labels.append((text, content))

    def links(self, n: int) -> None:
        self.out.append("<ul>")
        for _ in range(n):
            t = self.words(self.r.randint(1, 4))
            self.out.append(f'<li><a href="/{t[:4]}">{t}</a></li>')
            self.labels.append((t, False))
        self.out.append("</ul>")

    def around(self, kind: str) -> None:
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "div")
        if r.random() < 0.45:
            tag = r.choice(["div", "section"]) if kind != "form" else "form"
        self.out.append(self.named(kind, tag))
        if kind in ("nav", "sidebar", "share") or (kind in ("header", "footer") and r.random() < 0.5):
            if r.random() < 0.4:
                self.run(r.choice(["h3", "p", "h2"]), self.words(r.randint(1, 3)), False)
            self.links(r.randint(2, 9))
        if kind == "comments":
            self.run("h3", self.words(2), False)
            for _ in range(r.randint(1, 5)):
                inner = r.choice(["div", "div", "li", "article"])
                self.out.append(self.named("comments", inner))
                self.run("p", " ".join(self.sentence() for _ in range(r.randint(1, 3))), False)
                self.out.append(f"</{inner}>")
        elif kind == "form":
            self.run("label", self.words(r.randint(1, 3)), False)
            self.run("button", self.words(1), False)
        elif kind not in ("nav", "share"):
            for _ in range(r.randint(1, 2)):
                self.run(r.choice(["p", "div", "p"]), self.sentence(r.random() < 0.6) if kind != "footer" else "&copy; " + self.words(r.randint(2, 6)), False)
        if kind in ("ad", "footer", "notice") and r.random() < 0.4:
            t = self.sentence(r.random() < 0.5)
            self.out.append(t)
            self.labels.append((t, False))
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        r = self.r
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        self.out.append(self.named("article", tag))
        if r.random() < 0.8:
            self.run("h1", self.sentence(False), True)
        brief = r.random() < 0.25  # many short paragraphs
        for _ in range(r.randint(10, 80) if brief else r.randint(1, 12)):
            x = r.random()
            if brief and x < 0.9:
                self.run("p", self.sentence(r.random() < 0.3), True)
            elif x < 0.62:
                text = " ".join(self.sentence() for _ in range(r.randint(1, 6))) if r.random() < 0.8 else self.words(r.randint(1, 60))
                if r.random() < 0.2:
                    text = f'{text} <a href="/x">{self.words(2)}</a> {self.sentence()}'
                self.run("p", text, True)
            elif x < 0.72:
                self.run(r.choice(["h2", "h3"]), self.sentence(False), True)
            elif x < 0.80:
                self.out.append(r.choice(["<ul>", "<ul class='list'>"]))
                for _ in range(r.randint(2, 5)):
                    self.run("li", self.sentence(r.random() < 0.7), True)
                self.out.append("</ul>")
            elif x < 0.85:
                self.out.append("<blockquote>")
                self.run("p", self.sentence(), True)
                self.out.append("</blockquote>")
            elif x < 0.89:
                self.out.append("<table>")
                for _ in range(r.randint(1, 4)):
                    self.out.append("<tr>")
                    for _ in range(2):
                        self.run("td", self.words(r.randint(1, 3)), True)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif x < 0.92:
                self.out.append("<figure><img src='x'>")
                self.run("figcaption", self.sentence(), True)
                self.out.append("</figure>")
            elif x < 0.94:
                self.run("pre", self.words(6), True)
            else:
                self.around(r.choice(["ad", "share", "form", "notice"]))
        self.out.append(f"</{tag}>")


def page(seed: int) -> tuple[str, list[tuple[str, bool]]]:
    """(HTML, runs as (text with markup, belongs to the article))."""
    p = _Page(seed)
    r = p.r
    p.out.append("<html><head><title>x</title></head><body>")
    wrap = r.random() < 0.5
    if wrap:
        p.out.append(p.named("plain"))
    before = r.sample(["header", "nav", "notice", "ad", "sidebar", "form"], r.randint(0, 4))
    after = r.sample(["footer", "comments", "sidebar", "ad", "share", "nav", "notice"], r.randint(0, 5))
    for kind in before:
        p.around(kind)
    p.article()
    for kind in after:
        p.around(kind)
    if wrap:
        p.out.append("</div>")
    p.out.append("</body></html>")
    return "".join(p.out), p.labels
