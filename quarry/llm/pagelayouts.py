"""Training pages for the HTML extractor.

The ``pages`` table has no labels, so the extractor learns from layouts: pages
put together here from parts whose role is known, with the words of a bounded
sample of the real pages.  Each part is an element with a role -- article,
menu, header, footer, sidebar, advert, notice, form, comments -- under a name
that such parts commonly have, or under none at all; parts stand side by side,
in wrappers, or inside the article."""

from __future__ import annotations

import random

# Names of page parts, as sites commonly have them.
NAMES = {
    "article": ["<article>", "<main>", '<div class="content">', '<div class="post">',
                '<div id="main-content">', '<div class="entry-content">', '<section class="story">',
                '<div class="article-body">', '<div class="text">', "<div>", "<section>",
                '<article class="post hentry">', '<div role="main">', '<div itemprop="articleBody">'],
    "menu": ["<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navigation">',
             '<div class="breadcrumb">', "<div>", "<ul>", '<div role="navigation">', '<nav class="toc">'],
    "header": ["<header>", '<div class="header">', '<div id="masthead">', '<div class="top-bar">', "<div>"],
    "footer": ["<footer>", '<div class="footer">', '<div id="colophon">', '<div class="copyright">',
               "<div>", '<footer class="site-footer">'],
    "sidebar": ["<aside>", '<div class="sidebar">', '<div class="widget">', '<div class="related">',
                '<div id="secondary">', '<section class="recommended">'],
    "advert": ['<div class="ad">', '<div class="advert">', '<div class="sponsored">',
               '<div class="banner">', '<div id="ad-top">', '<aside class="promo">', '<p class="advertisement">'],
    "notice": ['<div class="cookie-notice">', '<div class="alert">', '<div id="consent">',
               '<div class="notice">', '<div class="newsletter">', '<div class="popup modal">',
               '<div role="dialog">'],
    "form": ["<form>", '<form class="search">', '<div class="subscribe">', '<div class="login">',
             '<form id="contact">'],
    "comments": ['<section class="comments">', '<div id="comments">', '<div class="comment-list">',
                 '<ol class="commentlist">', '<div class="responses">', '<div class="replies">',
                 '<div id="disqus_thread">'],
}
WRAPPERS = ["<div>", '<div class="wrapper">', '<div class="container">', '<div id="page">', "<section>",
            '<div class="row">', '<div class="site">']
BEFORE = ["header", "menu", "advert", "notice", "sidebar"]
AFTER = ["comments", "sidebar", "advert", "form", "notice", "footer", "menu"]
WITHIN = ["advert", "form", "comments", "notice", "sidebar", "menu"]
NOISE = ["box", "col-8", "c12", "x-7", "module", "inner"]


def _tag(start: str) -> str:
    return start[1:-1].split()[0]


class Layouts:
    """Random pages; an element of known role has the attribute data-role."""

    def __init__(self, words: list[str], seed: int):
        self.rnd = random.Random(seed)
        self.words = words or ["text"]

    def sentence(self, lo: int = 4, hi: int = 18) -> str:
        w = self.rnd.choices(self.words, k=self.rnd.randint(lo, hi))
        return " ".join(w).capitalize() + self.rnd.choice([".", ".", ".", "", "?", "!"])

    def prose(self, hi: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rnd.randint(1, hi)))

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/x">{self.sentence(1, 3)}</a></li>' for _ in range(n))

    def noise(self) -> str:
        return f' class="{self.rnd.choice(NOISE)}"' if self.rnd.random() < 0.15 else ""

    def paragraph(self) -> str:
        r = self.rnd.random()
        if r < 0.55:
            text = self.prose()
            if self.rnd.random() < 0.2:
                text += f' <a href="/y">{self.sentence(1, 4)}</a> {self.sentence()}'
            return f"<p{self.noise()}>{text}" + self.rnd.choice(["</p>", "</p>", "<br>"])
        if r < 0.65:
            return f"<p>{self.rnd.choice([self.sentence(1, 2), self.sentence(1, 6)])}</p>"
        if r < 0.75:
            return f"<h2>{self.sentence(1, 7)}</h2>"
        if r < 0.83:
            return "<ul>" + "".join(f"<li>{self.sentence(2, 12)}</li>" for _ in range(self.rnd.randint(2, 6))) + "</ul>"
        if r < 0.88:
            return f"<blockquote><p>{self.prose(3)}</p></blockquote>"
        if r < 0.92:
            return f"<div{self.noise()}>{self.prose()}</div>"
        if r < 0.96:
            cells = "".join(f"<tr><td>{self.sentence(1, 2)}</td><td>{self.sentence(1, 4)}</td></tr>" for _ in range(3))
            return f"<table>{cells}</table>"
        return f"<figure><img src=i.png><figcaption>{self.sentence(2, 8)}</figcaption></figure>"

    def body_of(self, role: str) -> str:
        rnd = self.rnd
        if role == "menu":
            return f"<ul>{self.links(rnd.randint(2, 9))}</ul>" if rnd.random() < 0.7 else self.links(rnd.randint(2, 6))
        if role == "header":
            return f"<h1>{self.sentence(1, 3)}</h1>" * (rnd.random() < 0.5) + f"<p>{self.sentence(1, 6)}</p>"
        if role == "footer":
            return rnd.choice([f"&copy; {self.sentence(1, 4)} &middot; {self.prose(2)}",
                               f"<p>&copy; {self.sentence(2, 6)}</p><ul>{self.links(3)}</ul>"])
        if role == "sidebar":
            return f"<h3>{self.sentence(1, 3)}</h3><ul>{self.links(rnd.randint(2, 6))}</ul>" + \
                f"<p>{self.prose(2)}</p>" * (rnd.random() < 0.4)
        if role == "form":
            return f"<label>{self.sentence(1, 3)}</label><input name=q><button>{self.sentence(1, 2)}</button>" + \
                f"<p>{self.sentence()}</p>" * (rnd.random() < 0.3)
        if role == "comments":
            one = lambda: (f'<div class="{rnd.choice(["comment", "comment-body", "reply", "user-post"])}">'  # noqa: E731
                           f"<b>{self.sentence(1, 2)}</b><p>{self.prose(4)}</p></div>")
            return f"<h3>{self.sentence(1, 2)}</h3>" + "".join(one() for _ in range(rnd.randint(1, 5)))
        return rnd.choice([self.prose(3), f"<p>{self.prose(2)}</p>",
                           f'<p>{self.sentence()}</p><a href="/b">{self.sentence(1, 3)}</a>'])

    def part(self, role: str) -> str:
        start = self.rnd.choice(NAMES[role])
        if role != "article":
            body = self.body_of(role)
        else:
            pieces = [self.paragraph() for _ in range(self.rnd.choice([1, 2, 3, 5, 8, 12, 20]))]
            if self.rnd.random() < 0.7:
                pieces.insert(0, f"<h1>{self.sentence(2, 9)}</h1>")
            if self.rnd.random() < 0.35:
                pieces.insert(self.rnd.randrange(len(pieces) + 1), self.part(self.rnd.choice(WITHIN)))
            body = "".join(pieces)
        return f'{start[:-1]} data-role="{role}">{body}</{_tag(start)}>'

    def page(self) -> str:
        rnd = self.rnd
        parts = [self.part(r) for r in BEFORE if rnd.random() < 0.45]
        middle = [self.part("article")] + [self.part(r) for r in AFTER if rnd.random() < 0.35]
        if rnd.random() < 0.5:
            start = rnd.choice(WRAPPERS)
            middle = [f"{start}{''.join(middle)}</{_tag(start)}>"]
        inner = "".join(parts + middle) + self.part("footer") * (rnd.random() < 0.7)
        if rnd.random() < 0.3:
            start = rnd.choice(WRAPPERS)
            inner = f"{start}{inner}</{_tag(start)}>"
        return (f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{}}</style></head>"
                f"<body>{inner}</body></html>")
