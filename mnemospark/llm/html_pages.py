"""Labelled pages from which the extraction model is trained.

Pages are composed from the layouts, regions and vocabularies below, with a label for
each text node: 1 for the article, 0 for the rest. They are the training set, made by a
fixed seed; none of the tables' pages is read for it.
"""

from __future__ import annotations

import random

# Names that site builders give to the regions of a page.
CONTENT_NAMES = ("article", "article-body", "content", "entry-content", "post", "post-content", "main", "main-content", "story", "story-body", "text", "page-content", "body-text")
REGION_NAMES = {
    "nav": ("nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "pagination", "toc"),
    "header": ("header", "masthead", "site-header", "top", "banner-top", "logo"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "legal", "colophon"),
    "aside": ("sidebar", "aside", "related", "widget", "recommended", "more-stories", "trending", "share", "social", "tags"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"),
    "notice": ("cookie", "cookie-banner", "consent", "notice", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe"),
    "form": ("search", "login", "signup", "form", "contact-form", "subscribe-form"),
    "comments": ("comments", "comment-list", "comment", "reader-comments", "discussion", "replies", "disqus"),
}
TAGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "ad": ("div", "aside", "section"), "notice": ("div", "section", "dialog"), "form": ("form", "div"), "comments": ("section", "div", "ol")}
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam".split()

Node = tuple[str, dict[str, str], list]


class _Maker:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.rng.choice(WORDS) for _ in range(self.rng.randint(lo, hi))).capitalize()

    def sentence(self) -> str:
        text = ". ".join(self.words(2, 15) for _ in range(self.rng.randint(1, 8))) + "."
        return text.replace(" ", ", ", 1) if self.rng.random() < 0.5 else text

    def links(self, n: int) -> list[Node]:
        return [("li", {}, [("a", {"href": "/x"}, [self.words(1, 3)])]) for _ in range(n)]

    def named(self, tag: str, names: tuple[str, ...], children: list) -> Node:
        rng, attrs = self.rng, {}
        if tag in ("div", "section", "ul", "ol", "dialog") or rng.random() < 0.4:
            attrs[rng.choice(("class", "class", "id"))] = rng.choice(names)
        return (tag, attrs, children)

    def region(self, kind: str) -> Node:
        rng, tag = self.rng, self.rng.choice(TAGS[kind])
        if kind == "nav":
            items = self.links(rng.randint(2, 10))
            kids = items if tag == "ul" else [("ul", {}, items)] if rng.random() < 0.8 else [i[2][0] for i in items]
        elif kind == "form":
            kids = [("label", {}, [self.words(1, 2)]), ("input", {"type": "text"}, []), ("button", {}, [self.words(1, 2)])]
            if tag == "div":
                kids = [("form", {}, kids)]
        elif kind == "comments":
            each = [("li" if tag == "ol" else "div", {"class": "comment"}, [("p", {}, [self.sentence()])]) for _ in range(rng.randint(1, 6))]
            kids = each if tag == "ol" else [("h3", {}, [self.words(1, 2)]), *each]
        elif kind == "header":
            kids = [(rng.choice(("h1", "div", "p")), {}, [("a", {"href": "/"}, [self.words(1, 4)])]), self.words(2, 6)]
        elif kind == "footer":
            kids = [rng.choice(("© 2024 ", "Copyright ", "")) + self.words(1, 12) + rng.choice(("", ".")), *([("ul", {}, self.links(3))] if rng.random() < 0.4 else [])]
        elif kind == "ad":
            kids = [self.sentence()] if rng.random() < 0.6 else [("a", {"href": "/ad"}, [self.words(2, 10)])]
        elif kind == "notice":
            kids = [("p", {}, [self.sentence()]), ("button", {}, [self.words(1, 2)])] if rng.random() < 0.7 else [self.sentence()]
        else:
            kids = [("h3", {}, [self.words(1, 3)]), ("ul", {}, self.links(rng.randint(2, 6)))] if rng.random() < 0.6 else [("p", {}, [self.sentence()])]
        return self.named(tag, REGION_NAMES[kind], kids)

    def inline(self) -> list:
        rng, out = self.rng, [self.sentence()]
        for _ in range(rng.choice((0, 0, 1, 2))):
            tag = rng.choice(("b", "i", "em", "strong", "a", "span", "code"))
            out += [(tag, {"href": "/in"} if tag == "a" else {}, [self.words(1, 6)]), " " + self.sentence()]
        return out if rng.random() < 0.8 else [("b", {}, out)]

    def article(self) -> Node:
        rng = self.rng
        kids: list = [(rng.choice(("h1", "h1", "h2")), {}, [self.words(2, 12)])] if rng.random() < 0.85 else []
        if rng.random() < 0.15:
            kids = [("header", {}, kids)]
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.68:
                kids.append(("p", {}, self.inline()))
            elif kind < 0.76:
                kids.append((rng.choice(("h2", "h3")), {}, [self.words(1, 8)]))
            elif kind < 0.84:
                kids.append((rng.choice(("ul", "ol")), {}, [("li", {}, [self.sentence()]) for _ in range(rng.randint(1, 5))]))
            elif kind < 0.9:
                kids.append(("blockquote", {}, [("p", {}, [self.sentence()])]))
            elif kind < 0.94:
                kids.append(("table", {}, [("tr", {}, [("td", {}, [self.words(1, 4)]) for _ in range(3)]) for _ in range(rng.randint(1, 3))]))
            elif kind < 0.97:
                kids.append(("figure", {}, [("img", {}, []), ("figcaption", {}, [self.words(2, 10)])]))
            else:
                kids.append(("pre", {}, [self.words(3, 12)]))
        tag = rng.choice(("article", "article", "main", "div", "section"))
        return self.named(tag, CONTENT_NAMES, kids)

    def page(self) -> list[tuple[Node, int]]:
        """The body's children with their labels; a region may also stand inside the article."""
        rng = self.rng
        main = self.article()
        for _ in range(rng.choice((0, 0, 1))):
            main[2].insert(rng.randint(0, len(main[2])), ("!", {}, [self.region(rng.choice(("ad", "aside", "form", "comments", "notice")))]))
        before = [self.region(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.45]
        after = [self.region(k) for k in ("comments", "aside", "ad", "footer", "form", "notice") if rng.random() < 0.45]
        out = [*((n, 0) for n in before), (main, 1), *((n, 0) for n in after)]
        if rng.random() < 0.35:
            lo = rng.randint(0, out.index((main, 1)))
            hi = rng.randint(out.index((main, 1)) + 1, len(out))
            wrap = ("div", {"class": rng.choice(("container", "wrapper", "page", "row", "layout"))}, [("!" if y == 0 else "=", {}, [n]) for n, y in out[lo:hi]])
            out[lo:hi] = [(wrap, 2)]
        return out


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page's HTML and the label of each of its texts but those of buttons, in order."""
    labels: list[int] = []

    def show(node: Node | str, y: int) -> str:
        if isinstance(node, str):
            if y >= 0:
                labels.append(y)
            return node
        tag, attrs, kids = node
        if tag in ("!", "="):
            return "".join(show(k, int(tag == "=")) for k in kids)
        head = f"<{tag}" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">"
        return head if tag in ("img", "input") else head + "".join(show(k, -1 if tag == "button" else y) for k in kids) + f"</{tag}>"

    body = "".join(show(n, y) for n, y in _Maker(seed).page())
    return f"<html><head><title>{seed}</title></head><body>{body}</body></html>", labels
