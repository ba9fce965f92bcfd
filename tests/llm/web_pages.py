"""Pages written another way than the practice pages are, with their main text, and a reader that isn't the operator's."""

from __future__ import annotations

import random
from html import escape
from html.parser import HTMLParser

LETTERS = "aabcdeeefghiijklmnooprstuuvwyz"


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9)))


def sentence(rng: random.Random, least: int = 6, most: int = 22) -> str:
    words = [_word(rng) for _ in range(rng.randint(least, most))]
    if len(words) > 9:
        words[len(words) // 2] += ","
    return (" ".join(words)).capitalize() + rng.choice("...!?")


def paragraph(rng: random.Random) -> str:
    return " ".join(sentence(rng) for _ in range(rng.randint(2, 6)))


def name(rng: random.Random) -> str:
    """A class as sites have them: of a framework, of a page builder, or made up."""
    return rng.choice([
        lambda: rng.choice(["wp-block-paragraph", "t1", "body copy", "Text_p__3kd", "css-1x2y3z", "col-md-8 px-4", "lead", "has-text", "mb-4 leading-relaxed", "paragraph", "it's", "elementor-widget", "rich text"]),
        lambda: f"{_word(rng)}-{_word(rng)}", lambda: _word(rng), lambda: f"{_word(rng)}__{_word(rng)}--{rng.randint(1, 99)} {_word(rng)}",
    ])()


def _tag(tag: str, inner: str, marks: str | None = None) -> str:
    return f'<{tag} class="{escape(marks)}">{inner}</{tag}>' if marks else f"<{tag}>{inner}</{tag}>"


def _links(rng: random.Random, n: int, most: int = 2) -> str:
    return "".join(_tag("li", f'<a href="/{_word(rng)}">{" ".join(_word(rng) for _ in range(rng.randint(1, most)))}</a>') for _ in range(n))


FORMS = ("article", "classed", "br", "bare", "untagged", "table", "unwrapped", "nested")


def page(form: str, seed: int, marks: str | None = None) -> tuple[str, list[str]]:
    """A page of the form, and its main text by block."""
    rng = random.Random(f"{form} {seed}")
    title = sentence(rng, 3, 8).rstrip(".!?")
    body = [paragraph(rng) for _ in range(rng.randint(3, 9))]
    if form == "untagged":
        return "\n".join(body), [" ".join(body)]
    menu = rng.choice([_tag("nav", _tag("ul", _links(rng, rng.randint(3, 8)))), _tag("div", _tag("ul", _links(rng, rng.randint(3, 8))), rng.choice(["menu", "nav-bar", "topnav"]))])
    side = rng.choice(["", _tag("div", _tag("h3", sentence(rng, 1, 3)[:-1]) + _tag("ul", _links(rng, rng.randint(3, 6), 6))), _tag("aside", _tag("h4", "Related") + _tag("p", sentence(rng, 3, 8)))])
    foot = _tag("footer", _tag("p", f"Copyright {rng.randint(1999, 2030)} {_word(rng)}. All rights reserved.") + _tag("p", '<a href="/t">Terms</a> <a href="/p">Privacy</a>'))
    notice = rng.choice(["", _tag("div", "We use cookies. Accept all or read our privacy policy.", "cookie-banner"), _tag("div", "Subscribe to our newsletter!", "newsletter")])
    mark = lambda: marks or name(rng)
    paragraphs = "".join(_tag("p", escape(t)) for t in body)
    if form == "article":
        main = _tag("article", _tag("h1", title) + paragraphs)
    elif form == "classed":  # every paragraph and the article have classes of any kind
        main = _tag("article", _tag("h1", title, mark()) + "".join(_tag("p", escape(t), mark()) for t in body), mark())
    elif form == "br":
        main, body = _tag("div", title + "<br><br>" + "<br><br>".join(map(escape, body)), marks), [" ".join([title, *body])]
        return f"<html><body>{notice}{menu}{main}{side}{foot}</body></html>", body
    elif form == "bare":
        main, body = _tag("h1", title) + "<br><br>".join(map(escape, body)), [title, " ".join(body)]
        return f"<html><body>{notice}{menu}{main}{foot}</body></html>", body
    elif form == "table":
        cells = _tag("td", _tag("ul", _links(rng, 4))) + _tag("td", _tag("h1", title) + paragraphs, marks)
        return f"<html><body>{notice}<table><tr>{cells}</tr></table>{foot}</body></html>", [title, *body]
    elif form == "unwrapped":
        main = _tag("h1", title) + paragraphs
    else:
        main = _tag("div", _tag("div", _tag("div", _tag("h2", title), mark()) + _tag("div", "".join(_tag("div", escape(t), mark()) for t in body), mark()), mark()), mark())
    return f"<!doctype html><html><head><title>{title}</title></head><body>{notice}{menu}{main}{side}{foot}</body></html>", [title, *body]


class Reader(HTMLParser):
    """The text inside the first element of a name, by block element, read with the standard library."""

    BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol td tr table blockquote pre figure figcaption section article header footer aside form nav main body".split())
    SKIPPED = frozenset("script style".split())

    def __init__(self, element: str):
        super().__init__(convert_charrefs=True)
        self.element, self.depth, self.skipped, self.out, self.words = element, 0, 0, [], []

    def _end_block(self):
        if text := " ".join("".join(self.words).split()):
            self.out.append(text)
        self.words.clear()

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self._end_block()
        self.depth += tag == self.element
        self.skipped += tag in self.SKIPPED
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self._end_block()
        self.depth -= tag == self.element
        self.skipped -= tag in self.SKIPPED

    def handle_data(self, data):
        if self.depth > 0 and not self.skipped:
            self.words.append(data)

    @classmethod
    def text(cls, element: str, page: str) -> str:
        reader = cls(element)
        reader.feed(page)
        reader.close()
        reader._end_block()
        return "\n".join(reader.out)
