"""Leaf blocks of web pages, and labelled practice pages for the block labeller."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

# Element names by how they shape text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object head title select option textarea button canvas audio video datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
#: Block elements before which an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
SCOPE = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote figure".split())

#: A tag ends at the first > outside a quoted value; quotes count only after an equals sign.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>=]|=)*+)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def _attributes(raw: str) -> tuple[str, ...]:
    if "=" not in raw:
        return ()
    return tuple(p for m in _NAMES.finditer(raw) for p in _PARTS.findall((m[1] or m[2] or m[3] or "").lower()))


def blocks(page: str) -> list[Block]:
    """The visible text of the page by block, in page order: references decoded, white space made one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    words: list[str] = []
    state = {"linked": 0, "hidden": 0, "links": 0}

    def add(raw: str) -> None:
        if state["hidden"] or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        words.append(text)
        if state["links"]:
            state["linked"] += len(text)

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append(Block(tuple(p for name, marks in stack if name not in INLINE for p in (name, *marks)), text, state["linked"]))
            words.clear()
        state["linked"] = 0

    def pop(depth: int) -> None:
        for name, _ in stack[depth:]:
            state["hidden"] -= name in HIDDEN
            state["links"] -= name == "a"
        del stack[depth:]

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE:
            flush()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                pop(depth)
            continue
        if name == "br":
            add(" ")
        if name in VOID or m[3].endswith("/"):
            continue
        ends = CLOSES.get(name, ()) or (("p",) if name in ENDS_P else ())
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    # Inline elements left open in what ends here end with it.
                    pop(i)
                    break
                if stack[i][0] in SCOPE and stack[i][0] not in ends:
                    break
        stack.append((name, _attributes(m[3])))
        state["hidden"] += name in HIDDEN
        state["links"] += name == "a"
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


# Practice pages -----------------------------------------------------------------------------------------------------

# Names and words common on web pages.
MENU = "home about contact products services news blog login register search archive help more sitemap".split()
NOTICE = "we use cookies accept all privacy policy subscribe newsletter sign up consent settings".split()
ADVERT = "sponsored advertisement buy now sale offer discount shop free deal click here".split()
FOOT = "copyright all rights reserved terms privacy imprint contact powered by".split()
COMMENT = "reply comment says report thanks great post agree posted ago like".split()
FORM = "name email address message send submit required phone password".split()
BODY_NAMES = ("content", "main", "article body", "post content", "entry content", "story", "text", "page body")
#: Names that tell nothing, as frameworks and page builders give them to any element.
PLAIN_NAMES = ("row", "col", "container", "wrapper", "inner", "box", "block", "section", "group", "text", "lead", "body copy", "wp block", "flex", "p", "mb px", "item", "title", "css x y z", "t", "builder widget")
AD_NAMES = ("ad", "ads", "advert", "banner ad", "sponsored", "promo")
NOTICE_NAMES = ("cookie", "cookie notice", "notice", "banner", "consent", "alert", "newsletter", "popup")
COMMENTS_NAMES = ("comments", "comment list", "responses", "discussion", "reader comments")
COMMENT_NAMES = ("comment", "comment item", "reply", "comment body")
MENU_NAMES = (("nav", ""), ("nav", ""), ("div", "menu"), ("div", "navbar nav"), ("nav", "breadcrumb"))
SIDE_NAMES = ("sidebar", "widget", "related", "aside", "side column", "recommended", "trending", "tags")
#: Names of elements and words of classes that may tell what a block is; any other name is not read.
TELLING = frozenset(" ".join((*BODY_NAMES, *SIDE_NAMES, *AD_NAMES, *NOTICE_NAMES, *COMMENTS_NAMES, *COMMENT_NAMES, *(n for _, n in MENU_NAMES), "header footer")).split())
READ = TELLING | ENDS_P | SCOPE | frozenset(CLOSES) | frozenset(("p", "tbody", "thead", "figcaption", "details", "summary", "hgroup", "search", "legend", "label", "caption"))


def _invented(rng: random.Random, n: int, style: int) -> str:
    out = []
    for _ in range(n):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéöüñ") for _ in range(rng.randint(1, 11)))
        word = word.upper() + "!!" if style == 1 else word + rng.choice(("***", "###", "$$$", "%%%", "&amp;&amp;&amp;")) if style == 2 else word
        out.append(word.capitalize() if rng.random() < 0.12 else word)
        if rng.random() < 0.12:
            out[-1] += rng.choice(".,.;")
        if style == 3 and rng.random() < 0.5:
            out.append("|")
    return " ".join(out)


def _marks(rng: random.Random) -> str:
    """A class that tells nothing: of a framework or made up."""
    made = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9)))
    return rng.choice((*(rng.choice(PLAIN_NAMES),) * 2, made(), f"{made()}-{made()}", f"{made()} {rng.choice(PLAIN_NAMES)}", "it's"))


def practice_page(seed: int) -> tuple[str, list[int]]:
    """A page in one of many layouts, and for each of its blocks whether it is main text.

    Names that tell nothing are given to main text and to all else alike, so that only names of a kind tell.
    """
    rng = random.Random(seed)
    parts: list[str] = []
    labels: list[int] = []
    style = rng.choice((0, 0, 0, 0, 1, 2, 3))
    named = rng.choice((0.0, 0.0, 0.1, 0.5, 1.0))  # share of elements with a name that tells nothing
    form = rng.choice((*("usual",) * 8, *("nested",) * 3, *("unwrapped",) * 2, *("table",) * 2, *("broken",) * 4, *("bare",) * 2, "untagged"))

    def say(words: list[str] | None, n: int) -> str:
        known = " ".join(rng.choice(words) for _ in range(max(1, n // 2))) if words and rng.random() < 0.6 else ""
        return (known + " " + _invented(rng, rng.randint(1, max(1, n)), rng.choice((0, 0, style)))).strip()

    def plain(marks: str = "") -> str:
        marks = marks or (_marks(rng) if rng.random() < named else "")
        return f' class="{marks}"' if marks else ""

    def put(tag: str, text: str, main: int, marks: str = "") -> None:
        parts.append(f"<{tag}{plain(marks)}>{text}</{tag}>")
        labels.append(main)

    def lines() -> str:
        """Text whose paragraphs are only broken lines."""
        return rng.choice(("<br>", "<br><br>", "<br/>\n<br/>")).join(say(None, rng.choice((10, 25, 60))) for _ in range(rng.randint(2, 8)))

    def bare_links() -> None:
        """A list of links in elements without a telling name."""
        parts.append(f"<div{plain()}>")
        if rng.random() < 0.6:
            put(rng.choice(("h3", "h4", "p")), say(None, 3), 0)
        parts.append("<ul>")
        for _ in range(rng.randint(2, 6)):
            put("li", f'<a href="/x">{say(None, 6)}</a>', 0)
        parts.append("</ul></div>")

    if form == "untagged":
        return "\n".join(say(None, rng.choice((4, 25, 60))) for _ in range(rng.randint(1, 8))), [1]

    def menu(tag: str, marks: str = "") -> None:
        parts.append(f"<{tag}{plain(marks)}><ul>")
        for _ in range(rng.randint(2, 9)):
            put("li", f'<a href="/x">{say(MENU, rng.choice((1, 1, 2)))}</a>', 0)
        parts.append(f"</ul></{tag}>")

    def boxes(kind: str) -> None:
        if kind == "ad":
            put("div", say(ADVERT, 14), 0, rng.choice(AD_NAMES))
        elif kind == "notice":
            put("div", say(NOTICE, 20), 0, rng.choice(NOTICE_NAMES))
        elif kind == "aside":
            tag, name = rng.choice((("aside", ""), ("div", rng.choice(SIDE_NAMES)), ("aside", rng.choice(SIDE_NAMES))))
            parts.append(f'<{tag} class="{name}">')
            put(rng.choice(("h3", "h4")), say(None, 3), 0)
            for _ in range(rng.randint(1, 5)):
                put(rng.choice(("p", "li")), rng.choice(("", '<a href="#">')) + say(None, 15), 0)
            parts.append(f"</{tag}>")
        elif kind == "form":
            parts.append("<form>")
            for _ in range(rng.randint(1, 4)):
                put(rng.choice(("p", "div", "fieldset")), "<label>" + say(FORM, 4) + "</label><input>", 0)
            parts.append("</form>")
        elif kind == "comments":
            tag = rng.choice(("section", "div"))
            parts.append(f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(COMMENTS_NAMES)}">')
            put(rng.choice(("h2", "h3")), say(COMMENT, 3), 0)
            for _ in range(rng.randint(1, 6)):
                inner = rng.choice(("article", "div", "li"))
                parts.append(f'<{inner} class="{rng.choice(COMMENT_NAMES)}">')
                for _ in range(rng.randint(1, 3)):
                    put("p", say(COMMENT if rng.random() < 0.3 else None, 40), 0)
                parts.append(f"</{inner}>")
            parts.append(f"</{tag}>")

    alone = rng.random() < 0.15  # nothing but main text
    parts.append("<html><head><title>t</title></head><body>")
    for _ in range(0 if alone else rng.randint(0, 2)):
        boxes(rng.choice(("notice", "ad")))
    if not alone and rng.random() < 0.5:
        parts.append("<header>" if rng.random() < 0.6 else '<div class="header">')
        for _ in range(rng.randint(1, 2)):
            put(rng.choice(("div", "p", "h1", "h2")), say(None, 5), 0)
        parts.append("</header>" if "<header>" in parts[-3:] or "<header>" in parts else "</div>")
    if not alone and rng.random() < 0.9:
        menu(*rng.choice(MENU_NAMES))
    for _ in range(0 if alone else rng.randint(0, 2)):
        boxes(rng.choice(("ad", "ad", "notice", "aside")))
    if not alone and rng.random() < 0.2:
        bare_links()
    usual = rng.choice(("article", "article", "article", "main", "named", "main+article"))
    outer = {"usual": usual, "nested": rng.choice(("wrapped", "wrapped", usual))}.get(form, form)
    opened = {
        "article": f"<article{plain()}>", "main": f"<main{plain()}>", "named": f'<div {rng.choice(("class", "class", "id"))}="{rng.choice(BODY_NAMES)}">', "main+article": f"<main><article{plain()}>",
        "wrapped": f"<div{plain()}>" * rng.randint(1, 3), "table": f"<td{plain()}>", "broken": f"<{rng.choice(('div', 'div', 'article', 'main'))}{plain()}>",
    }.get(outer, "")
    if form == "table":
        parts.append("<table><tr>")
        if not alone and rng.random() < 0.7:
            parts.append("<td><ul>")
            for _ in range(rng.randint(2, 6)):
                put("li", f'<a href="/x">{say(MENU, 2)}</a>', 0)
            parts.append("</ul></td>")
    parts.append(opened)
    inner_header = form == "usual" and rng.random() < 0.15
    if inner_header:
        parts.append("<header>")
    if form == "broken":
        put(rng.choice(("p", "div")), lines(), 1) if rng.random() < 0.3 else (parts.append(lines()), labels.append(1))
    elif form == "bare":
        put("h1", say(None, 9), 1)
        for _ in range(rng.randint(1, 3)):
            parts.append(lines() + rng.choice(("<hr>", "<h2>")))
            labels.append(1)
            if parts[-1].endswith("<h2>"):
                parts[-1] = parts[-1][:-4]
                put("h2", say(None, 5), 1)
    else:
        put(rng.choice(("h1", "h1", "h1", "h2")), say(None, 9), 1)
    if inner_header:
        parts.append("</header>")
    if form == "nested":
        parts.append(f"<div{plain()}>")
    tags = rng.choice((("p",) * 6, ("p",) * 6, ("p",) * 6, ("div",) * 6, ("p", "p", "p", "div", "div", "div")))
    for _ in range(0 if form in ("broken", "bare") else rng.choice((1, 2, 3, 5, 8, 12, 20))):
        tag = rng.choice((*tags, *(tags[:5] if form != "usual" else ()), "h2", "h3", "li", "blockquote", "pre", "td", "figcaption"))
        text = say(None, rng.choice((1, 2, 4, 10, 25, 60, 120)))
        if rng.random() < 0.15:
            text = f'<b>{text}</b> <a href="#">{say(None, 3)}</a>'
        elif rng.random() < 0.05:
            text = f"{text}<br>{say(None, 20)}"
        around = {"li": "ul", "td": "table", "figcaption": "figure"}.get(tag)
        if around:
            parts.append(f"<{around}>")
        put(tag, text, 1)
        if around:
            parts.append(f"</{around}>")
        if form == "usual" and rng.random() < 0.05:
            boxes(rng.choice(("ad", "aside", "notice", "form")))
    if form == "nested":
        parts.append("</div>")
    if form == "usual" and rng.random() < 0.3:
        boxes(rng.choice(("comments", "aside", "form")))
    ends = {"article": "</article>", "main": "</main>", "named": "</div>", "main+article": "</article></main>", "wrapped": "</div>" * opened.count("<div"), "table": "</td></tr></table>", "broken": f"</{opened[1:].split(' ')[0].rstrip('>')}>"}
    parts.append(ends.get(outer, ""))
    if not alone and rng.random() < 0.2:
        bare_links()
    for kind in ("aside", "form", "comments", "ad", "notice"):
        if not alone and rng.random() < 0.25:
            boxes(kind)
    if not alone and rng.random() < 0.9:
        parts.append(rng.choice(("<footer>", '<footer class="footer">')))
        for _ in range(rng.randint(1, 4)):
            put(rng.choice(("p", "div", "li")), say(FOOT, 12), 0)
        parts.append("</footer>")
    return "".join(parts) + "</body></html>", labels
