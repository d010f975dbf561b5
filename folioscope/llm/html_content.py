"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of block-level elements (inline elements belong to the
block around them).  Every block has a hidden label, content or not.  Its own evidence
(tag, the part of the page around it, marker words in class, id and role, share of link
text, text length) gives a unary potential; a parent-child potential says how labels follow each other down the tree.
Sum-product messages go up from the leaves and down from the root, which on a tree gives
exact marginals; the text of blocks whose content marginal is at least 1/2 is the result.

Potentials are trained piecewise from labelled pages: unary weights by logistic
regression over labelled blocks, the parent-child table from smoothed label pairs.  The
labelled pages are composed by a seeded rule (:func:`labelled_pages`): articles of
varying shape among menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, in changing order, nesting and naming.

Scale: one pass in Arrow batches without a shuffle; the model is a few hundred numbers.

Defined cases: null and empty html give an empty text; broken and unclosed markup is
parsed as far as it goes, in time linear in its length: a quote that is never closed ends
with its word, a tag that never ends is no text, and a drawing or control without an end
tag hides nothing; depth is not limited (no recursion); repeated rows each give a row;
columns that are not kept, whatever their names, are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's elements by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the end tag (or the end of the page) is no markup and never shown.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Left out with everything inside: drawings, controls, fallbacks, notation behind formulas.
UNSHOWN = frozenset("svg template select datalist button progress meter canvas audio video object annotation annotation-xml".split())
#: Parts of a control inside a form, text elsewhere.
IN_FORM = frozenset("label legend output".split())
BLOCK = frozenset(
    "html head body article aside section nav header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset address details summary dialog center hr".split()
)
#: What a page is made of, and elements that mostly hold others.
SECTION = frozenset("article main nav header footer aside form dialog".split())
BOX = frozenset("body article main section div td center".split())
#: A start tag closes an open element of these first, up to the boundary given.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "caption", "figcaption", "summary"}

# Words in class, id and role that speak for or against content.
MARKERS = {
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner adsense doubleclick taboola outbrain",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topbar skip tabs",
    "header": "header masthead branding logo",
    "footer": "footer foot copyright colophon legal",
    "side": "sidebar aside widget rail related recommended recommendations trending popular more",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall banner dialog",
    "comment": "comment comments reply replies discussion disqus respond reader",
    "form": "form search login signup contact",
    "share": "share social sharing follow toolbar meta byline tags",
    "content": "article content entry post story body main text hentry page",
}
_MARKER_OF: dict[str, list[str]] = {}
for _group, _words in MARKERS.items():
    for _word in _words.split():
        _MARKER_OF.setdefault(_word, []).append(_group)

_OPENS = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/(?=[^a-zA-Z])|/?[a-zA-Z])")
#: A tag whose attributes hold no angle brackets and no loose quotes; others are read attribute by attribute.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"'=]++|=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]*+))*+)>""")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_GAP, _NAME, _EQUALS, _BARE = re.compile(r"[\s/]*+"), re.compile(r"[^\s/>][^\s/>=]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*+)))?""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"[a-z]+")


class Tree:
    """Block-level elements in page order: parent, tag, marker features, and the text runs in order."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.marks: list[list[str]] = [[]]
        #: (node, text, is in a link, starts a new run of its node)
        self.runs: list[tuple[int, str, bool, int]] = []


class _Reader:
    """Tags of a source, each character looked at a bounded number of times."""

    def __init__(self, source: str) -> None:
        self.source = source
        #: Searches that have failed once fail from any later place as well.
        self.absent: set[str] = set()
        self.last: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def past(self, what: str, at: int) -> int:
        """One past the next ``what``, or the end."""
        found = self.find(what, at)
        return len(self.source) if found < 0 else found + len(what)

    def has_end(self, name: str, at: int) -> bool:
        """Whether an end tag of this name is still to come."""
        if (last := self.last.get(name)) is None:
            last = self.last[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}(?=[\\s/>])", self.source, re.I)), default=-1)
        return last >= at

    def past_end_tag(self, name: str, at: int) -> int:
        """One past the end tag of an element without markup; -1 if there is none."""
        if name in self.absent:
            return -1
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(self.source, at)
        if not found:
            self.absent.add(name)
            return -1
        return found.end()

    def tag(self, at: int) -> tuple[bool, str, str, int]:
        """(is an end tag, name, attributes, one past it) of the tag at a place."""
        if m := _PLAIN_TAG.match(self.source, at):
            return bool(m[1]), m[2].lower(), m[3], m.end()
        m = _TAG_NAME.match(self.source, at)
        begin = here = m.end()
        source, size = self.source, len(self.source)
        while True:
            here = _GAP.match(source, here).end()
            if here >= size:
                return bool(m[1]), "", "", size  # a tag that never ends is no text
            if source[here] == ">":
                return bool(m[1]), m[2].lower(), source[begin:here], here + 1
            here = _NAME.match(source, here).end()
            if not (equals := _EQUALS.match(source, here)):
                continue
            here = equals.end()
            quote = source[here : here + 1]
            if quote and quote in "\"'" and (end := self.find(quote, here + 1)) >= 0:
                here = end + 1
            else:  # a quote that is never closed ends with its word
                here = _BARE.match(source, here).end()


def _attributes(raw: str) -> tuple[bool, list[str]]:
    """Whether an element is hidden, and the marker groups that its names belong to."""
    hidden, marks = False, set()
    for a in _ATTRIBUTE.finditer(raw):
        key = a[1].lower()
        if key in ("class", "id", "role"):
            marks.update(g for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower()) for g in _MARKER_OF.get(w, ()))
        elif key == "hidden" or key == "aria-hidden" and (a[2] or a[3] or a[4] or "").lower() == "true":
            hidden = True
        elif key == "style" and _HIDING.search((a[2] or a[3] or a[4] or "").lower()):
            hidden = True
    return hidden, sorted(marks)


def parse(source: str) -> Tree:
    """A tolerant tree of a page; what is never shown is left out with its text."""
    tree, reader = Tree(), _Reader(source)
    #: Open elements: (tag, node that its text belongs to, links around it, is never shown)
    stack: list[tuple[str, int, int, bool]] = [("#root", 0, 0, False)]
    #: Places in the stack of the open elements of a name, and of all open blocks.
    places: dict[str, list[int]] = {}
    blocks: list[int] = [0]
    turn = at = 0
    size = len(source)

    def text(upto: int) -> None:
        if upto > at and not stack[-1][3]:
            tree.runs.append((stack[-1][1], source[at:upto], stack[-1][2] > 0, turn))

    def close_to(k: int) -> None:
        nonlocal turn
        for tag, _, _, unshown in reversed(stack[k:]):
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()
                turn += not unshown
        del stack[k:]

    def place(name: str) -> int:
        """Where the innermost open element of a name stands; 0 if there is none."""
        return found[-1] if (found := places.get(name)) else 0

    def innermost(names: set[str], bounds: set[str]) -> int:
        """The place of the innermost open element of some names that no bound is inside of; 0 if there is none."""
        k = max(map(place, names))
        return k if k >= max(map(place, bounds)) else 0

    while at < size:
        found = _OPENS.search(source, at)
        if not found:
            text(size)
            break
        text(found.start())
        lead, at = found[0], found.end()
        if lead == "<!--":
            at = reader.past("-->", at)
            continue
        if lead == "<![CDATA[":
            at = reader.past("]]>", at)
            continue
        if lead in ("<!", "<?", "</"):
            at = reader.past(">", at)
            continue
        is_end, name, raw, at = reader.tag(found.start())
        if not name:
            continue
        if is_end:
            # other elements end in the innermost block only
            if (k := place(name)) and (name in BLOCK or k > blocks[-1]):
                close_to(k)
            continue
        closed = raw.endswith("/")
        if name in RAW:
            end = at if closed and place("svg") else reader.past_end_tag(name, at)
            at = size if end < 0 else end
            continue
        if name == "br":
            if not stack[-1][3]:
                tree.runs.append((stack[-1][1], " ", False, turn))
            continue
        if name in CLOSES_P and (k := place("p")) and k == blocks[-1]:
            close_to(k)
        if name in IMPLIED:
            while k := innermost(*IMPLIED[name]):
                close_to(k)
        _, node, links, unshown = stack[-1]
        hidden, marks = _attributes(raw) if raw else (False, [])
        unshown = unshown or hidden or name in UNSHOWN or name in IN_FORM and place("form") > 0
        if name in BLOCK and not unshown:
            turn += 1
            tree.parent.append(node)
            tree.tag.append(name)
            tree.marks.append(marks)
            node = len(tree.tag) - 1
        # a slash closes void and foreign elements only
        if name in VOID or closed and name in ("svg", "math"):
            continue
        if name in UNSHOWN and not reader.has_end(name, at):
            continue
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append((name, node, links + (name == "a"), unshown))
    return tree


def features(tree: Tree) -> list[list[str]]:
    """Evidence of every node, from itself, the text below it, and where it stands on the page."""
    n = len(tree.tag)
    chars, linked, sentences, before = [0] * n, [0] * n, [0] * n, [-1] * n
    inside, titled = [""] * n, [t == "h1" for t in tree.tag]
    around: list[set[str]] = [set()] * n  # what the names of the elements around a node say
    for i in range(1, n):
        p = tree.parent[i]
        inside[i] = tree.tag[p] if tree.tag[p] in SECTION else inside[p]
        around[i] = around[p] | set(tree.marks[p]) if tree.marks[p] else around[p]
    total = 0
    for node, raw, in_link, _ in tree.runs:
        size = len(raw.strip())
        if before[node] < 0:
            before[node] = total
        total += size
        chars[node] += size
        linked[node] += size * in_link
        sentences[node] += raw.count(". ") + raw.count(", ")
    loose = list(chars)
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        sentences[p] += sentences[i]
        titled[p] = titled[p] or titled[i]
        if before[i] >= 0 and (before[p] < 0 or before[i] < before[p]):
            before[p] = before[i]
    out = []
    for i in range(n):
        tag = tree.tag[i]
        share = linked[i] / chars[i] if chars[i] else 0.0
        size = min(5, int(math.log2(chars[i] + 1) / 2))
        own = ["bias", f"tag={tag}", f"links={min(3, int(share * 4))}", f"size={size}", f"commas={min(3, int(math.log2(sentences[i] + 1)))}"]
        own.append(f"place={min(4, 5 * max(0, before[i]) // (total + 1))}")
        own += [f"in={inside[i]}", f"tag={tag} in={inside[i]}"]
        # its share of the page's text without links, the text of boxes also by itself
        part = lambda x: min(5, 6 * x // (chars[0] - linked[0] + 1))
        own.append(f"part={part(chars[i] - linked[i])}")
        if tag in BOX:
            own += [f"titled={titled[i]}", f"named={bool(tree.marks[i])} titled={titled[i]}"]
            own.append(f"named={bool(tree.marks[i])} part={part(chars[i] - linked[i])}")
            own += [f"loose={tag}", f"loose part={part(loose[i])}"] if loose[i] else []
        for m in tree.marks[i]:
            own += [f"mark={m}", f"mark={m} in={inside[i]}"]
        own += [f"around={m}" for m in sorted(around[i])]
        out.append(own)
    return out


#: Weight decay of the training.
RIDGE = 2e-5


class ContentModel:
    """Unary weights and the parent-child log-potentials; gives exact marginals of a tree."""

    def __init__(self, weights: dict[str, float], pair: list[list[float]]):
        self.weights, self.pair = weights, pair

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of every node, by sum-product up and down, in normalised odds."""
        n = len(tree.tag)
        get = self.weights.get
        unary = [math.exp(max(-40.0, min(40.0, sum(get(f, 0.0) for f in fs)))) for fs in features(tree)]
        (p00, p01), (p10, p11) = ((math.exp(x) for x in row) for row in self.pair)
        belief = list(unary)  # odds from the node and what is below it
        up = [1.0] * n
        for i in range(n - 1, 0, -1):
            b = belief[i]
            up[i] = (p10 + p11 * b) / (p00 + p01 * b)
            k = tree.parent[i]
            belief[k] = min(1e150, max(1e-150, belief[k] * up[i]))
        total = list(belief)
        for i in range(1, n):
            # the parent's odds without this child, sent down through the same table
            rest = total[tree.parent[i]] / up[i]
            down = (p01 + p11 * rest) / (p00 + p10 * rest)
            total[i] = min(1e150, max(1e-150, belief[i] * down))
        return [t / (1 + t) for t in total]

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        tree = parse(source)
        p = self.marginals(tree)
        parts: list[str] = []
        lines: list[str] = []
        last = None
        for node, raw, _, turn in tree.runs:
            if p[node] < 0.5:
                continue
            if last is not None and turn != last:
                lines.append("".join(parts))
                parts = []
            parts.append(html.unescape(raw) if "&" in raw else raw)
            last = turn
        lines.append("".join(parts))
        return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def labelled_pages(count: int = 480, seed: int = 11) -> Iterator[tuple[str, list[int]]]:
    """Composed pages and the label of each of their block elements, in page order."""
    rng = random.Random(seed)
    syllables = "an the re ti on ou ing ed er st le de la en que ment sch ung ver lich cion ado para mi".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def prose(lo: int, hi: int) -> str:
        return " ".join(word() + rng.choice(["", "", "", ",", ".", ""]) for _ in range(rng.randint(lo, hi))) + "."

    def links(tag: str, n: int) -> tuple[str, list[int]]:
        if rng.random() < 0.2:
            return f"<{tag}>" + " ".join(f'<a href="/{word()}">{prose(1, 3)}</a>' for _ in range(n)) + f"</{tag.split()[0]}>", [0]
        return f"<{tag}><ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n)) + f"</ul></{tag.split()[0]}>", [0] * (n + 2)

    def wrap(tag: str, names: list[str], inner: tuple[str, list[int]], label: int = 0, neutral: float = 0.0) -> tuple[str, list[int]]:
        how = rng.random()
        if rng.random() < neutral:  # a name that says nothing
            names = [word() for _ in range(3)]
        own = f' class="{rng.choice(names)}"' if how < 0.6 else f' id="{rng.choice(names)}"' if how < 0.8 else f' class="{rng.choice(names)}-{rng.choice(["wrap", "box", "inner", "1"])}"'
        return f"<{tag}{own}>{inner[0]}</{tag}>", [label, *inner[1]]

    def text_of(tag: str, lo: int, hi: int, label: int) -> tuple[str, list[int]]:
        return f"<{tag}>{prose(lo, hi)}</{tag}>", [label]

    def joined(parts: list[tuple[str, list[int]]]) -> tuple[str, list[int]]:
        return "".join(p[0] for p in parts), [x for p in parts for x in p[1]]

    def article() -> tuple[str, list[int]]:
        heading = rng.choice(["h1", "h1", "h1", "h2", ""])
        paragraph = rng.choice(["p", "p", "p", "p", "div"])
        parts = [text_of(heading, 1, 10, 1)] if heading else []
        if heading and rng.random() < 0.25:  # a head of its own
            more = [text_of(rng.choice(["p", "h2", "div"]), 1, 20, 1)] if rng.random() < 0.4 else []
            head = joined([*parts, *more])
            parts = [(f"<header>{head[0]}</header>", [1, *head[1]])]
        most = rng.choice([3, 12, 90, 90])  # articles of verses and lines, and of paragraphs
        if rng.random() < 0.3:  # text directly in its box
            parts += [(rng.choice(["<br><br>", "<br>", "<hr>"]).join(prose(most // 2, 2 * most) for _ in range(rng.randint(1, 9))).replace("<hr>", "<br>"), [])]
            return joined([*parts, *([boilerplate("comments")] if rng.random() < 0.2 else [])])
        for _ in range(rng.randint(1, 12 if most > 12 else 30)):
            kind = rng.random()
            if kind < 0.54:
                parts.append(text_of(paragraph, 1, most, 1))
            elif kind < 0.61:
                parts.append((f"<p>{prose(2, 20)} <a href='/x'>{prose(1, 5)}</a> {prose(2, 20)}</p>", [1]))
            elif kind < 0.66:
                parts.append(text_of("h2", 1, 6, 1))
            elif kind < 0.71:
                items = [text_of("li", 2, 20, 1) for _ in range(rng.randint(2, 5))]
                body = joined(items)
                parts.append((f"<ul>{body[0]}</ul>", [1, *body[1]]))
            elif kind < 0.76:
                body = joined([(f'<li><a href="/{word()}">{prose(1, 6)}</a></li>', [1]) for _ in range(rng.randint(2, 6))])
                parts.append((f"<{(own := rng.choice(['ul', 'ol']))}>{body[0]}</{own}>", [1, *body[1]]))
            elif kind < 0.79:
                inner = text_of("p", 5, 30, 1)
                parts.append((f"<blockquote>{inner[0]}</blockquote>", [1, *inner[1]]))
            elif kind < 0.83:
                parts.append(table(rng.randint(1, 4), rng.randint(1, 4)))
            elif kind < 0.845:
                inner = joined([text_of(tag, 1, 9, 1) for _ in range(rng.randint(1, 4)) for tag in ("dt", "dd")])
                parts.append((f"<dl>{inner[0]}</dl>", [1, *inner[1]]))
            elif kind < 0.86:
                parts.append((f"<figure><img src='/x.png'><figcaption>{prose(2, 9)}</figcaption></figure>", [1, 1]))
            elif kind < 0.97:
                parts.append(boilerplate(rng.choice(["ad", "aside", "form", "notice", "div.ad", "div.ad"])))
            else:
                parts.append((f"<p><b>{prose(2, 30)}<br>", [1]))
        if rng.random() < 0.3:  # short lines at the end
            parts += [(f"<p>{rng.choice([word(), word()[0], word()[0].upper()])}</p>", [1]) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.2:
            parts.append(boilerplate("comments"))
        return joined(parts)

    def table(rows: int, columns: int) -> tuple[str, list[int]]:
        row = lambda tag: joined([text_of(tag, 1, rng.choice([1, 3, 8]), 1) for _ in range(columns)])
        lines = [row("td") for _ in range(rows)]
        body = joined([(f"<tr>{x}</tr>", [1, *y]) for x, y in lines])
        if rng.random() < 0.5:
            return f"<table>{body[0]}</table>", [1, *body[1]]
        head = row("th")
        return f"<table><thead><tr>{head[0]}</tr></thead><tbody>{body[0]}</tbody></table>", [1, 1, 1, *head[1], 1, *body[1]]

    def boilerplate(kind: str) -> tuple[str, list[int]]:
        some = lambda lo, hi: joined([text_of(rng.choice(["p", "div", "li", "h3"]), lo, hi, 0) for _ in range(rng.randint(1, 3))])
        if kind == "nav":
            return links("nav", rng.randint(2, 9)) if rng.random() < 0.7 else wrap("div", ["nav", "menu", "navbar", "breadcrumbs"], links("div", rng.randint(2, 6)), neutral=0.4)
        if kind == "header":
            return wrap("header", ["header", "masthead", "top"], some(1, 8)) if rng.random() < 0.5 else (f"<header>{prose(1, 8)}</header>", [0])
        if kind == "footer":
            return (f"<footer>&copy; {prose(2, 25)}</footer>", [0]) if rng.random() < 0.6 else wrap(rng.choice(["footer", "div"]), ["footer", "copyright", "legal"], some(2, 25), neutral=0.1)
        if kind in ("ad", "div.ad"):
            return (f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo"])}">{rng.choice([prose(2, 40), prose(1, 3), word()])}</div>', [0]) if rng.random() < 0.7 else wrap(rng.choice(["div", "section", "aside"]), ["ad", "advert", "sponsor", "promo"], some(2, 40))
        if kind == "aside":
            return (f"<aside>{prose(3, 40)}</aside>", [0]) if rng.random() < 0.4 else wrap(rng.choice(["aside", "div"]), ["sidebar", "related", "widget", "trending"], joined([some(2, 30), links("div", 3)]), neutral=0.3)
        if kind == "form":
            return (f"<form><label>{prose(1, 4)}</label><input name=q><button>{word()}</button></form>", [0]) if rng.random() < 0.5 else wrap("form", ["search", "login", "signup", "newsletter"], some(1, 12), neutral=0.5)
        if kind == "notice":
            return wrap(rng.choice(["div", "section", "aside", "dialog"]), ["cookie", "notice", "consent", "newsletter", "alert", "popup"], some(3, 40)) if rng.random() < 0.6 else (f'<div class="{rng.choice(["cookie-notice", "notice", "gdpr", "alert"])}">{prose(3, 40)}</div>', [0])
        inner = joined([wrap("div", ["comment", "reply"], some(3, 50)) for _ in range(rng.randint(1, 4))])
        return wrap(rng.choice(["section", "div", "aside", "ul"]), ["comments", "discussion", "responses comments", "reader-comments"], inner)

    for _ in range(count):
        body = article()
        where = rng.random()
        if where < 0.45:
            main = (f"<article>{body[0]}</article>", [1, *body[1]])
        elif where < 0.6:
            main = wrap("article", ["post", "entry", "story"], body, 1, neutral=0.4)
        elif where < 0.7:
            main = (f"<main>{body[0]}</main>", [1, *body[1]])
        elif where < 0.85:  # boxes without a name, or with one that says nothing
            main = body
            for _ in range(rng.randint(1, 3)):
                main = (f"<div>{main[0]}</div>", [1, *main[1]]) if rng.random() < 0.6 else wrap("div", [word() for _ in range(3)], main, 1)
        else:
            main = wrap(rng.choice(["div", "div", "section"]), ["content", "post", "entry", "article-body", "story"], body, 1, neutral=0.4)
        before = [boilerplate(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "aside"], rng.randint(1, 4))]
        after = [boilerplate(k) for k in rng.sample(["footer", "aside", "comments", "ad", "nav", "form"], rng.randint(1, 4))]
        whole = joined([*before, main, *after])
        how = rng.random()
        if how < 0.3:
            whole = wrap("div", ["page", "wrapper", "site", "root"], whole, 0, neutral=0.5)
        elif how < 0.4:  # a layout table: a row for each part
            rows = joined([(f"<tr><td>{part}</td></tr>", [labels[0], labels[0], *labels]) for part, labels in [*before, main, *after]])
            whole = (f"<table>{rows[0]}</table>", [0, *rows[1]])
        yield f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{whole[0]}</body></html>", [0, 0, 0, 0, *whole[1]]


def train_content_model(pages: Iterator[tuple[str, list[int]]] | None = None, rounds: int = 800) -> ContentModel:
    """Piecewise training; each page comes with the labels of its blocks (root, html, head, body, ...)."""
    rows, labels = [], []
    counts = [[1.0, 1.0], [1.0, 1.0]]
    for source, given in pages or labelled_pages():
        tree = parse(source)
        if len(given) != len(tree.tag):
            raise ValueError(f"{len(given)} labels for {len(tree.tag)} blocks")
        rows += features(tree)
        labels += given
        for i in range(1, len(given)):
            counts[given[tree.parent[i]]][given[i]] += 1
    names = sorted({f for r in rows for f in r})
    at = {f: k for k, f in enumerate(names)}
    index = np.array([at[f] for r in rows for f in r])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y = np.array(labels, float)
    w = np.zeros(len(names))
    # steps by a bound of the curvature along each feature, so that rare ones are learned as well
    curve = np.bincount(index, minlength=len(names)) * max(map(len, rows)) / 4 / len(rows) + RIDGE
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(row, w[index], len(rows))))
        w -= 1.5 * (np.bincount(index, (p - y)[row], len(names)) / len(rows) + RIDGE * w) / curve
    # how a child's label follows its parent's, against how labels fall overall
    share = [sum(c[k] for c in counts) / sum(map(sum, counts)) for k in (0, 1)]
    pair = [[math.log(c[k] / sum(c) / share[k]) for k in (0, 1)] for c in counts]
    return ContentModel(dict(zip(names, w.tolist())), pair)


def extract_main_text(pages: DataFrame, model: ContentModel, *, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Per page row: the columns kept, and ``text``."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    narrow = pages.select(*keep, F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sent.value.extract(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.drop("html").schema)
    return narrow.mapInArrow(run, f"{kinds}, text string" if kinds else "text string")
