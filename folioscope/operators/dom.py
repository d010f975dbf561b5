"""Element trees of pages, built as browsers build them from markup of any kind.

The standard library's tokenizer gives tags and text; the tree follows the rules of the HTML
standard: implied end tags, formatting that is reopened where it was cut off or crossed
(the adoption agency), tables that hold rows and cells only (other content moves in front
of them), and what may stand in a select.  Frames and templates are ordinary elements, and
raw text is as far as the tokenizer knows it.

Defined cases: any text gives a tree with a head and a body; depth is not limited (no
recursion); time is linear in the source but for formatting that is reopened again and
again, of which a page gets ``MOST_REOPENED`` copies, after which none is reopened.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Elements by how a tree is built of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen basefont bgsound frame".split())
HEAD_ONLY = frozenset("title meta link base basefont bgsound style script noscript template noframes".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: A start tag ends an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr listing main menu nav ol p plaintext pre search section summary ul xmp h1 h2 h3 h4 h5 h6 li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: End tags of these end what is open inside them.
CLOSED_WHOLE = (ENDS_P - HEADINGS - {"p", "li", "dd", "dt", "hr", "form", "plaintext", "xmp"}) | {"button"}
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SPECIAL = ENDS_P | frozenset("applet area base basefont bgsound body br button caption col colgroup embed frame frameset head html iframe img input keygen link marquee meta noembed noframes noscript object param script select source style table tbody td template textarea tfoot th thead title tr track wbr".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, frozenset("html table template".split())
MARKED = frozenset("applet marquee object".split())
ROWS, CELLS, TABLE_PARTS = frozenset("tbody thead tfoot".split()), frozenset("td th".split()), frozenset("table tbody thead tfoot tr".split())
ONLY_IN_TABLES = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
#: A start tag that ends drawings and formulas.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Copies of formatting elements that a page gets.
MOST_REOPENED = 20_000


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def elements(self):
        return (c for c in self.children if isinstance(c, Element))

    def walk(self):
        """Descendant elements in document order."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Element):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def nodes(self) -> int:
        """Nodes from here down, this one included."""
        return 1 + sum(1 + sum(isinstance(x, str) for x in e.children) for e in self.walk()) + sum(isinstance(x, str) for x in self.children)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def matches(self, selector: str) -> bool:
        """tag, #id, .class (several), [name=value]."""
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        if selector[0] == "[":
            name, _, value = selector[1:-1].partition("=")
            return self.attrs.get(name) == value
        if selector[0] == ".":
            own = self.classes()
            return all(c in own for c in selector[1:].split("."))
        return self.tag == selector

    def text(self) -> str:
        out, stack = [], [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Element):
                    stack.append(iter(c.children))
                    break
                out.append(c)
            else:
                stack.pop()
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.html = Element("html", {}, None)
        self.head = Element("head", {}, self.html)
        self.body = Element("body", {}, self.html)
        self.html.children += [self.head, self.body]
        self.in_body = False
        self.open = [self.html, self.head]
        #: Open elements of a tag, so that a search for one is only made if there is one.
        self.count: dict[str, int] = {}
        #: Formatting elements that are to be reopened; None stands for the edge of a cell or an object.
        self.formatting: list[Element | None] = []
        self.form: Element | None = None
        self.quirks = True
        self.reopened = 0
        #: Content that a table may not hold goes in front of it.
        self.foster = False
        self.skip_newline = False

    # ---- the stack

    def _to_body(self) -> None:
        if not self.in_body:
            self.in_body, self.open, self.count = True, [self.html, self.body], {}

    def _close(self, k: int) -> None:
        for e in self.open[k:]:
            if e.tag in self.count:
                self.count[e.tag] -= 1
        del self.open[k:]

    def _open_at(self, k: int, node: Element) -> None:
        self.open.insert(k, node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def _find(self, tags: frozenset | set, bounds: frozenset) -> int:
        """Place of the innermost open element of some tags that no bound is inside of; 0 if there is none."""
        if any(self.count.get(t) for t in tags):
            for k in range(len(self.open) - 1, 1, -1):
                if self.open[k].tag in tags:
                    return k
                if self.open[k].tag in bounds:
                    break
        return 0

    def _imply_ends(self, but: str = "") -> None:
        while self.open[-1].tag in IMPLIED_END and self.open[-1].tag != but:
            self._close(len(self.open) - 1)

    def _end_in(self, tags: frozenset | set, bounds: frozenset) -> bool:
        if k := self._find(tags, bounds):
            self._close(k)
        return k > 0

    # ---- putting nodes

    def _place(self, parent: Element | None = None) -> tuple[Element, int]:
        """Parent and position of the next node."""
        parent = parent or self.open[-1]
        if self.foster and parent.tag in TABLE_PARTS:
            k = max(i for i, e in enumerate(self.open) if e.tag == "table")
            table = self.open[k]
            if table.parent is not None:
                return table.parent, _index(table)
            return self.open[k - 1], len(self.open[k - 1].children)
        return parent, len(parent.children)

    def _push(self, tag: str, attrs: dict[str, str]) -> Element:
        parent, at = self._place()
        node = Element(tag, attrs, parent)
        parent.children.insert(at, node)
        self._open_at(len(self.open), node)
        return node

    def _text(self, data: str) -> None:
        parent, at = self._place()
        if at and isinstance(parent.children[at - 1], str):
            parent.children[at - 1] += data
        else:
            parent.children.insert(at, data)

    # ---- formatting

    def _since_edge(self) -> int:
        k = len(self.formatting)
        while k and self.formatting[k - 1] is not None:
            k -= 1
        return k

    def _reopen(self) -> None:
        """Opens the formatting again that was cut off by the end of what it stood in."""
        k = len(self.formatting)
        while k and (e := self.formatting[k - 1]) is not None and e not in self.open:
            k -= 1
        for i in range(k, len(self.formatting)):
            self.reopened += 1
            if self.reopened > MOST_REOPENED:
                del self.formatting[i:]
                break
            self.formatting[i] = self._push(self.formatting[i].tag, dict(self.formatting[i].attrs))

    def _format(self, tag: str, attrs: dict[str, str]) -> None:
        self._reopen()
        alike = [k for k in range(self._since_edge(), len(self.formatting)) if self.formatting[k].tag == tag and self.formatting[k].attrs == attrs]
        if len(alike) > 2:
            del self.formatting[alike[0]]
        self.formatting.append(self._push(tag, attrs))

    def _drop_to_edge(self) -> None:
        del self.formatting[max(0, self._since_edge() - 1) :]

    def _adopt(self, tag: str) -> None:
        """An end tag of formatting: what it crosses keeps its place, and the formatting is cut around it."""
        last = self.open[-1]
        if last.tag == tag and last not in self.formatting:
            self._close(len(self.open) - 1)
            return
        for _ in range(8):
            at = next((k for k in range(len(self.formatting) - 1, self._since_edge() - 1, -1) if self.formatting[k].tag == tag), -1)
            if at < 0:
                self._end_other(tag)
                return
            element = self.formatting[at]
            if element not in self.open:
                del self.formatting[at]
                return
            k = self.open.index(element)
            if any(e.tag in SCOPE for e in self.open[k + 1 :]):
                return
            block = next((i for i in range(k + 1, len(self.open)) if self.open[i].tag in SPECIAL), 0)
            if not block:
                self._close(k)
                del self.formatting[at]
                return
            self._cut_around(element, self.open[block], k, block, at)

    def _cut_around(self, element: Element, block: Element, k: int, i: int, at: int) -> None:
        ancestor, mark, moved = self.open[k - 1], at, block
        for n in range(i - k - 1):
            i -= 1
            node = self.open[i]
            if n >= 3 and node in self.formatting:
                place = self.formatting.index(node)
                del self.formatting[place]
                mark -= place < mark
            if node not in self.formatting:
                self._close_one(i)
                continue
            copy = Element(node.tag, dict(node.attrs), ancestor)
            place = self.formatting.index(node)
            self.formatting[place], self.open[i] = copy, copy
            if moved is block:
                mark = place + 1
            _move(moved, copy)
            moved = copy
        parent, position = self._place(ancestor) if not (ancestor.tag in TABLE_PARTS) else self._fostered(ancestor)
        _move(moved, parent, position)
        copy = Element(element.tag, dict(element.attrs), block)
        copy.children, block.children = block.children, [copy]
        for c in copy.children:
            if isinstance(c, Element):
                c.parent = copy
        at = self.formatting.index(element)
        del self.formatting[at]
        self.formatting.insert(mark - (at < mark), copy)
        self._close_one(self.open.index(element))
        self._open_at(self.open.index(block) + 1, copy)

    def _fostered(self, parent: Element) -> tuple[Element, int]:
        before, self.foster = self.foster, True
        found = self._place(parent)
        self.foster = before
        return found

    def _close_one(self, k: int) -> None:
        self.count[self.open[k].tag] -= 1
        del self.open[k]

    # ---- tables

    def _part(self) -> str:
        """The part of a table that is being read, or "" outside of tables."""
        if not self.count.get("table"):
            return ""
        for e in reversed(self.open):
            if e.tag in TABLE_PARTS or e.tag in CELLS or e.tag in ("caption", "colgroup"):
                return e.tag
            if e.tag in ("template", "html"):
                break
        return ""

    def _in_table(self, tag: str, attrs: dict[str, str]) -> bool:
        """Works off a start tag by the rules of tables; False if it is no part of one here."""
        part = self._part()
        if not part:
            return tag in ONLY_IN_TABLES
        if part in CELLS or part == "caption":
            if tag not in ONLY_IN_TABLES:
                return False
            self._end_cell() if part in CELLS else self._end_caption()
            return self._in_table(tag, attrs)
        if part == "colgroup":
            if tag == "col":
                self._push(tag, attrs)
                self._close(len(self.open) - 1)
                return True
            if tag == "template":
                return False
            self._end_in({"colgroup"}, TABLE_SCOPE)
            return self._in_table(tag, attrs)
        if tag in ONLY_IN_TABLES:
            wanted = {"td": "tr", "th": "tr", "tr": "rows", "col": "colgroup"}.get(tag, "table")
            if wanted != "tr" and part == "tr":
                self._clear_to({"tr"})
                self._close(len(self.open) - 1)
                part = self._part()
            if wanted in ("table", "colgroup") and part in ROWS:
                self._clear_to(ROWS)
                self._close(len(self.open) - 1)
                part = "table"
            self._clear_to(TABLE_PARTS)
            if wanted in ("tr", "rows") and part == "table":
                self._push("tbody", {})
                part = "tbody"
            if wanted == "tr" and part in ROWS:
                self._push("tr", {})
            if wanted == "colgroup":
                self._push("colgroup", {})
                self._push("col", attrs)
                self._close(len(self.open) - 1)
                return True
            self._push(tag, attrs)
            if tag in CELLS or tag == "caption":
                self.formatting.append(None)
            return True
        if tag == "table":
            self._end_table()
            return self._in_table(tag, attrs) if self._part() not in ("", *CELLS, "caption") else False
        if tag == "input" and attrs.get("type", "").lower() == "hidden" or tag == "form":
            if tag == "input" or self.form is None:
                node = self._push(tag, attrs)
                self.form = node if tag == "form" else self.form
                self._close(len(self.open) - 1)
            return True
        return tag in ("style", "script", "template") and self._push(tag, attrs) is not None

    def _clear_to(self, tags: frozenset | set) -> None:
        while self.open[-1].tag not in tags and self.open[-1].tag not in ("html", "body", "template"):
            self._close(len(self.open) - 1)

    def _end_cell(self) -> None:
        self._imply_ends()
        self._end_in(CELLS, TABLE_SCOPE)
        self._drop_to_edge()

    def _end_caption(self) -> None:
        self._imply_ends()
        self._end_in({"caption"}, TABLE_SCOPE)
        self._drop_to_edge()

    def _end_table(self) -> None:
        part = self._part()
        if part in CELLS:
            self._end_cell()
        elif part == "caption":
            self._end_caption()
        self._end_in({"table"}, frozenset())

    # ---- tags and text

    def handle_decl(self, decl):
        if decl.lower().split()[:2] == ["doctype", "html"] and not self.in_body:
            self.quirks = False

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in reversed(attrs)}
        self.skip_newline = False
        if tag in ("html", "head", "body"):
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in own.items():
                node.attrs.setdefault(k, v)
            if tag == "body":
                self._to_body()
            return
        if not self.in_body and tag in HEAD_ONLY:
            self._push(tag, own)
            if tag in VOID:
                self._close(len(self.open) - 1)
            return
        self._to_body()
        foreign = self.count.get("svg") or self.count.get("math")
        if foreign and (k := self._find({"svg", "math"}, SCOPE)):
            if tag not in ENDS_FOREIGN or any(e.tag in ("foreignobject", "desc", "title", "annotation-xml") for e in self.open[k:]):
                self._push(tag, own)
                if tag in VOID:
                    self._close(len(self.open) - 1)
                return
            self._close(k)
        if self.count.get("select") and self._in_select(tag):
            return
        if tag in ONLY_IN_TABLES or self.count.get("table"):
            if self._in_table(tag, own):
                return
            if self._part() in TABLE_PARTS:
                self.foster = True
                self._start(tag, own)
                self.foster = False
                return
        self._start(tag, own)

    def _in_select(self, tag: str) -> bool:
        """Whether a start tag has no effect inside an open select; some end it."""
        if not self._find({"select"}, SCOPE):
            return False
        if tag in ("option", "optgroup", "hr", "script", "template"):
            return False
        if tag in ("input", "keygen", "textarea", "select") or tag in ONLY_IN_TABLES or tag == "table":
            self._end_in({"select"}, SCOPE)
            return tag == "select"
        return True

    def _start(self, tag: str, own: dict[str, str]) -> None:
        """A start tag by the rules of the body."""
        if tag == "image":
            tag = "img"
        if tag == "form" and self.form is not None:
            return
        if tag in ("li", "dd", "dt"):
            alike = {"li"} if tag == "li" else {"dd", "dt"}
            if any(self.count.get(t) for t in alike):
                for k in range(len(self.open) - 1, 1, -1):
                    e = self.open[k]
                    if e.tag in alike:
                        self._close(k)
                        break
                    if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                        break
        if tag in ENDS_P or tag == "table" and not self.quirks:
            self._end_in({"p"}, BUTTON_SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._close(len(self.open) - 1)
        if tag in ("pre", "listing"):
            self.skip_newline = True
        if tag == "button" and self._find({"button"}, SCOPE):
            self._end_in({"button"}, SCOPE)
        if tag in FORMATTING:
            if tag == "a" and any(e.tag == "a" for e in self.formatting[self._since_edge() :]):
                old = next(e for e in reversed(self.formatting) if e is not None and e.tag == "a")
                self._adopt("a")
                if old in self.formatting:
                    self.formatting.remove(old)
                if old in self.open:
                    self._close_one(self.open.index(old))
            elif tag == "nobr" and self._find({"nobr"}, SCOPE):
                self._reopen()
                self._adopt("nobr")
            self._format(tag, own)
            return
        if tag in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self._close(len(self.open) - 1)
            if tag == "optgroup" and self.open[-1].tag == "optgroup":
                self._close(len(self.open) - 1)
        if tag in ("rb", "rtc", "rp", "rt") and self._find({"ruby"}, SCOPE):
            self._imply_ends("rtc" if tag in ("rp", "rt") else "")
        if tag not in ENDS_P and tag not in HEAD_ONLY and tag not in ("table", "param", "source", "track", "textarea", "iframe"):
            self._reopen()
        node = self._push(tag, own)
        if tag == "form":
            self.form = node
        if tag in MARKED:
            self.formatting.append(None)
        if tag in VOID:
            self._close(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        # a slash ends drawings and formulas and what is in them, nothing else
        if len(self.open) > depth and (tag in ("svg", "math") or any(e.tag in ("svg", "math") for e in self.open[:-1] if self.count.get("svg") or self.count.get("math"))):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.skip_newline = False
        if tag in ("html", "head", "body"):
            if tag == "head":
                self._to_body()
            return
        if not self.in_body:
            if len(self.open) > 2 and self.open[-1].tag == tag:
                self._close(len(self.open) - 1)
                return
            if tag not in ("br", "p"):
                return
            self._to_body()
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p":
            if not self._find({"p"}, BUTTON_SCOPE):
                self.foster = self._part() in TABLE_PARTS
                self._push("p", {})
                self.foster = False
            self._end_in({"p"}, BUTTON_SCOPE)
        elif tag == "table":
            self._end_table()
        elif tag in ONLY_IN_TABLES:
            self._end_part(tag)
        elif tag in HEADINGS:
            self._end_in(HEADINGS, SCOPE)
        elif tag == "form":
            form, self.form = self.form, None
            if form in self.open and self._find({"form"}, SCOPE):
                self._imply_ends()
                self._close_one(self.open.index(form))
        elif tag in FORMATTING:
            foster, self.foster = self.foster, self._part() in TABLE_PARTS
            self._adopt(tag)
            self.foster = foster
        elif tag in MARKED:
            if self._end_in({tag}, SCOPE):
                self._drop_to_edge()
        elif tag in CLOSED_WHOLE or tag in ("dd", "dt"):
            self._end_in({tag}, SCOPE)
        elif tag == "li":
            self._end_in({"li"}, LIST_SCOPE)
        elif tag == "select":
            self._end_in({"select"}, TABLE_SCOPE)
        else:
            self._end_other(tag)

    def _end_part(self, tag: str) -> None:
        """An end tag of a part of a table; it ends what is open inside the part."""
        if tag in CELLS:
            if self._find({tag}, TABLE_SCOPE):
                self._end_in({tag}, TABLE_SCOPE)
                self._drop_to_edge()
        elif tag == "caption":
            if self._find({"caption"}, TABLE_SCOPE):
                self._end_caption()
        elif tag in ("tr", "colgroup") or tag in ROWS:
            if self._find({tag}, TABLE_SCOPE):
                if self._part() in CELLS:
                    self._end_cell()
                self._end_in({tag}, TABLE_SCOPE)

    def _end_other(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].tag == tag:
                self._close(k)
                return
            if self.open[k].tag in SPECIAL:
                return

    def handle_data(self, data):
        if self.skip_newline and data.startswith("\n"):
            data = data[1:]
        self.skip_newline = False
        if not self.in_body and self.open[-1] in (self.html, self.head):
            data = data.lstrip(" \t\n\f\r")
            if not data:
                return
            self._to_body()
        if not data:
            return
        part = self._part() if self.in_body else ""
        if part in TABLE_PARTS and self.open[-1].tag in TABLE_PARTS:
            if data.strip(" \t\n\f\r"):
                self.foster = True
                self._reopen()
                self._text(data)
                self.foster = False
                return
        elif self.in_body and self.open[-1].tag not in ("script", "style", "textarea", "title"):
            self._reopen()
        self._text(data)


def _index(node: Element) -> int:
    """Where a node stands among its parent's children; looked for from the end."""
    kids = node.parent.children
    return next(k for k in range(len(kids) - 1, -1, -1) if kids[k] is node)


def _move(node: Element, parent: Element, at: int | None = None) -> None:
    """Takes a node out of where it stands and puts it into a parent, at its end or in front of a child."""
    before = parent.children[at] if at is not None and at < len(parent.children) else None
    if node.parent is not None and any(c is node for c in reversed(node.parent.children)):
        del node.parent.children[_index(node)]
    node.parent = parent
    if before is None or before is node:
        parent.children.append(node)
    else:
        parent.children.insert(next(k for k in range(len(parent.children) - 1, -1, -1) if parent.children[k] is before), node)


def parse_document(source: str) -> Element:
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.html


def written(e: Element) -> str:
    """What is inside an element as markup, attributes in the order of their names; text as it is."""
    out, work, names = [], [iter(e.children)], []
    while work:
        for c in work[-1]:
            if isinstance(c, str):
                out.append(c)
                continue
            out.append(f"<{c.tag}" + "".join(f' {k}="{v}"' for k, v in sorted(c.attrs.items())) + ">")
            names.append(c.tag)
            work.append(iter(c.children))
            break
        else:
            work.pop()
            if names:
                name = names.pop()
                out.append("" if name in VOID else f"</{name}>")
    return "".join(out)
