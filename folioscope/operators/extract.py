"""Articles and their blocks from HTML: one Arrow pass, one nested row per page.

The container is the smallest candidate whose text score is near the best.  Blocks come
out in page order as a wide struct with a kind.  A page that gives no article is a row
with a status, never an exception.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import constants as K
from folioscope.functions.address import absolute_url
from folioscope.operators.dom import Element, parse_document, written

_SKIP, _ROLES, _INLINE, _BREAKS = map(frozenset, (K.SKIP_TAGS, K.SKIP_ROLES, K.INLINE_TAGS, K.LINE_BREAKING_TAGS))
_MARKER_WORDS = tuple(m for m in K.BOILERPLATE_MARKERS if "-" not in m)
_MARKER_PHRASES = tuple(f" {m.replace('-', ' ')} " for m in K.BOILERPLATE_MARKERS if "-" in m)
_NON_WORD = re.compile("[^0-9A-Za-z]")

BLOCK = "struct<kind:string,level:int,text:string,lang:string,highlights:array<int>,ordered:boolean,depth:int,tbl:struct<header:array<string>,rows:array<array<string>>,columns:int>,img_url:string,alt:string>"
SCHEMA = f"status string, score long, title string, container string, images array<string>, blocks array<{BLOCK}>"
_ARROW_BLOCK = pa.struct(
    [
        ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("lang", pa.string()), ("highlights", pa.list_(pa.int32())), ("ordered", pa.bool_()), ("depth", pa.int32()),
        ("tbl", pa.struct([("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("columns", pa.int32())])), ("img_url", pa.string()), ("alt", pa.string()),
    ]
)


def clean(s: str) -> str:
    return " ".join(s.split())


def flat(s: str) -> str:
    return " ".join(x for x in map(clean, s.splitlines()) if x)


def is_boilerplate(names: str) -> bool:
    norm = f" {_NON_WORD.sub(' ', names).lower()} "
    words = norm.split()
    kept = [w for before, w in zip([None, *words], words) if before not in K.TAXONOMY_PREFIXES]
    return any(w.startswith(_MARKER_WORDS) for w in kept) or any(p in norm for p in _MARKER_PHRASES)


def skipped(e: Element) -> bool:
    if e.tag in _SKIP:
        return True
    a = e.attrs
    if not a:
        return False
    style = "".join(a.get("style", "").split())
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or a.get("role") in _ROLES:
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}"
    return bool(names.strip()) and is_boilerplate(names)


def shown(e: Element) -> Iterator[Element | str]:
    """Children that are not pruned."""
    return (c for c in e.children if isinstance(c, str) or not skipped(c))


def measure(root: Element) -> dict[int, tuple[int, int]]:
    """By id of each element: its score (bytes of shown, cleaned text below and a bonus per paragraph) and its nodes.

    One fold from the leaves up, as elements come after their parents in page order.
    """
    every = [root, *root.walk()]
    scores, nodes, hidden = {}, {}, {}
    for e in every:
        texts = [c for c in e.children if isinstance(c, str)]
        hidden[id(e)] = skipped(e)
        scores[id(e)] = sum(len(clean(t).encode()) for t in texts) + K.PARAGRAPH_BONUS * (e.tag == "p")
        nodes[id(e)] = 1 + len(texts)
    for e in reversed(every[1:]):
        above = id(e.parent)
        nodes[above] += nodes[id(e)]
        if not hidden[id(e)]:
            scores[above] += scores[id(e)]
    return {k: (0 if hidden[k] else scores[k], nodes[k]) for k in scores}


def text_of(e: Element, leave: frozenset = frozenset()) -> str:
    """Shown text; br is a line end, and every piece of text is followed by a space."""
    if e.tag == "br":
        return "\n"
    out, stack = [], [shown(e)]
    while stack:
        for c in stack[-1]:
            if isinstance(c, str):
                out.append(f"{c} ")
            elif c.tag in leave:
                continue
            elif c.tag == "br":
                out.append("\n")
            else:
                stack.append(shown(c))
                break
        else:
            stack.pop()
    return "".join(out)


def inline_text(e: Element) -> str:
    out, stack = [], [shown(e)]
    while stack:
        for c in stack[-1]:
            if isinstance(c, str):
                out.append(f"{c} ")
            elif c.tag == "br":
                out.append(" ")
            elif c.tag in _INLINE:
                stack.append(shown(c))
                break
        else:
            stack.pop()
    return "".join(out)


def title_of(root: Element) -> str:
    for tag in ("title", "h1"):
        found = next((e for e in root.walk() if e.tag == tag), None)
        if found is not None and clean(found.text()):
            return clean_title(found.text())
    return clean_title(K.UNTITLED)


def clean_title(raw: str) -> str:
    t = clean(raw)
    heads = (t.split(sep, 1)[0].strip() for sep in K.TITLE_SEPARATORS if sep in t)
    return next((h for h in heads if len(h) >= K.MIN_TITLE_HEAD), t)


def choose_container(root: Element, least: int) -> tuple[Element | None, int]:
    every, sizes = list(root.walk()), measure(root)
    # elements by what the first part of a selector asks for
    by: dict[str, list[Element]] = {}
    for e in every:
        by.setdefault(e.tag, []).append(e)
        if e.attrs:
            for key in {*(f".{c}" for c in e.classes()), *(f"[{name}" for name in e.attrs), f"#{e.attrs.get('id')}"}:
                by.setdefault(key, []).append(e)
    named = lambda s: s.split("=")[0] if s[0] == "[" else "." + s.split(".")[1] if s[0] == "." else s
    found: list[tuple[int, int, Element]] = []
    best = 0
    for selectors in (K.PLATFORM_SELECTORS, K.STRUCTURE_SELECTORS, ("body",)):
        for s in selectors:
            found += [(*sizes[id(e)], e) for e in by.get(named(s), ()) if e.matches(s)]
        best = max((f[0] for f in found), default=0)
        if best >= least:
            break
    if not best:
        return None, 0
    near = [f for f in found if f[0] >= best * 9 // 10 and f[0] >= least]
    return (min(near, key=lambda f: f[1])[2] if near else None), best


def cell_text(e: Element) -> str:
    """Lines of a table cell; blocks and br end a line, list items begin with a bullet."""
    lines: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if t := clean("".join(now)):
            lines.append(t)
        now.clear()

    if skipped(e):
        return ""
    #: Open elements: what is left of their children, the tag, and how many lines were there before.
    stack = [(shown(e), e.tag, 0)]
    if e.tag == "br":
        return ""
    while stack:
        children, tag, before = stack[-1]
        for c in children:
            if isinstance(c, str):
                now.append(f"{c} ")
            elif c.tag == "br":
                flush()
            else:
                if c.tag == "li":
                    flush()
                stack.append((shown(c), c.tag, len(lines)))
                break
        else:
            stack.pop()
            if tag == "li" or tag in _BREAKS:
                flush()
            if tag == "li" and len(lines) > before:
                lines[before] = f"• {lines[before]}"
    flush()
    return "\n".join(lines)


def _own_rows(e: Element) -> Iterator[tuple[Element, bool]]:
    """Rows of a table that are in no table inside it, and whether they are in a head."""
    stack = [(e.elements(), False)]
    while stack:
        for c in stack[-1][0]:
            if c.tag == "tr":
                yield c, stack[-1][1]
            if c.tag != "table":
                stack.append((c.elements(), stack[-1][1] or c.tag == "thead"))
                break
        else:
            stack.pop()


def table_of(e: Element) -> dict | None:
    rows: list[tuple[list[str], bool]] = []
    for tr, in_head in _own_rows(e):
        cells = [c for c in tr.elements() if c.tag in ("td", "th")]
        if cells:
            rows.append(([cell_text(c) for c in cells], in_head or any(c.tag == "th" for c in cells)))
    if not rows:
        return None
    width = max(len(r) for r, _ in rows)
    padded = [r + [""] * (width - len(r)) for r, _ in rows]
    header = padded.pop(0) if rows[0][1] else []
    body = [r for r in padded if any(r)]
    return {"header": header, "rows": body, "columns": width} if header or body else None


def is_layout(e: Element, table: dict) -> bool:
    if table["header"]:
        return False
    n = len(table["rows"])
    return n > K.MAX_CONTENT_TABLE_ROWS or n > K.NESTED_TABLE_ROWS and any(x.tag == "table" for x in e.walk())


def is_placeholder(url: str) -> bool:
    low = url.lower()
    return low.startswith(("data:", "blob:", "about:")) or re.split("[/?]", low)[-1] in K.SPACER_FILES


def srcset(raw: str) -> list[tuple[int, str]]:
    """(rank, address) of each candidate; rank is the width it stands for."""
    out = []
    for part in raw.split(","):
        fields = part.split()
        if not fields or is_placeholder(fields[0]):
            continue
        d = fields[1] if len(fields) > 1 else ""
        if re.fullmatch(r"\d{1,9}w", d):
            rank = min(int(d[:-1]), K.MAX_SRCSET_WIDTH)
        elif re.fullmatch(r"\d+(\.\d+)?x", d):
            rank = int(float(d[:-1]) * K.MAX_SRCSET_WIDTH)
        else:
            rank = 0
        out.append((rank, fields[0]))
    return out


def image_source(img: Element) -> str | None:
    direct = (img.attrs[a].strip() for a in K.SOURCE_ATTRIBUTES if a in img.attrs)
    if found := next((s for s in direct if s and not is_placeholder(s)), None):
        return found
    if img.parent is not None and img.parent.tag == "picture":
        options = [u for s in img.parent.walk() if s.tag == "source" for a in K.SRCSET_ATTRIBUTES if a in s.attrs for _, u in srcset(s.attrs[a])]
        if options:
            return next((u for u in options if not u.lower().endswith(".svg")), options[0])
    for a in K.SRCSET_ATTRIBUTES:
        if options := srcset(img.attrs.get(a, "")):
            top = max(r for r, _ in options)
            return [u for r, u in options if r == top][-1]
    return None


def alt_text(img: Element) -> str:
    return next((t for a in ("alt", "aria-label", "title") if (t := clean(img.attrs.get(a, "")))), "")


# ---- code blocks


def normalize_language(raw: str) -> str:
    low = raw.strip().lower()
    prefix = next((p for p in K.LANGUAGE_PREFIXES if low.startswith(p)), "")
    low = low[len(prefix) :]
    return K.LANGUAGE_ALIASES.get(low, low)


def language_in(raw: str) -> str | None:
    named = False
    for token in raw.split():
        token = re.sub(r"^[^0-9A-Za-z+#_-]+|[^0-9A-Za-z+#_-]+$", "", token).lower()
        if not token:
            continue
        if named:
            return normalize_language(token)
        if token == "brush":
            named = True
            continue
        for p in K.LANGUAGE_PREFIXES:
            if token.startswith(p) and len(token) > len(p):
                return normalize_language(token[len(p) :])
        if token not in K.NON_LANGUAGE_TOKENS and normalize_language(token) in K.KNOWN_LANGUAGES:
            return normalize_language(token)
    return None


def code_language(pre: Element) -> str | None:
    for e in [pre, *([pre.parent] if pre.parent is not None else []), *(x for x in pre.walk() if x.tag in ("code", "span", "div"))]:
        for a in ("data-language", "data-lang", "lang", "class"):
            if found := language_in(e.attrs.get(a, "")):
                return found
    return None


def parse_ranges(raw: str) -> list[tuple[int, int]]:
    out = []
    for part in re.split("[, ]", raw):
        if m := re.fullmatch(r"(\d+)\s*(?:-\s*(\d+))?", part.strip()):
            a, b = int(m[1]), int(m[2] or m[1])
            if 0 < a <= b:
                out.append((a, b))
    return out


_DIRECTIVE = re.compile(r"[/#\-;<!*%][\W_]*?highlight-(next-line|start|end)[\s/#\-;<!*%>]*\Z")


def is_marked(e: Element) -> bool:
    if any(a in e.attrs and e.attrs[a].strip() not in ("false", "0") for a in K.HIGHLIGHT_ATTRIBUTES):
        return True
    return any(c in K.HIGHLIGHT_TOKENS or c.endswith(tuple(K.HIGHLIGHT_SUFFIXES)) for c in map(str.lower, e.classes()))


def code_of(pre: Element) -> tuple[str, list[int]]:
    """Code text without directive lines, and the zero-based lines to highlight."""
    parts, marks, whole = [], set(), []
    size = newlines = 0

    def put(t: str) -> None:
        nonlocal size, newlines
        parts.append(t)
        size += len(t)
        newlines += t.count("\n")

    #: Open elements, and how many parts, characters and line ends came before each.
    stack = [(shown(pre), None, 0, 0, 0)]
    while stack:
        children, e, part, begin, first = stack[-1]
        for c in children:
            if isinstance(c, str):
                put(c)
            elif c.tag == "br":
                put("\n")
            else:
                stack.append((shown(c), c, len(parts), size, newlines))
                break
        else:
            stack.pop()
            if e is not None and e.tag == "mark":
                whole.append((begin, size, first))
            elif e is not None and is_marked(e):
                marks.update(range(first, first + "".join(parts[part:]).rstrip("\n \t\r").count("\n") + 1))
    text = "".join(parts)
    for begin, end, line in whole:
        # a mark counts if nothing but indentation shares its line
        if not text[:begin].rpartition("\n")[2].strip(" \t") and not text[end:].partition("\n")[0].strip(" \t\r"):
            marks.add(line)
    lines = text.rstrip("\n ").split("\n")
    around = [(pre, True)] + ([(pre.parent, False)] if pre.parent is not None and "line-highlight" in map(str.lower, pre.parent.classes()) else [])
    for e, strict in [*around, *((x, False) for x in pre.walk() if "line-highlight" in x.classes())]:
        offset = next((int(o.attrs["data-line-offset"]) for o in (e, pre) if o.attrs.get("data-line-offset", "").strip().isdigit()), 0)
        raw = next((e.attrs[a] for a in ("data-range", "data-line") if a in e.attrs and (not strict or re.search("[,-]", e.attrs[a]))), "")
        marks.update(n - 1 + offset for a, b in parse_ranges(raw) for n in range(a, min(b, len(lines)) + 1))
    kept, lit, inside, after = [], [], False, False
    for i, line in enumerate(lines):
        if m := _DIRECTIVE.match(line.strip()):
            inside, after = m[1] == "start" or (m[1] != "end" and inside), m[1] == "next-line" or after
            continue
        if i in marks or inside or after:
            lit.append(len(kept))
        after = False
        kept.append(line)
    return "\n".join(kept), lit


# ---- blocks


class Walker:
    """Blocks of a container in page order, and the distinct images in the order they are met."""

    def __init__(self, base: str):
        self.base, self.out, self.images = base, [], {}

    def put(self, kind: str, text: str | None = None, **more) -> None:
        if text is None or text:
            self.out.append({"kind": kind, "text": text, **more})

    def image(self, img: Element) -> None:
        source = image_source(img)
        url = absolute_url(self.base, source) if source else None
        if url:
            self.images.setdefault(url)
            self.put("image", img_url=url, alt=alt_text(img))

    def walk(self, container: Element) -> None:
        """Works off elements in page order; a list and its items are told apart from what else they hold."""
        work: list[tuple[str, Element, int]] = [("any", container, 0)]
        while work:
            what, e, depth = work.pop()
            more = self.list_parts(e, depth) if what == "list" else self.block(e, depth) if what == "any" else self.item(e, depth)
            work += reversed(more)

    def block(self, e: Element, depth: int) -> list[tuple[str, Element, int]]:
        """Puts the block that an element is; gives what is still to be looked at inside it."""
        if skipped(e):
            return []
        tag = e.tag
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.put("heading", flat(text_of(e)), level=int(tag[1]))
        elif tag in ("p", "li"):
            self.put("paragraph" if tag == "p" else "list_item", flat(text_of(e)), **({} if tag == "p" else {"ordered": False, "depth": depth}))
            for x in e.walk():
                if x.tag == "img":
                    self.image(x)
        elif tag == "pre":
            text, lit = code_of(e)
            if text.strip():
                self.put("code", text, lang=code_language(e), highlights=lit)
        elif tag == "blockquote":
            self.put("quote", flat(text_of(e)))
        elif tag in ("figcaption", "caption"):
            self.put("caption", flat(text_of(e)))
        elif tag in ("ul", "ol"):
            return [("list", e, depth)]
        elif tag == "img":
            self.image(e)
        elif tag == "hr":
            self.put("divider")
        elif tag == "table" and (t := table_of(e)) and not is_layout(e, t):
            self.put("table", tbl=t)
        else:
            if tag != "table" and tag not in _INLINE:
                self.put("paragraph", flat(inline_text(e)))
            return [("any", c, depth) for c in e.elements()]
        return []

    def list_parts(self, e: Element, depth: int) -> list[tuple[str, Element, int]]:
        out: list[tuple[str, Element, int]] = []
        for c in e.elements():
            if c.tag == "li":
                out += [("item", c, depth), *(("list", sub, depth + 1) for sub in c.elements() if sub.tag in ("ul", "ol"))]
            elif c.tag in ("div", "ul", "ol"):
                out.append(("any", c, depth))
        return out

    def item(self, e: Element, depth: int) -> list[tuple[str, Element, int]]:
        if not skipped(e):
            self.put("list_item", flat(text_of(e, frozenset(("ul", "ol")))), ordered=e.parent.tag == "ol", depth=depth)
        return []


def repeats_title(text: str, title: str) -> bool:
    a, b = clean(text).lower(), clean(title).lower()
    if len(a) < 12 or not b:
        return False
    if a == b or len(a) >= 40 and a in b:
        return True
    return a.startswith(b) and (len(b) >= 40 or len(a) >= 40 and len(b) >= 20)


def tidy(blocks: list[dict], title: str) -> list[dict]:
    """Without a leading repeat of the title, outer dividers, and later copies of an image."""
    if blocks and blocks[0]["kind"] in ("heading", "paragraph") and repeats_title(blocks[0]["text"], title):
        blocks = blocks[1:]
    solid = [i for i, b in enumerate(blocks) if b["kind"] != "divider"]
    blocks = blocks[solid[0] : solid[-1] + 1] if solid else []
    longest: dict[str, str] = {}
    for b in blocks:
        if b["kind"] == "image" and len(b["alt"].encode()) > len(longest.setdefault(b["img_url"], b["alt"]).encode()):
            longest[b["img_url"]] = b["alt"]
    seen: set[str] = set()
    out = []
    for b in blocks:
        if b["kind"] == "image":
            if b["img_url"] in seen:
                continue
            seen.add(b["img_url"])
            b = b | {"alt": longest[b["img_url"]]}
        out.append(b)
    return out


def extract_article(source: str | None, base: str | None, least: int = K.MIN_TEXT_LENGTH) -> dict:
    root = parse_document(source or "")
    out = {"status": "ok", "score": 0, "title": title_of(root), "container": None, "images": [], "blocks": []}
    container, out["score"] = choose_container(root, least)
    if container is None:
        return out | {"status": "too_thin" if out["score"] else "no_content"}
    walker = Walker(base or "")
    walker.walk(container)
    blocks = tidy(walker.out, out["title"])
    return out | {"container": container.tag, "blocks": blocks, "images": list(walker.images)} | ({} if blocks else {"status": "no_blocks", "images": []})


def extract_articles(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), min_text_len: int = K.MIN_TEXT_LENGTH) -> DataFrame:
    """One row per page: the columns kept, status, score, title, container, images and nested blocks."""
    narrow = pages.select(*keep, F.col("url").alias("base_url"), "html")
    names = [x.split()[0] for x in ("status", "score", "title", "container", "images")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                got = [extract_article(h, u, min_text_len) for u, h in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist())]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
                yield pa.record_batch(
                    [*part.columns[:-2], *(pa.array([g[n] for g in got], k) for n, k in zip(names, kinds)), pa.array([g["blocks"] for g in got], pa.list_(_ARROW_BLOCK))],
                    names=[*keep, *names, "blocks"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[: len(keep)])
    return narrow.mapInArrow(run, f"{kept}, {SCHEMA}")


def body_trees(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """The columns kept, and ``tree``: the body of each page as it is built, written as markup."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [written(parse_document(x or "").children[1]) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(trees, pa.string())], names=[*keep, "tree"])

    narrow = pages.select(*keep, html)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema[: len(keep)])
    return narrow.mapInArrow(run, f"{kept}tree string")


def explode_blocks(articles: DataFrame, key: str = "page_id") -> DataFrame:
    return articles.select(key, F.posexplode("blocks").alias("pos", "b")).select(key, "pos", "b.*")
