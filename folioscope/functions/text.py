"""Scalar functions as native columns: titles, addresses, names, chunks, colours, dates."""

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import constants as K

INVISIBLE = r"[\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFEFF]"


def clean_text(s: Column) -> Column:
    """White space (Unicode's) collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def flat_text(s: Column) -> Column:
    """Cleaned, non-empty lines joined by a space."""
    return F.array_join(F.filter(F.transform(F.split(s, r"\r?\n"), clean_text), lambda x: x != ""), " ")


def clean_title(s: Column) -> Column:
    """The head before the first separator that leaves at least 15 characters."""
    t = clean_text(s)
    options = []
    for sep in K.TITLE_SEPARATORS:
        head = F.trim(F.substring_index(t, sep, 1))
        options.append(F.when((F.instr(t, sep) > 0) & (F.length(head) >= K.MIN_TITLE_HEAD), head))
    return F.coalesce(*options, t)


def host(url: Column) -> Column:
    """Between :// and the next slash; other characters than letters, digits, . and - become _."""
    after = F.split(url, "://")
    start = F.when(F.size(after) > 1, F.try_element_at(after, F.lit(2))).otherwise(url)
    return F.regexp_replace(F.substring_index(start, "/", 1), "[^0-9A-Za-z.-]", "_")


def percent_decode(s: Column) -> Column:
    """Valid %XX sequences decoded as UTF-8 (broken ones replaced); everything else, + too, stays."""
    # escapes become bytes: runs of valid escapes are unhexed together, so multi-byte characters meet
    pieces = F.regexp_extract_all(s, F.lit(r"(?s)(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))
    decode = lambda p: F.when(p.rlike("^(?:%[0-9A-Fa-f]{2})+$"), F.hex(F.unhex(F.replace(p, F.lit("%"), F.lit(""))))).otherwise(F.hex(F.encode(p, "UTF-8")))
    return F.make_valid_utf8(F.unhex(F.array_join(F.transform(pieces, decode), "")).cast("string"))


def path_slug(url: Column) -> Column:
    """Last path segment as a file stem: decoded, lower case, safe characters, at most 60; null if generic."""
    path = F.try_parse_url(url, F.lit("PATH"))
    segment = F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1))
    # ASCII letters only are lowered: others become hyphens anyway
    stem = F.translate(F.substring_index(percent_decode(segment), ".", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    slug = F.regexp_replace(F.regexp_replace(stem, "[^0-9a-z_-]", "-"), "^-+|-+$", "")
    return F.when(~slug.isin("", "index", "default", "home"), F.substring(slug, 1, 60))


def output_name(url: Column) -> Column:
    own = host(url)
    return F.when(own == "", F.lit("sayfa.pdf")).otherwise(F.concat(own, F.coalesce(F.concat(F.lit("-"), path_slug(url)), F.lit("")), F.lit(".pdf")))


def host_label(url: Column) -> Column:
    """host/file of an image address; otherwise its first 48 characters."""
    name = F.try_element_at(F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda x: x != ""), F.lit(-1))
    own = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(F.concat(own, F.lit("/"), F.coalesce(name, F.lit("görsel"))), F.substring(url, 1, 48))


def normalize_tokens(s: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(s, "[^0-9A-Za-z]", " ")), F.lit(" "))


def boilerplate(s: Column) -> Column:
    """Whether a class or id names page furniture; words after a taxonomy prefix do not count."""
    norm = normalize_tokens(s)
    tokens = F.filter(F.split(norm, " +"), lambda x: x != "")
    kept = F.filter(tokens, lambda t, i: (i == 0) | ~F.coalesce(F.get(tokens, i - 1), F.lit("")).isin(*K.TAXONOMY_PREFIXES))
    words = [m for m in K.BOILERPLATE_MARKERS if "-" not in m]
    phrases = [m.replace("-", " ") for m in K.BOILERPLATE_MARKERS if "-" in m]
    return F.exists(kept, lambda t: t.rlike(f"^(?:{'|'.join(words)})")) | norm.rlike(f" (?:{'|'.join(phrases)}) ")


def placeholder_source(s: Column) -> Column:
    low = F.lower(s)
    return low.rlike("^(?:data|blob|about):") | F.element_at(F.split(low, "[/?]"), -1).isin(*K.SPACER_FILES)


def normalize_language(s: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(s)), f"^(?:{'|'.join(K.LANGUAGE_PREFIXES)})", "")
    table = F.create_map(*(F.lit(x) for kv in K.LANGUAGE_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, low), low)


def parse_ranges(s: Column) -> Column:
    """Line ranges named by "2, 5-7" as (first, last): one-based, in order, invalid, zero and reversed ones left out."""
    parts = F.filter(F.split(s, "[, ]"), lambda p: p.rlike(r"^[0-9]{1,18}(?:-[0-9]{1,18})?$"))
    pair = lambda p: F.struct(F.substring_index(p, "-", 1).cast("long").alias("first"), F.substring_index(p, "-", -1).cast("long").alias("last"))
    return F.filter(F.transform(parts, pair), lambda r: (r["first"] > 0) & (r["last"] >= r["first"]))


def best_srcset(s: Column) -> Column:
    """The widest candidate (at most 2400 px; density counts 2400 a unit); of equals the last."""
    fields = F.transform(F.split(s, ","), lambda p: F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), " "))
    fields = F.filter(fields, lambda f: (f[0] != "") & ~placeholder_source(f[0]))

    def key(f: Column) -> Column:
        d = F.coalesce(F.get(f, F.lit(1)), F.lit(""))
        return (
            F.when(d.rlike(r"^\d{1,9}w$"), F.least(F.regexp_extract(d, r"^(\d+)", 1).cast("long"), F.lit(K.MAX_SRCSET_WIDTH).cast("long")))
            .when(d.rlike(r"^\d+(\.\d+)?x$"), (F.regexp_extract(d, r"^([\d.]+)", 1).cast("float") * F.lit(float(K.MAX_SRCSET_WIDTH)).cast("float")).cast("long"))
            .otherwise(F.lit(0).cast("long"))
        )

    ranked = F.transform(fields, lambda f, i: F.struct(key(f).alias("k"), i.alias("i"), f[0].alias("url")))
    return F.try_element_at(F.array_sort(ranked), F.lit(-1))["url"]


def format_from_content_type(s: Column) -> Column:
    low = F.lower(s)
    out = F.when(low.contains("png"), "png").when(low.contains("jpeg") | low.contains("jpg"), "jpeg")
    for kind in ("webp", "gif", "svg"):
        out = out.when(low.contains(kind), kind)
    return out


def sniff_format(body: Column) -> Column:
    head = F.hex(F.substring(body, 1, 12))
    text = F.ltrim(F.regexp_replace(F.decode(F.substring(body, 1, 1024), "ISO-8859-1"), "^\u00ef\u00bb\u00bf", ""))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.rlike("^52494646.{8}57454250"), "webp")
        .when(head.rlike("^474946383[79]61"), "gif")
        .when(text.startswith("<") & text.contains("<svg"), "svg")
    )


#: Bytes that name a format and, of all but JPEGs and drawings, hold the size.
HEAD_BYTES = 30


def image_size(body: Column) -> Column:
    """(width, height) from the header of a PNG, GIF, JPEG, WebP or SVG; null where it cannot be read.

    Of PNG, GIF and WebP only the first bytes go to Python.
    """
    short = F.hex(F.substring(body, 1, 12)).rlike("^(?:89504E470D0A1A0A|474946383[79]61|52494646.{8}57454250)")
    return F.pandas_udf(_sizes, "width int, height int")(F.when(short, F.substring(body, 1, HEAD_BYTES)).otherwise(body))


def pixel_size(body: bytes | None) -> tuple[int, int] | None:
    """Width and height by the format's own header; an SVG's by its size or view box."""
    b = bytes(body or b"")
    number = lambda at, n, order="big": int.from_bytes(b[at : at + n], order)
    if b.startswith(b"\x89PNG\r\n\x1a\n"):
        return (number(16, 4), number(20, 4)) if len(b) >= 24 else None
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return (number(6, 2, "little"), number(8, 2, "little")) if len(b) >= 10 else None
    if b.startswith(b"\xff\xd8"):
        return _jpeg_size(b)
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        kind = b[12:16]
        if kind == b"VP8X" and len(b) >= 30:
            return 1 + number(24, 3, "little"), 1 + number(27, 3, "little")
        if kind == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
            bits = number(21, 4, "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
            return number(26, 2, "little") & 0x3FFF, number(28, 2, "little") & 0x3FFF
        return None
    return _svg_size(b)


def _jpeg_size(b: bytes) -> tuple[int, int] | None:
    """Segments from the header on, up to the first frame (of any kind); thumbnails inside segments are passed over."""
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            return None
        marker = b[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
        elif marker in (0xD9, 0xDA):
            return None
        else:
            at += 2 + max(2, int.from_bytes(b[at + 2 : at + 4], "big"))
    return None


_SVG = re.compile(rb"""<svg\b((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_LENGTH = re.compile(rb"""(?:^|\s)(width|height|viewBox)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_PIXELS = {b"": 1.0, b"px": 1.0, b"pt": 96 / 72, b"pc": 16.0, b"in": 96.0, b"cm": 96 / 2.54, b"mm": 96 / 25.4}


def _svg_size(b: bytes) -> tuple[int, int] | None:
    root = _SVG.search(b)
    if not root:
        return None
    found = {m[1]: (m[2] if m[2] is not None else m[3]).strip() for m in _LENGTH.finditer(root[1])}
    box = [float(x) for x in re.split(rb"[\s,]+", found.get(b"viewBox", b"")) if re.fullmatch(rb"[-+]?[0-9]*\.?[0-9]+", x)]
    own = []
    for name, k in ((b"width", 2), (b"height", 3)):
        m = re.fullmatch(rb"([0-9]*\.?[0-9]+)\s*([a-z]*)", found.get(name, b""))
        if m and m[2] in _PIXELS:
            own.append(float(m[1]) * _PIXELS[m[2]])
        elif len(box) == 4:
            own.append(box[k])
    return (math.ceil(own[0]), math.ceil(own[1])) if len(own) == 2 and min(own) > 0 else None


def _sizes(bodies: pd.Series) -> pd.DataFrame:
    sizes = [pixel_size(b) or (None, None) for b in bodies]
    return pd.DataFrame({"width": pd.array([w for w, _ in sizes], "Int32"), "height": pd.array([h for _, h in sizes], "Int32")})


def fit_scale(w: Column, h: Column, max_w: Column, max_h: Column) -> Column:
    """Factor of at most 1 that fits an image, at least 0.01."""
    k = F.least(F.lit(1.0), F.when(w > 0, max_w / w).otherwise(F.lit(1.0)), F.when(h > 0, max_h / h).otherwise(F.lit(1.0)))
    return F.greatest(F.lit(0.01), F.least(F.lit(1.0), k))


def natural_mm(px: Column, dpi: Column) -> Column:
    return px * 25.4 / dpi


def raster_scale(w: Column, h: Column) -> Column:
    """Scale of a drawing: 2.1, at most 2400 px long and 16 million px in all; null without an area."""
    s = F.least(F.lit(2.1), F.lit(2400.0) / F.greatest(w, h))
    return F.when((w > 0) & (h > 0), F.least(s, F.sqrt(F.lit(16e6) / (w * h))).cast("float"))


def raster_pixels(side: Column, scale: Column) -> Column:
    """Pixels of a side of a drawing at its scale, one at least."""
    return F.greatest(F.lit(1), F.round(side * scale.cast("double")).cast("int"))


def blend_on_white(channel: Column, alpha: Column) -> Column:
    """A colour channel (0 to 255) laid over white with an alpha of 0 to 255, rounded down."""
    return F.floor((channel * alpha + 255 * (255 - alpha)) / 255).cast("int")


def fit_radii(width: Column, height: Column, corners: tuple[Column, Column, Column, Column]) -> Column:
    """Corner radii (lower left, lower right, upper right, upper left) shrunk alike until no side is shorter than its two."""
    r = [F.greatest(F.lit(0.0), c) for c in corners]
    sides = ((width, 0, 1), (width, 2, 3), (height, 0, 3), (height, 1, 2))
    shrink = F.least(F.lit(1.0), *(side / F.greatest(F.lit(1e-6), r[i] + r[j]) for side, i, j in sides))
    return F.array(*(c * shrink for c in r))


def gutter_marker(number: Column, digits: Column, continuation: Column, numbers: Column) -> Column:
    plain = F.when(continuation, "» ").otherwise("")
    own = F.when(continuation, F.concat(F.repeat(F.lit(" "), digits), F.lit(" │ » "))).otherwise(F.concat(F.lpad(number.cast("string"), F.greatest(digits, F.length(number.cast("string"))), F.lit(" ")), F.lit(" │ ")))
    return F.when(numbers, own).otherwise(plain)


def visual_chunks(line: Column, first: Column, rest: Column) -> Column:
    """A line in pieces: the first of ``first`` characters, the others of ``rest``; empty gives one empty piece."""
    a, b = F.greatest(F.lit(1), first), F.greatest(F.lit(1), rest)
    more = F.when(F.length(line) > a, F.transform(F.sequence(a + 1, F.length(line), b), lambda k: F.substring(line, k, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.substring(line, F.lit(1), a)), more)


def chunk_text(s: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters, broken between words; longer words are cut.

    A text that fits is returned as it is.  A word of exactly ``most`` characters after an
    empty piece leaves that empty piece in the result, as the length test counts a space.
    """
    words = F.filter(F.split(F.regexp_replace(s, r"(?U)\s+", " "), " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc: Column, w: Column) -> Column:
        now, out = acc["now"], acc["out"]
        held = F.when(now != "", F.array_append(out, now)).otherwise(out)
        long = F.struct(F.concat(held, F.transform(F.sequence(F.lit(1), F.length(w), F.lit(most)), lambda k: F.substring(w, k, F.lit(most)))).alias("out"), F.lit("").alias("now"))
        full = F.struct(F.array_append(out, now).alias("out"), w.alias("now"))
        more = F.struct(out.alias("out"), F.when(now != "", F.concat(now, F.lit(" "), w)).otherwise(w).alias("now"))
        return F.when(F.length(w) > most, long).when(F.length(now) + F.length(w) + 1 > most, full).otherwise(more)

    end = lambda acc: F.when(acc["now"] != "", F.array_append(acc["out"], acc["now"])).otherwise(acc["out"])
    return F.when(F.length(s) <= most, F.array(s)).otherwise(F.aggregate(words, start, step, end))


#: Code in backticks, addresses up to white space, tags; each of two characters at least.
PROTECTED = r"`[^`]*`|https?://(?U:\S)*|<[^>]*>"


def protect(s: Column) -> Column:
    """(masked, parts): protected pieces replaced by numbered marks."""
    parts = F.regexp_extract_all(s, F.lit(PROTECTED), F.lit(0))
    gaps = F.split(s, PROTECTED, -1)
    masked = F.array_join(F.transform(gaps, lambda g, i: F.when(i < F.size(gaps) - 1, F.concat(g, F.lit("⟦"), i.cast("string"), F.lit("⟧"))).otherwise(g)), "")
    return F.struct(masked.alias("masked"), parts.alias("parts"))


def restore(s: Column, parts: Column) -> Column:
    """Marks replaced by their parts; null if any mark is missing."""
    mark = lambda i: F.concat(F.lit("⟦"), i.cast("string"), F.lit("⟧"))
    named = F.transform(parts, lambda p, i: F.struct(mark(i).alias("m"), p.alias("p")))
    return F.aggregate(named, s, lambda acc, x: F.when(acc.contains(x["m"]), F.replace(acc, x["m"], x["p"])))


def translated_text(body: Column) -> Column:
    """The sentences of a translation reply, joined; null if blank."""
    found = F.from_json(body, "sentences array<struct<trans:string>>")["sentences"]
    text = F.array_join(F.transform(found, lambda x: x["trans"]), "")
    return F.when(F.trim(text) != "", text)


def pdf_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "'D:'yyyyMMddHHmmss'Z'")


def text_object(s: Column) -> Column:
    """UTF-16BE with a byte order mark, as hex."""
    return F.concat(F.lit("FEFF"), F.hex(F.encode(s, "UTF-16BE")))


def rgb01(colour: Column, channel: int) -> Column:
    return F.conv(F.substring(colour, 1 + 2 * channel, 2), 16, 10).cast("int") / F.lit(255.0)


def destination_pt(page_height_mm: Column, y_mm: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(page_height_mm, page_height_mm - y_mm)) * 72 / 25.4


def header_text(page_no: Column, continued: Column) -> Column:
    return F.concat(F.lit("Sayfa "), page_no.cast("string"), F.when(continued, " · kod devamı").otherwise(""))


def image_note(alt: Column, reason: Column, url: Column) -> Column:
    return F.when(F.coalesce(alt, F.lit("")) != "", F.concat(F.lit("[görsel: "), alt, F.lit("]"))).otherwise(F.concat(F.lit("[görsel "), reason, F.lit(": "), host_label(url), F.lit("]")))


def accepts(status: Column, content_type: Column) -> Column:
    """retry without a status, error outside 2xx, rejected for a foreign type, ok otherwise."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    fine = (low == "") | low.contains("html") | low.contains("xml") | low.contains("text/plain")
    return F.when(status.isNull(), "retry").when(~status.between(200, 299), "http_error").when(~fine, "type_error").otherwise("ok")


def body_text(content_type: Column, body: Column) -> Column:
    """UTF-8 if valid or declared (broken parts replaced), otherwise Latin-1 byte for byte."""
    declared = F.lower(F.coalesce(content_type, F.lit(""))).rlike("utf-?8")
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).when(declared, F.make_valid_utf8(body.cast("string"))).otherwise(F.decode(body, "ISO-8859-1"))
