"""Addresses as browsers read them: taken apart, resolved against a base, and written in one form.

The rules are the living URL standard's: white space and control characters around an
address do not count, tabs and line breaks nowhere; backslashes are slashes in the schemes
of the web; hosts are lower-cased, taken out of percent signs, put into ASCII (IDNA) or read
as numbers; default ports go; dot segments are worked off; what may not stand in a part is
percent-encoded.

Defined cases: what cannot be read gives null; a base without a path of its own (``data:``)
resolves fragments only; drive letters of ``file:`` addresses are ordinary segments.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass, replace
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The web's schemes with their ports.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
# Printable ASCII characters that are percent-encoded in each part.
IN_FRAGMENT = ' "<>`'
IN_QUERY = ' "#<>'
IN_WEB_QUERY = IN_QUERY + "'"
IN_PATH = IN_QUERY + "?^`{}"
IN_USER = IN_PATH + "/:;=@[\\]|"
# What no host may hold, and what no domain may hold besides.
NOT_IN_HOST = "\x00\t\n\r #/:<>?@[\\]^|"
NOT_IN_DOMAIN = NOT_IN_HOST + "%\x7f" + "".join(map(chr, range(1, 0x20)))

_AROUND = "".join(map(chr, range(0x21)))
_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):(.*)", re.S)
_DOT, _DOTS = re.compile(r"(?:\.|%2e)", re.I), re.compile(r"(?:\.|%2e){2}", re.I)
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]*|[0-9]+")


@dataclass(frozen=True)
class Address:
    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    #: Segments behind slashes; a string if the path is not made of segments.
    path: tuple[str, ...] | str = ()
    query: str | None = None
    fragment: str | None = None

    @property
    def web(self) -> bool:
        return self.scheme in PORTS

    def __str__(self) -> str:
        out = [self.scheme, ":"]
        if self.host is not None:
            out.append("//")
            if self.user or self.password:
                out += [self.user, ":" + self.password if self.password else "", "@"]
            out += [self.host, "" if self.port is None else f":{self.port}"]
        elif not isinstance(self.path, str) and len(self.path) > 1 and not self.path[0]:
            out.append("/.")  # else it would read as a host
        out.append(self.path if isinstance(self.path, str) else "".join("/" + s for s in self.path))
        out.append("" if self.query is None else "?" + self.query)
        out.append("" if self.fragment is None else "#" + self.fragment)
        return "".join(out)


def encoded(text: str, special: str) -> str:
    """The text with the characters given, control characters and all beyond ASCII percent-encoded."""
    if text.isascii() and text.isprintable() and not any(c in special for c in text):
        return text
    return "".join(c if " " <= c <= "~" and c not in special else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _numbered_host(name: str) -> str | None:
    """An IPv4 address of up to four numbers, of which the last fills what is left; '' if it is none, null if it is a wrong one."""
    parts = name.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not (_NUMBER.fullmatch(parts[-1]) or parts[-1].isdigit()):
        return ""
    if len(parts) > 4:
        return None
    values = []
    for p in parts:
        if not _NUMBER.fullmatch(p):
            return None
        base, digits = (16, p[2:] or "0") if p[:2].lower() == "0x" else (8, p) if len(p) > 1 and p[0] == "0" else (10, p)
        if base == 8 and not set(p) <= set("01234567"):
            return None
        values.append(int(digits, base))
    *front, last = values
    if any(v > 255 for v in front) or last >= 256 ** (5 - len(values)):
        return None
    total = last + sum(v << 8 * (3 - k) for k, v in enumerate(front))
    return ".".join(str(total >> s & 255) for s in (24, 16, 8, 0))


def _ascii_domain(name: str) -> str | None:
    """A domain in lower case and ASCII; null if it cannot be."""
    if name.isascii() and "xn--" not in name.lower():
        return name.lower()
    # compatibility forms and case fold away, but for two letters that stay themselves; joiners and soft hyphens go
    folded = "".join(c if c in "ßς" else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) for c in name if c not in "\u00ad\u200b\u2060\ufeff")
    out = []
    for label in re.split("[.\u3002\uff0e\uff61]", unicodedata.normalize("NFC", folded)):
        if not label.isascii():
            if unicodedata.combining(label[0]) or any(unicodedata.category(c) in ("Cn", "Co", "Cs", "Cc") for c in label):
                return None
            label = "xn--" + label.encode("punycode").decode()
        elif label.startswith("xn--"):
            try:
                if label[4:].encode().decode("punycode").isascii():
                    return None
            except UnicodeError:
                return None
        out.append(label)
    return ".".join(out)


def _host(raw: str, web: bool) -> str | None:
    if raw.startswith("["):
        try:
            return f"[{_shortest_v6(ipaddress.IPv6Address(raw[1:-1]))}]" if raw.endswith("]") and "%" not in raw else None
        except ValueError:
            return None
    if not web:
        return None if any(c in NOT_IN_HOST for c in raw) else encoded(raw, "")
    name = _ascii_domain(unquote_to_bytes(raw.encode("utf-8", "replace")).decode("utf-8", "replace"))
    if not name or any(c in NOT_IN_DOMAIN for c in name):
        return None
    number = _numbered_host(name)
    return number if number != "" else name


def _shortest_v6(address: ipaddress.IPv6Address) -> str:
    """Eight hexadecimal groups, the first longest run of two or more zeros left out."""
    groups = [f"{int(address) >> s & 0xFFFF:x}" for s in range(112, -1, -16)]
    runs = [(len(m[0]), m.start()) for m in re.finditer(r"Z+", "".join("Z" if g == "0" else "-" for g in groups))]
    size, at = max(runs, key=lambda r: (r[0], -r[1]), default=(0, 0))
    return ":".join(groups) if size < 2 else ":".join(groups[:at]) + "::" + ":".join(groups[at + size :])


def _with_authority(out: Address, rest: str) -> Address | None:
    """The address with what stands behind its two slashes."""
    end = re.search(r"[/\\?#]" if out.web else r"[/?#]", rest)
    authority, rest = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    login, at, place = authority.rpartition("@")
    if at:
        if not place:
            return None
        user, _, password = login.partition(":")
        out = replace(out, user=encoded(user, IN_USER), password=encoded(password, IN_USER))
    colon = re.search(r":([^\]:]*)$", place)
    name, port = (place[: colon.start()], colon[1]) if colon else (place, "")
    if port and not (port.isascii() and port.isdigit() and int(port) < 1 << 16):
        return None
    if not name and (out.web and out.scheme != "file" or colon):
        return None
    host = _host(name, out.web) if name else ""
    if host is None:
        return None
    if out.scheme == "file" and host == "localhost":
        host = ""
    return _with_path(replace(out, host=host, port=int(port) if port and int(port) != PORTS.get(out.scheme) else None), rest)


def _with_path(out: Address, rest: str, before: tuple[str, ...] = ()) -> Address:
    """The address with path, query and fragment; ``before``: segments that the path goes on from."""
    rest, mark, fragment = rest.partition("#")
    if mark:
        out = replace(out, fragment=encoded(fragment, IN_FRAGMENT))
    rest, mark, query = rest.partition("?")
    if mark:
        out = replace(out, query=encoded(query, IN_WEB_QUERY if out.web else IN_QUERY))
    if out.web:
        rest = rest.replace("\\", "/")
    if not rest and not before:
        return replace(out, path=("",) if out.web else ())
    path = list(before)
    parts = (rest[1:] if rest.startswith("/") else rest).split("/")
    for k, part in enumerate(parts):
        if _DOTS.fullmatch(part):
            del path[-1:]
        elif not _DOT.fullmatch(part):
            path.append(encoded(part, IN_PATH))
            continue
        if k == len(parts) - 1:
            path.append("")
    return replace(out, path=tuple(path))


def _relative(base: Address, rest: str) -> Address | None:
    """What ``rest``, which has no scheme of its own, means at a base."""
    plain = rest.replace("\\", "/") if base.web else rest
    if isinstance(base.path, str):
        return replace(base, fragment=encoded(rest[1:], IN_FRAGMENT)) if rest.startswith("#") else None
    if plain.startswith("//"):
        at = 2
        while base.web and base.scheme != "file" and plain[at : at + 1] == "/":
            at += 1
        return _with_authority(Address(base.scheme), rest[at:])
    base = replace(base, fragment=None)
    if plain.startswith("/"):
        return _with_path(replace(base, query=None), rest)
    if not rest or rest[0] in "?#":
        query = base.query if not rest.startswith("?") else None
        read = _with_path(Address(base.scheme, query=query), rest)
        return replace(base, query=read.query, fragment=read.fragment)
    return _with_path(replace(base, query=None), rest, base.path[:-1])


def parse(raw: str, base: Address | None = None) -> Address | None:
    """An address, resolved against a base if it is not whole; null if it cannot be read."""
    raw = re.sub(r"[\t\n\r]", "", raw.strip(_AROUND))
    m = _SCHEME.fullmatch(raw)
    if not m:
        return _relative(base, raw) if base else None
    scheme, rest = m[1].lower(), m[2]
    plain = rest.replace("\\", "/")
    if scheme in PORTS:
        if base and base.scheme == scheme and not (rest.startswith("//") if scheme != "file" else plain.startswith("//")):
            return _relative(base, rest)
        if scheme == "file":
            return _with_authority(Address(scheme), rest[2:]) if plain.startswith("//") else _with_path(Address(scheme, host=""), rest)
        return _with_authority(Address(scheme), rest[len(plain) - len(plain.lstrip("/")) :])
    if rest.startswith("//"):
        return _with_authority(Address(scheme), rest[2:])
    if rest.startswith("/"):
        return _with_path(Address(scheme), rest)
    path, mark, fragment = rest.partition("#")
    path, asked, query = path.partition("?")
    return Address(scheme, path=encoded(path, ""), query=encoded(query, IN_QUERY) if asked else None, fragment=encoded(fragment, IN_FRAGMENT) if mark else None)


def absolute_url(base: str, href: str) -> str | None:
    """Where a link of a page leads; null for embedded data, scripts, other schemes than the web's, and what cannot be read."""
    if not href or href.startswith(("data:", "javascript:")):
        return None
    if found := parse(href):
        return str(found) if found.scheme.startswith("http") else None
    at = parse(base)
    found = parse(href, at) if at else None
    return str(found) if found else None


def joined(base: Column, href: Column) -> Column:
    """absolute_url of two columns."""

    def run(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or h is None else absolute_url(b, h) for b, h in zip(bases, hrefs)], dtype=object)

    return F.pandas_udf(run, "string")(base, href)
