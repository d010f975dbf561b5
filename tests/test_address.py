"""Addresses against a table of what the URL standard says of them."""

import random

import pytest

from folioscope.functions.address import absolute_url, joined, parse

#: base, link, where it leads
CASES = [
    ("https://a.com/x/y", "/img.png", "https://a.com/img.png"),
    ("https://a.com/x/", "b.png", "https://a.com/x/b.png"),
    ("https://a.com", "https://b.com/c", "https://b.com/c"),
    ("https://a.com", "", None),
    ("https://a.com", "data:image/png;base64,xx", None),
    ("https://a.com", "javascript:void(0)", None),
    ("https://a.com", "ftp://f/x", None),
    ("https://a.com", "mailto:x@y", None),
    ("not a base", "x", None),
    # slashes both ways
    ("http://h/a/b?q", "\\\\img.example\\a b.png", "http://img.example/a%20b.png"),
    ("http://h/a/b", "\\c\\d", "http://h/c/d"),
    ("http://h/a/b", "c\\d?e\\f#g\\h", "http://h/a/c/d?e\\f#g\\h"),
    ("http://h/a/b", "///x/y", "http://x/y"),
    ("http://h/", "http:////x//y", "http://x//y"),
    ("http://h/", "https:///x", "https://x/"),
    # query, fragment, nothing
    ("http://h/a/b?q#f", "?z", "http://h/a/b?z"),
    ("http://h/a/b?q#f", "#g", "http://h/a/b?q#g"),
    ("http://h/a/b?q#f", "c", "http://h/a/c"),
    ("http://h/a/b?q#f", " \n", "http://h/a/b?q"),
    ("http://h", "?z", "http://h/?z"),
    # hosts
    ("http://h/", "HTTP://EXÄMPLE.org:80/%7Ea b", "http://xn--exmple-cua.org/%7Ea%20b"),
    ("http://h/", "http://faß.de/", "http://xn--fa-hia.de/"),
    ("http://h/", "http://日本。jp/", "http://xn--wgv71a.jp/"),
    ("http://h/", "http://ＧＯ.com", "http://go.com/"),
    ("http://h/", "http://GOO\u200b\u2060\ufeffgoo.com", "http://googoo.com/"),
    ("http://h/", "http://ex%41mple.com/", "http://example.com/"),
    ("http://h/", "http://ex%C3%A4mple.com/", "http://xn--exmple-cua.com/"),
    ("http://h/", "http://a.b./", "http://a.b./"),
    ("http://h/", "http://xn--exmple-cua.org/", "http://xn--exmple-cua.org/"),
    ("http://h/", "http://xn--/", None),
    ("http://h/", "http://a b/", None),
    ("http://h/", "http://a%20b/", None),
    ("http://h/", "http://a<b/", None),
    ("http://h/", "http://a%zz/", None),
    ("http://h/", "http:///", None),
    ("http://h/", "http://", None),
    # numbers
    ("http://h/", "//0x7f.1/a", "http://127.0.0.1/a"),
    ("http://h/", "http://1.2.3/", "http://1.2.0.3/"),
    ("http://h/", "http://0300.168.0xF0", "http://192.168.0.240/"),
    ("http://h/", "http://4294967295/", "http://255.255.255.255/"),
    ("http://h/", "http://4294967296/", None),
    ("http://h/", "http://256.1.1.1/", None),
    ("http://h/", "http://1.2.3.4.5/", None),
    ("http://h/", "http://1.2.3.08/", None),
    ("http://h/", "http://a.0x/", None),
    ("http://h/", "http://1.2.3.4./", "http://1.2.3.4/"),
    ("http://h/", "http://[::1:0:0]:8080", "http://[::1:0:0]:8080/"),
    ("http://h/", "http://[2001:DB8:0:0:1:0:0:0]/", "http://[2001:db8:0:0:1::]/"),
    ("http://h/", "http://[::ffff:1.2.3.4]/", "http://[::ffff:102:304]/"),
    ("http://h/", "http://[1::2::3]/", None),
    ("http://h/", "http://[::1/", None),
    # logins and ports
    ("http://h/", "https://u:p@h.example:443/x", "https://u:p@h.example/x"),
    ("http://h/", "http://u@v:p@w@h/", "http://u%40v:p%40w@h/"),
    ("http://h/", "http://u:@h/", "http://u@h/"),
    ("http://h/", "http://user@/x", None),
    ("http://h/", "http://h:/x", "http://h/x"),
    ("http://h/", "http://h:0080/x", "http://h/x"),
    ("http://h/", "http://h:65536/", None),
    ("http://h/", "http://h:8a/", None),
    ("http://u:p@h:8080/a", "b", "http://u:p@h:8080/b"),
    # dots
    ("http://h/a/b/c", "../../../../up", "http://h/up"),
    ("http://h/a/b", "./.", "http://h/a/"),
    ("http://h/a/b", "..", "http://h/"),
    ("http://h/a/b", "%2e%2E/c", "http://h/c"),
    ("http://h/a/b", ".%2e/%2E/c/..", "http://h/"),
    ("http://h/a/b", "...", "http://h/a/..."),
    ("http://h/a//b", "../c", "http://h/a/c"),
    ("http://h/", "/a/./b/../c", "http://h/a/c"),
    # what is encoded where
    ("http://h/?a", "a|b^c`d{e}\"<>", "http://h/a|b%5Ec%60d%7Be%7D%22%3C%3E"),
    ("http://h/", "?a'b\"c<d>", "http://h/?a%27b%22c%3Cd%3E"),
    ("http://h/", "#a'b\"c`d<", "http://h/#a'b%22c%60d%3C"),
    ("http://h/", "ß?ß#ß", "http://h/%C3%9F?%C3%9F#%C3%9F"),
    ("http://h/", "a%zz%2F", "http://h/a%zz%2F"),
    ("http://h/", "a\x01b\x7f", "http://h/a%01b%7F"),
    ("http://h/a/b", "x\ty\n.png", "http://h/a/xy.png"),
    ("http://h/a/b", " \x00 c ", "http://h/a/c"),
    # the scheme of the base
    ("http://h/a/b", "http:rel.png", "http://rel.png/"),
    ("http://h/a/b", "x:y", None),
    ("http://h/a/b", "1x:y", "http://h/a/1x:y"),
    ("data:x,y", "#f", "data:x,y#f"),
    ("data:x,y", "f", None),
    ("file:///a/b", "c", "file:///a/c"),
    ("file://host/a/b", "//other/c", "file://other/c"),
]


@pytest.mark.parametrize("base, link, want", CASES)
def test_cases(base, link, want):
    assert absolute_url(base, link) == want


def test_relative_with_the_scheme_of_the_base():
    assert str(parse("http:rel.png", parse("http://h/a/b"))) == "http://h/a/rel.png"
    assert str(parse("http:/rel.png", parse("http://h/a/b"))) == "http://h/rel.png"
    assert str(parse("https:rel.png", parse("http://h/a/b"))) == "https://rel.png/"
    assert str(parse("web+x:/.//p")) == "web+x:/.//p" and str(parse("x://H/%41")) == "x://H/%41"


def test_what_is_read_is_read_alike_again():
    """Written addresses are read and written the same; nothing crashes on random text."""
    rng = random.Random(4)
    alphabet = ["http:", "https:", "//", "/", "\\", ".", "..", "%2e", "@", ":", "[", "]", "?", "#", "a", "Ä", "ß", "1", "0x", "%", " ", "\t", "'", "|", "😀", "\ud83d", "xn--", "\u0301"]
    base = parse("http://u@h:81/a/b?c#d")
    for _ in range(20_000):
        raw = "".join(rng.choices(alphabet, k=rng.randrange(10)))
        if (found := parse(raw, base)) is not None:
            assert str(parse(str(found))) == str(found), raw


def test_columns(spark):
    rows = spark.createDataFrame([(b, u) for b, u, _ in CASES] + [(None, "x"), ("http://h/", None)], "base string, link string")
    got = rows.select(joined(rows.base, rows.link).alias("u")).collect()
    assert [r.u for r in got] == [w for *_, w in CASES] + [None, None]
