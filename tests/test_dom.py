"""Trees of malformed pages against literal trees, and what holds for any text."""

import random
import time

import pytest

from folioscope.operators.dom import Element, parse_document, written


#: Pages, and what is in their body.
TREES = [
    ('<p>1<b>2<i>3</b>4</i>5</p>', '<p>1<b>2<i>3</i></b><i>4</i>5</p>'),
    ('<b>1<p>2</b>3</p>', '<b>1</b><p><b>2</b>3</p>'),
    ('<!DOCTYPE html><table><b><tr><td>aaa</td></tr>bbb</table>ccc', '<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>'),
    ('<a><p></a></p>', '<a></a><p><a></a></p>'),
    ('<table><p>x', '<p>x</p><table></table>'),
    ('<a>x<div>y<a>z', '<a>x</a><div><a>y</a><a>z</a></div>'),
    ('<b><table><td><i></table>', '<b><table><tbody><tr><td><i></i></td></tr></tbody></table></b>'),
    ('<!DOCTYPE html><p>a<table><td>b</table>c', '<p>a</p><table><tbody><tr><td>b</td></tr></tbody></table>c'),
    ('<p>a<table><td>b</table>c', '<p>a<table><tbody><tr><td>b</td></tr></tbody></table>c</p>'),
    ('<b><em>a<p>b</b>c</em>d', '<b><em>a</em></b><em></em><p><em><b>b</b>c</em>d</p>'),
    ('<p><b><div><marquee></p></b></div>X', '<p><b></b></p><div><b><marquee><p></p>X</marquee></b></div>'),
    ('<ul><li>a<ul><li>b</ul><li>c</ul>', '<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>'),
    ('<h1>a<h2>b</h1>c', '<h1>a</h1><h2>b</h2>c'),
    ('<p>a</p></p>b', '<p>a</p><p></p>b'),
    ('a</br>b', 'a<br>b'),
    ('<table>x<tr>y<td>z</table>w', 'xy<table><tbody><tr><td>z</td></tr></tbody></table>w'),
    ('<select><b>a<option>b<option>c</select>d', '<select>a<option>b</option><option>c</option></select>d'),
    ('<div><b>x</div>y', '<div><b>x</b></div><b>y</b>'),
    ('<a href=1>x<a href=2>y', '<a href="1">x</a><a href="2">y</a>'),
    ('<font><p>a</font>b', '<font></font><p><font>a</font>b</p>'),
    ('<table><tr><td>a<table><tr><td>b</table>c</table>d', '<table><tbody><tr><td>a<table><tbody><tr><td>b</td></tr></tbody></table>c</td></tr></tbody></table>d'),
    ('<table><caption>a<tr><td>b</table>', '<table><caption>a</caption><tbody><tr><td>b</td></tr></tbody></table>'),
    ('<table><col><tr><td>b</table>', '<table><colgroup><col></colgroup><tbody><tr><td>b</td></tr></tbody></table>'),
    ('<td>x</td>y', 'xy'),
    ('<dl><dt>a<dd>b<p>c<dt>d</dl>', '<dl><dt>a</dt><dd>b<p>c</p></dd><dt>d</dt></dl>'),
    ('<pre>\nx</pre>', '<pre>x</pre>'),
    ('<b>a<b>b<b>c<b>d<p>e</b></b></b></b>f', '<b>a<b>b<b>c<b>d</b></b></b><p><b><b><b>e</b></b></b>f</p></b>'),
    ('<svg><path/><p>x', '<svg><path></path></svg><p>x</p>'),
    ('<form><form><p>a</form>b</form>', '<form><p>a</p></form>b'),
    ('<a><table><td><a><table></table><a></tr><a></table><b>X</b>C<a>Y', '<a><a></a><table><tbody><tr><td><a><table></table></a><a></a></td></tr></tbody></table></a><a><b>X</b>C</a><a>Y</a>'),
    ('<!DOCTYPE html><body><b><nobr>1<nobr></b><i><nobr>2<nobr></i>3', '<b><nobr>1</nobr><nobr></nobr></b><nobr><i></i></nobr><i><nobr>2</nobr><nobr></nobr></i><nobr>3</nobr>'),
    ('<b><button>foo</b>bar', '<b></b><button><b>foo</b>bar</button>'),
    ('<!DOCTYPE html><span><button>foo</span>bar', '<span><button>foobar</button></span>'),
    ('<table><a>1<p>2</a>3</p>', '<a>1</a><p><a>2</a>3</p><table></table>'),
    ('<cite><b><cite><i><cite><i><cite><i><div>X</b>TEST', '<cite><b><cite><i><cite><i><cite><i></i></cite></i></cite></i></cite></b><i><i><div><b>X</b>TEST</div></i></i></cite>'),
]


@pytest.mark.parametrize("source, want", TREES)
def test_trees(source, want):
    assert written(parse_document(source).children[1]) == want


def test_head():
    html = parse_document("<title>T</title><meta name=a content=b>\n<link rel=x><p>x<html lang=tr><body class=c><body class=d id=i>y")
    assert written(html.children[0]) == '<title>T</title><meta content="b" name="a"><link rel="x">'
    assert html.attrs == {"lang": "tr"} and html.children[1].attrs == {"class": "c", "id": "i"} and written(html.children[1]) == "<p>xy</p>"


def test_any_text_gives_a_consistent_tree():
    """Parents and children agree, and all text is kept, whatever the tags."""
    rng = random.Random(2)
    names = "a b i p div table tr td tbody caption li ul select option form button h1 svg nobr marquee col br span title math input".split()
    for _ in range(3000):
        parts = [rng.choice([f"<{n}>", f"</{n}>", f"<{n} x={rng.randrange(3)}>", f"<{n}/>"]) if rng.random() < 0.75 else f"w{k} " for k in range(rng.randrange(40)) for n in [rng.choice(names)]]
        html = parse_document("".join(parts))
        kept = sorted(html.text().split())
        work = [html]
        while work:
            e = work.pop()
            for c in e.children:
                if isinstance(c, Element):
                    assert c.parent is e
                    work.append(c)
        assert kept == sorted(p.strip() for p in parts if p.startswith("w"))


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<a href=x>", "<table>", "<table><tr><td>", "<li>", "<p><b>", "<select>", "<b id={}><p>", "</p>", "<svg>", "<table>x", "<i></b>", "<dd><span>"])
def test_time_and_depth(unit):
    source = "".join(unit.format(k) for k in range(20_000)) + "end"
    began = time.time()
    assert parse_document(source).text().endswith("end") or "end" in parse_document(source).text()
    assert time.time() - began < 60
