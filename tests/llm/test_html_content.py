"""Main text of pages: broken markup, page furniture of other shapes, and time linear in the source."""

import time
from collections import Counter

import pytest

from folioscope.llm import html_content

HEAD = "Heading of the article"
FIRST = "First words of an article, with some length to them. And more of it follows, too."
LAST = "Last words of the article, which go on for a bit. Then they end, as all things do."


@pytest.fixture(scope="module")
def model():
    return html_content.train_content_model()


def page(middle):
    return f"<html><body><nav><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></nav><article><h1>{HEAD}</h1><p>{FIRST}</p>{middle}<p>{LAST}</p></article><footer>Copyright x</footer></body></html>"


@pytest.mark.parametrize(
    "middle, want",
    [
        ("<p>has an <svg class=i viewBox='0 0 1 1'/> icon inside</p>", ["has an icon inside"]),
        ("<p>has <svg><title>no</title><text>no</text></svg> a drawing</p>", ["has a drawing"]),
        ("<p>open <svg> never closed</p>", ["open never closed"]),
        ("<p title=it's>midtext don't stop</p>", ["midtext don't stop"]),
        ('<p class="a>unclosed quote</p>', ["unclosed quote"]),
        ('<p title="a > b">angle in a quote</p>', ["angle in a quote"]),
        ("<p>press <button>Buy now</button> here</p>", ["press here"]),
        ("<p>pick <select><option>one<option>two</select> one</p>", ["pick one"]),
        ("<p>seen <span hidden>unseen</span> <b style='display: none'>no</b> again</p>", ["seen again"]),
        ("<div aria-hidden=true><p>never shown at all</p></div>", []),
        ("<ul><li><a href=/1>Link one</a></li><li><a href=/2>Link two of it</a></li><li><a href=/3>Three</a></li></ul>", ["Link one", "Link two of it", "Three"]),
        ("<p>a &lt; b &amp; c <math><mi>x</mi><mo>=</mo><mn>2</mn></math> done</p>", ["a < b & c x=2 done"]),
        ("<p>5 < 6 and 7 > 3</p>", ["5 < 6 and 7 > 3"]),
        ("<p data-id=nav data-x='hidden'>kept text of it</p>", ["kept text of it"]),
        ("<div class=ad>Buy things now</div>", []),
        ("<!-- <p>comment</p> --><p>after a comment</p>", ["after a comment"]),
        ("<script>var t = '</p><p>no</p>';</script ><p>after a script</p>", ["after a script"]),
    ],
)
def test_broken_and_unshown(model, middle, want):
    assert model.extract(page(middle)).split("\n") == [HEAD, FIRST, *want, LAST]


def sentence(k):
    return f"Sentence number {k} says something in a plain way, as sentences of articles do. It goes on for a while, and then it stops."


#: Pages of other shapes than the composed ones; no name of a content element is a marker word.
HAND_WRITTEN = [
    # a table layout of old
    (f"<table width=100%><tr><td><a href=/>Start</a> <a href=/n>News</a> <a href=/c>Contact us</a></td></tr><tr><td><h1>Old page</h1><p>{sentence(1)}<p>{sentence(2)}</td></tr><tr><td class=foot>Copyright 1999</td></tr></table>", ["Old page", sentence(1), sentence(2)]),
    # nested, unnamed boxes
    (f"<div id=root><div><ul><li><a href=/>A</a></li><li><a href=/b>B</a></li><li><a href=/c>C</a></li></ul></div><div class=xk12><div><h1>Boxes</h1><p>{sentence(1)}</p><blockquote><p>{sentence(2)}</p></blockquote><p>{sentence(3)}</p></div></div><footer><p>Imprint</p></footer></div>", ["Boxes", sentence(1), sentence(2), sentence(3)]),
    # comments and a newsletter form after the text
    (f"<main><h1>Talk</h1><p>{sentence(1)}</p><p>{sentence(2)}</p></main><section class=comments><h2>Comments</h2><div class=comment><p>I do not agree with this at all.</p></div></section><form class=newsletter><p>Get our news by mail every day.</p><input><button>Send</button></form>", ["Talk", sentence(1), sentence(2)]),
    # a code sample and a figure
    (f"<header><a href=/>Site</a></header><article class=zz><h1>Code</h1><p>{sentence(1)}</p><pre>a = 1\nb = 2</pre><figure><img src=x><figcaption>What is seen here</figcaption></figure><p>{sentence(2)}</p></article><aside><h3>Related</h3><ul><li><a href=/1>One more</a></li><li><a href=/2>Another</a></li></ul></aside>", ["Code", sentence(1), "a = 1 b = 2", "What is seen here", sentence(2)]),
]


@pytest.mark.parametrize("source, want", HAND_WRITTEN)
def test_hand_written_pages(model, source, want):
    assert model.extract(f"<!DOCTYPE html><html><head><title>t</title></head><body>{source}</body></html>").split("\n") == want


WORDS = " ".join(f"word{k}" for k in range(120))
TEXTS = [sentence(k) for k in range(1, 4)]
#: Articles of shapes that lose text easily, and their blocks.
SHAPES = {
    "text directly in a box": (f"<div><h1>Head of it</h1>{WORDS}<br><br>{WORDS}</div>", ["Head of it", f"{WORDS} {WORDS}"]),
    "sentences directly in nested boxes": (f"<div id=c><div><h2>Head of it</h2>{TEXTS[0]}<br><br>{TEXTS[1]}<br>{TEXTS[2]}</div></div>", ["Head of it", " ".join(TEXTS)]),
    "text directly in main, no heading": (f"<main>{TEXTS[0]}<br><br>{TEXTS[1]}</main>", [" ".join(TEXTS[:2])]),
    "text directly in a cell": (f"<table><tr><td>{TEXTS[0]}<br><br>{TEXTS[1]}<br><br>{TEXTS[2]}</td></tr></table>", [" ".join(TEXTS)]),
    "a head inside the article": (f"<article><header><h1>Head of it</h1></header><p>{WORDS}</p></article>", ["Head of it", WORDS]),
    "a small table": (f"<article><h1>Head</h1><p>{TEXTS[0]}</p><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>c</td><td>d</td></tr></tbody></table><p>{TEXTS[1]}</p></article>", ["Head", TEXTS[0], *"abcd", TEXTS[1]]),
    "a letter at the end": (f"<article><h1>Head</h1><p>{TEXTS[0]}</p><p>E</p></article>", ["Head", TEXTS[0], "E"]),
    "labels in a paragraph": (f"<article><h1>Head</h1><p>Some <label>labelled</label> and <output>put out</output> words.</p><p>{TEXTS[0]}</p></article>", ["Head", "Some labelled and put out words.", TEXTS[0]]),
    "boxes instead of paragraphs": (f"<div class=zq><div>{TEXTS[0]}</div><div>{TEXTS[1]}</div><div>Yes.</div></div>", [*TEXTS[:2], "Yes."]),
    "paragraphs without a heading": (f"<div><p>{TEXTS[0]}</p><p>{TEXTS[1]}</p></div>", TEXTS[:2]),
    "sections with code": (f"<main><section><h2>One</h2><p>{TEXTS[0]}</p></section><section><h2>Two</h2><p>{TEXTS[1]}</p><pre>x = 1</pre></section></main>", ["One", TEXTS[0], "Two", TEXTS[1], "x = 1"]),
    "details and an address": (f"<article><h1>Head</h1><p>{TEXTS[0]}</p><details><summary>More of it</summary><p>{TEXTS[1]}</p></details><address>Some place</address></article>", ["Head", TEXTS[0], "More of it", TEXTS[1], "Some place"]),
    "a list of definitions": (f"<article><h1>Head</h1><dl><dt>One</dt><dd>{TEXTS[0]}</dd><dt>Two</dt><dd>Short</dd></dl></article>", ["Head", "One", TEXTS[0], "Two", "Short"]),
    "an advert between": (f"<article><h1>Head</h1><p>{TEXTS[0]}</p><div class=advert><p>{TEXTS[2]}</p></div><p>{TEXTS[1]}</p></article>", ["Head", *TEXTS[:2]]),
    "comments of readers": (f"<article><h1>Head</h1><p>{TEXTS[0]}</p></article><div id=comments><div class=comment><p>{TEXTS[1]}</p></div><div class=comment>{TEXTS[2]}</div></div>", ["Head", TEXTS[0]]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(model, shape):
    source, want = SHAPES[shape]
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>{source}<footer>Copyright x</footer></body></html>"
    assert model.extract(page).split("\n") == want


def test_word_recall_and_precision(model):
    """Over all hand-written pages nearly every word of an article is kept, and nearly no other."""
    kept = wanted = right = 0
    for source, want in [*HAND_WRITTEN, *SHAPES.values()]:
        got = Counter(model.extract(f"<html><body>{source}</body></html>").split())
        words = Counter(" ".join(want).split())
        kept, wanted, right = kept + got.total(), wanted + words.total(), right + (got & words).total()
    assert right / wanted >= 0.98 and right / kept >= 0.98


def test_nested_lists_take_linear_time():
    unit = "<div>" * 90_000 + "<li></li>" * 50_000
    began = time.time()
    html_content.parse("<ul><li><ul>" + unit)
    assert time.time() - began < 8


@pytest.mark.parametrize("unit", ["<a ", "<a href=\"x' ", "<svg>", "<div>", "</x", "<![CDATA[", "<select><option>", "<p title='", "<b><i></b>"])
def test_linear_time(model, unit):
    source = unit * (1_000_000 // len(unit))
    began = time.time()
    html_content.parse(source)
    assert time.time() - began < 8  # a quadratic scan takes hours


def test_extra_columns(spark, model):
    table = spark.createDataFrame([(1, "u", page(""), "x", 3)], "page_id long, url string, html string, text string, base long")
    got = html_content.extract_main_text(table, model).collect()
    assert [(r.page_id, r.url, r.text) for r in got] == [(1, "u", f"{HEAD}\n{FIRST}\n{LAST}")]
