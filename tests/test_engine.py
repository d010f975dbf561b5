"""Extraction, tokens, layout and scalar functions on small cases; queries against DuckDB."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioscope.functions import text as T
from folioscope.operators import extract, layout, relational
from folioscope.operators.codetok import tokenize
from folioscope.operators.extract import absolute_url, code_of, extract_article, is_boilerplate, srcset
from folioscope.operators.dom import parse_document
from folioscope.plans import catalog, dimensions
from folioscope.sources import tables
from folioscope.sources.tables import accepted_pages, combined_lines, filter_lists, url_list
from folioscope.streaming.articles import stream_articles, write_stream

PAD = "<p>" + "Enough words to pass the score of a page. " * 8 + "</p>"


def blocks(inner, base="https://s.example/a/b"):
    got = extract_article(f"<html><head><title>T</title></head><body><article>{inner}{PAD}</article></body></html>", base)
    assert got["status"] == "ok"
    return [b for b in got["blocks"] if not (b["text"] or "").startswith("Enough words")]


def kinds(inner):
    return [(b["kind"], b["text"]) for b in blocks(inner)]


def test_blocks_in_page_order():
    assert kinds("<h2>Head <b>line</b></h2><p>One<br>two</p><blockquote><p>a</p><p>b</p></blockquote><hr><div>own <a>link</a> text<p>inner</p></div>") == [
        ("heading", "Head line"), ("paragraph", "One two"), ("quote", "a b"), ("divider", None), ("paragraph", "own link text"), ("paragraph", "inner"),
    ]


def test_pruned_subtrees():
    assert kinds("<nav>x</nav><div class='social-share'>x</div><div hidden>x</div><p style='display : none'>x</p><div role=search>x</div><p class='tag-modal'>kept</p>") == [("paragraph", "kept")]
    assert is_boilerplate("Advertisement") and not is_boilerplate("multimodal") and not is_boilerplate("post tag-banner") and is_boilerplate("tag-banner-related x related")


def test_lists_and_tables():
    got = blocks("<ol><li>a<ul><li>b</ul><li>c</ol><table><tr><th>h<th>i<tr><td>1<tr><td><ul><li>x<li>y</ul><td>2</table>")
    assert [(b["text"], b["ordered"], b["depth"]) for b in got[:3]] == [("a", True, 0), ("b", False, 1), ("c", True, 0)]
    assert got[3]["tbl"] == {"header": ["h", "i"], "rows": [["1", ""], ["• x\n• y", "2"]], "columns": 2}


def test_images():
    got = blocks("<p>t<img src=/x.png alt='short'></p><img src=/x.png alt='much longer'><img data-src='y.png' src='data:x'><ul><li><img src=gone.png></ul>")
    assert [(b["img_url"], b["alt"]) for b in got if b["kind"] == "image"] == [("https://s.example/x.png", "much longer"), ("https://s.example/a/y.png", "")]
    assert srcset("a.png 1x, b.png 3000w, c.png 2400w,") == [(2400, "a.png"), (2400, "b.png"), (2400, "c.png")]
    assert absolute_url("https://a.b/c", "javascript:x") is None and absolute_url("https://a.b/c", "//d.e/f") == "https://d.e/f"


def test_code_blocks():
    pre = "<pre class='brush: rust'><code>let a;\n<mark>let b;</mark>\n<mark>x</mark> y\n// highlight-start\nin\n// highlight-end\n<span class='line hl'>z\n</span>end  \n</code></pre>"
    got = blocks(pre)[0]
    assert (got["lang"], got["highlights"]) == ("rust", [1, 3, 4]) and got["text"].split("\n")[3] == "in"
    root = parse_document('<pre data-line="2, 4-5" data-line-offset="1">a\nb\nc\nd\ne\nf</pre>')
    assert code_of(next(e for e in root.walk() if e.tag == "pre"))[1] == [2, 4, 5]


def test_status_and_title():
    assert extract_article("", "u")["status"] == "no_content" and extract_article(None, None)["status"] == "no_content"
    thin = extract_article("<body><p>short</p>", "u")
    assert (thin["status"], thin["score"]) == ("too_thin", 55)
    got = extract_article(f"<title>A title that is long enough | Site</title><article><h1>A title that is long enough</h1>{PAD}</article>", "u")
    assert got["title"] == "A title that is long enough" and [b["kind"] for b in got["blocks"]] == ["paragraph"]
    wide = extract_article(f"<main><div class=entry>{PAD}</div>more</main>", "u")
    assert wide["container"] == "div"


def test_pruning_keeps_score():
    a, b = (extract_article(f"<article>{x}{PAD}</article>", "u")["score"] for x in ("", "<aside><p>much text here</p></aside>"))
    assert a == b


SNIPPETS = [
    ("py", 'def f(x): return "a\\"b" # c', [("def", "keyword"), ("f", "function"), ("return", "keyword"), ('"a\\"b"', "str"), ("# c", "comment")]),
    ("rust", "println!(1..5, 0xFFu8, Vec)", [("println", "function"), ("1", "number"), ("5", "number"), ("0xFFu8", "number"), ("Vec", "type")]),
    ("sql", "SELECT 'x' -- y", [("SELECT", "keyword"), ("'x'", "str"), ("-- y", "comment")]),
    ("html", '<a href="x>y">t</a>', [("a", "keyword"), ("href", "type"), ('"x>y"', "str"), ("a", "keyword")]),
    ("py", '"""a\nb"""', [('"""a', "str"), ('b"""', "str")]),
]


@pytest.mark.parametrize("lang,code,want", SNIPPETS)
def test_token_kinds(lang, code, want):
    assert [t for line in tokenize(code, lang) for t in line if t[1] != "plain"][: len(want)] == want


def test_tokens_round_trip():
    rng = random.Random(1)
    bits = ["'", '"', "`", "\\", "\n", "/*", "*/", "//", "#", "<a b='", ">", "é", "0x1F", "1.5e+3", "12..4", "foo(", "Bar", "@x", "$", " ", "\t", "<!--", "-->", "'''", "a_b"]
    for _ in range(800):
        code = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        for lang in (None, "py", "html", "rust", "sql", "js", "md"):
            assert "\n".join("".join(t for t, _ in line) for line in tokenize(code, lang)) == code


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def plain_chunks(text, most):
    if len(text) <= most:
        return [text]
    out, now = [], ""
    for w in text.split():
        if len(w) > most:
            out += [now] * bool(now) + [w[i : i + most] for i in range(0, len(w), most)]
            now = ""
        elif len(now) + len(w) + 1 > most:
            out, now = [*out, now], w
        else:
            now = f"{now} {w}" if now else w
    return out + [now] * bool(now)


def test_chunks(spark):
    rng = random.Random(2)
    texts = [" ".join("x" * rng.randint(1, 14) for _ in range(rng.randint(0, 20))) for _ in range(60)] + ["y" * 10 + " " + "z" * 40, "a  b"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.chunk_text(F.col("s"), 10).alias("c")).collect()
    assert all(r.c == plain_chunks(r.s, 10) for r in rows)


def test_scalars(spark):
    u = F.col("u")
    assert one(spark, T.output_name(u), u="https://a.b:80/x/My%20Page%C3%A9+1.html?q#f") == "a.b_80-my-page--1.pdf"
    assert one(spark, T.output_name(u), u="https://a.b/index.html") == "a.b.pdf" and one(spark, T.output_name(u), u="") == "sayfa.pdf"
    assert one(spark, T.percent_decode(u), u="a%2Bb+c%zz%E9%") == "a+b+c%zz�%"
    assert one(spark, T.clean_title(u), u="A title of enough length — Site | Other") == "A title of enough length — Site"
    assert one(spark, T.parse_ranges(u), u="2, 5-7,0,9-8,x") == [(2, 2), (5, 7)]
    assert one(spark, T.normalize_language(u), u=" language-TSX ") == "typescript"
    assert one(spark, T.restore(u, F.array(F.lit("p"))), u="no mark") is None
    assert one(spark, T.translated_text(u), u='{"sentences":[{"trans":"a "},{"trans":"b"}]}') == "a b"
    assert one(spark, T.pdf_date(F.lit(0))) == "D:19700101000000Z"
    assert one(spark, T.placeholder_source(u), u="/i/Spacer.gif") and not one(spark, T.placeholder_source(u), u="/i/real.gif")
    assert one(spark, T.host_label(u), u="nope") == "nope"
    assert dimensions.parse_option("code_theme", "GitHub") == "github-light" and dimensions.parse_option("font_size", "12") == 12
    for kind, bad in (("page", "b5"), ("font_size", "17"), ("theme", "x")):
        with pytest.raises(ValueError):
            dimensions.parse_option(kind, bad)


def test_page_lines():
    f = relational.page_lines
    assert f([0, 1, 2], 0, 10.0, 4.0) == 2 - (1 if 3 - 2 == 1 else 0)  # a single line is never left over
    assert f([0, 0, 0, 0, 0], 0, 8.0, 4.0) == 2  # an over-long unit is cut
    assert f([0, 1, 1, 1], 0, 12.0, 4.0) == 1  # units stay whole
    assert f([0], 0, 1.0, 4.0) == 0 and f([], 0, 9.0, 4.0) == 0


@pytest.mark.parametrize("unit, close", [("<div>", "</div>"), ("<b>", "</b>"), ("<ul><li>", "</li></ul>"), ("<table><tr><td>", "</td></tr></table>"), ("<span>", ""), ("<pre>", ""), ("<blockquote>", "")])
def test_deep_pages(unit, close):
    got = extract_article(f"<html><body><article>{unit * 20_000}deep words{close * 20_000}{PAD}</article></body></html>", "https://s.example/")
    assert got["status"] == "ok" and any("deep words" in (b["text"] or str(b.get("tbl"))) for b in got["blocks"])


def test_call_behind_many_spaces():
    assert tokenize("foo" + " " * 250 + "(1)", None)[0][0] == ("foo", "function")


def test_pixel_sizes():
    be, le = lambda n, k: n.to_bytes(k, "big"), lambda n, k: n.to_bytes(k, "little")
    frame = lambda m, w, h: bytes([0xFF, m]) + be(17, 2) + b"\x08" + be(h, 2) + be(w, 2) + b"\x03"
    thumb = b"\xff\xe1" + be(2 + 13, 2) + frame(0xC0, 9, 9)[:13].ljust(13, b"\0")
    for marker in (0xC0, 0xC1, 0xC2, 0xC9):
        assert T.pixel_size(b"\xff\xd8" + thumb + b"\xff\xc4" + be(5, 2) + b"abc" + frame(marker, 640, 480)) == (640, 480)
    assert T.pixel_size(b"\xff\xd8" + thumb) is None and T.pixel_size(b"") is None and T.pixel_size(None) is None
    assert T.pixel_size(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + le(29 | 19 << 14, 4)) == (30, 20)
    assert T.pixel_size(b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0abc\x9d\x01\x2a" + le(30, 2) + le(20, 2)) == (30, 20)
    assert T.pixel_size(b"<svg width='2in' viewBox='0 0 10 40'>") == (192, 40) and T.pixel_size(b"<svg viewBox='0,0,30.5,20'/>") == (31, 20)
    assert T.pixel_size(b"<svg width='100%'>") is None


def test_literal_palettes_and_markers(spark):
    """Some fixed values written out again, as the queries' SQL is made from the same lists."""
    colours = {(r.theme, r.role): r.colour for r in dimensions.code_palettes(spark).collect()}
    assert len(colours) == 84 and colours["github-light", "keyword"] == "CF222E" and colours["monokai", "function"] == "A6E22E" and colours["solarized-dark", "background"] == "002B36" and colours["sepia", "comment"] == "8A7355"
    assert {r.theme: (r.text, r.background, r.code_theme) for r in dimensions.themes(spark).collect()}["dark"] == ("E4E7EB", "16191D", "dark-on-page")
    for name in ("sidebar", "my-widget-1", "cookies", "related", "post navigation", "skip_link", "newsletter-box"):
        assert is_boilerplate(name), name
    for name in ("content", "navigation", "ad", "post", "subtitle", "category-sidebar"):
        assert not is_boilerplate(name), name


def test_lists_and_articles_written(spark, tmp_path):
    lists = spark.createDataFrame([("easy", "||a.example^\n! c"), ("private", "||b.example^")], "name string, text string")
    tables.write_lists(lists, str(tmp_path / "lists"))
    held = filter_lists(spark, str(tmp_path / "lists" / "*" / "*.txt"))
    assert sorted(r.raw for r in combined_lines(held).filter("raw <> ''").collect()) == ["! c", "||a.example^", "||b.example^"]
    assert held.filter("fresh").count() == held.count() and tables.cache_age(held).first().age_s >= 0
    pages = spark.createDataFrame([(1, "https://s.example/x.html", f"<article>{PAD}</article>"), (2, "https://t.example/", None)], "page_id long, url string, html string")
    tables.write_articles(extract.extract_articles(pages), str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("output_name", "status").collect())) == [("s.example-x.pdf", "ok"), ("t.example.pdf", "no_content")]


def test_text_rules_by_join(spark, monkeypatch):
    urls = spark.createDataFrame([(u,) for u in ("https://x.example/ads/banner-1.png", "https://x.example/pic.png", "https://y.example/AD", "https://z.example/a/b")], "img_url string")
    rules = relational.parse_rules(spark.createDataFrame([("/banner-",), ("/ad",), ("never-there-at-all",), ("@@y.example/ad",)], "raw string"))
    want = sorted(r[0] for r in relational.blocked_urls(urls, rules).collect())
    monkeypatch.setattr(relational, "MAX_TEXT_RULES", 0)
    assert sorted(r[0] for r in relational.blocked_urls(urls, rules).collect()) == want == ["https://x.example/ads/banner-1.png"]


def test_list_quirks(spark):
    rows = [(1, i, o, d, r) for r, items in ((1, [(True, 1), (True, 0)]), (2, [(True, 0), (True, 1), (True, 0), (True, 1)])) for i, (o, d) in enumerate(items, 10 * r)]
    got = layout.list_layout(spark.createDataFrame(rows, "page_id int, pos int, ordered boolean, depth int, run int")).orderBy("pos").collect()
    assert [r.bullet for r in got] == ["1.", None, "1.", "1.", "2.", "2."]


def test_rules(spark):
    rules = relational.parse_rules(spark.createDataFrame([("||ads.example^",), ("@@||good.ads.example^$image",), ("/banner-ad-$image",), ("||script.example^$script",), ("! c",), ("x##y",)], "raw string"))
    urls = ["https://a.ads.example/x", "https://good.ads.example/x", "https://o.example/banner-ad-1.png", "https://script.example/a.js", "https://badads.example/", "not a url"]
    got = relational.blocked_urls(spark.createDataFrame([(u,) for u in urls], "img_url string"), rules).collect()
    assert {r.img_url for r in got} == {urls[0], urls[2]}


def test_sources(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text("||x^\n! c")
    lists = filter_lists(spark, str(tmp_path / "l"))
    assert lists.first().fresh and combined_lines(lists).count() == 2
    rows = spark.createDataFrame([("u", 200, "text/html", b"\xe9"), ("v", None, None, b""), ("w", 200, "image/png", b"")], "url string, status int, content_type string, body binary")
    assert {r.url: (r["class"], r.html) for r in accepted_pages(rows).collect()} == {"u": ("ok", "é"), "v": ("retry", None), "w": ("type_error", None)}
    with pytest.raises(ValueError):
        url_list(spark, [])


def test_stream(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.write.parquet(str(tmp_path / "in"))
    write_stream(stream_articles(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == pages.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    rows = lambda rs: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rs)
    got = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.fetchall())


def test_names_and_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in entry.queries())


def test_image_sizes_as_columns(spark):
    """The first bytes of a header give what the whole body gives, cut anywhere."""
    le = lambda n, k: n.to_bytes(k, "little")
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + (70_000).to_bytes(4, "big") + (9).to_bytes(4, "big") + b"rest"
    webp = [b"RIFFabcdWEBPVP8X" + bytes(8) + le(69_999, 3) + le(8, 3), b"RIFFabcdWEBPVP8L" + bytes(4) + b"\x2f" + le(29 | 16_382 << 14, 4) + bytes(9), b"RIFFabcdWEBPVP8 " + bytes(4) + b"abc\x9d\x01\x2a" + le(30 | 1 << 14, 2) + le(20, 2), b"RIFFabcdWEBPXXXX" + bytes(20)]
    bodies = [png, b"GIF89a" + le(300, 2) + le(2, 2) + b"more", *webp, b"<svg width='3' height='4' title='a > b'>", b"<svg title='>' width='7' height='8'>", b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x05\x00\x06\x03", b"", None]
    bodies += [b[:k] for b in bodies[:6] for k in (7, 9, 12, 16, 20, 23, 24, 25, 29)]
    rows = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(bodies)], "i int, body binary")
    rows = rows.withColumn("s", T.image_size(F.col("body")))
    got = {r.i: (r.s.width, r.s.height) for r in rows.collect()}
    assert got == {i: T.pixel_size(b) or (None, None) for i, b in enumerate(bodies)}
    assert got[0] == (70_000, 9) and got[2] == (70_000, 9) and got[3] == (30, 16_383) and got[4] == (30, 20) and got[7] == (7, 8) and got[8] == (6, 5)
