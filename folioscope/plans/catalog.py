"""Queries over the test tables, each with the SQL that gives the same rows.

Inputs that the page table does not have (lists, tables, code, images, rules, responses)
are markup or bytes put around table values, so the expected rows are SQL over those values.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import address
from folioscope.functions import constants as K
from folioscope.functions import text as T
from folioscope.operators import codetok, extract, filters, layout, relational
from folioscope.plans import dimensions, sql_functions
from folioscope.sources.tables import document_metadata, read_table, refreshed_lists, run_summary, settled_attempts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_PAD = "<p>" + "Padding words that carry the page over the score. " * 5 + "</p>"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_articles(read_table(spark, sf_dir, "pages"))


def _blocks_of(html: DataFrame, key: str) -> DataFrame:
    """Blocks of composed pages (key, html), without the padding paragraph."""
    pages = html.select(key, F.lit("https://site.example/a/").alias("url"), "html")
    return extract.explode_blocks(extract.extract_articles(pages, keep=(key,)), key).filter(~F.coalesce(F.col("text"), F.lit("")).startswith("Padding words"))


def _page(*parts: Column | str) -> Column:
    return F.concat(F.lit(f"<html><body><article>{_PAD}"), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("</article></body></html>"))


def _joined(value: Column, order: Column, between: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), between)


# ---- SQL shared by the page queries

_UNESCAPE = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PAGE_SQL = rf"""
    raw AS (
        SELECT page_id, url, {_CLEAN.format(_UNESCAPE.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))} AS title,
               regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS art, regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS ad FROM pages),
    nodes AS (SELECT page_id, list_transform(regexp_split_to_array(art, '<[^>]*>'), lambda x: {_CLEAN.format(_UNESCAPE.format("x"))}) AS a, {_CLEAN.format(_UNESCAPE.format("ad"))} AS ad_text FROM raw),
    sized AS (
        SELECT page_id, url, title, art, ad_text, CAST(list_sum(list_transform(a, lambda x: strlen(x))) AS BIGINT) + 50 * CAST(len(regexp_extract_all(art, '<p>')) AS BIGINT) AS s, strlen(ad_text) AS d
        FROM raw JOIN nodes USING (page_id)),
    status AS (
        SELECT *, CASE WHEN s >= 200 THEN s WHEN greatest(s, d) >= 200 THEN greatest(s, d) ELSE s + d END AS score,
               CASE WHEN s >= 200 THEN 'article' WHEN d >= 200 THEN 'div' WHEN s + d >= 200 THEN 'body' END AS container FROM sized),
    pieces AS (
        SELECT page_id, title, i AS place, i = 2 AS is_h, {_CLEAN.format(_UNESCAPE.format(r"regexp_replace(regexp_replace(p[i], '<br>', ' ', 'g'), '<[^>]*>', '', 'g')"))} AS text
        FROM (SELECT page_id, title, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, title, regexp_split_to_array(art, '</?(?:p|h1)>') AS p FROM status WHERE container IN ('article', 'body')))
        UNION ALL SELECT page_id, title, 0, false, ad_text FROM status WHERE container IN ('body', 'div')),
    filled AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n FROM pieces WHERE text <> ''),
    told AS (
        SELECT *, n = 1 AND length(text) >= 12 AND title <> '' AND (lower(text) = lower(title) OR (length(text) >= 40 AND contains(lower(title), lower(text)))
               OR (starts_with(lower(text), lower(title)) AND (length(title) >= 40 OR (length(text) >= 40 AND length(title) >= 20)))) AS again FROM filled),
    blocks AS (
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS pos, CASE WHEN is_h THEN 'heading' ELSE 'paragraph' END AS kind, CAST(CASE WHEN is_h THEN 1 END AS INTEGER) AS level, text
        FROM told WHERE NOT again)"""
_HOST = "regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '[^0-9A-Za-z.-]', '_', 'g')"
_STEM = r"trim(regexp_replace(lower(split_part(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[-1], '.', 1)), '[^0-9a-z_-]', '-', 'g'), '-')"
_NAME = f"CASE WHEN {_HOST} = '' THEN 'sayfa.pdf' ELSE {_HOST} || coalesce('-' || CASE WHEN {_STEM} NOT IN ('', 'index', 'default', 'home') THEN substr({_STEM}, 1, 60) END, '') || '.pdf' END"


@query(f"WITH {_PAGE_SQL} SELECT page_id, CASE WHEN contains(title, ' | ') AND length(trim(split_part(title, ' | ', 1))) >= 15 THEN trim(split_part(title, ' | ', 1)) ELSE title END AS title FROM raw")
def page_title(spark, sf_dir):
    return _articles(spark, sf_dir).select("page_id", "title")


@query(f"SELECT page_id, {_HOST} AS host, {_NAME} AS output_name FROM pages")
def page_output_name(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", T.host(F.col("url")).alias("host"), T.output_name(F.col("url")).alias("output_name"))


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def pages_per_host_top10(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query(f"WITH {_PAGE_SQL} SELECT page_id, CASE WHEN container IS NOT NULL THEN 'ok' WHEN score > 0 THEN 'too_thin' ELSE 'no_content' END AS status, score, container FROM status")
def article_status(spark, sf_dir):
    return _articles(spark, sf_dir).select("page_id", "status", "score", "container")


@query(f"WITH {_PAGE_SQL} SELECT * REPLACE (coalesce(level, 0) AS level) FROM blocks")
def article_blocks(spark, sf_dir):
    return extract.explode_blocks(_articles(spark, sf_dir)).select("page_id", "pos", "kind", F.coalesce("level", F.lit(0)).alias("level"), "text")


@query(f"WITH {_PAGE_SQL} SELECT {_HOST} AS host, kind, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM blocks JOIN pages USING (page_id) GROUP BY ALL")
def blocks_by_kind(spark, sf_dir):
    """The flagship: blocks and characters of every host by kind of block."""
    blocks = _articles(spark, sf_dir).select(T.host(F.col("url")).alias("host"), F.explode("blocks").alias("b"))
    return blocks.groupBy("host", F.col("b.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("b.text")).cast("long").alias("n_chars"))


@query(f"WITH {_PAGE_SQL} SELECT count(*) FILTER (container IS NOT NULL) AS ok, count(*) FILTER (container IS NULL) AS failed, CAST(count(*) FILTER (container IS NOT NULL) = 0 AS INTEGER) AS exit_code FROM status")
def extraction_run(spark, sf_dir):
    return run_summary(_articles(spark, sf_dir))


@query(
    f"""WITH {_PAGE_SQL} SELECT page_id, {_HOST} AS author, {_NAME} AS output_name, count(*) AS n_blocks, count(*) FILTER (kind = 'heading') AS n_bookmarks, false AS needs_mono,
        CAST(0 AS BIGINT) AS n_images, len(list_distinct(flatten(list(string_split(text, ''))))) AS n_glyphs FROM blocks JOIN pages USING (page_id) GROUP BY page_id, url"""
)
def render_summary(spark, sf_dir):
    blocks = _articles(spark, sf_dir).select("page_id", "url", F.explode("blocks").alias("b"))
    # distinct characters of a block first, so a page gathers alphabets, not texts
    glyphs = F.size(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.array_distinct(F.split("b.text", ""))))))).cast("long")
    return blocks.groupBy("page_id", T.host(F.col("url")).alias("author"), T.output_name(F.col("url")).alias("output_name")).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("b.kind") == "heading").alias("n_bookmarks"), F.bool_or(F.col("b.kind") == "code").alias("needs_mono"), F.count_if(F.col("b.kind") == "image").alias("n_images"), glyphs.alias("n_glyphs")
    )


# ---- characters


@query("SELECT ch, count(*) AS n_docs FROM (SELECT doc_id, unnest(list_distinct(string_split(text, ''))) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def doc_charset(spark, sf_dir):
    return relational.charset(read_table(spark, sf_dir, "documents"), "doc_id").groupBy("ch").agg(F.count(F.lit(1)).alias("n_docs"))


def _ascii(spark) -> DataFrame:
    return spark.range(33, 127).select(F.char(F.col("id")).alias("ch"))


_MISSING = r"(unicode(ch) > 126 AND NOT regexp_matches(ch, '^[\x{7F}-\x{A0}\x{AD}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FEFF}]$'))"


@query(f"SELECT ch, count(*) AS n_docs FROM (SELECT unnest(list_distinct(string_split(text, ''))) AS ch FROM documents) WHERE ch <> '' AND {_MISSING} GROUP BY ch ORDER BY unicode(ch) LIMIT 12")
def missing_glyphs_top12(spark, sf_dir):
    chars = relational.charset(read_table(spark, sf_dir, "documents"), "doc_id").groupBy("ch").agg(F.count(F.lit(1)).alias("n_docs"))
    return relational.missing_glyphs(chars, _ascii(spark)).orderBy(F.hex(F.encode("ch", "UTF-32"))).limit(12).select("ch", "n_docs")


@query(
    f"""WITH c AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS place, text FROM documents),
        d AS (SELECT doc_id, place - 1 AS place, {_MISSING} AS f FROM (SELECT doc_id, place, text[place] AS ch FROM c)),
        g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) - row_number() OVER (PARTITION BY doc_id, f ORDER BY place) AS g FROM d),
        r AS (SELECT doc_id, f, min(place) AS s, count(*) AS n FROM g GROUP BY doc_id, f, g)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) AS INTEGER) AS run, f AS needs_fallback, CAST(s AS INTEGER) AS start, CAST(n AS INTEGER) AS n_chars FROM r"""
)
def coverage_runs(spark, sf_dir):
    return relational.coverage_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", r"\x21-\x7E")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]')) AS INTEGER) AS n_invisible FROM documents")
def invisible_chars(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(T.INVISIBLE)).alias("n_invisible"))


@query(r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_chars, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS sha FROM documents")
def clean_texts(spark, sf_dir):
    t = T.clean_text(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("sha"))


# ---- wrapping


@query(
    """WITH l AS (SELECT doc_id, u.i AS line_no, u.l AS line FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'l': x, 'i': i - 1})) AS u FROM documents)),
       p AS (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((length(line) - 55) / 53.0) AS BIGINT)))) AS part FROM l)
       SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(part AS INTEGER) AS part, CASE WHEN part = 0 THEN substr(line, 1, 55) ELSE substr(line, 56 + (part - 1) * 53, 53) END AS text FROM p"""
)
def visual_chunks(spark, sf_dir):
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.posexplode(T.visual_chunks(F.col("line"), F.lit(55), F.lit(53))).alias("part", "text"))


@query(
    r"""WITH w AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
        f AS (SELECT doc_id, text, list_reduce(list_transform(ws, lambda x: [x]), lambda acc, x:
                CASE WHEN length(x[1]) > 400 THEN acc[:-2] || CASE WHEN acc[-1] <> '' THEN [acc[-1]] ELSE [] END || list_transform(range(1, length(x[1]) + 1, 400), lambda k: substr(x[1], k, 400)) || ['']
                     WHEN length(acc[-1]) + length(x[1]) + 1 > 400 THEN acc || x
                     ELSE acc[:-2] || [CASE WHEN acc[-1] <> '' THEN acc[-1] || ' ' || x[1] ELSE x[1] END] END, ['']) AS c FROM w),
        g AS (SELECT doc_id, CASE WHEN length(text) <= 400 THEN [text] WHEN c[-1] = '' THEN c[:-2] ELSE c END AS c FROM f)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS no, CAST(length(c[i]) AS INTEGER) AS n_chars, sha256(c[i]) AS sha FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM g)"""
)
def text_chunks(spark, sf_dir):
    """Pieces of at most 400 characters."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunk_text(F.col("text"), 400)).alias("no", "chunk"))
    return rows.select("doc_id", "no", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("sha"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '    │ » ' ELSE lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(3, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), ' ') || ' │ ' END AS marker,
       CASE WHEN l_linenumber % 3 = 0 THEN '» ' ELSE '' END AS plain FROM lineitem"""
)
def gutter_markers(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem")
    mark = lambda numbers: T.gutter_marker(F.col("l_partkey"), F.lit(3), F.col("l_linenumber") % 3 == 0, F.lit(numbers))
    return rows.select("l_orderkey", "l_linenumber", mark(True).alias("marker"), mark(False).alias("plain"))


# ---- tables, lists


def _nation_tables(spark, sf_dir) -> DataFrame:
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    row = F.concat(F.lit("<tr><td>"), F.col("n_name"), F.lit("<td>  "), F.col("n_nationkey").cast("string"), F.lit("<br>key</tr>"))
    tables = nation.groupBy("n_regionkey").agg(_joined(row, F.col("n_nationkey")).alias("rows"))
    pages = region.join(tables, F.col("r_regionkey") == F.col("n_regionkey"))
    return pages.select(F.col("r_regionkey").cast("long").alias("page_id"), _page("<table><thead><tr><th>Nation<th>Key</tr></thead><tbody>", F.col("rows"), "</tbody></table>").alias("html"))


@query(
    """SELECT CAST(n_regionkey AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row_no,
       n_name AS name, n_nationkey || chr(10) || 'key' AS code, 'Nation|Key' AS header, 2 AS columns FROM nation"""
)
def table_extract(spark, sf_dir):
    blocks = _blocks_of(_nation_tables(spark, sf_dir), "page_id").filter("kind = 'table'")
    rows = blocks.select("page_id", F.posexplode("tbl.rows").alias("row_no", "r"), F.array_join("tbl.header", "|").alias("header"), F.col("tbl.columns").alias("columns"))
    return rows.select("page_id", "row_no", F.col("r")[0].alias("name"), F.col("r")[1].alias("code"), "header", "columns")


@query(
    """WITH c AS (SELECT n_regionkey, 0 AS col, length(n_name) AS n FROM nation UNION ALL SELECT n_regionkey, 1, length(CAST(n_nationkey AS VARCHAR)) + 4 FROM nation
       UNION ALL SELECT r_regionkey, 0, 6 FROM region UNION ALL SELECT r_regionkey, 1, 3 FROM region)
       SELECT CAST(n_regionkey AS BIGINT) AS page_id, CAST(col AS INTEGER) AS col, CAST(greatest(1, least(3, (sum(n) // count(*)) // 20)) AS INTEGER) AS weight FROM c GROUP BY ALL"""
)
def column_weights(spark, sf_dir):
    blocks = _blocks_of(_nation_tables(spark, sf_dir), "page_id").filter("kind = 'table'")
    return relational.column_weights(blocks, "page_id")


@query(
    """SELECT k AS page_id, CASE WHEN n <= 30 THEN 'table' ELSE 'paragraph' END AS kind, CASE WHEN n <= 30 THEN 1 ELSE n END AS n_blocks FROM (
       SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 100 + CAST(s_nationkey AS BIGINT), count(*) FROM supplier GROUP BY 1)"""
)
def layout_tables(spark, sf_dir):
    """Tables without a header count as layout beyond thirty rows; their cells are then ordinary blocks."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("page_id"), F.col("c_custkey").alias("o"), F.col("c_name").alias("name"))
    s = read_table(spark, sf_dir, "supplier").select((F.col("s_nationkey").cast("long") + 100).alias("page_id"), F.col("s_suppkey").alias("o"), F.col("s_name").alias("name"))
    rows = c.union(s).groupBy("page_id").agg(_joined(F.concat(F.lit("<tr><td>"), F.col("name"), F.lit("</td></tr>")), F.col("o")).alias("rows"))
    blocks = _blocks_of(rows.select("page_id", _page("<table>", F.col("rows"), "</table>").alias("html")), "page_id")
    return blocks.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n_blocks"))


def _list_blocks(spark, sf_dir) -> DataFrame:
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    inner = nation.groupBy("n_regionkey").agg(_joined(F.concat(F.lit("<li>"), F.col("n_name")), F.col("n_nationkey")).alias("items"))
    outer = region.join(inner, F.col("r_regionkey") == F.col("n_regionkey")).groupBy().agg(
        _joined(F.concat(F.lit("<li>"), F.col("r_name"), F.lit("<ol>"), F.col("items"), F.lit("</ol></li>")), F.col("r_regionkey")).alias("items")
    )
    return _blocks_of(outer.select(F.lit(1).cast("long").alias("page_id"), _page("<ul>", F.col("items"), "</ul><p>end of the list</p><ul><li>last</ul>").alias("html")), "page_id")


_LIST_SQL = """items AS (SELECT r_regionkey AS r, -1 AS n, r_name AS text, false AS ordered, 0 AS depth FROM region UNION ALL SELECT n_regionkey, n_nationkey, n_name, true, 1 FROM nation
    UNION ALL SELECT 1000, 0, 'last', false, 0)"""


@query(
    f"""WITH {_LIST_SQL} SELECT CAST(row_number() OVER (ORDER BY r, n) AS INTEGER) AS item, text, ordered, CAST(depth AS INTEGER) AS depth, CASE WHEN r = 1000 THEN 2 ELSE 1 END AS run,
        CASE WHEN ordered THEN row_number() OVER (PARTITION BY r, ordered ORDER BY n) || '.' ELSE '•' END AS bullet, CAST(10 * (depth + 1) AS DOUBLE) AS indent_mm, CAST(174 - 10 * (depth + 1) AS DOUBLE) AS text_mm FROM items"""
)
def list_numbers(spark, sf_dir):
    items = relational.list_runs(_list_blocks(spark, sf_dir)).select("page_id", "pos", "text", "ordered", "depth", "run")
    numbered = layout.list_layout(items, width_mm=174.0)
    return numbered.select(F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).alias("item"), "text", "ordered", "depth", "run", "bullet", "indent_mm", "text_mm")


# ---- images


@query("SELECT p_brand, arg_max(p_partkey, CAST(p_size AS BIGINT) * 1000000000 + p_partkey) || '.png' AS url FROM part GROUP BY p_brand")
def srcset_best(spark, sf_dir):
    piece = F.concat(F.col("p_partkey").cast("string"), F.lit(".png "), F.col("p_size").cast("string"), F.lit("w"))
    sets = read_table(spark, sf_dir, "part").groupBy("p_brand").agg(_joined(piece, F.col("p_partkey"), ", ").alias("srcset"))
    return sets.select("p_brand", T.best_srcset(F.col("srcset")).alias("url"))


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS page_id, 'https://site.example/' || CASE p_partkey % 4 WHEN 0 THEN 'a/real-' WHEN 1 THEN 'a/lazy-' WHEN 2 THEN 'set-' ELSE 'a/wide-' END || p_partkey || '.png' AS img_url,
       CASE WHEN p_partkey % 4 = 1 THEN 'titled' ELSE p_name END AS alt FROM part"""
)
def image_source(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    part = read_table(spark, sf_dir, "part")
    img = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('<img src="real-'), key, F.lit('.png" data-src="other.png" alt="'), F.col("p_name"), F.lit('">')))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('<img src="data:image/gif;base64,R0" data-src="lazy-'), key, F.lit('.png" alt=" " title="titled">')))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit('<picture><source srcset="/x.svg, /set-'), key, F.lit('.png 2x"><img src="/i/spacer.gif" aria-label="'), F.col("p_name"), F.lit('"></picture>')))
        .otherwise(F.concat(F.lit('<img srcset="thin.png 10w, wide-'), key, F.lit('.png 20w, small.png" alt="'), F.col("p_name"), F.lit('">')))
    )
    pages = part.select(F.col("p_partkey").cast("long").alias("page_id"), _page("<figure>", img, "</figure>").alias("html"))
    return _blocks_of(pages, "page_id").filter("kind = 'image'").select("page_id", "img_url", "alt")


@query(
    """WITH i AS (SELECT s_nationkey AS page_id, s_suppkey AS pos, 'u' || s_suppkey % 3 AS img_url, s_name || repeat('x', CAST(s_suppkey % 5 AS INTEGER)) AS alt FROM supplier)
       SELECT page_id, min(pos) AS pos, img_url, arg_max(alt, strlen(alt) * 1000000000 - pos) AS alt FROM i GROUP BY page_id, img_url"""
)
def image_collapse(spark, sf_dir):
    rows = read_table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("page_id"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("u"), (F.col("s_suppkey") % 3).cast("string")).alias("img_url"), F.concat("s_name", F.repeat(F.lit("x"), (F.col("s_suppkey") % 5).cast("int"))).alias("alt")
    )
    return relational.collapse_images(rows)


@query(
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'png' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'png' WHEN 5 THEN 'webp' WHEN 6 THEN 'jpeg' ELSE 'svg' END AS format,
       CASE WHEN p_partkey % 8 NOT IN (2, 4) THEN p_size ELSE 0 END AS width_px, CASE WHEN p_partkey % 8 NOT IN (2, 4) THEN p_size + 7 ELSE 0 END AS height_px,
       CASE WHEN p_partkey % 8 IN (2, 4) THEN 'failed' WHEN p_size < CASE WHEN p_partkey % 8 = 7 THEN 12 ELSE 24 END THEN 'skipped' ELSE 'loaded' END AS outcome,
       CASE p_partkey % 8 WHEN 2 THEN 'network' WHEN 4 THEN 'decode' END AS reason FROM part"""
)
def image_outcome(spark, sf_dir):
    """Headers of every format; the JPEGs have a thumbnail's frame inside a segment, and one is progressive."""
    return _image_outcomes(spark, sf_dir).select("p_partkey", "format", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("width_px", "height_px")), "outcome", "reason")


def _image_outcomes(spark, sf_dir) -> DataFrame:
    hex4 = lambda c: F.lpad(F.hex(c), 8, "0")
    hex2 = lambda c: F.lpad(F.hex(c), 4, "0")
    little = lambda c: F.concat(F.substring(hex2(c), 3, 2), F.substring(hex2(c), 1, 2))
    w, h, k = F.col("p_size").cast("long"), (F.col("p_size") + 7).cast("long"), F.col("p_partkey") % 8
    thumbnail = "FFE1000DFFD8FFC000110800010001"  # a segment of 13 bytes that holds another frame
    jpeg = lambda frame: F.concat(F.lit(f"FFD8FFE000074A46494600{thumbnail}FF{frame}001108"), hex2(h), hex2(w), F.lit("03"))
    body = (
        F.when(k == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex4(w), hex4(h), F.lit("0806")))
        .when(k == 1, F.concat(F.lit("474946383961"), little(w), little(h), F.lit("F700")))
        .when(k == 2, F.lit(""))
        .when(k == 3, jpeg("C0"))
        .when(k == 5, F.concat(F.lit("524946461600000057454250565038580A00000000000000"), little(w - 1), F.lit("00"), little(h - 1), F.lit("00")))
        .when(k == 6, jpeg("C2"))
        .when(k == 7, F.hex(F.concat(F.lit('<?xml version="1.0"?><svg viewBox="0 0 9 9" width="'), w.cast("string"), F.lit('px" height="'), h.cast("string"), F.lit('"></svg>'))))
        .otherwise(F.lit("00010203"))
    )
    kind = F.when(k == 1, "image/gif").when(k == 0, "image/png")
    rows = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.lit("https://img.example/"), F.col("p_partkey").cast("string")).alias("url"), kind.alias("content_type"), F.unhex(body).alias("body"))
    return relational.image_outcomes(rows)


@query(
    """WITH i AS (SELECT *, p_partkey % 8 = 7 AS svg, CAST(CAST(2.1 AS FLOAT) AS DOUBLE) AS s FROM part WHERE p_partkey % 8 NOT IN (2, 4) AND p_size >= CASE WHEN p_partkey % 8 = 7 THEN 12 ELSE 24 END),
        p AS (SELECT p_partkey, p_retailprice, CASE WHEN svg THEN CAST(round(p_size * s) AS INTEGER) ELSE p_size END AS w, CASE WHEN svg THEN CAST(round((p_size + 7) * s) AS INTEGER) ELSE p_size + 7 END AS h, CASE WHEN svg THEN 96 * s ELSE 96::DOUBLE END AS dpi FROM i),
        m AS (SELECT *, w * 25.4 / dpi AS mm, h * 25.4 / dpi AS mh FROM p), f AS (SELECT *, greatest(0.01, least(1.0, 8.0 / mm, p_retailprice / 100 / mh)) AS k FROM m)
        SELECT p_partkey, CAST(w AS INTEGER) AS width_px, CAST(h AS INTEGER) AS height_px, CAST(round(dpi, 6) AS DOUBLE) AS dpi, CAST(round(mm * k, 6) AS DOUBLE) AS width_mm, CAST(round(mh * k, 6) AS DOUBLE) AS height_mm FROM f"""
)
def image_prepared(spark, sf_dir):
    """Images as they are printed: drawings rasterized beyond their own pixels, all fitted into eight mm by a hundredth of a price."""
    prices = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("room"))
    rows = relational.prepared_images(_image_outcomes(spark, sf_dir).join(prices, "p_partkey"), F.lit(8.0), F.col("room"))
    return rows.select("p_partkey", F.col("print_width_px").alias("width_px"), F.col("print_height_px").alias("height_px"), *(F.round(c, 6).alias(c) for c in ("dpi", "width_mm", "height_mm")))


@query(
    """SELECT p_brand, count(*) FILTER (p_partkey % 8 NOT IN (2, 4) AND p_partkey % 9 <> 0 AND p_size >= CASE WHEN p_partkey % 8 = 7 THEN 12 ELSE 24 END) AS loaded, count(*) FILTER (p_partkey % 8 NOT IN (2, 4) AND p_partkey % 9 <> 0 AND p_size < CASE WHEN p_partkey % 8 = 7 THEN 12 ELSE 24 END) AS skipped,
       count(*) FILTER (p_partkey % 8 IN (2, 4) OR p_partkey % 9 = 0) AS failed, count(*) FILTER (p_partkey % 8 = 7 AND p_partkey % 9 <> 0 AND p_size >= 12) AS rasterized FROM part GROUP BY p_brand"""
)
def image_counts(spark, sf_dir):
    """Outcomes of image blocks, counted; one without a response has failed."""
    known = _image_outcomes(spark, sf_dir)
    blocks = known.select("p_brand", F.col("url").alias("img_url"), F.col("format").alias("own"))
    told = relational.with_outcome(blocks, known.filter("p_partkey % 9 <> 0"))
    return relational.image_counters(told.withColumnRenamed("own", "format"), "p_brand")


@query("SELECT DISTINCT 'https://img.example/' || p_size AS img_url FROM part WHERE p_size % 4 <> 0")
def prefetch_list(spark, sf_dir):
    urls = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("https://img.example/"), F.col("p_size").cast("string"))).otherwise(F.lit(""))
    return relational.prefetch_urls(read_table(spark, sf_dir, "part").select(urls.alias("img_url")))


@query(
    """SELECT p_partkey, greatest(0.01, least(1.0, least(1.0, 174.0 / (p_size * 20 * 25.4 / 96), 200.54 / (p_retailprice * 25.4 / 96)))) AS scale,
       CAST(least(least(2.1, 2400.0 / greatest(p_size * 20.0, p_retailprice)), sqrt(16e6 / (p_size * 20.0 * p_retailprice))) AS FLOAT) AS raster FROM part"""
)
def image_fit(spark, sf_dir):
    w, h = F.col("p_size") * 20.0, F.col("p_retailprice")
    mm = lambda px: T.natural_mm(px, F.lit(96.0))
    return read_table(spark, sf_dir, "part").select("p_partkey", T.fit_scale(mm(w), mm(h), F.lit(174.0), F.lit(200.54)).alias("scale"), T.raster_scale(w, h).alias("raster"))


@query(
    """SELECT p_partkey, CAST((p_size * (p_partkey % 256) + 255 * (255 - p_partkey % 256)) // 255 AS INTEGER) AS channel,
       greatest(0.0, p_size - 10.0::DOUBLE) * k AS lower_left, 4.0::DOUBLE * k AS upper_right
       FROM (SELECT *, least(1.0::DOUBLE, p_partkey % 90 / greatest(1e-6, greatest(0.0, p_size - 10.0::DOUBLE) + 2), p_partkey % 90 / 4.0::DOUBLE, 30 / greatest(1e-6, greatest(0.0, p_size - 10.0::DOUBLE)), 30 / 6.0::DOUBLE) AS k FROM part)"""
)
def pixel_and_corner(spark, sf_dir):
    """Pixels over white, and corners of boxes p_partkey % 90 wide and 30 high with radii (p_size - 10, 2, 4, 0)."""
    alpha, radius = F.col("p_partkey") % 256, F.col("p_size") - F.lit(10.0)
    corners = T.fit_radii(F.col("p_partkey") % 90, F.lit(30.0), (radius, F.lit(2.0), F.lit(4.0), F.lit(0.0)))
    return read_table(spark, sf_dir, "part").select("p_partkey", T.blend_on_white(F.col("p_size"), alpha).alias("channel"), corners[0].alias("lower_left"), corners[2].alias("upper_right"))


@query(
    r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages),
        b AS (SELECT DISTINCT host FROM h WHERE page_id % 5 = 0), x AS (SELECT DISTINCT host FROM h WHERE page_id % 10 = 0)
        SELECT page_id, url FROM h WHERE NOT ((contains(lower(url), '/en/') OR EXISTS (SELECT 1 FROM b WHERE h.host = b.host OR ends_with(h.host, '.' || b.host)))
        AND NOT EXISTS (SELECT 1 FROM x WHERE h.host = x.host OR ends_with(h.host, '.' || x.host)))"""
)
def image_antijoin(spark, sf_dir):
    """Page addresses stand in for images; host rules and exceptions come from some of their hosts, one substring rule is common."""
    pages = read_table(spark, sf_dir, "pages")
    own = F.try_parse_url(F.col("url"), F.lit("HOST"))
    lines = pages.filter("page_id % 5 = 0").select(F.concat(F.lit("||"), own, F.lit("^")).alias("raw")).union(pages.filter("page_id % 10 = 0").select(F.concat(F.lit("@@||"), own, F.lit("^$image"))))
    rules = relational.parse_rules(lines.union(spark.createDataFrame([("! a comment",), ("/en/$image",), ("never-there$script",), ("",)], "raw string")))
    return relational.allowed(pages, rules, url="url").select("page_id", "url")


#: Malformed markup around a name, and the tree that it makes.
_MALFORMED = {
    "<p>1<b>#<i>3</b>4</i>5</p>": "<p>1<b>#<i>3</i></b><i>4</i>5</p>",
    "<b>#<p>2</b>3</p>": "<b>#</b><p><b>2</b>3</p>",
    "<table><p>#": "<p>#</p><table></table>",
    "<a>x<div>#<a>z": "<a>x</a><div><a>#</a><a>z</a></div>",
    "<table><b><tr><td>#</td></tr>bbb</table>ccc": "<b></b><b>bbb</b><table><tbody><tr><td>#</td></tr></tbody></table><b>ccc</b>",
    "<ul><li>#<ul><li>b</ul><li>c</ul>": "<ul><li>#<ul><li>b</li></ul></li><li>c</li></ul>",
    "<div><b>#</div>y": "<div><b>#</b></div><b>y</b>",
    "<table>#<tr>y<td>z</table>w": "#y<table><tbody><tr><td>z</td></tr></tbody></table>w",
    "<select><b>a<option>#<option>c</select>d": "<select>a<option>#</option><option>c</option></select>d",
    "<table><caption>#<tr><td>b</table>": "<table><caption>#</caption><tbody><tr><td>b</td></tr></tbody></table>",
    "<dl><dt>#<dd>b<p>c<dt>d</dl>": "<dl><dt>#</dt><dd>b<p>c</p></dd><dt>d</dt></dl>",
    "<!DOCTYPE html><p>#<table><td>b</table>c": "<p>#</p><table><tbody><tr><td>b</td></tr></tbody></table>c",
    "<form><form><p>#</form>b</form>": "<form><p>#</p></form>b",
    "<font><p>#</font></p></p>b</br>": "<font></font><p><font>#</font></p><p></p>b<br>",
}


@query(f"SELECT p_partkey, replace(CASE p_partkey % {len(_MALFORMED)} {' '.join(f'WHEN {k} THEN {chr(39)}{x}{chr(39)}' for k, x in enumerate(_MALFORMED.values()))} END, '#', p_name) AS tree FROM part")
def malformed_trees(spark, sf_dir):
    """Crossed and unclosed formatting, content that a table may not hold, parts out of place: the trees that browsers make of them."""
    markup = F.element_at(F.array(*(F.lit(x) for x in _MALFORMED)), (F.col("p_partkey") % len(_MALFORMED) + 1).cast("int"))
    pages = read_table(spark, sf_dir, "part").select("p_partkey", F.replace(markup, F.lit("#"), F.col("p_name")).alias("html"))
    return extract.body_trees(pages, keep=("p_partkey",))


#: Links, and where they lead from a page at {origin}{folder}{name}?{query}, as SQL.
_LINKS = {
    "img/a b.png": "origin || folder || 'img/a%20b.png'",
    "/a/./b/../c": "origin || '/a/c'",
    "..": "origin || regexp_replace(folder, '[^/]+/$', '')",
    "../../../%2e%2E/up": "origin || '/up'",
    "?q=1": "origin || folder || name || '?q=1'",
    "#part": "regexp_replace(url, '#.*$', '') || '#part'",
    " \t": "regexp_replace(url, '#.*$', '')",
    "\\\\img.example\\x y": "scheme || '//img.example/x%20y'",
    "//CDN.example:80/x": "scheme || '//cdn.example' || CASE scheme WHEN 'http:' THEN '' ELSE ':80' END || '/x'",
    "HTTP://EXÄMPLE.org:80/%7Ea?b'c": "'http://xn--exmple-cua.org/%7Ea?b%27c'",
    "https://u:p@h.example:443": "'https://u:p@h.example/'",
    "x\ty\n.png": "origin || folder || 'xy.png'",
    "//0x7f.1/a": "scheme || '//127.0.0.1/a'",
    "ß|^": "origin || folder || '%C3%9F|%5E'",
    "": "NULL",
    "data:image/png;base64,xx": "NULL",
    "mailto:a@b.example": "NULL",
    "http://a b/": "NULL",
    "http://h:65536/": "NULL",
}


@query(
    rf"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?:)', 1) AS scheme, regexp_extract(url, '^(https?://[^/]*)', 1) AS origin,
            regexp_extract(url, '^https?://[^/]*(/[^?#]*/|/)', 1) AS folder, regexp_extract(url, '^https?://[^?#]*/([^/?#]*)', 1) AS name FROM pages)
        {" UNION ALL ".join(f"SELECT page_id, {k} AS link_no, CAST({x} AS VARCHAR) AS target FROM p" for k, x in enumerate(_LINKS.values()))}"""
)
def link_targets(spark, sf_dir):
    """Links of many forms, resolved at the address of every page."""
    links = F.array(*(F.lit(x) for x in _LINKS))
    rows = read_table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(links).alias("link_no", "link"))
    return rows.select("page_id", "link_no", address.joined(F.col("url"), F.col("link")).alias("target"))


_KIND = "CASE p.l_partkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'script' ELSE 'subdocument' END"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_KIND} AS type,
        (k % 8 = 0 AND path = 3) OR (NOT coalesce((k % 6 = 5 AND l_partkey % 3 = 0) OR (k % 4 = 0 AND path IN (3, 4) AND l_partkey % 3 <> 1), false)
          AND ((k % 6 = 0 AND k % 10 <> 0 AND l_suppkey % 4 <> 0) OR (k % 6 = 1 AND path = 0 AND l_partkey % 3 = 0) OR (k % 6 = 2 AND path = 1)
            OR (k % 6 = 3 AND path = 2 AND l_partkey % 3 = 1 AND l_suppkey % 4 = 1) OR (k % 6 = 4 AND path = 5))) AS blocked
        FROM (SELECT *, l_linenumber % 6 AS path, coalesce(o_orderkey, -1) AS k FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey = l_orderkey) p"""
)
def filter_verdicts(spark, sf_dir):
    """Rules of ten forms, two for every order or so, against a request for every line item: addresses, parties, types and domains differ."""
    put = lambda text: F.replace(F.lit(text), F.lit("#"), k)
    k, n = F.col("o_orderkey").cast("string"), F.col("o_orderkey")
    main = F.element_at(F.array(*(put(x) for x in ("||cdn#.example^$third-party", "/banner#/*.gif$image", "-ad#-", "||cdn#.example/track*pixel^$script,domain=a#.example|~b.a#.example", "|http://cdn#.example/x#|", "@@||cdn#.example^$image"))), (n % 6 + 1).cast("int"))
    others = [F.when(n % 4 == 0, put("@@||cdn#.example/ok^$~script")), F.when(n % 8 == 0, put("||cdn#.example/ok/forced$important")), F.when((n % 6 == 0) & (n % 10 == 0), put("||cdn#.example^$third-party,badfilter")), F.when(n % 5 == 0, put("! a comment on cdn#.example")), F.when(n % 7 == 0, put("cdn#.example##.banner"))]
    lines = read_table(spark, sf_dir, "orders").select(F.explode(F.array_compact(F.array(main, *others))).alias("raw"))
    items = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k = F.col("l_orderkey").cast("string")
    own = F.concat(F.lit("https://s"), F.col("l_partkey").cast("string"), F.lit(".cdn"), k, F.lit(".example"))
    url = F.element_at(F.array(*(F.concat(own, put(x)) for x in ("/banner#/x.gif", "/a-ad#-b", "/track/9/pixel?z", "/ok/forced/y", "/ok")), put("http://cdn#.example/x#")), (F.col("l_linenumber") % 6 + 1).cast("int"))
    source = F.element_at(F.array(put("https://www.cdn#.example/"), put("https://a#.example/"), put("https://b.a#.example/x"), F.lit("https://other.co.uk")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("image", "script", "subdocument"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    requests = items.select("*", url.alias("url"), source.alias("source_url"), kind.alias("type"))
    return filters.verdicts(requests, filters.parse_filters(lines)).select(*items.columns, "type", "blocked")


# ---- code


def _code_pages(spark, sf_dir) -> DataFrame:
    line = F.concat(F.when(F.col("p_size") % 5 == 0, F.lit('<span class="line hl">')).otherwise(F.lit("<span>")), F.col("p_name"), F.lit("</span>"))
    body = read_table(spark, sf_dir, "part").groupBy("p_brand").agg(_joined(line, F.col("p_partkey"), "\n").alias("code"))
    return body.select(F.xxhash64("p_brand").alias("page_id"), "p_brand", _page('<pre><code class="hljs language-py3">', F.col("code"), "\n# highlight-next-line\nlast line  \n</code></pre>").alias("html"))


@query(
    """SELECT p_brand, 'python' AS lang, count(*) + 1 AS n_lines, count(*) FILTER (p_size % 5 = 0) + 1 AS n_highlighted,
       sha256(string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10) || 'last line') AS sha FROM part GROUP BY p_brand"""
)
def code_blocks(spark, sf_dir):
    pages = _code_pages(spark, sf_dir)
    blocks = _blocks_of(pages, "page_id").filter("kind = 'code'").join(pages.select("page_id", "p_brand"), "page_id")
    return blocks.select("p_brand", "lang", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.size("highlights").cast("long").alias("n_highlighted"), F.sha2("text", 256).alias("sha"))


@query(
    """SELECT 'function' AS kind, count(*) AS n, CAST(sum(length('call')) AS BIGINT) AS n_chars FROM part UNION ALL SELECT 'keyword', count(*), CAST(sum(6) AS BIGINT) FROM part
       UNION ALL SELECT 'number', count(*), CAST(sum(length(CAST(p_size AS VARCHAR))) AS BIGINT) FROM part UNION ALL SELECT 'str', count(*), CAST(sum(length(p_brand) + 2) AS BIGINT) FROM part
       UNION ALL SELECT 'comment', count(*), CAST(sum(length(p_type) + 2) AS BIGINT) FROM part UNION ALL SELECT 'plain', 4 * count(*), CAST(sum(6) AS BIGINT) FROM part"""
)
def token_kind_counts(spark, sf_dir):
    line = F.concat(F.lit("return call("), F.col("p_size").cast("string"), F.lit(', "'), F.col("p_brand"), F.lit('") # '), F.col("p_type"))
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit(0).alias("pos"), line.alias("text"), F.lit("py").alias("lang"))
    return codetok.code_tokens(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("SELECT doc_id, length(text) AS n_chars, sha256(text) AS sha FROM documents")
def token_round_trip(spark, sf_dir):
    """Tokens of every document, put together again: one row of lines of tokens each, folded where it is."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    whole = F.array_join(F.transform("lines", lambda line: F.array_join(F.transform(line, lambda t: t["text"]), "")), "\n")
    return codetok.code_lines(docs, keep=("doc_id",)).select("doc_id", whole.alias("whole")).select("doc_id", F.length("whole").cast("long").alias("n_chars"), F.sha2("whole", 256).alias("sha"))


_MARKER_ROWS = ", ".join(f"({i}, '{m}')" for i, m in enumerate(K.BOILERPLATE_MARKERS))


@query(
    f"""WITH m(i, marker) AS (VALUES {_MARKER_ROWS}) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN contains(marker, '-') AND false WHEN 2 THEN contains(marker, '-') ELSE false END AS hit
        FROM part JOIN m ON i = p_size % {len(K.BOILERPLATE_MARKERS)}"""
)
def boilerplate_match(spark, sf_dir):
    marker = F.element_at(F.array(*map(F.lit, K.BOILERPLATE_MARKERS)), (F.col("p_size") % len(K.BOILERPLATE_MARKERS) + 1).cast("int"))
    k = F.col("p_partkey") % 4
    names = F.when(k == 0, F.concat(F.lit("box "), F.upper(marker))).when(k == 1, F.concat(F.lit("zz"), F.replace(marker, F.lit("-"), F.lit("")))).when(k == 2, F.concat(F.lit("tag-"), marker)).otherwise(F.lit("plain text"))
    return read_table(spark, sf_dir, "part").select("p_partkey", T.boilerplate(names).alias("hit"))


# ---- responses, protection, translation


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'retry' WHEN event_id % 7 IN (1, 2) THEN 'http_error' WHEN event_id % 3 = 0 THEN 'type_error' ELSE 'ok' END AS class FROM events"""
)
def http_accept(spark, sf_dir):
    status = F.element_at(F.array(F.lit(None).cast("int"), F.lit(404), F.lit(301), F.lit(200), F.lit(204), F.lit(299), F.lit(200)), (F.col("event_id") % 7 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("image/png"), F.lit("Text/HTML; charset=x"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))
    return read_table(spark, sf_dir, "events").select("event_id", T.accepts(status, kind).alias("class"))


@query(r"SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 1 THEN regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') ELSE text END) AS sha FROM documents")
def http_decode(spark, sf_dir):
    body = F.when(F.col("doc_id") % 2 == 1, F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.body_text(F.lit("text/html"), body), 256).alias("sha"))


@query(
    """SELECT conv_id, turn, 3 AS n_parts, length('⟦0⟧  ⟦1⟧ ⟦2⟧') + length(text) AS n_masked, sha256('`' || role || '` ' || text || ' https://x.example/' || conv_id || ' <b>') AS sha FROM conversations"""
)
def protect_restore(spark, sf_dir):
    text = F.concat(F.lit("`"), F.col("role"), F.lit("` "), F.col("text"), F.lit(" https://x.example/"), F.col("conv_id").cast("string"), F.lit(" <b>"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.protect(text).alias("p"))
    return rows.select("conv_id", "turn", F.size("p.parts").alias("n_parts"), F.length("p.masked").cast("long").alias("n_masked"), F.sha2(T.restore(F.col("p.masked"), F.col("p.parts")), 256).alias("sha"))


@query(f"WITH {_PAGE_SQL} SELECT page_id, pos, kind, lower(text) AS text FROM blocks")
def translate_roundtrip(spark, sf_dir):
    """Titles and blocks through a lower-casing translator, chunk by chunk, in place."""
    done = relational.translate_blocks(_articles(spark, sf_dir), F.lower)
    return extract.explode_blocks(done).select("page_id", "pos", "kind", "text")


@query(
    """SELECT CAST(n_regionkey AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row_no, lower(n_name) AS name, n_nationkey || ' key' AS code, 'nation|key' AS header,
       lower(r_name) AS title FROM nation JOIN region ON r_regionkey = n_regionkey"""
)
def translate_tables(spark, sf_dir):
    """Title and table cells as jobs, translated, and joined back by row and column."""
    pages = _nation_tables(spark, sf_dir).join(read_table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("page_id"), "r_name"), "page_id")
    titled = pages.select("page_id", F.lit("https://site.example/a/").alias("url"), F.replace("html", F.lit("<html>"), F.concat(F.lit("<html><head><title>"), "r_name", F.lit("</title></head>"))).alias("html"))
    articles = extract.extract_articles(titled, keep=("page_id",))
    blocks = extract.explode_blocks(articles)
    jobs = relational.translate_jobs(relational.translation_jobs(blocks).unionByName(relational.title_jobs(articles)), F.lower)
    titles = jobs.filter("kind = 'title'").select("page_id", F.col("translated").alias("title"))
    rows = relational.write_back(blocks, jobs).filter("kind = 'table'").select("page_id", F.posexplode("tbl.rows").alias("row_no", "r"), F.array_join("tbl.header", "|").alias("header"))
    return rows.join(titles, "page_id").select("page_id", "row_no", F.col("r")[0].alias("name"), F.replace(F.col("r")[1], F.lit("\n"), F.lit(" ")).alias("code"), "header", "title")


@query(
    """WITH a AS (SELECT event_id, unnest([1, 2, 3]) AS attempt FROM events), c AS (SELECT event_id, attempt, event_id % 5 = 0 OR (event_id + attempt) % 3 = 0 AS lost FROM a),
       f AS (SELECT event_id, min(attempt) FILTER (NOT lost) AS t FROM c GROUP BY event_id)
       SELECT event_id, CASE WHEN t IS NULL THEN 'network' WHEN event_id % 7 = 1 THEN 'http_error' ELSE 'ok' END AS class, CAST(coalesce(t, 3) AS INTEGER) AS attempts, CAST(250 * (coalesce(t, 3) - 1) * coalesce(t, 3) / 2 AS INTEGER) AS waited_ms FROM f"""
)
def fetch_attempts(spark, sf_dir):
    """Attempts of which some fail in the network; the first answer counts, whatever it says."""
    rows = read_table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    lost = (F.col("event_id") % 5 == 0) | ((F.col("event_id") + F.col("attempt")) % 3 == 0)
    status = F.when(~lost, F.when(F.col("event_id") % 7 == 1, 404).otherwise(200))
    return settled_attempts(rows.select("event_id", "attempt", status.alias("status"), F.lit("text/html").alias("content_type")), "event_id")


@query(
    """SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 5 <> 4 THEN 'old ' || n_name WHEN n_nationkey % 3 = 0 THEN 'new ' || n_name WHEN n_nationkey % 5 <> 4 THEN 'old ' || n_name END AS text,
       CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 5 <> 4 THEN 'cache' WHEN n_nationkey % 3 = 0 THEN 'network' WHEN n_nationkey % 5 <> 4 THEN 'stale' ELSE 'missing' END AS origin FROM nation WHERE n_nationkey % 5 <> 4 OR n_nationkey % 3 = 0 OR n_nationkey % 7 = 0"""
)
def list_refresh(spark, sf_dir):
    nation, key = read_table(spark, sf_dir, "nation"), F.col("n_nationkey")
    held = nation.filter(key % 5 != 4).select(F.col("n_name").alias("name"), F.concat(F.lit("old "), "n_name").alias("text"), (key % 2 == 0).alias("fresh"))
    got = nation.filter((key % 3 == 0) | (key % 7 == 0)).select(F.col("n_name").alias("name"), F.when(key % 3 == 0, F.concat(F.lit("new "), "n_name")).alias("text"))
    return refreshed_lists(held, got)


@query(
    f"""WITH {_PAGE_SQL} SELECT page_id, CASE WHEN contains(title, ' | ') AND length(trim(split_part(title, ' | ', 1))) >= 15 THEN trim(split_part(title, ' | ', 1)) ELSE title END AS title, {_HOST} AS author, {_NAME} AS output_name, 'en' AS lang, 'a maker' AS creator, 'a maker' AS producer,
        strftime(TIMESTAMP '1970-01-01' + to_seconds(page_id * 100003), 'D:%Y%m%d%H%M%SZ') AS created, strftime(TIMESTAMP '1970-01-01' + to_seconds(page_id * 100003), 'D:%Y%m%d%H%M%SZ') AS modified FROM raw"""
)
def metadata(spark, sf_dir):
    return document_metadata(_articles(spark, sf_dir), lang="en", creator="a maker", made_s=F.col("page_id") * 100003)


@query(f"WITH {_PAGE_SQL} SELECT page_id, pos, kind, text FROM blocks")
def sql_extract_blocks(spark, sf_dir):
    """The same blocks by the table function, from SQL."""
    sql_functions.register(spark)
    return spark.sql("SELECT page_id, b.pos, b.kind, b.text FROM {pages}, LATERAL extract_blocks(html, url) AS b", pages=read_table(spark, sf_dir, "pages"))


@query("SELECT p_partkey, CAST(0 AS INTEGER) AS tok_no, 'keyword' AS kind, 'return' AS text FROM part UNION ALL SELECT p_partkey, 1, 'plain', ' ' FROM part UNION ALL SELECT p_partkey, 2, 'number', CAST(p_size AS VARCHAR) FROM part")
def sql_highlight_code(spark, sf_dir):
    sql_functions.register(spark)
    return spark.sql("SELECT p_partkey, t.tok_no, t.kind, t.text FROM {part}, LATERAL highlight_code('return ' || p_size, 'python') AS t", part=read_table(spark, sf_dir, "part"))


# ---- outline, pagination, dimensions


@query(
    """WITH h AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, 1 + (l_linenumber * l_partkey) % 6 AS level, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
       p AS (SELECT a.k, a.idx, a.level, a.n, max(b.idx) FILTER (b.idx < a.idx AND b.level < a.level) AS parent, min(b.idx) FILTER (b.idx > a.idx AND b.level <= a.level) AS stop FROM h a JOIN h b USING (k) GROUP BY ALL)
       SELECT k, CAST(idx AS INTEGER) AS idx, CAST(level AS INTEGER) AS level, CAST(coalesce(parent, -1) AS INTEGER) AS parent_idx, CAST(coalesce(lag(idx) OVER s, -1) AS INTEGER) AS prev_idx, CAST(coalesce(lead(idx) OVER s, -1) AS INTEGER) AS next_idx,
              CAST(coalesce(stop, n) - idx - 1 AS INTEGER) AS n_descendants FROM p WINDOW s AS (PARTITION BY k, parent ORDER BY idx)"""
)
def outline_tree(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1).alias("idx"), (1 + (F.col("l_linenumber") * F.col("l_partkey")) % 6).cast("int").alias("level")
    )
    return relational.outline(rows, "k").select("k", "idx", "level", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("parent_idx", "prev_idx", "next_idx")), "n_descendants")


_PAGES_SQL = """u AS (SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS unit, 1 + p_size % 3 AS n, p_size % 5 = 0 AS hl FROM part),
    v AS (SELECT *, CAST(sum(n) OVER (PARTITION BY p_brand ORDER BY unit) AS BIGINT) - n AS first FROM u),
    b AS (SELECT p_brand, list(first ORDER BY first) AS starts, CAST(sum(n) AS BIGINT) AS total FROM v GROUP BY p_brand),
    m AS (SELECT *, total * 4.2 + 4 > 120.5 AND total * 4.2 + 4 <= 270 AS moves FROM b),
    r(p_brand, starts, total, page_no, begins, stop) AS (
        SELECT p_brand, starts, total, CAST(moves AS INTEGER), CAST(0 AS BIGINT), page_stop(starts, total, 0, CASE WHEN moves THEN 63 ELSE 27 END) FROM m
        UNION ALL SELECT p_brand, starts, total, page_no + 1, stop, page_stop(starts, total, stop, 63) FROM r WHERE stop < total),
    l AS (SELECT p_brand, page_no, begins, unnest(range(begins, stop)) AS k FROM r),
    placed AS (SELECT l.p_brand, v.unit, v.hl, CAST(k + 1 AS INTEGER) AS vline_no, page_no, k - begins AS on_page FROM l JOIN v ON v.p_brand = l.p_brand AND k >= first AND k < first + n)"""


def _with_stop(sql: str) -> str:
    """The rule of page ends, written into a query (limit, last start within it, last start before the end)."""
    def stop(m: re.Match) -> str:
        starts, total, at, room = (x.strip() for x in m[1].split(", ", 3))
        last = f"list_filter({starts}, lambda x: x <= ({at}) + {room})[-1]"
        end = f"(CASE WHEN ({at}) + {room} >= {total} THEN {total} WHEN {last} > ({at}) THEN {last} ELSE ({at}) + {room} END)"
        back = f"list_filter({starts}, lambda x: x < {end})[-1]"
        return f"CAST(CASE WHEN {total} - {end} = 1 AND {end} - ({at}) > 1 AND {back} > ({at}) THEN {back} ELSE {end} END AS BIGINT)"

    return re.sub(r"page_stop\((starts, total, (?:0, CASE WHEN moves THEN 63 ELSE 27 END|stop, 63))\)", stop, sql)


def _placed_code(spark, sf_dir) -> DataFrame:
    part = read_table(spark, sf_dir, "part").withColumn("unit", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("int"))
    lines = part.select("p_brand", "unit", (F.col("p_size") % 5 == 0).alias("highlighted"), F.explode(F.sequence(F.lit(0), F.col("p_size") % 3)).alias("part"))
    lines = lines.select("p_brand", "unit", "highlighted", F.row_number().over(Window.partitionBy("p_brand").orderBy("unit", "part")).alias("vline_no"))
    return relational.paginate(lines, "p_brand", first_mm=120.0, page_mm=271.0, line_mm=4.2)


@query(_with_stop(f"WITH RECURSIVE {_PAGES_SQL} SELECT p_brand, unit, vline_no, page_no FROM placed"))
def code_pagination(spark, sf_dir):
    """Pages of code lines, brand by brand."""
    return _placed_code(spark, sf_dir).select("p_brand", "unit", "vline_no", "page_no")


@query(
    _with_stop(
        f"""WITH RECURSIVE {_PAGES_SQL}, x AS (SELECT p_brand, page_no, count(*) AS n_lines, CAST(min(vline_no) AS INTEGER) AS first_line FROM placed GROUP BY ALL)
        SELECT *, page_no > min(page_no) OVER (PARTITION BY p_brand) AS continued, (max(page_no) OVER (PARTITION BY p_brand) - min(page_no) OVER (PARTITION BY p_brand)) AS code_splits FROM x"""
    )
)
def code_box_pages(spark, sf_dir):
    """Boxes behind code blocks, page by page, and how often each block is broken."""
    boxes = relational.code_boxes(_placed_code(spark, sf_dir), "p_brand", line_mm=4.2)
    return boxes.join(relational.code_splits(boxes, "p_brand"), "p_brand").select("p_brand", "page_no", "n_lines", "first_line", "continued", F.col("code_splits").cast("int").alias("code_splits"))


@query(
    _with_stop(
        f"""WITH RECURSIVE {_PAGES_SQL} SELECT p_brand, page_no, vline_no, round(CASE WHEN page_no = 0 THEN 151 ELSE 0 END + 2 + on_page * 4.2::DOUBLE, 3) AS top_mm, 4.2::DOUBLE AS height_mm FROM placed WHERE hl"""
    )
)
def highlight_band_pages(spark, sf_dir):
    """Bands behind highlighted lines, one for each visual line."""
    bands = relational.highlight_bands(_placed_code(spark, sf_dir), "p_brand", line_mm=4.2)
    return bands.select("p_brand", "page_no", "vline_no", F.round("top_mm", 3).alias("top_mm"), F.round(F.col("bottom_mm") - F.col("top_mm"), 3).alias("height_mm"))


@query(
    """WITH p(page, w, h) AS (VALUES ('a4', 210.0, 297.0), ('a5', 148.0, 210.0), ('letter', 216.0, 279.0), ('tablet', 162.0, 216.0)),
       m AS (SELECT page, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, CAST(floor(10 * h / 297 + 0.5) AS INTEGER) AS t, CAST(floor(18 * w / 210 + 0.5) AS INTEGER) AS r, CAST(floor(16 * h / 297 + 0.5) AS INTEGER) AS b FROM p)
       SELECT page, w AS width_mm, h AS height_mm, t AS top, r AS right, b AS bottom, r AS left, w - r - r AS content_width_mm, h - t - b AS content_height_mm, (h - t - b) * CAST(0.74 AS DOUBLE) AS max_image_height_mm FROM m"""
)
def page_geometry(spark, sf_dir):
    return dimensions.page_geometry(spark)


@query(
    f"""WITH {_PAGE_SQL} SELECT page_id, pos, CASE WHEN kind = 'heading' THEN CASE level WHEN 1 THEN 17.0::DOUBLE WHEN 2 THEN 15.0 WHEN 3 THEN 13.0 ELSE 12.0 END END AS font_pt, kind = 'heading' AS bold, false AS mono, kind = 'heading' AS bookmark FROM blocks"""
)
def block_style(spark, sf_dir):
    return relational.block_styles(extract.explode_blocks(_articles(spark, sf_dir))).select("page_id", "pos", "font_pt", "bold", "mono", "bookmark")


@query(
    """WITH l AS (SELECT p_partkey, u.i AS unit, u.l AS line FROM (SELECT p_partkey, unnest(list_transform(string_split(p_name || chr(10) || repeat(p_type || ' ', 1 + p_size % 9), chr(10)), lambda x, i: {'l': x, 'i': i - 1})) AS u FROM part)),
       p AS (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((length(line) - 35) / 33.0) AS BIGINT)))) AS part FROM l)
       SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY unit, part) - 1 AS INTEGER) AS vline_no, CASE WHEN part = 0 THEN ' ' || (unit + 1) || ' │ ' ELSE '   │ » ' END AS marker,
       CASE WHEN part = 0 THEN substr(line, 1, 35) ELSE substr(line, 36 + (part - 1) * 33, 33) END AS copy_text, unit = 1 AS highlighted FROM p"""
)
def code_visual_lines(spark, sf_dir):
    """Code wrapped at forty columns with its gutter; what is copied leaves the gutter out."""
    text = F.concat("p_name", F.lit("\n"), F.expr("repeat(p_type || ' ', 1 + p_size % 9)"))
    blocks = read_table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), F.array(F.lit(1)).alias("highlights"))
    lines = relational.copy_texts(relational.visual_lines(blocks, ("p_partkey",), columns=40))
    return lines.select("p_partkey", "vline_no", "marker", "copy_text", "highlighted")


@query(
    """SELECT p_partkey, CAST(0 AS INTEGER) AS tok_no, 'keyword' AS kind, 'return' AS text, 'CF222E' AS colour, false AS italic FROM part UNION ALL SELECT p_partkey, 1, 'plain', ' ', '24292F', false FROM part
       UNION ALL SELECT p_partkey, 2, 'number', CAST(p_size AS VARCHAR), '0550AE', false FROM part UNION ALL SELECT p_partkey, 3, 'plain', ' ', '24292F', false FROM part UNION ALL SELECT p_partkey, 4, 'comment', '# ' || p_brand, '6E7781', true FROM part"""
)
def token_colours(spark, sf_dir):
    line = F.concat(F.lit("return "), F.col("p_size").cast("string"), F.lit(" # "), F.col("p_brand"))
    tokens = codetok.code_tokens(read_table(spark, sf_dir, "part").select("p_partkey", line.alias("text"), F.lit("py").alias("lang")), keep=("p_partkey",))
    palette = dimensions.code_palettes(spark).filter("theme = 'github-light'").select("role", "colour")
    return codetok.token_styles(tokens, palette).select("p_partkey", "tok_no", "kind", "text", "colour", "italic")


@query(
    """WITH t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, CASE WHEN l_quantity > 25 THEN 'a' ELSE 'b' END AS kind FROM lineitem),
         g AS (SELECT *, n - row_number() OVER (PARTITION BY k, kind ORDER BY n) AS g FROM t)
    SELECT k, CAST(min(n) AS INTEGER) AS tok_no, kind, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY n) || ' ' AS text FROM g GROUP BY k, kind, g"""
)
def merged_kind_runs(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("tok_no"), F.when(F.col("l_quantity") > 25, "a").otherwise("b").alias("kind"))
    return relational.kind_runs(rows.withColumn("text", F.concat(F.col("tok_no").cast("string"), F.lit(" "))), ("k",)).select("k", "tok_no", "kind", "text")


@query(
    """WITH h AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, 1 + (l_linenumber * l_partkey) % 6 AS level FROM lineitem),
       p AS (SELECT *, min(level) OVER (PARTITION BY k ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM h)
       SELECT k, count(*) FILTER (least IS NULL OR least >= level) AS n_roots, count(*) AS n_entries FROM p GROUP BY k"""
)
def outline_counts(spark, sf_dir):
    return relational.outline_roots(outline_tree(spark, sf_dir).withColumn("parent_idx", F.nullif("parent_idx", F.lit(-1))), "k")


@query(f"WITH {_PAGE_SQL} SELECT page_id, true AS sans, false AS mono, bool_or(len(list_filter(string_split(text, ''), lambda ch: ch <> '' AND {_MISSING})) > 0) AS fallback FROM blocks GROUP BY page_id")
def font_choice(spark, sf_dir):
    blocks = extract.explode_blocks(_articles(spark, sf_dir))
    chars = relational.charset(blocks, "page_id").distinct()
    return relational.font_families(chars, _ascii(spark), blocks)


@query(f"SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' AND unicode(ch) <> 32 AND {_MISSING} UNION SELECT 'x'")
def missing_of_both(spark, sf_dir):
    """Characters that the text font or the code font (which here lacks an x) does not have."""
    chars = relational.charset(read_table(spark, sf_dir, "documents"), "doc_id").select("ch").distinct()
    return relational.missing_union(chars, _ascii(spark), _ascii(spark).filter("ch <> 'x'"))


@query("SELECT ch FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' UNION SELECT DISTINCT unnest(string_split('Sayfa 0123456789 · kod devamı │ » • [görsel ağ: ] / . -', ''))")
def drawn_charset(spark, sf_dir):
    """Characters of the documents and of the page furniture."""
    return relational.charset(read_table(spark, sf_dir, "documents"), "doc_id").select("ch").union(relational.interface_charset(spark)).distinct()


_PALETTE_ROWS = ", ".join(f"('{t}', '{r}', '{c}')" for t, v in K.PALETTES.items() for r, c in zip(K.PALETTE_ROLES, v.split()))


@query(f"SELECT theme, role, colour, CAST('0x' || substr(colour, 1, 2) AS INTEGER) / 255.0::DOUBLE AS red, CAST('0x' || substr(colour, 5, 2) AS INTEGER) / 255.0::DOUBLE AS blue FROM (VALUES {_PALETTE_ROWS}) v(theme, role, colour)")
def palette(spark, sf_dir):
    return dimensions.code_palettes(spark).withColumn("red", T.rgb01(F.col("colour"), 0)).withColumn("blue", T.rgb01(F.col("colour"), 2))


@query("SELECT o_orderkey, strftime(o_orderdate, 'D:%Y%m%d%H%M%SZ') AS pdf_date FROM orders")
def pdf_dates(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", T.pdf_date(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("pdf_date"))


@query(
    """SELECT n_nationkey, 'FEFF' || regexp_replace(hex(encode(n_name)), '(..)', '00\\1', 'g') AS title_object, 'Sayfa ' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ' · kod devamı' ELSE '' END AS header,
       CASE WHEN n_nationkey % 3 = 0 THEN '[görsel: ' || n_name || ']' ELSE '[görsel ağ: h.example/' || n_nationkey || '.png]' END AS note,
       greatest(0.0, least(297.0, 297.0 - n_nationkey * 20.5)) * 72 / 25.4 AS top_pt FROM nation"""
)
def page_labels(spark, sf_dir):
    key = F.col("n_nationkey")
    url = F.concat(F.lit("https://h.example/a/"), key.cast("string"), F.lit(".png?w=1"))
    return read_table(spark, sf_dir, "nation").select(
        "n_nationkey",
        T.text_object(F.col("n_name")).alias("title_object"),
        T.header_text(key, key % 2 == 0).alias("header"),
        T.image_note(F.when(key % 3 == 0, F.col("n_name")), F.lit("ağ"), url).alias("note"),
        T.destination_pt(F.lit(297.0), key * 20.5).alias("top_pt"),
    )
