"""Functions for SQL: table functions that take a page or code apart, and scalars of the same names as the columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscope.operators import codetok, extract


class ExtractBlocks:
    """Blocks of a page, one row each, in page order."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for pos, b in enumerate(extract.extract_article(html, url)["blocks"]):
            yield pos, b["kind"], b.get("level"), b.get("text"), b.get("lang"), b.get("img_url"), b.get("alt")


class HighlightCode:
    """Tokens of a piece of code, one row each, line by line."""

    def eval(self, code: str, lang: str) -> Iterator[tuple]:
        for line_no, line in enumerate(codetok.tokenize(code or "", lang)):
            for tok_no, (text, kind) in enumerate(line):
                yield line_no, tok_no, text, kind


def _clean_titles(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: None if t is None else extract.clean_title(t))


def register(spark: SparkSession) -> None:
    """extract_blocks(html, url) and highlight_code(code, lang) for LATERAL, and clean_title(text)."""
    spark.udtf.register("extract_blocks", F.udtf(ExtractBlocks, returnType="pos int, kind string, level int, text string, lang string, img_url string, alt string"))
    spark.udtf.register("highlight_code", F.udtf(HighlightCode, returnType="line_no int, tok_no int, text string, kind string"))
    spark.udf.register("clean_title", F.pandas_udf(_clean_titles, "string"))
