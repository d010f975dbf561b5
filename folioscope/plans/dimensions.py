"""Small fixed relations: page geometry, themes and code palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.functions import constants as K


def _round(x: float) -> int:
    return int(x + 0.5)


def page_geometry(spark: SparkSession) -> DataFrame:
    rows = []
    for name, (w, h) in K.PAGE_SIZES.items():
        top, right, bottom, left = (_round(m * f) for m, f in zip(K.BASE_MARGINS, (h / 297, w / 210, h / 297, w / 210)))
        rows.append((name, w, h, top, right, bottom, left, w - left - right, h - top - bottom, (h - top - bottom) * K.IMAGE_HEIGHT_SHARE))
    return spark.createDataFrame(rows, "page string, width_mm double, height_mm double, top int, right int, bottom int, left int, content_width_mm double, content_height_mm double, max_image_height_mm double")


def code_palettes(spark: SparkSession) -> DataFrame:
    rows = [(name, role, colour) for name, text in K.PALETTES.items() for role, colour in zip(K.PALETTE_ROLES, text.split())]
    return spark.createDataFrame(rows, "theme string, role string, colour string")


def themes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v, K.AUTO_CODE_THEME[k]) for k, v in K.THEMES.items()], "theme string, text string, muted string, background string, code_theme string")


def parse_option(kind: str, value: str) -> str | int:
    """A validated option: page, theme, code_theme or font_size."""
    low = value.strip().lower()
    if kind == "font_size":
        if not low.isdigit() or not 8 <= int(low) <= 16:
            raise ValueError(f"font size must be 8 to 16: {value}")
        return int(low)
    known = {"page": [*K.PAGE_SIZES], "theme": [*K.THEMES], "code_theme": ["auto", *(k for k in K.PALETTES if k != "dark-on-page")]}[kind]
    low = K.CODE_THEME_ALIASES.get(low, low) if kind == "code_theme" else low
    if low not in known:
        raise ValueError(f"{kind} must be one of {', '.join(known)}: {value}")
    return low
