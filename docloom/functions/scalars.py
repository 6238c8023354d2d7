"""Units, colours, dimension strings, escapes, ids and checksums, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points in each unit (the millimetre as points are defined from it in the formats).
MM_PER_PT = 0.352778
PER_PT = {"hwpunit": 100.0, "emu": 12700.0, "halfpt": 2.0, "twip": 20.0}


def to_pt(value: Column, unit: str, dpi: float = 96.0) -> Column:
    """A length in points from hwpunit, emu, halfpt, twip, mm or px."""
    if unit == "mm":
        return value / MM_PER_PT
    if unit == "px":
        return value * 72.0 / dpi
    return value / PER_PT[unit]


def from_pt(value: Column, unit: str, dpi: float = 96.0) -> Column:
    """The inverse; units that are whole numbers round half to even."""
    if unit == "mm":
        return value * MM_PER_PT
    if unit == "px":
        return value * dpi / 72.0
    return F.bround(value * PER_PT[unit], 0).cast("long")


def parse_hex_color(color: Column) -> Column:
    """Struct r, g, b, a of #rrggbb or #rrggbbaa; null for anything else."""
    digits = F.lower(F.ltrim(color, F.lit("#")))

    def part(i: int) -> Column:
        return F.conv(F.substring(digits, i, 2), 16, 10).cast("int")

    alpha = F.when(F.length(digits) == 8, part(7) / 255.0).otherwise(1.0)
    return F.when(digits.rlike("^([0-9a-f]{6}|[0-9a-f]{8})$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), alpha.alias("a")))


def to_hex_color(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    """Lower-case #rrggbb, with alpha only where it is not 1."""

    def two(x: Column) -> Column:
        return F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")

    base = F.concat(F.lit("#"), two(r), two(g), two(b))
    return base if a is None else F.when(a == 1.0, base).otherwise(F.concat(base, two(F.bround(a * 255, 0))))


def color_from_int(value: Column) -> Column:
    """#rrggbb of a number whose bytes are red, green, blue."""
    return to_hex_color(F.shiftright(value, 16).bitwiseAND(F.lit(255)), F.shiftright(value, 8).bitwiseAND(F.lit(255)), value.bitwiseAND(F.lit(255)))


def ratios_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 0.01


def parse_dimension(text: Column) -> Column:
    """Points of a string like 12pt, 3.5mm, 2cm or 7 (points); null for anything else."""
    number = F.regexp_extract(F.trim(text), r"^(-?\d+(?:\.\d+)?)\s*(pt|mm|cm|px)?$", 1)
    unit = F.lower(F.regexp_extract(F.trim(text), r"^(-?\d+(?:\.\d+)?)\s*(pt|mm|cm|px)?$", 2))
    value = F.when(number != "", number.cast("double"))
    return F.when(unit == "mm", value / MM_PER_PT).when(unit == "cm", value * 10 / MM_PER_PT).when(unit == "px", value * 0.75).otherwise(value)


def parse_percent(text: Column) -> Column:
    number = F.regexp_extract(F.trim(text), r"^(-?\d+(?:\.\d+)?)\s*%$", 1)
    return F.when(number != "", number.cast("double"))


def format_pt(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.1fpt", F.bround(value, 1)))


def format_mm(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.1fmm", F.bround(value * MM_PER_PT, 1)))


def format_percent(value: Column) -> Column:
    """An integral percentage without a fraction."""
    whole = F.floor(value) == value
    return F.when(value.isNull(), None).when(whole, F.concat(value.cast("long").cast("string"), F.lit("%"))).otherwise(F.concat(value.cast("string"), F.lit("%")))


def line_spacing(value: Column, kind: Column) -> Column:
    """Struct kind (ratio or points) and value of a line spacing string, by its type."""
    percent, length = parse_percent(value), parse_dimension(value)
    return (
        F.when(percent.isNotNull(), F.struct(F.lit("ratio").alias("kind"), percent.alias("value")))
        .when(F.coalesce(kind, F.lit("percent")).isin("fixed", "minimum", "between") & length.isNotNull(), F.struct(F.lit("points").alias("kind"), length.alias("value")))
        .when(length.isNotNull(), F.struct(F.lit("points").alias("kind"), length.alias("value")))
    )


def layout_mode(like_char: Column, flow: Column, halign: Column, x: Column, y: Column) -> Column:
    """How a positioned object takes part in the flow."""
    floats = flow.isin("float", "tight", "through")
    return (
        F.when(F.coalesce(like_char, F.lit(False)), "inline")
        .when(flow == "back", "background")
        .when(flow == "front", "foreground")
        .when(flow == "block", "block")
        .when(floats & halign.isin("right", "outside"), "float_right")
        .when(floats, "float_left")
        .when(x.isNotNull() | y.isNotNull(), "anchored")
        .otherwise("block")
    )


def paper_relative(value: Column, relative_to: Column, margin: Column) -> Column:
    """An offset from the paper's edge as one from the margin."""
    return F.when(relative_to == "paper", value - margin).otherwise(value)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_~|\[\]])", r"\\$1")


def escape_line_start(text: Column) -> Column:
    """Breaks what would open a block at the start of a line."""
    numbered = F.regexp_replace(text, r"^(\d+)([.)])(\s)", r"$1\\$2$3")
    marked = F.regexp_replace(numbered, r"^(#{1,6})(\s|$)", r"\\$1$2")
    return F.regexp_replace(F.regexp_replace(marked, r"^([-+])(\s)", r"\\$1$2"), r"^(>|!\[)", r"\\$1")


def unescape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+\-.!|~<>])", "$1")


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def block_id(number: Column) -> Column:
    return F.format_string("b_%04d", number.cast("int"))


def verbatim_id(number: Column) -> Column:
    return F.format_string("v_%04d", number.cast("int"))


def is_block_id(value: Column) -> Column:
    return value.rlike(r"^b_\d{4,}$")


def is_verbatim_id(value: Column) -> Column:
    return value.rlike(r"^v_\d{4,}$")


def block_number(value: Column) -> Column:
    """The number in a block id, 0 if it is none."""
    return F.coalesce(F.when(is_block_id(value), F.regexp_extract(value, r"(\d+)$", 1).cast("long")), F.lit(0))


def checksum(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


#: Everything here by its SQL name; see :func:`register`.
EXPORTED = {
    "doc_escape_markdown": "regexp_replace(t, '([\\\\\\\\`*_~|\\\\[\\\\]])', '\\\\\\\\$1')",
    "doc_escape_html": "replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')",
    "doc_unescape_html": "replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>')",
    "doc_checksum": "concat('sha256:', sha2(t, 256))",
}


def register(spark) -> list[str]:
    """Makes the text functions available to SQL as session functions that Catalyst inlines."""
    for name, body in EXPORTED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {body}")
    return sorted(EXPORTED)
