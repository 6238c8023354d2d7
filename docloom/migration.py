"""Documents of the older schema, whose dimensions are strings, and back again.

The older table has the columns of nodes, but ``width``, ``height`` and ``line_spacing`` as strings
like ``"210mm"``, ``"12.0pt"`` or ``"160%"`` and a ``line_spacing_type``. The newer one has points,
and of line spacings the kind and the value. Inlines, nested fields in ``attrs`` and the metadata of
documents follow the same rules. What only one format knows goes to a column ``extensions`` and
back. All of it is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalars

LENGTHS = ("width", "height", "margin_left", "margin_right", "margin_top", "margin_bottom", "indent", "font_size")
#: Types that the older schema lacks.
NEW_TYPES = ("chart", "text_art")
# Names of lengths and percentages in ``attrs`` (with or without "format." before them) and in the metadata.
ATTR_LENGTHS = ("width", "height", "original_width", "original_height", "font_size", "space_before", "space_after", "indent_left", "indent_right", "indent_first", "drop_cap_distance")
ATTR_COLORS = ("color", "background_color", "underline_color", "strikeout_color", "highlight_color")
METADATA_LENGTHS = ("page_width", "page_height", "header_margin", "footer_margin", "gutter", "margin_top", "margin_bottom", "margin_left", "margin_right")
OLD_METADATA = {"paper_width": "page_width", "paper_height": "page_height"}
FORMATS = ("hwp", "hwpx", "docx", "pdf")


def _hex(color: Column) -> Column:
    """Lower-case hex; null for names and anything else."""
    return F.when(color.rlike("^#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.lower(color))


def inlines_to_v2(inlines: Column) -> Column:
    """Inlines whose ``size`` is a string like "10pt": points, and colours as hex; texts, flags and references stay."""
    return F.transform(inlines, lambda i: i.withField("size", scalars.parse_dimension(i["size"].cast("string"))).withField("color", _hex(i["color"])))


def inlines_to_v1(inlines: Column) -> Column:
    """The inverse, to a tenth of a point."""
    return F.transform(inlines, lambda i: i.withField("size", scalars.format_pt(i["size"].cast("double"))))


def _bare(key: Column) -> Column:
    return F.regexp_replace(key, r"^format\.", "")


def attrs_to_v2(attrs: Column) -> Column:
    """Lengths as numbers of points, colours as hex; values that are neither are left out. Other fields stay."""
    value = lambda k, v: F.when(_bare(k).isin(*ATTR_LENGTHS), scalars.parse_dimension(v).cast("string")).when(_bare(k).isin(*ATTR_COLORS), _hex(v)).otherwise(v)
    return F.map_filter(F.transform_values(attrs, value), lambda k, v: v.isNotNull() | ~_bare(k).isin(*ATTR_LENGTHS, *ATTR_COLORS))


def attrs_to_v1(attrs: Column) -> Column:
    """The inverse, to a tenth of a point."""
    return F.transform_values(attrs, lambda k, v: F.when(_bare(k).isin(*ATTR_LENGTHS), scalars.format_pt(v.try_cast("double"))).otherwise(v))


def metadata_to_v2(metadata: DataFrame) -> DataFrame:
    """Rows of doc_id, name and value: lengths as points, the paper's size under its newer name; lengths that are none are null."""
    name = F.col("name")
    for old, new in OLD_METADATA.items():
        name = F.when(F.col("name") == old, new).otherwise(name)
    renamed = metadata.withColumn("name", name)
    return renamed.withColumn("value", F.when(F.col("name").isin(*METADATA_LENGTHS), scalars.parse_dimension(F.col("value")).cast("string")).otherwise(F.col("value")))


def metadata_to_v1(metadata: DataFrame) -> DataFrame:
    """The inverse: lengths as millimetres, to a tenth."""
    length = F.col("name").isin(*METADATA_LENGTHS)
    back = metadata.withColumn("value", F.when(length, scalars.format_mm(F.col("value").try_cast("double"))).otherwise(F.col("value")))
    name = F.col("name")
    for old, new in OLD_METADATA.items():
        name = F.when(F.col("name") == new, old).otherwise(name)
    return back.withColumn("name", name)


def create_extension(format_name: str, **fields: object) -> dict[str, str]:
    """Entries of ``extensions`` for one format, ``"hwp.field"`` to text; other formats are an error."""
    if format_name not in FORMATS:
        raise ValueError(f"no extension for {format_name}")
    return {f"{format_name}.{name}": str(value) for name, value in fields.items() if value is not None}


def collect_extensions(nodes: DataFrame, format_name: str, fields: list[str]) -> DataFrame:
    """Moves ``fields`` of ``attrs`` to a map ``extensions`` under the format's name; a map that is there is kept, moved fields win."""
    create_extension(format_name)
    moved = F.map_filter("attrs", lambda k, v: k.isin(*fields))
    named = F.transform_keys(moved, lambda k, v: F.concat(F.lit(f"{format_name}."), k))
    empty = F.create_map().cast("map<string,string>")
    held = F.map_filter("extensions", lambda k, v: ~F.map_contains_key(F.coalesce(named, empty), k)) if "extensions" in nodes.columns else empty
    extensions = F.map_concat(F.coalesce(held, empty), F.coalesce(named, empty))
    return nodes.withColumns({"extensions": extensions, "attrs": F.map_filter("attrs", lambda k, v: ~k.isin(*fields))})


def look_up_extensions(nodes: DataFrame, format_name: str) -> DataFrame:
    """The inverse: entries of the format go back to ``attrs``, others stay in ``extensions``."""
    create_extension(format_name)
    empty, start = F.create_map().cast("map<string,string>"), f"{format_name}."
    own = F.map_filter(F.coalesce("extensions", empty), lambda k, v: k.startswith(start))
    back = F.transform_keys(own, lambda k, v: F.substring(k, len(start) + 1, 1000))
    kept = F.map_filter(F.coalesce("attrs", empty), lambda k, v: ~F.map_contains_key(back, k))
    return nodes.withColumns({"attrs": F.map_concat(kept, back), "extensions": F.map_filter("extensions", lambda k, v: ~k.startswith(start))})


def v1_to_v2(nodes: DataFrame) -> DataFrame:
    """Lengths to points, spacings to struct(kind, value), colours to lower-case hex, in inlines and attrs too; strings that are no lengths become null."""
    out = {c: scalars.parse_dimension(F.col(c)) for c in LENGTHS if c in nodes.columns}
    if "line_spacing" in nodes.columns:
        kind = F.col("line_spacing_type") if "line_spacing_type" in nodes.columns else F.lit(None).cast("string")
        out["line_spacing"] = scalars.line_spacing(F.col("line_spacing"), kind)
    if "color" in nodes.columns:
        out["color"] = _hex(F.col("color"))
    if "inlines" in nodes.columns:
        out["inlines"] = inlines_to_v2(F.col("inlines"))
    if "attrs" in nodes.columns:
        out["attrs"] = attrs_to_v2(F.col("attrs"))
    return nodes.withColumns(out) if out else nodes


def v2_to_v1(nodes: DataFrame) -> DataFrame:
    """The inverse, to a tenth of a point; blocks of newer types become unknown ones that say what they were."""
    out = {c: scalars.format_pt(F.col(c)) for c in LENGTHS if c in nodes.columns}
    if "line_spacing" in nodes.columns:
        spacing = F.col("line_spacing")
        out["line_spacing"] = F.when(spacing["kind"] == "ratio", scalars.format_percent(spacing["value"])).otherwise(scalars.format_pt(spacing["value"]))
        out["line_spacing_type"] = F.when(spacing["kind"] == "ratio", "percent").when(spacing.isNotNull(), "fixed")
    if "inlines" in nodes.columns:
        out["inlines"] = inlines_to_v1(F.col("inlines"))
    if "attrs" in nodes.columns:
        out["attrs"] = attrs_to_v1(F.col("attrs"))
    if "type" in nodes.columns:
        new = F.col("type").isin(*NEW_TYPES)
        if "attrs" in nodes.columns:
            kept = F.map_filter(F.coalesce(out["attrs"], F.create_map().cast("map<string,string>")), lambda k, v: k != "was")
            noted = F.map_concat(kept, F.create_map(F.lit("was"), F.col("type")))
            out["attrs"] = F.when(new, noted).otherwise(out["attrs"])
        out["type"] = F.when(new, "unknown").otherwise(F.col("type"))
    return nodes.withColumns(out) if out else nodes
