"""Rules for Markdown, HTML and DOCX: rows of doc_id, rule_id, message and severity."""

from __future__ import annotations

from html.parser import HTMLParser

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements that must not be closed.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
SCHEMA = "doc_id long, rule_id string, message string, severity string"


def _violations(docs: DataFrame, rule: str, when: Column, message: Column | str, severity: str = "warning") -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return docs.where(when).select("doc_id", F.lit(rule).alias("rule_id"), text.alias("message"), F.lit(severity).alias("severity"))


def without_fences(md: Column) -> Column:
    """Markdown without its fenced code."""
    return F.regexp_replace(md, r"(?ms)^(```|~~~).*?^\1[ \t]*$", "")


def check_m1(docs: DataFrame, md: str = "md") -> DataFrame:
    """Lines that open a raw HTML block."""
    start = r"(?mi)^ {0,3}<(script|pre|style|textarea|!--|\?|![a-z]|/?(address|article|aside|blockquote|body|center|details|dialog|div|dl|fieldset|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav|ol|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(\s|/?>|$))"
    count = F.regexp_count(without_fences(F.col(md)), F.lit(start))
    return _violations(docs, "M1", count > 0, F.concat(count.cast("string"), F.lit(" raw HTML blocks")))


def check_m2(docs: DataFrame, md: str = "md") -> DataFrame:
    """Nothing but white space."""
    return _violations(docs, "M2", F.col(md).isNull() | ~F.col(md).rlike(r"\S"), "empty output", "error")


def check_m3(docs: DataFrame, md: str = "md") -> DataFrame:
    """Hash marks that no space parts from a title: a capital letter, a Hangul syllable or a letter of Hangul."""
    count = F.regexp_count(without_fences(F.col(md)), F.lit(r"(?m)^#{1,6}[A-Z가-힣ㄱ-ㆎ]"))
    return _violations(docs, "M3", count > 0, F.concat(count.cast("string"), F.lit(" headings without a space")))


def validate_markdown(docs: DataFrame, md: str = "md") -> DataFrame:
    return check_m1(docs, md).unionByName(check_m2(docs, md)).unionByName(check_m3(docs, md))


# Elements that HTML closes by itself.
_CLOSED_BY_ITSELF = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup caption html body head rb rt rp".split())


class _Faults(HTMLParser):
    """Parse errors as they are met: stray and missing end tags, ends out of order, attributes given twice."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        names = [n for n, _ in attrs]
        self.found += [f"attribute {n} twice in {tag}" for n in sorted({n for n in names if names.count(n) > 1})]
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.found.append(f"{tag} cannot close itself")

    def handle_endtag(self, tag):
        if tag in VOID:
            return  # rule H4
        if tag not in self.open:
            self.found.append(f"end of {tag} without its start")
            return
        while (last := self.open.pop()) != tag:
            if last not in _CLOSED_BY_ITSELF:
                self.found.append(f"{tag} ends before {last}")

    def finish(self) -> list[str]:
        self.close()
        return self.found + [f"{t} never ends" for t in self.open if t not in _CLOSED_BY_ITSELF]


def html_faults(html: str | None) -> list[str]:
    parser = _Faults()
    parser.feed(html or "")
    return parser.finish()


def check_h1(docs: DataFrame, html: str = "html") -> DataFrame:
    """Parse errors, one row each, found by going through the tags of each document."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(d, "H1", fault, "warning") for d, text in zip(pdf["doc_id"], pdf["html"], strict=True) for fault in html_faults(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "rule_id", "message", "severity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(html).alias("html")).mapInPandas(run, "doc_id long, rule_id string, message string, severity string")


def tag_balance(docs: DataFrame, html: str = "html") -> DataFrame:
    """Block and inline elements opened and closed a different number of times: an H1 without Python."""
    names = ("b", "i", "em", "strong", "div", "section", "article", "table", "ul", "ol", "a", "span")
    opened = [F.regexp_count(F.col(html), F.lit(rf"(?i)<{n}(\s[^>]*)?>")) for n in names]
    closed = [F.regexp_count(F.col(html), F.lit(rf"(?i)</{n}\s*>")) for n in names]
    odd = F.array_join(F.array_compact(F.array(*[F.when(o != c, F.lit(n)) for n, o, c in zip(names, opened, closed, strict=True)])), ",")
    return docs.withColumn("_odd", odd).where("_odd <> ''").select("doc_id", F.lit("H1").alias("rule_id"), F.concat(F.lit("unbalanced: "), "_odd").alias("message"), F.lit("warning").alias("severity"))


def check_h2(docs: DataFrame, html: str = "html") -> DataFrame:
    return _violations(docs, "H2", ~F.coalesce(F.col(html), F.lit("")).rlike(r"(?i)^\s*<!doctype"), "no doctype", "error")


def check_h3(docs: DataFrame, html: str = "html") -> DataFrame:
    """Ids that occur more than once in a document."""
    ids = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?i)<[a-z][^>]*?\sid\s*=\s*\"([^\"]+)\""), F.lit(1))).alias("id"))
    twice = ids.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.select("doc_id", F.lit("H3").alias("rule_id"), F.concat(F.lit("duplicate id "), "id").alias("message"), F.lit("warning").alias("severity"))


def check_h4(docs: DataFrame, html: str = "html") -> DataFrame:
    """End tags of elements that have none."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col(html), F.lit(rf"(?i)</({'|'.join(VOID)})\s*>"), F.lit(1))).alias("tag"))
    return found.select("doc_id", F.lit("H4").alias("rule_id"), F.concat(F.lit("closing tag of void element "), F.lower("tag")).alias("message"), F.lit("warning").alias("severity"))


def validate_html(docs: DataFrame, html: str = "html") -> DataFrame:
    return check_h1(docs, html).unionByName(check_h2(docs, html)).unionByName(check_h3(docs, html)).unionByName(check_h4(docs, html))


def reports(docs: DataFrame, violations: DataFrame) -> DataFrame:
    """Errors and warnings of each document; it passes without either."""
    counts = violations.groupBy("doc_id").agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", zero("errors"), zero("warnings"))
    return joined.withColumn("passed", (F.col("errors") == 0) & (F.col("warnings") == 0))


# Parts that a package must have, and the root element of each main part.
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ROOTS = {"word/document.xml": "document", "word/styles.xml": "styles", "word/numbering.xml": "numbering", "word/footnotes.xml": "footnotes", "word/endnotes.xml": "endnotes"}


def docx_violations(content: bytes) -> list[tuple[str, str]]:
    """(rule, message) of a package: parts (D1), content types (D2), targets (D3), roots (D4), well-formedness (D5), section (D6)."""
    from ..sources.xml import local, safe_tree

    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile:
        return [("D1", "not a zip archive")]
    names, trees, out = set(archive.namelist()), {}, []
    out += [("D1", f"{part} is missing") for part in REQUIRED if part not in names]
    for name in sorted(n for n in names if re.search(r"\.(xml|rels)$", n)):
        try:
            trees[name] = safe_tree(archive.read(name))
        except ET.ParseError as e:
            out.append(("D5", f"{name}: {e}"))
    types = trees.get("[Content_Types].xml")
    if types is not None:
        overrides = {e.get("PartName", "").lstrip("/") for e in types if local(e.tag) == "Override"}
        defaults = {e.get("Extension", "").lower() for e in types if local(e.tag) == "Default"}
        out += [("D2", f"{part} is declared but absent") for part in sorted(overrides - names)]
        out += [("D2", f"{n} has no content type") for n in sorted(names) if n != "[Content_Types].xml" and n not in overrides and n.rpartition(".")[2].lower() not in defaults and not n.endswith("/")]
    for name, tree in trees.items():
        if name.endswith(".rels"):
            base = posixpath.dirname(posixpath.dirname(name))
            for e in tree:
                if e.get("TargetMode") != "External":
                    target = e.get("Target", "")
                    path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))
                    if path not in names:
                        out.append(("D3", f"{name}: target {target} is absent"))
        if name in ROOTS and tree.tag != _W + ROOTS[name]:
            out.append(("D4", f"{name}: root is {local(tree.tag)}"))
    document = trees.get("word/document.xml")
    body = document.find(_W + "body") if document is not None else None
    if body is None or not len(body) or body[-1].tag != _W + "sectPr":
        out.append(("D6", "the body does not end with section properties"))
    return out


# Parts of an HWPX package, the roots of its main parts and the languages of its fonts.
HWPX_PARTS = ("mimetype", "version.xml", "META-INF/container.xml", "Contents/content.hpf", "Contents/header.xml", "Contents/section0.xml")
HWPX_LANGUAGES = {"HANGUL", "LATIN", "HANJA", "JAPANESE", "OTHER", "SYMBOL", "USER"}


def hwpx_violations(content: bytes) -> list[tuple[str, str]]:
    """(rule, message): mimetype (HX1), parts (HX2), manifest (HX3), header (HX4), namespaces (HX5), pictures (HX6), well-formedness (HX7)."""
    from ..sources.xml import local, safe_tree

    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile:
        return [("HX2", "not a zip archive")]
    infos, out, trees = archive.infolist(), [], {}
    names = {i.filename for i in infos}
    if not infos or infos[0].filename != "mimetype" or infos[0].compress_type != zipfile.ZIP_STORED or archive.read("mimetype") != b"application/hwp+zip":
        out.append(("HX1", "mimetype must come first, stored, and name the format"))
    out += [("HX2", f"{part} is missing") for part in HWPX_PARTS if part not in names]
    for name in sorted(n for n in names if re.search(r"\.(xml|hpf|rdf)$", n)):
        try:
            trees[name] = safe_tree(archive.read(name))
        except ET.ParseError as e:
            out.append(("HX7", f"{name}: {e}"))
    manifest = trees.get("Contents/content.hpf")
    items = {e.get("id"): e.get("href", "") for e in manifest.iter() if local(e.tag) == "item"} if manifest is not None else {}
    hrefs = {posixpath.normpath(h) for h in items.values()}
    out += [("HX3", f"{h} is listed but absent") for h in sorted(hrefs) if h not in names]
    out += [("HX3", f"{n} is not in the manifest") for n in sorted(names) if re.fullmatch(r"Contents/section\d+\.xml", n) and n not in hrefs]
    head = trees.get("Contents/header.xml")
    if head is not None:
        missing = HWPX_LANGUAGES - {e.get("lang") for e in head.iter() if local(e.tag) == "fontface"}
        out += [("HX4", f"no fonts for {', '.join(sorted(missing))}")] if missing else []
        out += [("HX4", f"no {part}") for part in ("charPr", "paraPr", "style") if not any(local(e.tag) == part for e in head.iter())]
    for name, tree in trees.items():
        wanted = {"Contents/header.xml": "head", **({name: "section"} if re.fullmatch(r"Contents/section\d+\.xml", name) else {})}.get(name)
        if wanted and not tree.tag.startswith("{http://www.hancom.co.kr/hwpml/2011/" + wanted + "}"):
            out.append(("HX5", f"{name}: root is {tree.tag}"))
        for e in tree.iter():
            ref = e.get("binaryItemIDRef")
            if ref and ref not in items and not any(n.startswith(f"BinData/{ref}.") for n in names):
                out.append(("HX6", f"{name}: picture {ref} is absent"))
    return out


def _packages(packages: DataFrame, content: str, check) -> DataFrame:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(d, rule, message, "error") for d, c in zip(pdf["doc_id"], pdf["content"], strict=True) for rule, message in check(c)]
            yield pd.DataFrame(rows, columns=["doc_id", "rule_id", "message", "severity"])

    return packages.select("doc_id", F.col(content).alias("content")).mapInPandas(run, SCHEMA)


def validate_hwpx(packages: DataFrame, content: str = "content") -> DataFrame:
    """Violations of HWPX packages (doc_id, content)."""
    return _packages(packages, content, hwpx_violations)


def validate_docx(packages: DataFrame, content: str = "content") -> DataFrame:
    """Violations of DOCX packages (doc_id, content)."""
    return _packages(packages, content, docx_violations)
