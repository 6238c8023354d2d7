"""Command line: convert, export, patch, validate, diff, info and inspect files, many at once."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from . import tools


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("docloom").getOrCreate()


def _show(found: DataFrame, out) -> int:
    """Prints rows as they come, without gathering them."""
    count = 0
    for row in found.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row), file=out)
        count += 1
    return count


def _write(made: DataFrame, output: str | None, out) -> None:
    """Rows (path, content) to standard output, or below a folder by Spark's writers."""
    if output is None:
        for row in made.toLocalIterator():
            print(row["content"], file=out)
    elif dict(made.dtypes)["content"] == "binary":
        made.write.mode("overwrite").parquet(output)
    else:
        made.write.mode("overwrite").json(output)


def _convert(a, out) -> int:
    fmt = a.format or (os.path.splitext(a.output or "")[1].lstrip(".") or "md")
    _write(tools.convert(_session(), a.input, fmt, **({"embed_ids": True} if a.embed_ids else {})), a.output, out)
    return 0


def _export(a, out) -> int:
    _write(tools.export_md(_session(), a.input), a.output, out)
    return 0


def _patch(a, out) -> int:
    from .sinks.hwp import patch_hwp_blocks
    from .sources.markdown import parse_markdown

    with open(a.input, "rb") as source, open(a.md, encoding="utf-8") as edited:
        made = patch_hwp_blocks(source.read(), parse_markdown(tools.strip_source_header(edited.read())))
    with open(a.output, "wb") as target:
        target.write(made)
    return 0


def _validate(a, out) -> int:
    return 1 if _show(tools.validate(_session(), a.input), out) else 0


def _diff(a, out) -> int:
    return 1 if _show(tools.diff(_session(), a.a, a.b), out) else 0


def _info(a, out) -> int:
    for spec in tools.info(a.format):
        print("\t".join(str(v) for v in spec.values()), file=out)
    return 0


def _inspect(a, out) -> int:
    if a.json:
        _write(tools.convert(_session(), a.input, "json"), None, out)
    else:
        _show(tools.inspect(_session(), a.input).orderBy("path", "type"), out)
    return 0


def main(arguments: list[str] | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="docloom", description="Documents on Spark. Inputs are paths or globs that Spark can read.")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple[tuple, dict]) -> None:
        made = commands.add_parser(name, help=run.__name__.strip("_"))
        for names, known in options:
            made.add_argument(*names, **known)
        made.set_defaults(run=run)

    given, output = (("input",), {}), (("-o", "--output"), {})
    command("convert", _convert, given, output, (("-f", "--format"), {}), (("--embed-ids",), {"action": "store_true"}))
    command("export", _export, given, output)
    command("patch", _patch, given, (("--md",), {"required": True}), (("-o", "--output"), {"required": True}))
    command("validate", _validate, given)
    command("diff", _diff, (("a",), {}), (("b",), {}))
    command("info", _info, (("format",), {"nargs": "?"}))
    command("inspect", _inspect, given, (("--json",), {"action": "store_true"}))
    known = parser.parse_args(arguments)
    try:
        return known.run(known, out)
    except (OSError, ValueError) as e:
        print(f"docloom: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
