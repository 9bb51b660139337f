"""Command line: PDF files to Markdown files."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import __version__
from .operators.markdown import Options


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("quire", description="PDF files to Markdown")
    p.add_argument("inputs", nargs="+", help="PDF files, or folders whose *.pdf files are taken")
    p.add_argument("--out", help="folder for one .md per input; a single input may go to standard output")
    p.add_argument("--no-page-breaks", action="store_true")
    p.add_argument("--no-image-placeholders", action="store_true")
    p.add_argument("--jobs", type=int, default=None)
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--version", "-V", action="version", version=__version__)
    a = p.parse_args(argv)
    if a.jobs is not None and a.jobs < 1:
        p.error("--jobs must be at least 1")
    return a


def resolve(inputs: list[str]) -> list[Path]:
    """Files in the order given, those of a folder by name; a missing path is an error."""
    out: list[Path] = []
    for i in map(Path, inputs):
        if not i.exists():
            raise FileNotFoundError(str(i))
        out += sorted(p for p in i.iterdir() if p.name.endswith(".pdf")) if i.is_dir() else [i]
    return out


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans.document import pages_from_rows, to_markdown
    from .sources.pdf import parse_simple

    a = arguments(argv)
    options = Options(not a.no_page_breaks, not a.no_image_placeholders)
    files = resolve(a.inputs)
    if a.out is None:
        if len(files) != 1:
            print("several inputs need --out", file=sys.stderr)
            return 2
        print(to_markdown(pages_from_rows(*parse_simple(files[0].read_bytes())), options))
        return 0
    spark = SparkSession.builder.master(f"local[{a.jobs or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()

    def convert(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, to_markdown(pages_from_rows(*parse_simple(bytes(data))), options), None))
                except Exception as e:  # one bad file must not stop the batch
                    rows.append((path, "", f"{type(e).__name__}: {e}"))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    out = Path(a.out)
    out.mkdir(parents=True, exist_ok=True)
    df = spark.read.format("binaryFile").load([str(f) for f in files]).select("path", "content")
    failed = 0
    for r in df.mapInPandas(convert, "path string, markdown string, error string").toLocalIterator():
        (out / f"{Path(r['path']).stem}.md").write_text(r["markdown"])
        failed += r["error"] is not None
        if not a.quiet:
            print(r["path"], r["error"] or "ok", file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
