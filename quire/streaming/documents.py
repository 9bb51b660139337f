"""Markdown of documents as their files arrive."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.markdown import Options
from ..plans.document import pages_from_rows, to_markdown
from ..sources.pdf import parse_simple


def markdown_stream(spark: SparkSession, folder: str, options: Options = Options(), parse=parse_simple) -> DataFrame:
    """A stream of ``doc_id, markdown, error`` over the PDF files of a folder.

    Every document stands alone, so the stream keeps no state and needs no watermark.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            rows = []
            for doc, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append((doc, to_markdown(pages_from_rows(*parse(content)), options), None))
                except Exception as e:  # a bad file is reported, the stream goes on
                    rows.append((doc, "", f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, names=["doc_id", "markdown", "error"])

    return files.mapInArrow(run, "doc_id string, markdown string, error string")
