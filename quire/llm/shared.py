"""Helpers shared by the training-data operators: intermediate tables, Arrow glue."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, since a machine-local folder would not be
    visible to the other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        folder = tempfile.TemporaryDirectory(prefix="quire-")
        atexit.register(folder.cleanup)
        _LOCAL_DIR.append(folder.name)
    return f"file://{_LOCAL_DIR[0]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage without tying the result to an executor: a lost executor costs
    only the tasks that were running on it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_quire_path", None)
        if path:
            spark = t.sparkSession
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_parts(arr: pa.Array, most: int = 2 << 20, rows: int = 1 << 16):
    """Split a string array into runs of at most ``rows`` rows holding about ``most`` bytes each.

    Yields ``(first row, bytes as uint8, offsets)`` with offsets rebased to the run.
    Nulls count as empty texts. A single longer text forms a run of its own.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    n = len(arr)
    if n == 0:
        return
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow list array over a flat numpy array."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values))


def table(df_or_name, spark: SparkSession | None = None, sf_dir: str | None = None) -> DataFrame:
    """A DataFrame as it is, or a table of ``sf_dir`` by name."""
    if isinstance(df_or_name, DataFrame):
        return df_or_name
    return spark.read.parquet(f"{sf_dir}/{df_or_name}.parquet")
