"""Token ids as Arrow files of fixed-size lists.

The ids of the texts, an end id after each, are laid end to end and cut into sequences of
one length. Every task writes one Arrow IPC file whose record batches hold ``ROWS``
sequences (the last batch fewer) in two columns, ``ids`` and ``mask``, both fixed-size lists
without nulls; ids are 16-bit where the vocabulary allows. As all lists are equally
long, sequence ``k`` is row ``k % ROWS`` of batch ``k // ROWS`` and any of it is read as a view
of the mapped file, without copying. The mask is 0 only for the padding that fills up a file's
last sequence.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unigram
from .shared import shared_dir, text_parts
from .spans import starts

LENGTH = 1024
ROWS = 1024
END_ID = 2
MANIFEST = "doc_id bigint, file string, seq bigint, at int, n_ids bigint"


def schema_of(length: int, wide: bool) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", pa.int32() if wide else pa.uint16(), False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.uint8(), False), length), False)])


class Writer:
    """Cuts a stream of ids into sequences and writes them in whole batches.

    The file appears under its name only when it is complete; a repeated task writes the
    same bytes again.
    """

    def __init__(self, uri: str, length: int, wide: bool, rows: int = ROWS):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.length, self.rows, self.wide = length, rows, wide
        self.schema = schema_of(length, wide)
        self.kind = np.int32 if wide else np.uint16
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.sink = self.out = None
        self.kept: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.kept.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        block = self.length * self.rows
        if self.held >= block:
            flat = np.concatenate(self.kept)
            whole = len(flat) // block * block
            for lo in range(0, whole, block):
                self._batch(flat[lo : lo + block], block)
            self.kept, self.held = [flat[whole:]], len(flat) - whole

    def _batch(self, flat: np.ndarray, real: int) -> None:
        if self.out is None:
            self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
            self.sink = self.fs.open_output_stream(self.temporary)
            self.out = pa.ipc.new_file(self.sink, self.schema)
        mask = np.ones(len(flat), np.uint8)
        mask[real:] = 0
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(i).type) for i, x in enumerate((flat, mask))]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.kept)
            full = -(-len(flat) // self.length) * self.length
            self._batch(np.concatenate([flat, np.zeros(full - len(flat), self.kind)]), len(flat))
        if self.out is not None:
            self.out.close()
            self.sink.close()
            if self.fs.type_name != "local" and self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
                self.fs.delete_file(self.path)
            self.fs.move(self.temporary, self.path)


def write(docs: DataFrame, model: unigram.Model, folder: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write all texts under ``folder`` and return the manifest, one row per text.

    ``doc_id, file, seq, at, n_ids``: the text's ids, without its end id, begin at place ``at`` of
    sequence ``seq`` of ``file`` and run on through the following sequences. Null texts and
    empty ones have no ids but an end id all the same. Rows without id and repeated rows are
    written each. An empty table writes no file. The files are written when the result is
    computed.
    """
    wide = len(model.size) > 1 << 16

    def run(batches):
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.arrow"
        w = Writer(uri, length, wide)
        for b in batches:
            for lo, data, offs in text_parts(b.column(1), 4 << 20):
                ids, count = unigram.encode_rows(model, data, offs)
                first = w.total + starts(count + 1)
                w.add(np.insert(ids, np.cumsum(count), end_id))
                n = len(count)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array([uri] * n, pa.string()), pa.array(first // length), pa.array((first % length).astype(np.int32)), pa.array(count)], names=["doc_id", "file", "seq", "at", "n_ids"])
        w.close()

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, MANIFEST)


class Reader:
    """Random access to the sequences of one file; local files are mapped, not read."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if where.type_name == "local" else where.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        first = self.file.get_batch(0).num_rows
        self.rows = first
        self.count = first * (self.file.num_record_batches - 1) + self.file.get_batch(self.file.num_record_batches - 1).num_rows

    def __len__(self) -> int:
        return self.count

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence, as views of the file."""
        if not 0 <= k < self.count:
            raise IndexError(k)
        b, at = self.file.get_batch(k // self.rows), k % self.rows * self.length
        return tuple(b.column(i).flatten().to_numpy(zero_copy_only=True)[at : at + self.length] for i in (0, 1))

    def ids(self, seq: int, at: int, n: int) -> np.ndarray:
        """``n`` ids from a place on, over as many sequences as they fill."""
        out = [self.sequence(seq + i)[0] for i in range(-(-(at + n) // self.length))]
        return np.concatenate(out)[at : at + n] if out else np.empty(0, np.int32)


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/quire/tokens-{uuid.uuid4().hex}"
