"""Arrow batches as tables of whole groups."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().dictionary_encode("encode").indices)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows with the places where groups start; a group is never cut.

    The batches come sorted by ``keys``; a group may go on in the next one.
    """
    kept, n, enough = [], 0, rows
    for b in itertools.chain(batches, [None]):
        if b is not None:
            kept.append(b)
            n += b.num_rows
            if n < enough:
                continue
        if not n:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            code = _codes(t.column(k))
            new[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(new)
        cut = n if b is None else int(starts[-1])
        if cut:
            yield t.slice(0, cut), starts[starts < cut]
        kept, n = t.slice(cut).to_batches(), n - cut
        # a long group is looked at again only when there is twice as much of it
        enough = max(rows, 2 * n)
