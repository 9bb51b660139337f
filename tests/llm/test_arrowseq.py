import numpy as np
import pytest

from quire.llm import arrowseq as A
from quire.llm import unigram as U
from quire.llm.queries import MODEL

SCHEMA = "doc_id bigint, text string, file string, seq int"


def test_round_trip_through_views(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "ROWS", 4)
    model = U.load(MODEL)
    texts = ["hello world", None, "", "word " * 9000, "a\nb\tc é", "x" * 5000] + [f"text number {i}" for i in range(200)]
    rows = [(i, t, "f", 1) for i, t in enumerate(texts)] + [(None, "no id", "f", 1), (4, texts[4], "f", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = A.write(df, model, f"file://{tmp_path}/t", 64).collect()
    assert len(out) == len(rows)
    readers = {f: A.Reader(f) for f in {r["file"] for r in out}}
    want = {r["doc_id"]: r["ids"] for r in U.encode(df, model).collect()}
    for r in out:
        if r["doc_id"] is not None:
            reader = readers[r["file"]]
            assert reader.ids(r["seq"], r["at"], r["n_ids"]).tolist() == (want[r["doc_id"]] or [])
            assert reader.ids(r["seq"], r["at"], r["n_ids"] + 1)[-1] == A.END_ID
    total = sum(r["n_ids"] + 1 for r in out)
    assert sum(int(x.sequence(k)[1].sum()) for x in readers.values() for k in range(len(x))) == total
    for x in readers.values():
        ids, mask = x.sequence(len(x) - 1)
        assert len(ids) == len(mask) == 64 and not ids.flags.owndata and not mask.flags.owndata and ids.dtype == np.uint16
        full = int(mask.sum())
        assert mask[:full].all() and not mask[full:].any() and not ids[full:].any()
        with pytest.raises(IndexError):
            x.sequence(len(x))


def test_empty_table_writes_nothing(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert A.write(df, U.load(MODEL), f"file://{tmp_path}/none").collect() == []
    assert not (tmp_path / "none").exists()
