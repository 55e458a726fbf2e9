"""What a Python worker holds for a batch is bounded by its parts, not by the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cratewarden.llm import decontaminate, simhash, wordhash


def _batch(rows: int = 4000) -> pa.RecordBatch:
    """About 9 MB of text."""
    words = np.array([f"word{i:04d}" for i in range(3000)])
    drawn = np.random.default_rng(1).integers(0, len(words), (rows, 250))
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array([" ".join(words[d]) for d in drawn])], ["doc_id", "text"])


def _peak(task) -> tuple[float, list[pa.RecordBatch]]:
    """MB of numpy's arrays and Python's objects at most, and the batches."""
    tracemalloc.start()
    out = list(task)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, out


def test_parts_hold_every_row_once_in_order():
    texts = ["a" * n if n else None for n in (0, 3, 1 << 20, 5, 0, 2 << 20, 1)] + [""] * 1500
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    for whole in (batch, batch.slice(1, 700), batch.slice(0, 0)):
        parts = list(wordhash.parts(whole))
        assert pa.Table.from_batches(parts, batch.schema).equals(pa.Table.from_batches([whole]))
        for part in parts:
            size = sum(len(t or "") for t in part.column(1).to_pylist())
            assert 0 < part.num_rows <= wordhash.PART_ROWS and (size <= wordhash.PART or part.num_rows == 1)


def test_near_copies_hold_little_of_a_batch():
    batch = _batch()
    for powers in (wordhash._bytes, wordhash._words):
        powers.up = powers.down = np.ones(1, np.uint64)
    peak, out = _peak(simhash._set_task(5, ["digest", "size", "bits", "keys"], iter([batch])))
    assert sum(b.num_rows for b in out) == batch.num_rows
    assert peak < 60, peak


def test_decontamination_holds_little_of_a_batch(tmp_path):
    batch = _batch()
    item = " ".join(batch.column(1)[17].as_py().split()[40:90])
    (tmp_path / "index").write_bytes(decontaminate.Index([1], decontaminate.item_words([item])).saved())
    for powers in (wordhash._bytes, wordhash._words):
        powers.up = powers.down = np.ones(1, np.uint64)
    peak, out = _peak(decontaminate._clean_task(f"file://{tmp_path}/index", iter([batch])))
    assert [i for b in out for i in b.column(0).to_pylist()] == [i for i in range(batch.num_rows) if i != 17]
    assert peak < 60, peak
