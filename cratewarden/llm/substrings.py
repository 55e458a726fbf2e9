"""Substring dedup behind a count-min prefilter.

Every window of 50 words is named by the smallest hash of its 25-word grams,
its anchor: equal windows have equal anchors, and a run of windows shares one,
so a text has about one anchor for 13 words. Each task counts the anchors of
its rows in a count-min sketch; merged, the sketches overestimate how often an
anchor, and so any window under it, occurs. A second pass sends on only windows
whose anchor is estimated to be repeated, and those are grouped exactly, by 96 hash
bits. No repeated window can be missed; a full sketch only sends more.

Scale. The sketch has about 8 cells for each anchor, by the bytes of the texts,
up to MAX_CELLS (2 ** 30: 128 MB of bits for each of its two rows), which is the
bound of what is broadcast. Beyond some 10 GB of text the cells fill, and beyond
some 100 GB the sketch sorts out little: the result is the same, but more windows
are grouped. Tasks count in pieces of BUFFER anchors and send the cells that
these use, never a whole sketch. Windows are grouped by a partial aggregate (the
smallest doc_id), and a passage that very many documents share is one row for
each task there. Texts are shuffled once, with the positions to remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash

WINDOW = 50
GRAM = 25
#: Bounds of the number of cells, and the bytes of text for one.
MIN_CELLS, MAX_CELLS, CELL_BYTES = 1 << 20, 1 << 30, 10
#: Cells in one piece of a sketch; pieces are what tasks send and merge.
PIECE = 1 << 16
#: Anchors that a task holds before it sends what they count.
BUFFER = 1 << 20


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window of `window` words: the smallest hash of a gram in it."""
    least = wordhash.windows(hashes, gram)
    span, width = window - gram + 1, 1
    while 2 * width <= span and len(least) > width:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[:-rest], least[rest:]) if 0 < rest < len(least) else least if not rest else least[:0]


def sketch_cells(anchor: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (wordhash.mix(anchor + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(cells - 1)).astype(np.int64)


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def _document_anchors(column: pa.Array) -> Iterator[np.ndarray]:
    """The anchors of each document once, for runs of documents."""
    for _, hashes, bounds in wordhash.chunks(column):
        found = anchors(hashes)
        if not len(found):
            continue
        inside = wordhash.within(bounds, WINDOW, len(found))
        first = np.concatenate([[True], (found[1:] != found[:-1]) | ~inside[:-1]]) & inside
        # a new row's first window counts again, even if its anchor is the last row's
        begins = bounds[:-1][bounds[:-1] < len(found)]
        first[begins] = inside[begins]
        # a document counts each of its anchors once, so what only it repeats isn't sent on
        at = np.flatnonzero(first)
        doc = np.searchsorted(bounds, at, "right")
        order = np.lexsort((found[at], doc))
        at, doc = at[order], doc[order]
        yield found[at[np.concatenate([[True], (found[at][1:] != found[at][:-1]) | (doc[1:] != doc[:-1])])[: len(at)]]]


def _sketch_task(cells: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sketches: for each piece, the cells counted once and those counted more often."""
    held, n = [], 0
    for batch in batches:
        for found in _document_anchors(_text(batch)):
            held.append(found)
            n += len(found)
            if n >= BUFFER:
                yield _sketch(np.concatenate(held), cells)
                held, n = [], 0
    if n:
        yield _sketch(np.concatenate(held), cells)


def _sketch(anchor: np.ndarray, cells: int) -> pa.RecordBatch:
    out = {"row": [], "piece": [], "once": [], "often": []}
    for row in range(2):
        used, n = np.unique(sketch_cells(anchor, row, cells), return_counts=True)
        pieces, starts = np.unique(used // PIECE, return_index=True)
        for piece, at, many in zip(pieces, np.split(used, starts[1:]), np.split(n, starts[1:]), strict=True):
            low = (at - piece * PIECE).astype(np.uint16)
            for k, v in (("row", row), ("piece", int(piece)), ("once", low[many == 1].tobytes()), ("often", low[many > 1].tobytes())):
                out[k].append(v)
    return pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int32()), pa.array(out["piece"], pa.int32()), pa.array(out["once"], pa.binary()), pa.array(out["often"], pa.binary())], ["row", "piece", "once", "often"])


def _merge_piece(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """Add the tasks' counts of one piece; keep which cells reach two."""
    count = np.zeros(PIECE, np.int64)
    for once, often in zip(parts["once"], parts["often"], strict=True):
        count[np.frombuffer(once, np.uint16)] += 1
        count[np.frombuffer(often, np.uint16)] += 2
    return pd.DataFrame({"row": [key[0]], "piece": [key[1]], "repeated": [np.packbits(count >= 2).tobytes()]})


def repeated_cells(docs: DataFrame, cells: int | None = None) -> list[np.ndarray]:
    """The merged sketch as bits: for each of its two rows, which cells count two or more. 2 * cells / 8 bytes at most."""
    if cells is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (size // CELL_BYTES).bit_length()))
    parts = docs.select("text").mapInArrow(lambda batches: _sketch_task(cells, batches), "row int, piece int, once binary, often binary")
    merged = parts.groupBy("row", "piece").applyInPandas(_merge_piece, "row int, piece int, repeated binary")
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(2)]
    for row, piece, repeated in merged.collect():
        bits[row][piece * (PIECE // 8) : (piece + 1) * (PIECE // 8)] = np.frombuffer(bytes(repeated), np.uint8)
    return bits


def _estimated(bits: list[np.ndarray], anchor: np.ndarray) -> np.ndarray:
    """Whether the sketch counts an anchor twice or more."""
    keep = np.ones(len(anchor), bool)
    for row in range(2):
        at = sketch_cells(anchor, row, len(bits[row]) * 8)
        keep &= (bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return keep


def _windows_task(sketch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = sketch.value
    for batch in batches:
        doc, key = (batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "row_key"))
        for base, hashes, bounds in wordhash.chunks(_text(batch)):
            found = anchors(hashes)
            at = np.flatnonzero(wordhash.within(bounds, WINDOW, len(found)))
            at = at[_estimated(bits, found[at])]
            row, every = np.searchsorted(bounds, at, "right") - 1, wordhash.windows(hashes, WINDOW)
            # of equal windows in one document the first stands for all
            order = np.lexsort((at, every[at], row))
            new = np.concatenate([[True], (every[at[order]][1:] != every[at[order]][:-1]) | (row[order][1:] != row[order][:-1])])[: len(at)]
            at, row = at[order][new], row[order][new]
            name = every[at].view(np.int64)
            check = (wordhash.windows(hashes, WINDOW, second=True)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            rows = pa.array(row + base)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(check), doc.take(rows), key.take(rows), pa.array((at - bounds[row]).astype(np.int32))], ["name", "check", "doc_id", "row_key", "at"])


def repeated_windows(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """docs (doc_id, row_key, text) -> (doc_id, row_key, at) for each window that also starts in a document with a smaller doc_id.

    Of windows that one document repeats only the first is given: a text of few
    words said over and over is a few rows, not a hot key.

    The windows are made twice, once for the aggregate and once for the join:
    making them is cheaper than keeping them.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, cells))
    texts = docs.select("doc_id", "row_key", "text")
    schema = "name long, check int, doc_id long, row_key long, at int"
    seen = texts.mapInArrow(lambda batches: _windows_task(sketch, batches), schema)
    first = seen.groupBy("name", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    return seen.join(first, ["name", "check"]).filter("doc_id > first").select("doc_id", "row_key", "at")


def _removal(frame: pd.DataFrame) -> pd.DataFrame:
    """Drop the words under the windows that start at `starts`, and under windows equal to those."""
    total, removed, kept = [], [], []
    for text, starts in zip(frame["text"], frame["starts"], strict=True):
        tokens = (text or "").encode().split()
        gone = np.zeros(len(tokens) + 1, np.int64)
        if starts is not None and len(starts):
            _, hashes, _ = next(wordhash.chunks(pa.array([text])))
            names = wordhash.windows(hashes, WINDOW)
            at = np.flatnonzero(np.isin(names, names[np.asarray(starts)]))
            gone[at] += 1
            ends = at + WINDOW
            gone[ends] -= 1
            gone = np.cumsum(gone)
            tokens_kept = [tokens[i] for i in np.flatnonzero(gone[:-1] == 0)]
        else:
            tokens_kept = tokens
        total.append(len(tokens))
        removed.append(len(tokens) - len(tokens_kept))
        kept.append(b" ".join(tokens_kept).decode())
    return frame.drop(columns=["text", "starts"]).assign(n_words=total, n_removed=removed, kept=kept)


def row_key() -> Column:
    """What tells texts of one doc_id apart."""
    return F.xxhash64("text", F.octet_length("text"))


def dedup_substrings(docs: DataFrame, *, cells: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, n_removed, kept): each text without the windows that an earlier document has.

    Earlier means a smaller doc_id; a null doc_id is neither earlier nor later
    than any. Null texts have no words. Repeated rows with one doc_id are judged
    each for itself and remove nothing from each other. Texts under 50 words
    have no window. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", row_key())
    gone = repeated_windows(docs.filter(F.col("doc_id").isNotNull()), cells).groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("starts"))
    joined = docs.join(gone, ["doc_id", "row_key"], "left").select("doc_id", "text", "starts")
    return joined.mapInPandas(lambda frames: map(_removal, frames), "doc_id long, n_words long, n_removed long, kept string")


def substring_report(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
