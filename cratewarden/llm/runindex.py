"""Repeated byte strings by run-length indexes: run-compressed Burrows-Wheeler transforms with sampled run ends.

A byte goes if a string of LENGTH bytes around it also starts anywhere else. Such a
string, a window, is routed by the smallest hash of a gram in it: equal windows
have equal ones, and a run of windows shares one, so a text falls into segments
(a run of windows and the bytes under it) that meet all they can match under one
key. Segments that are equal as a whole are counted, not compared: what two of them
hold is repeated. Of different segments under one key, one of each is indexed.

The index of a block of segments sorts its suffixes, keeps the transform as runs,
and of the suffix array only the text positions at the two ends of each run. The
matching statistics of the segments against each other are then streamed from
those samples, left to right: the match of a position with its neighbour in
suffix order is one shorter than that of the position before, unless the
position ends a run. So only the matches at run ends are compared byte by byte, and the
more repetitive a corpus, the fewer these are. A match of LENGTH or more marks.

Scale. Keys, counts and places are shuffled, and the bytes of segments whose key others
have too; texts are joined twice, with the segments to cut out and with the
marks. An index holds one key or several, up to BLOCK bytes each. A key with more than
that (a phrase in a third of all texts) isn't indexed: its segments, once each,
are routed again by longer grams, up to whole windows, which are counted. Each
level leaves out windows whose longer gram is unique, and none that is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import cut

LENGTH = 400
#: Bytes of the grams that route windows, level by level.
GRAMS = (64, 232, 316, 358, 379, 390, 395, 398, 400)
#: Bytes under one key that are indexed together, and windows scanned at once and held in one segment.
BLOCK, CHUNK, RUN = 1 << 21, 1 << 20, 4096
_U = np.uint64
_END = 255  # occurs in no UTF-8 text

MARKS = "doc long, row_key long, start long, size long"
_PLACE = ["doc", "row_key", "base"]


# --- segments ---


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values in a row."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - width + span], h[width - span :]) if width > span else h


def _scan(data: np.ndarray, offsets: np.ndarray, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, name, row, place in the row, windows, whether the key's gram occurs again) of each segment of rows laid end to end."""
    for low in range(int(offsets[0]), int(offsets[-1]) - LENGTH + 1, CHUNK):
        text = data[low : min(low + CHUNK + LENGTH - 1, int(offsets[-1]))]
        many = len(text) - LENGTH + 1
        up, down = wordhash._bytes(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(wordhash._LETTER[text] * up[: len(text)], out=sums[1:])
        hashes = wordhash.mix((sums[gram:] - sums[:-gram]) * down[: len(text) - gram + 1])
        least = _least(hashes, LENGTH - gram + 1)
        cuts = offsets[(offsets > low) & (offsets < low + len(text))] - low
        first, last = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, low + many, "left")
        begin, end = np.maximum(offsets[first:last] - low, 0), np.minimum(offsets[first + 1 : last + 1] - low - LENGTH + 1, many)
        inside = np.zeros(many + 1, np.int64)
        real = end > begin
        np.add.at(inside, begin[real], 1)
        np.add.at(inside, end[real], -1)
        inside = np.cumsum(inside[:-1]) > 0
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])])
        new[cuts[cuts < many]] = True
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, many))
        start, size = start[inside[start]], size[inside[start]]
        pieces = -(-size // RUN)
        if len(pieces) and pieces.max() > 1:
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, size = np.repeat(start, pieces) + nth * RUN, np.minimum(np.repeat(size, pieces) - nth * RUN, RUN)
        if not len(start):
            continue
        stop = start + size + LENGTH - 1
        name = wordhash.mix((sums[stop] - sums[start]) * down[start] ^ size.astype(np.uint64))
        row = np.searchsorted(offsets, start + low, "right") - 1
        yield least[start], name, row, start + low - offsets[row], size, _again(hashes, least[start], start, size + LENGTH - gram)


def _again(hashes: np.ndarray, keys: np.ndarray, start: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether each key is the hash of two or more of the `grams` grams from `start` on."""
    known = np.unique(keys)
    bits = np.zeros(1 << 20, bool)
    bits[(known & _U(len(bits) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(bits[(hashes & _U(len(bits) - 1)).astype(np.int64)])
    key = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
    at, key = at[known[key] == hashes[at]], key[known[key] == hashes[at]]
    line = np.sort(key * (1 << 40) + at)
    own = np.searchsorted(known, keys) * (1 << 40) + start
    return np.searchsorted(line, own + grams) - np.searchsorted(line, own) > 1


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _name_task(gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, row_key, base = (np.asarray(batch.column(i)) for i in range(3))
        for key, name, row, at, size, again in _scan(*_bytes_of(batch.column(3)), gram):
            place = wordhash.mix(wordhash.mix(row_key[row].view(np.uint64) ^ wordhash.mix(doc[row].view(np.uint64))) + (base[row] + at).astype(np.uint64))
            columns = [key.view(np.int64), name.view(np.int64), place.view(np.int64), doc[row], row_key[row], base[row], at, size.astype(np.int32), again]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "name", "place", *_PLACE, "at", "size", "again"])


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments wanted of each text."""
    for batch in batches:
        data, offsets = _bytes_of(batch.column(3))
        wanted = batch.column(4)
        inner = wanted.flatten()
        key, at, size, alone, hot = (inner.field(i) for i in range(5))
        row = np.repeat(np.arange(len(wanted)), np.diff(np.asarray(wanted.offsets)))
        start = offsets[row] + np.asarray(at)
        stop = start + np.asarray(size) + LENGTH - 1
        for low in range(0, len(row), 4096):
            part = slice(low, low + 4096)
            texts = pa.array([data[a:b].tobytes() for a, b in zip(start[part], stop[part], strict=True)], pa.binary())
            own = pa.array(row[part])
            yield pa.RecordBatch.from_arrays(
                [key[part], hot[part], alone[part], batch.column(0).take(own), batch.column(1).take(own), pa.array(np.asarray(batch.column(2))[row[part]] + np.asarray(at)[part]), texts],
                ["key", "hot", "alone", *_PLACE, "text"],
            )


# --- the index ---


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling from 8 bytes on; each round sorts only suffixes that are still equal to another."""
    n = len(text)
    word = packed(text)
    order = np.argsort(word)
    head = np.concatenate([[True], word[order][1:] != word[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    todo, h = _equal(head, np.arange(n)), 8
    while len(todo):
        i = order[todo]
        key = rank[i] * (n + 1) + np.where(i + h < n, rank[np.minimum(i + h, n - 1)] + 1, 0)
        turn = np.argsort(key)
        i, key = i[turn], key[turn]
        order[todo] = i
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[i] = np.maximum.accumulate(np.where(head, todo, 0))
        todo, h = _equal(head, todo), 2 * h
    return order


def _equal(head: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The slots in groups of two or more."""
    return slots[~head | ~np.concatenate([head[1:], [True]])]


def packed(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, in the order of bytes; beyond the end come zeros."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(len(text), np.uint64)
    for k in range(8):
        word = (word << _U(8)) | padded[k : k + len(text)]
    return word


def common(text: np.ndarray, word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b share; eight at a time."""
    n, out = len(text), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        fits = np.maximum(i, j) + 8 <= n
        same = np.zeros(len(live), bool)
        same[fits] = word[i[fits]] == word[j[fits]]
        for at in np.flatnonzero(~fits):
            x, y = text[i[at] :], text[j[at] :]
            differ = np.flatnonzero(x[: len(y)] != y[: len(x)])
            out[live[at]] += differ[0] if len(differ) else min(len(x), len(y))
        end = fits & ~same
        x = word[i[end]] ^ word[j[end]]
        equal = np.zeros(len(x), np.int64)
        for k in range(1, 8):
            equal += x < _U(1 << (64 - 8 * k))
        out[live[end]] += equal
        live = live[same]
        out[live] += 8
    return out


@dataclass
class RunIndex:
    """A run-compressed transform: the byte of each run, how long the runs are, and the text positions sampled at their ends, each with its neighbour's in the run before or after."""

    head: np.ndarray
    size: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray) -> RunIndex:
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], 256)
        start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        size = np.diff(np.append(start, len(text)))
        return cls(before[start], size, order[start], order[start + size - 1])

    def statistics(self, text: np.ndarray) -> np.ndarray:
        """For each position of the text, the longest match that begins there and anywhere else."""
        place, best = np.arange(len(text)), np.zeros(len(text), np.int64)
        match = common(text, packed(text), self.first[1:], self.last[:-1])
        for sampled, own in ((self.first, np.append(0, match)), (self.last, np.append(match, 0))):
            turn = np.argsort(sampled)
            reach = (sampled + own)[turn]  # where the match of a sampled position ends, as do those after it
            best = np.maximum(best, reach[np.searchsorted(sampled[turn], place, "right") - 1] - place)
        return best


def _index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the segments of a task, which come in order of key."""
    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for row in zip(*columns, strict=True):
            if row[:1] + row[2:5] == last:
                continue  # the same place of a row that comes twice
            if size >= BLOCK and row[0] != last[0]:
                yield _marks(held)
                held, size = [], 0
            last = row[:1] + row[2:5]
            held.append(row)
            size += len(row[5])
    if held:
        yield _marks(held)


def _marks(held: list[tuple]) -> pa.RecordBatch:
    """The matched stretches of the segments that are alone of their kind; the others are known to be repeated."""
    sizes = np.array([len(row[5]) + 1 for row in held])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(row[5] + bytes([_END]) for row in held), np.uint8)
    long = RunIndex.of(text).statistics(text) >= LENGTH
    segment = np.repeat(np.arange(len(held)), sizes)
    long &= np.arange(len(text)) + LENGTH < ends[segment]
    long &= np.array([row[1] for row in held])[segment]
    step = np.diff(np.concatenate([[0], long.astype(np.int8), [0]]))
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    own = segment[start]
    at = np.array([row[4] for row in held])[own] + start - (ends - sizes)[own]
    doc, row_key = (np.array([row[k] for row in held], np.int64)[own] for k in (2, 3))
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row_key), pa.array(at.astype(np.int64)), pa.array((stop - start + LENGTH - 1).astype(np.int64))], ["doc", "row_key", "start", "size"])


# --- the job ---


def _level(source: DataFrame, gram: int) -> tuple[DataFrame, DataFrame | None]:
    """source (doc, row_key, base, text) -> marks, and the segments of keys too large for an index, as the next source."""
    rows = source.mapInArrow(lambda batches: _name_task(gram, batches), "key long, name long, place long, doc long, row_key long, base long, at long, size int, again boolean")
    named = cut(rows, "segments")
    kinds = named.groupBy("key", "name").agg(F.count(F.lit(1)).alias("copies"), F.min("place").alias("first"), F.max("again").alias("again"), F.max("size").alias("bytes"))
    keys = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("bytes") + LENGTH - 1).alias("total"), F.max("again").alias("any"))
    met = keys.filter("kinds > 1 or any").select("key", "total")
    judged = kinds.join(met, "key", "left").filter("copies > 1 or total is not null").select("key", "name", "copies", "first", "total")
    plan = cut(named.join(judged, ["key", "name"]), "segment-plan")
    whole = F.col("copies") > 1 if gram < LENGTH else F.lit(True)
    marks = plan.filter(whole).select("doc", "row_key", (F.col("base") + F.col("at")).alias("start"), (F.col("size") + LENGTH - 1).cast("long").alias("size"))
    wanted = plan.filter((F.col("place") == F.col("first")) & F.col("total").isNotNull())
    if gram == LENGTH or wanted.isEmpty():
        return marks, None
    one = F.struct("key", "at", "size", (F.col("copies") == 1).alias("alone"), (F.col("total") > BLOCK).alias("hot"))
    by_text = wanted.groupBy(*_PLACE).agg(F.collect_set(one).alias("wanted"))
    pieces = cut(source.join(by_text, _PLACE).select(*_PLACE, "text", "wanted").mapInArrow(_cut_task, "key long, hot boolean, alone boolean, doc long, row_key long, base long, text binary"), "segment-bytes")
    cold = pieces.filter("not hot").select("key", "alone", "doc", "row_key", "base", "text")
    found = cold.repartition("key").sortWithinPartitions("key", "doc", "row_key", "base").mapInArrow(_index_task, MARKS)
    hot = pieces.filter("hot").select(*_PLACE, "text")
    return marks.unionByName(cut(found, "segment-marks")), None if hot.isEmpty() else hot


def repeated_stretches(texts: DataFrame) -> DataFrame:
    """texts (doc, row_key, text binary) -> (doc, row_key, start, size) of stretches that together cover all repeated windows, and nothing else."""
    source, out = texts.select("doc", "row_key", F.lit(0).cast("long").alias("base"), "text"), None
    for gram in GRAMS:
        marks, source = _level(source, gram)
        out = marks if out is None else out.unionByName(marks)
        if source is None:
            break
    return out


def _remove_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, spans, kept = [], [], [], []
        for text, marks in zip(batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            stay = np.ones(len(text) + 2, bool)
            stay[0] = stay[-1] = True
            runs = 0
            if marks.is_valid and len(marks.values):
                start, size = (np.asarray(marks.values.field(i)) for i in range(2))
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + size, -1)
                stay[1:-1] = np.cumsum(step[:-1]) == 0
                runs = int(np.count_nonzero(stay[:-1] & ~stay[1:]))
                rest = np.frombuffer(text, np.uint8)[stay[1:-1]].tobytes()
            else:
                rest = text
            total.append(len(text))
            removed.append(len(text) - len(rest))
            spans.append(runs)
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept binary): each text without the bytes that a repeated window of 400 bytes covers.

    Every occurrence goes, the first as well. Null texts are empty; a text under 400
    bytes keeps all. Each row is a document, also where a doc_id or a whole row
    comes again; a missing doc_id stays missing. What is kept may part a
    character, so it is binary. Other columns are ignored; an empty table has no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text")).withColumns({"doc": F.coalesce("doc_id", F.lit(0).cast("long")), "row_key": F.xxhash64("text", F.octet_length("text"))})
    marks = repeated_stretches(rows.filter(F.octet_length("text") >= LENGTH))
    listed = marks.groupBy("doc", "row_key").agg(F.collect_list(F.struct("start", "size")).alias("marks"))
    joined = rows.join(listed, ["doc", "row_key"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_remove_task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_report(docs: DataFrame) -> DataFrame:
    return dedup_suffixes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
