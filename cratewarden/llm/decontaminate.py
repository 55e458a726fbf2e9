"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

An item of n words contaminates a document if n consecutive words of it lie
within floor(max_edits * n) word edits of the item. At either end of the document the
window may hang over by as many words; each that is missing is one edit. Words
are runs of letters, digits and other non-ASCII characters, ASCII letters in
lower case.

The CGK embedding reads a sequence with a pointer that at step j moves on by
the random bit f_j(symbol), so sequences at a small edit distance fall into step
again after each edit and agree in most steps: edit distance becomes Hamming
distance. A band samples a few steps of such a walk, and a window is proposed
for the items whose sampled symbols agree in any band; WALKS walks of
BANDS bands reach the target recall (see `recall`). Windows over an end walk as well, on
symbols of no word. Proposals are verified by a banded edit distance,
and the windows around each that is near are measured too, for the nearest.

Windows that no item can be near are not walked: n words within k edits keep
n - q + 1 - kq of the item's runs of q words at least, whatever the item, so a
window of n words needs as many runs that occur in items of n words. This
knows neither items nor places in them, and leaves no near window out; which
item a window meets is for the walks to say.

Scale. Documents pass through one narrow stage. The benchmark is tested in
blocks of about BLOCK_ITEMS items or BLOCK_BYTES bytes. Tasks index the blocks
and write them to the shared folder, as plain arrays, where each Python worker reads a block
once, so items don't pass through the driver; a benchmark of any size runs in
as many passes as it has blocks, and a task holds one block.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import cut, open_uri, scratch_name, shared_dir

MAX_EDITS = 0.2
WALKS, BANDS, SAMPLES = 6, 6, 2
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 64 << 20
#: Bytes of text that are matched at once where whole rows pass through.
TEXT_BYTES = 1 << 19
#: Words of windows that are walked, or measured, at once.
AT_ONCE = 1 << 20
#: Share of a walk's steps that agree, at worst, for a window within the threshold (measured: 0.45 to 0.95).
WORST_AGREEMENT = 0.4

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[b for b in range(128) if not chr(b).isalnum()]] = True
_FOLD = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)
_U = np.uint64


def recall(agreement: float = WORST_AGREEMENT, walks: int = WALKS, bands: int = BANDS, samples: int = SAMPLES) -> float:
    """The chance that a window whose walks agree in this share of steps meets its item in some band."""
    return 1 - (1 - agreement**samples) ** (walks * bands)


def allowed(n: int) -> int:
    return int(MAX_EDITS * n)


def gram_size(n: int) -> int:
    """Words in a row, 3 at most, that a window within the allowed edits of an n-word item must share with it."""
    k = allowed(n)
    return min(3, -(-(n - k) // (k + 1)))


@dataclass
class Index:
    """A block of items, ready to be matched. All arrays; a few hundred bytes for each word of an item."""

    ids: list[int | None]
    tokens: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by gram size: hashes in order, each with every size of items that have it
    tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)  # by item size: for each band, keys in order and their items

    def __post_init__(self):
        if self.tables:
            return
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        sizes: dict[int, list[int]] = {}
        for i, words in enumerate(self.tokens):
            found.setdefault(q := gram_size(len(words)), []).append((wordhash.windows(words, q), len(words)))
            sizes.setdefault(len(words), []).append(i)
        for q, parts in found.items():
            h, n = np.concatenate([g for g, _ in parts]), np.concatenate([np.full(len(g), n) for g, n in parts])
            order = np.lexsort((n, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (n[order][1:] != n[order][:-1])])
            self.grams[q] = h[order][new], n[order][new]
        for n, items in sizes.items():
            keys = band_keys(np.concatenate([self.tokens[i] for i in items]), np.arange(len(items)) * n, n)
            self.tables[n] = []
            for band in keys:
                order = np.argsort(band, kind="stable")
                self.tables[n].append((band[order], np.array(items)[order]))

    def saved(self) -> bytes:
        """The index as plain arrays."""
        out = io.BytesIO()
        known = np.array([i is not None for i in self.ids])
        arrays = {"ids": np.array([i or 0 for i in self.ids], np.int64), "known": known, "words": np.concatenate(self.tokens), "sizes": np.array([len(t) for t in self.tokens])}
        arrays |= {f"gram-{part}-{q}": x for q, both in self.grams.items() for part, x in zip("hn", both, strict=True)}
        arrays |= {f"band-{part}-{n}": np.stack([both[k] for both in bands]) for n, bands in self.tables.items() for k, part in enumerate("ki")}
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Index:
        with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
            of = {name: arrays[name] for name in arrays.files}
        sized = lambda kind: [int(name.rsplit("-", 1)[1]) for name in of if name.startswith(kind)]
        ids = [int(i) if k else None for i, k in zip(of["ids"], of["known"], strict=True)]
        grams = {q: (of[f"gram-h-{q}"], of[f"gram-n-{q}"]) for q in sized("gram-h")}
        tables = {n: list(zip(of[f"band-k-{n}"], of[f"band-i-{n}"], strict=True)) for n in sized("band-k")}
        return cls(ids, np.split(of["words"], np.cumsum(of["sizes"])[:-1]), grams, tables)


@lru_cache(maxsize=4096)
def _plan(n: int) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """For windows of n words: by step, the (walk, band) that sample there, and by step and walk the multiplier whose top bit moves the pointer."""
    samples: list[list[tuple[int, int]]] = [[] for _ in range(2 * n)]
    factors = np.zeros((2 * n, WALKS, 1), np.uint64)
    for walk in range(WALKS):
        rng = np.random.default_rng((n, walk))
        for band in range(BANDS):
            for j in np.sort(rng.choice(2 * n, min(SAMPLES, 2 * n), replace=False)).tolist():
                samples[j].append((walk, band))
        factors[:, walk, 0] = rng.integers(1, 2**63, 2 * n, dtype=np.uint64) | _U(1)
    last = max(j for j, met in enumerate(samples) if met)
    return samples[: last + 1], factors


def band_keys(words: np.ndarray, starts: np.ndarray, n: int) -> list[np.ndarray]:
    """For each band, the key of the n-word window at each start: a hash of the sampled symbols of a CGK walk. All walks go in step."""
    samples, factors = _plan(n)
    place, end = np.broadcast_to(starts.astype(np.int64), (WALKS, len(starts))).copy(), starts + n
    keys = [[np.full(len(starts), band + 1, np.uint64) for band in range(BANDS)] for _ in range(WALKS)]
    for j, met in enumerate(samples):
        # a pointer has moved j words at most, so none is past its window before step n
        symbol = words[place] if j < n else np.where(place < end, words[np.minimum(place, end - 1)], _U(0))
        for walk, band in met:
            keys[walk][band] = wordhash.mix(keys[walk][band] * _U(0x9E3779B97F4A7C15) ^ symbol[walk])
        place += ((symbol * factors[j]) >> _U(63)).view(np.int64)
    return [key for own in keys for key in own]


def edit_distance(words: np.ndarray, starts: np.ndarray, items: np.ndarray, n: int, limit: int, missing: np.ndarray | int = 0) -> np.ndarray:
    """Word edits between each window of n - missing words and its n-word item (a row of `items`), or limit + 1 if more."""
    width = 2 * limit + 1
    far = limit + 1
    offset = np.arange(width) - limit
    row = np.where(offset >= 0, offset, far)[None, :].repeat(len(starts), 0)
    # words beyond a shorter window are in columns that its distance doesn't depend on
    window = words[np.minimum(starts[:, None] + np.arange(n), len(words) - 1)]
    for i in range(1, n + 1):
        j = i + offset
        valid = (j >= 0) & (j <= n)
        equal = (window[:, np.clip(j - 1, 0, n - 1)] == items[:, i - 1 : i]) & (j >= 1) & valid
        new = np.minimum(row + ~equal, np.concatenate([row[:, 1:], np.full((len(row), 1), far)], axis=1) + 1)
        new[:, (j < 1) & valid] = i
        new[:, ~valid] = far
        for c in range(1, width):
            new[:, c] = np.minimum(new[:, c], new[:, c - 1] + 1)
        row = np.minimum(new, far)
    return row[np.arange(len(row)), limit - missing]


def walked(index: Index, hashes: np.ndarray, bounds: np.ndarray, q: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item size, starts, rows) of the windows that have as many grams of q words from items of that size as a near one must. Starts before a row's, or too near its end, hang over."""
    grams, sizes = index.grams[q]
    bits = np.zeros(1 << 20, bool)
    bits[(grams & _U((1 << 20) - 1)).astype(np.int64)] = True
    found = wordhash.windows(hashes, q)
    at = np.flatnonzero(bits[(found & _U((1 << 20) - 1)).astype(np.int64)])
    row = np.searchsorted(bounds, at, "right") - 1
    at, row = at[at + q <= bounds[row + 1]], row[at + q <= bounds[row + 1]]
    low = np.searchsorted(grams, found[at], "left")
    many = np.searchsorted(grams, found[at], "right") - low
    # a row for each shared gram and each size of items that have it, of which there are few
    which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at, row, size = np.repeat(at, many), np.repeat(row, many), sizes[which]
    if not len(at):
        return
    order = np.argsort(size, kind="stable")
    each, begins = np.unique(size[order], return_index=True)
    for n, own in zip(each.tolist(), np.split(order, begins[1:]), strict=True):
        k = allowed(n)
        needed = max(1, n - q + 1 - k * q)
        if len(own) < needed:
            continue
        first, last, of = at[own][: len(own) - needed + 1], at[own][needed - 1 :], row[own][: len(own) - needed + 1]
        together = (row[own][needed - 1 :] == of) & (last - first <= n - q)
        first, last, of = first[together], last[together], of[together]
        # starts of windows that hold all `needed` of these grams, and miss k words at most
        begin, end = np.maximum(last + q - n, bounds[of] - k), np.minimum(first, bounds[of + 1] - n + k)
        begin, end, of = begin[begin <= end], end[begin <= end], of[begin <= end]
        if not len(of):
            continue
        # ends are in order within a row, so each run begins after the one before
        begin = np.concatenate([begin[:1], np.where(of[1:] == of[:-1], np.maximum(begin[1:], end[:-1] + 1), begin[1:])])
        length = np.maximum(end - begin + 1, 0)
        starts = np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        yield n, starts, np.repeat(of, length)


def _missing(starts: np.ndarray, rows: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(bounds[rows] - starts, 0) + np.maximum(starts + n - bounds[rows + 1], 0)


def proposed(index: Index, hashes: np.ndarray, bounds: np.ndarray, starts: np.ndarray, rows: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, rows, items) of the windows of n words that meet an item in some band of a walk."""
    step = max(1, AT_ONCE // n)
    for i in range(0, len(starts), step):
        at, row = starts[i : i + step], rows[i : i + step]
        over = _missing(at, row, bounds, n) > 0
        for own in (np.flatnonzero(~over), np.flatnonzero(over)):
            if not len(own):
                continue
            if over[own[0]]:
                place = at[own][:, None] + np.arange(n)
                inside = (place >= bounds[row[own]][:, None]) & (place < bounds[row[own] + 1][:, None])
                walk = band_keys(np.where(inside, hashes[np.clip(place, 0, len(hashes) - 1)], _U(0)).ravel(), np.arange(len(own)) * n, n)
            else:
                walk = band_keys(hashes, at[own], n)
            window, item = met_items(index, walk, n)
            yield at[own][window], row[own][window], item


def _measured(index: Index, hashes: np.ndarray, bounds: np.ndarray, starts: np.ndarray, rows: np.ndarray, items: np.ndarray, n: int, limit: int) -> np.ndarray:
    missing, out = _missing(starts, rows, bounds, n), []
    step = max(1, AT_ONCE // (n + 2 * limit + 1))
    for i in range(0, len(starts), step):
        s = slice(i, i + step)
        out.append(edit_distance(hashes, np.maximum(starts[s], bounds[rows[s]]), np.stack([index.tokens[x] for x in items[s]]), n, limit, missing[s]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def matches(index: Index, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, items, distances, words) of the verified windows."""
    for q in index.grams:
        for n, all_starts, all_rows in walked(index, hashes, bounds, q):
            k = allowed(n)
            for starts, rows, items in proposed(index, hashes, bounds, all_starts, all_rows, n):
                # a window some words beside a near one is at twice its edits at most
                close = _measured(index, hashes, bounds, starts, rows, items, n, min(2 * k, n)) <= min(2 * k, n)
                beside = np.arange(-k, k + 1)
                around = np.stack([x.ravel() for x in np.broadcast_arrays(starts[close][:, None] + beside, rows[close][:, None], items[close][:, None])])
                at, row, item = np.unique(around, axis=1)
                missing = _missing(at, row, bounds, n)
                at, row, item = at[missing <= k], row[missing <= k], item[missing <= k]
                distance = _measured(index, hashes, bounds, at, row, item, n, k)
                near = distance <= k
                yield np.maximum(at, bounds[row])[near], item[near], distance[near], n - _missing(at, row, bounds, n)[near]


def met_items(index: Index, keys: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) for each window whose key is that of an n-word item in some band."""
    pairs = [np.zeros(0, np.int64)]
    for (own, items), key in zip(index.tables[n], keys, strict=True):
        low = np.searchsorted(own, key, "left")
        many = np.searchsorted(own, key, "right") - low
        which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs.append(np.repeat(np.arange(len(key)), many) * len(index.ids) + items[which])
    met = np.unique(np.concatenate(pairs))
    return met // len(index.ids), met % len(index.ids)


def _match_task(uri: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = opened(uri)
    for batch in batches:
        doc = batch.column(0)
        for base, hashes, bounds in wordhash.chunks(batch.column(1), _SEPARATORS, _FOLD):
            for at, item, distance, n in matches(index, hashes, bounds):
                row = np.searchsorted(bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(row + base)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(at - bounds[row], pa.int64()), pa.array(distance, pa.int32()), pa.array(n, pa.int32())],
                    ["doc_id", "item_id", "start_word", "edits", "n_words"],
                )


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, hashes, bounds in wordhash.chunks(pa.array(texts, pa.string()), _SEPARATORS, _FOLD):
        out += [hashes[a:b].copy() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def index_blocks(benchmark: DataFrame) -> list[str]:
    """The items in blocks that a task can hold, each an index file in the shared folder: their URIs. Items without words are left out.

    Tasks make the indexes, one of a block each; a task that runs again writes a
    file of another name, and only the files of finished tasks are listed.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    items = cut(items, "benchmark-items")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not n:
        return []
    many, folder = max(-(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES)), shared_dir(benchmark.sparkSession)

    def build(group: pa.Table) -> pa.Table:
        found = [(i, w) for i, w in zip(group.column("item_id").to_pylist(), item_words(group.column("text").to_pylist()), strict=True) if len(w)]
        uris = [f"{folder}/benchmark-index-{uuid.uuid4().hex}"] if found else []
        for uri in uris:
            files, path = open_uri(uri)
            with files.open_output_stream(path) as out:
                out.write(Index([i for i, _ in found], [w for _, w in found]).saved())
        return pa.table({"uri": pa.array(uris, pa.string())})

    made = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(many))).groupBy("block").applyInArrow(build, "uri string")
    return [r.uri for r in cut(made, "benchmark-indexes").collect()]  # a row for each block


@lru_cache(maxsize=1)
def opened(uri: str) -> Index:
    """An index file, read once by each Python worker that needs it."""
    files, path = open_uri(uri)
    with files.open_input_stream(path) as source:
        return Index.loaded(source.read())


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, start_word, edits, n_words): for each document and item within the threshold, its nearest window, the first of equals.

    doc_id takes the values of `key`. Null texts have no words; repeated rows
    with one doc_id give one row for each item; rows without an item_id count as one item without a name;
    empty tables give no rows; other columns of either table are ignored.
    """
    schema = "doc_id long, item_id long, start_word long, edits int, n_words int"
    found = None
    for uri in index_blocks(benchmark):
        part = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches, uri=uri: _match_task(uri, batches), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.min(F.struct("edits", "start_word", "n_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.start_word", "best.edits", "best.n_words")


def _clean(uri: str, texts: pa.Array) -> np.ndarray:
    """Which texts have no window near an item of the block."""
    out = np.ones(len(texts), bool)
    for base, hashes, bounds in wordhash.chunks(texts, _SEPARATORS, _FOLD, TEXT_BYTES):
        for at, _, _, n in matches(opened(uri), hashes, bounds):
            # the last word is in the row also where the window hangs over its start
            out[base + np.searchsorted(bounds, at + n - 1, "right") - 1] = False
    return out


def _clean_task(uri: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in wordhash.parts(whole)):
        yield batch.filter(pa.array(_clean(uri, batch.column(batch.schema.get_field_index("text")))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a window near any item, also over an end; the columns and rows of `docs`.

    One narrow stage for a benchmark of one block. For more, each block is a pass that names
    contaminated texts by hash, and the documents are parted from those once.
    """
    uris = index_blocks(benchmark)
    if len(uris) == 1:
        return docs.mapInArrow(lambda batches: _clean_task(uris[0], batches), docs.schema)
    name = {c: scratch_name(docs, c) for c in ("one", "two")}
    marks = {name["one"]: F.xxhash64("text"), name["two"]: F.xxhash64("text", F.octet_length("text"))}
    dirty = None
    for uri in uris:

        def named(batches: Iterator[pa.RecordBatch], uri=uri) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select([1, 2]).filter(pa.array(~_clean(uri, batch.column(0))))

        part = docs.select("text", *(c.alias(n) for n, c in marks.items())).mapInArrow(named, f"`{name['one']}` long, `{name['two']}` long")
        dirty = part if dirty is None else dirty.unionByName(part)
    if dirty is None:
        return docs
    return docs.withColumns(marks).join(cut(dirty.distinct(), "contaminated-texts"), list(name.values()), "left_anti").select(*docs.columns)
