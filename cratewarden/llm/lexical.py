"""Ranked lexical search, term-at-a-time over short lists and document-at-a-time over long ones.

Documents stay where they are: each task makes postings of its own documents,
for terms that some item asks for, and holds them a block at a time. In a block
the short lists of an item are summed first, term at a time, into accumulators.
These then stand among the long lists as one more iterator, whose bound is the
largest sum. Iterators are ordered by bound; those whose bounds together stay
under the score of the tenth document so far name no candidates, and are looked up
only for candidates that may still reach it. A bound that equals that score isn't
under it, so ties are kept for their order by doc_id. The ten best of a task go
on to the next block, so bounds cut more with each.

Scale. Two narrow passes over the documents for each block of items, one for the
statistics and one for the ranking. Items are taken in blocks of about
BLOCK_PAIRS (item, term) pairs, which is the bound of what is broadcast: some 50
MB. A task sends on ten rows an item; they are cut down in two steps, by item
and a hash of doc_id, then by item, so that no task gets the rows of all others.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .common import cut
from .decontaminate import _FOLD, _SEPARATORS

TOP = 10
#: (item, term) pairs in a block of items, about.
BLOCK_PAIRS = 1 << 20
#: Postings, and documents, that a task holds at once.
POSTINGS, DOCUMENTS = 1 << 20, 1 << 16
#: Documents between two looks at the score to reach.
SPAN = 4096
#: A list is short up to this share of the item's longest, or up to so many documents.
SHORT_SHARE, SHORT = 1 / 16, 32
SALT = 64


@dataclass
class Queries:
    """A block of items over a sorted vocabulary: item i asks for terms[asks[starts[i]:starts[i + 1]]]."""

    ids: list[int | None]
    terms: np.ndarray
    asks: np.ndarray
    starts: np.ndarray
    weights: np.ndarray | None = None
    documents: int = 0
    words: int = 0
    bits: np.ndarray = field(init=False)

    def __post_init__(self):
        self.bits = np.zeros(1 << max(16, len(self.terms).bit_length() + 4), bool)
        self.bits[(self.terms & np.uint64(len(self.bits) - 1)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in `hashes`, numbers of the terms there)."""
        at = np.flatnonzero(self.bits[(hashes & np.uint64(len(self.bits) - 1)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        same = self.terms[term] == hashes[at]
        return at[same], term[same]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, hashes, bounds in wordhash.chunks(batch.column(1), _SEPARATORS, _FOLD):
            rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + base
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(hashes.view(np.int64))], ["item_id", "term"])


def query_blocks(items: DataFrame, block_pairs: int = BLOCK_PAIRS) -> Iterator[Queries]:
    """The items with their distinct terms, block by block; rows with one item_id are one item."""
    pairs = cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, term long").distinct(), "item-terms")
    many = max(1, -(-pairs.count() // block_pairs))
    for block in range(many):
        found = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(many)) == block).toArrow()
        if not len(found):
            continue
        known = found.column("item_id").is_valid().to_numpy()
        item, term = found.column("item_id").fill_null(0).to_numpy(), found.column("term").to_numpy().view(np.uint64)
        order = np.lexsort((term, item, ~known))
        known, item, term = known[order], item[order], term[order]
        first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (known[1:] != known[:-1])]))
        terms, asks = np.unique(term, return_inverse=True)
        yield Queries([int(item[i]) if known[i] else None for i in first], terms, asks, np.append(first, len(item)))


def _statistics_task(queries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) for each term held by n documents of the task; term -1 counts documents with any term, -2 all their terms."""
    q: Queries = queries.value
    many, documents, words = len(q.terms), 0, 0
    held = np.zeros(many, np.int64)
    for batch in batches:
        for _, hashes, bounds in wordhash.chunks(batch.column(0), _SEPARATORS, _FOLD):
            documents += int(np.count_nonzero(np.diff(bounds)))
            words += len(hashes)
            at, term = q.hits(hashes)
            row = np.searchsorted(bounds, at, "right") - 1
            term, n = np.unique(np.unique(row * many + term) % many, return_counts=True)
            held[term] += n
    used = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2]).astype(np.int32)), pa.array(np.append(held[used], [documents, words]))], ["term", "n"])


def with_statistics(docs: DataFrame, queries: Queries) -> Queries:
    """The block with N, L and the weights of its terms, from all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)
    rows = docs.select("text").mapInArrow(lambda batches: _statistics_task(shared, batches), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    found = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist(), strict=True))
    documents, words = found.get(-1, 0), found.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(queries.terms))], np.int64)
    return Queries(queries.ids, queries.terms, queries.asks, queries.starts, weights, documents, words)


@dataclass
class Best:
    """The best documents of an item so far, in order: score, then doc_id, a missing one last."""

    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def reach(self, k: int) -> int:
        """The score that a document needs at least."""
        return int(self.score[k - 1]) if len(self.score) >= k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray, k: int) -> None:
        score, doc, known = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.known, known])
        order = np.lexsort((doc, ~known, -score))[:k]
        self.score, self.doc, self.known = score[order], doc[order], known[order]


@dataclass
class Postings:
    """A block of documents: for each term that occurs, the documents in order and what the term adds to their scores."""

    doc_ids: np.ndarray
    known: np.ndarray
    slot: np.ndarray  # by term: its list, or -1
    starts: np.ndarray
    docs: np.ndarray
    adds: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, q: Queries, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray) -> Postings:
        key, tf = np.unique(term * len(doc_ids) + doc, return_counts=True)
        term, doc = np.divmod(key, len(doc_ids))
        m = 10 + (90 * lengths * q.documents) // max(q.words, 1)
        adds = q.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        present, starts = np.unique(term, return_index=True)
        slot = np.full(len(q.terms), -1)
        slot[present] = np.arange(len(present))
        return cls(doc_ids, known, slot, np.append(starts, len(term)), doc, adds, np.maximum.reduceat(adds, starts) if len(starts) else adds)

    def search(self, terms: np.ndarray, best: Best, k: int) -> None:
        """Add what this block has for an item to its best documents."""
        lists = self.slot[terms]
        lists = lists[lists >= 0]
        if not len(lists) or int(self.bounds[lists].sum()) < best.reach(k):
            return
        size = self.starts[lists + 1] - self.starts[lists]
        short = size <= max(SHORT, size.max() * SHORT_SHARE)
        iterators = [(self.docs[a:b], self.adds[a:b], int(self.bounds[x])) for x, a, b in ((x, self.starts[x], self.starts[x + 1]) for x in lists[~short])]
        if short.any():
            docs, sums = _added([self.docs[self.starts[x] : self.starts[x + 1]] for x in lists[short]], [self.adds[self.starts[x] : self.starts[x + 1]] for x in lists[short]])
            iterators.append((docs, sums, int(sums.max())))
        iterators.sort(key=lambda i: -i[2])
        rest = np.append(np.cumsum([i[2] for i in iterators][::-1])[::-1], 0)
        for begin in range(0, len(self.doc_ids), SPAN):
            reach = best.reach(k)
            naming = int(np.count_nonzero(rest >= reach))
            if not naming:
                return
            part = [slice(*np.searchsorted(docs, (begin, begin + SPAN))) for docs, _, _ in iterators[:naming]]
            docs, sums = _added([i[0][s] for i, s in zip(iterators, part, strict=False)], [i[1][s] for i, s in zip(iterators, part, strict=False)])
            for (own, adds, _), still in zip(iterators[naming:], rest[naming:], strict=False):
                may = sums + still >= reach
                docs, sums = docs[may], sums[may]
                at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                sums = sums + np.where(own[at] == docs, adds[at], 0)
            good = sums >= reach
            if good.any():
                best.add(sums[good], self.doc_ids[docs[good]], self.known[docs[good]], k)


def _added(docs: list[np.ndarray], adds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents of several lists, and the sum for each."""
    found, place = np.unique(np.concatenate(docs), return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, place, np.concatenate(adds))
    return found, sums


def _blocks(q: Queries, batches: Iterator[pa.RecordBatch]) -> Iterator[Postings]:
    held: list[tuple[np.ndarray, ...]] = []
    postings = documents = 0

    def block() -> Postings:
        ids, known, lengths, term, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        return Postings.of(q, ids, known, lengths, term, doc)

    for batch in batches:
        known, ids = batch.column(0).is_valid().to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy()
        for base, hashes, bounds in wordhash.chunks(batch.column(1), _SEPARATORS, _FOLD):
            rows = slice(base, base + len(bounds) - 1)
            at, term = q.hits(hashes)
            used = q.weights[term] > 0
            at, term = at[used], term[used]
            held.append((ids[rows], known[rows], np.diff(bounds), term, np.searchsorted(bounds, at, "right") - 1 + documents))
            postings, documents = postings + len(at), documents + len(bounds) - 1
            if postings >= POSTINGS or documents >= DOCUMENTS:
                yield block()
                held, postings, documents = [], 0, 0
    if held:
        yield block()


def _rank_task(queries, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    q: Queries = queries.value
    best = [Best() for _ in q.ids]
    for block in _blocks(q, batches):
        for i, found in enumerate(best):
            block.search(q.asks[q.starts[i] : q.starts[i + 1]], found, k)
    item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
    if len(item):
        doc, known, score = (np.concatenate([getattr(b, x) for b in best]) for x in ("doc", "known", "score"))
        yield pa.RecordBatch.from_arrays([pa.array([q.ids[i] for i in item], pa.int64()), pa.array(doc, mask=~known), pa.array(score)], ["item_id", "doc_id", "score"])


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> (item_id, rank, doc_id, score): the k best documents of each item, scores above 0.

    Null texts have no terms; items without terms, or whose terms no document
    has, give no rows. Rows with one item_id are one item, with the terms of all
    of them; a missing item_id is one more item. Each row of `docs` is a document
    of its own, also where a doc_id comes again; a missing doc_id is last of
    equal scores. Other columns are ignored; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in query_blocks(items, block_pairs):
        shared = docs.sparkSession.sparkContext.broadcast(with_statistics(docs, block))
        found = docs.mapInArrow(lambda batches, shared=shared: _rank_task(shared, k, batches), "item_id long, doc_id long, score long")
        out = out.unionByName(found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = out.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALT)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
