"""Vector codes: product quantisation whose nearest entries are found in a geometric near-neighbour access tree (GNAT).

A vector is cut into PARTS parts, each named by the nearest of ENTRIES entries of its
position's codebook. The codebooks begin as the parts of the first vectors and
are refined in ROUNDS rounds: assign, then take the floor of each entry's mean.

The tree of a codebook has split points, far from each other; every other entry
goes below its nearest one, and a split point stores, for each child, the least
and greatest distance to the entries there. A query holds its best distance so far. Its
distance to a split point rules out each child whose range lies farther off than
that, strictly, and by a margin over the error of square roots, so a child with an entry
that ties is always entered. Entries are compared as integers: squared distance,
then index.

Scale. All components are integers, so sums don't depend on the order of rows.
The vectors are read once a round and once more for the codes, each in a narrow
stage that sends on sums (ENTRIES rows a part position and task), never vectors.
Codebooks, ENTRIES vectors in all, are what passes through the driver. Codes are written once; their
errors are summed by label and joined back with a salt, so a label that holds
most rows is spread over SALT tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, LARGEST = 256, 1 << 24
#: Split points of a node; a node of so many entries or fewer is a leaf.
SPLITS = 6
#: More than the error of two square roots of squared distances below 2 ** 53, relative and absolute.
MARGIN = 1e-9
SALT = 32
#: Vectors searched for at once.
ROWS = 1 << 14


def squared(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = points - point
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Node:
    """entries: split points, or all entries of a leaf. low, high: by split point and child, the distances to what lies there."""

    entries: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: list[Node | None] = field(default_factory=list)


def grow(book: np.ndarray, entries: np.ndarray) -> Node:
    """The tree over these entries of a codebook."""
    if len(entries) <= SPLITS:
        return Node(entries)
    chosen = [0]
    away = squared(book[entries], book[entries[0]])
    for _ in range(SPLITS - 1):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, squared(book[entries], book[entries[chosen[-1]]]))
    chosen = sorted(set(chosen))
    splits, others = entries[chosen], np.delete(entries, chosen)
    far = np.sqrt(np.stack([squared(book[others], book[s]) for s in splits]).astype(float))
    nearest = far.argmin(axis=0)
    between = np.sqrt(np.stack([squared(book[splits], book[s]) for s in splits]).astype(float))
    low, high, children = between.copy(), between.copy(), []
    for j in range(len(splits)):
        own = nearest == j
        if own.any():
            low[:, j], high[:, j] = np.minimum(low[:, j], far[:, own].min(axis=1)), np.maximum(high[:, j], far[:, own].max(axis=1))
        children.append(grow(book, others[own]) if own.any() else None)
    return Node(splits, low, high, children)


def nearest(book: np.ndarray, tree: Node, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the entry nearest to each query, the lower index of equals; and how many distances that took."""
    best, found, work = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(book)), 0

    def compare(rows: np.ndarray, entry: int) -> np.ndarray:
        nonlocal work
        work += len(rows)
        d = squared(queries[rows], book[entry])
        better = (d < best[rows]) | ((d == best[rows]) & (entry < found[rows]))
        best[rows[better]], found[rows[better]] = d[better], entry
        return np.sqrt(d.astype(float))

    def visit(node: Node, rows: np.ndarray) -> None:
        if node.low is None:
            for entry in node.entries:
                compare(rows, entry)
            return
        alive = np.ones((len(rows), len(node.entries)), bool)
        for i, entry in enumerate(node.entries):
            own = np.flatnonzero(alive[:, i])
            d = compare(rows[own], entry)[:, None]
            reach = np.sqrt(best[rows[own]].astype(float))[:, None]
            slack = MARGIN * (1 + d + reach)
            alive[own] &= (d - reach <= node.high[i] * (1 + MARGIN) + slack) & (d + reach >= node.low[i] * (1 - MARGIN) - slack)
        for j, child in enumerate(node.children):
            if child is not None and len(own := rows[alive[:, j]]):
                visit(child, own)

    if len(queries):
        visit(tree, np.arange(len(queries)))
    return found, best, work


def part_bounds(size: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its end: equal parts, or as equal as can be."""
    return [j * size // parts for j in range(parts + 1)]


def _integers(column: pa.Array, size: int) -> np.ndarray:
    values = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), size)
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64)


def _assigned(books: list[np.ndarray], size: int, column: pa.Array) -> Iterator[tuple[slice, list[np.ndarray], list[np.ndarray], list[np.ndarray]]]:
    """For runs of rows: the rows, and by part position the parts, their nearest entries and squared distances."""
    bounds = part_bounds(size, len(books))
    trees = [grow(book, np.arange(len(book))) for book in books]
    for at in range(0, len(column), ROWS):
        vectors = _integers(column.slice(at, ROWS), size)
        parts = [vectors[:, a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        found = [nearest(book, tree, part) for book, tree, part in zip(books, trees, parts, strict=True)]
        yield slice(at, at + len(vectors)), parts, [f[0] for f in found], [f[1] for f in found]


def _sums_task(books: list[np.ndarray], size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, entry, position, total) of the vectors of a task; position -1 counts them."""
    totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    for batch in batches:
        for _, parts, found, _ in _assigned(books, size, batch.column(0)):
            for total, part, entry in zip(totals, parts, found, strict=True):
                np.add.at(total, entry, np.concatenate([np.ones((len(part), 1), np.int64), part], axis=1))
    used = [(p, *np.nonzero(total[:, :1].astype(bool) & np.ones(total.shape, bool))) for p, total in enumerate(totals)]
    columns = [np.concatenate(x) for x in zip(*[(np.full(len(e), p), e, at - 1, totals[p][e, at]) for p, e, at in used], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "position", "total"])


def refine(kept: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The codebooks after one round over all vectors."""
    sums = kept.select("vector").mapInArrow(lambda batches: _sums_task(books, size, batches), "part long, entry long, position long, total long")
    rows = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).toArrow()
    part, entry, position, total = (rows.column(c).to_numpy() for c in ("part", "entry", "position", "total"))
    out = []
    for p, book in enumerate(books):
        table = np.zeros((len(book), book.shape[1] + 1), np.int64)
        own = part == p
        table[entry[own], position[own] + 1] = total[own]
        count = table[:, :1]
        out.append(np.where(count > 0, table[:, 1:] // np.maximum(count, 1), book))
    return out


def _codes_task(books: list[np.ndarray], size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, _, found, distance in _assigned(books, size, batch.column(2)):
            digits = np.stack(found, axis=1).astype(np.uint8)
            width = 2 * digits.shape[1]
            text = digits.tobytes().hex()
            code = pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string())
            own = batch.slice(rows.start, rows.stop - rows.start)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), code, pa.array(np.sum(distance, axis=0))], ["vec_id", "label", "code", "error"])


def book_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def _finite(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, number), F.lit(False))


def encode_vectors(embeddings: DataFrame, *, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """embeddings (vec_id, <vector>, label) -> (vec_id, label, code, error) of each kept vector, and the codebooks.

    Vectors that are null or hold a null or non-finite component are dropped, and
    those of another length than the first: the one of the smallest vec_id, a
    missing one last, then the smaller components. Components are held to 2 ** 24 / 256 on
    either side, so squared distances fit into 53 bits. Repeated rows each have a row; fewer
    vectors than entries make smaller codebooks; an empty table has no rows and
    no codebooks. A vector of a length that `parts` doesn't divide is cut as
    equally as can be. Entries number 256 at most. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: from 1 to 256 entries")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(f"`{vector}`").cast("array<double>").alias("vector")).filter(_finite(F.col("vector")))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector").asc()]
    first = rows.orderBy(*order).limit(1).collect()
    size = len(first[0].vector) if first else 0
    kept = rows.filter(F.size("vector") == size)
    begin = kept.orderBy(*order).select("vector").limit(entries).toArrow().column("vector").combine_chunks()
    bounds = part_bounds(size, parts)
    vectors = _integers(begin, size)
    books = [np.ascontiguousarray(vectors[:, a:b]) for a, b in zip(bounds, bounds[1:], strict=False)] if first else []
    for _ in range(rounds if first else 0):
        books = refine(kept, books, size)
    label = kept.schema["label"].dataType.simpleString()
    coded = kept.select("vec_id", "label", "vector").mapInArrow(lambda batches: _codes_task(books, size, batches), f"vec_id long, label {label}, code string, error long")
    return (cut(coded, "codes") if first else coded.limit(0)), books


def code_report(embeddings: DataFrame) -> DataFrame:
    """Codes and errors, each with the error of all vectors of its label, and the digest of the codebooks."""
    coded, books = encode_vectors(embeddings)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumnRenamed("label", "own")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    joined = salted.join(by_label, salted["label"].eqNullSafe(by_label["own"]) & (salted["salt"] == by_label["salt"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
