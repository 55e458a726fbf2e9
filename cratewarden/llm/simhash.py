"""SimHash near-dedup by anchor-point covering.

A fingerprint is cut into halves A and B of 32 bits. Two fingerprints at
distance 2 or less differ by (0, up to 2), (up to 2, 0) or (1, 1) in them.

- (1, 1): 31 bits of A carry the perfect Hamming code [31, 26], whose 2**26 code
  words are the anchors; every point lies within the covering radius, 1, of
  exactly one, its home. Fingerprints are replicated to every anchor within
  radius + threshold = 2, at most 16 of them, and one at distance 1 of another
  is replicated to that one's home. B differs by one bit, so one of its two
  16-bit quarters is equal and joins the key.
- (0, *) and (*, 0): one half is equal, which is the code of radius 0: every
  point is its own anchor.

Homes meet replicas in an equi-join on keys of 34 to 48 bits, and a pair is a
link if it differs by 2 bits or less.

Scale. Equal fingerprints are one row before anything is joined, so a group of
copies costs nothing, and a distinct fingerprint has at most 2080 others within
2 bits. 36 narrow rows are shuffled for each distinct fingerprint. Spark plans
broadcasts by the bytes of a file, which an explode doesn't change, so joins are
hinted to merge. Bits are counted in numpy, from 64-bit shingle hashes made in
each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import cut, scratch_name
from .components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are unpacked at once, and counters of shingles that are summed together.
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """The 64-bit SimHash, as a signed number; 0 for texts without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1 :] if len(tokens) >= shingle else ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts.tolist(), last.tolist(), strict=False)), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        counts += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str, *, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and the fingerprint of `text` as `name`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t, shingle) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), made], [*keep, name])

    frame = docs.select(*(F.col(f"`{k}`") for k in keep), "text")
    schema = frame.drop("text").schema.add(name, "long")
    return frame.mapInArrow(task, schema)


def _bit(n: int | Column) -> Column:
    return F.expr("1L") * (1 << n) if isinstance(n, int) else F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _syndrome(half: Column) -> Column:
    """Of 31 bits, the exclusive or of the positions 1 to 31 that are set; 0 for code words."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    parity = [(F.bit_count(half.bitwiseAND(F.lit(m))).cast("int") % 2) * (1 << k) for k, m in enumerate(masks)]
    return sum(parity[1:], parity[0])


def _keys(fp: Column) -> tuple[Column, Column]:
    """The anchor keys of a fingerprint as arrays: (homes, replicas)."""
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    coded = fp.bitwiseAND(F.lit(0x7FFFFFFF))
    syndrome = _syndrome(coded)
    home = F.when(syndrome == 0, coded).otherwise(coded.bitwiseXOR(_bit(syndrome - 1)))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: i.bitwiseXOR(syndrome) > i)
    others = F.transform(pairs, lambda i: coded.bitwiseXOR(_bit(i - 1)).bitwiseXOR(_bit(i.bitwiseXOR(syndrome) - 1)))
    # at distance 0 of its home a point has no second anchor within 2
    anchors = F.concat(F.array(home), F.when(syndrome == 0, F.array().cast("array<bigint>")).otherwise(others))
    quarter = [F.shiftrightunsigned(fp, 32).bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(fp, 48)]
    with_quarter = lambda a: F.array(*(F.shiftleft(a, 17) + q * 2 + k for k, q in enumerate(quarter)))
    equal = [low - (1 << 40), high - (1 << 41)]  # below all other keys, and apart
    return F.concat(with_quarter(home), F.array(*equal)), F.concat(F.flatten(F.transform(anchors, with_quarter)), F.array(*equal))


def linked_fingerprints(fps: DataFrame, distance: int = 2) -> DataFrame:
    """fps (fp), all different -> (a, b), a < b, for each two at `distance` or less, which may be 2 at most."""
    if distance > 2:
        raise ValueError("the anchors cover distances up to 2")
    homes, replicas = _keys(F.col("fp"))
    left = fps.select(F.col("fp").alias("a"), F.explode(homes).alias("key"))
    right = fps.select(F.col("fp").alias("b"), F.explode(replicas).alias("key"))
    # found from either side: one order is enough for the equal halves, and the anchors need both
    met = left.join(right.hint("merge"), "key").filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group_documents(docs: DataFrame, *, shingle: int = 3, distance: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, with doc_id, the fingerprint `fp` and component_id, the smallest doc_id reachable over links.

    Texts without words, null ones too, have fingerprint 0 and are linked like
    any other. A null doc_id is never the smallest unless all of a component
    are null. Repeated rows stay, each in its component.
    """
    rows = cut(with_fingerprint(docs, "fp", shingle=shingle, keep=keep), "simhash-rows")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    fps = cut(fps, "simhash-fingerprints")
    component = connected_components(linked_fingerprints(fps.select("fp"), distance))
    named = fps.join(component.hint("merge"), fps["fp"] == component["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = named.select("fp", "component").join(smallest.hint("merge"), "component").select("fp", "component_id")
    return rows.join(labels.hint("merge"), "fp")


def simhash_report(docs: DataFrame) -> DataFrame:
    return group_documents(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies of 5-word shingles at similarity 0.8 -------------------------------------------------
#
# Two texts of similarity 0.8 differ in about 15 % of SimHash bits, far beyond
# what anchors can cover, and buckets of few bits fill with strangers as the
# input grows. The stage therefore takes BANDS * ROWS smallest hashes of each
# shingle set; a band's key is 64 bits of ROWS of them, which strangers share
# with the chance of their similarity to the power ROWS, whatever the input's
# size. A pair at 0.8 shares a key in some band with chance 0.9999.
#
# Members of a bucket don't meet in all pairs: each meets the bucket's first and
# the one before it, in an order of the bucket's own. A large group of near
# copies thus costs one row for each member. Buckets only spare comparisons: all
# texts in two components then meet by a prefix join on the shingles themselves, rarest
# first, which leaves out no pair at 0.8: the first common shingle of such sets,
# of n and m <= n, is among the first n / 5 + 1 of one and m / 9 + 1 of the other.
# A text thus gives a fifth of its shingles, and those of one text alone go at once.
# Passages that many texts share come last in that order, so texts that share no
# more than that don't meet. Sizes and bits only propose: every link is verified
# on both shingle sets, and texts are one node only if their sets are equal.

BANDS, ROWS = 32, 6
#: Most differing bits of BANDS * ROWS, one from each smallest hash, for a candidate: at similarity 0.8 the mean is 19.2 and the deviation 4.2.
MOST_BITS = 44
#: Members of a bucket that are put in order together; larger buckets are parted, and tied by their first.
BUCKET = 4096
#: Bits of the counters by which shingles are ordered, 4 MB in all.
COUNTERS = 20

_FOLD = np.frombuffer(_LOWER, np.uint8)
_FACTORS = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = BANDS * ROWS // 64
#: Shingles that are multiplied by all factors at once, and bytes of text that are hashed at once.
_STEP, _BYTES = 512, 1 << 18


def _shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The hashes of each text's set of shingles, sorted."""
    words = (hashes[a:b] for _, hashes, bounds in wordhash.chunks(texts, fold=_FOLD, size=_BYTES) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    return [np.unique(wordhash.windows(w, min(shingle, len(w)))) if len(w) else np.zeros(0, np.uint64) for w in words]


def _smallest(made: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each factor."""
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(made), _STEP):
        np.minimum(out, (made[at : at + _STEP, None] * _FACTORS).min(axis=0), out=out)
    return out


def _set_task(shingle: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in wordhash.parts(whole)):
        texts = batch.column(batch.schema.get_field_index("text"))
        sets = _shingle_sets(texts, shingle)
        least = wordhash.mix(np.array([_smallest(s) for s in sets], np.uint64).reshape(len(sets), BANDS * ROWS))
        signs = np.packbits((least & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(sets), 0)
        for k in range(ROWS):
            key = wordhash.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ least[:, k::ROWS])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (signs, key.view(np.int64))]
        digests, sizes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, digests, sizes, *lists], [*batch.schema.names, *names])


def with_shingle_set(docs: DataFrame, digest: str, size: str, bits: str, keys: str, shingle: int) -> DataFrame:
    """`docs` with the `digest` (128 bits) and `size` of its shingle set, `bits` (longs) and `keys` of its smallest hashes."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*docs.schema, T.StructField(digest, T.BinaryType()), T.StructField(size, T.LongType()), T.StructField(bits, longs), T.StructField(keys, longs)])
    return docs.mapInArrow(lambda batches: _set_task(shingle, [digest, size, bits, keys], batches), schema)


def shingle_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the texts (node, text) whose node is in `wanted`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [s.view(np.int64) for s in _shingle_sets(part.column(1), shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], ["node", "shingles"])

    return cut(texts.join(wanted.select("node").hint("merge"), "node", "left_semi").select("node", "text").mapInArrow(task, "node long, shingles array<long>"), "near-sets")


def verified(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) whose shingle sets (node, shingles) are at similarity 0.8 or more."""
    pairs = links
    for node, side in (("a", "left"), ("b", "right")):
        pairs = pairs.join(sets.withColumnsRenamed({"node": node, "shingles": side}).hint("merge"), node)
    # of sets of m and n, s in both: s / (m + n - s) >= 4 / 5
    return pairs.filter(F.size(F.array_intersect("left", "right")) * 9 >= (F.size("left") + F.size("right")) * 4).select("a", "b")


def _maybe_near(met: DataFrame, fps: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sizes and bits allow similarity 0.8."""
    for node, side in (("a", "x"), ("b", "y")):
        met = met.join(fps.select(F.col("node").alias(node), F.col("size").alias(f"{side}size"), F.col("bits").alias(f"{side}bits")).hint("merge"), node)
    differing = [F.bit_count(F.col("xbits")[k].bitwiseXOR(F.col("ybits")[k])) for k in range(_WORDS)]
    sizes = F.least("xsize", "ysize") * 5 >= F.greatest("xsize", "ysize") * 4
    return met.filter(sizes & (sum(differing[1:], differing[0]) <= MOST_BITS)).select("a", "b")


Sets = Callable[[pa.RecordBatch], Iterator[tuple[pa.Array, list[np.ndarray]]]]


def _made(shingle: int) -> Sets:
    """The nodes and shingle sets of a batch (node, text), by parts."""
    return lambda batch: ((part.column(0), _shingle_sets(part.column(1), shingle)) for part in wordhash.parts(batch))


def _held(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """The nodes and shingle sets of a batch (node, shingles)."""
    yield batch.column(0), [made.values.to_numpy(zero_copy_only=False).view(np.uint64) for made in batch.column(1)]


def _shingle_counts(rows: DataFrame, sets: Sets) -> np.ndarray:
    """How many shingles fall on each of 2 ** COUNTERS counters."""
    shift = np.uint64(64 - COUNTERS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for _, made in sets(batch):
                at = np.concatenate([np.zeros(0, np.uint64), *made]) >> shift
                counts += np.bincount(at.astype(np.int64), minlength=len(counts))
        blocks = counts.reshape(-1, _BLOCK)
        held = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(list(blocks[held]), pa.list_(pa.int64()))], ["at", "n"])

    def total(tasks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = 0, np.zeros(_BLOCK, np.int64)
        for batch in tasks:
            at = batch.column(0)[0].as_py()
            counts += batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, _BLOCK).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([counts], pa.list_(pa.int64()))], ["at", "n"])

    schema = "at long, n array<long>"
    found = rows.mapInArrow(task, schema).groupBy("at").applyInArrow(total, schema).toArrow()  # 2 ** COUNTERS numbers at most
    counts = np.zeros(1 << COUNTERS, np.uint32)
    for at, held in zip(found.column("at").to_pylist(), found.column("n"), strict=True):
        counts[at * _BLOCK : (at + 1) * _BLOCK] = np.minimum(held.values.to_numpy(zero_copy_only=False), 2**32 - 1)
    return counts


def prefixes(rows: DataFrame, sets: Sets) -> DataFrame:
    """(token, node, size, place): of each node the rarest shingles of its set in order, as many as one that it is near has in common with it at least, if others have them too."""
    counts = rows.sparkSession.sparkContext.broadcast(_shingle_counts(rows, sets))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - COUNTERS)
        for batch in batches:
            for nodes, made in sets(batch):
                sizes = np.array([len(s) for s in made], np.int64)
                probes = np.minimum(sizes, sizes - -(-4 * sizes // 5) + 1)
                tokens = [s[np.lexsort((s, counts.value[s >> shift]))[:n]] for s, n in zip(made, probes.tolist(), strict=True)]
                place = np.arange(1, probes.sum() + 1) - np.repeat(np.cumsum(probes) - probes, probes)
                same = [pa.array(np.repeat(v, probes)) for v in (nodes.to_numpy(zero_copy_only=False), sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64)), *same, pa.array(place)], ["token", "node", "size", "place"])

    found = rows.mapInArrow(task, "token long, node long, size long, place long")
    return found.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("many > 1").drop("many")


def met_in_prefixes(rows: DataFrame) -> DataFrame:
    """rows (token, node, size, place, component) -> (a, b): pairs of different components that may be near.

    Rows of a shingle's most frequent component meet those of others only, so one
    large group costs nothing. Pairs inside a less frequent component are
    compared and left out, so the work grows with the square of a second one.
    """
    rows = cut(rows.withColumn("indexed", F.expr("place <= size - (8 * size + 8) div 9 + 1")), "near-prefixes")
    parts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max_by("component", "n").alias("most"), F.count(F.lit(1)).alias("parts"))
    rows = cut(rows.join(parts.filter("parts > 1").drop("parts").hint("merge"), "token").withColumn("other", F.col("component") != F.col("most")).drop("most"), "near-prefixes")
    left = rows.withColumn("turn", F.when(F.col("other"), 0).otherwise(1)).alias("x")
    right = rows.filter("indexed").withColumn("turn", F.explode(F.when(F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).alias("y")
    met = left.join(right.hint("merge"), ["token", "turn"]).filter(
        "x.component <> y.component and (x.size > y.size or (x.size = y.size and x.node > y.node)) and y.size * 5 >= x.size * 4"
        " and (least(x.size - x.place, y.size - y.place) + 1) * 9 >= (x.size + y.size) * 4"
    )
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """sets (node, component, shingles) -> (a, b): pairs of different components, among them all at similarity 0.8 or more."""
    return met_in_prefixes(prefixes(sets.select("node", "shingles"), _held).join(sets.select("node", "component").hint("merge"), "node"))


def near_links(fps: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """fps (node, size, bits, keys), sets all different, and their texts (node, text) -> (a, b): verified links that join all which are near."""
    points = fps.select("node", F.explode("keys").alias("key"))
    turned = F.col("node").bitwiseXOR(F.xxhash64("key"))  # the bucket's own order
    buckets = points.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(turned).alias("first")).filter("many > 1")
    points = points.join(buckets.hint("merge"), "key").withColumn("first", F.col("first").bitwiseXOR(F.xxhash64("key")))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / BUCKET))
    before = F.lag("node").over(Window.partitionBy("key", "part").orderBy("turned"))
    met = points.withColumns({"part": part, "turned": turned}).withColumn("before", before).select("node", F.explode(F.array("first", "before")).alias("other")).filter("other is not null and node <> other")
    met = cut(_maybe_near(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), fps), "near-met")
    sets = shingle_sets(texts, met.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle)
    links = cut(verified(met, sets), "near-links")
    # what is near and in two components still has to meet, whether it shares a bucket or not
    placed = fps.select("node").join(connected_components(links).hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = met_in_prefixes(prefixes(texts.select("node", "text"), _made(shingle)).join(placed.hint("merge"), "node"))
    rest = cut(rest.join(met.hint("merge"), ["a", "b"], "left_anti"), "near-rest")
    sets = shingle_sets(texts, rest.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle)
    return links.unionByName(cut(verified(rest, sets), "near-links"))


def drop_near_copies(docs: DataFrame, *, shingle: int = 5) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest doc_id; the columns of `docs`.

    Texts without words are one group. Repeated rows are copies; of equal
    doc_ids any one row stays, and a null doc_id only if it is alone.
    """
    digest, size, bits, keys, row = (scratch_name(docs, k) for k in ("digest", "size", "bits", "keys", "row"))
    rows = cut(with_shingle_set(docs, digest, size, bits, keys, shingle).withColumn(row, F.monotonically_increasing_id()), "near-rows")
    order = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.col(row).alias("row"))
    fps = rows.groupBy(digest).agg(F.min(order).alias("first"), *(F.first(c).alias(name) for c, name in ((size, "size"), (bits, "bits"), (keys, "keys")))).withColumn("node", F.col("first.row"))
    fps = cut(fps, "near-fingerprints")
    texts = rows.select(F.col(row).alias("node"), "text")
    component = connected_components(near_links(fps, texts, shingle))
    named = fps.select("node", "first").join(component.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    stay = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return rows.join(stay.hint("merge"), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
