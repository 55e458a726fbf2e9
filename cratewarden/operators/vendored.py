"""Libraries inside packages: winnowed fingerprints in an inverted index, containment, and what the SBOM says to it.

A file is read without white space and case, so reformatting doesn't matter. Of each
run of WINDOW grams of GRAM characters the least hash is kept: two files that share
GRAM + WINDOW - 1 characters in a row share a fingerprint, and a text keeps some 2 / (WINDOW + 1)
of its grams. A fingerprint that more than `most` known libraries have is of none
of them (license headers, boilerplate): containment is the share of a library's own, distinctive
fingerprints that a package has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

GRAM, WINDOW = 24, 16
MOST, LEAST_SHARE, LEAST_PRINTS = 20, 0.3, 5
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def winnowed(text: bytes) -> np.ndarray:
    """The distinct fingerprints of a text; none if it has fewer than GRAM characters other than space."""
    data = np.frombuffer(text, np.uint8)
    data = _LOWER[data[~_SPACE[data]]].astype(np.uint64)
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    hashes = np.zeros(len(data) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        hashes = hashes * np.uint64(_BASE) + data[k : len(data) - GRAM + 1 + k] + np.uint64(1)
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    least, span = hashes, min(WINDOW, len(hashes))
    return np.unique(np.lib.stride_tricks.sliding_window_view(least, span).min(axis=1))


def _numbered(names: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(<key>, <key>_id) of the distinct names, and the salt of the hash that numbers them, under which no two have one number."""
    names, salt = cut(names.filter(F.col(key).isNotNull()).select(key).distinct(), "vendored-names"), 0
    while True:
        numbered = names.withColumn(f"{key}_id", F.xxhash64(key, F.lit(salt)))
        if numbered.groupBy(f"{key}_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return numbered, salt
        salt += 1


def _prints(files: DataFrame, key: str, salt: int) -> DataFrame:
    """files (<key>, content) -> (<key>_id, h): the distinct fingerprints of all files of a key, dealt by h. Files without content or key have none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [winnowed(t.as_py()).view(np.int64) for t in part.column(1)]
                own = np.repeat(np.asarray(part.column(0)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(found))], [f"{key}_id", "h"])

    rows = files.filter(F.col(key).isNotNull() & F.col("content").isNotNull()).select(F.xxhash64(key, F.lit(salt)).alias("id"), F.col("content").cast("binary").alias("content"))
    # what is dealt by h is dealt by (id, h), too: rows are shuffled once for this, for the holders and for the join
    return rows.mapInArrow(task, f"{key}_id long, h long").repartition("h").distinct()


def _own(libraries: DataFrame, salt: int, most: int) -> DataFrame:
    """(library_id, h): the distinctive fingerprints of each library."""
    rows = _prints(libraries, "library", salt)
    few = rows.groupBy("h").agg(F.count(F.lit(1)).alias("holders")).filter(F.col("holders") <= most).select("h")
    return rows.join(few.hint("merge"), "h", "left_semi")


def _shared(files: DataFrame, salt: int, own: DataFrame) -> DataFrame:
    """(package_id_id, library_id, shared): how many fingerprints each two share; without a package, how many a library has."""
    met = _prints(files, "package_id", salt).join(own.hint("merge"), "h").select("package_id_id", "library_id")
    return met.unionByName(own.select(F.lit(None).cast("long").alias("package_id_id"), "library_id")).groupBy("package_id_id", "library_id").agg(F.count(F.lit(1)).alias("shared"))


def _found(shared: DataFrame, packages: DataFrame, libraries: DataFrame, share: float, least: int) -> DataFrame:
    prints = shared.filter("package_id_id is null").select("library_id", F.col("shared").alias("prints"))
    met = shared.filter("package_id_id is not null").join(prints.hint("merge"), "library_id")
    enough = (F.col("shared") >= share * F.col("prints")) & (F.col("shared") >= F.least(F.lit(least), F.col("prints")))
    named = met.filter(enough).join(libraries.hint("merge"), "library_id").join(packages.hint("merge"), "package_id_id")
    return named.select("package_id", "library", "shared", "prints", F.round(F.col("shared") / F.col("prints"), 4).alias("containment"))


def library_index(libraries: DataFrame, most: int = MOST) -> DataFrame:
    """libraries (library, content) -> (library, h, prints): the distinctive fingerprints of each library, and how many it has."""
    names, salt = _numbered(libraries, "library")
    own = _own(libraries, salt, most)
    counted = own.groupBy("library_id").agg(F.count(F.lit(1)).alias("prints")).join(names.hint("merge"), "library_id")
    return own.join(counted.hint("merge"), "library_id").select("library", "h", "prints")


def vendored_libraries(files: DataFrame, index: DataFrame, *, share: float = LEAST_SHARE, least: int = LEAST_PRINTS) -> DataFrame:
    """files (package_id, content), a `library_index` -> (package_id, library, shared, prints, containment) of libraries that a package holds in part or whole.

    At least `share` of the library's distinctive fingerprints, and `least` of them or all; a library without any
    can't be found. Packages and libraries meet on fingerprints, of which each
    belongs to `most` libraries at most, so a popular library costs a row for each package and fingerprint.
    Names are numbered meanwhile, so that a row is two numbers.
    """
    (libraries, salt), (packages, other) = _numbered(index, "library"), _numbered(files, "package_id")
    own = index.select(F.xxhash64("library", F.lit(salt)).alias("library_id"), "h")
    return _found(_shared(files, other, own), packages, libraries, share, least)


def find_vendored(libraries: DataFrame, files: DataFrame, *, most: int = MOST, share: float = LEAST_SHARE, least: int = LEAST_PRINTS) -> tuple[DataFrame, DataFrame]:
    """libraries (library, content), files (package_id, content) -> what `vendored_libraries` gives, and (library) of all that can be found, without an index that is kept: fingerprints of both sides are shuffled once."""
    (named, salt), (packages, other) = _numbered(libraries, "library"), _numbered(files, "package_id")
    shared = cut(_shared(files, other, _own(libraries, salt, most)), "vendored-shared")
    known = shared.filter("package_id_id is null").join(named.hint("merge"), "library_id").select("library")
    return _found(shared, packages, named, share, least), known


def declared_and_found(found: DataFrame, components: DataFrame, index: DataFrame) -> DataFrame:
    """found (package_id, library), components (package_id, name) -> (package_id, library, verdict).

    undeclared: found, but in no row of the package's components; declared: both;
    unused: a known library that is declared and not found. Names are compared without case.
    """
    known = index.select("library").distinct().withColumn("key", F.lower("library"))
    listed = components.select("package_id", F.lower("name").alias("key")).distinct().join(known, "key").select("package_id", "library", F.lit(True).alias("listed"))
    both = found.select("package_id", "library", F.lit(True).alias("found")).join(listed, ["package_id", "library"], "full")
    verdict = F.when(F.col("listed").isNull(), "undeclared").when(F.col("found").isNull(), "unused").otherwise("declared")
    return both.select("package_id", "library", verdict.alias("verdict"))
