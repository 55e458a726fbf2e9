"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text go with them.

Everything is an expression over one row, so the operator is a single narrow
stage: no shuffle, no state, and work in proportion to the text. Repeated
8-word windows are found on an array of window hashes; a document whose hashes
are all different (nearly every one) is done after one hash set, and only the
others sort theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_name, words

WINDOW = 8
MIN_WORDS = 20
#: Documents that keep less than this share of their word characters are rejected.
MIN_KEPT = 0.5

SYMBOLS = r"[^#*$%&|<>]++"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Phrases of page furniture, as whole words in any case.
BOILERPLATE = r"(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript|lorem ipsum|click here|sign (?:in|up)|log ?in|subscribe (?:now|to)|share (?:on|this)|read more|skip to content|back to top|powered by|copyright (?:\(c\)|©|[0-9]{4}))\b"
#: Ends of a sentence, with closing quotes or brackets after them.
SENTENCE_END = r"[.!?…。！？:;][\"'”’»)\]]*[\x20\x09-\x0D]*$"


# An array that a lambda looks into is always a column of its own: inside the lambda, an expression would be computed for each element.


def window_hashes(hashes: Column) -> Column:
    """Of an array column of word hashes, the hash of each WINDOW words in a row."""
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    return F.when(F.size(hashes) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def by_hash(windows: Column) -> Column:
    """The windows sorted by hash, with their places; empty if all differ."""
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.array_sort(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def twins(ordered: Column) -> Column:
    """The places, in order, of windows whose neighbour in a column sorted by hash has the same hash."""
    same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
    return F.array_sort(F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))


def covered(places: Column) -> Column:
    """Words that windows at these places cover."""
    steps = F.transform(places, lambda at, k: F.least(F.coalesce(F.get(places, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step).cast("long")


def line_passes(line: Column) -> Column:
    """Whether a line with a word stays.

    Navigation: three or more separators between links. Noise: symbols or
    shouting in more than a fifth of it. Boilerplate: page furniture in a line
    of up to 25 words. Punctuation: short lines must end a sentence.
    """
    size = F.length(line)
    bars = F.length(F.regexp_replace(line, r"[^|»›•·]++", ""))
    symbols = F.length(F.regexp_replace(line, SYMBOLS, ""))
    shouts = F.length(F.regexp_replace(line, r"[^!]++", ""))
    short = size < 160
    navigation = (bars >= 3) & (bars * 40 > size)
    noise = (symbols * 8 > size) | ((shouts >= 4) & (shouts * 15 > size))
    furniture = short & line.rlike(BOILERPLATE)
    unended = (size < 30) & ~line.rlike(SENTENCE_END)
    return ~(navigation | noise | furniture | unended)


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]++", "")).cast("long")


def judge_quality(docs: DataFrame, *, text: str = "text", min_words: int = MIN_WORDS, max_repeated: int = 30, min_kept: float = MIN_KEPT) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the counts, the cleaned text and the verdict, under names that it doesn't have: (frame, names).

    Null and blank texts have no words and fail. Repeated rows are judged each
    for itself; other columns pass through.
    """
    name = {k: scratch_name(docs, k) for k in ("text", "words", "lines", "hashes", "windows", "ordered", "twins", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean", "kept")}
    c = {k: F.col(v) for k, v in name.items()}
    lines = F.filter(F.split(c["text"], "\n"), lambda line: line.rlike(HAS_WORD))
    out = (
        docs.withColumn(name["text"], F.coalesce(F.col(text), F.lit("")))
        .withColumns({name["words"]: words(c["text"]), name["lines"]: lines})
        .withColumns({
            name["hashes"]: F.transform(c["words"], lambda w: F.xxhash64(w)),
            name["n_words"]: F.size(c["words"]).cast("long"),
            name["word_chars"]: F.length(F.array_join(c["words"], "")).cast("long"),
            name["n_symbols"]: F.length(F.regexp_replace(c["text"], SYMBOLS, "")).cast("long"),
            name["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
            name["clean"]: F.array_join(F.filter(c["lines"], line_passes), "\n"),
        })
        .withColumn(name["windows"], window_hashes(c["hashes"]))
        .withColumn(name["ordered"], by_hash(c["windows"]))
        .withColumn(name["twins"], twins(c["ordered"]))
        .withColumn(name["n_repeat_words"], covered(c["twins"]))
        .withColumn(name["base_failed"], (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeated * c["n_words"]))
        .withColumn(name["kept"], ~c["base_failed"] & (word_chars(c["clean"]) >= F.lit(min_kept) * c["word_chars"]))
    )
    return out.drop(*(name[k] for k in ("text", "words", "lines", "hashes", "windows", "ordered", "twins"))), name


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each document: its counts, base_failed and kept."""
    out, name = judge_quality(docs.select("doc_id", "text"))
    return out.select("doc_id", *(F.col(name[k]).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the lines that pass; the columns of `docs`.

    The row number keeps the optimizer from moving the filter below the columns
    that it depends on, where each would be computed again inside every lambda.
    """
    out, name = judge_quality(docs)
    row = scratch_name(out, "row")
    passed = out.withColumn(row, F.monotonically_increasing_id()).filter(F.col(name["kept"]) & (F.col(row) >= 0))
    return passed.select(*(F.col(name["clean"]).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
