"""Secret scans: fixed patterns, and tokens that read like random strings.

Two character Markov models, of random strings and of ordinary identifiers, are
trained from labelled samples and compared by log-likelihood ratio. Their
bigram tables become one array of 64 * 64 numbers in the plan, so scoring is an
expression over a row; everything after training is a single narrow stage.

Labelled samples. Ordinary: identifiers joined (snake, camel, kebab, path) from
the words of a bounded sample of the documents, SAMPLE_WORDS distinct words.
Random: digests of the same words in hexadecimal, base64 and base62 letters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, words
from .spans import as_text, free_of, with_spans

KINDS = ("assign", "access", "hex")
#: The base patterns. A minimum length stands in the pattern where a shorter run can't hold a longer match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Tokens that the models judge, and the alphabet of their bigrams; digits, capitals and signs share no class with small letters.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
#: Rows (about) and distinct words (at most) that the models are trained on.
SAMPLE_ROWS, SAMPLE_WORDS = 400, 4000
#: Mean log-likelihood ratio for each bigram over which a token is random.
THRESHOLD = 0.8


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(label, token): 1 for random strings, 0 for ordinary identifiers, from a bounded sample of the words of `docs`."""
    sample = bounded_sample(docs.select("doc_id", "text"), SAMPLE_ROWS, "doc_id")
    word = sample.select(F.explode(words(F.col("text"))).alias("w")).select(F.lower(F.regexp_replace("w", r"[^\p{L}]++", "")).alias("w"))
    word = word.filter(F.length("w").between(2, 24)).groupBy("w").agg(F.xxhash64("w").alias("h")).orderBy("h").limit(SAMPLE_WORDS)
    # partners by one more hash, so that joining two words needs no order between rows
    hashed = word.select("w", F.md5(F.encode("w", "UTF-8")).alias("m"), F.pmod(F.xxhash64("w"), F.lit(3)).alias("k"))
    ascii_word = F.regexp_replace("w", r"[^a-z]++", "e")
    capital = F.initcap(ascii_word)
    ordinary = F.array(F.concat(ascii_word, F.lit("_"), ascii_word), F.concat(ascii_word, capital), F.concat(capital, F.lit("/"), ascii_word), F.concat(ascii_word, F.lit("-"), F.substring("m", 1, 1)), ascii_word, F.upper(ascii_word))
    bits = F.unhex(F.sha2(F.encode("w", "UTF-8"), 256))
    random = F.array(F.substring("m", 1, 32), F.sha1(F.encode("w", "UTF-8")), F.base64(bits), F.regexp_replace(F.base64(bits), "[+/=]", ""), F.upper(F.regexp_replace(F.base64(bits), "[^A-Za-z0-9]", "")))
    return hashed.select(F.explode(F.array(F.struct(F.lit(0).alias("label"), ordinary.alias("tokens")), F.struct(F.lit(1).alias("label"), random.alias("tokens")))).alias("x")).select("x.label", F.explode("x.tokens").alias("token"))


def train(samples: DataFrame) -> list[float]:
    """Log of how much likelier each bigram is in random strings than in ordinary ones: len(ALPHABET) ** 2 numbers."""
    n = len(ALPHABET)
    pairs = samples.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
    counts = {label: [[0.0] * n for _ in range(n)] for label in (0, 1)}
    for label, pair, many in pairs.groupBy("label", "pair").count().filter(F.col("pair").rlike("^[A-Za-z0-9+/]{2}$")).collect():  # at most 2 * 64 * 64 rows
        counts[label][ALPHABET.index(pair[0])][ALPHABET.index(pair[1])] += many
    shares = {label: _smoothed(table) for label, table in counts.items()}
    return [round(math.log(r / o), 4) for random, ordinary in zip(shares[1], shares[0], strict=True) for r, o in zip(random, ordinary, strict=True)]


def _smoothed(counts: list[list[float]], weight: float = 30.0) -> list[list[float]]:
    """Chances of the next character, drawn towards those of its class (small, capital, digit, sign) after the last one's class."""
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in ALPHABET]
    size = [kind.count(k) for k in range(4)]
    follows = [[1.0 + sum(x for i, row in enumerate(counts) if kind[i] == a for j, x in enumerate(row) if kind[j] == b) for b in range(4)] for a in range(4)]
    prior = [[follows[a][kind[j]] / sum(follows[a]) / size[kind[j]] for j in range(len(ALPHABET))] for a in range(4)]
    return [[(x + weight * prior[kind[i]][j]) / (sum(row) + weight) for j, x in enumerate(row)] for i, row in enumerate(counts)]


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's bigrams; signs outside the alphabet take no part."""
    plain = F.regexp_replace(token, "[^A-Za-z0-9+/]", "")
    places = F.transform(F.split(plain, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    # a fold with the last place in its state: each letter is looked up once
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).cast("double").alias("sum"), F.lit(0).alias("n"))
    numbers = F.array(*map(F.lit, table))

    def step(state: Column, at: Column) -> Column:
        known = (state["last"] >= 0) & (at >= 0)
        gain = F.when(known, F.get(numbers, state["last"] * len(ALPHABET) + at)).otherwise(F.lit(0.0))
        return F.struct(at.cast("int").alias("last"), (state["sum"] + gain).alias("sum"), (state["n"] + known.cast("int")).alias("n"))

    folded = F.aggregate(F.filter(places, lambda p: p >= 0), zero, step)
    return F.when(folded["n"] > 0, folded["sum"] / folded["n"]).otherwise(F.lit(0.0))


def scan_secrets(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the spans of each base kind (`assign`, `access`, `hex`) and those the models add (`random`).

    Spans are whole matches, in code points, end exclusive. A token is added if
    it overlaps no base span and its ratio is over the threshold. Null texts are
    empty; rows are scanned each for itself; other columns are ignored; an empty
    table trains on nothing and gives no rows.
    """
    table = train(labelled_samples(docs))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    patterns = {"assign": (ASSIGN, text.rlike("(?i)passw|secret|token|api_?key")), "access": (ACCESS, text.contains("AKIA")), "hex": (HEX, F.lit(True)), "random": (TOKEN, F.lit(True))}
    rows = with_spans(rows, patterns).drop("text")
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= 6))
    rows = rows.withColumn("base", F.concat(*KINDS))
    rows = free_of(rows, "random", "base")
    return rows.withColumn("random", F.filter("random", lambda s: ratio(s["text"], table) > threshold)).drop("base")


def secret_report(docs: DataFrame) -> DataFrame:
    out = scan_secrets(docs)

    def tagged(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), as_text(kind, s).alias("t")))

    def joined(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.transform(F.array_sort(F.concat(*(tagged(n, kind) for n, kind in enumerate(kinds)))), lambda x: x["t"]), ",")

    return out.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(KINDS), 256).alias("base_sha256"), joined((*KINDS, "random")).alias("spans"), F.size("random").cast("long").alias("n_random")
    )
