"""Suffix index, lexical search and vector codes against brute force, and on odd input."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cratewarden.llm import codes, lexical, runindex

from .test_operators import CLASH, docs, empty, prose, rows  # noqa: F401

# --- 11 ---


def brute_suffixes(texts):
    """{i: (bytes, removed, spans, kept digest)}"""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = {}
    for k, d in enumerate(data):
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[k] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repetitive(rng):
    """Texts with copies, near copies, passages on and around 400 bytes, short periods, and one very long text."""
    out = [prose(rng, rng.choice([5, 60, 100, 300])) for _ in range(25)]
    near = prose(rng, 600)
    for k in range(6):
        at = 100 + 550 * k
        out.append(near[:at] + "#" + near[at + k % 3 :])
    for size in (399, 400, 401, 430, 800):
        passage = prose(rng, 200)[:size]
        out += [prose(rng, 30) + "|" + passage + "|" + prose(rng, 30) for _ in range(3)]
    out += ["A" * 399, "B" * 400, "C" * 401, "D" * 9000, "ab" * 300 + "x", "é" * 500, "w " * 700, out[3], out[3], None, "", "\x00" * 500 + "q", "z" + "\x00" * 420]
    out.append(prose(rng, 9000) + near[300:1500] + prose(rng, 2000))
    return out


@pytest.mark.parametrize("block", [1 << 21, 3000])
def test_suffixes(spark, monkeypatch, block):
    """Also with a block so small that most keys are routed again, down to whole windows."""
    monkeypatch.setattr(runindex, "BLOCK", block)
    texts = repetitive(random.Random(3))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", *(f"'x' AS {c.split()[0]}" for c in CLASH.split(", ")), "1 AS base", "2 AS row_key").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in runindex.suffix_report(frame).collect()}
    assert got == brute_suffixes(texts)


def test_suffixes_odd_rows(spark, docs, rows, empty):  # noqa: F811
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in runindex.suffix_report(docs).collect()}
    assert got == brute_suffixes([t for _, t, _ in rows])
    assert runindex.suffix_report(empty).count() == 0
    long = prose(random.Random(1), 120)
    twice = spark.createDataFrame([(1, long), (1, long), (None, long + "x"), (None, "short"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in runindex.suffix_report(twice).collect()) == [(0, 0, 0), (0, len(long), 1), (1, len(long), 1), (1, len(long), 1), (2, 0, 0)]


def test_run_index():
    """Statistics from run ends equal those of all pairs, and copies add few runs."""
    rng = random.Random(8)
    for text in [prose(rng, 40) * 3, "a" * 50, prose(rng, 30) + "#" + prose(rng, 30), "abab" * 9 + "b"]:
        data = np.frombuffer(text.encode() + b"\xff", np.uint8)
        raw = data.tobytes()
        index = runindex.RunIndex.of(data)
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert runindex.suffix_array(data).tolist() == order

        def shared(i, j):
            n = 0
            while max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:  # noqa: B023
                n += 1
            return n

        assert index.statistics(data).tolist() == [max(shared(i, j) for j in range(len(raw)) if j != i) for i in range(len(raw))]
        assert int(index.size.sum()) == len(raw)
    one = prose(rng, 200)
    once, often = (len(runindex.RunIndex.of(np.frombuffer((one * k).encode() + b"\xff", np.uint8)).head) for k in (1, 50))
    assert often <= once + 60


# --- 12 ---

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(texts, items, k=10):
    held = [Counter(terms(t)) for _, t in texts]
    sizes = [sum(c.values()) for c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = set()
    for item, wanted in asked.items():
        scores = []
        for (doc, _), c, size in zip(texts, held, sizes, strict=True):
            m = 10 + (90 * size * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out |= {(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def searched(frame, items, **options):
    return {tuple(r) for r in lexical.rank_documents(frame, items, **options).collect()}


def test_search(spark, docs, rows, empty, monkeypatch):  # noqa: F811
    rng = random.Random(2)
    vocabulary = ["the", "of", "and"] + [prose(rng, 1) for _ in range(400)]
    weights = [300, 200, 100] + [400 / (k + 3) for k in range(400)]
    texts = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 30, 200])))) for k in range(900)] + [(7, "The, the of!"), (None, "the of and"), (901, None), (902, "...")]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 40])))) for k in range(60)] + [(3, "THE"), (None, "of"), (61, ""), (62, None), (63, "nowhere"), (5, vocabulary[9]), (5, vocabulary[9])]
    frame = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS score", "2 AS term").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS rank")
    want = brute_search(texts, items)
    assert searched(frame, asked) == want
    for name, value in (("POSTINGS", 300), ("SPAN", 16), ("SHORT", 4)):
        monkeypatch.setattr(lexical, name, value)
    assert searched(frame, asked, block_pairs=100) == want
    assert searched(docs, asked.limit(0)) == searched(empty, asked) == set()
    some = [(d, t) for d, t, _ in rows][:20]
    assert searched(docs, spark.createDataFrame(some, "item_id long, text string")) == brute_search([(d, t) for d, t, _ in rows], some)


def test_search_skips(spark):
    """Long lists whose bounds are too low to name candidates are not gone through."""
    rng = np.random.default_rng(0)
    q = lexical.Queries([0], np.arange(3, dtype=np.uint64), np.arange(3), np.array([0, 3]), np.array([9000, 10, 5]), 20000, 400000)
    n = 20000
    doc = np.concatenate([np.arange(0, n, 900), np.arange(n), np.arange(n)])
    block = lexical.Postings.of(q, np.arange(n), np.ones(n, bool), rng.integers(5, 40, n), np.repeat([0, 1, 2], [len(range(0, n, 900)), n, n]), doc)
    best, seen, added = lexical.Best(), [], lexical._added
    lexical._added = lambda docs, adds: (seen.append(sum(map(len, docs))), added(docs, adds))[1]
    try:
        block.search(np.arange(3), best, 10)
    finally:
        lexical._added = added
    assert len(best.score) == 10 and sum(seen[1:]) < n
    assert set(best.doc) <= set(range(0, n, 900))


# --- 13 ---


def brute_codes(vectors, parts=16, entries=64, rounds=2):
    data = sorted((k, [math.floor(256 * float(np.float32(x))) for x in v], label) for k, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v))
    size = len(data[0][1])
    at = [j * size // parts for j in range(parts + 1)]
    cut = [[v[a:b] for a, b in zip(at, at[1:], strict=False)] for _, v, _ in data]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p])) for p, part in enumerate(c)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(k, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), label) for (k, _, label), f in zip(data, assign(), strict=True)]
    errors = Counter()
    for _, _, error, label in out:
        errors[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((k, code, error, errors[label], digest) for k, code, error, label in out)


def coded(frame):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.code_report(frame).collect())


@pytest.mark.parametrize("size, many", [(64, 300), (16, 40), (37, 150), (8, 90)])
def test_codes(spark, size, many):
    rng = np.random.default_rng(size)
    vectors = [(int(k), [float(np.float32(x)) for x in rng.normal(0, 0.2, size)], [None, 1, 2][min(int(k) % 4, 2)]) for k in rng.permutation(many)]
    vectors += [(many + k, [0.25] * size, 7) for k in range(5)] + [(many + 9, None, 1), (many + 10, [None] + [0.0] * (size - 1), 1), (many + 11, [float("nan")] * size, 1), (many + 12, [float("-inf")] * size, None)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS code", "1 AS error", "2 AS part", "3 AS vector", "4 AS salt", "5 AS own").repartition(3)
    assert coded(frame) == brute_codes(vectors)


def test_codes_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert coded(spark.createDataFrame([], schema)) == coded(spark.createDataFrame([(1, None, "a")], schema)) == []
    twice = spark.createDataFrame([(1, [1.0] * 16, "a"), (1, [1.0] * 16, "a"), (2, [2.0] * 16, None), (3, [1.0], "a"), (None, [9.0] * 16, "a")], schema)
    assert [(r.vec_id, r.code[:2], r.error) for r in codes.code_report(twice).orderBy("vec_id").collect()] == [(None, "03", 0), (1, "00", 0), (1, "00", 0), (2, "02", 0)]
    huge = spark.createDataFrame([(1, [3e38] * 16, "a"), (2, [-3e38] * 16, "a")], schema)
    assert [r.error for r in codes.code_report(huge).collect()] == [0, 0]
    assert [r.code for r in codes.code_report(spark.createDataFrame([(1, [], "a")], schema)).collect()] == ["00" * 16]


def test_tree():
    """Nearest entries, ties too, with fewer distances than a scan."""
    rng = np.random.default_rng(1)
    book = np.concatenate([rng.normal(0, 30, (60, 4)), rng.normal(300, 5, (4, 4))]).astype(np.int64)
    book[40] = book[3]
    queries = np.concatenate([book, rng.normal(0, 40, (3000, 4)).astype(np.int64), (book[:30] + book[1:31]) // 2])
    found, distance, work = codes.nearest(book, codes.grow(book, np.arange(64)), queries)
    every = ((queries[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert work < 0.8 * every.size
