"""The bit-sliced search, vector codes and ranked search against brute force, and on the cases that their docstrings define."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.llm import bit_sliced, lexical_search, vector_codes
from strideline.llm.blocks import packed, unpacked

VECTORS = "vec_id long, embedding array<float>, label int, rank int, body string, number long, key long, error long, code string, id long"


def rows_of(vectors):
    return [(i, v, label, 1, "b", 2, 3, 4, "c", 5) for i, v, label in vectors]


def odd_vectors(rng, n=300, width=8):
    """Ties, repeated rows and ids, nulls, components that aren't finite, short and empty vectors, a hot vector and label."""
    out = [(i, [rng.gauss(0, 0.2) for _ in range(width)], rng.choice([1, 1, 2, None])) for i in range(n)]
    out += [(1000 + i, [0.5, -0.25] * (width // 2), 7) for i in range(n // 2)]
    out += [out[3], (4, [1.0] * width, 9), (2000, None, 1), (2050, [0.1, None] * (width // 2), 1), (2100, [float("nan")] * width, 1), (2150, [float("inf")] * width, 1)]
    return [*out, (2200, [0.5], 3), (2250, [], 3), (None, [0.3] * width, None), (-50, [-0.5] * width, None)]


def whole(vectors, scale, width):
    out = []
    for i, v, label in vectors:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v] + [0] * (width - len(v)), label))
    return out


# ---- bit-sliced search


def brute_nearest(rows, k, asks):
    out = []
    for i, q, _ in rows:
        if i is not None and asks(i):
            found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for j, v, _ in rows if j != i)
            out += [(i, n + 1, f[3], -f[0]) for n, f in enumerate(found[:k])]
    return out


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("k", [1, 5, 400, 1000])
def test_nearest_equals_brute_force(spark, k):
    vectors = odd_vectors(random.Random(1))
    df = spark.createDataFrame(rows_of(vectors), VECTORS)
    got = bit_sliced.nearest(df, F.col("vec_id") % 50 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert key(map(tuple, got.collect())) == key(brute_nearest(whole(vectors, 256, 8), k, lambda i: i % 50 == 0))


def test_nearest_over_many_blocks(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)], 0) for i in range(3000)]
    df = spark.createDataFrame(rows_of(vectors), VECTORS).repartition(7)
    index = bit_sliced.index(df, rows=130)
    assert index.count() >= 23
    got = bit_sliced.searched(index, df.where("vec_id % 10 = 0"), 5)
    assert key(map(tuple, got.collect())) == key(brute_nearest(whole(vectors, 256, 6), 5, lambda i: i % 10 == 0))


def test_adders_sum_bitmaps():
    rng = np.random.default_rng(5)
    for _ in range(50):
        columns = [rng.integers(0, 1 << 63, (rng.integers(0, 9), 2), dtype=np.uint64) for _ in range(rng.integers(0, 5))]
        want = np.zeros(128, np.int64)
        for w, column in enumerate(columns):
            for row in column:
                want += np.unpackbits(row.view(np.uint8), bitorder="little").astype(np.int64) << w
        got = np.zeros(128, np.int64)
        for w, digit in enumerate(bit_sliced.added(columns, 2)):
            got += np.unpackbits(digit.view(np.uint8), bitorder="little").astype(np.int64) << w
        assert (got == want).all()


def test_selection_takes_ties_by_place():
    digits = [bit_sliced.bitmap(np.array(b, bool)) for b in ([0, 1, 1, 0, 1, 1], [1, 1, 1, 0, 1, 1])]  # 2 3 3 0 3 3
    among = bit_sliced.bitmap(np.array([1, 1, 0, 1, 1, 1], bool))
    for k, want in ((1, [1]), (2, [1, 4]), (3, [1, 4, 5]), (4, [0, 1, 4, 5]), (9, [0, 1, 3, 4, 5])):
        assert sorted(bit_sliced.selected(digits, among, k)) == want


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame(rows_of([(1, [0.5, 0.5], 1), (51, [0.5, 0.5], 1)]), VECTORS)
    assert bit_sliced.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert bit_sliced.nearest(some, F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in bit_sliced.nearest(some, F.col("vec_id") == 1).collect()] == [(1, 1, 51, 32768)]
    with pytest.raises(Exception, match="in magnitude"):
        bit_sliced.nearest(spark.createDataFrame(rows_of([(0, [3e30], 1)]), VECTORS), F.col("vec_id") == 0).collect()


# ---- vector codes


def brute_codes(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v, _ in rows], np.int64)
    width = -(-x.shape[1] // parts) * parts
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    parts_ = np.split(x, parts, axis=1)
    books = [p[:entries].copy() for p in parts_]
    for r in range(rounds + 1):
        codes = [((p[:, None, :] - b[None]) ** 2).sum(axis=2) for p, b in zip(parts_, books)]
        if r == rounds:
            break
        for p, b, d in zip(parts_, books, codes):
            own = d.argmin(axis=1)
            for e in set(own.tolist()):
                b[e] = [int(c) // int((own == e).sum()) for c in p[own == e].sum(axis=0)]
    code = ["".join(f"{d[i].argmin():02x}" for d in codes) for i in range(len(rows))]
    error = [int(sum(d[i].min() for d in codes)) for i in range(len(rows))]
    of_label = {}
    for (_, _, label), e in zip(rows, error):
        of_label[label] = of_label.get(label, 0) + e
    return [(i, c, e, of_label[label]) for (i, _, label), c, e in zip(rows, code, error)]


@pytest.mark.parametrize("width,entries,rounds", [(8, 256, 4), (8, 16, 4), (6, 3, 2), (8, 1, 3)])
def test_codes_equal_brute_force(spark, width, entries, rounds):
    vectors = odd_vectors(random.Random(2), width=width)
    df = spark.createDataFrame(rows_of(vectors), VECTORS).repartition(5)
    got = vector_codes.compressed(df, entries=entries, rounds=rounds).collect()
    want = brute_codes(whole(vectors, 1024, width), 4, entries, rounds)
    assert key((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == key(want)
    assert len({r["codebooks_sha256"] for r in got}) == 1


def test_bounds_save_scans_and_keep_ties():
    """On clustered rows most bounds hold; on a small grid, where nearly every row is tied, codes stay those of a full scan."""
    rng = np.random.default_rng(3)
    for x, entries, few in ((rng.integers(-3, 4, (4000, 3)), 12, False), (rng.integers(-1000, 1000, (20, 3))[rng.integers(0, 20, 4000)] + rng.integers(-9, 9, (4000, 3)), 20, True)):
        book = x[:entries].copy()
        code, upper, lower = vector_codes.scanned(x, book)
        for _ in range(6):
            counts = np.bincount(code, minlength=len(book))
            totals = np.zeros_like(book)
            np.add.at(totals, code, x)
            now = vector_codes.moved(book, counts, totals)
            code, upper, lower, scans = vector_codes.reassigned(x, now, vector_codes.Motion(book, now), code, upper, lower)
            book = now
            assert (code == ((x[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
            assert not few or scans < len(x)
        assert not few or scans < len(x) // 4


def test_large_components_stay_exact():
    rng = np.random.default_rng(6)
    x, e = rng.integers(-(1 << 24), 1 << 24, (50, 16)), rng.integers(-(1 << 24), 1 << 24, (9, 16))
    assert (vector_codes.distances(x, e) == ((x[:, None] - e[None]) ** 2).sum(axis=2)).all()


def test_codes_of_nothing(spark):
    assert vector_codes.compressed(spark.createDataFrame([], VECTORS)).count() == 0
    only = spark.createDataFrame(rows_of([(1, None, 1), (2, [None], 2)]), VECTORS)
    assert vector_codes.compressed(only).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compressed(only).count() == 0


# ---- ranked search

DOCS = "doc_id long, text string, score long, rank int, key long, item long, body string, words string"
WORD = re.compile(lexical_search.TERM)


def found_terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    counts = [(i, {}) for i, _ in docs]
    for (_, tf), (_, text) in zip(counts, docs):
        for w in found_terms(text):
            tf[w] = tf.get(w, 0) + 1
    held, total = sum(bool(tf) for _, tf in counts), sum(sum(tf.values()) for _, tf in counts)
    df = {}
    for _, tf in counts:
        for w in tf:
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, tf in counts:
            m = 50 + (50 * sum(tf.values()) * held) // total if total else 0
            score = sum(int(np.floor(1000 * np.log((2 * held + 2) / (2 * df[w] + 1)))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * m)) for w in set(found_terms(text)) if w in tf)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, f[3], -f[0]) for n, f in enumerate(sorted(found)[:k])]
    return out


def odd_texts(rng, n=400):
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "ß", "K", "k", "K", "x1", "漢字"]
    out = [(i, rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choice(words[: rng.choice([5, 20, 68])]) for _ in range(rng.choice([0, 1, 5, 30, 90])))) for i in range(n)]
    out += [(n + i, out[7][1]) for i in range(150)]  # copies, so that scores are tied at the boundary
    return [*out, out[9], (None, out[7][1]), (None, "w1 w2"), (5000, None), (5001, " .,\t"), (5002, "w1 " * 3000)]


@pytest.mark.parametrize("k,block_bytes", [(50, 1 << 23), (3, 2000), (1000, 5000)])
def test_search_equals_brute_force(spark, monkeypatch, k, block_bytes):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block_bytes)
    rng = random.Random(8)
    docs = odd_texts(rng)
    items = [(i, " ".join(f"W{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 40])))) for i in range(30)] + [(3, "w1 w2"), (None, "w3"), (77, None), (78, "unknown"), (79, "k K Éa"), (80, docs[7][1])]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, "b", "w") for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, key long, rank int")
    got = lexical_search.search(df, asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(map(tuple, got.collect())) == key(brute_search(docs, items, k))


def test_reading_ends_early():
    """With one rare term that decides, groups of the common ones are left unread, and scores are whole nevertheless."""
    n = 5000
    known = {b"rare": 0, b"common": 1}
    codes, docs = [np.zeros(40, np.int64), np.ones(n, np.int64)], [np.arange(40), np.arange(n)]
    ids = {"ids": np.arange(n), "none": np.zeros(n, bool)}
    held = unpacked(packed(lexical_search.block(ids, known, codes, docs, n + 40, n)))
    at, scores = lexical_search.top(held, np.array([0, 1]), np.array([9000, 2]), 40, 0)
    assert at.tolist() == list(range(40)) and len(set(scores.tolist())) == 1
    t = held["t"].astype(np.int64)
    assert scores[0] == 9000 * t[held["groups"][0]] + 2 * t[held["groups"][1] : held["groups"][2]].min()
    assert lexical_search.top(held, np.array([1]), np.array([2]), 40, 10**12)[0].tolist() == []


def test_search_of_nothing_found(spark):
    docs = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.search(docs, items).count() == 0
    some = spark.createDataFrame([(1, "w1", 1, 2, 3, 4, "b", "w")], DOCS)
    assert lexical_search.search(some, items.limit(0)).count() == 0
    assert lexical_search.search(some, spark.createDataFrame([(1, "w9")], items.schema)).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = ("Ab-c é " * 500).encode()
    whole_ = [w for some in lexical_search.terms(text) for w in some]
    monkeypatch.setattr(lexical_search, "PIECE_BYTES", 7)
    assert [w for some in lexical_search.terms(text) for w in some] == whole_ == ["ab".encode(), b"c", "é".encode()] * 500
