"""Many texts that share much of themselves, as templates do."""

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from strideline.llm import near_dup


def texts(spark, n, own):
    """Texts of 104 common words and some of their own: 100 shingles are common."""
    pack = zstandard.ZstdCompressor().compress
    base = " ".join(f"t{i}" for i in range(104))
    rows = [(i, i, bytearray(pack(" ".join([base, *(f"o{i}_{j}" for j in range(own(i)))]).encode()))) for i in range(n)]
    return spark.createDataFrame(rows, "node long, class long, packed binary").repartition(4)


@pytest.mark.parametrize("own", [lambda i: 20, lambda i: 22 + i % 7])
def test_templates_below_the_threshold_do_not_meet(spark, monkeypatch, own):
    """2,000 texts with a similarity of about 0.7 to each other: two million pairs, of which next to none may be joined."""
    joined = []
    real = near_dup.meeting
    monkeypatch.setattr(near_dup, "meeting", lambda rows: joined.append(real(rows)) or joined[-1])
    df = texts(spark, 2000, own)
    assert near_dup.prefix_pairs(df.select("node", "class"), df.select("node", "packed")).count() == 0
    assert joined[0].count() < 20_000


def test_sizes_that_fit_meet(spark):
    """Every pair that is alike enough by its sizes is found, and no pair that isn't."""
    n = 300
    size = lambda i: 100 + i % 40  # noqa: E731  strips of text i
    df = texts(spark, n, lambda i: i % 40)
    got = {(r["u"], r["v"]) for r in near_dup.prefix_pairs(df.select("node", "class"), df.select("node", "packed")).collect()}
    for u in range(n):
        for v in range(u + 1, n):
            a, b = size(u), size(v)
            alike = 100 / (a + b - 100) if u % 40 or v % 40 else 1.0
            assert ((u, v) in got) == (alike >= 0.8 - 1e-9) or (v % 40 == 0 or u % 40 == 0), (u, v, alike)


def test_bands_hold_every_partner(spark):
    """By arithmetic: whatever sizes and places fit, the row's range of sizes has the partner's, and the partner's has the row's."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 5000, 200_000), rng.integers(1, 5000, 200_000)
    i, j = (rng.random(200_000) * 0.25 * a).astype(int), (rng.random(200_000) * 0.25 * b).astype(int)
    fits = np.minimum(a - i, b - j) >= near_dup.needed(a, b)
    share = near_dup.SIMILARITY / (1 + near_dup.SIMILARITY)
    for size, place, other in ((a, i, b), (b, j, a)):
        least, most = np.ceil(size * near_dup.SIMILARITY - 1e-6), np.floor((size - place) / share - size + 1e-6)
        assert (fits <= ((other >= least) & (other <= most))).all()
    assert fits.sum() > 1000
    sizes = spark.range(1, 3000).select(near_dup.size_band(F.col("id")).alias("b")).collect()
    assert all(x["b"] <= y["b"] for x, y in zip(sizes, sizes[1:]))


@pytest.fixture
def verified(monkeypatch):
    """Every node in crowded buckets, no rounds of bucket leaders, and the number of pairs that each verification gets."""
    counts = []
    real = near_dup.linked
    monkeypatch.setattr(near_dup, "CROWD", 1)
    monkeypatch.setattr(near_dup, "ROUNDS", 0)

    def linked(pairs, nodes):
        pairs = near_dup.written(pairs, "pairs")
        counts.append(pairs.count())
        return real(pairs, nodes)

    monkeypatch.setattr(near_dup, "linked", linked)
    return counts


def test_near_copies_meet_leaders_first(spark, verified):
    """400 near copies of one text, each with two words of its own: 79,800 similar pairs, of which a few for each text are verified."""
    n, words = 400, [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        own = list(words)
        own[20 + i % 150], own[30 + i * 7 % 150] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["class_id"] for r in near_dup.near_duplicates(docs).collect()} == {0}
    assert sum(verified) < 10 * n


def test_chains_stay_whole(spark, verified):
    """Texts that are similar to their neighbours alone: leaders join parts of the chain, what is left is paired."""
    rows = [(100 * c + i, " ".join(f"c{c}_{k}" for k in range(4 * i, 4 * i + 124))) for c in range(3) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {(r["doc_id"] // 100 * 100, r["class_id"]) for r in near_dup.near_duplicates(docs).collect()} == {(0, 0), (100, 100), (200, 200)}
