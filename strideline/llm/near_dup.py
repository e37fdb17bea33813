"""MinHash near-deduplication with DartMinHash signatures.

A document is its multiset of five-word shingles. Darts fall on the plane of (weight, rank) of every shingle as a hashed
Poisson process; those below the document's weight and a rank that leaves about k (ln k + 3) of them are thrown, each
falls on one of k coordinates, and the earliest on each is kept: two documents keep the same dart with the probability
of their weighted Jaccard similarity. Bands of coordinates make buckets; candidates are verified exactly.

Equal texts are one node. In a few rounds every node is held against one leader of its buckets (the one it meets most
often) that isn't in its class yet. Then the pairs of different classes that share a small bucket are all verified. Nodes
of crowded buckets meet by prefixes instead: the shingles of a node, rarest first, where two similar enough nodes must
have a common one so early that the rest can still make up the similarity. That is exact for any order of shingles, so
a class is split only where no verified link joins it. Members of one class are never paired with each other: where
prefixes would make many pairs, nodes are first held against one leader that fits them, as often as that joins classes,
and the pairs of what are still different classes come last.

Defined cases: null texts are alone in their class; equal texts are one class, empty ones too; a text of fewer than five
words is one shingle; rows with one doc_id and one text are one document, one doc_id with several texts is a document for
each; a null doc_id has a null class; other columns pass through untouched in `kept`.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import M1, M3, WORD, arrow_flat, arrow_map, join_hash, mix, numbered, unit, written
from strideline.llm.components import components
from strideline.llm.doubling import grouped, joined, packed, unpacked

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, about 5 in a million.
BANDS, ROWS = 40, 6
#: Rounds that hold nodes against one leader each at most, before what is left is paired; one that links nothing is the last.
ROUNDS = 3
#: Pairs whose signatures agree on less than this share (six deviations under the threshold's) aren't verified.
AGREE = 0.64
#: Nodes of a bucket that are paired; those of larger ones meet by prefixes.
CROWD = 32
#: Rows of prefixes that would meet more than so many others on average are held against leaders first.
MEETINGS = 2
#: Turns of that at most; what differs after them is paired.
TURNS = 8
#: Counters of shingles and their classes, whatever the data's size; shingles that share one cost time alone.
COUNTERS = 1 << 20
COUNTER_BLOCKS = 64
#: Documents whose darts a task holds at once.
SIGN_DOCS = 256
#: Word hashes that a worker keeps.
CACHE_WORDS = 300_000

_known: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, those of frequent words kept in the worker."""
    if len(_known) > CACHE_WORDS:
        _known.clear()
    get = _known.get
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = _known[w] = xxhash.xxh3_64_intdigest(w.encode())
        out.append(h)
    return np.array(out, np.uint64)


def shingles(text: str) -> np.ndarray:
    """Hashes of the five-word shingles, in order; fewer words are one shingle, none have none."""
    h = word_hashes(WORD.findall(text))
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64))
    two = join_hash(h[:-1], h[1:])
    four = join_hash(two[:-2], two[2:])
    return join_hash(four[:-1], h[4:])


def occurrences(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Strips of unit weight: each shingle hash mixed with the number of its occurrence within its document."""
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(h)
    out[order] = mix(s + nth.astype(np.uint64) * M3)
    return out


def signatures(sets: list[np.ndarray], k: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash signatures, (documents, k) uint64, of shingle arrays that aren't empty."""
    out = np.zeros((len(sets), k), np.uint64)
    todo = np.arange(len(sets))
    factor = 1.0
    while len(todo):
        n = np.array([len(sets[i]) for i in todo])
        doc = np.repeat(np.arange(len(todo)), n)
        strip = occurrences(doc, np.concatenate([sets[i] for i in todo]))
        limit = (factor * k * (np.log(k) + 3) / n)[doc]
        rank = np.zeros(len(strip))
        keys, ranks, darts = [], [], []
        turn = 0
        while len(strip):
            turn += 1
            dart = mix(strip + np.uint64(turn * int(M1) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(unit(dart))
            near = rank <= limit
            strip, rank, limit, doc, dart = strip[near], rank[near], limit[near], doc[near], dart[near]
            fall = mix(dart + M3)
            keys.append(doc * k + (fall % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            darts.append(fall)
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        scale = float(1 << 40) / max(1.0, float(rank.max(initial=1.0)))
        order = np.argsort((key << 41) | (rank * scale).astype(np.int64)) if len(todo) * k < 1 << 22 else np.lexsort((rank, key))
        key, dart = key[order], dart[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        own = np.zeros((len(todo), k), np.uint64)
        hit = np.zeros((len(todo), k), bool)
        own.flat[key[first]] = dart[first]
        hit.flat[key[first]] = True
        full = hit.all(axis=1)
        out[todo[full]] = own[full]
        todo = todo[~full]  # a coordinate without a dart: throw farther
        factor *= 2
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket keys; the band's number is part of its key."""
    h = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(sig), axis=0)
    part = sig.reshape(len(sig), BANDS, ROWS)
    for r in range(ROWS):
        h = join_hash(h, part[:, :, r])
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (distinct hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - low
    return low / whole if whole else 0.0


def text_hashes(texts: list[str | None]) -> tuple[list, list]:
    """The two halves of each text's hash, as signed numbers."""
    hashes = [None if t is None else xxhash.xxh3_128_intdigest(t.encode()) for t in texts]
    half = (1 << 64) - 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return [None if h is None else signed(h & half) for h in hashes], [None if h is None else signed(h >> 64) for h in hashes]


def packed_by_hash(docs: DataFrame) -> DataFrame:
    """(first, h1, h2, packed) of (doc_id, text)."""

    def make():
        pack = zstandard.ZstdCompressor(level=3)
        return lambda ids, texts: [ids, *text_hashes(texts), [pack.compress(t.encode()) for t in texts]]

    plain = docs.where("doc_id is not null and text is not null")
    return arrow_flat(plain, ["doc_id", "text"], [("first", "long"), ("h1", "long"), ("h2", "long"), ("packed", "binary")], make)


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, h, h1, h2, keys, sig) of (doc_id, text): a hash for joins, the text's hash, bucket keys, and one byte of each coordinate."""

    def make():
        def run(texts: list) -> list:
            h1, h2 = text_hashes(texts)
            sets = [shingles(t) if t else np.zeros(0, np.uint64) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(texts)
            sigs: list = [None] * len(texts)
            for at in range(0, len(full), SIGN_DOCS):  # darts follow the number of documents, not their bytes
                part = full[at : at + SIGN_DOCS]
                sig = signatures([sets[i] for i in part])
                low = (sig & np.uint64(255)).astype(np.uint8)
                for i, k, s in zip(part, band_keys(sig).view(np.int64), low):
                    keys[i], sigs[i] = k, s.tobytes()
            return [h1, h2, keys, sigs]

        return run

    fields = [("h1", "long"), ("h2", "long"), ("keys", "array<long>"), ("sig", "binary")]
    return arrow_map(docs.withColumn("h", F.xxhash64("text")), ["doc_id", "h"], ["text"], fields, make, limit=2 << 20)


def agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v, sig_u, sig_v) whose signatures agree enough to be worth verifying."""

    def make():
        def run(a: list, b: list) -> list:
            same = [np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) / (BANDS * ROWS) for x, y in zip(a, b)]
            return [same]

        return run

    return arrow_map(pairs, ["u", "v"], ["sig_u", "sig_v"], [("agree", "double")], make, by=None).where(F.col("agree") >= AGREE).select("u", "v")


def linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough, verified exactly."""
    side = lambda x, *cs: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cs))
    # Written, so that Spark sees how few they are before it moves texts.
    near = written(agreeing(pairs.join(side("u", "sig"), "u").join(side("v", "sig"), "v")), "near")

    def make():
        unpack = zstandard.ZstdDecompressor()
        seen: OrderedDict[int, tuple] = OrderedDict()

        def counted(node: int, packed: bytes) -> tuple:
            if node not in seen:
                seen[node] = np.unique(shingles(unpack.decompress(packed).decode()), return_counts=True)
                if len(seen) > 64:
                    seen.popitem(last=False)
            return seen[node]

        return lambda u, v, a, b: [[similarity(counted(y, q), counted(x, p)) for x, y, p, q in zip(u, v, a, b)]]

    texts = near.join(side("u", "packed"), "u").join(side("v", "packed"), "v")
    found = arrow_map(texts, ["u", "v"], ["u", "v", "packed_u", "packed_v"], [("similarity", "double")], make, by="packed_u")
    return found.where(F.col("similarity") >= SIMILARITY).select("u", "v")


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Common strips that sets of a and b strips need to be similar enough."""
    return np.ceil((np.asarray(a) + b) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9).astype(np.int64)


def prefix_rows(strips: np.ndarray, counts: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strip, place) of one node's prefix: its strips rarest first, as many as a similar enough node can't lack altogether.

    Such a node shares SIMILARITY of the larger one's strips at least, so two prefixes of this length have a common one.
    Strips that one class has to itself (`alone`) keep their places but meet nobody.
    """
    n = len(strips)
    at = (strips % np.uint64(COUNTERS)).astype(np.int64)
    order = np.lexsort((strips, counts[at]))[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]
    meets = ~alone[at[order]]
    return strips[order][meets], np.nonzero(meets)[0]


def strips_of(packed: list[bytes]) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    sets = [shingles(unpack.decompress(p).decode()) for p in packed]
    return [occurrences(np.zeros(len(s), np.int64), s) for s in sets]


def summed(at: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counters that stand once each: their numbers added up, and the smallest and the largest class."""
    order = np.argsort(at, kind="stable")
    at, n, lo, hi = at[order], n[order], lo[order], hi[order]
    cut = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
    return at[cut], np.add.reduceat(n, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)


def prefixes(crowd: DataFrame, slim: DataFrame) -> DataFrame:
    """(key, node, class, size, place) of the nodes (node, class): their prefixes, a row for each strip."""
    texts = written(crowd.join(slim.select("node", "packed"), "node"), "crowd")

    size = COUNTERS // COUNTER_BLOCKS

    def make_counts():
        def run(cls: list, packs: list) -> list:
            strips = strips_of(packs)
            at = (np.concatenate(strips) % np.uint64(COUNTERS)).astype(np.int64)
            owner = np.repeat(np.array(cls, np.int64), [len(s) for s in strips])
            at, n, lo, hi = summed(at, np.ones(len(at), np.int64), owner, owner)
            cut = np.searchsorted(at, np.arange(COUNTER_BLOCKS + 1) * size)
            parts = [(k, a, z) for k, (a, z) in enumerate(zip(cut, cut[1:])) if z > a]
            return [[k for k, _, _ in parts], *([packed(x[a:z]) for _, a, z in parts] for x in (at, n, lo, hi))]

        return run

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "block"):
            at, n, lo, hi = summed(*(joined(rows, c) for c in ("at", "n", "lo", "hi")))
            yield pa.RecordBatch.from_arrays([pa.array([packed(x)]) for x in (at, n, (lo == hi).astype(np.int64))], names=["at", "n", "alone"])

    # Counters travel in blocks of packed arrays; COUNTERS of them at most reach the driver, in 13 MB unpacked.
    fields = [("block", "int"), ("at", "binary"), ("n", "binary"), ("lo", "binary"), ("hi", "binary")]
    seen = arrow_flat(texts, ["class", "packed"], fields, make_counts, by="packed", limit=1 << 20)
    seen = seen.repartitionById(COUNTER_BLOCKS, F.col("block")).sortWithinPartitions("block").mapInArrow(merge, "at binary, n binary, alone binary")
    counts, alone = np.zeros(COUNTERS, np.int32), np.zeros(COUNTERS, bool)
    for r in seen.collect():
        at = unpacked(r["at"])
        counts[at], alone[at] = np.minimum(unpacked(r["n"]), 2**31 - 1), unpacked(r["alone"]) > 0
    shared = crowd.sparkSession.sparkContext.broadcast((counts, alone))

    def make_rows():
        def run(node: list, cls: list, packed: list) -> list:
            strips = strips_of(packed)
            rows = [prefix_rows(s, *shared.value) for s in strips]
            size = [len(r[0]) for r in rows]
            spread = lambda x: np.repeat(np.array(x, np.int64), size)
            key, place = (np.concatenate(x) for x in zip(*rows))
            return [key.view(np.int64), spread(node), spread(cls), spread([len(s) for s in strips]), place]

        return run

    fields = [("key", "long"), ("node", "long"), ("class", "long"), ("size", "long"), ("place", "long")]
    return arrow_flat(texts, ["node", "class", "packed"], fields, make_rows, by="packed", limit=1 << 18)


def prefix_pairs(crowd: DataFrame, slim: DataFrame) -> DataFrame:
    """(u, v) of the nodes (node, class) of different classes that may be similar enough by their prefixes."""
    return pairs_of(meeting(prefixes(crowd, slim)))


def fitting(met: DataFrame) -> DataFrame:
    """Of (u, a, i, v, b, j), those whose strips from the common one on can make up the similarity."""
    return met.where(F.least(F.expr("a - i"), F.expr("b - j")) >= F.ceil(F.expr("a + b") * F.lit(SIMILARITY / (1 + SIMILARITY)) - F.lit(1e-9)))


def pairs_of(met: DataFrame) -> DataFrame:
    return fitting(met).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def size_band(size: Column) -> Column:
    """Sizes within about 1 % share a band."""
    return F.floor(F.log(size.cast("double")) * 100).cast("int")


def seeking(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, asking) of prefix rows (key, node, class, size, place): those that have a partner's key and size, by key and band.

    With `place` strips before this one, a node of `size` can have no partner larger than it still has strips for, nor one
    under SIMILARITY of its size. Each key tells which bands of sizes it has; a row none of whose sizes is there goes, and
    the rest meet by key and band. So texts that share much, yet not enough, don't meet: their common strips come too late
    in their prefixes for partners of the sizes that they have.
    """
    rows = rows.withColumn("band", size_band(F.col("size")))
    # Only keys that two classes have; members of a key's main class don't look for others, they are found.
    keys = rows.groupBy("key", "class", "band").agg(F.count(F.lit(1)).alias("n"))
    keys = keys.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.collect_set("band").alias("bands"))
    share = SIMILARITY / (1 + SIMILARITY)
    least, most = F.ceil(F.col("size") * SIMILARITY - 1e-6), F.floor((F.col("size") - F.col("place")) / share - F.col("size") + 1e-6)
    rows = rows.join(keys.where("lo <> hi").select("key", "main", "bands"), "key").withColumn("least", least).withColumn("most", most).where("most >= least")
    inside = F.filter("bands", lambda x: (x >= size_band(F.col("least"))) & (x <= size_band(F.col("most"))))
    rows = rows.withColumn("asks", inside).where(F.size("asks") > 0).withColumn("in_main", F.col("class") == F.col("main"))
    rows = written(rows.select("key", "node", "class", "size", "place", "band", "least", "most", "in_main", "asks"), "prefixes")
    found = rows.select("key", "band", F.col("node").alias("u"), F.col("class").alias("cu"), F.col("size").alias("a"), F.col("place").alias("i"), "least", "most", F.col("in_main").alias("found"))
    asking = rows.where("not in_main").select("key", F.explode("asks").alias("band"), F.col("node").alias("v"), F.col("class").alias("cv"), F.col("size").alias("b"), F.col("place").alias("j"))
    return found, asking


def met_by(found: DataFrame, asking: DataFrame) -> DataFrame:
    """(u, a, i, v, b, j) of rows of `seeking` with a common key, of different classes and of sizes that may fit."""
    return found.join(asking, ["key", "band"]).where("cu <> cv and (found or u < v) and b between least and most").select("u", "a", "i", "v", "b", "j")


def meeting(rows: DataFrame) -> DataFrame:
    """(u, a, i, v, b, j) of all prefix rows (key, node, class, size, place) that may fit."""
    return met_by(*seeking(rows))


def crowding(found: DataFrame, asking: DataFrame) -> bool:
    """Whether the rows of `seeking` would meet too many others: counted by classes, at most, before any is joined."""
    n = F.count(F.lit(1))
    have = found.groupBy("key", "band", F.col("cu").alias("c")).agg(n.alias("f"), F.lit(0).cast("long").alias("q"))
    want = asking.groupBy("key", "band", F.col("cv").alias("c")).agg(F.lit(0).cast("long").alias("f"), n.alias("q"))
    by_class = have.unionByName(want).groupBy("key", "band", "c").agg(F.sum("f").cast("double").alias("f"), F.sum("q").cast("double").alias("q"))
    meet = by_class.groupBy("key", "band").agg((F.sum("f") * F.sum("q") - F.sum(F.expr("f * q"))).alias("m"), F.sum("f").alias("f"))
    total = meet.agg(F.sum("m").alias("m"), F.sum("f").alias("f")).first()
    return (total["m"] or 0) > MEETINGS * (total["f"] or 0)


def led(found: DataFrame, asking: DataFrame, turn: int) -> DataFrame:
    """(u, v): each asking node with the leader that it meets most often, one of each key and band, another in each turn."""
    order = F.xxhash64("u", F.lit(turn))
    lead = found.groupBy("key", "band").agg(F.min(F.struct(order.alias("o"), *(c for c in found.columns if c not in ("key", "band")))).alias("l")).select("key", "band", "l.*").drop("o")
    met = fitting(met_by(lead.withColumn("found", F.lit(True)), asking)).groupBy("v", "u").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("v").agg(F.max(F.struct("n", "u")).alias("b")).select(F.col("b.u").alias("u"), "v")


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class) once the classes of linked nodes are one."""
    a = classes.select(F.col("node").alias("u"), F.col("class").alias("cu"))
    b = classes.select(F.col("node").alias("v"), F.col("class").alias("cv"))
    edges = links.join(a, "u").join(b, "v").where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
    roots = components(edges).select(F.col("node").alias("class"), "root")
    return written(classes.join(roots, "class", "left").select("node", F.coalesce("root", "class").alias("class")), "classes")


def settled_crowd(crowd: DataFrame, slim: DataFrame, classes: DataFrame) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
    """What `seeking` finds in the prefixes of the nodes `crowd` (node, class), and the classes (node, class), once leaders have joined what they can."""
    rows = written(prefixes(crowd, slim), "prefixes")
    plain, turn = rows.drop("class"), 0
    while True:
        sought = seeking(rows)
        if turn == TURNS or not crowding(*sought):
            return sought, classes
        links = written(linked(led(*sought, turn), slim), "links")
        if not links.limit(1).count():
            return sought, classes
        classes = merged(classes, links)
        rows, turn = plain.join(classes, "node"), turn + 1


def classes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h, class_id, leads) of (doc_id, text): the class is named by its smallest doc_id; one text of that leads it."""
    rows = written(prepared(docs), "signatures")
    named = rows.where("doc_id is not null and h1 is not null")
    # A text is a node, numbered by its smallest doc_id or, where that is the smallest of several texts, by their hashes.
    firsts = written(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")), "firsts")
    several = written(firsts.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("first", F.lit(True).alias("several")), "several")
    texts = written(firsts.join(several, "first", "left").select("h1", "h2", "first", F.when(F.col("several"), F.xxhash64("h1", "h2")).otherwise(F.col("first")).alias("node")), "texts")
    carrier = named.join(texts, ["h1", "h2"]).where("doc_id = first").dropDuplicates(["node"]).where("keys is not null")
    nodes = written(carrier.select("node", "sig", "keys"), "nodes")
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    busy = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = written(buckets.join(busy, "key"), "buckets")  # nodes alone in a bucket go at once
    met_any = texts.join(buckets.select("node").distinct(), "node")
    texts_of = packed_by_hash(docs).join(met_any, ["first", "h1", "h2"]).select("node", "packed").dropDuplicates(["node"])
    slim = written(nodes.select("node", "sig").join(texts_of, "node"), "candidates")
    classes = written(nodes.select("node", F.col("node").alias("class")), "classes")
    leading, turn = ROUNDS > 0, 0
    while True:
        held = buckets.join(classes, "node")
        if leading:
            # A leader for each bucket, another in each round; each node meets the one of another class that it shares most buckets with.
            order = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
            lead = held.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("leader"), F.col("class").alias("c"))).alias("l")).select("key", "l.leader", "l.c")
            met = held.join(lead, "key").where("class <> c").groupBy(F.col("node").alias("v"), F.col("leader").alias("u")).agg(F.count(F.lit(1)).alias("n"))
            pairs = met.groupBy("v").agg(F.max(F.struct("n", F.col("u"))).alias("b")).select(F.col("b.u").alias("u"), "v")
        else:
            mixed = held.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
            rest = written(held.join(mixed.select("key", (F.col("n") > CROWD).alias("crowded")), "key"), "mixed")
            sought, classes = settled_crowd(rest.where("crowded").select("node", "class").distinct(), slim, classes)
            few = rest.where("not crowded").drop("class").join(classes, "node")
            a = few.select("key", F.col("node").alias("u"), F.col("class").alias("cu"))
            b = few.select("key", F.col("node").alias("v"), F.col("class").alias("cv"))
            pairs = a.join(b, "key").where("u < v and cu <> cv").select("u", "v")
            pairs = pairs.unionByName(pairs_of(met_by(*sought))).distinct()
        links = written(linked(pairs, slim), "links")
        linking = bool(links.limit(1).count())
        if linking:
            classes = merged(classes, links)
        if not leading:
            break
        turn += 1
        leading = linking and turn < ROUNDS
    members = texts.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    leader = members.groupBy("class").agg(F.min(F.struct("first", "node")).alias("l"))
    named_class = members.join(leader, "class").select("h1", "h2", F.col("l.first").alias("class_id"), (F.col("node") == F.col("l.node")).alias("leads"))
    placed = rows.select("doc_id", "h", "h1", "h2").join(named_class, ["h1", "h2"], "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return placed.select("doc_id", "h", class_id.alias("class_id"), (F.coalesce("leads", F.lit(True)) & (F.col("doc_id") == class_id)).alias("leads"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return classes_of(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "class_id")


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that of the smallest doc_id, with all its columns; rows without doc_id stay."""
    plain, (i, t) = numbered(docs, doc_id, text)
    number = F.col(i).cast("long")
    found = classes_of(plain.select(number.alias("doc_id"), F.col(t).alias("text")))
    first = found.where("leads").select("doc_id", "h").distinct()
    named = plain.join(first, (number == F.col("doc_id")) & (F.xxhash64(F.col(t)) == F.col("h")), "left_semi")
    return named.unionByName(plain.where(number.isNull())).toDF(*docs.columns)
