"""Ranked lexical search over an impact-ordered index, read score at a time.

A term's impact in a document is its weight w times t = (10**9 * tf) div (1000 * tf + 20 * m), with m from the document's
length and the corpus's mean. Documents are indexed in blocks; in a block each term has its documents grouped by exact t,
the highest first, so that groups of all terms of an item, taken by descending impact, add up scores from the top. For every
item a task carries the k best scores over the blocks it reads. Reading a block's groups ends only when the sum of each
term's next impact proves that no more than k documents can still reach the k-th score known so far; the scores of
these are then completed from the rest of the groups. No posting leaves its block, and no corpus-wide list is built.

Defined cases: a null or empty text has no terms, isn't counted in N and is never returned; an item without known terms
gives no rows. Every row is a document, and every row of the items an item, of its own, whatever its id. Equal scores come by
ascending doc_id, null last. Texts of any length are read in pieces. Empty tables give no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.blocks import best, blocks, ids_of, met, unpacked
from strideline.llm.common import arrow_flat, arrow_map, dropped, written

#: Terms are maximal runs of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The same over UTF-8 bytes: other ASCII becomes a space, A-Z is lower-cased.
_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

#: Bytes of text in a block of the index, bytes read into terms at once, and items in a block of queries.
BLOCK_BYTES, PIECE_BYTES, ASKED = 4 << 20, 1 << 20, 64

#: Shares of an item's postings after which the bounds are looked at.
STEPS = (1 / 16, 1 / 8, 1 / 4, 1 / 2)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    at = 0
    plain = text.translate(_BYTES)
    while at < len(plain):
        end = plain.find(b" ", at + PIECE_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def block(ids: dict[str, np.ndarray], known: dict[bytes, int], codes: list[np.ndarray], docs: list[np.ndarray], total: int, held: int) -> dict[str, np.ndarray]:
    """An index block: `groups[i] : groups[i + 1]` are term i's groups by descending t, `docs[starts[g] : starts[g + 1]]` a group's documents."""
    n = len(ids["ids"])
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    key, tf = np.unique((np.concatenate(codes) if codes else doc) * n + doc, return_counts=True)
    code, doc = key // n, key % n
    length = np.bincount(doc, weights=tf, minlength=n).astype(np.int64)
    m = 100 - 50 + (50 * length * held) // total
    t = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
    order = np.lexsort((doc, -t, code))
    code, t, doc = code[order], t[order], doc[order]
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (t[1:] != t[:-1])])
    starts = np.nonzero(new)[0]
    ends = np.cumsum([len(w) for w in known])
    return ids | {
        "text": np.frombuffer(b"".join(known), np.uint8),
        "ends": ends.astype(np.int32),
        "groups": np.searchsorted(code[starts], np.arange(len(known) + 1)).astype(np.int32),
        "t": t[starts].astype(np.int32),
        "starts": np.concatenate([starts, [len(doc)]]).astype(np.int32),
        "docs": doc.astype(np.uint16 if n <= 1 << 16 else np.uint32),
    }


def vocabulary(held: dict[str, np.ndarray]) -> list[bytes]:
    text, ends = held["text"].tobytes(), held["ends"].tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class Index:
    """The written blocks of an index, the documents with a term (`held`) and the length of all (`total`)."""

    def __init__(self, blocks_: DataFrame, held: int, total: int):
        self.blocks, self.held, self.total = blocks_, held, total

    def weights(self) -> DataFrame:
        """(term, w) of all terms, with how many documents hold it."""
        def make():
            def rows(bodies):
                found = [unpacked(b) for b in bodies]
                words = [w.decode() for b in found for w in vocabulary(b)]
                counts = [np.diff(b["starts"][b["groups"]].astype(np.int64)) for b in found]
                return [words, np.concatenate(counts)]

            return rows

        df = arrow_flat(self.blocks, ["body"], [("term", "string"), ("df", "long")], make, by="body").groupBy("term").agg(F.sum("df").alias("df"))
        return df.withColumn("w", F.floor(1000 * F.log(F.lit(2.0 * self.held + 2) / (2 * F.col("df") + 1))).cast("long"))


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """An index of all terms of all texts."""
    used = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def counter():
        return lambda texts: [[sum(map(len, terms((t or "").encode()))) for t in texts]]

    lengths = arrow_map(used, [], ["text"], [("n", "long")], counter)
    held, total = lengths.agg(F.expr("count_if(n > 0)"), F.sum("n")).first()

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
            ids, known, codes, numbers, size, n = [], {}, [], [], 0, 0

            def closed():
                joined = {k: np.concatenate([i[k] for i in ids]) for k in ids[0]}
                return block(joined, known, codes, numbers, total, held)

            for batch in batches:
                texts, own = batch.column("text"), ids_of(batch.column("id"))
                rows = []
                for i in range(batch.num_rows):
                    raw = texts[i].as_buffer()
                    before = len(codes)
                    for some in terms(raw.to_pybytes() if raw is not None else b""):
                        if some:
                            codes.append(np.fromiter((known.setdefault(w, len(known)) for w in some), np.int64, len(some)))
                            numbers.append(np.full(len(some), n))
                    if len(codes) > before:
                        rows.append(i)
                        n += 1
                        size += len(raw)
                    if size >= BLOCK_BYTES:
                        ids.append({k: v[rows] for k, v in own.items()})
                        yield closed()
                        ids, known, codes, numbers, size, n, rows = [], {}, [], [], 0, 0, []
                if rows:
                    ids.append({k: v[rows] for k, v in own.items()})
            if n:
                yield closed()

        return run

    return Index(blocks(used.where("text is not null"), make, "impacts"), held or 0, total or 0)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places `starts[i]` to `starts[i] + lengths[i]`, one range after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def top(held: dict[str, np.ndarray], codes: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block, and their whole scores, that hold all that belong to its k best of at least `floor`."""
    first, last = held["groups"][codes].astype(np.int64), held["groups"][codes + 1].astype(np.int64)
    group = spread(first, last - first)
    term = np.repeat(np.arange(len(codes)), last - first)
    impact = weights[term] * held["t"][group]
    order = np.argsort(-impact, kind="stable")
    group, term, impact = group[order], term[order], impact[order]
    size = (held["starts"][group + 1] - held["starts"][group]).astype(np.int64)
    read = np.cumsum(size)
    score = np.zeros(len(held["ids"]), np.int64)
    heads = [*zip(first.tolist(), last.tolist())]
    done, at = np.zeros(len(codes), np.int64), 0

    def add(a: int, b: int, among: np.ndarray | None = None) -> None:
        docs, more = held["docs"][spread(held["starts"][group[a:b]].astype(np.int64), size[a:b])], np.repeat(impact[a:b], size[a:b])
        if among is not None:
            docs, more = docs[among[docs]], more[among[docs]]
        np.add.at(score, docs, more)

    for share in (0, *STEPS, 1):
        to = int(np.searchsorted(read, share * read[-1])) if share < 1 else len(group)
        while 0 < to < len(group) and impact[to] == impact[to - 1]:  # groups of one impact go together
            to += 1
        if to > at:
            add(at, to)
            done += np.bincount(term[at:to], minlength=len(codes))
            at = to
        rest = sum(int(w) * int(held["t"][a + d]) for (a, z), d, w in zip(heads, done.tolist(), weights.tolist()) if a + d < z)
        least = max(floor, kth(score, k))
        if rest < max(least, 1):
            open_ = (score > 0) & (score + rest >= least)
            if at == len(group) or int(open_.sum()) <= k:
                break
    if at < len(group) and open_.any():
        add(at, len(group), open_)
    docs = np.nonzero(open_)[0]
    return docs, score[docs]


def queries(items: DataFrame, weights: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, key, words, w): the known terms of each item, once each, with their weights."""
    used = items.select(F.col(item_id).alias("item"), F.monotonically_increasing_id().alias("key"), F.col(text).alias("text"))
    used = written(used, "items")  # keys must stay the same

    def make():
        def rows(keys, texts):
            own = [(k, w.decode()) for k, t in zip(keys, texts) for w in dict.fromkeys(w for some in terms((t or "").encode()) for w in some)]
            return [[k for k, _ in own], [w for _, w in own]]

        return rows

    own = arrow_flat(used, ["key", "text"], [("key", "long"), ("term", "string")], make).join(weights.where("w > 0").select("term", "w"), "term")
    own = own.groupBy("key").agg(F.collect_list(F.struct("term", "w")).alias("known"))
    return used.select("item", "key").join(own, "key").select("item", "key", F.col("known.term").alias("words"), F.col("known.w").alias("w"))


def ranked(index_: Index, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the `k` best documents of every item."""
    asked = written(queries(items, index_.weights(), item_id, text), "asked")

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
            for batch in batches:
                for a in range(0, batch.num_rows, ASKED):
                    part = batch.slice(a, ASKED)
                    words = [w.encode() for w in part.column("words").flatten().to_pylist()]
                    yield {
                        "keys": part.column("key").to_numpy(),
                        "counts": part.column("words").value_lengths().to_numpy().astype(np.int64),
                        "text": np.frombuffer(b"".join(words), np.uint8),
                        "ends": np.cumsum([len(w) for w in words]),
                        "w": part.column("w").flatten().to_numpy(),
                    }

        return run

    def answer(bodies: list[bytes]):
        wanted = []
        for body in map(unpacked, bodies):
            words, at = vocabulary(body), 0
            for key, n in zip(body["keys"].tolist(), body["counts"].tolist()):
                wanted.append((key, words[at : at + n], body["w"][at : at + n]))
                at += n
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def take(body: bytes) -> None:
            held = unpacked(body)
            place = {w: i for i, w in enumerate(vocabulary(held))}
            for key, words, w in wanted:
                codes = np.array([place.get(x, -1) for x in words], np.int64)
                there = codes >= 0
                if not there.any():
                    continue
                ids, none, scores = found.get(key) or (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
                docs, more = top(held, codes[there], w[there], k, int(scores[k - 1]) if len(scores) == k else 0)
                if len(docs):
                    ids, none, scores = (np.concatenate(p) for p in ((ids, held["ids"][docs]), (none, held["none"][docs]), (scores, more)))
                    order = np.lexsort((ids, none, -scores))[:k]
                    found[key] = ids[order], none[order], scores[order]

        def give() -> pa.RecordBatch:
            none = [np.zeros(0, t) for t in (np.int64, bool, np.int64)]
            ids, missing, scores = (np.concatenate(c) for c in zip(none, *found.values()))
            keys = np.repeat(np.fromiter(found, np.int64, len(found)), [len(s) for _, _, s in found.values()])
            return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "doc_id": pa.array(ids, mask=missing), "score": scores})

        return take, give

    blocks_ = blocks(asked.select("key", "words", "w"), make, "queries")
    found = written(met(index_.blocks, blocks_, answer, "key long, doc_id long, score long"), "found")
    dropped(blocks_)
    rows = best(found, ["key"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    return rows.join(asked.select(F.col("item").alias("item_id"), "key"), "key").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """`ranked` over a new index of `docs`."""
    made = index(docs)
    out = ranked(made, items, k)
    dropped(made.blocks)
    return out
