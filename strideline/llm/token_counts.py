"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one flat symbol array with sequence starts (ragged rows). In each round every
sequence finds its lowest-rank pair and applies it at all its non-overlapping places, all sequences at once; sequences
without a mergeable pair leave the batch. What survives is counted. Counts of pre-tokens are kept in a bounded
per-worker table, so that a frequent word is merged once.

Defined cases: a null or empty text has 0 tokens and 0 bytes; repeated rows each get their count; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import arrow_map

#: Entries of a worker's table of counted pre-tokens; when full it starts anew (only speed depends on it).
CACHE_ENTRIES = 300_000

#: The pre-tokens of this vocabulary family (letter runs, single digits, contractions, runs of other signs), longest
#: alternatives of different first characters in order of frequency; white space separates.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits that Unicode got after the version by which the vocabulary's library splits; there they are signs.
_NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB "
    "11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 "
    "3D000-3FC3F "
)
_NO = "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in _NEWER.split())
_ANY = regex.compile(rf"(?V1)[\p{{L}}--[{_NO}]]+|[\p{{N}}--[{_NO}]]|'(?:s|t|re|ve|m|ll|d)|[[^{_SPACE}\p{{L}}\p{{N}}]||[{_NO}]]+")
#: The same over lower-cased text below U+0250 without superscript digits and fractions, where letters are plain ranges.
_LOW = re.compile("[\\x00-\u024f]*")
_ODD = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be]")
_LETTER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NEAR = re.compile(rf"[{_LETTER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{_LETTER}0-9]+")


class WordBpe:
    """Counts tokens as a lower-casing word-end BPE file does; built from the vocabulary file's own fields."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.n_vocab = max(vocab.values()) + 1
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.n_vocab + vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into
        self.none = len(pairs)
        self.cache: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or `none`."""
        key = left * self.n_vocab + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def count_words(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        start = np.cumsum(length) - length
        symbols = self.inner[flat]
        last = start + length - 1
        symbols[last] = self.final[flat[last]]
        done = np.zeros(len(words), np.int64)
        owner = np.arange(len(words))
        rank = np.full(len(symbols), self.none, np.int64)
        if len(symbols) > 1:
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        rank[last] = self.none
        while len(owner):
            lowest = np.minimum.reduceat(rank, start)
            live = lowest < self.none
            if not live.all():
                done[owner[~live]] = length[~live]
                stay = np.repeat(live, length)
                symbols, rank = symbols[stay], rank[stay]
                owner, length, lowest = owner[live], length[live], lowest[live]
                if not len(owner):
                    break
                start = np.cumsum(length) - length
            hit = rank == np.repeat(lowest, length)
            # Of adjacent hits (the same symbol repeated) every second one is taken, from the left.
            at = np.nonzero(hit)[0]
            fresh = np.ones(len(at), bool)
            fresh[1:] = np.diff(at) > 1
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.into[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # a merged symbol takes over its right half's place at the end of a sequence
            gone = np.add.reduceat(~keep, start)
            place = (np.cumsum(keep) - 1)[at]
            symbols, rank = symbols[keep], rank[keep]
            length = length - gone
            start = np.cumsum(length) - length
            end = np.zeros(len(symbols), bool)
            end[start + length - 1] = True
            for p in (place[~end[place]], (place - 1)[place > 0]):
                p = p[~end[p]]
                rank[p] = self.rank(symbols[p], symbols[p + 1])
            rank[start + length - 1] = self.none
        return done

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def words(self, text: str) -> list[str]:
        text = self.normal(text)
        if text.isascii() or (_LOW.fullmatch(text) and not _ODD.search(text)):
            return _NEAR.findall(text)
        return _ANY.findall(text)

    def count(self, texts: list[str | None]) -> list[int]:
        found: list[list[str]] = []
        extra: list[int] = []
        for text in texts:
            text = text or ""
            parts, n = [text], 0
            if self.special:
                parts = self.special.split(text)
                n = len(parts) - 1
            words: list[str] = []
            for part in parts:
                words += self.words(part)
            found.append(words)
            extra.append(n)
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        missing: set[str] = set()
        for words in found:
            missing.update(words)
        fresh = [w for w in missing if w not in cache]
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            cache.update(zip(part, self.count_words(part).tolist()))
        get = cache.__getitem__
        return [sum(map(get, words)) + n for words, n in zip(found, extra)]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    named = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [named[b] if b in named else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; `path` is a vocabulary file that every node has."""

    def make():
        bpe = word_bpe(path)
        return lambda texts: ([len((t or "").encode()) for t in texts], bpe.count(texts))

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = arrow_map(plain, ["doc_id"], ["text"], [("n_bytes", "long"), ("n_tokens", "long")], make)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
