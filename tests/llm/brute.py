"""Plain versions of the operators' definitions, without Spark, numpy or the operators' own code."""

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    """The contract's counts, and every count that rules may test."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            cover[i : i + 3] = [True] * 3
    seen, dup, full = set(), 0, 0
    for line in text.split("\n"):
        if WORD.findall(line):
            full += 1
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": sum(cover), "n_lines": full,
        "n_upper": sum(c.isupper() for c in text), "n_letters": sum(c.isalpha() for c in text), "n_digits": sum(c.isdecimal() for c in text), "n_marks": text.count("!") + text.count("?"),
        "n_distinct_words": len(set(words)), "n_chars": len(text),
    }


def base_failed(s):
    return s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]


def kept(s, rules, ratios):
    """A list's verdict: the first rule whose conditions all hold rejects."""
    value = {name: s[top] / s[low] if s[low] else 0.0 for name, top, low in ratios}
    hit = any(all((value[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)
    return not base_failed(s) and not hit


def shingles(text):
    """The multiset of five-word shingles; fewer words are one."""
    words = WORD.findall(text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def links(texts, least=0.8):
    """Pairs of places whose shingles are alike enough, of all pairs that share one at all."""
    sets = [shingles(t) for t in texts]
    size = [sum(s.values()) for s in sets]
    holders, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for k, n in s.items():
            for j, m in holders[k]:
                common[j, i] += min(n, m)
            holders[k].append((i, n))
    return {p for p, c in common.items() if c >= least * (size[p[0]] + size[p[1]] - c)}


def classes(n, pairs):
    """The smallest place of each place's class."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def bytes_kept(texts, window=100):
    """(bytes kept, removed, runs) of each text in order, without what an earlier string of `window` bytes covers."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            piece = raw[i : i + window]
            if piece in seen:
                cover[i : i + window] = b"\1" * window
            seen.add(piece)
        out.append((bytes(b for b, c in zip(raw, cover) if not c), sum(cover), sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))))
    return out


def best_fit_decreasing(sizes, capacity):
    """Sequences that best fit opens, piece by piece, the longest first."""
    gaps, opened = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect_left(gaps, s)
        if at == len(gaps):
            opened += 1
            left = capacity - s
        else:
            left = gaps.pop(at) - s
        insort(gaps, left)
    return opened


def pieces(text, tokenizer, capacity=2048):
    """(piece, start, length, ids_crc32) of one document."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids), capacity), len(ids)]
    return [(k, a, z - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:z]))) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]


def media(text):
    """(n_bytes, payload_bytes, payload_sha256, tail_crc32) and the payload."""
    raw = (text or "").encode()
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])), payload


def words_kept(texts, window=35):
    """(n_words, n_removed, kept words joined) of each text: words in windows whose word sequence starts twice anywhere are removed."""
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            count[k] = count.get(k, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out
