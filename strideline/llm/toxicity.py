"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Words lose the signs inside them first; then two strings are alike as they share subsequences of 4 characters, gaps discounted, so that an insult with
characters put between its own stays close to itself. A sentence is the bag of its units (words, or runs of single
characters), its margin the largest of theirs: the machine is trained on sentences of labelled documents
by choosing toxic sentences' witnesses, fitting a squared-hinge machine on Nyström features of units, and choosing
again. A document's score is the calibrated largest margin over all its sentences, which is the largest over all units.

Defined cases: a null or empty text has no unit and gets the score of the bias alone; null labels are ignored, of contradicting ones of an id toxic holds; with no
labelled example of one class every score is the other class's, and with no string that tells the classes apart it is 0; repeated rows are scored one by one; other columns pass
through untouched in `clean`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import arrow_map, numbered

#: Labelled documents that the machine is trained on, at most about so many of each class; a hash of the id chooses them.
TOXIC_DOCS, OTHER_DOCS = 1_000, 1_500
#: Landmarks that stand for toxic units and for ordinary ones.
TOXIC_LANDMARKS, PLAIN_LANDMARKS = 24, 4
#: Log lift of a unit's pieces in toxic documents from which it is a witness at once.
SURE = 3.5
#: Decay of a gap; characters in a subsequence.
DECAY, ORDER = 0.6, 4
#: Longer units are no landmarks.
LANDMARK_CHARS = 10
#: Longer units are seen through overlapping windows of this length.
WINDOW = 24
#: Units that a worker keeps with their margins.
CACHE_ENTRIES = 300_000
#: From this score on a text counts as toxic.
THRESHOLD = 0.3

_SIGNS = "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”‘’…¡¿–—·•"
_DROP = str.maketrans("", "", _SIGNS)
#: Signs and digits that stand for letters in words that hold both.
_LETTERS = str.maketrans("013457@$", "oieastas")
_SINGLES = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def plain_unit(word: str) -> str:
    """A lower-cased word without signs; digits among letters are read as the letters that they stand for."""
    if not word.isalpha():
        word = word.translate(_DROP)
        if not word.isalpha() and not word.isdigit():
            word = word.translate(_LETTERS)
    return word


def units(text: str) -> set[str]:
    """Distinct units of a text: its words, and runs of single characters as one word."""
    text = text.lower()
    out = set(map(plain_unit, set(text.split())))
    for run in _SINGLES.findall(text):
        out.add(plain_unit("".join(run.split())))
    out.discard("")
    return out


def windows(unit: str) -> list[str]:
    """The unit, or overlapping windows that cover it."""
    if len(unit) <= WINDOW:
        return [unit]
    step = WINDOW // 2
    return [unit[i : i + WINDOW] for i in range(0, len(unit) - step, step)]


def codes(strings: list[str], pad: int, width: int = 0) -> np.ndarray:
    width = max(width, max(map(len, strings), default=1))
    out = np.full((len(strings), width), pad, np.int32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le"), np.int32)
    return out


def decays(width: int, decay: float = DECAY) -> np.ndarray:
    """What a match at place j adds to the prefixes that end before place k > j: decay to the power k - j + 1."""
    gap = np.arange(width)[None, :] - np.arange(width)[:, None]
    return np.where(gap > 0, decay ** (gap + 1.0), 0.0).astype(np.float32)


def subsequence(s: np.ndarray, t: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of ORDER, row by row: s (n, a) against t (n, b), whose pads differ and match nothing.

    `open_[i]` holds the weights of common subsequences of i characters that a later match may extend, for each prefix of t.
    """
    n, b = t.shape
    spread, square = decays(b, decay), np.float32(decay * decay)
    total = np.zeros(n, np.float32)
    open_ = [None] + [np.zeros((n, b), np.float32) for _ in range(ORDER - 1)]
    for a in range(s.shape[1]):
        hit = (s[:, a, None] == t).astype(np.float32)
        for i in range(ORDER, 0, -1):
            gain = hit * open_[i - 1] if i > 1 else hit
            if i == ORDER:
                total += square * gain.sum(axis=1)
            else:
                open_[i] *= np.float32(decay)
                open_[i] += gain @ spread
    return total


def by_chunks(s: np.ndarray, t: np.ndarray, size: int = 4096) -> np.ndarray:
    """`subsequence` over any number of rows, those of like length together."""
    out = np.zeros(len(s))
    length = (s >= 0).sum(axis=1)
    order = np.argsort(length, kind="stable")
    for k in range(0, len(order), size):
        part = order[k : k + size]
        width = int(length[part[-1]])
        other = t[part]
        out[part] = subsequence(s[part, :width], other[:, : max(1, int((other >= 0).sum(axis=1).max()))])
    return out


class Landmarks:
    """Strings that stand for a kernel: kernels against them all, computed only where a common subsequence is long enough."""

    FIELD = 16  # bits for one string in the packed words, the highest left free for carries

    def __init__(self, marks: list[str]):
        self.marks = marks
        self.codes = codes(marks, -2)
        self.letters = np.array(sorted({ord(c) for m in marks for c in m}), np.int32)
        per = 64 // self.FIELD
        self.words = -(-len(marks) // per)
        self.full = np.zeros(self.words, np.uint64)
        self.match = np.zeros((len(self.letters) + 1, self.words), np.uint64)
        for j, m in enumerate(marks):
            for k, c in enumerate(m):
                bit = np.uint64(1 << (j % per * self.FIELD + k))
                self.full[j // per] |= bit
                self.match[int(np.searchsorted(self.letters, ord(c))), j // per] |= bit
        own = self.codes.copy()
        own[own < 0] = -1
        self.own = by_chunks(own, self.codes)

    def common(self, s: np.ndarray) -> np.ndarray:
        """Lengths of longest common subsequences, (n, m), many strings in one machine word."""
        at = np.minimum(np.searchsorted(self.letters, s), len(self.letters) - 1)
        at = np.where(self.letters[at] == s, at, len(self.letters))
        v = np.repeat(self.full[None, :], len(s), axis=0)
        for a in range(s.shape[1]):
            m = self.match[at[:, a]]
            v = ((v + (v & m)) | (v & ~m)) & self.full
        left = np.bitwise_count(v.view(np.uint16)).astype(np.int64)[:, : len(self.marks)]
        return np.array([len(m) for m in self.marks]) - left

    def kernel(self, strings: list[str]) -> np.ndarray:
        """Normalised kernels, (n, m)."""
        out = np.zeros((len(strings), len(self.marks)))
        for k in range(0, len(strings), 20_000):
            s = codes(strings[k : k + 20_000], -1)
            i, j = np.nonzero(self.common(s) >= ORDER)
            if not len(i):
                continue
            rows, back = np.unique(i, return_inverse=True)
            t = np.where(s[rows] < 0, -2, s[rows])
            scale = np.sqrt(by_chunks(s[rows], t)[back] * self.own[j])
            out[k + i, j] = np.divide(by_chunks(s[i], self.codes[j]), scale, out=np.zeros(len(i)), where=scale > 0)
        return out


@dataclass
class Machine:
    landmarks: Landmarks
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    cache: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def features(self, strings: list[str]) -> np.ndarray:
        return self.landmarks.kernel(strings) @ self.whiten

    def margins(self, strings: list[str]) -> list[float]:
        """Margin of each unit; long ones take their best window's."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        fresh = [u for u in dict.fromkeys(strings) if u not in self.cache]
        short = [u for u in fresh if len(u) <= WINDOW]
        if short:
            self.cache.update(zip(short, (self.features(short) @ self.weights + self.bias).tolist()))
        for u in fresh:
            if len(u) > WINDOW:
                self.cache[u] = float((self.features(windows(u)) @ self.weights + self.bias).max())
        return [self.cache[u] for u in strings]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [units(t or "") for t in texts]
        every = list(set().union(*found)) if found else []
        known = dict(zip(every, self.margins(every)))
        best = np.array([max(map(known.__getitem__, f), default=self.bias) for f in found], float)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 3.0) -> tuple[np.ndarray, float]:
    """A primal Newton solution of the L2 squared-hinge machine."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    goal = lambda v: 0.5 * v @ ridge @ v + cost * (weight * np.maximum(0, 1 - y * (z @ v)) ** 2).sum()
    for _ in range(50):
        active = y * (z @ w) < 1
        c = cost * 2 * weight * active
        step = np.linalg.solve(ridge + (z * c[:, None]).T @ z, ridge @ w + (z * c[:, None]).T @ (z @ w - y))
        size = 1.0
        while size > 1e-4 and goal(w - size * step) > goal(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def calibrated(best: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the largest margins, with smoothed targets."""
    p, n = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (p + 1) / (p + 2), 1 / (n + 2))
    z = np.stack([best, np.ones_like(best)], axis=1)
    w = np.array([4.0, 0.0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (q * (1 - q) + 1e-6)[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (q - target) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def variants(unit: str) -> list[str]:
    """A unit with characters put between its own: the forms that training adds to its witnesses."""
    r = zlib.crc32(unit.encode())
    at = 1 + r % max(1, len(unit) - 1)
    letter = "abcdefghijklmnopqrstuvwxyz"[r // 7 % 26]
    signs = (".", "-", "*", "_")
    return [signs[r % 4].join(unit), unit[:at] + letter + unit[at:], unit[:at] + signs[r // 3 % 4] + unit[at:], unit[:at] + unit[at - 1] + unit[at:]]


def grams(unit: str, n: int = 4) -> set[str]:
    return {unit[i : i + n] for i in range(len(unit) - n + 1)} if len(unit) > n else {unit}


def train(texts: list[str], toxic: np.ndarray, rounds: int = 2) -> Machine | None:
    """Trains on labelled documents; None without examples of both classes."""
    if not toxic.any() or toxic.all():
        return None
    bags = [[units(s) for s in _SENTENCE.split(t)] for t in texts]
    docs = [set().union(*b) if b else set() for b in bags]
    with_gram: tuple[Counter, Counter] = (Counter(), Counter())
    with_unit: tuple[Counter, Counter] = (Counter(), Counter())
    for d, t in zip(docs, toxic):
        g = set().union(*map(grams, d)) if d else set()
        with_gram[int(t)].update(g)
        with_unit[int(t)].update(d)
    p, n = int(toxic.sum()), int((~toxic).sum())
    lift = {g: float(np.log((c + 0.1) / (p + 1)) - np.log((with_gram[0][g] + 0.5) / (n + 1))) for g, c in with_gram[1].items() if c >= 2}
    units_with: dict[str, list[str]] = defaultdict(list)
    for u in with_unit[1]:
        for g in grams(u):
            if lift.get(g, 0) > 1:
                units_with[g].append(u)
    # Landmarks: the pieces that mark toxic documents best, as the unit that mostly holds them or, for a stem, alone.
    marks: list[str] = []
    for g in sorted((g for g in lift if lift[g] >= 1.5), key=lambda g: (-lift[g] * with_gram[1][g], g)):
        if len(marks) == TOXIC_LANDMARKS:
            break
        if len(g) < ORDER or any(g in m for m in marks):
            continue
        u = max((u for u in units_with[g] if len(u) <= LANDMARK_CHARS), key=lambda u: (with_unit[1][u], -len(u), u), default=g)
        u = u if 2 * with_unit[1][u] > with_gram[1][g] else g
        if not any(m in u for m in marks):
            marks.append(u)
    plain = [u for u, _ in sorted(with_unit[0].items(), key=lambda x: (-x[1], x[0])) if ORDER <= len(u) <= LANDMARK_CHARS][:PLAIN_LANDMARKS]
    marks = (marks or [u for u, _ in with_unit[1].most_common(4) if ORDER <= len(u) <= LANDMARK_CHARS]) + [u for u in plain if u not in marks]
    if not marks:
        return None
    square = Landmarks(marks).kernel(marks)
    value, vector = np.linalg.eigh((square + square.T) / 2)
    keep = value > 1e-6
    machine = Machine(Landmarks(marks), vector[:, keep] / np.sqrt(value[keep]), np.zeros(int(keep.sum())), 0.0)
    # Bags: a toxic document's sentences with a candidate; every unit of the other documents is negative.
    others = sorted(u for u in with_unit[0] if len(u) <= WINDOW)
    x0 = machine.features(others)
    w0 = np.array([with_unit[0][u] for u in others], float) ** 0.5
    weight_of = {u: max((lift.get(g, 0.0) for g in grams(u)), default=0.0) for u in with_unit[1] if u not in with_unit[0]}
    weigh = lambda u: weight_of.get(u, 0.0)
    sentences = [s for i in np.nonzero(toxic)[0] for s in bags[i] if s]
    doc_best = [[max((u for u in docs[i]), key=lambda u: (weigh(u), u))] for i in np.nonzero(toxic)[0] if docs[i]]
    sure = [{u for u in s if weigh(u) >= SURE} for s in sentences] + [set(d) for d in doc_best]
    for _ in range(rounds):
        witness = Counter(w for s in sure for u in s for w in windows(u)[:1])
        chosen = sorted(u for u in witness if u not in with_unit[0])
        if not chosen:
            return None
        extra = [v for u in chosen for v in variants(u) if len(v) <= WINDOW and v not in with_unit[0]]
        x1 = machine.features(chosen + extra)
        w1 = np.concatenate([np.array([witness[u] for u in chosen], float) ** 0.5, np.full(len(extra), 0.8)])
        x, y = np.vstack([x1, x0]), np.concatenate([np.ones(len(x1)), -np.ones(len(x0))])
        weight = np.concatenate([w1 / w1.mean(), w0 / w0.mean()])
        machine.weights, machine.bias = squared_hinge(x, y, weight)
        machine.cache.clear()
        every = list(set().union(*sentences))
        margin = dict(zip(every, machine.margins(every)))
        again = [{u for u in s if margin[u] > 0 or weigh(u) >= SURE} for s in sentences]
        sure = again if any(again) else sure
    machine.cache.clear()
    every = list(set().union(*docs))
    margin = dict(zip(every, machine.margins(every)))
    best = np.array([max(map(margin.__getitem__, d), default=machine.bias) for d in docs])
    machine.slope, machine.shift = calibrated(best, toxic)
    machine.cache.clear()
    return machine


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Machine | None, float]:
    """The machine of the labelled documents that aren't held out, and the toxic share of those it was trained on."""
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select(F.col("doc_id").alias("_label_id"), (F.col("toxic") == 1).alias("_toxic"))
    marks = marks.groupBy("_label_id").agg(F.max("_toxic").alias("_toxic"))
    n = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = 1 << 20
    place = F.pmod(F.xxhash64("_label_id"), F.lit(full))
    cut = lambda k, most: int(min(1.0, most / max(1, n.get(k, 0))) * full)
    chosen = marks.where(place < F.when(F.col("_toxic"), F.lit(cut(True, TOXIC_DOCS))).otherwise(F.lit(cut(False, OTHER_DOCS))))
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    rows = plain.join(F.broadcast(chosen.limit(2 * (TOXIC_DOCS + OTHER_DOCS))), F.col("_id") == F.col("_label_id"))
    rows = rows.select("_label_id", "_toxic", "_text").limit(2 * (TOXIC_DOCS + OTHER_DOCS)).collect()
    rows = sorted(rows, key=lambda r: (r["_label_id"], r["_text"]))
    toxic = np.array([r["_toxic"] for r in rows], bool)
    machine = train([r["_text"] for r in rows], toxic)
    # Without a machine: one class alone gives its score; two that no string tells apart mark nothing.
    return machine, float(len(toxic) > 0 and toxic.all())


def _scorer(machine: Machine | None, share: float, shared):
    def make():
        model = machine if shared is None else shared.value
        if model is None:
            return lambda texts: ([share] * len(texts),)
        return lambda texts: (model.scores(texts),)

    return make


def _scored(docs: DataFrame, keep: list[str], text: str, name: str, machine: Machine | None, share: float) -> DataFrame:
    shared = None if machine is None else docs.sparkSession.sparkContext.broadcast(machine)  # a few kB, by its landmarks' number
    return arrow_map(docs, keep, [text], [(name, "double")], _scorer(None, share, shared), by=text)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    machine, share = fitted(docs, labels, doc_id, text)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = _scored(plain, ["doc_id"], "text", "score", machine, share)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that don't count as toxic, all columns as they were; all rows, where the labels teach nothing."""
    plain, (i, t) = numbered(docs, doc_id, text)
    machine, share = fitted(plain, labels, i, t)
    if machine is None:
        return docs
    return _scored(plain, plain.columns, t, "score", machine, share).where(F.col("score") < THRESHOLD).select(*plain.columns).toDF(*docs.columns)
