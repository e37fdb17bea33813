"""Quality rules: a learned decision list over text statistics.

Statistics are computed in one pass over whole texts. Sequential covering then learns, from a bounded sample of labelled
statistics, ordered rules that reject: a rule grows by the threshold condition of highest information gain, is pruned
against held-back rows, and is kept only while it is precise there; rows that it covers leave the sample. The list comes
out as one Spark conditional expression, so that applying it is a projection.

Defined cases: a null or empty text has no words, fails the base rules and isn't kept; null labels and labels of unknown
documents are ignored; without usable labels the list is empty and every text that passes the base rules is kept;
repeated rows are judged one by one; other columns pass through untouched in `judged`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import WORD, arrow_map, numbered, written

#: Labelled rows that the list is learned from, at most; a hash of the document's id chooses them.
SAMPLE_ROWS = 20_000

#: The counted statistics, in the order that `text_statistics` returns them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct_words", "n_chars")

#: What conditions may test: name, numerator, denominator.
RATIOS = (
    ("mean_word", "word_chars", "n_words"),
    ("symbol_share", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "n_letters"),
    ("digit_share", "n_digits", "n_chars"),
    ("mark_share", "n_marks", "n_chars"),
    ("letter_share", "n_letters", "n_chars"),
    ("distinct_share", "n_distinct_words", "n_words"),
    ("line_words", "n_words", "n_lines"),
)
FEATURES = tuple(r[0] for r in RATIOS)

_SYMBOLS = "#*$%&|<>"
_MARKS = "!?"


def text_statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeated = 0
    if n >= 3:
        v = np.int64(len(known))
        _, pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
        again = times[window] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= again
        repeated = int(cover.sum())
    lines = text.split("\n")
    seen: set[str] = set()
    full = dup = 0
    for line in lines:
        if WORD.search(line):
            full += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    if text.isascii():
        codes = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
        upper, lower, digits = int(codes[65:91].sum()), int(codes[97:123].sum()), int(codes[48:58].sum())
        letters = upper + lower
    else:
        low = text.lower()
        upper = sum(map(str.isupper, text)) if low != text else 0
        letters, digits = sum(map(str.isalpha, text)), sum(map(str.isdecimal, text))
    symbols, marks = sum(map(text.count, _SYMBOLS)), sum(map(text.count, _MARKS))
    return n, sum(map(len, words)), symbols, dup, repeated, full, upper, letters, digits, marks, len(known), len(text)


def statistics(docs: DataFrame, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """The columns `keep` of `docs` and COUNTS of each whole text."""

    def make():
        return lambda texts: list(zip(*map(text_statistics, texts))) if texts else [[] for _ in COUNTS]

    return arrow_map(docs, keep, [text], [(prefix + c, "long") for c in COUNTS], make, by=text)


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def ratio(name: str, prefix: str = "") -> Column:
    """A feature as a Spark expression; 0 where its denominator is 0."""
    _, top, low = next(r for r in RATIOS if r[0] == name)
    return F.coalesce(F.try_divide(F.col(prefix + top).cast("double"), F.col(prefix + low)), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def grow(x: dict[str, np.ndarray], bad: np.ndarray, depth: int = 4, cuts: int = 48) -> Rule:
    """Adds the condition of highest information gain until no good row is covered, or nothing is gained."""
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < depth:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for name, v in x.items():
            values = np.unique(v[inside])
            if len(values) < 2:
                continue
            cut = np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, cuts)))
            order = np.argsort(v[inside], kind="stable")
            ranked, y = v[inside][order], bad[inside][order]
            at = np.searchsorted(ranked, cut, side="right")
            p_low = np.concatenate([[0], np.cumsum(y)])[at]
            n_low = at - p_low
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, above, float(cut[k])), float(g[k])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on held-back rows: (bad - good) / covered, the shorter of equals."""
    best, worth = rule, -2.0
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k], x, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth:
            best, worth = rule[:k], value
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = 0.97, least: int = 5, rules: int = 12) -> list[Rule]:
    """Sequential covering: `fold` marks the rows held back for pruning; a rule must be `precise` on each part."""
    out: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = lambda m: {k: v[m] for k, v in x.items()}
    while len(out) < rules and (left & bad & ~fold).sum() >= least:
        g, h = left & ~fold, left & fold
        rule = grow(part(g), bad[g])
        if not rule:
            break
        rule = prune(rule, part(h), bad[h]) if (h & bad).any() else rule
        hit = covers(rule, x, len(bad)) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        ph, nh = int((hit & bad & fold).sum()), int((hit & ~bad & fold).sum())
        if p < least or p < precision * (p + n) or ph < precision * (ph + nh) - 1e-9:
            break
        out.append(rule)
        left &= ~hit
    return out


def expression(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one ordered conditional: true where a text is kept."""
    verdict = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            v = ratio(c.feature, prefix)
            test = test & ((v > c.threshold) if c.above else (v <= c.threshold))
        verdict = F.when(test, F.lit(False)) if verdict is None else verdict.when(test, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def fitted(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", prefix: str = "", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns the list from at most about `rows` labelled documents that pass the base rules."""
    marks = labels.select(F.col("doc_id").alias("_label_id"), (F.col("quality") == 0).alias("_bad")).where("_label_id is not null and _bad is not null")
    known = stats.where(~base_failed(prefix)).join(marks, F.col(doc_id) == F.col("_label_id"))
    n = known.count()
    if not n:
        return []
    share = min(1.0, rows / n)
    sample = known.where(F.pmod(F.xxhash64("_label_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(2 * rows)
    pdf = sample.select("_label_id", "_bad", *(ratio(f, prefix).alias(f) for f in FEATURES)).toPandas().sort_values("_label_id")
    x = {f: pdf[f].to_numpy(float) for f in FEATURES}
    ids = pdf["_label_id"].to_numpy(np.int64)
    fold = (ids * 2654435761 % (1 << 32)) % 3 == 0
    return learn(x, pdf["_bad"].to_numpy(bool), fold)


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every document."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stats = written(statistics(plain, ["doc_id"]), "quality")
    rules = fitted(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & expression(rules))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, all columns as they were."""
    plain, (i, t) = numbered(docs, doc_id, text)
    stats = written(statistics(plain, plain.columns, t), "quality")
    rules = fitted(stats, labels, i)
    return stats.where(~base_failed() & expression(rules)).select(*plain.columns).toDF(*docs.columns)
