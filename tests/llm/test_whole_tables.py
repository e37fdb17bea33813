"""The registered queries over whole small tables, against plain versions of their definitions."""

import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strideline.llm import media_gif, quality_rules, toxicity
from strideline.llm.common import table
from strideline.llm.queries import QUERIES
import brute

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no generated tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, str(DATA), "documents").collect()}


def test_op1(spark, texts):
    rows = QUERIES["op1_quality_rules"](spark, str(DATA)).collect()
    docs = table(spark, str(DATA), "documents")
    rules = quality_rules.fitted(quality_rules.statistics(docs, ["doc_id"]), table(spark, str(DATA), "labels"))
    assert len(rows) == len(texts)
    for r in rows:
        s = brute.quality(texts[r["doc_id"]])
        assert all(r[c] == s[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] == brute.base_failed(s) and r["kept"] == brute.kept(s, rules, quality_rules.RATIOS)


def test_op2(spark, texts):
    """The fold, the threshold, and scores that labels of the held-out fold can't move."""
    docs, labels = table(spark, str(DATA), "documents"), table(spark, str(DATA), "labels")
    rows = {r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, str(DATA)).collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in rows.items()}


def test_op2_on_held_out_labels(spark):
    """About one label in twenty marks a text as toxic that has no insult at all; these can't be learned, so recall isn't asked for."""
    data = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, data, "labels").where("toxic is not null").collect()}
    rows = [(r["predicted"], truth[r["doc_id"]]) for r in QUERIES["op2_toxicity"](spark, data).collect() if r["held_out"] and r["doc_id"] in truth]
    marked = [t for p, t in rows if p]
    assert sum(p == t for p, t in rows) >= 0.92 * len(rows) and len(marked) >= 5 and sum(marked) >= 0.95 * len(marked)


def test_op5(spark, texts):
    rows = QUERIES["op5_media_gif"](spark, str(DATA)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        digest, payload = brute.media(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == digest
        stored = media_gif.encode(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        # A grey pixel's two high bits stand for each of its colours.
        bins = Counter(21 * (b >> 6) for b in payload)
        area = 64 * media_gif.ROWS
        if len(payload) > area:
            # Every frame shows the screen as it is then: a last frame of fewer rows leaves the rest of the one before.
            screen, bins = bytearray(payload[:area]), Counter()
            for a in range(0, len(payload), area):
                part = payload[a : a + area]
                screen[: len(part)] = part
                bins.update(21 * (b >> 6) for b in screen)
        assert r["feature"].endswith("hist=" + "-".join(f"{k}:{bins[k]}" for k in sorted(bins)))
        assert sum(sum(f["histogram"]) for f in r["frames"]) == sum(bins.values())


def test_op6(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = QUERIES["op6_best_fit_packing"](spark, str(DATA)).collect()
    want = Counter((i, *p) for i, t in texts.items() for p in brute.pieces(t, library))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= 2048
    sizes = [r["length"] for r in rows]
    assert -(-sum(sizes) // 2048) <= len(by_sequence) <= brute.best_fit_decreasing(sizes, 2048)


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = QUERIES["op4_token_counts"](spark, str(DATA)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 2048)


def test_op8(spark, texts):
    ids = sorted(texts)
    rows = {r["doc_id"]: r for r in QUERIES["op8_substring_dedup"](spark, str(DATA)).collect()}
    removed = 0
    for i, (n, gone, kept) in zip(ids, brute.words_kept([texts[i] for i in ids])):
        r = rows[i]
        removed += gone
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    assert removed


def test_op9(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op9_suffix_dedup"](spark, str(DATA)).collect()}
    ids = sorted(texts)
    for i, (kept, removed, runs) in zip(ids, brute.bytes_kept([texts[i] for i in ids])):
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len((texts[i] or "").encode()), removed, runs, hashlib.sha256(kept).hexdigest())


def test_op10_recall(spark):
    """Every pair of real documents that is alike enough lies in one class, and no class holds more than such links join."""
    data = "/root/testdata/sf0.01"
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, data, "documents").where("text is not null").collect())
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op10_minhash_near_dedup"](spark, data).collect()}
    pairs = brute.links([t for _, t in docs])
    found = sum(got[docs[i][0]] == got[docs[j][0]] for i, j in pairs)
    assert len(pairs) > 50 and found >= 0.9 * len(pairs)
    want = brute.classes(len(docs), pairs)
    assert sum(got[d] == docs[want[k]][0] for k, (d, t) in enumerate(docs) if t) >= 0.99 * len(docs)
