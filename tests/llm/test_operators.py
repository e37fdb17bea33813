"""The training-data operators against brute force, libraries and round trips, and on the cases that their docstrings define."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strideline.llm import media_gif, near_dup, packing, piece_sampling, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity, warc_fixity, windows
from strideline.llm.common import HASH_BLOCK, WORD, mix
from strideline.llm.windows import window_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, words long, packed string, g long, `_place` long, doc long, sub long, h long, _label_id long, n_words long, c0 string, `unit` int"


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns with names that operators use."""
    texts = ["plain words here", "", None, "plain words here", "x " * 3000, "é😀\x00 \n\t<|endoftext|>", "a\n\nb\n\na", " ", "word" * 500, " ".join(f"w{i * 7919 % 5000}" for i in range(60_000))]
    rows = [(i, t, None, None, None, 0.5, True, 1, "p", 2, 3, 4, 5, 6, 7, 8, "c", 9) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", *rows[0][2:]), (None, None, *rows[0][2:])], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, None), (None, 1, 1), (4, None, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")


def every_operator(spark, docs, marks):
    path = P.path
    yield "quality", quality_rules.quality(docs, marks)
    yield "toxicity", toxicity.toxicity(docs, marks)
    yield "tokens", token_counts.token_counts(docs, path("word_bpe_49k.json"))
    yield "gif", media_gif.stored_columns(docs)
    yield "pieces", piece_sampling.sampled(docs, path("piece_bpe_32k.model"))
    yield "words", substring_dedup.deduplicated(docs)
    yield "bytes", suffix_dedup.deduplicated(docs)
    yield "near", near_dup.near_duplicates(docs)


def test_defined_cases(spark):
    docs, marks = odd_docs(spark), labels(spark)
    n = docs.count()
    for name, out in every_operator(spark, docs, marks):
        rows = out.collect()
        assert len(rows) == n, name
        assert sum(r["doc_id"] is None for r in rows) == 2, name
    assert packing.best_fit(docs, P.path("byte_bpe_50k.json")).count() >= n
    for out in (quality_rules.judged(docs, marks), toxicity.clean(docs, marks), near_dup.kept(docs), suffix_dedup.trimmed(docs)):
        assert out.columns == docs.columns and out.schema == docs.schema
        out.collect()


def test_empty_tables(spark):
    docs, marks = odd_docs(spark).limit(0), labels(spark).limit(0)
    for name, out in every_operator(spark, docs, marks):
        assert out.count() == 0, name
    assert packing.best_fit(docs, P.path("byte_bpe_50k.json")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_fixity.page_audit(pages, F.lit(False)).count() == 0


# ---- quality rules


def brute_statistics(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            cover[i : i + 3] = [True] * 3
    seen, dup = [], 0
    for line in (text or "").split("\n"):
        if WORD.findall(line):
            dup += line in seen
            seen.append(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(cover)


def test_statistics():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "é", "ab ", "\x85"]) for _ in range(rng.randrange(60)))
        assert quality_rules.text_statistics(text)[:5] == brute_statistics(text)


def test_decision_list(spark):
    rng = np.random.default_rng(0)
    x = {f: rng.random(2000) for f in quality_rules.FEATURES}
    bad = ((x["symbol_share"] > 0.8) & (x["upper_share"] <= 0.5)) | (x["repeat_share"] > 0.95)
    rules = quality_rules.learn(x, bad, np.arange(2000) % 3 == 0)
    hit = np.zeros(2000, bool)
    for r in rules:
        hit |= quality_rules.covers(r, x, 2000)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() <= 0.02 * hit.sum()
    df = spark.createDataFrame([(10, 9), (10, 0)], "n_words long, n_symbols long")
    rule = [(quality_rules.Condition("symbol_share", True, 0.5),)]
    assert [r[0] for r in df.select(quality_rules.expression(rule)).collect()] == [False, True]
    assert quality_rules.learn({}, np.zeros(0, bool), np.zeros(0, bool)) == []


# ---- toxicity


def brute_kernel(s, t, p, decay):
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), p):
        for b in combinations(range(len(t)), p):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel():
    words = ["idiot", "idixot", "loser", "closers", "aaaa", "xyz", "scum"]
    marks = ["idiot", "loser", "aaaaa"]
    got = toxicity.Landmarks(marks).kernel(words)
    for i, s in enumerate(words):
        for j, t in enumerate(marks):
            k = lambda a, b: brute_kernel(a, b, toxicity.ORDER, toxicity.DECAY)
            scale = (k(s, s) * k(t, t)) ** 0.5
            assert got[i, j] == pytest.approx(k(s, t) / scale if scale else 0.0, abs=1e-5)


def test_machine():
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    text = lambda bad: " ".join(w for _ in range(5) for w in [*rng.choices(words, k=12), *([rng.choice(bad)] if bad else []), "end."])
    texts = [text(["moronic", "wretch"]) for _ in range(60)] + [text([]) for _ in range(200)]
    machine = toxicity.train(texts, np.arange(260) < 60)
    bad, good = [text(["moronic"]), text(["wretch"]), text(["w.r.e.t.c.h"]), text(["w r e t c h"])], [text([]) for _ in range(40)]
    assert (machine.scores(bad) >= toxicity.THRESHOLD).all() and (machine.scores(good) >= toxicity.THRESHOLD).mean() <= 0.05
    assert len(machine.scores([None, ""])) == 2 and toxicity.train(["a"], np.array([True])) is None


# ---- token counts


def test_token_counts():
    from tokenizers import Tokenizer

    mine, library = token_counts.word_bpe(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = ["", "!" * 50, "a" * 3000, "It's we'LL", "<|startoftext|>hi<|endoftext|>", "ΑΣ ΣΑΣ", "é", "日本 12 ½²", "x\x85y\x1cz"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500)])) for _ in range(25)) for _ in range(500)]
    known = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [f"a{chr(c)}b {chr(c)}1" for c in rng.sample(known, 20_000)] + ["".join(map(chr, rng.sample(known, 12))) for _ in range(3000)]
    texts += [f"x{chr(c)}y" for c in (0x208F, 0x209D, 0x209F, 0x1C89, 0xA7CE, 0x1E6C0, 0x3D000)]  # letters of newer versions of Unicode
    assert mine.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packed_ids_are_the_library_s():
    """The ids that packing counts and sums, on any characters."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    mine, library = packing.byte_bpe(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    known = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(rng.choice([rng.randrange(9, 127), rng.randrange(0xA0, 0x3000), rng.choice(known)])) for _ in range(rng.randrange(30))) for _ in range(5000)]
    assert [mine.encode_ordinary(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


# ---- GIF


def test_gif_round_trip():
    rng = random.Random(3)
    for n, letters in ((1, 1), (3, 2), (300, 256), (700, 4)):
        data = bytes(rng.randrange(letters) for _ in range(64 * n))
        frames = media_gif.decode(media_gif.encode(data))
        assert b"".join(f.canvas[: len(f.samples), :, 0].tobytes() for f in frames) == data and len(frames) == -(-n // media_gif.ROWS)


def test_gif_frames_that_need_what_was_there_before():
    """Pages that come again, with a few changes, are stored by transparent samples over a kept or a restored screen."""
    rng = random.Random(4)
    area = media_gif.WIDTH * media_gif.ROWS
    page = lambda n=area: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    changed = lambda x: bytes(c if rng.random() < 0.9 else 122 for c in x)
    a, b, all_values = page(), page(), bytes(range(256)) * (area // 256)
    for pages in ([a, a, a], [a, b, changed(a), b], [a, changed(a), b, changed(a)[: area // 2]], [all_values, all_values], [a, b, a[:640]]):
        data = b"".join(pages)
        stored = media_gif.encode(data)
        assert b"".join(f.canvas[: len(f.samples), :, 0].tobytes() for f in media_gif.decode(stored)) == data
        found = [(d, c) for _, d, c in media_gif.frames_of(data)]
        assert found[0][1] is None and (pages[0] is all_values) == all(c is None for _, c in found)
        if len(pages) == 4 and pages[1] is b:
            assert [d for d, _ in found] == [1, 3, 3, 1] or media_gif.RESTORE in [d for d, _ in found]


def test_gif_columns_of_many_frames(spark):
    text = "ab" * 20_000 + "é" * 9000
    r = media_gif.stored_columns(spark.createDataFrame([(1, text)], "doc_id long, text string"), media=True).first()
    payload = text.encode() + b"\0" * (-len(text.encode()) % 64)
    area = media_gif.WIDTH * media_gif.ROWS
    assert len(r["frames"]) == -(-len(payload) // area) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    for k, f in enumerate(r["frames"]):
        screen = bytearray(payload[:area])
        for a in range(0, k + 1):
            part = payload[a * area : (a + 1) * area]
            screen[: len(part)] = part
        want = Counter(21 * (v >> 6) for v in screen)
        assert (f["start_ms"], f["delay_ms"]) == (40 * k, 40) and {i: n for i, n in enumerate(f["histogram"]) if n} == want


def small_gif(frames, palette, size=(2, 2), bits=2):
    """A GIF by hand: each code after a clear code, frames as (samples, rectangle, disposal, transparent index)."""
    out = b"GIF89a" + size[0].to_bytes(2, "little") + size[1].to_bytes(2, "little") + bytes([0x80 | 1, 0, 0]) + bytes(v for c in palette for v in c)
    for samples, (x, y, w, h), disposal, clear in frames:
        out += bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, 0, clear or 0, 0, 0x2C])
        out += b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([0, bits])
        stream = "".join(format(c, "03b")[::-1] for s in samples for c in (4, s)) + format(5, "03b")[::-1]
        stream += "0" * (-len(stream) % 8)
        data = bytes(int(stream[i : i + 8][::-1], 2) for i in range(0, len(stream), 8))
        out += bytes([len(data)]) + data + b"\0"
    return out + b"\x3b"


def test_gif_drawing(spark):
    pal = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    gif = small_gif([([1, 1, 1, 1], (0, 0, 2, 2), 1, None), ([2, 3], (0, 0, 2, 1), 3, 3), ([3], (1, 1, 1, 1), 2, None), ([2], (0, 1, 1, 1), 0, None)], pal)
    at = [[tuple(map(int, p)) for p in f.canvas.reshape(-1, 3)] for f in media_gif.decode(gif)]
    red, green, blue, black = pal[1], pal[2], pal[3], pal[0]
    assert at == [[red] * 4, [green, red, red, red], [red, red, red, blue], [red, red, green, black]]
    df = spark.createDataFrame([(1, gif), (2, b"junk"), (3, None)], "doc_id long, media binary")
    for cut in range(len(gif)):  # a file cut off anywhere is told as broken, never as anything else
        with pytest.raises(ValueError):
            media_gif.decode(gif[:cut])
    rows = media_gif.frame_columns(df).orderBy("doc_id", "frame").collect()
    assert [r["start_ms"] for r in rows[:4]] == [0, 50, 100, 150] and sum(rows[0]["histogram"]) == 4 and rows[4]["error"] and rows[5]["error"]


# ---- packing


def test_sweep_is_best_fit():
    rng = random.Random(4)
    for capacity in (10, 97):
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(300)), reverse=True)
        runs, opened = packing.sweep(dict(Counter(sizes)), capacity)
        gaps = []
        for s in sizes:  # best-fit decreasing, one by one
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((capacity if fit is None else fit) - s)
        assert opened == len(gaps)


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a b c", "word " * 100, "<|endoftext|> x", "", None, *[f"{i} " * (i * 7 % 40) for i in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.best_fit(docs, P.path("byte_bpe_50k.json"), 32).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 32 for r in own[1:]) and all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) <= 32


# ---- SentencePiece


def test_sampling():
    grid = piece_sampling.Lattices(P.path("piece_bpe_32k.model"), 0.002)
    texts = ["Hello  world", "", "   ", "日本語 😀\n\tx", "a" * 300, " lead", "trail ", "▁ ▁▁a", "x\x00y"]
    found = grid.sample(list(range(len(texts))), texts)
    assert [grid.decode(i) for i in found] == texts
    again = grid.sample([3], [texts[3]])
    assert again[0].tolist() == found[3].tolist()
    word, n = "▁the", 20_000
    ways = {}

    def walk(at, ids, weight):
        if at == len(word):
            ways[tuple(ids)] = np.exp(weight)
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in grid.piece:
                i = grid.piece[word[at:end]]
                walk(end, [*ids, i], weight + grid.score[i])

    walk(0, [], 0.0)
    seen = Counter(tuple(i.tolist()) for i in grid.sample(list(range(n)), ["the"] * n))
    total = sum(ways.values())
    assert all(abs(seen[k] / n - v / total) < 0.015 for k, v in ways.items())


@pytest.mark.parametrize("chars, block", [(512, 4096), (8, 20)])
def test_sampling_of_long_chunks(monkeypatch, chars, block):
    """Each piece at each place is drawn as often as its exact probability, over the edges of blocks too."""
    grid = piece_sampling.Lattices(P.path("piece_bpe_32k.model"), 0.002)
    assert not any("▁" in piece.lstrip("▁") for piece in grid.piece)
    monkeypatch.setattr(piece_sampling, "CHUNK_CHARS", chars)
    monkeypatch.setattr(piece_sampling, "BLOCK_CHARS", block, raising=False)
    text, n = "internationalization" * 4, 2000
    word = "▁" + text
    arcs = [(a, z, grid.piece[word[a:z]]) for a in range(len(word)) for z in range(a + 1, min(len(word), a + grid.longest) + 1) if word[a:z] in grid.piece]
    ahead, behind = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
    for a, z, i in arcs:
        ahead[z] += ahead[a] * np.exp(grid.score[i])
    for a, z, i in reversed(arcs):
        behind[a] += behind[z] * np.exp(grid.score[i])
    seen = Counter()
    for found in grid.sample(list(range(n)), [text] * n):
        ends = np.cumsum([len(grid.bytes_[i]) for i in found])
        seen.update(zip([0, *ends[:-1].tolist()], ends.tolist()))
    assert any(a < 48 < z for a, z in seen) and set(seen) <= {(a, z) for a, z, _ in arcs}
    for a, z, i in arcs:
        assert abs(seen[a, z] / n - ahead[a] * np.exp(grid.score[i]) * behind[z] / ahead[-1]) < 0.05
    odd = ["日本語😀▁" * 30, "-" * 700 + " x" + " " * 300, "a" * 9, ""]
    assert [grid.decode(i) for i in grid.sample([1, 2, 3, 4], odd)] == odd


# ---- substring and suffix dedup


def brute_words(docs, window):
    words = {d: WORD.findall(t or "") for d, t in docs}
    seen = Counter(tuple(x[i : i + window]) for x in words.values() for i in range(len(x) - window + 1))
    out = {}
    for d, x in words.items():
        cover = [False] * len(x)
        for i in range(len(x) - window + 1):
            if seen[tuple(x[i : i + window])] > 1:
                cover[i : i + window] = [True] * window
        out[d] = (len(x), sum(cover), hashlib.sha256(" ".join(w for w, c in zip(x, cover) if not c).encode()).hexdigest())
    return out


def brute_bytes(docs, window):
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            piece = raw[i : i + window]
            if piece in seen:
                cover[i : i + window] = b"\1" * window
            seen.add(piece)
        runs = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        out[d] = (len(raw), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(raw, cover) if not c)).hexdigest())
    return out


def copied(seed, letters):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(150))) for _ in range(6)]
    part = lambda: rng.choice(base)[rng.randrange(40) :] if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randrange(20)))
    docs = [(i, "".join(part() for _ in range(rng.randrange(6)))) for i in range(50)]
    return [*docs, (100, "a" * 300), (101, None), (102, ""), (103, "é" * 90), (104, "é" * 70)]


@pytest.mark.parametrize("part, heavy", [(1 << 22, 1024), (50, 2)])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_substring_dedup(spark, monkeypatch, letters, part, heavy):
    monkeypatch.setattr("strideline.llm.repeats.PART_SYMBOLS", part)  # 50: every text goes the way of very long ones
    monkeypatch.setattr("strideline.llm.doubling.SAMPLE", min(64, heavy // 2))
    monkeypatch.setattr("strideline.llm.doubling.HEAVY", heavy)  # 2: keys that two positions hold go the way of very frequent ones
    docs = copied(len(letters), letters)
    df = lambda d: spark.createDataFrame(d, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.deduplicated(df(docs), 20, 7).collect()}
    assert got == brute_bytes(docs, 20)
    spaced = [(d, t and " ".join(t)) for d, t in docs]
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.deduplicated(df(spaced), 9, 3).collect()}
    assert got == brute_words(spaced, 9)


def test_hashes_in_blocks():
    """Windows of any place and length, over the edges of blocks too, have the hash that their symbols have on their own."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 24, 25, 99, 100, 101, HASH_BLOCK - 1, HASH_BLOCK, HASH_BLOCK + 1, HASH_BLOCK + 99, 3 * HASH_BLOCK + 50):
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        found = window_hashes(base, [25, 32, 100])
        for size, h in found.items():
            assert len(h) == max(0, n - size + 1)
            for at in {0, len(h) // 2, len(h) - 1, *(k for k in (HASH_BLOCK - size, HASH_BLOCK - 1, HASH_BLOCK) if k < len(h))} if len(h) else ():
                assert h[at] == window_hashes(base[at : at + size], [25, 32, 100])[size][0], (n, size, at)
        assert (mix(base)[::97] == mix(base[::97].copy())).all()


def test_windows_are_hashed_without_whole_steps():
    """Memory beside the result is that of a few blocks, not an array for each doubling."""
    import tracemalloc

    base = np.arange(1 << 20, dtype=np.uint64)
    tracemalloc.start()
    window_hashes(base, [100])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * base.nbytes


def test_many_intervals_merge_as_few_do(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (0, 1, 65, 300):
        found = [(int(a), int(a + w)) for a, w in zip(rng.integers(-5, 400, n), rng.integers(-2, 9, n))]
        monkeypatch.setattr(windows, "MANY", 1 << 30)
        few = windows.intervals(found, 380)
        monkeypatch.setattr(windows, "MANY", -1)
        assert windows.intervals(found, 380) == few


# ---- near duplicates


def test_documents_of_one_id(spark):
    """Several texts, equal and differing, under a null id and under one id."""
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = make(60)
    texts = [make(90) + shared, shared + make(10), make(30) + shared + make(50), "short", None, ""]
    rows = [(None, t) for t in [*texts, texts[0], texts[0]]] + [(7, t) for t in [texts[2], make(80), make(40) + shared, None, texts[2]]] + [(8, texts[1])]
    docs = spark.createDataFrame([(*r, f"row {i}") for i, r in enumerate(rows)], "doc_id long, text string, source string").repartition(1).sortWithinPartitions("source")
    # Null ids in the order of the table, texts of one id in that of their hashes; equal texts of one id are one document.
    hashed = dict(docs.select("source", F.xxhash64("text")).collect())
    place = {i: n for n, i in enumerate(sorted(range(len(rows)), key=lambda i: f"row {i}"))}
    keys = {i: (0, place[i]) if d is None else (d, -(hashed[f"row {i}"] % (1 << 64) >> 1)) for i, (d, _) in enumerate(rows)}
    names = {k: n for n, k in enumerate(sorted(set(keys.values())))}
    want = brute_bytes({names[keys[i]]: rows[i][1] for i in range(len(rows))}.items(), 20)
    got = Counter(map(tuple, suffix_dedup.deduplicated(docs, 20, 7).collect()))
    assert got == Counter((rows[i][0], *want[names[keys[i]]]) for i in range(len(rows)))
    seen = {r["source"]: r["text"] for r in suffix_dedup.trimmed(docs, 20, 7).collect()}
    assert len(seen) == len(rows)
    for i, (_, t) in enumerate(rows):
        kept = seen[f"row {i}"]
        assert kept is None if t is None else hashlib.sha256(kept.encode()).hexdigest() == want[names[keys[i]]][3]
    spaced = docs.withColumn("text", F.array_join(F.split("text", ""), " "))
    want = brute_words([(names[keys[i]], rows[i][1] and " ".join(rows[i][1])) for i in range(len(rows))], 9)
    got = Counter(map(tuple, substring_dedup.deduplicated(spaced, 9, 3).collect()))
    assert got == Counter((rows[i][0], *want[names[keys[i]]]) for i in range(len(rows)))


def test_near_duplicates_of_one_id(spark):
    rng = random.Random(4)
    base, other, third = (rng.choices([f"w{i}" for i in range(300)], k=150) for _ in range(3))
    text = lambda words, last: " ".join([*words[:-1], last])
    rows = [(5, text(base, "a")), (5, text(other, "a")), (3, text(other, "b")), (9, text(base, "b")), (6, text(third, "a")), (6, text(third, "b")), (6, text(third, "b")), (None, text(base, "a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, near_dup.near_duplicates(docs).collect()))
    assert got == Counter([(5, 5), (5, 3), (3, 3), (9, 5), (6, 6), (6, 6), (6, 6), (None, None)])
    kept = Counter(map(tuple, near_dup.kept(docs).collect()))
    assert kept in [Counter([rows[0], rows[2], rows[7], *third_]) for third_ in ([rows[4]], [rows[5]] * 2)]


def test_signatures():
    rng = np.random.default_rng(0)
    base = rng.integers(1 << 60, size=400).astype(np.uint64)
    for keep in (380, 200):
        other = base.copy()
        other[keep:] = rng.integers(1 << 60, size=400 - keep)
        sig = near_dup.signatures([base, other], 2000)
        assert abs((sig[0] == sig[1]).mean() - keep / (800 - keep)) < 0.05


@pytest.mark.parametrize("crowd, rounds", [(32, 2), (1, 0)])
def test_near_duplicates(spark, monkeypatch, crowd, rounds):
    """The second case leaves every pair to prefixes."""
    monkeypatch.setattr(near_dup, "CROWD", crowd)
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for family in range(12):
        base = rng.choices(vocabulary, k=150)
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(copy)))
    docs += [(1000, None), (1001, None), (1002, ""), (1003, ""), (1004, "one two"), (1005, "one two")]
    sets = {d: np.unique(near_dup.shingles(t), return_counts=True) for d, t in docs if t}
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    same = lambda a, b: (ta := dict(docs)[a]) is not None and ta == dict(docs)[b] or (a in sets and b in sets and near_dup.similarity(sets[a], sets[b]) >= 0.8)
    ids = [d for d, _ in docs]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if same(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == {d: find(d) for d in ids}


def test_prefixes():
    """Sets that are similar enough always meet, by a place and a size that allow for it."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, size=near_dup.COUNTERS)
    for _ in range(300):
        a = rng.choice(1 << 40, size=rng.integers(1, 120), replace=False).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.integers(0, 1 + len(a) // 5) :], rng.integers(1 << 41, 1 << 42, size=rng.integers(0, 1 + len(a) // 8)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        alone = np.ones(near_dup.COUNTERS, bool)
        alone[np.intersect1d(a, b).astype(np.int64) % near_dup.COUNTERS] = False
        (keys, places), (others, theirs) = near_dup.prefix_rows(a, counts, alone), near_dup.prefix_rows(b, counts, alone)
        held = dict(zip(keys.tolist(), places.tolist()))
        need = near_dup.needed(len(a), len(b))
        met = any(k in held and min(len(a) - held[k], len(b) - j) >= need for k, j in zip(others.tolist(), theirs.tolist()))
        assert met or common < 0.8 * (len(a) + len(b) - common) - 1e-9


# ---- WARC


def test_fixity_of_records_with_any_columns(spark):
    """Columns called like those that the audit makes are replaced, other ones pass through."""
    rows = [(i, 10, f"d{i}", f"d{i}" if i != 70 else "x", 1, 2, 3, "b", 4, True, "c") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, length long, sha256 string, replica_sha256 string, number long, offset long, `_place` long, bad string, `_add` long, intact boolean, c0 string")
    got = warc_fixity.audit(warc_fixity.laid_out(df, ["id"])).orderBy("id").collect()
    assert [r["id"] for r in got if not r["intact"]] == [70] and all((r["number"], r["offset"], r["_place"], r["bad"], r["_add"], r["c0"]) == (r["id"], 10 * r["id"], 3, "b", 4, "c") for r in got)


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}") for i in range(3000)] + [(7, None, None)], "page_id long, url string, html string")
    rows = warc_fixity.page_audit(pages, F.col("page_id").isin(5, 1500, 2999)).collect()
    assert len(rows) == 3001 and {r["page_id"] for r in rows if not r["intact"]} == {5, 1500, 2999}
    by_segment = defaultdict(list)
    for r in rows:
        by_segment[r["segment"]].append((r["offset"], r["length"]))
    for spans in by_segment.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_missing_records(spark):
    leaf = spark.range(40).select(F.col("id").alias("number"), F.col("id").cast("string").alias("hash"))
    found = warc_fixity.damaged(warc_fixity.tree(leaf), warc_fixity.tree(leaf.where("number <> 13 and number < 38")))
    assert {r[0] for r in found.collect()} == {13, 38, 39}


def test_warc_files(spark, tmp_path):
    page = spark.createDataFrame([(1, "http://x", "hé")], "page_id long, url string, html string")
    text = page.select(warc_fixity.record(F.col("page_id"), F.col("url"), F.col("html"))).first()[0]
    (tmp_path / "a.warc").write_bytes(text.encode() * 2)
    (tmp_path / "b.warc.gz").write_bytes(warc_fixity.packed_record(text) * 2)
    rows = warc_fixity.read(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and all(bytes(r["content"]) == text.encode() for r in rows)
