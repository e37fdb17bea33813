"""Each stage of the pipeline over what its predecessor kept, against a plain version of what it decides."""

from collections import defaultdict
from pathlib import Path

import public_tokenizers as P
import pytest

import corpus_pipeline
from strideline.llm import quality_rules, toxicity
from strideline.llm.common import table, written
import brute

DATA = "/root/testdata/sf0.001"


def quality_kept(spark, docs):
    rules = quality_rules.fitted(quality_rules.statistics(docs, ["doc_id"]), table(spark, DATA, "labels"))
    return [r for r in docs.collect() if brute.kept(brute.quality(r["text"]), rules, quality_rules.RATIOS)]


def toxic_dropped(spark, docs):
    machine, share = toxicity.fitted(docs, table(spark, DATA, "labels"))
    score = lambda t: share if machine is None else machine.scores([t])[0]
    return [r for r in docs.collect() if score(r["text"]) < 0.3]


def near_dropped(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    same = brute.links([r["text"] for r in rows])
    first: dict = {}
    for i, r in enumerate(rows):  # equal texts are one document, whatever their length
        if r["text"] is not None:
            same.add((first.setdefault(r["text"], i), i))
    return [r for i, (r, c) in enumerate(zip(rows, brute.classes(len(rows), same))) if i == c]


def repeats_cut(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    out = []
    for r, (kept, _, _) in zip(rows, brute.bytes_kept([r["text"] for r in rows])):
        text = None if r["text"] is None else kept.decode("utf-8", "ignore")
        new = r.asDict() | {"text": text, "n_chars": None if text is None else len(text)}
        out.append(type(r)(**new))
    return out


PLAIN = [quality_kept, toxic_dropped, near_dropped, repeats_cut]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no generated tables")
def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    for (name, stage), plain in zip(corpus_pipeline.STAGES, PLAIN):
        out = written(stage(spark, docs, DATA), "stage")
        assert out.columns == columns, name
        key = lambda r: tuple(str(v) for v in r)
        assert sorted(map(tuple, out.collect()), key=key) == sorted((tuple(r[c] for c in columns) for r in plain(spark, docs)), key=key), name
        docs = out
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    want = [(r["doc_id"], *p) for r in docs.collect() for p in brute.pieces(r["text"], library)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    filled = defaultdict(int)
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= brute.best_fit_decreasing([r["length"] for r in rows], 2048)


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, packed string, h long, `_place` long, keys string, sig int, doc long, sub long, score double, kept boolean, node long, c0 string, sequence_id long, piece int"


def odd_tables(spark, folder, marks):
    """Documents without id or text, repeated, of one id and several texts, near copies, and columns with names that stages use."""
    own = lambda k, n=80: " ".join(f"word{k}x{i}" for i in range(n))
    texts = [(k, own(k)) for k in range(1, 21)]
    texts += [(3, own(3)), (4, own(400)), (None, own(500)), (None, own(500)), (None, own(501)), (30, own(5) + " end"), (31, None), (32, ""), (33, "too short"), (34, " \n\t ")]
    rows = [(i, t, "en", "s", len(t) if t else None, "p", 1, 2, "k", 3, 4, 5, 0.5, True, 6, "c", 7, 8) for i, t in texts]
    spark.createDataFrame(rows, EXTRA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("marks", [[], [(1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 0, 0), (99, 0, 0)], [(1, None, None)]])
def test_defined_cases(spark, tmp_path, marks):
    """Labels that teach nothing reject nothing; long enough documents stay but for the near copy; a repeated one keeps its rows."""
    folder = odd_tables(spark, tmp_path, marks)
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "stage")
        assert docs.columns == table(spark, folder, "documents").columns, name
    rows = corpus_pipeline.run(spark, folder).collect()
    first = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if r["piece"] == 0)
    assert first == sorted([*((False, k) for k in range(1, 21)), (False, 3), (False, 4), *[(True, 0)] * 3])
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert all(r[1].startswith("word") or not r[1] for r in texts) and sum(1 for i, t in texts if i == 4) == 2


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], EXTRA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_no_tables_of_earlier_stages(spark, tmp_path):
    """What is left is what the last stage reads and wrote."""
    folder = odd_tables(spark, tmp_path, [])
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    corpus_pipeline.run(spark, folder).collect()
    left = {p.name.split("-", 1)[1].rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}
    assert "suffix-array-dedup" in left and not left & {"quality-rules", "toxicity", "MinHash-near-dedup", "signatures", "candidates", "links", "prefixes", "quality", "pairs", "classes"}, left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
