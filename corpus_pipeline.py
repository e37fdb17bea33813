"""The corpus pipeline: each stage works on what its predecessor kept.

Every stage but the last returns the columns of `documents`; `run` writes each as Parquet and reads it again for the next,
and drops what was written on the way.

Defined cases: a null or empty text fails the quality rules, as do texts of under 50 words. Rows without doc_id are
documents of their own: no label is theirs, no class of near duplicates has them, and their repeated bytes are judged like
others'. Rows with one id and one text are one document for the near duplicates, which keep all its rows, and for
repeated bytes; with several texts they are several. Labels that teach nothing, none or of one class, reject
nothing. Extra columns stay until packing, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strideline.llm import near_dup, packing, quality_rules, suffix_dedup, toxicity
from strideline.llm.common import collected, dropped, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.judged(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the machine is trained on labelled ones among `docs`."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near duplicates."""
    return near_dup.kept(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat what stands earlier; n_chars follows."""
    return suffix_dedup.trimmed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Learned stages, signatures and vocabularies have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with collected() as made:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(*(t for t in made if t is not docs), *([held] if held is not None else []))
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
