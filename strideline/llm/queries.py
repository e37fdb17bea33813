"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm import bit_sliced, lexical_search, media_gif, near_dup, packing, piece_sampling, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity, vector_codes, warc_fixity
from strideline.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, audited against a replica in which the pages whose hash begins with 0 have gone bad."""
    return warc_fixity.page_audit(table(spark, sf_dir, "pages"), F.md5(F.col("page_id").cast("string").cast("binary")).startswith("0"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.stored_columns(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sampled(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_token_counts": op4_token_counts,
    "op5_media_gif": op5_media_gif,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_piece_sampling": op7_piece_sampling,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_exact_topk": op12_exact_topk,
    "op13_vector_codes": op13_vector_codes,
}

_EOL = "chr(13) || chr(10)"
_HEAD = f"""'WARC/1.1' || {_EOL} || 'WARC-Type: response' || {_EOL} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {_EOL} || 'WARC-Target-URI: ' || url || {_EOL} ||
  'Content-Type: text/html' || {_EOL} || 'Content-Length: ' || strlen(html) || {_EOL} || {_EOL}"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _terms(of: str, table_: str) -> str:
    return f"select {of}, unnest(regexp_extract_all(translate(text, {_LETTERS}), '{lexical_search.TERM}')) as term from {table_}"


def _whole(scale: int) -> str:
    return f"""select vec_id, label, [floor({scale} * x::double) for x in embedding] as v from embeddings
      where embedding is not null and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0"""


def _lloyd(rounds: int = 4, parts: int = 4) -> str:
    """Plain Lloyd rounds: every distance of every round."""
    cut = ", ".join(f"({p}, v[{p} * len(v) // {parts} + 1 : ({p} + 1) * len(v) // {parts}])" for p in range(parts))
    ctes = [
        f"w as materialized ({_whole(1024)})",
        f"x as materialized (select vec_id, label, p as part, u as v from w, lateral (values {cut}) as c(p, u))",
        "b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v from x where vec_id in (select vec_id from w order by vec_id limit 256))",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""d{r} as materialized (select vec_id, label, x.part, x.v, min(struct_pack(d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.v, b.v)]), e := entry)) as best
            from x join b{r} b on b.part = x.part group by all)"""
        )
        if r < rounds:
            ctes.append(
                f"""m{r} as (select part, entry, list(floor(s / n) order by i) as v from (select part, best.e as entry, i, sum(c) as s, count(*) as n
                from (select part, best, unnest(v) as c, generate_subscripts(v, 1) as i from d{r}) group by all) group by all)"""
            )
            ctes.append(f"b{r + 1} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from b{r} b left join m{r} m on m.part = b.part and m.entry = b.entry)")
    last = f"d{rounds}"
    return f"""with {", ".join(ctes)},
      h as (select sha256(string_agg(c::bigint::varchar, ',' order by part, entry, i)) as s from (select part, entry, unnest(v) as c, generate_subscripts(v, 1) as i from b{rounds})),
      e as (select vec_id, label, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error from {last} group by vec_id, label)
      select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h.s as codebooks_sha256 from e, h"""


ORACLE: dict[str, str] = {
    "op11_ranked_search": f"""with d as ({_terms("doc_id", "documents")}), q as (select distinct item_id, term from ({_terms("item_id", "benchmark")})),
      p as (select doc_id, term, count(*) as tf from d group by all), f as (select term, count(*) as df from p group by term),
      l as (select doc_id, sum(tf)::bigint as n from p group by doc_id), c as (select count(*) as held, sum(n)::bigint as total from l),
      m as (select doc_id, 100 - 50 + ((50 * n * held) // total) as m from l, c),
      s as (select item_id, doc_id, sum(floor(1000 * ln((2 * held + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
        from q join f using (term) join p using (term) join m using (doc_id), c group by item_id, doc_id)
      select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 50""",
    "op12_exact_topk": f"""with w as ({_whole(256)}),
      s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from w q join w c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0)
      select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op13_vector_codes": _lloyd(),
    "op3_warc_fixity": f"""with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
      r as (select page_id, {_HEAD} as head, html, case when md5(page_id::varchar) like '0%' then substr(html, 2) || substr(html, 1, 1) else html end as bad from p),
      s as (select page_id, strlen(head) + strlen(html) + 4 as length, sha256(head || html || {_EOL} || {_EOL}) as sha256, sha256(head || bad || {_EOL} || {_EOL}) as copy from r),
      n as (select *, row_number() over (order by page_id, sha256) - 1 as number from s)
      select page_id, number // 1024 as segment, (sum(length) over (partition by number // 1024 order by number) - length)::bigint as "offset", length::bigint as length, sha256, sha256 = copy as intact from n""",
}
