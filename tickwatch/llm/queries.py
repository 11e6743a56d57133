"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwatch.llm import exact_search, filter_audit, license_scan, link_trust, near_search, packing, quality, recompression, setsketch, sharding, speculative_bpe, token_files, whitening
from tickwatch.llm.common import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "host", "path", "low", "toxic", "low_rate", "toxic_rate", "low_posterior", "toxic_posterior", "rejected", (~F.col("rejected")).alias("kept"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(read(spark, sf_dir, "pages"), RULES)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.removed(read(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), BYTE_BPE, end_id=2, capacity=1024)


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=8)


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(read(spark, sf_dir, "embeddings"), k=20, every=20)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(read(spark, sf_dir, "documents"), threshold=75)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "n_links")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speculative_bpe.encode(read(spark, sf_dir, "documents"), WORD_BPE, digests=True)


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read(spark, sf_dir, "documents"), BYTE_BPE, end_id=0)


def near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_search.search(read(spark, sf_dir, "embeddings"), k=20, every=20)


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000)


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_empirical_bayes": quality_verdicts,
    "op2_link_trust": url_verdicts,
    "op3_recompression": substring_dedup,
    "op4_pack_sum_of_squares": packed,
    "op5_shard_histogram_sort": sharded,
    "op6_exact_top_k": exact_top_k,
    "op7_setsketch": near_duplicates,
    "op8_speculative_bpe": bpe_round_trip,
    "op9_token_files": token_spans,
    "op10_multiprobe_lsh": near_neighbours,
    "op11_cholesky_whitening": whitened,
    "op12_filter_audit": filter_interactions,
    "op13_license_join": licenses,
}

def license_sql() -> str:
    """Every block against every template, without filters."""
    notices = license_scan.templates(license_scan.NOTICES)
    listed = ", ".join(f"({list(sorted(t.words))}, '{t.label}', {t.need}, {t.width})" for t in notices)
    phrases = ", ".join(f"({text.split()}, '{label}')" for text, label in license_scan.PHRASES)
    return rf"""
        with p as (
            select * from (values {phrases}) as p(phrase, label)
        ), n as (
            select * from (values {listed}) as n(notice, label, need, width)
        ), d as (
            select row_number() over () as r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from documents
        ), pos as (
            select r, w, unnest(range(len(w))) as i from d
        ), b as (
            select r, i, label from pos join p on w[i + 1] = phrase[1] and w[i + 1:i + len(phrase)] = phrase
        ), base as (
            select r, count(*) as n_base, min(i) as first_word, max(i) as last_word,
                   string_agg(distinct label, ',' order by label) as base_labels
            from b group by r
        ), k as (
            select r, width, list_distinct(w[i + 1:i + width]) as block
            from pos join (select distinct width from n) on i % (width // 2) = 0
            where i = 0 or i + width // 2 < len(w)
        ), m as (
            select r, label, len(list_intersect(block, notice)) as shared, need, len(notice) as size from k join n using (width)
        ), found as (
            select r, label, shared / size as containment from m where shared >= need
        ), all_labels as (
            select r, string_agg(distinct label, ',' order by label) as labels, max(containment) as containment
            from (select r, label, containment from found union all select r, label, 1.0 from b) group by r
        )
        select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
               coalesce(containment, 0)::double as score
        from d left join base using (r) left join all_labels using (r)
    """


ORACLES: dict[str, str] = {
    "op6_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q
            from embeddings
            where vec_id is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.vec_id as query_id, b.vec_id as vec_id,
                   cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
            from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id
        ), r as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
                   vec_id, score
            from s
        )
        select query_id, rank, vec_id, score from r where rank <= 20
    """,
    "op12_filter_audit": """
        with t as (
            select coalesce(lang, '') as part, doc_id, coalesce(text, '') as t from documents
        ), w as (
            select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
                   min(doc_id) over (partition by t) as first_id
            from t
        ), f as (
            select part, doc_id,
                   (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
                   + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::int
                   + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first_id, false)::int as bits
            from w
        ), l as (
            select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
        ), m as (
            select part, bits, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
            from f left join l using (doc_id) group by part, bits
        ), c as (
            select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as c(name, bit)
        ), o as (
            select concat(a.name, b.name, c.name, d.name, e.name) as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as line
            from c as a, c as b, c as c, c as d, c as e
            where a.bit + b.bit + c.bit + d.bit + e.bit = 31
              and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
        ), s as (
            select filter_order, step::int as step, line[step] as own, coalesce(list_sum(line[1:step - 1]), 0)::int as before
            from o, (select unnest(range(1, 6)) as step)
        ), r as (
            select part, filter_order, step, own,
                   coalesce(sum(n) filter (where bits & (before | own) = 0), 0)::bigint as kept,
                   coalesce(sum(n) filter (where bits & before = 0 and bits & own <> 0), 0)::bigint as removed,
                   coalesce(sum(n) filter (where bits & before <> 0 and bits & own <> 0), 0)::bigint as redundant,
                   coalesce(sum(n) filter (where bits = own), 0)::bigint as unique_fails,
                   coalesce(sum(good) filter (where bits & before = 0 and bits & own <> 0), 0)::bigint as good_lost,
                   coalesce(sum(toxic) filter (where bits & before = 0 and bits & own <> 0), 0)::bigint as toxic_lost
            from m, s group by part, filter_order, step, own
        )
        select * exclude (own), (sum(removed) over (partition by part, own))::bigint as shapley from r
    """,
    "op13_license_join": license_sql(),
}
