from __future__ import annotations

import os

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tickwatch.llm import queries as corpus

from . import test_packing, test_quality_classifier, test_recompression, test_setsketch
from .conftest import SF

CONTRACT = {
    "op1_quality_empirical_bayes": {"doc_id", "rejected"},
    "op2_link_trust": {"page_id", "host", "path", "rule", "verdict"},
    "op3_recompression": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op4_pack_sum_of_squares": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op5_shard_histogram_sort": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op6_exact_top_k": {"query_id", "rank", "vec_id", "score"},
    "op7_setsketch": {"doc_id", "n_shingles", "component_id", "kept"},
    "op8_speculative_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10_multiprobe_lsh": {"query_id", "rank", "vec_id", "score"},
}


def test_all_are_registered():
    assert set(CONTRACT) == set(corpus.QUERIES)
    assert set(CONTRACT) | {"pipeline"} <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "substring dedup", "best-fit packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")
@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query_on_the_given_tables(spark, name):
    out = entry.queries()[name](spark, SF)
    assert CONTRACT[name] <= set(out.columns)
    rows = out.collect()
    assert rows
    if name in corpus.ORACLES:
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
        cur = con.execute(corpus.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(cur.fetchall())


@pytest.fixture(scope="module")
def tables(spark, documents, tmp_path_factory):
    """A small corpus with copies, near copies, shared passages and bad documents."""
    docs, labels = test_quality_classifier.corpus(300, seed=9)
    words = [f"t{i}" for i in range(400)]
    passage = " ".join(words[:70])
    more = [
        (900, " ".join(words[200:300]) + " " + passage + " end"), (901, " ".join(words[300:400]) + "\n" + passage),
        (902, passage + " " + " ".join(f"u{i}" for i in range(90))), (903, " ".join(words[100:200])),
        (904, " ".join(words[100:199]) + " changed"), (905, None), (906, ""), (907, " ".join(words[100:200])),
    ]
    path = str(tmp_path_factory.mktemp("tables"))
    documents(docs + more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_by_definition(spark, tables):
    """Each stage against brute force on what the stage before has kept."""
    read = spark.read.parquet(f"{tables}/documents.parquet")
    columns = read.columns
    docs, seen = read, []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, tables), "test-stage")
        seen.append(docs)
    good, unique, cut, packed = seen
    assert good.columns == unique.columns == cut.columns == columns

    def pairs(df):
        return [(r["doc_id"], r["text"]) for r in df.collect()]

    assert 900 in dict(pairs(good)) and good.count() < read.count()
    kept = {r[0] for r in test_setsketch.expected(pairs(good)) if r[3]}
    assert sorted(pairs(unique), key=str) == sorted([p for p in pairs(good) if p[0] in kept], key=str)
    want = {r[0]: r for r in test_recompression.expected(pairs(unique), 50)}
    before, after = dict(pairs(unique)), dict(pairs(cut))
    assert after == {i: want[i][3] if want[i][2] else t for i, t in before.items()}
    assert any(want[i][2] for i in before)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packed.collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == test_packing.pieces_by_library(library, pairs(cut), 1024)
    test_packing.check_places(rows, 1024)


def test_run_is_all_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, tables), "test-run")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, tables).select(*names).collect()
    assert sorted(got, key=str) == sorted(docs.select(*names).collect(), key=str)
