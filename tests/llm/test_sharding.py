from __future__ import annotations

import random
import zlib

from tickwatch.llm import sharding

from .conftest import awkward


def check(rows, docs, shards):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=str
    )
    slots = {}
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)]


def test_near_equal(documents):
    r = random.Random(1)
    docs = [(i, "x" * r.randint(0, 300) + str(i)) for i in range(3000)]
    sizes = check(sharding.shard(documents(docs), 8, rows_per_task=100).collect(), docs, 8)
    assert max(sizes) - min(sizes) <= 2 * 310


def test_hot_text_is_cut(documents):
    docs = [(i, "the same text") for i in range(1500)] + [(i, f"another {i}") for i in range(1500, 3000)]
    sizes = check(sharding.shard(documents(docs), 8).collect(), docs, 8)
    assert max(sizes) <= 1.02 * min(sizes)


def test_equal_rows_are_cut(documents):
    docs = [(1, "same")] * 800
    sizes = check(sharding.shard(documents(docs), 8).collect(), docs, 8)
    assert max(sizes) == min(sizes)


def test_equal_texts_stay_together(documents):
    docs = [(i, f"text {i % 700}") for i in range(2100)]
    rows = sharding.shard(documents(docs), 8).collect()
    check(rows, docs, 8)
    together = {}
    for r in rows:
        together.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert max(map(len, together.values())) <= 2 and sum(len(s) > 1 for s in together.values()) <= 7


def test_awkward_rows(awkward_docs, documents):
    check(sharding.shard(awkward_docs, 8).collect(), awkward(), 8)
    assert sharding.shard(documents([])).collect() == []
    check(sharding.shard(documents([(None, None)])).collect(), [(None, None)], 8)


def test_carried_columns(documents):
    docs = documents([(i, f"t{i}") for i in range(20)])
    out = sharding.shard(docs, 2, carry=("text", "count")).collect()
    assert sorted((r["text"], r["count"]) for r in out) == sorted((f"t{i}", "x") for i in range(20))
