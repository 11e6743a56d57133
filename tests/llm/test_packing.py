from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickwatch.llm import packing

from .conftest import awkward

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def pieces_by_library(library, rows, capacity):
    out = []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        for piece, (a, b) in enumerate(packing.cuts(len(ids), capacity)):
            out.append((doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_awkward_rows(library, awkward_docs):
    rows = packing.pack(awkward_docs, PATH).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == pieces_by_library(library, awkward(), 1024)
    check_places(rows, 1024)


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).collect() == []


def test_several_groups(library, documents):
    docs = documents([(i, "word " * (i * 37 % 90)) for i in range(300)])
    placed = packing.place(packing.tokenized_pieces(docs, PATH, capacity=64, with_ids=False), 64, group_pieces=50)
    check_places(placed.collect(), 64)


def test_sequences_hold_the_pieces(library, documents):
    docs = documents([(i, f"text number {i} " * (i % 9)) for i in range(40)])
    made = packing.tokenized_pieces(docs, PATH, capacity=32)
    placed = packing.place(made, 32)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        at = 4 * r["offset"]
        assert whole[r["sequence_id"]][at : at + 4 * r["length"]] == bytes(r["ids"])


def test_cuts():
    assert packing.cuts(5, 10) == [(0, 5)] and packing.cuts(10, 10) == [(0, 10)]
    assert packing.cuts(25, 10) == [(0, 5), (5, 15), (15, 25)]


def test_sum_of_squares_is_the_least():
    """Every single choice, against all others."""
    r = np.random.default_rng(5)
    sizes, capacity = r.integers(1, 21, 300), 20
    bins, offsets = packing.sum_of_squares(sizes, capacity)
    gaps = {}
    for size, b, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def cost(choice):
            after = [g for k, g in gaps.items() if k != choice] + [gaps.get(choice, capacity) - size]
            return sum(g * after.count(g) ** 2 for g in set(after))

        able = [k for k, g in gaps.items() if g >= size] + [len(gaps)]
        assert cost(b) == min(map(cost, able))
        assert offset == capacity - gaps.get(b, capacity)
        gaps[b] = gaps.get(b, capacity) - size


def test_few_sequences():
    r = np.random.default_rng(2)
    sizes = np.sort(np.minimum(1024, r.lognormal(5.5, 1, 20_000).astype(int) + 1))[::-1]
    bins, _ = packing.sum_of_squares(sizes, 1024)
    assert bins.max() + 1 <= 1.005 * sizes.sum() / 1024
