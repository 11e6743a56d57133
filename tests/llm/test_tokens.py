from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickwatch.llm import speculative_bpe, token_files
from tickwatch.llm.encoder import byte_encoder

from .conftest import SF, awkward

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  a  B \n\n c", "don't 'S x_y 'LL", "ΣΑΣ Σ", "½ ² x1 Ⅷ", "<|endoftext|> hi <|startoftext|>x", "a\x1cb\x85c", "日本語 テスト\r\n x é É İ", "</w> </w>a <w>", "x" * 300, "_" * 60,
    "１２３ ٣٤ a1b2", "tabs\t\t end   ", "naïve café ﬁ", "\U0001f600\U0001f469‍\U0001f4bb ok", "nul \x00 byte",
]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


def noise(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdehilnorstuàßé  .,'1\n") for _ in range(r.randint(0, 300))) for _ in range(n)]


def given_texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def test_byte_ids_are_the_library_s(spark, byte_library):
    own = byte_encoder(BYTE)
    for text in ODD + noise(1, 200) + given_texts(spark):
        assert own.encode(text) == byte_library.encode(text, add_special_tokens=False).ids, text


def test_word_ids_are_the_library_s(spark, word_library):
    texts = ODD + noise(2, 400) + given_texts(spark)
    for text, (ids, decoded) in zip(texts, speculative_bpe.codec(WORD).round_trip(texts)):
        want = word_library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and decoded == word_library.decode(want, skip_special_tokens=False), text


def test_characters_of_newer_tables(word_library):
    """Characters that Python's tables do not know, and a sample of all others."""
    r = random.Random(12)
    codes = [0x1C89, 0x105D0, 0x10D52, 0x13460, 0x2FFFF, *r.sample([c for c in range(0x20, 0x33500) if not 0xD800 <= c < 0xE000], 8000)]
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in codes]
    got = speculative_bpe.codec(WORD).round_trip(texts)
    library = word_library.encode_batch(texts, add_special_tokens=False)
    assert [c for c, (ids, _), e in zip(codes, got, library) if list(ids) != e.ids] == []


def test_merges_alike_for_short_and_long_words():
    own = speculative_bpe.codec(WORD)
    for text in noise(3, 60):
        parts = speculative_bpe.symbols(speculative_bpe.marked(text.encode().decode("latin-1").translate(own.bytes) + "</w>"))
        assert own.merge(parts[-40:]) == own._merge_long(parts[-40:])


def test_tables_start_anew(monkeypatch, word_library):
    monkeypatch.setattr(speculative_bpe, "MAX_WORDS", 50)
    monkeypatch.setattr(speculative_bpe, "MAX_PAIRS", 40)
    own = speculative_bpe.Codec(WORD)
    for text in noise(4, 40):
        (ids, _), = own.round_trip([text])
        assert ids.tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_word_digests_of_awkward_rows(awkward_docs, documents, word_library):
    want = []
    for i, t in awkward():
        ids = word_library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(word_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, speculative_bpe.encode(awkward_docs, WORD, digests=True).collect()), key=str) == sorted(want, key=str)
    assert speculative_bpe.encode(documents([]), WORD).collect() == []
    one = speculative_bpe.encode(documents([(1, "a word")]), WORD).first()
    assert np.frombuffer(one["ids"], "<u4").tolist() == word_library.encode("a word").ids and one["decoded"] == "a</w> word</w>"


def spans(rows, library):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_round_trip(awkward_docs, byte_library):
    got = token_files.token_files(awkward_docs, BYTE).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == spans(awkward(), byte_library)


def test_files_of_many_parts(documents, byte_library, tmp_path):
    rows = [(i * 7 % 501, t) for i, t in enumerate(noise(5, 500))]
    manifest = token_files.write_token_files(documents(rows), str(tmp_path), BYTE, 0, parts=7)
    assert manifest.count() > 1
    assert sorted(map(tuple, token_files.read_token_files(manifest, str(tmp_path)).collect()), key=lambda r: r[1]) == spans(rows, byte_library)
    part = manifest.first()
    flat = np.fromfile(f"{tmp_path}/part-{part['part']:05d}.ids", "<u2")
    offsets = np.fromfile(f"{tmp_path}/part-{part['part']:05d}.offsets", "<i8")
    assert len(offsets) == part["n_docs"] + 1 and offsets[0] == 0 and offsets[-1] == len(flat) == part["n_tokens"]


def test_files_of_an_empty_table(documents):
    assert token_files.token_files(documents([]), BYTE).collect() == []
