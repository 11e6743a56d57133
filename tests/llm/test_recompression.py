from __future__ import annotations

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickwatch.llm import recompression

from .conftest import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, window):
    """Row by row, by definition."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)


def passages(seed, n, words, window):
    """Documents of shared passages, runs, edits and noise over a small vocabulary."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    shared = [[r.choice(vocabulary) for _ in range(r.randint(window // 2, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(r.randint(0, 5)):
            kind = r.random()
            if kind < 0.5:
                part = list(r.choice(shared))
                if r.random() < 0.4 and part:
                    part[r.randrange(len(part))] = r.choice(vocabulary)
                text += part
            elif kind < 0.7:
                text += [r.choice(vocabulary)] * r.randint(1, 2 * window)
            else:
                text += [r.choice(vocabulary) for _ in range(r.randint(0, 2 * window))]
        rows.append((r.randint(0, n), r.choice([" ", "\n", "\t "]).join(text)))
    return rows


def test_passages(spark, documents):
    for seed, words, window in ((1, 3, 10), (2, 40, 10), (3, 500, 50), (4, 5, 50), (5, 2, 12)):
        rows = passages(seed, 60, words, window)
        assert got(recompression.removed(documents(rows), window)) == expected(rows, window), (seed, words, window)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.lists(st.sampled_from("abc"), max_size=60).map(" ".join)), max_size=12), st.integers(2, 20))
def test_any_rows(spark, documents, rows, window):
    assert got(recompression.removed(documents(rows), window)) == expected(rows, window)


def test_awkward_rows(awkward_docs):
    assert got(recompression.removed(awkward_docs)) == expected(awkward(), 50)


def test_empty_table(documents):
    assert recompression.removed(documents([])).collect() == []
    assert recompression.deduplicated(documents([])).collect() == []


def test_deduplicated_keeps_columns(documents):
    text = " ".join(f"p{i}" for i in range(60))
    docs = documents([(1, text), (2, f"head {text}  tail"), (3, "a  b"), (4, None)])
    out = recompression.deduplicated(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, text, len(text)), (2, "head tail", 9), (3, "a  b", 4), (4, None, None)]


def test_a_line_over_and_over_is_one_stretch(spark, documents):
    """Of a text that repeats one line, a row for each key and not for each repetition."""
    rows = [(i, " ".join([f"h{i}x{n}" for n in range(30)] + ["is", "one."] * (200 + i) + [f"t{i}x{n}" for n in range(30)])) for i in range(20)]
    docs = documents(rows)
    assert got(recompression.removed(docs)) == expected(rows, 50)
    assert recompression.repeated(docs).count() <= 19 * 10


def test_repeated_stretches_far_apart(spark, documents):
    """Places of one key whose words do not meet stay apart, in one text and over the edge of two."""
    line = [f"p{n}" for n in range(12)]
    for gap in (0, 1, 9, 10, 11, 40):
        rows = [(i, " ".join(line + [f"a{i}x{n}" for n in range(gap)] + line + [f"b{i}x{n}" for n in range(gap)] + line)) for i in range(6)]
        assert got(recompression.removed(documents(rows), 10)) == expected(rows, 10), gap


def test_a_cover_of_one_window_has_one_source(spark, documents):
    passage = " ".join(f"p{n}" for n in range(50))
    rows = [(1, passage), (2, passage), (3, f"head {passage} tail"), (3, passage), (4, passage)]
    docs = documents(rows)
    assert got(recompression.removed(docs)) == expected(rows, 50)
    assert sorted((r["doc_id"], r["first"], r["last"]) for r in recompression.repeated(docs).collect()) == [(2, 0, 0), (3, 0, 0), (3, 1, 1), (4, 0, 0)]
