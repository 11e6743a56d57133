from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwatch.llm import filter_audit as fa

from .conftest import DOCS, awkward

WORD = re.compile("[^\x20\x09-\x0d]+")
LABELS = "doc_id long, quality int, toxic int, part string"


def failing(docs):
    """Per document, in order: its part and the set of filters it fails."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, lang in docs:
        text = t or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        out.append((lang or "", {f for f, x in fails.items() if x}))
    return out


def brute(docs, labels):
    rows = failing(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {p for p, _ in rows}:
        mine = [(i, f) for (i, _, _), (p, f) in zip(docs, rows) if p == part]
        shapley = {}
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                all_failing = [x for x in mine if f in x[1]]
                shapley[f] = shapley.get(f, 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(all_failing) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = shapley[row[6]]
    return out


def check(spark, docs, labels):
    table = spark.createDataFrame([(i, t, lang, "s", 1, "x", 1, 2, None) for i, t, lang in docs], DOCS)
    got = fa.filter_audit(table, spark.createDataFrame(labels, LABELS.removesuffix(", part string"))).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[x] for x in names] for r in got} == brute(docs, labels)
    assert len(got) == 600 * len({lang or "" for _, _, lang in docs})


def sample(n, seed=1):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [r.choice(["Word", "word", "OTHER", "x%", "plain", f"w{r.randint(0, 500)}"]) for _ in range(r.choice([5, 99, 100, 130]))]
        texts.append(" ".join(words[: r.randint(1, 200)]) if r.random() < 0.5 else " ".join(f"w{r.randint(0, 10**6)}" for _ in words))
    return [(i, r.choice(texts[: n // 3]) if r.random() < 0.3 else t, r.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    r = random.Random(5)
    docs = sample(400)
    labels = [(r.randint(0, 500), r.choice([0, 1, None]), r.choice([0, 0, 1])) for _ in range(300)] + [(None, 1, 1)]
    check(spark, docs, labels)


def test_ranges_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(fa, "RANGE", 7)
    docs = sample(120, 2) + [(50, "one id, many rows " * 40, "en")] * 40
    wanted = fa.postings
    monkeypatch.setattr(fa, "postings", lambda rows: wanted(rows, rows_per_task=25))
    check(spark, docs, [(50, 1, 0), (3, 0, 1)])


def test_a_hot_text(spark):
    """A text with more copies than the smallest count that is looked up by broadcast."""
    docs = [(i, "the same words " * 30 if i % 3 else f"text {i}", "en") for i in range(2400)]
    check(spark, docs, [(i, 1, 0) for i in range(0, 2400, 7)])


def test_awkward_rows(spark):
    docs = [(i, t, [None, "en", ""][k % 3]) for k, (i, t) in enumerate(awkward())] + [(20, None, "de"), (21, "", "de"), (None, "one", "de")]
    check(spark, docs, [(5, 1, 0), (5, 0, 1), (None, 1, 1), (2, None, None)])
    check(spark, [], [])
    check(spark, docs[:3], [])


def test_posting_lists(spark):
    docs = [(9, "b#", "en"), (4, "b#", "en"), (7, "fine", "en"), (1, "x", "de")]
    table = spark.createDataFrame([(i, t, lang, "s", 1, "x", 1, 2, None) for i, t, lang in docs], DOCS)
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    lists = {r["part"]: r for r in fa.postings(fa.marked(fa.copies(fa.judged(table)), labels)).collect()}
    assert lists["en"]["doc_ids"] == [4, 7, 9] and lists["en"]["D"] == [0, 2] and lists["en"]["E"] == [2] and lists["en"]["good"] == [1]
    assert lists["de"]["doc_ids"] == [1] and lists["de"]["A"] == [0] and lists["de"]["E"] == []


@pytest.mark.parametrize("seed", range(6))
def test_merges(seed):
    r = random.Random(seed)
    top = r.choice([3, 300, 30_000])
    a, b = (np.array(sorted(r.sample(range(top), r.randint(0, min(top, 2000)))), np.int32) for _ in "ab")
    assert fa.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
    assert fa.union(a, b).tolist() == sorted({*a.tolist(), *b.tolist()})
    assert fa.difference(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})


def test_hot_keys_are_not_joined_by_shuffle(spark):
    rows = fa.judged(spark.createDataFrame([(i, "same", "en", "s", 1, "x", 1, 2, None) for i in range(1500)], DOCS))
    assert fa.copies(rows).where("E").count() == 1499
    assert fa.copies(rows).select(F.count_if("E")).first()[0] == 1499
