from __future__ import annotations

import random

import pytest

from tickwatch.llm import license_scan as ls

from .conftest import awkward

WORD = ls.WORD


def brute(docs, phrases, notices):
    out = []
    for i, text in docs:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        base = sorted((at, label) for p, label in phrases for at in range(len(words)) if words[at : at + len(p.split())] == p.split())
        best, labels = 0.0, {label for _, label in base}
        for text_, label, threshold in notices:
            notice = set(text_.split())
            width = 2
            while width < 2 * len(text_.split()):
                width *= 2
            for start in range(0, max(len(words), 1), width // 2):
                shared = len(notice & set(words[start : start + width]))
                if shared and 1000 * shared >= round(1000 * threshold * len(notice)):
                    best = max(best, shared / len(notice))
                    labels.add(label)
        places = [at for at, _ in base]
        out.append(
            (i, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else best)
        )
    return sorted(out, key=str)


def check(documents, docs, phrases=ls.PHRASES, notices=ls.NOTICES):
    got = sorted((tuple(r) for r in ls.license_scan(documents(docs), phrases, notices).collect()), key=str)
    assert got == brute(docs, phrases, notices)
    return got


def test_known_notices(documents):
    docs = [
        (1, "Some text.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "Licensed under CC BY-NC 4.0."),
        (4, "This work is licensed under the GNU General Public License, version 3."), (5, "A clean text about the mit and its license."),
        (6, "Permission is hereby\n * granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files"),
        (7, "under the MIT license and under the mit-license; UNDER THE\tMIT LICENSE"), (8, "under the MIT İ license"),
    ]
    got = {r[0]: r for r in check(documents, docs)}
    assert [got[i][6] for i in range(1, 9)] == ["mit", "apache-2", "cc-by-nc", "gpl-3", "", "mit", "mit", ""]
    assert got[6][5] == "" and got[7][2:5] == (3, 0, 9) and got[4][7] == 1.0


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(documents, seed):
    r = random.Random(seed)
    known = [w for text, _, _ in ls.NOTICES for w in text.split()]
    docs = []
    for i in range(150):
        words = [r.choice(known) if r.random() < 0.6 else f"w{r.randint(0, 40)}" for _ in range(r.choice([0, 3, 20, 200]))]
        for text, _, _ in r.sample(ls.NOTICES, r.randint(0, 2)):
            at = r.randint(0, len(words))
            words[at:at] = [w for w in text.split() if r.random() < 0.9]
        docs.append((i, r.choice([" ", "\n", ", "]).join(words)))
    check(documents, docs)


def test_short_alphabet_and_own_templates(documents):
    """Few words in many templates of several sizes: every filter of the join has something to leave out."""
    r = random.Random(9)
    words = "abcdefghij"
    notices = [(" ".join(r.choices(words, k=r.randint(1, 12))), f"l{j}", r.choice([0.5, 0.7, 0.9, 1.0])) for j in range(25)]
    docs = [(i, " ".join(r.choices(words + "xyzuvw", k=r.randint(0, 60)))) for i in range(200)]
    check(documents, docs, [("a a", "twice"), ("b", "one"), ("a b", "two")], notices)


def test_awkward_rows(documents):
    check(documents, awkward())
    check(documents, [(1, "mit " * 3000 + "released under the mit license"), (1, None), (None, "Released under the MIT License")])
    assert ls.license_scan(documents([])).collect() == []
    check(documents, [(1, "cc by nc"), (2, "words")], notices=[])


def test_spans(documents):
    rows, found = ls.scan(documents([(5, "x " * 21 + "Released under the MIT License")]))
    assert rows.count() == 1
    assert {(r["width"], r["start"], r["label"], r["containment"]) for r in found.collect()} == {(16, 16, "mit", 1.0)}
