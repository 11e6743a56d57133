from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from tickwatch.llm import setsketch

from .conftest import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()


def expected(rows, threshold=75):
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] == sets[b]
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and (same_id or 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both)):
                top[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least[find(i)] if doc is not None else None
        out.append((doc, len(sets[i]), component, doc is None or doc == component))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def near_copies(seed, n, groups, edits):
    r = random.Random(seed)
    base = [[f"g{g}w{r.randrange(200)}" for _ in range(r.randint(3, 120))] for g in range(groups)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"e{r.randrange(1000)}"
        rows.append((i, " ".join(words)))
    r.shuffle(rows)
    return rows


def test_groups(documents):
    for seed, n, groups, edits in ((1, 120, 20, 4), (2, 150, 4, 6), (3, 100, 2, 12)):
        rows = near_copies(seed, n, groups, edits)
        assert got(setsketch.near_duplicates(documents(rows))) == expected(rows), seed


def test_awkward_rows(awkward_docs):
    rows = awkward()
    assert got(setsketch.near_duplicates(awkward_docs)) == expected(rows)


def test_empty_table(documents):
    assert setsketch.near_duplicates(documents([])).collect() == []
    assert setsketch.survivors(documents([])).collect() == []


def test_survivors_keep_columns(documents):
    docs = documents([(3, "a b c d e f"), (1, "A b c d e f"), (2, "other"), (None, "a b c d e f"), (4, None)])
    out = setsketch.survivors(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"]) == [(1, "A b c d e f"), (2, "other"), (4, None)]
    assert out.where("doc_id is null").count() == 1


def test_estimate_is_close():
    r = np.random.default_rng(1)
    for n, m, both in ((400, 400, 340), (1000, 600, 500), (30, 30, 26), (2000, 2000, 200)):
        x = r.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        sets = np.concatenate([x[:n], x[n - both :]])
        k = setsketch.registers(sets, np.array([0, n, n + m])).astype(int)
        j = setsketch.estimate(k[:1], k[1:], np.array([float(n)]), np.array([float(m)]))[0]
        assert abs(j - both / (n + m - both)) < 0.15


def test_sketch_of_a_union_is_the_maximum():
    x = np.arange(1, 300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b, c = (setsketch.registers(s, np.array([0, len(s)])) for s in (x[:200], x[100:], x))
    assert (np.maximum(a, b) == c).all()


def test_shingles_of_texts():
    texts = pa.array(["a b c d e f", None, "", "a a a a a a a", "x Y"], pa.large_string())
    _, first = setsketch.shingles(texts)
    assert np.diff(first).tolist() == [2, 0, 0, 1, 1]


def test_one_id_with_several_texts(documents):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a + " tail"), (5, a), (5, b), (9, b + " end"), (9, "a third text of its own")]
    assert got(setsketch.near_duplicates(documents(rows))) == expected(rows)
    left = sorted((r["doc_id"], r["text"]) for r in setsketch.survivors(documents(rows)).collect())
    assert left == [(3, a + " tail"), (5, b), (9, "a third text of its own")]
    rows = [(i % 40, t) for i, t in near_copies(4, 120, 12, 4)]
    assert got(setsketch.near_duplicates(documents(rows))) == expected(rows)


def test_crowded_bucket_under_the_threshold(documents, monkeypatch):
    """Variants of one text that are like each other, but less than the threshold: they share buckets, and no pair becomes a row."""
    monkeypatch.setattr(setsketch, "BLOCK", 32)
    r = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in r.sample(range(0, 400, 5), 26):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, t + " more") for i, t in rows[::50]]
    met = []
    real = setsketch.sized
    monkeypatch.setattr(setsketch, "sized", lambda df, name, **k: met.append((name, real(df, name, **k))) or met[-1][1])
    assert got(setsketch.near_duplicates(documents(rows))) == expected(rows)
    assert sum(df.count() for name, df in met if name == "likely") < 0.1 * len(rows) ** 2 / 2


def test_blocks_find_what_pairs_find(documents, monkeypatch):
    for block, pairs in ((1, 1), (3, 50)):
        monkeypatch.setattr(setsketch, "BLOCK", block)
        monkeypatch.setattr(setsketch, "PAIRS", pairs)
        rows = near_copies(7, 80, 2, 14)
        assert got(setsketch.near_duplicates(documents(rows))) == expected(rows), block


def test_long_sketch_tells_what_the_short_one_does_not(documents, monkeypatch):
    """700 variants 0.66 to 0.74 alike, some pairs linked: the short sketch lets most pairs through, the longer one few."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(600)]
    rows = []
    for i in range(700):
        words = list(base)
        for at in r.sample(range(0, 600, 5), r.choice([10, 11])):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, t + " more") for i, t in rows[::50]]
    met = []
    real = setsketch.sized
    monkeypatch.setattr(setsketch, "sized", lambda df, name, **k: met.append((name, real(df, name, **k))) or met[-1][1])
    assert got(setsketch.near_duplicates(documents(rows))) == expected(rows)
    sets = [shingle_set(t) for _, t in rows[:120]]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    met = sum(df.count() for name, df in met if name == "likely")
    short, long_ = (sum(x >= floor for x in alike) / len(alike) for floor in (setsketch.lowest(75), setsketch.lowest_long(75)))
    assert short > 0.9 and met < 2 * (long_ + 0.05) * len(rows) ** 2 / 2, (short, long_, met)


def test_long_estimate_is_close():
    r = np.random.default_rng(2)
    for n, m, both in ((400, 400, 340), (1000, 700, 700), (3, 3, 2), (5000, 5000, 10)):
        x = r.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        sets = np.concatenate([x[:n], x[n - both :]])
        bits = np.packbits((setsketch.registers(sets, np.array([0, n, n + m]), setsketch.LONG) & 1).astype(bool), axis=1).view("<u8")
        level = both / (n + m - both)
        error = 2 * ((1 + level) / 2 * (1 - level) / 2 / setsketch.LONG) ** 0.5
        assert abs(setsketch.estimate_long(bits[:1], bits[1:])[0] - level) < 5 * error
