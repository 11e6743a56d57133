from __future__ import annotations

import math
import random

import pytest

from tickwatch.llm import quality

from .conftest import awkward

GOOD = "the house on a hill was old and its garden full of roses that nobody had cut for many years".split()
BAD = ["awful", "nasty", "vile"]


def corpus(n, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(GOOD) for _ in range(60)]
        low, toxic = r.random() < 0.2, r.random() < 0.2
        if low:
            words = [r.choice(GOOD)] * 50
        if toxic:
            words[r.randrange(len(words))] = r.choice(BAD)
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if low else 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(documents, labels_of):
    docs, labels = corpus(600)
    out = quality.classify(documents(docs), labels_of(labels[:400])).select("row.doc_id", "rejected").collect()
    want = {i: q == 0 or t == 1 for i, q, t in labels[400:]}
    right = sum(want[r["doc_id"]] == r["rejected"] for r in out if r["doc_id"] in want)
    assert right >= 0.97 * len(want)


def test_sites_shrink_toward_all(spark):
    """Few documents of one site move its rate little, many move it to their own."""
    rows = [("big", "p", 4.0)] * 200 + [("small", "p", 4.0)] + [(f"h{i}", "p", -4.0) for i in range(100) for _ in range(5)]
    judged = spark.createDataFrame([(h, p, x, x) for h, p, x in rows], "host string, path string, low double, toxic double")
    rates = {r["host"]: r["low_rate"] for r in quality.rates(judged).collect()}
    assert rates["h1"] < rates["small"] < rates["big"]
    assert rates["big"] > 0.9


def test_a_site_decides_where_texts_do_not(documents, labels_of):
    docs, labels = corpus(300)
    out = quality.classify(documents([*docs, (1000, None), (1001, "")]), labels_of(labels)).where("row.doc_id >= 1000").collect()
    assert [r["rejected"] for r in out] == [False, False]
    assert all(r["low_posterior"] == pytest.approx(r["low_rate"]) for r in out)


def test_awkward_rows(spark, documents, awkward_docs, labels_of):
    labels = [(1, 0, 1), (None, 1, 0), (8, None, None), (9, 1, 0), (10, 0, 0), (5, 1, 0), (5, 0, 1), (77, 1, 1)]
    out = quality.classify(awkward_docs, labels_of(labels))
    assert sorted((str(r["row"]["doc_id"]) for r in out.collect())) == sorted(str(i) for i, _ in awkward())
    kept = quality.kept(awkward_docs, labels_of(labels))
    assert kept.schema.simpleString() == awkward_docs.schema.simpleString()
    assert quality.kept(documents([]), labels_of([])).collect() == []


def test_without_labels_nothing_is_rejected(documents, labels_of):
    docs, _ = corpus(20)
    assert quality.kept(documents(docs), labels_of([])).count() == 20


def test_features():
    assert quality.features(None) == quality.features("") == set()
    found = quality.features("Word, word!! Unrelated unrelenting unrelieved")
    assert {"word", "unrelated", "unrel**"[:4] + "**"} <= found


def worth(sites, centre, groups):
    """Pseudo-documents by moments: sites as (k, n, group), the centre and size of each group."""
    sites = [s for s in sites if s[1]]
    if len(sites) <= len({g for _, _, g in sites}):
        return quality.UNKNOWN
    spread = sum(n * (k / n - centre(g)) ** 2 for k, n, g in sites)
    noise = {g: centre(g) * (1 - centre(g)) for _, _, g in sites}
    free = sum(noise[g] * (sum(1 for s in sites if s[2] == g) - 1) for g in noise)
    total = sum(n for _, n, _ in sites)
    between = (spread - free) / max(1.0, total - sum(n * n / groups(g) for _, n, g in sites))
    return quality.WORTH[1] if between <= 0 else min(quality.WORTH[1], max(quality.WORTH[0], sum(n * noise[g] for _, n, g in sites) / total / between - 1))


def brute(rows):
    """(site rate, posterior) of each (host, path, log odds or None), row by row."""
    p = lambda x: 1 / (1 + math.exp(-x))
    seen = [(h, q, p(x)) for h, q, x in rows if x is not None]
    all_ = (sum(c for *_, c in seen) + 1) / (len(seen) + 2)
    of = lambda key: ([c for h, q, c in seen if key(h, q)])
    hosts = {h: of(lambda a, _, h=h: a == h) for h in {r[0] for r in rows}}
    paths = {(h, q): of(lambda a, b, h=h, q=q: (a, b) == (h, q)) for h, q, _ in rows}
    host_worth = worth([(sum(c), len(c), 0) for c in hosts.values()], lambda _: all_, lambda _: len(seen))
    path_worth = worth([(sum(c), len(c), h) for (h, _), c in paths.items()], lambda h: sum(hosts[h]) / len(hosts[h]), lambda h: len(hosts[h]))
    out = []
    for h, q, x in rows:
        have, own = (0, 0.0) if x is None else (1, p(x))
        host = (sum(hosts[h]) - own + host_worth * all_) / (len(hosts[h]) - have + host_worth)
        rate = (sum(paths[h, q]) - own + path_worth * host) / (len(paths[h, q]) - have + path_worth)
        shift = 0.0 if x is None else x - math.log(all_ / (1 - all_))
        out.append((rate, p(shift + math.log(rate / (1 - rate)))))
    return out, all_


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rates_and_posteriors_row_by_row(spark, seed):
    r = random.Random(seed)
    base = {h: r.gauss(-1, 2) for h in ["a", "b", "c", "d", "", None]}
    rows = [("one", "p", 2.0), ("none", "p", None)]
    for h, level in base.items():
        for q in r.sample(["x", "y", "z", "", None], 3):
            at = level + r.gauss(0, 2 * (seed - 1))
            rows += [(h, q, None if r.random() < 0.1 else at + r.gauss(0, 1)) for _ in range(r.choice([1, 4, 40]))]
    # toxic is asked of one site only
    judged = spark.createDataFrame([(i, h, q, x, x if h == "a" else None) for i, (h, q, x) in enumerate(rows)], "i int, host string, path string, low double, toxic double")
    got = {x["i"]: x for x in quality.posteriors(judged).collect()}
    assert len(got) == len(rows)
    for question, asked in (("low", rows), ("toxic", [(h, q, x if h == "a" else None) for h, q, x in rows])):
        want, all_ = brute(asked)
        for i, (rate, posterior) in enumerate(want):
            assert got[i][f"{question}_rate"] == pytest.approx(rate, rel=1e-9)
            assert got[i][f"{question}_posterior"] == pytest.approx(posterior, rel=1e-9)
        assert got[0][f"{question}_all"] == pytest.approx(all_)
    # the only document of a host has no site but the corpus
    assert got[0]["low_rate"] == pytest.approx(got[0]["low_all"])
    assert got[0]["low_posterior"] == pytest.approx(1 / (1 + math.exp(-2.0)))


def test_levels_have_priors_of_their_own(spark):
    """Hosts alike, paths not: a path's documents say much, a host's little."""
    rows = [(f"h{h}", f"p{q}", 4.0 if q % 2 else -4.0) for h in range(10) for q in range(4) for _ in range(30)]
    judged = spark.createDataFrame([(h, q, x, x) for h, q, x in rows], "host string, path string, low double, toxic double")
    row = quality.rates(judged).first()
    assert row["low_worth"] < 2 and row["low_h_worth"] == quality.WORTH[1]


def test_conflicting_labels_fit_alike(documents, labels_of):
    docs, labels = corpus(200)
    docs += [(1000 + i, t) for i, t in docs[:60]]
    labels += [(1000 + i, 1 - q, 1 - t) for i, q, t in labels[:60]]
    table = documents(docs)
    first = quality.fit(table, labels_of(labels))
    assert first == quality.fit(table.repartition(7, "text"), labels_of(labels[::-1]))
    assert any(len(m) > 1 for m in first.values())
