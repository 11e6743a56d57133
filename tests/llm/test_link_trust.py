from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tickwatch.llm import link_trust
from tickwatch.llm.queries import RULES

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType()), T.StructField("verdict", T.LongType()), T.StructField("rank", T.LongType())])


@pytest.fixture(scope="session")
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return lower(m[1]), m[2]


def rule_of(host, path):
    fits = []
    for rule, verdict in RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def brute(rows):
    judged = [(i, *parts(u), *rule_of(*parts(u)), h) for i, u, h in rows]
    edges = {}
    for _, host, _, _, _, html in judged:
        links = {lower(x) for x in re.findall(r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)""", html or "")}
        for x in links - {host} if host else ():
            edges[host, x] = edges.get((host, x), 0) + 1

    def spread(edges, verdict):
        seeds = {}
        for _, host, _, _, v, _ in judged:
            if v == verdict and host:
                seeds[host] = seeds.get(host, 0) + 1
        n = sum(seeds.values()) or 1
        seeds = {h: s / n for h, s in seeds.items()}
        if not edges:
            return seeds
        out = {}
        for (a, _), w in edges.items():
            out[a] = out.get(a, 0) + w
        rank = dict(seeds)
        for _ in range(link_trust.ROUNDS):
            new, handed = {}, 0.0
            for (a, b), w in edges.items():
                new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * w / out[a]
            handed = sum(r for h, r in rank.items() if h in out)
            for h, s in seeds.items():
                new[h] = new.get(h, 0) + s * (1 - 0.85 * handed)
            rank = new
        return rank

    trust, distrust = spread(edges, "allow"), spread({(b, a): w for (a, b), w in edges.items()}, "block")
    out = []
    for i, host, path, rule, verdict, _ in judged:
        t, d = trust.get(host, 0), distrust.get(host, 0)
        out.append((i, host, path, rule, verdict or ("block" if d > t and d > 1e-9 else "allow")))
    return sorted(out, key=str), trust, distrust


def check(pages, rows):
    got = link_trust.judge(pages(rows), RULES).collect()
    want, trust, distrust = brute(rows)
    assert sorted([tuple(r)[:5] for r in got], key=str) == want
    for r in got:
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0)) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0))
    return got


def test_awkward_rows(pages):
    rows = [
        (1, None, None), (2, "no scheme", "x"), (3, "://", ""), (4, "http://ORG/a?b#c", None), (5, "http://x.example.org/es/1", ""), (6, "http://x.example.org/en/12", ""), (7, "http://a.com?x", ""),
        (8, "http://a.com/fr/", ""), (9, "http://a.com/de/", ""), (9, "http://a.com/de/", ""), (10, "http://a.com/", ""), (11, "http://xcom/fr/", ""), (12, "ftp://É.COM/fr/é#/de/", ""),
        (13, "http://example.org#x/es/", ""), (14, "http://u://v.org/", ""), (None, "http://b.net/\nx", "<a href='//'>"), (15, "http://org", ""),
    ]
    check(pages, rows)
    assert link_trust.judge(pages([]), RULES).collect() == []


def test_links_carry_trust_and_distrust(pages):
    r = random.Random(4)
    hosts = [f"h{i}.{t}" for i in range(12) for t in ("org", "net", "com")]
    rows = []
    for i in range(300):
        links = "".join(f'<a HREF="{r.choice(["http:", "https:", ""])}//{r.choice(hosts).upper()}/x">' for _ in range(r.randint(0, 4)))
        rows.append((i, f"https://{r.choice(hosts)}/{r.choice(['fr', 'de', 'es', 'x'])}/{i}", links + "<a href='/own'>"))
    got = check(pages, rows)
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def page(i, host, path, links=()):
    return i, f"http://{host}/{path}", "".join(f"<a href='//{x}/'>" for x in links)


def test_unrelated_blocked_pages_leave_verdicts_unchanged(pages):
    # c4 -> c3 -> c2 -> c1 -> bad.com, and 40 hosts that link to all of these
    chain = ["bad.com", "c1.net", "c2.net", "c3.net", "c4.net"]
    rows = [page(0, "bad.com", "de/")] + [page(i, chain[i], "", [chain[i - 1]]) for i in range(1, 5)] + [page(10 + i, f"o{i}.net", "", chain[:-1]) for i in range(40)]
    more = [page(100 + i, "other.com", f"de/{i}") for i in range(300)]
    for given in (rows, rows + more):
        got = {r["page_id"]: r for r in link_trust.judge(pages(given), RULES).collect()}
        assert [got[i]["verdict"] for i in (1, 2, 3, 4, 10)] == ["block"] * 5, (len(given), got[4])
        assert got[4]["trust"] == 0 < got[4]["distrust"]


def test_ranks_are_converged(pages):
    n = 14
    chain = [page(0, "bad.com", "de/")] + [page(i, f"c{i}.net", "", ["bad.com" if i == 1 else f"c{i - 1}.net"]) for i in range(1, n)]
    got = link_trust.judge(pages(chain), RULES).collect()
    assert {r["verdict"] for r in got} == {"block"} and min(r["distrust"] for r in got) > 0

    r = random.Random(6)
    hosts = [f"h{i}.{t}" for i in range(10) for t in ("org", "net", "com")]
    rows = [page(i, x, r.choice(["fr/", "de/", "x"]), r.sample([y for y in hosts if y != x], 1 + i % 2)) for i, x in enumerate(hosts)]
    judged = {i: (*parts(u), *rule_of(*parts(u))) for i, u, _ in rows}
    links = np.zeros((30, 30))
    for i, _, html in rows:
        for x in re.findall("//([^/]+)/", html):
            links[i, hosts.index(x)] = 1
    solved = []
    for verdict, m in (("allow", links), ("block", links.T)):
        seeds = np.array([judged[i][3] == verdict for i in range(30)], float)
        shares = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        y = np.linalg.solve(np.eye(30) - 0.85 * shares.T, seeds / seeds.sum())
        solved.append(y / y.sum())
    for row in link_trust.judge(pages(rows), RULES).collect():
        t, d = (x[row["page_id"]] for x in solved)
        assert (row["trust"], row["distrust"]) == pytest.approx((t, d), rel=1e-7)
        assert row["verdict"] == (judged[row["page_id"]][3] or ("block" if d > t else "allow"))
