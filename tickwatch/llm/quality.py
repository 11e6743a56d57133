"""Quality classifier with hierarchical empirical Bayes.

Two questions are asked of every document: is it of low quality, is it toxic? For each, (1) a sparse logistic model of
its words and its shape (symbols, repetitions, capitals, ...) gives the document's own evidence; (2) the evidence of
*all* documents is summed per path and per host; (3) a path's rate is shrunk toward its host's and a host's toward
the corpus', each by as many pseudo-documents as the spread of the rates at its own level asks for (hosts within the corpus,
paths within hosts), so a site with few documents says little; (4) the posterior odds are the document's odds times its site's odds
over the corpus' odds, where the document itself is left out of the sums of its path and host: its evidence counts once, and
the only document of a host has the corpus' rate. A document is rejected if either posterior exceeds ``limit``.

A prior is worth ``WORTH[0]`` to ``WORTH[1]`` documents, and ``UNKNOWN`` where its level has no two sites to compare.

In the documents table ``source`` is the host and ``lang`` the path below it. The model is fitted on at most
``MAX_LABELLED`` labelled rows, taken by a hash of their ids, each text once; a text with several labels is of low quality
or toxic if one of them says so. Everything else covers all rows. Evidence is computed where the text lies, twice, rather than
shuffled with it.

Defined results: a null or empty text has no evidence, so its path's rate decides; null hosts and paths are sites like
others, apart from empty ones; without labels of both kinds a question has no evidence and rejects nothing; repeated rows give
repeated rows; an empty table gives no rows; other columns may have any name and are passed through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import materialise

MAX_LABELLED = 12_000
#: Features per question that the model may use.
SCREENED = 2_000
MIN_DOCS = 8
#: How many documents a prior is worth: least and most, and without two sites to compare.
WORTH, UNKNOWN = (1.0, 10_000.0), 100.0
#: Weight of the absolute coefficients against the likelihood of the whole sample.
PENALTY = 0.5
STEMS = (6, 4)
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]+")
QUESTIONS = ("low", "toxic")
BIAS = "\x00bias"


def step(name: str, share: float, steps: int) -> str:
    return f"\x00{name}{min(steps, int(share * steps))}"


def features(text: str | None) -> set[str]:
    """The distinct words of a whole text, without the punctuation around them, their beginnings, and its shape."""
    if not text:
        return set()
    words = text.lower().split()
    kinds = set(words)
    n, chars = max(1, len(words)), len(text)
    lines = [x for x in text.split("\n") if x]
    out = {w.strip(SYMBOLS) for w in kinds}
    out.discard("")
    # beginnings of words stand for their inflections and compounds; many different words with one count more
    plain = list(out)
    for size in STEMS:
        stems = Counter([w[:size] + "*" for w in plain if len(w) > size])
        out.update(stems)
        out.update([s + "*" for s, n in stems.items() if n >= 3])
    out |= {
        step("symbols", sum(map(text.count, SYMBOLS)) / chars, 40),
        step("digits", sum(map(text.count, "0123456789")) / chars, 20),
        step("capitals", sum(map(len, CAPITALS.findall(text))) / chars, 10),
        step("again", sum(map(str.__eq__, words, words[1:])) / n, 20),
        step("kinds", len(kinds) / n, 20),
        step("lines", 1 - len(set(lines)) / max(1, len(lines)), 10),
        step("length", sum(map(len, words)) / n / 20, 20),
        f"\x00size{int(math.log2(n))}",
    }
    return out


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, dict[str, float]]:
    """Weights of the features for each question; the driver sees SCREENED features a question and the
    MAX_LABELLED rows as numbers of these."""
    usable = labels.select(F.col("doc_id").cast("long").alias("l_id"), (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    chosen = materialise(usable.where("l_id is not null").orderBy(F.xxhash64("l_id"), "low", "toxic").limit(MAX_LABELLED), "labels")
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).groupBy("text").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "tokens": [sorted(features(t)) for t in batch["text"]], "low": batch["low"], "toxic": batch["toxic"]})

    rows = rows.withColumn("key", F.xxhash64("text"))
    sample = materialise(rows.mapInPandas(tokens, "key long, tokens array<string>, low double, toxic double"), "sample")
    known = {t: i for i, t in enumerate(screened(sample))}

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.array(sorted(known[t] for t in row if t in known), "<i4").tobytes() for row in batch["tokens"]]
            yield pd.DataFrame({"key": batch["key"], "found": found, "low": batch["low"], "toxic": batch["toxic"]})

    # MAX_LABELLED rows at most, each with the few of the screened features that it has; in one order, for equal sums in every run
    matrix = sample.mapInPandas(numbered, "key long, found binary, low double, toxic double").toPandas().sort_values(["key", "found"])
    out: dict[str, dict[str, float]] = {}
    for question in QUESTIONS:
        usable_rows = matrix[matrix[question].notna()]
        y = usable_rows[question].to_numpy(float)
        if not known or len(set(y)) < 2:
            out[question] = {}
            continue
        bias, weights = lasso([np.frombuffer(f, "<i4") for f in usable_rows["found"]], y, len(known))
        out[question] = {t: float(weights[i]) for t, i in known.items() if weights[i]} | {BIAS: bias}
    return out


def screened(sample: DataFrame) -> list[str]:
    """The features that say most about one of the questions, by the likelihood ratio of their counts."""
    sums = [F.sum(q).alias(q) for q in QUESTIONS]
    counts = sample.select(F.explode("tokens").alias("token"), *QUESTIONS).groupBy("token").agg(F.count("*").alias("n"), *sums)
    counts = materialise(counts.where(F.col("n") >= MIN_DOCS), "counts")
    totals = sample.agg(F.count("*").alias("n"), *sums).first()
    found: set[str] = set()
    for q in QUESTIONS:
        share = (totals[q] or 0) / max(1, totals["n"])
        if not 0 < share < 1:
            continue

        def part(seen: Column, expected: Column) -> Column:
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

        ratio = part(F.col(q), F.col("n") * share) + part(F.col("n") - F.col(q), F.col("n") * (1 - share))
        best = counts.where(F.col(q).isNotNull()).orderBy(ratio.desc(), "token").limit(SCREENED)
        found |= {r["token"] for r in best.select("token").collect()}
    return sorted(found)


def lasso(found: list[np.ndarray], y: np.ndarray, features: int, rounds: int = 40) -> tuple[float, np.ndarray]:
    """(bias, weights) of a logistic model of rows of features, with PENALTY on absolute weights: one weight after
    the other takes a Newton step, cut to 1, from where the penalty lets it."""
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.concatenate(found) if found else np.zeros(0, np.int32)
    order = np.argsort(col, kind="stable")
    edges = np.searchsorted(col[order], np.arange(features + 1))
    rows = [row[order[a:b]] for a, b in zip(edges, edges[1:])]
    weights, bias = np.zeros(features), 0.0
    margin = np.zeros(len(y))

    def step(at: np.ndarray | slice) -> tuple[float, float]:
        p = 1 / (1 + np.exp(-margin[at]))
        return float((p - y[at]).sum()), float((p * (1 - p)).sum()) + 1e-3

    active = range(features)
    for turn in range(rounds):
        g, h = step(slice(None))
        move = float(np.clip(-g / h, -1, 1))
        bias += move
        margin += move
        most = abs(move)
        for j in active:
            g, h = step(rows[j])
            old = weights[j]
            aim = old - g / h
            new = np.sign(aim) * max(abs(aim) - PENALTY / h, 0.0)
            new = old + float(np.clip(new - old, -1, 1))
            if new != old:
                weights[j] = new
                margin[rows[j]] += new - old
                most = max(most, abs(new - old))
        if most < 1e-3:
            break
        # between full rounds only weights that are not zero move
        active = range(features) if turn % 8 == 7 else np.flatnonzero(weights).tolist()
    return bias, weights


def evidence(docs: DataFrame, model: dict[str, dict[str, float]], host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` as a column ``row``, the host and path of each, and the log odds that its text alone gives."""
    sites = [docs[f"`{c}`"].cast("string") if c in docs.columns else F.lit(None).cast("string") for c in (host, path)]
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), sites[0].alias("host"), sites[1].alias("path"), docs["text"].cast("string").alias("text"))

    @F.pandas_udf("low double, toxic double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = []
        for t in texts:
            have = features(t)
            found.append([sum((m[x] for x in have & m.keys()), m[BIAS]) if have and m else None for m in (model[q] for q in QUESTIONS)])
        return pd.DataFrame(found, columns=list(QUESTIONS), dtype=float)

    return packed.withColumn("own", judge("text")).select("row", "host", "path", F.col("own.low").alias("low"), F.col("own.toxic").alias("toxic"))


def chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def odds(rate: Column) -> Column:
    return F.log(rate / (1 - rate))


def shrunk(k: Column, n: Column, toward: Column, worth: float) -> Column:
    return (k + worth * toward) / (n + worth)


def rates(judged: DataFrame) -> DataFrame:
    """A row per host and path. Per question: its shrunk rate, the corpus' rate, the sums of the path (k, n) and of
    the host (h_k, h_n), and how many documents the priors of hosts and of paths are worth."""
    sums = [x for q in QUESTIONS for x in (F.coalesce(F.sum(chance(F.nanvl(q, F.lit(None)))), F.lit(0.0)).alias(f"{q}_k"), F.count(F.nanvl(q, F.lit(None))).alias(f"{q}_n"))]
    paths = materialise(judged.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy(F.col("host").alias("of_host")).agg(*[F.sum(f"{q}_{x}").alias(f"{q}_h_{x}") for q in QUESTIONS for x in "kn"])
    out = materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host"), "sites")
    for q in QUESTIONS:
        total, n = paths.agg(F.sum(f"{q}_k"), F.sum(f"{q}_n")).first()
        # one document each way keeps rates off 0 and 1
        all_ = ((total or 0) + 1) / ((n or 0) + 2)
        worth = {f"{q}_h_worth": pseudo_documents(hosts, f"{q}_h_k", f"{q}_h_n", all_), f"{q}_worth": pseudo_documents(out, f"{q}_k", f"{q}_n", None, f"{q}_h_k", f"{q}_h_n")}
        out = out.withColumn(f"{q}_all", F.lit(all_)).withColumns({c: F.lit(w) for c, w in worth.items()}).withColumn(f"{q}_rate", site_rate(q))
    return out


def site_rate(q: str, left_out: Column | None = None) -> Column:
    """The shrunk rate of a path, without the chance ``left_out`` of one of its documents (null: it has none)."""
    one = F.lit(0) if left_out is None else left_out.isNotNull().cast("int")
    chance_ = F.lit(0.0) if left_out is None else F.coalesce(left_out, F.lit(0.0))

    def part(c: str) -> tuple[Column, Column]:
        # differences of sums can fall below 0 by rounding, or above what is left
        n = F.col(f"{q}_{c}n") - one
        return F.greatest(F.lit(0.0), F.least(n.cast("double"), F.col(f"{q}_{c}k") - chance_)), n

    of_host = shrunk(*part("h_"), F.col(f"{q}_all"), F.col(f"{q}_h_worth"))
    of_path = shrunk(*part(""), of_host, F.col(f"{q}_worth"))
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), of_path))


def pseudo_documents(sites: DataFrame, k: str, n: str, mean: float | None, above_k: str = "", above_n: str = "") -> float:
    """How many documents the prior of ``sites`` is worth, by moments of their rates around ``mean``, or around the rate of
    the site above each: many if they differ no more than chance."""
    sites = sites.where(F.col(n) > 0)
    if mean is None:
        centre, group, share = F.col(above_k) / F.col(above_n), F.countDistinct("host") + F.max(F.col("host").isNull().cast("int")), F.col(n) / F.col(above_n)
    else:
        centre, group, share = F.lit(mean), F.lit(1), None
    noise = centre * (1 - centre)
    # a group of m sites has m - 1 free differences: each site takes its share of the one that is lost
    shares = F.sum(F.col(n) * F.col(n)) / F.sum(n) if share is None else F.sum(F.col(n) * share)
    lost = F.first(noise) if share is None else F.sum(noise * share)
    row = sites.agg(
        F.count("*").alias("sites"), group.alias("groups"), F.sum(n).alias("n"), shares.alias("own"), F.sum(F.col(n) * (F.col(k) / F.col(n) - centre) ** 2).alias("spread"),
        (F.sum(noise) - lost).alias("free"), (F.sum(noise * F.col(n)) / F.sum(n)).alias("noise"),
    ).first()
    if not row["sites"] or row["sites"] <= row["groups"]:
        return UNKNOWN
    between = (row["spread"] - row["free"]) / max(1.0, row["n"] - row["own"])
    return WORTH[1] if between <= 0 else min(WORTH[1], max(WORTH[0], row["noise"] / between - 1))


def posteriors(judged: DataFrame, answered: tuple[str, ...] = QUESTIONS) -> DataFrame:
    """``judged`` (host, path, the own log odds of each question, ...) with each question's site rate, the document left out, and
    its posterior; a question that is not ``answered`` has a posterior of 0."""
    sites = rates(judged.select("host", "path", *QUESTIONS)).drop(*[f"{q}_rate" for q in QUESTIONS]).withColumnsRenamed({"host": "s_host", "path": "s_path"})
    here = F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path"))
    out = judged.join(sites, here)
    for q in QUESTIONS:
        own = F.nanvl(q, F.lit(None))
        out = out.withColumn(f"{q}_rate", site_rate(q, chance(own)))
        seen = F.coalesce(own - odds(F.col(f"{q}_all")), F.lit(0.0))
        out = out.withColumn(f"{q}_posterior", chance(seen + odds(F.col(f"{q}_rate"))) if q in answered else F.lit(0.0))
    return out.select(*judged.columns, *[f"{q}_{x}" for q in QUESTIONS for x in ("rate", "all", "posterior")])


def classify(docs: DataFrame, labels: DataFrame, limit: float = 0.5, host: str = "source", path: str = "lang") -> DataFrame:
    """row (all columns of ``docs``), host, path, each question's own log odds, site rate and posterior, and rejected."""
    model = fit(docs, labels)
    out = posteriors(evidence(docs, model, host, path), tuple(q for q in QUESTIONS if model[q]))
    return out.withColumn("rejected", F.greatest("low_posterior", "toxic_posterior") > limit)


def kept(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    return classify(docs, labels, limit).where(~F.col("rejected")).select("row.*")
