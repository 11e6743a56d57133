"""Near-duplicate groups by SetSketch registers.

A document is the set of its 5-word shingles (A-Z lower-cased; fewer words are one shingle). Every shingle throws points
of a Poisson process onto ``REGISTERS`` registers; a register keeps its smallest point ``x`` as the whole number
``floor(1 - log_b(x))``, cut to 16 bits. Equal sets give equal registers, the sketch of a union is the maximum, and
registers of two sets agree with a probability close to their similarity.

Steps: (1) sets that are equal are one class, named by its smallest doc_id, so thousands of copies cost one sketch; if
classes have that doc_id in common, all but one are linked by keys of their own, and components get their names at the end;
(2) registers are banded, and classes that share a band meet in a bucket; (3) the two cardinalities and the registers
that agree, win and lose give the likelihood of each similarity: pairs whose estimate lies ``SLACK`` standard
errors under the threshold are dropped; (4) the rest is confirmed on the full sets.

Buckets never emit all their pairs. A class that meets many others over all its buckets is likely their origin: the one that
meets most is the bucket's head. First every class meets the head of the bucket it shares most often. Linked classes
form components, and from then on only buckets that hold several components matter: there, the head of the
bucket's largest component meets all outside it. Then members outside it meet all members of other components in blocks of bounded
size: a block's members travel with their registers and are compared within a task, each pair in the first band that it shares, and
only pairs that are likely become rows. Classes in crowded buckets get a second, longer sketch for this, of ``LONG`` registers of which
the lowest bit is kept: it drops nearly all that lies under the threshold but less than ``SLACK`` of the short sketch's standard errors.
Of the likely pairs the more probable ones are confirmed first, then those still between components. So
no link that a band has revealed is lost, and a bucket of n alike documents costs n pairs. With the parameters here a pair at
the threshold shares no band, or is dropped by one of its estimates, with a probability below 1e-6.

Defined results: null and empty texts have an empty set and are linked with nothing; a row without doc_id counts its
shingles and has no component, and is kept; rows with equal doc_id count as one document each by its own text; repeated rows
give repeated rows; an empty table gives no rows; other columns may have any name and are passed through by ``survivors``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import U, Sequences, chunks, hashed_words, materialise, mix, sized
from tickwatch.llm.components import components
from tickwatch.llm.recompression import FILTER_BITS, bit_filter, spots

WORDS = 5
BANDS, ROWS = 45, 4
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
TOP = (1 << 16) - 1
SLACK = 5.0
#: Bytes of text that are compared at once.
COMPARED = 1 << 21
#: Members of a bucket that meet as many others in one task, and pairs of them that are compared at once.
BLOCK, PAIRS = 256, 1 << 13
#: Registers of the longer sketch, and from how many pairs of a bucket on its members get one.
LONG, CROWDED = 4096, 1024
#: Sets whose longer sketches are drawn at once.
DRAWN = 128
SKETCH = "doc_id long, thash long, n_shingles long, f1 long, f2 long, registers binary"


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and the first of each text (one entry more)."""
    hashes, first = hashed_words(texts, lower=True)
    n = np.diff(first)
    per = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    doc = np.repeat(np.arange(len(n)), per)
    start = np.repeat(first[:-1] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    end = np.minimum(start + words, first[1:][doc])
    found = Sequences(hashes).of(start, end)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[keep], doc[keep]
    return found, np.searchsorted(doc, np.arange(len(n) + 1))


def registers(found: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The sketch of each set, ``m`` registers of unsigned 16 bits; of an empty set all 0.

    Each shingle draws its points in ascending order, so it is done once its next point is above the largest minimum
    of its set: about m * ln(m) points per set, whatever its size.
    """
    sets = len(first) - 1
    least = np.full(sets * m, np.inf)
    doc = np.repeat(np.arange(sets), np.diff(first))
    live, at, draw = np.arange(len(found)), np.zeros(len(found)), 0
    block = 1
    while len(live):
        steps = np.arange(draw + 1, draw + block + 1, dtype=U)
        seeds = mix(found[live][:, None] + steps[None, :] * U(0x9E3779B97F4A7C15))
        gaps = -np.log(((seeds >> U(11)).astype(float) + 0.5) * 2.0**-53) / (m * RATE)
        points = at[live][:, None] + np.cumsum(gaps, axis=1)
        where = (mix(seeds) % U(m)).astype(np.int64) + doc[live][:, None] * m
        np.minimum.at(least, where.ravel(), points.ravel())
        at[live] = points[:, -1]
        bound = least.reshape(sets, m).max(axis=1)
        live = live[at[live] < bound[doc[live]]]
        draw += block
        block = min(32, block * 2)
    with np.errstate(divide="ignore"):
        out = np.floor(1 - np.log(least) / math.log(BASE))
    return np.clip(out, 0, TOP).astype(np.uint16).reshape(sets, m)


def sketches(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): its text's hash, set size, set fingerprint and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(2)):
                found, first = shingles(texts)
                ends = np.zeros((2, len(found) + 1), U)
                np.cumsum(mix(found), out=ends[0, 1:])
                np.cumsum(mix(found ^ U(0x5851F42D4C957F2D)), out=ends[1, 1:])
                f1, f2 = (e[first[1:]] - e[first[:-1]] for e in ends)
                raw = [r.tobytes() for r in registers(found, first)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(np.diff(first)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(raw, pa.binary())],
                    names=["doc_id", "thash", "n_shingles", "f1", "f2", "registers"],
                )

    return keyed(docs).select("doc_id", "thash", "text").mapInArrow(run, SKETCH)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("thash"))


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most likely similarity of sets of sizes ``n`` and ``m`` with the registers ``a`` and ``b``.

    The chances that a register of one set wins, loses or ties follow from the sizes and the similarity in
    closed form; the best of a grid of similarities is taken.
    """
    u, v = n / (n + m), m / (n + m)
    wins, losses = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    grid = np.linspace(0, 1, 129)[None, :] * np.minimum(u / v, v / u)[:, None]

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    win, lose = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    small = 1e-12
    like = wins * np.log(win + small) + losses * np.log(lose + small) + (a.shape[1] - wins - losses) * np.log(np.maximum(1 - win - lose, small))
    return np.take_along_axis(grid, like.argmax(axis=1)[:, None], 1)[:, 0]


def lowest(threshold: int) -> float:
    """The estimate that a pair at the threshold does not fall under."""
    level = threshold / 100
    return level - SLACK * math.sqrt(level * (1 - level) / REGISTERS)


def long_sketches(texts: DataFrame) -> DataFrame:
    """(id, bits): the lowest bits of LONG registers of each text's set. Those of different registers agree by even chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in chunks(batch.column(1), max_docs=DRAWN):
                bits = np.packbits((registers(*shingles(some), LONG) & 1).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array([b.tobytes() for b in bits], pa.binary())], names=["id", "bits"])

    return texts.select("id", "text").mapInArrow(run, "id long, bits binary")


def estimate_long(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity of sets from the share of bits that agree, ``(1 + similarity) / 2`` of all; rows are 64-bit words."""
    return 1 - 2 * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) / (64 * a.shape[1])


def lowest_long(threshold: int) -> float:
    """The longer sketches' estimate that a pair at the threshold does not fall under."""
    agree = (1 + threshold / 100) / 2
    return threshold / 100 - SLACK * 2 * math.sqrt(agree * (1 - agree) / LONG)


def likely(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of classes that may reach the threshold by their sizes and registers."""
    floor = lowest(threshold)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                p = batch.iloc[at : at + 2048]
                x, y = (np.frombuffer(b"".join(p[c]), np.uint16).reshape(len(p), -1) for c in ("ra", "rb"))
                fine = estimate(x, y, p["na"].to_numpy(float), p["nb"].to_numpy(float)) >= floor
                yield p.loc[fine, ["a", "b"]]

    left = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInPandas(test, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3)))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right"))
                p = batch.slice(at, max(1, to - at))
                at += p.num_rows
                (x, fx), (y, fy) = shingles(p.column(2).cast(pa.large_string())), shingles(p.column(3).cast(pa.large_string()))
                # equal (pair, shingle) of both sides, by one sort
                px, py = np.repeat(np.arange(p.num_rows), np.diff(fx)), np.repeat(np.arange(p.num_rows), np.diff(fy))
                pair, all_ = np.concatenate([px, py]), np.concatenate([x, y])
                order = np.lexsort((all_, pair))
                pair, all_ = pair[order], all_[order]
                same = (pair[1:] == pair[:-1]) & (all_[1:] == all_[:-1])
                both = np.bincount(pair[1:][same], minlength=p.num_rows)
                union = np.diff(fx) + np.diff(fy) - both
                keep = pa.array((100 * both >= threshold * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([p.column(0).filter(keep), p.column(1).filter(keep)], names=["a", "b"])

    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(test, "a long, b long")


def bucket_of(values: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The bucket of four registers, as 64 bits, of a band."""
    return mix(values + (band + 1).astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def banded(nodes: DataFrame) -> DataFrame:
    """(bucket, id) for every band of every class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                p = batch.iloc[at : at + 2048]
                values = np.frombuffer(b"".join(p["registers"]), "<u8").reshape(len(p), BANDS)  # four registers are 64 bits
                keys = bucket_of(values, np.arange(BANDS)[None, :])
                yield pd.DataFrame({"bucket": keys.ravel(), "id": np.repeat(p["id"].to_numpy(), BANDS)})

    return nodes.select("id", "registers").mapInPandas(run, "bucket long, id long")


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, thash, n_shingles, component_id, kept and n_links (links found with the document's class) per row."""
    sets = materialise(sketches(docs), "sketches")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = materialise(sets.where(own).groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.min_by("thash", "doc_id").alias("thash")), "classes")
    classes, shared = numbered(classes)
    links, labels = linked(docs, classes, threshold)
    if shared:
        # a component's smallest key may belong to a class of a larger doc_id
        doc = labels.join(classes.select("id", "doc"), "id").groupBy("component").agg(F.min("doc").alias("doc"))
        single = classes.where("id != doc").join(labels, "id", "left_anti").select(F.col("id").alias("component"), "doc")
        other = materialise(doc.where("doc != component").union(single), "names").withColumnRenamed("component", "named")
        all_ = classes.select("id").join(labels, "id", "left").withColumn("named", F.coalesce("component", "id"))
        labels = all_.join(other, "named", "left").select("id", F.coalesce("doc", "named").alias("component"))
    named = classes.select("f1", "f2", "id").join(labels, "id", "left")
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_links"))
    named = named.join(degree, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = sets.select("doc_id", "thash", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", "thash", "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def numbered(classes: DataFrame) -> tuple[DataFrame, bool]:
    """``classes`` with a key ``id`` of their own, and whether any differs from doc, the smallest doc_id.

    Of the classes with the same doc the one with the smallest fingerprint keeps it as its key; the others' keys are hashes,
    drawn again until no two classes share one.
    """
    shared = classes.groupBy("doc").agg(F.count("*").alias("n_sets"), F.min(F.struct("f1", "f2")).alias("least")).where("n_sets > 1")
    shared = materialise(shared.select("doc", F.col("least.f1").alias("least1"), F.col("least.f2").alias("least2")), "shared-ids")
    if shared.isEmpty():
        return classes.withColumn("id", F.col("doc")), False
    salt, own = 0, F.col("least1").isNull() | ((F.col("f1") == F.col("least1")) & (F.col("f2") == F.col("least2")))
    while True:
        key = F.when(own, F.col("doc")).otherwise(F.xxhash64("doc", "f1", "f2", F.lit(salt)))
        out = materialise(classes.join(shared, "doc", "left").withColumn("id", key).drop("least1", "least2"), "classes")
        if out.groupBy("id").count().where("count > 1").isEmpty():
            return out, True
        salt += 1


def linked(docs: DataFrame, classes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Links between classes that join their components, and (id, component) of all linked classes."""
    spark = docs.sparkSession
    nodes = classes.select("id", "n", "registers")
    rows = banded(nodes)
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    rows = sized(rows.join(shared, "bucket"), "buckets")
    degrees = rows.groupBy("id").agg(F.sum("size").alias("degree"))
    rows = sized(rows.select("bucket", "id").join(degrees, "id"), "members")
    wanted = materialise(classes.select("id", F.col("doc").alias("doc_id"), "thash").join(degrees.select("id"), "id"), "contenders")
    texts = among(docs, wanted).join(wanted, ["doc_id", "thash"]).dropDuplicates(["doc_id", "thash"])
    texts = materialise(texts.select("id", "text"), "texts")

    best = F.max(F.struct("degree", (-F.col("id")).alias("first"))).alias("best")
    heads = rows.groupBy("bucket").agg(best).select("bucket", (-F.col("best.first")).alias("head"), F.col("best.degree").alias("head_degree"))
    meets = rows.join(heads, "bucket").where("id != head").groupBy("id", "head").agg(F.count("*").alias("often"), F.max("head_degree").alias("head_degree"))
    meets = meets.groupBy("id").agg(F.max_by("head", F.struct("often", "head_degree", "head")).alias("head"))
    pairs = ordered(meets, "id", "head")

    links = tried = spark.createDataFrame([], "a long, b long")
    state, labels = rows, None
    for _ in range(2):  # heads of buckets, then hubs of components
        near = sized(likely(pairs, nodes, threshold), "likely")
        links = links.union(sized(confirmed(near, texts, threshold), "links"))
        tried = tried.union(near)
        labels = components(links)
        state = opened(state, labels)
        pairs = ordered(state.where("component != main"), "id", "hub").join(tried, ["a", "b"], "left_anti")
    crowded = state.where(F.col("outsiders") * F.col("members") >= CROWDED).select("id").distinct()
    long_ = sized(long_sketches(texts.join(crowded, "id").repartition("id")), "long-sketches")
    near = sized(across(state, nodes, long_, threshold).join(tried, ["a", "b"], "left_anti"), "likely")
    # what is probably linked first, for then much of the rest lies within components
    links = links.union(sized(confirmed(near.where(F.col("estimate") >= threshold / 100), texts, threshold), "links"))
    labels = components(links)
    rest = near.where(F.col("estimate") < threshold / 100).select("a", "b")
    for end in ("a", "b"):
        rest = rest.join(labels.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    rest = rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    links = links.union(sized(confirmed(rest, texts, threshold), "links"))
    return links, components(links)


def among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``keyed``, without most that are not ``wanted`` (doc_id, thash): a bit filter of fixed size keeps
    their texts out of the shuffle. What it lets through too much finds no partner."""
    key = F.xxhash64("doc_id", "thash").alias("k1")
    filter_ = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(key), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for spot in spots(batch.column(3).to_numpy().view(U), FILTER_BITS):
                keep &= (table[spot >> 6] >> (spot & 63).astype(U)) & U(1) == U(1)
            yield batch.filter(pa.array(keep)).select([0, 1, 2])

    return keyed(docs).select("doc_id", "text", "thash", key).mapInArrow(run, "doc_id long, text string, thash long")


def opened(state: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with the bucket's largest component and that one's hub."""
    best = F.max(F.struct("degree", (-F.col("id")).alias("first"))).alias("best")
    state = state.select("bucket", "id", "degree").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = state.groupBy("bucket", "component").agg(F.count("*").alias("size"), best)
    main = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component", "best")).alias("main"), F.count("*").alias("kinds"), F.sum("size").alias("members")).where("kinds > 1")
    main = main.select("bucket", F.col("main.component").alias("main"), (-F.col("main.best.first")).alias("hub"), "members", (F.col("members") - F.col("main.size")).alias("outsiders"))
    return sized(state.join(main, "bucket"), "open")


def across(state: DataFrame, nodes: DataFrame, long_: DataFrame, threshold: int) -> DataFrame:
    """(a, b, estimate) of all classes of different components that share an open bucket and may reach the threshold.

    Those outside a bucket's main component ("left") meet all its members ("right") in blocks of about BLOCK by BLOCK; a block's members
    travel with their registers, in crowded buckets with their longer sketches too, and are compared where they arrive, so that only
    likely pairs become rows. A pair of several buckets counts in the first band that it shares.
    """
    floor, floor_long, at_once, words = lowest(threshold), lowest_long(threshold), PAIRS, LONG // 64
    lefts, rights = (F.ceil(F.col(c) / BLOCK).cast("long") for c in ("outsiders", "members"))
    outside = F.col("component") != F.col("main")
    left, right = F.pmod(F.xxhash64("id", F.lit(1)), lefts), F.pmod(F.xxhash64("id", F.lit(2)), rights)

    def place(x: Column, y: Column, is_left: Column, is_right: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), is_left.alias("is_left"), is_right.alias("is_right"))

    yes, no, zero = F.lit(True), F.lit(False), F.lit(0).cast("long")
    as_left = F.transform(F.sequence(zero, rights - 1), lambda y: place(left, y, yes, no))
    as_right = F.transform(F.sequence(zero, lefts - 1), lambda x: place(x, right, no, yes))
    places = F.when(rights == 1, F.array(place(zero, zero, outside, yes))).when(outside, F.concat(as_left, as_right)).otherwise(as_right)
    bits = F.when(F.col("outsiders") * F.col("members") >= CROWDED, F.col("bits")).alias("bits")
    rows = state.join(nodes, "id").join(long_, "id", "left").select("bucket", "id", "component", outside.alias("outside"), "n", "registers", bits, F.explode(places).alias("place"))
    rows = rows.select("bucket", "place.*", "id", "component", "outside", "n", "registers", "bits")

    def compare(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
        bucket, group = p["bucket"].to_numpy(), np.cumsum(edges(p)) - 1
        ids, component, outside, n = (p[c].to_numpy() for c in ("id", "component", "outside", "n"))
        all_ = np.frombuffer(b"".join(p["registers"]), np.uint16).reshape(len(p), -1)
        bands = all_.view("<u8")
        has_long = p["bits"].notna().to_numpy()
        long_of = np.cumsum(has_long) - 1
        bits = np.frombuffer(b"".join(p["bits"][has_long]), "<u8").reshape(-1, words)
        left, right = np.flatnonzero(p["is_left"]), np.flatnonzero(p["is_right"])
        first, end = np.searchsorted(group[right], group[left]), np.searchsorted(group[right], group[left], "right")
        total = np.concatenate([[0], np.cumsum(end - first)])
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(total, total[at] + at_once, "right")) - 1)
            met = end[at:to] - first[at:to]
            i = np.repeat(left[at:to], met)
            j = right[np.repeat(first[at:to] - (total[at:to] - total[at]), met) + np.arange(met.sum())]
            at = to
            # two outsiders meet twice
            fine = (component[i] != component[j]) & (~outside[j] | (ids[i] < ids[j])) & (100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
            i, j = i[fine], j[fine]
            same = bands[i] == bands[j]
            band = same.argmax(axis=1)
            fine = same.any(axis=1) & (bucket_of(bands[i, band], band) == bucket[i])
            i, j = i[fine], j[fine]
            guess = estimate(all_[i], all_[j], n[i].astype(float), n[j].astype(float))
            fine = guess >= floor
            i, j, guess = i[fine], j[fine], guess[fine]
            both = np.flatnonzero(has_long[i] & has_long[j])
            guess[both] = estimate_long(bits[long_of[i[both]]], bits[long_of[j[both]]])
            fine = np.ones(len(i), bool)
            fine[both] = guess[both] >= floor_long
            a, b = ids[i[fine]], ids[j[fine]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "estimate": guess[fine]})

    def edges(p: pd.DataFrame) -> np.ndarray:
        keys = p[["bucket", "x", "y"]].to_numpy()
        return np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last block may go on in the next batch
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(batch):
                last = int(np.flatnonzero(edges(batch))[-1])
                held = batch.iloc[last:]
                if last:
                    yield from compare(batch.iloc[:last])
        if held is not None:
            yield from compare(held)

    keys = ["bucket", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long, estimate double")


def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def survivors(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one document of each group."""
    found = near_duplicates(docs, threshold)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.col("thash").alias("__gone_hash")).distinct()
    same = (docs["doc_id"].cast("long") == F.col("__gone_id")) & (F.coalesce(F.xxhash64(docs["text"].cast("string")), F.lit(0)) == F.col("__gone_hash"))
    return docs.join(gone, same, "left_anti")
