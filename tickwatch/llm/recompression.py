"""Substring dedup by recompression.

Every document is a row of words. A round of recompression joins neighbouring symbols into larger ones: equal
neighbours (runs), and pairs whose first symbol is of the round's left half and whose second of its right half,
halves being a bit of the symbols' names. A name is a fingerprint of the words that a symbol stands for, so it is the same in
every document and on every machine without any exchange. Whether two symbols are joined depends on these two only;
so equal stretches of text get equal symbols inside, wherever they stand, and only the symbols at a stretch's edges
can differ. For each edge of a symbol we keep how far to the left and right its making has looked: a window of
``window`` words that holds all of that is certain to hold the symbol.

Each window is represented by an anchor: of the symbols it is certain of at the highest round that has any,
the one with the smallest hash. Equal windows choose equal anchors, and neighbouring windows mostly share one, so there is
a record for each fifteen words or so: its windows, and the cover, all words that these windows hold.

Verification goes from large to small. (1) Each record is keyed by its cover, and by its anchor with the words
before it, and with those after it, up to half a window: of two equal windows' records one of these halves is equal. One
pre-aggregation finds the covers that occur in several documents, and the halves that occur in several covers.
(2) A second pass emits the records of such covers, and, only for records with such a half, the edges of passages and
surroundings of edits, the windows one by one. Which keys matter is looked up in a bit filter of fixed size
(``FILTER_BITS``); what it lets through too much finds no partner. A text that repeats one line has the same covers and
windows over and over: places of one key whose words meet leave as one stretch, so a key has at most one row for each ``window``
words of a text. (3) Of equal covers, and of equal windows, all but those of the
smallest doc_id are repeats; their words are removed. Each key has one source, so the join makes no more rows than it has
places. Keys are pre-aggregated and joined, never gathered, so a passage in a third of all documents is no hot task.

Fingerprints that decide have 128 bits.

Defined results: null, empty and short texts lose no word; a row without doc_id loses none and is no source; rows with one
doc_id and different texts are judged each by its own text, and are no source for each other; repeated rows give repeated rows;
an empty table gives no rows; other columns may have any name and are passed through by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import BASES, U, Sequences, chunks, hashed_words, materialise, mix

WINDOW = 50
ROUNDS = 4
FAR = 1 << 40
#: Size of the filter that is sent to all executors: 4 MB, whatever the input. A larger corpus wants a larger one: it
#: only decides how many records are looked at in vain, not the result.
FILTER_BITS = 1 << 25
KEYS = "k1 long, k2 long, value long"
PLACES = "k1 long, k2 long, doc_id long, thash long, first int, last int"


class Level:
    """The symbols of one round over all words of a chunk: where each begins and ends, its name, its document, and
    how far left the making of its left edge has looked, and how far right that of its right edge."""

    def __init__(self, start: np.ndarray, end: np.ndarray, name: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.start, self.end, self.name, self.doc, self.left, self.right = start, end, name, doc, left, right


def words_level(names: np.ndarray, doc: np.ndarray) -> Level:
    at = np.arange(len(names))
    return Level(at, at + 1, names, doc, at, at + 1)


def next_level(level: Level, prints: Sequences, turn: int) -> Level:
    """One round: runs and pairs become symbols."""
    salt = U((2 * turn + 1) * BASES[0] % (1 << 64))
    half = (mix(level.name + salt) >> U(63)).astype(bool)
    inside = level.doc[1:] == level.doc[:-1]
    joined = inside & ((level.name[1:] == level.name[:-1]) | (~half[:-1] & half[1:]))
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    last = np.concatenate([first[1:] - 1, [len(level.name) - 1]])
    start, end, doc = level.start[first], level.end[last], level.doc[first]
    # an edge is certain once the symbols on both its sides are; at a text's edge it never is
    left, right = np.full(len(first), -FAR), np.full(len(first), FAR)
    inner = np.flatnonzero(inside[first[1:] - 1]) + 1
    left[inner] = level.left[first[inner] - 1]
    inner = inner - 1
    right[inner] = level.right[last[inner] + 1]
    return Level(start, end, prints.of(start, end), doc, left, right)


class Records:
    """The stretches of windows with one anchor, over all texts of a chunk; ``begin`` and ``end`` are the anchor's words,
    ``first`` and ``last`` the windows' first words, all counted through the chunk."""

    def __init__(self, names: np.ndarray, texts: np.ndarray, window: int, rounds: int) -> None:
        """``names`` of all words, and where each text begins, with one entry more than texts."""
        counts = np.diff(texts)
        stops = np.repeat(texts[1:], counts)
        starts = np.flatnonzero(np.arange(len(names)) + window <= stops)
        doc = np.repeat(np.arange(len(counts)), counts)
        begin, end, kind = (np.zeros(len(starts), np.int64) for _ in range(3))
        self.prints = Sequences(names)
        self.covers = Sequences(names, 1)
        todo = np.arange(len(starts))
        levels = [words_level(names, doc)]
        for turn in range(rounds if len(starts) else 0):
            levels.append(next_level(levels[-1], self.prints, turn))
        for number, level in reversed(list(enumerate(levels))):
            # a window is certain of a symbol if it starts at ``low`` to ``high``
            usable = np.flatnonzero(level.right - level.left <= window)
            if not len(usable) or not len(todo):
                continue
            low, high = level.right[usable] - window, level.left[usable]
            rank = mix(level.name[usable] ^ U(number))
            from_, to = np.searchsorted(high, starts[todo]), np.searchsorted(low, starts[todo], "right")
            some = to > from_
            hit = todo[some]
            best = usable[leftmost_least(rank, from_[some], to[some])]
            begin[hit], end[hit], kind[hit] = level.start[best], level.end[best], number
            todo = todo[~some]
        own = doc[starts] if len(starts) else starts
        new = np.ones(len(starts), bool)
        new[1:] = (begin[1:] != begin[:-1]) | (kind[1:] != kind[:-1]) | (own[1:] != own[:-1])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:] - 1, [len(starts) - 1]]).astype(np.int64)[: len(head)]
        self.window, self.doc = window, own[head]
        self.first, self.last, self.begin, self.end = starts[head], starts[tail], begin[head], end[head]
        self.text, self.stop = texts[self.doc], texts[self.doc + 1]

    def cover(self) -> tuple[np.ndarray, np.ndarray]:
        """The key of all words of a record's windows. Its second part is odd; that of a half is 0, and that of a cover
        of a single window is another even number: such a record goes by its window."""
        to = self.last + self.window
        second = self.covers.of(self.first, to) | U(1)
        return self.prints.of(self.first, to), np.where(self.last > self.first, second, second ^ U(1) | U(2))

    def halves(self) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """(records, key) of the anchors with the words before them, and with those after them: any window that holds
        the anchor holds one of the two whole."""
        reach = (self.window - (self.end - self.begin) + 1) // 2
        before = np.flatnonzero(self.begin - reach >= self.text)
        after = np.flatnonzero(self.end + reach <= self.stop)
        return (
            (before, self.prints.of(self.begin[before] - reach[before], self.end[before])),
            (after, self.prints.of(self.begin[after], self.end[after] + reach[after])),
        )


def leftmost_least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the least of ``values[start:end]`` for many short stretches, the first of ties."""
    out = np.zeros(len(start), np.int64)
    if not len(start):
        return out
    size = end - start
    power = np.floor(np.log2(size)).astype(np.int64)
    table = np.arange(len(values))
    for p in range(int(power.max()) + 1):
        if p:
            reach = 1 << (p - 1)
            a, b = table[: len(table) - reach], table[reach:]
            table = np.where(values[b] < values[a], b, a)
        mine = np.flatnonzero(power == p)
        a, b = table[start[mine]], table[end[mine] - (1 << p)]
        out[mine] = np.where(values[b] < values[a], b, a)
    return out


def stretches(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, their ``last``): of each text's places with one key, those whose words meet become one, which begins at the
    first of them and ends with the last. Equal keys stand for equally many windows."""
    order = np.lexsort((first, k1))
    a, b = order[:-1], order[1:]
    new = np.ones(len(order), bool)
    new[1:] = (k1[a] != k1[b]) | (k2[a] != k2[b]) | (doc[a] != doc[b]) | (first[b] > last[a] + window)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(order))[: len(head)] - 1
    # in the order of the texts again: neighbours of one document pack better
    back = np.argsort(order[head])
    return order[head][back], last[order[tail]][back]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("thash"), text.alias("text"))


def keys(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """The keys of all records: covers with their doc_id, halves with their cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, texts in chunks(batch.column(2)):
                r = Records(*hashed_words(texts), window, rounds)
                c1, c2 = r.cover()
                (before, b1), (after, a1) = r.halves()
                none = np.zeros(len(before) + len(after), U)
                columns = [np.concatenate([c1, b1, a1]), np.concatenate([c2, none]), np.concatenate([ids[r.doc + at].view(U), c1[before], c1[after]])]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["k1", "k2", "value"])

    return keyed(docs).where("doc_id is not null and text is not null").mapInArrow(run, KEYS)


def spots(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of a key in the filter."""
    return [((key >> U(s)) % U(bits)).astype(np.int64) for s in (0, 17, 34)]


def bit_filter(ties: DataFrame, bits: int) -> np.ndarray:
    """The filter of all keys ``k1``: its 64-bit words are made by the executors; the driver gets ``bits`` bits at most."""
    places = [F.pmod(F.shiftrightunsigned("k1", s), F.lit(bits)) for s in (17, 34)]
    # the unsigned remainder, for keys that are negative as signed numbers
    places.append(F.pmod(F.pmod("k1", F.lit(bits)) + F.when(F.col("k1") < 0, F.lit((1 << 64) % bits)).otherwise(F.lit(0)), F.lit(bits)))
    set_ = ties.select(F.explode(F.array(*places)).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    words = set_.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(U)


def places(docs: DataFrame, window: int, rounds: int, bits: int, filter_: Broadcast, singles: bool) -> DataFrame:
    """(k1, k2, doc_id, thash, first, last): of windows whose record has a tied half or is a single, tied window
    (``singles``), or of these and all other records with a tied cover. ``first`` and ``last`` count words from the text's
    start; the words from ``first`` to ``last`` and a window further are all held by places of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_.value

        def tied(key: np.ndarray) -> np.ndarray:
            out = np.ones(len(key), bool)
            for spot in spots(key, bits):
                out &= (table[spot >> 6] >> (spot & 63).astype(U)) & U(1) == U(1)
            return out

        for batch in batches:
            for at, texts in chunks(batch.column(2)):
                r = Records(*hashed_words(texts), window, rounds)
                wanted = np.zeros(len(r.first), bool)
                for some, key in r.halves():
                    wanted[some[tied(key)]] = True
                c1, c2 = r.cover()
                own, several = tied(c1), r.last > r.first
                wanted = np.flatnonzero(wanted | own & ~several)
                n = r.last[wanted] - r.first[wanted] + 1
                start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - r.first[wanted], n)
                found = [(r.prints.of(start, start + window), r.covers.of(start, start + window) | U(1), np.repeat(wanted, n), start, start)]
                if not singles:
                    own = np.flatnonzero(own & several)
                    found.append((c1[own], c2[own], own, r.first[own], r.last[own]))
                k1, k2, own, first, last = map(np.concatenate, zip(*found))
                kept, last = stretches(k1, k2, r.doc[own], first, last, window)
                k1, k2, own, first = k1[kept], k2[kept], own[kept], first[kept]
                doc = pa.array(r.doc[own] + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), batch.column(0).take(doc), batch.column(1).take(doc), pa.array((first - r.text[own]).astype(np.int32)), pa.array((last - r.text[own]).astype(np.int32))],
                    names=["k1", "k2", "doc_id", "thash", "first", "last"],
                )

    return keyed(docs).where("doc_id is not null and text is not null").mapInArrow(run, PLACES)


def repeated(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, thash, first, last): stretches whose words, up to a window beyond ``last``, are all held by windows that
    also start in a document with a smaller doc_id."""
    ties = keys(docs, window, rounds).groupBy("k1", "k2").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low < high")
    ties = materialise(ties.select("k1", "k2", F.col("low").alias("source")), "ties")
    filter_ = docs.sparkSession.sparkContext.broadcast(bit_filter(ties, bits))
    # texts are parsed again rather than kept: a scan costs less than shuffling what it makes
    windows = places(docs, window, rounds, bits, filter_, singles=True).groupBy("k1", "k2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last_doc"))
    # a key is that of a window or that of a cover of several: none is in both
    sources = ties.where("k2 % 2 != 0").union(windows.where("source < last_doc").select("k1", "k2", "source"))
    found = places(docs, window, rounds, bits, filter_, singles=False).join(sources, ["k1", "k2"])
    return found.where("doc_id > source").select("doc_id", "thash", "first", "last")


def removed(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words, joined by single spaces) for every row."""
    return cut(keyed(docs), docs, window, rounds).select("doc_id", "n_words", "n_removed", "kept_text")


def deduplicated(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, length: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with their other columns; texts without their repeated words. A text that loses none stays
    as it is, and so does a null text. A column named ``length`` follows the text."""
    text, doc = docs["text"].cast("string"), docs["doc_id"].cast("long")
    # the text travels once, and beside it all other columns
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    packed = docs.select(doc.alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("thash"), text.alias("text"), F.struct(*others).alias("row"))
    out = cut(packed, docs, window, rounds)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kinds = dict(docs.dtypes)
    new = {"text": text}
    if length in docs.columns:
        new[length] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kinds[length])).otherwise(F.col(f"row.`{length}`"))
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def cut(rows: DataFrame, docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """``rows`` (doc_id, thash, text, ...) with n_words, n_removed and kept_text."""
    spans = repeated(docs, window, rounds).groupBy("doc_id", "thash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("thash").alias("s_hash"), "spans")
    with_spans = rows.join(spans, (F.col("doc_id") == F.col("s_id")) & (F.col("thash") == F.col("s_hash")), "left").drop("s_id", "s_hash")
    names = [c for c in with_spans.columns if c != "spans"]
    schema = ", ".join(f"`{c}` {t}" for c, t in with_spans.select(*names).dtypes) + ", n_words long, n_removed long, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text, at_spans = batch.schema.get_field_index("text"), batch.schema.get_field_index("spans")
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                rows_ = [without(t, s, window) for t, s in zip(piece.column(at_text).to_pylist(), piece.column(at_spans))]
                n, gone, kept = (list(c) for c in zip(*rows_))
                columns = [piece.column(piece.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    return with_spans.mapInArrow(run, schema)


def without(text: str | None, spans: pa.Scalar, window: int) -> tuple[int, int, str]:
    """(words, words removed, kept words joined by a space) of one text."""
    words = (text or "").encode("utf-8").split()  # of bytes: exactly the six ASCII separators
    if not spans.is_valid or not len(spans.values):
        return len(words), 0, b" ".join(words).decode("utf-8")
    first, last = (np.asarray(spans.values.field(c), np.int64) for c in (0, 1))
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, last + window, -1)
    keep = np.cumsum(depth[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join([w for w, k in zip(words, keep.tolist()) if k]).decode("utf-8")
