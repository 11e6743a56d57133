"""BPE with word ends, by speculation and verification.

For every word that is new to the process, greedy longest match proposes tokens. A row of tokens is the result of
the merges exactly if every token, and every two neighbours, stay as they are when merged alone; so all
adjacent pairs of a batch of words are tested at once against a table of pairs already judged, and only a pair that
was never seen is merged. Words with a pair that fails go through the exact merges. Words repeat within and
across documents; their tokens are kept per process in a table of bounded size.

Text is prepared as the vocabulary file asks: NFC, lower case, words cut by its pattern, white space dropped, bytes
written as characters. The vocabulary names no decoder, so decoding writes the tokens' strings with a space
between them.

Defined results: null and empty texts have no tokens and decode to the empty text; special tokens that occur in a text
are that token; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickwatch.llm.encoder import byte_chars

END = "</w>"
#: Stands for the end of a word while tokens are matched; no text byte is written as this character.
MARK = ""
#: The vocabulary's word pattern for texts without the characters of ODD.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Numbers that are no digits, separators that not every pattern library takes for white space, and characters that this
#: Python does not know in the planes that have characters: the library may know them.
ODD = {c for c in map(chr, [*range(4 << 16), *range(14 << 16, 15 << 16)]) if unicodedata.category(c) in ("No", "Nl", "Cn")} | set("\x1c\x1d\x1e\x1f\x85\u180e")
ODD_LATIN = re.compile("[" + "".join(c for c in sorted(ODD) if c < "\u0100") + "]")
#: Words and pairs kept per process. A full table starts anew, which changes no result.
MAX_WORDS = 800_000
MAX_PAIRS = 2_000_000
#: Up to so many symbols a plain search for the next merge beats a heap.
SHORT = 48
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
OUTPUT = "doc_id long, n_tokens long, ids binary, decoded string"
_codecs: dict[str, "Codec"] = {}


def codec(path: str) -> "Codec":
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


class Codec:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)  # for special tokens' ids and the cutting of odd texts only
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.ids = {marked(t): i for t, i in vocab.items()}
        self.symbols = {i: symbols(t) for t, i in self.ids.items()}
        self.ranks = {(marked(a), marked(b)): r for r, (a, b) in enumerate(map(tuple, spec["model"]["merges"]))}
        self.prefixes = {t[:n]: -1 for t in self.ids for n in range(1, len(t))} | self.ids  # of all tokens, -1 where it is none itself
        self.bytes = str.maketrans({b: c for c, b in byte_chars().items()})
        self.whole = np.full(max(self.strings) + 1, -1, np.int8)  # whether a token's own merges make it; -1: not yet known
        self._forget_pairs()
        self._forget_words()

    def _forget_pairs(self) -> None:
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def _forget_words(self) -> None:
        self.known: dict[str, int] = {}
        self.decoded: list[str] = []
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.used = 0

    # words

    def words(self, text: str) -> list[str]:
        """A text without special tokens as words, not yet written as byte characters."""
        if odd(text):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            back = byte_chars()
            return [bytes(back[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in pieces]
        # a capital sigma has one lower case here, wherever it stands
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match, or None where a stretch fits no token."""
        get, out, at, n = self.prefixes.get, [], 0, len(word)
        while at < n:
            best, to, end = -1, at + 1, at
            while to <= n and (token := get(word[at:to])) is not None:
                if token >= 0:
                    best, end = token, to
                to += 1
            if best < 0:
                return None
            out.append(best)
            at = end
        return out

    def merge(self, parts: list[str]) -> list[int]:
        """The exact merges: always the earliest rule that applies, leftmost first."""
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get, never = self.ranks.get, len(self.ranks)
        ranks = [get(p, never) for p in zip(parts, parts[1:])]
        parts = list(parts)
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), never)
        return [self.ids[p] for p in parts]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same by a heap, in time n log n."""
        ranks, n = self.ranks, len(parts)
        parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.ids[p] for p in parts if p]

    def fitting(self, pairs: np.ndarray) -> np.ndarray:
        """Which (first << 32 | second) pairs of tokens the merges leave as they are."""
        new = np.unique(pairs)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, new), len(self.pairs) - 1)
            new = new[self.pairs[at] != new]
        if len(new):
            if len(self.pairs) + len(new) > MAX_PAIRS:
                self._forget_pairs()
                new = np.unique(pairs)
            judged = np.fromiter((self._fits(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in new), bool, len(new))
            both, fits = np.concatenate([self.pairs, new]), np.concatenate([self.fits, judged])
            order = np.argsort(both)
            self.pairs, self.fits = both[order], fits[order]
        return self.fits[np.searchsorted(self.pairs, pairs)]

    def _fits(self, a: int, b: int) -> bool:
        return self.merge(self.symbols[a] + self.symbols[b]) == [a, b]

    def _whole(self, tokens: np.ndarray) -> np.ndarray:
        for t in np.unique(tokens[self.whole[tokens] < 0]).tolist():
            self.whole[t] = self.merge(self.symbols[t]) == [t]
        return self.whole[tokens] == 1

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word: proposed, verified together, merged where the proposal fails."""
        spelled = [w.encode("utf-8", "surrogateescape").decode("latin-1").translate(self.bytes) + MARK for w in words]
        proposed = [self.propose(s) for s in spelled]
        sizes = np.fromiter((len(p) if p else 0 for p in proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed if p for t in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        good = sizes > 0
        if len(flat):
            good[word[~self._whole(flat)]] = False
            inner = word[1:] == word[:-1]
            tested = ((flat[:-1] << 32) | flat[1:])[inner]
            good[word[1:][inner][~self.fitting(tested)]] = False
        return [p if ok else self.merge(symbols(s)) for p, ok, s in zip(proposed, good, spelled)]

    def learn(self, words: list[str]) -> None:
        found = self.encode_words(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total, at = int(sizes.sum()), len(self.known)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(found) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + total] = np.fromiter((t for p in found for t in p), np.uint32, total)
        self.ends[at + 1 : at + 1 + len(found)] = self.used + np.cumsum(sizes)
        self.used += total
        strings = self.strings
        self.decoded += [" ".join([strings[t] for t in p]) for p in found]
        self.known.update(zip(words, range(at, at + len(found))))

    # texts

    def _plain(self, parts: list[str]) -> tuple[np.ndarray, str]:
        if not parts:
            return np.zeros(0, "<u4"), ""
        known = self.known
        at = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        begin, end = self.ends[at], self.ends[at + 1]
        size = end - begin
        out = np.cumsum(size)
        ids = self.flat[np.arange(out[-1]) + np.repeat(begin - out + size, size)].astype("<u4")
        return ids, " ".join(map(self.decoded.__getitem__, at.tolist()))

    def round_trip(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """(ids, decoded text) of each text; all new words of the texts are encoded together."""
        pieces = [[p if i % 2 else self.words(p) for i, p in enumerate(self.cut.split(t))] if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for t in pieces for p in t[::2] for w in p) if w not in self.known]
        if len(self.known) + len(new) > MAX_WORDS and self.known:
            self._forget_words()
            new = list(dict.fromkeys(w for t in pieces for p in t[::2] for w in p))
        if new:
            self.learn(new)
        for t in pieces:
            if len(t) == 1:
                yield self._plain(t[0])
                continue
            parts = [(np.array([self.special[p]], "<u4"), p) if i % 2 else self._plain(p) for i, p in enumerate(t)]
            yield np.concatenate([np.zeros(0, "<u4"), *(i for i, _ in parts)]), " ".join(s for i, s in parts if len(i))


def odd(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not ODD.isdisjoint(text)
    return ODD_LATIN.search(text) is not None


def marked(token: str) -> str:
    return token[: -len(END)] + MARK if token.endswith(END) else token


def symbols(token: str) -> list[str]:
    """What the merges start from: single characters, the last of a word joined with its end."""
    return [*token[:-2], token[-2:]] if token.endswith(MARK) else list(token)


def pieces_of(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``most`` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32 bits, little-endian) and the decoded text of every document; or, so that they
    need not leave the task, the SHA-256 of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, to in pieces_of(texts):
                rows = [(len(i), i.tobytes(), d) for i, d in own.round_trip(texts[at:to])]
                n, ids, decoded = (list(c) for c in zip(*rows))
                if digests:
                    ids = [hashlib.sha256(x).hexdigest() for x in ids]
                    decoded = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded]
                columns = [batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pairs.mapInArrow(run, DIGESTS if digests else OUTPUT)
