"""Byte-level BPE with a compiled lexicon of frequent words.

Words are counted over all documents; the frequent ones are merged once and
compiled, with their ids, into a minimal acyclic transducer that every task maps
into memory. Words that it does not hold are merged exactly. The result is
that of the tokenizers library for a byte-level BPE file.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tabsieve.llm.tables import giving_back, most_frequent, publish, whole_text
from tabsieve.llm.transducer import Transducer, compile_words
from tabsieve.plans.held import hold

#: At most this many words are compiled, those of the highest counts.
LEXICON_WORDS = 65_536
#: Longer words are never compiled.
LEXICON_BYTES = 64
#: Words that a task remembers, and partial counts that it holds.
REMEMBERED = 500_000
COUNTED = 200_000
#: Words of a long text, and bytes of short ones, that are encoded at a time.
WORDS_AT_A_TIME = 1 << 18
TEXT_BYTES = 1 << 22
#: Words of up to so many bytes are looked up and merged side by side, those of
#: similar length together; NONE is the rank of a pair that never merges.
WIDTHS = (8, 16, 32, 64)
NONE = np.iinfo(np.int32).max

# The contractions and classes by which the library cuts words.
_WORDS = r"'(?:[stmd]|re|ve|ll)| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable Latin-1,
    else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Model:
    """What tasks need to know of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cutter = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if not plain or spec["normalizer"] or cutter["type"] != "ByteLevel" or not cutter["use_regex"] or cutter["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens with options")
        vocab, letters = model["vocab"], byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.bytes_ids = [vocab[c] for c in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        tokens = {i: bytes(of_letter[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens |= {i: t.encode() for t, i in self.special.items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.late = _late_letters(Tokenizer.from_file(path))


def _late_letters(tokenizer: Tokenizer) -> tuple[str, str, str]:
    """Code points that are newer than Python's tables and that the installed regex
    knows as letters or numbers: all, and those the library takes for
    letters and for numbers. The library is asked, next to an a and a 1."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    late = [c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn"]
    known = []
    for neighbour in "a1":
        cuts = {at for _, (at, _) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"!{c}{neighbour}" for c in late))}
        known.append("".join(c for k, c in enumerate(late) if 3 * k + 2 not in cuts))
    return "".join(late), *known


def _ranges(letters: str) -> str:
    spans: list[list[int]] = []
    for c in sorted(map(ord, letters)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


class Words:
    """Cuts texts into words as the library does."""

    def __init__(self, model: Model):
        late, letters, numbers = (_ranges(x) for x in model.late)
        self.usual = regex.compile(_WORDS.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"))
        self.is_late = regex.compile(f"[{late}]") if late else None
        # Letters are the older ones and the late ones that the library knows.
        kinds = {k: f"[\\p{{{k}}}--[{late}]]" if not own else f"[[\\p{{{k}}}--[{late}]]||[{own}]]" for k, own in (("L", letters), ("N", numbers))}
        self.exact = regex.compile(_WORDS.format(L=kinds["L"], N=kinds["N"], l=kinds["L"], n=kinds["N"]), regex.V1) if late else None
        names = sorted(model.special, key=len, reverse=True)
        self.special = model.special
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def blocks(self, text: str) -> Iterator[list[str]]:
        """Lists of words in order; an added token is a list of its own."""
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield [part]
                continue
            pattern = self.exact if self.is_late and not _is_latin(part) and self.is_late.search(part) else self.usual
            if len(part) <= WORDS_AT_A_TIME:
                yield pattern.findall(part)
                continue
            found = (m[0] for m in pattern.finditer(part))
            while block := list(islice(found, WORDS_AT_A_TIME)):
                yield block


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Merger:
    """Merges the bytes of a word by rank, the leftmost first among equals."""

    def __init__(self, model: Model):
        self.bytes_ids = np.array(model.bytes_ids, np.int64)
        self.ranks = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(model.merges)}
        pairs = np.array(model.merges, np.int64).reshape(-1, 3)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), pairs[:, 2]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.rank[at], NONE)

    def ids_of_all(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` of words that are rows of bytes with the given sizes.

        Each round merges the best pair of every word that still has one.
        """
        places = np.arange(words.shape[1])
        ids = np.where(places < sizes[:, None], self.bytes_ids[words], -1)
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self._rank_of(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(ids))
        while len(live):
            now = ranks[live]
            at = now.argmin(axis=1)
            best = now[np.arange(len(live)), at]
            going = best < NONE
            live, at, best, now = live[going], at[going], best[going], now[going]
            if not len(live):
                break
            rows = np.arange(len(live))
            moved = np.minimum(places + (places > at[:, None]), places[-1])
            own, now = np.take_along_axis(ids[live], moved, axis=1), np.take_along_axis(now, moved, axis=1)
            own[:, -1], now[:, -1] = -1, NONE
            own[rows, at] = self.made[best]
            after = own[rows, np.minimum(at + 1, places[-1])]
            now[rows, at] = np.where(at < places[-1], self._rank_of(own[rows, at], after), NONE)
            inner = np.flatnonzero(at > 0)
            now[inner, at[inner] - 1] = self._rank_of(own[inner, at[inner] - 1], own[inner, at[inner]])
            ids[live], ranks[live] = own, now
        return ids[ids >= 0].astype("<i4"), (ids >= 0).sum(axis=1)

    def ids(self, word: bytes) -> list[int]:
        return self._queued(self.bytes_ids[np.frombuffer(word, np.uint8)].tolist())

    def _queued(self, ids: list[int]) -> list[int]:
        """With a queue and a linked list, for words of any length."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*ranks[pair], k, pair) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in ranks]
        queue = [(rank, k, new, pair) for rank, new, k, pair in queue]
        heapq.heapify(queue)
        gone = [False] * n

        def ask(k: int) -> None:
            if 0 <= k and after[k] < n and (found := ranks.get((ids[k], ids[after[k]]))):
                heapq.heappush(queue, (found[0], k, found[1], (ids[k], ids[after[k]])))

        while queue:
            _, k, new, pair = heapq.heappop(queue)
            if gone[k] or after[k] >= n or (ids[k], ids[after[k]]) != pair:
                continue
            right = after[k]
            ids[k], gone[right], after[k] = new, True, after[right]
            if after[k] < n:
                before[after[k]] = k
            ask(before[k])
            ask(k)
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]


def word_counts(docs: DataFrame, model: Model) -> DataFrame:
    """``(word, n)`` over all whole texts; words of up to LEXICON_BYTES bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(SimpleNamespace(**vars(model)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pieces = Words(shared.value), Counter()
        for batch in batches:
            for text in batch.column(0):
                # A word begins with its blank: what lies between blanks is cut once.
                pieces.update(text.as_py().split(" "))
                if len(pieces) > COUNTED:
                    yield _counts(pieces, words)
                    pieces = Counter()
        yield _counts(pieces, words)

    counted = docs.select(whole_text().alias("text")).mapInArrow(giving_back(count), "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(pieces: Counter, words: Words) -> pa.RecordBatch:
    seen: Counter = Counter()
    for piece, n in pieces.items():
        if piece.isalpha():  # one word, with its blank
            seen[" " + piece] += n
            continue
        for block in words.blocks(" " + piece):
            for word in block:
                seen[word] += n
    kept = [(w, n) for word, n in seen.items() if len(w := word.encode()) <= LEXICON_BYTES]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])


def build_lexicon(docs: DataFrame, model: Model) -> bytes:
    """The compiled lexicon of the documents' frequent words."""
    counts = hold(word_counts(docs, model).where("n > 1"), "words")
    words = [bytes(w) for w in most_frequent(counts, LEXICON_WORDS)]
    return compile_words((w, tuple(ids.tolist())) for w, ids in _merged(words, Merger(model)))


def _by_width(words: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Words of similar length as rows of bytes, with their sizes."""
    low = -1
    for width in WIDTHS:
        own = [w for w in words if low < len(w) <= width]
        if own:
            rows = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in own), np.uint8).reshape(-1, width)
            yield own, rows, np.array([len(w) for w in own])
        low = width


def _cut(flat: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(counts)
    return (flat[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True))


def _merged(words: list[bytes], merger: Merger) -> Iterator[tuple[bytes, np.ndarray]]:
    for own, rows, sizes in _by_width(words):
        yield from zip(own, _cut(*merger.ids_of_all(rows, sizes)), strict=True)


class Encoder:
    """Ids of texts, as 32-bit numbers in bytes."""

    def __init__(self, model: Model, lexicon: str):
        self.words, self.merger, self.lexicon = Words(model), Merger(model), Transducer(lexicon)
        self.special = {s: np.array([i], "<i4").tobytes() for s, i in model.special.items()}
        self.known = dict(self.special)

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; new words of short texts are learned together."""
        if len(texts) == 1:
            return [b"".join(self._ids([block])[0] for block in self.words.blocks(texts[0]))]
        return self._ids([[w for block in self.words.blocks(t) for w in block] for t in texts])

    def _ids(self, blocks: list[list[str]]) -> list[bytes]:
        new = set().union(*blocks).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict(self.special)
            new = set().union(*blocks).difference(self.known)
        spelled = {w.encode(): w for w in new}
        for data, ids in self._found(list(spelled)):
            self.known[spelled[data]] = ids.tobytes()
        known = self.known
        return [b"".join([known[w] for w in block]) for block in blocks]

    def _found(self, words: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Ids from the lexicon, or merged if it does not hold the word."""
        for own, rows, sizes in _by_width(words):
            held, flat, counts = self.lexicon.get_all(rows, sizes)
            yield from zip((w for w, here in zip(own, held, strict=True) if here), _cut(flat, counts), strict=True)
            other = ~held
            if other.any():
                merged = _cut(*self.merger.ids_of_all(rows[other], sizes[other]))
                yield from zip((w for w, here in zip(own, held, strict=True) if not here), merged, strict=True)
        for word in words:
            if len(word) > WIDTHS[-1]:
                yield word, np.array(self.merger.ids(word), "<i4")


class Decoder:
    """Texts of ids: the tokens' bytes, read as UTF-8."""

    def __init__(self, model: Model):
        self.data = np.frombuffer(b"".join(model.tokens), np.uint8)
        self.sizes = np.array([len(t) for t in model.tokens])
        self.first = np.cumsum(self.sizes) - self.sizes

    def text(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        moved = self.first[ids] - (np.cumsum(sizes) - sizes)
        return self.data[np.repeat(moved, sizes) + np.arange(sizes.sum())].tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of ``docs`` but its text, then ``ids`` and ``decoded``.

    ``tokenizer`` is the path of a byte-level BPE file, read on the driver. A
    missing text is empty: no ids, an empty text. Added tokens
    that occur in a text become their ids. Columns named like the new ones are
    replaced. Words are remembered per task within a bound and long texts are
    cut into words bit by bit, so memory follows the longest text only.
    """
    spark = docs.sparkSession
    model = Model(tokenizer)
    shared = spark.sparkContext.broadcast(SimpleNamespace(**vars(model)))
    file = publish(spark, "lexicon", build_lexicon(docs, model))
    kept = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    taken = docs.select(*[F.col(f"`{c}`") for c in kept], whole_text().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value, SparkFiles.get(file)), Decoder(shared.value)
        for batch in batches:
            begin = 0
            for end in _pieces(batch.column("text")):
                part = batch.slice(begin, end - begin)
                ids = [np.frombuffer(x, "<i4") for x in encoder.ids_of(part.column("text").to_pylist())]
                yield _encoded(part, kept, ids, [decoder.text(x) for x in ids])
                begin = end

    fields = [f for f in taken.schema.fields if f.name in kept]
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return taken.mapInArrow(giving_back(run), T.StructType([*fields, *made]))


def _pieces(texts: pa.Array) -> Iterator[int]:
    """Ends of runs of texts of about TEXT_BYTES; a longer one is alone."""
    size = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > TEXT_BYTES:
            yield k
            size = 0
        size += n
    if len(texts):
        yield len(texts)


def _encoded(batch: pa.RecordBatch, kept: list[str], ids: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists, pa.array(texts, pa.string())], [*kept, "ids", "decoded"])


def ids_text(ids: str = "ids"):
    """Decimal ids joined by commas."""
    return F.array_join(F.transform(F.col(ids), lambda x: x.cast("string")), ",")
