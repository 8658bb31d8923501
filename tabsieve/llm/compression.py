"""Toxicity by compression distance.

zstandard trains one dictionary on windows of ordinary text, and one on the windows
of toxic texts that are too frequent there for chance, in rounds: windows that the
dictionary so far does not shorten are trained on again, so that none is left out.
Every window of a text, of each of ``WIDTHS`` words, is compressed with the ordinary
dictionary and with the toxic one, which the ordinary one follows. A window that gets
shorter with the toxic dictionary resembles toxic text; how many windows gain
how many bytes is turned into a probability by a calibrated logistic function.
A window without any four or more bytes that the toxic dictionary has beyond the ordinary
one has the same matches with both, so it gains nothing and need not be compressed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm.tables import giving_back, whole_text

#: The classifier is fitted on at most this many labelled rows of each class,
#: those with the smallest hashes of their ids, of texts up to this many bytes.
TRAIN_ROWS = 3_000
TRAIN_BYTES = 32_768
#: Part of them that trains dictionaries; the others calibrate.
TRAIN_PART = 0.6
#: Windows of these numbers of words are compared, one after the other in a text.
WIDTHS = (1, 3)
#: A window stands between these two, which also end every dictionary: a
#: window is then never stored uncompressed, and its words never lie in the
#: last bytes of a block, where no match begins.
LEAD, TAIL = b"~window of a text, with the words that follow~", b"~and so it ends~"
LEVEL = 6
#: No shorter match is made. Fixed value.
SHORTEST = 4
#: Bytes are looked for in the toxic dictionary up to this length, by hashes of so many bits.
#: One 64-bit number holds them.
LONGEST, HASH_BITS = 8, 18
ORDINARY_BYTES = 1_024
ORDINARY_WORDS = 200_000
#: A toxic dictionary has this many bytes for each byte of its different windows.
TOXIC_SHARE = 2
#: zstandard trains no smaller dictionary.
SMALLEST_BYTES = 256
#: Beginnings of words, of these lengths, that mark text as toxic when they are in
#: clearly more toxic texts.
STEMS = (4, 5, 6, 7)
STEM_DEVIATIONS = 4.2
STEM_LOG_RATIO = 1.5
STEM_TEXTS = 3
#: Gains in bytes from -LIMIT to LIMIT are told apart.
LIMIT = 32
#: Words whose gains a task remembers.
REMEMBERED = 200_000
#: Wider windows in memory at once.
WINDOWS_AT_A_TIME = 4_096


def is_held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from; a missing id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str], float]:
    """Toxic texts, ordinary texts, and the part of toxic labels among all that
    may be learned from. A document with several labels is toxic if one says so."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, total = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    ranked = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    # At most twice TRAIN_ROWS ids.
    chosen = ranked.where("toxic = 1").limit(TRAIN_ROWS).unionByName(ranked.where("toxic = 0").limit(TRAIN_ROWS))
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.where(F.octet_length("text") <= TRAIN_BYTES).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    # Copies count once.
    kinds: dict[str, int] = {}
    for r in rows:
        kinds[r.text] = max(kinds.get(r.text, 0), r.toxic)
    pick = lambda k: [t for t, v in kinds.items() if v == k]
    return pick(1), pick(0), toxic / total if total else 0.0


def toxic_windows(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Windows of a word of toxic texts whose beginnings are in too many of those
    texts for chance, as often as they are there."""

    def texts_with(texts: list[str]) -> Counter:
        return Counter(stem for t in texts for stem in {w[:k] for w in t.lower().split() for k in STEMS})

    here, there = texts_with(toxic), texts_with(ordinary)
    marked = set()
    for stem, n in here.items():
        if n >= STEM_TEXTS:
            ratio = math.log((n + 0.5) / (len(toxic) + 1)) - math.log((there[stem] + 0.5) / (len(ordinary) + 1))
            if ratio > STEM_LOG_RATIO and _deviations(n, there[stem], len(toxic), len(ordinary)) > STEM_DEVIATIONS:
                marked.add(stem)
    return [regex.sub(r"\W+$", "", w) for t in toxic for w in t.lower().split() if any(w[:k] in marked for k in STEMS)]


def toxic_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """The different ones of those windows, the most frequent first."""
    return [w for w, _ in sorted(Counter(toxic_windows(toxic, ordinary)).items(), key=lambda x: (-x[1], x[0]))]


def _deviations(n: int, m: int, texts: int, others: int) -> float:
    """Root of the likelihood ratio that n of the texts and m of the others have
    something independently of the kind."""
    def part(x: int, of: int, expected: float) -> float:
        return x * math.log(x / (of * expected)) + (of - x) * math.log((of - x) / (of * (1 - expected)) if x < of else 1) if x else of * math.log(1 / (1 - expected))

    expected = (n + m) / (texts + others)
    if expected == 1:
        return 0.0
    return math.sqrt(2 * max(0.0, part(n, texts, expected) + part(m, others, expected)))


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """``(ordinary, toxic)`` dictionaries."""
    plain = [w for t in ordinary for w in t.lower().split()]
    stride = max(1, len(plain) // ORDINARY_WORDS)
    plain = plain[::stride] if stride == 1 else [w for k in range(0, len(plain), 20 * stride) for w in plain[k : k + 20]]
    base = _trained([" ".join(plain[k : k + 20]).encode("utf-8", "replace") for k in range(0, len(plain), 20)], ORDINARY_BYTES)
    base += LEAD + TAIL
    found, left = base, [f" {w} ".encode("utf-8", "replace") for w in toxic_windows(toxic, ordinary)]
    before = _lengths(_compressor(base), left)
    while left:
        distinct = b"".join(dict.fromkeys(left))
        # What is trained first comes last: the nearest matches are the cheapest.
        found = _trained(left, max(SMALLEST_BYTES, TOXIC_SHARE * len(distinct))) + found
        after = _lengths(_compressor(found), left)
        missed = [k for k in range(len(left)) if after[k] >= before[k]]
        if len(missed) == len(left):
            # Nothing more can be learned from so few: they are told word by word.
            found = distinct + found
            break
        left, before = [left[k] for k in missed], [before[k] for k in missed]
    return base, found


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples, or their last bytes if they are too few."""
    if len(samples) > 100:
        try:
            return zstandard.train_dictionary(size, samples, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def _lengths(compressor: zstandard.ZstdCompressor, windows: list[bytes]) -> list[int]:
    compress = compressor.compress
    return [len(compress(b"%b%b%b" % (LEAD, w, TAIL))) for w in windows]


class Windows:
    """Counts of the gains of a text's windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)
        self.known: dict[str, int] = {}
        self.beyond = _beyond(ordinary, toxic)

    def gains(self, text: str, width: int = 1) -> np.ndarray:
        """How many of the text's windows gain -LIMIT to LIMIT bytes."""
        return self._gains_of(text.lower().split(), width)

    def _gains_of(self, words: list[str], width: int) -> np.ndarray:
        if not words:
            return np.zeros(2 * LIMIT + 1, np.int64)
        if width > 1:
            found = np.zeros(2 * LIMIT + 1, np.int64)
            for k in range(0, len(words), width * WINDOWS_AT_A_TIME):
                some = words[k : k + width * WINDOWS_AT_A_TIME]
                found += np.bincount(self._gains([" ".join(some[j : j + width]) for j in range(0, len(some), width)]), minlength=2 * LIMIT + 1)
            return found
        # Words come again.
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known = self.known = {}
            new = set(words)
        new = list(new)
        known.update(zip(new, self._gains(new)))
        return np.bincount([known[w] for w in words], minlength=2 * LIMIT + 1)

    def _gains(self, windows: list[str]) -> list[int]:
        data = [f" {w} ".encode("utf-8", "replace") for w in windows]
        gains = np.full(len(data), LIMIT)
        at = self.may_gain(data)
        data = [data[k] for k in at]
        gains[at] += np.array(_lengths(self.ordinary, data), int) - np.array(_lengths(self.toxic, data), int)
        return np.clip(gains, 0, 2 * LIMIT).tolist()

    def may_gain(self, data: list[bytes]) -> list[int]:
        """Which windows have bytes that may be a match with the toxic dictionary and none
        with the ordinary one: those of equal hashes, so none is missed."""
        if not data:
            return []
        # Each with the bytes beside it, which no match begins with or goes on to but in LEAD and TAIL.
        lead, tail = LEAD[1 - SHORTEST :], TAIL[: LONGEST - 1]
        sizes = np.array([len(lead) + len(w) for w in data])
        begin = np.cumsum(sizes + len(tail)) - sizes - len(tail)
        numbers = _numbers(lead + (tail + lead).join(data) + tail)
        new, both = self.beyond[SHORTEST]
        hashes = _hashes(numbers, SHORTEST)
        found, doubtful = np.flatnonzero(new[hashes]), np.flatnonzero(both[hashes])
        kept = [found]
        for size in range(SHORTEST + 1, LONGEST + 1):
            new, both = self.beyond[size]
            hashes = _hashes(numbers[doubtful], size)
            kept.append(doubtful[new[hashes]])
            doubtful = doubtful[both[hashes]]
        at = np.concatenate(kept)
        window = np.searchsorted(begin, at, "right") - 1
        return np.unique(window[at - begin[window] < sizes[window]]).tolist()

    def features(self, text: str) -> np.ndarray:
        """A one, then the features of the gains of each width."""
        words = text.lower().split()
        return np.concatenate([[1.0], *(features(self._gains_of(words, width))[1:] for width in WIDTHS)])


def _beyond(ordinary: bytes, toxic: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, marks by hash of the bytes that only the toxic dictionary has, and of those
    that both have. The longest are told apart no further: they count as the toxic one's."""
    cut, marks = len(toxic) - len(ordinary) if toxic.endswith(ordinary) else len(toxic), {}
    for size in range(SHORTEST, LONGEST + 1):
        # A match may begin before the place where the ordinary dictionary follows.
        here = {toxic[k : k + size] for k in range(min(cut, len(toxic) - size + 1))}
        there = set() if size == LONGEST else {ordinary[k : k + size] for k in range(len(ordinary) - size + 1)}
        marks[size] = tuple(np.zeros(1 << HASH_BITS, bool) for _ in range(2))
        for mark, own in zip(marks[size], (here - there, here & there), strict=True):
            mark[[int(_hashes(_numbers(w), size)[0]) for w in own]] = True
    return marks


def _numbers(data: bytes) -> np.ndarray:
    """LONGEST bytes as one number, at every byte; zeros follow the last."""
    return np.ndarray((len(data),), "<u8", data + bytes(LONGEST - 1), 0, (1,))


def _hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """Of the first bytes of each number."""
    return (numbers << np.uint64(8 * (LONGEST - size))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL)
    usual = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=96, dict_size=len(content))
    params = zstandard.ZstdCompressionParameters(
        window_log=usual.window_log,
        chain_log=usual.chain_log,
        hash_log=usual.hash_log,
        search_log=usual.search_log,
        min_match=SHORTEST,
        target_length=usual.target_length,
        strategy=usual.strategy,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def features(gains: np.ndarray) -> np.ndarray:
    """Of counted gains: the highest, the mean of the three highest, the mean, and
    numbers and rates of windows beyond thresholds. A text without windows has
    gained nothing."""
    n, values = gains.sum(), np.arange(-LIMIT, LIMIT + 1)
    if not n:
        gains, n = np.where(values == 0, 1, 0), 1
    upper, left = [], 3
    for v in values[::-1]:
        take = min(left, int(gains[v + LIMIT]))
        upper += [v] * take
        left -= take
    over = [int(gains[values >= k].sum()) for k in (2, 3, 4)]
    rates = [math.log(x / n + 0.005) for x in over]
    return np.array([1.0, upper[0] / 4, sum(upper) / len(upper) / 4, float(gains @ values) / n, math.log1p(over[0]), math.log1p(over[1]), *rates])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * b
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(penalty), slope)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The dictionaries and the calibration: a small dict, the same for any
    order of the rows. Without labels of both kinds every score is the part of
    toxic labels."""
    toxic, ordinary, part = training_rows(docs, labels)
    if len(toxic) < 5 or len(ordinary) < 5:
        return {"ordinary": b"", "toxic": b"", "weights": None, "part": part}
    cut = lambda texts: int(len(texts) * TRAIN_PART)
    plain, other = train_dictionaries(toxic[: cut(toxic)], ordinary[: cut(ordinary)])
    windows = Windows(plain, other)
    held = [(t, 1) for t in toxic[cut(toxic) :]] + [(t, 0) for t in ordinary[cut(ordinary) :]]
    x = np.array([windows.features(t) for t, _ in held])
    y = np.array([k for _, k in held], np.float64)
    # Classes were drawn apart; weights bring back how common they are.
    weight = np.where(y == 1, part / max(y.mean(), 1e-9), (1 - part) / max(1 - y.mean(), 1e-9))
    return {"ordinary": plain, "toxic": other, "weights": fit_logistic(x, y, weight).tolist(), "part": part}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """The columns of ``docs``, then the score: 0 to 1 for every whole text.

    A missing text is empty. A column of the score's name is replaced. Only the
    text is read by the score.
    """
    kept = [c for c in docs.columns if c != name]
    # A text that is a kept column travels once.
    own = name != "text" and dict(docs.dtypes).get("text") == "string"
    whole = "text" if own else "__whole"
    taken = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if own else [whole_text().alias(whole)]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(model["ordinary"], model["toxic"])
        weights = None if model["weights"] is None else np.array(model["weights"])
        for batch in batches:
            scores = []
            for text in batch.column(whole):
                if weights is None:
                    scores.append(model["part"])
                else:
                    z = float(windows.features(text.as_py() or "") @ weights)
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, name])

    fields = [f for f in taken.schema.fields if f.name in kept]
    return taken.mapInArrow(giving_back(run), T.StructType([*fields, T.StructField(name, T.DoubleType())]))
