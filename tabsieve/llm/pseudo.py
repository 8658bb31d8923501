"""Document scores by masked pseudo-likelihood.

A network of a window predicts every word from the two words before and the two
after it. Output is in two steps, the class of a word and the word in its class.
Rare words share buckets by a hash: the network predicts the bucket, and the word
in it has its frequency in the corpus, joined from the counts of all words. The
network is trained in numpy on every document: tasks start from
common weights, and their weights are averaged after each round. A document's
score is the sum of the conditional log-probabilities of its words.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.tables import least_count, whole_text
from tabsieve.plans.held import hold

#: Frequent words with outputs of their own, and buckets of the others.
WORDS = 3_968
BUCKETS = 128
#: Words of a class; with WORDS + BUCKETS this makes 64 classes.
CLASS = 64
WIDTH = 32
PLACES = (-2, -1, 1, 2)
#: Each round trains on every ROUNDS-th word of a document, one further on than the
#: round before: together on every word once.
ROUNDS = 2
BATCH = 16_384
#: Rows whose scores are made at once, and rows of a word that are added up one after the
#: other: how they are cut, not what is computed.
BLOCK = 2048
FEW = 256
PIECE = 32
PLACE, ONES = np.arange(BLOCK, dtype=np.int32), np.ones(BLOCK, np.float32)
RATE = 0.1
#: Exponents up to this size need no scaling. Fixed value: 32-bit numbers end at 88.
REACH = 60.0
#: Words scored at a time.
CHUNK = 1 << 14
#: Longer words stand for themselves by a hash.
LONGEST = 64
#: The seed of Spark's xxhash64. Fixed value.
HASH_SEED = 42
#: Bytes of texts that are split at a time.
PART = 1 << 23
#: The separators of words that Python knows and Arrow does not. Fixed values.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Most frequent words whose counts are given to all tasks; those of the others are joined.
LISTED = 131_072
#: Numbers of weights that are averaged as one row, and weights of tasks that are averaged
#: in one place before the averages are.
SLICE = 1 << 14
LOT = 64
#: Training tasks for each core: their number, and what they send, is the cluster's and
#: not the table's.
TASKS_PER_CORE = 4


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _short(word: str) -> str:
    return word if len(word) <= LONGEST else "\0" + hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=16).hexdigest()


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in stretches of about PART bytes."""
    parts = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // PART
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in itertools.pairwise(cuts) if a < b)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, those of ``words_of``, and their number in each text."""
    # Arrow lowers and splits like Python where there is nothing but ASCII and none of the separators that only Python knows.
    plain = [t if t.isascii() and not any(c in t for c in SEPARATORS) else " ".join(words_of(t)) for t in texts.to_pylist()]
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(plain, pa.string())))
    words, ends = lists.values, lists.offsets.to_numpy()
    filled = pc.binary_length(words).to_numpy() > 0
    if not filled.all():
        # Blanks at either end leave an empty word.
        words, ends = words.filter(pa.array(filled)), np.concatenate(([0], np.cumsum(filled)))[ends]
    return words, np.diff(ends)


def _shorts(words: pa.Array) -> pa.Array:
    long = pc.greater(pc.utf8_length(words), LONGEST)
    if not pc.any(long).as_py():
        return words
    return pc.replace_with_mask(words, long, pa.array([_short(w) for w in words.filter(long).to_pylist()], pa.string()))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in _pieces(batch.column(0)):
            counted = _split(texts)[0].value_counts()
            yield pa.RecordBatch.from_arrays([_shorts(counted.field("values")), counted.field("counts")], ["word", "n"])


def vocabulary(docs: DataFrame) -> dict:
    """Words by falling count, then by the word, the outputs' counts, the sizes of the
    buckets, and the table ``(word, n)`` of every document that they are from. ``listed`` are
    the most frequent words of buckets with their counts: all that occur ``least`` times."""
    counted = docs.select(whole_text().alias("text")).mapInArrow(_count, "word string, n long")
    counts = hold(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    spark = docs.sparkSession
    # At most WORDS words.
    frequent = {r.word: r.n for r in counts.orderBy(F.col("n").desc(), "word").limit(WORDS).collect()}
    words = list(frequent)
    chosen = spark.createDataFrame([(w,) for w in words], "word string")
    others = counts.join(F.broadcast(chosen), "word", "left_anti")
    bucket = F.pmod(F.crc32("word"), F.lit(BUCKETS))
    rare = others.groupBy(bucket.alias("b")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    kinds, total = np.ones(BUCKETS), np.zeros(BUCKETS)
    for r in rare.collect():
        kinds[r.b], total[r.b] = r.kinds, r.n
    n = np.concatenate(([frequent[w] for w in words], total)).astype(np.float64)
    least = least_count(counts, LISTED)
    # At most LISTED words.
    listed = others.where(F.lit(False) if least is None else F.col("n") >= least).toArrow().combine_chunks()
    return {"words": words, "n": n, "kinds": kinds, "counts": counts, "listed": listed, "least": least}


def _bytes(words: pa.Array) -> list[bytes]:
    """The words in UTF-8."""
    if not len(words):
        return []
    ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist(), words.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in itertools.pairwise(ends)]


def _buckets(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words], np.int64) % BUCKETS


class Ids:
    """Numbers of words: their place by count, or that of their bucket."""

    def __init__(self, words: list[str], listed: pa.Table | None = None):
        own, more, n = len(words), pa.array([], pa.string()), np.ones(0)
        if listed is not None and listed.num_rows:
            more, n = listed.column("word").chunk(0).cast(pa.string()), listed.column("n").to_numpy()
        self.first_bucket, self.known = own, pa.concat_arrays([pa.array(words, pa.string()), more])
        # The last places are those of words that are not known.
        self.number = np.concatenate((np.arange(own), own + _buckets(_bytes(more)), [0]))
        self.told = np.concatenate((np.zeros(own), np.log(n), [0.0]))

    def of(self, text: str) -> np.ndarray:
        which, number = self.read(pa.array([text], pa.string()))[1:3]
        return number[which]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """The numbers of words of the texts; of each word its kind; of each kind its number, the logarithm
        of its count if it is listed, its 64-bit hash if it is not known, and whether it is not."""
        words, sizes = _split(texts)
        coded = words.dictionary_encode()
        kinds = _shorts(coded.dictionary)
        place = pc.fill_null(pc.index_in(kinds, value_set=self.known), -1).to_numpy()
        new = place < 0
        number, hashes, others = self.number[place], np.zeros(len(place), np.uint64), _bytes(kinds.filter(pa.array(new)))
        number[new] = self.first_bucket + _buckets(others)
        hashes[new] = np.array([xxhash.xxh64_intdigest(w, HASH_SEED) for w in others], np.uint64)
        return sizes, coded.indices.to_numpy(), number, self.told[place], hashes, new


def _in_range(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether sums of exponentials over the last axis fit into 32 bits as they are, for any
    state: its numbers are from -1 to 1."""
    reach = np.abs(weights).sum(axis=-2)
    return ((bias + reach).max(axis=-1) < REACH) & ((bias - reach).max(axis=-1) > -REACH)


class Network:
    """Weights in one flat array, and views of their parts."""

    def __init__(self, n: np.ndarray, flat: np.ndarray | None = None):
        outputs = len(n)
        classes = -(-outputs // CLASS)
        # The layers have their bias as a last column: it meets a state's last number, one.
        self.shapes = {
            "enter": (len(PLACES), outputs + 1, WIDTH),
            "bias": (WIDTH,),
            "outer": (classes, WIDTH + 1),
            "inner": (classes, CLASS, WIDTH + 1),
        }
        sizes = {k: int(np.prod(s)) for k, s in self.shapes.items()}
        self.flat = np.zeros(sum(sizes.values()), np.float32) if flat is None else flat.copy()
        at = 0
        for k, s in self.shapes.items():
            setattr(self, k, self.flat[at : at + sizes[k]].reshape(s))
            at += sizes[k]
        for k, part in _parts(self.outer, self.inner).items():
            setattr(self, k, part)
        self.outside = outputs
        if flat is None:
            # It begins as what counts alone say.
            padded = np.full(classes * CLASS, 1e-9)
            padded[:outputs] = n + 0.1
            by_class = padded.reshape(classes, CLASS)
            self.class_bias[:] = np.log(by_class.sum(axis=1) / padded.sum())
            self.word_bias[:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
            self.enter[:] = np.random.default_rng(7).normal(0, 0.1, self.enter.shape)

    def _state(self, around: list[np.ndarray]) -> np.ndarray:
        """States, and a one behind each."""
        h = np.ones((len(around[0]), WIDTH + 1), np.float32)
        first = self.enter[0] + self.bias
        for a in range(0, len(h), BLOCK):
            z = first.take(around[0][a : a + BLOCK], axis=0)
            for k in range(1, len(PLACES)):
                z += self.enter[k].take(around[k][a : a + BLOCK], axis=0)
            np.tanh(z, out=h[a : a + BLOCK, :WIDTH])
        return h

    def log_probabilities(self, around: list[np.ndarray], target: np.ndarray, learn: dict | None = None) -> np.ndarray | None:
        """Of each target; with ``learn`` the gradients are put there instead."""
        group, member = (target // CLASS).astype(np.uint8), target % CLASS
        order = None
        if (group[1:] < group[:-1]).any():
            order = np.argsort(group, kind="stable")
            around, group, member = [a[order] for a in around], group[order], member[order]
        h = self._state(around)
        counts = np.bincount(group, minlength=len(self.outer))
        # The rows of a class stand together: all of these are views.
        cuts = np.concatenate(([0], np.cumsum(counts))).tolist()
        slopes = None if learn is None else {"outer": np.zeros_like(self.outer), "inner": np.zeros_like(self.inner)}
        values = np.zeros(len(h) if learn is None else (len(h), WIDTH), np.float32)
        room = np.empty(BLOCK * max(CLASS, len(self.outer)), np.float32)
        level = bool(_in_range(self.to_class, self.class_bias).all())
        plain = _in_range(self.to_word, self.word_bias).tolist()
        for a in range(0, len(h), BLOCK):
            part = slice(a, a + BLOCK)
            _layer(h[part], self.outer, group[part], level, room, values[part], slopes and slopes["outer"])
        for c in np.flatnonzero(counts).tolist():
            for a in range(cuts[c], cuts[c + 1], BLOCK):
                part = slice(a, min(a + BLOCK, cuts[c + 1]))
                _layer(h[part], self.inner[c], member[part], plain[c], room, values[part], slopes and slopes["inner"][c])
        back = np.argsort(order) if order is not None else slice(None)
        if learn is None:
            return values[back]
        for a in range(0, len(h), BLOCK):
            z = h[a : a + BLOCK, :WIDTH]
            values[a : a + BLOCK] -= values[a : a + BLOCK] * z * z
        learn |= slopes | _parts(slopes["outer"], slopes["inner"])
        learn["bias"], learn["z"] = values.sum(axis=0), values[back]
        return None


def _parts(outer: np.ndarray, inner: np.ndarray) -> dict[str, np.ndarray]:
    """Weights and biases as views of the layers."""
    return {"to_class": outer[:, :WIDTH].T, "class_bias": outer[:, WIDTH], "to_word": inner[:, :, :WIDTH].swapaxes(1, 2), "word_bias": inner[:, :, WIDTH]}


def _layer(h: np.ndarray, weights: np.ndarray, own: np.ndarray, plain: bool, room: np.ndarray, values: list[np.ndarray], slopes: np.ndarray | None) -> None:
    """One layer for the states ``h``. The log-probabilities of its outputs ``own`` are added to ``values``;
    with ``slopes`` the states' slopes are added there instead, and those of the weights to ``slopes``."""
    rows, outputs = len(h), len(weights)
    flat = room[: rows * outputs]
    scores = flat.reshape(rows, outputs)
    np.matmul(h, weights.T, out=scores)
    if not plain:
        scores -= scores.max(axis=1, keepdims=True)
    at = PLACE[:rows] * outputs
    at += own
    if slopes is None:
        values += flat.take(at)
    np.exp(scores, out=scores)
    # A product adds up faster than a sum along rows.
    total = scores @ ONES[:outputs]
    if slopes is None:
        values -= np.log(total)
        return
    np.divide(1, total, out=total)
    scores *= total[:, None]
    flat[at] -= 1
    values += scores @ weights[:, :WIDTH]
    # Products of few rows are made faster than those of many.
    whole = rows - rows % FEW
    if whole:
        slopes += (scores[:whole].reshape(-1, FEW, outputs).swapaxes(1, 2) @ h[:whole].reshape(-1, FEW, WIDTH + 1)).sum(axis=0)
    if whole < rows:
        slopes += scores[whole:].T @ h[whole:]


def _sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray, last: int) -> np.ndarray:
    """The sums of ``rows[order]`` from each place of ``first`` up to the next, the last one up to ``last``.

    Stretches are cut into pieces of at most PIECE rows, and the k-th rows of all pieces that
    have one are added at once; sums of pieces are added up in the same way.
    """
    sizes = np.diff(first, append=last)
    pieces = (sizes + (PIECE - 1)) // PIECE
    ends = np.cumsum(pieces)
    begin, length = first, sizes
    if len(first) < ends[-1]:
        within = PIECE * (np.arange(ends[-1]) - np.repeat(ends - pieces, pieces))
        begin = np.repeat(first, pieces) + within
        length = np.minimum(np.repeat(sizes, pieces) - within, PIECE)
    falling = np.argsort((PIECE - length).astype(np.uint8), kind="stable")
    begin = begin[falling]
    longer = (len(length) - np.cumsum(np.bincount(length, minlength=PIECE + 1))).tolist()
    total = rows.take(order.take(begin), axis=0)
    for k in range(1, PIECE):
        more = longer[k]
        if not more:
            break
        total[:more] += rows.take(order[k:].take(begin[:more]), axis=0)
    place = np.empty_like(falling)
    place[falling] = np.arange(len(falling))
    if len(falling) == len(first):
        return total.take(place, axis=0)
    return _sums(total, place, ends - pieces, len(place))


class Trainer:
    """Adaptive gradient steps, by row for the entering weights."""

    def __init__(self, network: Network):
        self.network = network
        self.sums = {k: np.full(s, 1e-3, np.float32) for k, s in network.shapes.items() if k != "enter"}
        self.rows = np.full(network.shapes["enter"][:2], 1e-3, np.float32)

    def step(self, around: list[np.ndarray], target: np.ndarray) -> None:
        order = np.argsort((target // CLASS).astype(np.uint8), kind="stable")
        around, target = [a[order] for a in around], target[order]
        learn: dict = {}
        self.network.log_probabilities(around, target, learn)
        for k, total in self.sums.items():
            total += learn[k] ** 2
            getattr(self.network, k)[...] -= RATE * learn[k] / np.sqrt(total)
        # The words of all places at once, each with a number for its place.
        enter, rows = self.network.enter.reshape(-1, WIDTH), self.rows.reshape(-1)
        words = np.concatenate([a + k * self.rows.shape[1] for k, a in enumerate(around)])
        order = np.argsort(words.astype(np.uint16), kind="stable")
        words = words[order]
        first = np.concatenate(([0], np.flatnonzero(words[1:] != words[:-1]) + 1))
        own = words[first]
        row = np.tile(np.arange(len(target)), len(around)).take(order)
        slope = _sums(learn["z"], row, first, len(row))
        rows[own] += np.einsum("nw,nw->n", slope, slope) / WIDTH
        slope *= (RATE / np.sqrt(rows[own]))[:, None]
        enter[own] -= slope


def number_words(docs: DataFrame, vocab: dict) -> DataFrame:
    """``(doc_id, row, ids, told, rare, times)``: every whole text as numbers of 16 bits, the sum of the
    logarithms of the counts of its listed words, and how often it has each word of a bucket that is
    not listed, by the word's 64-bit hash, written once for all passes. ``row`` names a row."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab["words"], vocab["listed"]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(*shared.value)
        for batch in batches:
            begin = 0
            for texts in _pieces(batch.column("text")):
                names = [batch.column(c).slice(begin, len(texts)) for c in ("doc_id", "row")]
                begin += len(texts)
                yield pa.RecordBatch.from_arrays([*names, *_numbered(ids, texts)], ["doc_id", "row", "ids", "told", "rare", "times"])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), whole_text().alias("text"))
    return hold(rows.mapInArrow(run, "doc_id long, row long, ids binary, told double, rare array<long>, times array<int>"), "ids")


def _numbered(ids: Ids, texts: pa.Array) -> list[pa.Array]:
    sizes, which, number, told, hashes, new = ids.read(texts)
    row = np.repeat(np.arange(len(texts)), sizes)
    found = number.astype(np.uint16)[which]
    at = np.flatnonzero(new[which])
    pairs, times = np.unique(row[at] << 32 | which[at], return_counts=True)
    ends = _ends(np.bincount(pairs >> 32, minlength=len(texts)))
    return [
        pa.Array.from_buffers(pa.binary(), len(texts), [None, _ends(2 * sizes).buffers()[1], pa.py_buffer(found)]),
        pa.array(np.bincount(row, told[which], len(texts)), pa.float64()),
        pa.ListArray.from_arrays(ends, pa.array(hashes[pairs & 0xFFFFFFFF].view(np.int64))),
        pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
    ]


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def _lists(column: pa.Array, most: int) -> Iterator[list[np.ndarray]]:
    """The lists of numbers of a column as views of its values, up to about ``most`` numbers at a time."""
    if pa.types.is_binary(column.type):
        # Two bytes are a number.
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
        values = np.frombuffer(column.buffers()[2] or b"", np.uint16)
    else:
        ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(ends[1:] // most)) + 1).tolist(), len(column)]
    for a, b in itertools.pairwise(cuts):
        if a < b:
            yield [values[c:d] for c, d in itertools.pairwise(ends[a : b + 1].tolist())]


def _laid(found: list[np.ndarray], outside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lists in a row, two numbers for the outside around each; the places of their numbers
    in it, the places in their lists, and the lists' sizes."""
    sizes = np.array([len(x) for x in found], np.int64)
    edge = np.full(2, outside, np.int32)
    row = np.concatenate([edge, *(x for own in found for x in (own, edge))])
    within = np.arange(sizes.sum())
    place = np.repeat(2 * np.arange(1, len(found) + 1), sizes) + within
    return row, place, within - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def _trainer(n: np.ndarray, flat: np.ndarray, turn: int):
    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(n, flat)
        trainer, held, seen = Trainer(network), np.empty((len(PLACES) + 1, 0), np.int32), 0
        for batch in batches:
            for found in _lists(batch.column(0), 16 * BATCH):
                row, place, within, _ = _laid(found, network.outside)
                at = place[within % ROUNDS == turn]
                held, seen = np.concatenate((held, [row[at + p] for p in (*PLACES, 0)]), axis=1), seen + len(at)
                while held.shape[1] >= BATCH:
                    trainer.step(list(held[:-1, :BATCH]), held[-1, :BATCH])
                    held = held[:, BATCH:]
        if held.shape[1]:
            trainer.step(list(held[:-1]), held[-1])
        if seen:
            parts = range(0, len(network.flat), SLICE)
            values = [network.flat[k : k + SLICE].tobytes() for k in parts]
            task = TaskContext.get()
            lot = task.partitionId() // LOT if task else 0
            yield _slices([(k, lot, float(seen), v) for k, v in enumerate(values)])

    return train


def _slices(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "lot", "seen", "weights"])


def _average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of slices by part and lot: a task holds one sum for each."""
    sums: dict[tuple[int, int], list] = {}
    for batch in batches:
        for part, lot, seen, weights in zip(*(batch.column(c).to_pylist() for c in ("part", "lot", "seen", "weights")), strict=True):
            own = np.frombuffer(weights, np.float32).astype(np.float64) * seen
            if (part, lot) in sums:
                sums[part, lot][0] += seen
                sums[part, lot][1] += own
            else:
                sums[part, lot] = [seen, own]
    yield _slices([(*k, seen, (total / seen).astype(np.float32).tobytes()) for k, (seen, total) in sums.items()])


def train(numbers: DataFrame, n: np.ndarray) -> np.ndarray:
    """The averaged weights; 2.6 MB whatever the size of the corpus. ``numbers`` is
    that of ``number_words``, ``n`` the counts of the vocabulary."""
    flat, shape = Network(n).flat, "part int, lot int, seen double, weights binary"
    tasks = TASKS_PER_CORE * numbers.sparkSession.sparkContext.defaultParallelism
    for turn in range(ROUNDS):
        shared = numbers.sparkSession.sparkContext.broadcast((n, flat))

        def run(batches, shared=shared, turn=turn):
            return _trainer(*shared.value, turn)(batches)

        made = numbers.select("ids").coalesce(tasks).mapInArrow(run, shape)
        # Two steps: no task reads more than the slices of a lot, or those of all lots.
        lots = made.repartition("part", "lot").mapInArrow(_average, shape).withColumn("lot", F.lit(0))
        rows = sorted(lots.repartition("part").mapInArrow(_average, shape).collect())
        if not rows:
            break
        flat = np.concatenate([np.frombuffer(r.weights, np.float32) for r in rows])
        shared.unpersist()
    return flat


def score_ids(found: list[np.ndarray], network: Network, rare: np.ndarray) -> np.ndarray:
    """The log-probability of each list of numbers. ``rare`` is subtracted for a word
    that is one of the many of its bucket."""
    row, place, _, sizes = _laid(found, network.outside)
    value = np.zeros(len(place))
    for k in range(0, len(place), CHUNK):
        here = place[k : k + CHUNK]
        value[k : k + CHUNK] = network.log_probabilities([row[here + p] for p in PLACES], row[here]) - rare[row[here]]
    sums = np.concatenate(([0.0], np.cumsum(value)))
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def rare_shares(vocab: dict) -> np.ndarray:
    """What the log-probability of a bucket has more than that of its word, but for the
    logarithm of the word's own count."""
    own = len(vocab["words"])
    return np.concatenate((np.zeros(own), np.log(np.maximum(vocab["n"][own:], 1))))


def rare_counts(numbers: DataFrame, vocab: dict) -> DataFrame:
    """``(row, more)``: the sum of the logarithms of the counts of a row's words of buckets
    that are not listed. Words of one occurrence add nothing. Words are known by 64-bit hashes."""
    rare = numbers.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times")
    told = F.col("n") > 1 if vocab["least"] is None else F.col("n").between(2, vocab["least"] - 1)
    known = vocab["counts"].where(told).select(F.xxhash64("word").alias("word"), F.log(F.col("n").cast("double")).alias("log_n"))
    return rare.join(known, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log_n")).alias("more"))


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, log_likelihood, per_word)`` for each row of ``docs``.

    Fitted on the same documents. ``per_word`` is the mean log-probability; it
    is NULL for a text without words, whose sum is 0. A missing text is empty.
    Logarithms are natural. An empty table gives none.
    """
    vocab = vocabulary(docs)
    numbers = number_words(docs, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((vocab["n"], train(numbers, vocab["n"]), rare_shares(vocab)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, flat, rare = shared.value
        network = Network(n, flat)
        for batch in batches:
            values, sizes = [], []
            for found in _lists(batch.column("ids"), 1 << 18):
                values.append(score_ids(found, network, rare))
                sizes += map(len, found)
            if values:
                told = np.concatenate(values) + batch.column("told").to_numpy()
                columns = [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(told)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_words", "told"])

    made = numbers.select("doc_id", "row", "ids", "told").mapInArrow(run, "doc_id long, row long, n_words long, told double")
    made = made.join(rare_counts(numbers, vocab), "row", "left")
    made = made.select("doc_id", "n_words", (F.col("told") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return made.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
