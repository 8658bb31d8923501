"""Near-duplicate join on word shingles by chosen paths.

Every text becomes a set of hashed shingles and a sketch of minimum hashes. In
each run the sets are split recursively on sampled tokens of their sketches: a
bucket is a path of shared tokens. Small buckets, and buckets that a further
split would leave together, are compared by brute force. The runs sample some
RUNS / SIMILARITY tokens; a pair right at the threshold misses all of their
buckets with a probability of 0.2 ** 12 after one split and of about 0.001
after DEPTH splits. Sketches, the same in all runs, tell it apart with a probability
of 4.2e-6: together 4.2e-6 after one split, about 0.001 after DEPTH. What the sketches put together is then verified on the
whole texts, exactly and pair by pair, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.components import connected_components
from tabsieve.llm.stream import groups, in_block_pairs, roots_of, sorted_groups
from tabsieve.llm.tables import join_with_nulls, whole_text
from tabsieve.plans.held import hold

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RUNS = 10
#: Minimum hashes of a sketch; a pair at 0.8 has fewer than 36 alike with a
#: probability of 4.2e-6.
SKETCH = 64
SKETCH_SIMILARITY = 36 / 64
#: Buckets of up to this size are not split further, and none after DEPTH splits.
SMALL_BUCKET = 64
DEPTH = 4
#: A bucket is tight if a split leaves this part of its pairs together.
TIGHT = 0.5
#: Rows that are compared at a time, by sketches and by texts. Larger groups
#: are compared in pairs of such blocks.
SKETCH_BLOCK = 16_384
TEXT_BLOCK = 1_024
#: A text counts once more for each so many shingles, so that a block of texts has
#: 2 * TEXT_BLOCK * TEXT_SHINGLES shingles at most, or one text.
TEXT_SHINGLES = 8_192
#: Texts are hashed in pieces of about this many bytes.
PIECE = 1 << 22

_SETS = "doc_id long, text_hash long, set binary, shingles long, sketch binary"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _odd_numbers(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class WordHasher:
    """64-bit hashes of the words of a text: longest runs without blanks."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self):
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("powers", self.BASE), ("inverses", pow(self.BASE, -1, 1 << 64))):
                made = np.full(n, base, np.uint64)
                made[0] = 1
                setattr(self, name, np.multiply.accumulate(made))

    def words(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        out, begin = [], 0
        while begin < len(data):
            end = min(len(data), begin + PIECE)
            if end < len(data):  # on to the end of the word
                while end < len(data) and not (data[end] == 32 or 9 <= data[end] <= 13):
                    end += 1
            out.append(self._piece(data[begin:end]))
            begin = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _piece(self, data: np.ndarray) -> np.ndarray:
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        starts = np.flatnonzero(solid[1:] & ~solid[:-1])
        ends = np.flatnonzero(solid[:-1] & ~solid[1:])
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


def shingle_set(words: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle of all its words."""
    if not len(words):
        return words
    w = min(width, len(words))
    factors = _odd_numbers(w, w)
    total = np.zeros(len(words) - w + 1, np.uint64)
    for k in range(w):
        total += words[k : len(words) - w + 1 + k] * factors[k]
    return np.unique(_mixed(total))


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    factors, low = _odd_numbers(SKETCH, 77), np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(shingles), 4096):
        part = shingles[begin : begin + 4096]
        np.minimum(low, _scrambled(part, factors).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _scrambled(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    x = shingles[None, :] * factors[:, None]
    x ^= x >> np.uint64(32)
    x *= _M1
    return x


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        sets, sizes, sketches = [], [], []
        for text in batch.column("text"):
            shingles = shingle_set(hasher.words(text.as_py()))
            sets.append(_set_key(shingles))
            sizes.append(len(shingles))
            sketches.append(sketch_of(shingles).tobytes() if len(shingles) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
            ["doc_id", "text_hash", "set", "shingles", "sketch"],
        )


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def describe(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, set, shingles, sketch)``: one row for each document."""
    text = whole_text()
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(_describe, _SETS)


def _first_tokens() -> list[np.ndarray]:
    """Sketch positions of each run: one, and a second one in a quarter of the
    runs, so that 1 / SIMILARITY are sampled on average."""
    places = np.argsort(_odd_numbers(SKETCH, 5))
    cuts = np.floor(np.arange(RUNS + 1) / SIMILARITY).astype(int)
    return [places[a:b] % SKETCH for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _paths(parent: np.ndarray, place: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(_mixed(parent + place.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) ^ (token.astype(np.uint64) + np.uint64(0x1B873593)))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), SKETCH)


def _split_first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _first_tokens()
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = _sketches(batch.column("sketch"))
        for run, places in enumerate(runs):
            for place in places:
                path = _paths(np.full(len(sketch), run, np.uint64), np.full(len(sketch), place), sketch[:, place])
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("set")], ["path", "set"])


def _split_again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each path samples its own tokens: one, and with a chance a second one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = _sketches(batch.column("sketch"))
        parent = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
        drawn = _mixed(parent)
        first = (drawn % np.uint64(SKETCH)).astype(np.int64)
        second = ((drawn >> np.uint64(8)) % np.uint64(SKETCH)).astype(np.int64)
        twice = (drawn >> np.uint64(32)).astype(np.float64) / 2**32 < 1 / SIMILARITY - 1
        for place, rows in ((first, np.ones(len(sketch), bool)), (second, twice & (second != first))):
            at = np.flatnonzero(rows)
            path = _paths(parent[at], place[at], sketch[at, place[at]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("path").take(pa.array(at)), pa.array(path.view(np.int64)), batch.column("set").take(pa.array(at))], ["parent", "path", "set"]
            )


def buckets(sets: DataFrame) -> DataFrame:
    """``(path, set, members)``: the buckets that are to be compared.

    A bucket of more than SMALL_BUCKET sets is split again unless it is tight;
    after DEPTH splits it is compared as it is.
    """
    members = hold(sets.select("set", "sketch").mapInArrow(_split_first, "path long, set binary"), "paths")
    final: list[DataFrame] = []
    for depth in range(DEPTH):
        sizes = hold(members.groupBy("path").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
        large = sizes.where(F.col("members") > SMALL_BUCKET)
        if depth == DEPTH - 1 or large.isEmpty():
            final.append(members.join(sizes, "path"))
            break
        final.append(members.join(sizes.where(F.col("members") <= SMALL_BUCKET), "path"))
        split = members.join(large, "path").join(sets.select("set", "sketch"), "set")
        split = split.select("path", "set", "sketch").mapInArrow(_split_again, "parent long, path long, set binary")
        split = hold(split, "paths")
        parts = split.groupBy("parent", "path").agg(F.count("*").alias("n"))
        kept = parts.groupBy("parent").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("together"))
        kept = kept.join(large, F.col("parent") == F.col("path")).select("path", "members", (F.col("together") / F.col("members") >= TIGHT).alias("tight"))
        kept = hold(kept, "tight")
        final.append(members.join(kept.where("tight").drop("tight"), "path"))
        members = split.join(kept.where("NOT tight").select(F.col("path").alias("parent")), "parent", "left_semi").select("path", "set")
        members = hold(members, "paths")
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each set to the first of those that sketches connect it with."""
    links: list[tuple[bytes, bytes]] = []
    for group in groups(batches, ["path", "left", "right"]):
        if group.num_rows < 2:
            continue
        names = group.column("set").to_pylist()
        sketch = _sketches(group.column("sketch").combine_chunks())
        links += [(names[i], names[r]) for i, r in enumerate(_sketch_roots(sketch)) if i != r]
        if len(links) > 20_000:
            yield _links(links)
            links = []
    yield _links(links)


def _links(links: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])


def _sketch_roots(sketch: np.ndarray) -> np.ndarray:
    """Connected components by similar sketches, each member compared only with
    those that have not been reached yet."""
    n, least = len(sketch), int(np.ceil(SKETCH_SIMILARITY * SKETCH))
    root, rest = np.arange(n), np.arange(n)
    while len(rest) > 1:
        start, rest, front = rest[0], rest[1:], [rest[0]]
        while front and len(rest):
            at = front.pop()
            near = (sketch[rest] == sketch[at]).sum(axis=1) >= least
            found = rest[near]
            root[found] = start
            front.extend(found.tolist())
            rest = rest[~near]
    return root


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, owner = np.concatenate(sets)[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    counts = np.diff(np.concatenate((first, [len(values)])))
    common = np.zeros((n, n), np.float32)
    # Rare elements by their few owners, frequent ones by a product of matrices.
    for c in np.unique(counts[(counts > 1) & (counts <= 16)]):
        at = first[counts == c]
        for part in np.array_split(at, 1 + len(at) * c * c // 2_000_000):
            own = owner[part[:, None] + np.arange(c)]
            flat = (own[:, :, None] * n + own[:, None, :]).ravel()
            common += np.bincount(flat, minlength=n * n).reshape(n, n) if len(flat) > n * n // 8 else _added(flat, n)
    often = np.flatnonzero(counts > 16)
    for part in range(0, len(often), 1024):
        columns = often[part : part + 1024]
        has = np.zeros((n, len(columns)), np.float32)
        lengths = counts[columns]
        rows = np.repeat(first[columns] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        has[owner[rows], np.repeat(np.arange(len(columns)), lengths)] = 1
        common += has @ has.T
    return common


def _added(flat: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n * n, np.float32)
    np.add.at(out, flat, 1)
    return out.reshape(n, n)


def linked_sets(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which two different sets have at least the given Jaccard similarity."""
    common = common_counts(sets).astype(np.float64)
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    return linked


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links of each piece: ``(a, NULL, links)`` with the weight of a's
    partners, and ``(a, b, 0)`` from each set to the first of its component."""
    hasher, out = WordHasher(), []
    for group in groups(batches, ["part", "left", "right"]):
        rows: dict[bytes, tuple] = {}
        for name, text, copies, mine in zip(*(group.column(c).to_pylist() for c in ("set", "text", "copies", "mine")), strict=True):
            if name not in rows:
                shingles = shingle_set(hasher.words(text))
                if _set_key(shingles) == name:
                    rows[name] = (shingles, copies, mine)
        if len(rows) < 2:
            continue
        names, values = list(rows), list(rows.values())
        linked = linked_sets([v[0] for v in values])
        mine = np.array([v[2] for v in values])
        if group.column("left")[0].as_py() != group.column("right")[0].as_py():
            linked &= mine[:, None] != mine[None, :]
        weight = linked @ np.array([v[1] for v in values], np.float64)
        out += [(names[i], None, int(w)) for i, w in enumerate(weight) if w]
        out += [(names[i], names[r], 0) for i, r in enumerate(roots_of(linked)) if i != r]
        if len(out) > 20_000:
            yield _verified(out)
            out = []
    yield _verified(out)


def _verified(rows: list) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["a", "b", "links"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, class_id, n_links, kept)`` for each row of ``docs``.

    Two documents are linked if the shingle sets of their texts have a Jaccard
    similarity of 0.8 or more; words are longest runs without blanks. A class is
    a connected component, named by its smallest doc_id; ``kept`` marks that
    document, among rows with that id the one with the smallest text_hash. Equal
    sets are one node with a weight, so copies are never paired with each other.
    A text without words is linked with nothing; one of fewer than five words is
    one shingle. A missing id takes part, but names a class only if no member
    has one. Rows that repeat an id and a text share ``kept``. An empty table gives none.
    """
    rows = hold(describe(docs), "described")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    # Equal sets have equal sketches.
    same = [F.first(c).alias(c) for c in ("sketch", "shingles")]
    sets = rows.where("shingles > 0").groupBy("set").agg(*same, F.count("*").alias("copies"), first)
    sets = hold(sets.select("set", "sketch", "shingles", "copies", "first.*"), "sets")

    pieces = in_block_pairs(buckets(sets).join(sets.select("set", "sketch"), "set"), F.col("members"), F.col("set"), SKETCH_BLOCK)
    pieces = sorted_groups(pieces.select("path", "left", "right", "set", "sketch"), ["path", "left", "right"])
    parts = hold(connected_components(hold(pieces.mapInArrow(_alike, "a binary, b binary").distinct(), "alike"), "parts"), "parts")

    weights = parts.join(sets.select(F.col("set").alias("node"), "shingles"), "node")
    sizes = weights.groupBy("component").agg(F.sum(1 + F.floor(F.col("shingles") / TEXT_SHINGLES)).alias("members"))
    candidates = parts.join(sizes, "component").join(sets.drop("sketch", "none").withColumnRenamed("set", "node"), "node")
    candidates = candidates.select(F.col("node").alias("set"), "copies", "doc_id", "text_hash", "members", F.col("component").alias("part"))
    text = whole_text()
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = join_with_nulls(texts, candidates, ["doc_id", "text_hash"])
    found = in_block_pairs(found, F.col("members"), F.col("set"), TEXT_BLOCK)
    found = sorted_groups(found.select("part", "left", "right", "mine", "set", "copies", "text"), ["part", "left", "right"])
    verified = hold(found.mapInArrow(_verify, "a binary, b binary, links long"), "verified")

    classes = connected_components(verified.where("b IS NOT NULL").select("a", "b"), "classes")
    links = verified.where("b IS NULL").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    known = sets.drop("sketch").join(classes.withColumnRenamed("node", "set"), "set", "left").join(links, "set", "left")
    known = known.select("set", "copies", F.struct("none", "doc_id", "text_hash").alias("first"), F.coalesce("component", "set").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    known = hold(known, "known")
    keepers = hold(known.groupBy("class").agg(F.min("first").alias("keep")), "keepers")
    known = known.join(keepers, "class").select("set", "keep", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "text_hash", "set", "shingles").join(known, "set", "left")
    lone = F.col("shingles") == 0
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash"))
    return out.select(
        "doc_id",
        "text_hash",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (lone | same).alias("kept"),
    )
