"""Links between similar vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; two codewords name a
cell of the product grid. A vector is indexed in its nearest cell and visits
the cells around it in the order of their distance, the multi-sequence, until
they are farther than its own by a margin. The margin is fitted so that of two
vectors at the least similarity one visits the other's cell with the wanted
probability. Vectors that meet in a cell are compared exactly.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.components import connected_components
from tabsieve.llm.stream import groups, in_block_pairs, sorted_groups
from tabsieve.plans.held import hold

SIMILARITY = 0.9
#: Part of the links right at SIMILARITY that the visits are fitted to find.
RECALL = 0.99
#: Vectors for each cell on average, and the largest codebook.
CELL_VECTORS = 48
MOST_WORDS = 1024
#: Codebooks are trained on this many vectors, those with the smallest
#: hashes, or on SAMPLE_WORD for each codeword if that is more; the margin on
#: MARGIN_VECTORS of them.
SAMPLE = 8_192
SAMPLE_WORD = 16
MARGIN_VECTORS = 1_024
ITERATIONS = 8
#: Rows of a cell that are compared at a time, and of these with one product.
BLOCK = 4_096
TILE = 512


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, also where squares would overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, column: str) -> tuple[DataFrame, DataFrame, int]:
    """``(vec_id, node)`` of all rows, ``(node, vec, copies, first_id)`` of the
    distinct valid vectors, and their length. Shorter vectors end in zeros."""
    x = F.col(column)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    width = vectors.agg(F.max(F.size(x))).first()[0]
    width = max(width or 0, 2)
    kind = np.dtype("<f4") if dict(vectors.dtypes)[column] == "array<float>" else np.dtype("<f8")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column("x"):
                if not v.is_valid:
                    rows.append(None)
                    continue
                filled = np.zeros(width, kind)
                own = v.values.to_numpy(zero_copy_only=False)
                filled[: len(own)] = own
                rows.append((filled + 0.0).astype(kind).tobytes())  # -0 is 0
            keys = [r and hashlib.blake2b(r, digest_size=16).digest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["vec_id", "node", "vec"])

    usable = F.when(F.coalesce(good, F.lit(False)), x)
    rows = hold(vectors.select("vec_id", usable.alias("x")).mapInArrow(pack, "vec_id long, node binary, vec binary"), "vectors")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    return rows.select("vec_id", "node"), hold(nodes, "nodes"), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    kind = "<f4" if len(data) == 4 * width * len(column) else "<f8"
    return unit_rows(np.frombuffer(data, kind).reshape(len(column), width))


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ITERATIONS):
        near = _distances(x, words).argmin(axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1))


class Grid:
    """Two codebooks and the margin of the visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, margin: float = 0.0):
        self.first, self.second, self.margin = first, second, margin

    def _sorted(self, x: np.ndarray):
        half = self.first.shape[1]
        for d in (_distances(x[:, :half], self.first), _distances(x[:, half:], self.second)):
            order = d.argsort(axis=1, kind="stable")
            yield order, np.take_along_axis(d, order, axis=1)

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """Cells of each row in the order of distance, the nearest one first."""
        (order1, d1), (order2, d2) = self._sorted(x)
        n2 = len(self.second)
        return [self._sequence(o1.tolist(), a.tolist(), o2.tolist(), b.tolist(), n2) for o1, a, o2, b in zip(order1, d1, order2, d2, strict=True)]

    def _sequence(self, o1: list, a: list, o2: list, b: list, n2: int) -> list[int]:
        most, out = a[0] + b[0] + self.margin, []
        queue = [(a[0] + b[0], 0, 0)]
        while queue:
            d, i, j = heapq.heappop(queue)
            if d > most:
                break
            out.append(o1[i] * n2 + o2[j])
            # Each pair is reached once: down its column from the top, along the top.
            if j + 1 < len(b):
                heapq.heappush(queue, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(queue, (a[i + 1] + b[0], i + 1, 0))
        return out

    def excess(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How much farther from x the nearest cell of y is than that of x."""
        half, total = self.first.shape[1], np.zeros(len(x))
        for words, cut in ((self.first, slice(None, half)), (self.second, slice(half, None))):
            d, other = _distances(x[:, cut], words), _distances(y[:, cut], words)
            total += d[np.arange(len(x)), other.argmin(axis=1)] - d.min(axis=1)
        return total


def fit_grid(sample: np.ndarray, words: int, similarity: float, recall: float) -> Grid:
    half, words = sample.shape[1] // 2, min(words, len(sample))
    grid = Grid(_k_means(sample[:, :half], words, 1), _k_means(sample[:, half:], words, 2))
    x = sample[:MARGIN_VECTORS]
    side = np.random.default_rng(3).normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    y = similarity * x + np.sqrt(1 - similarity**2) * side
    grid.margin = float(np.quantile(np.minimum(grid.excess(x, y), grid.excess(y, x)), recall)) + 1e-9
    return grid


def _compare(x: np.ndarray, home: np.ndarray, here: int, block: np.ndarray, split: bool, weight: np.ndarray, probes: list, similarity: float):
    """Links of one piece: weights of counted partners, and components.

    A pair whose vectors have different homes and visit each other would be seen
    in both: it counts in the smaller one.
    """
    n = len(x)
    root, links = np.arange(n), np.zeros(n)
    index = np.flatnonzero(home == here)
    for begin in range(0, len(index), TILE):
        rows = index[begin : begin + TILE]
        near = x[rows] @ x.T >= similarity
        near[np.arange(len(rows)), rows] = False
        if split:
            near &= block[rows][:, None] != block[None, :]
        for i, row in enumerate(rows):
            found = np.flatnonzero(near[i])
            if not len(found):
                continue
            if (root[found] != root[row]).any():
                root[np.isin(root, np.append(root[found], root[row]))] = min(root[found].min(), root[row])
            away = home[found] != here
            # Members of the same home: once, from the smaller place.
            counted = np.where(away, ~(np.isin(home[found], probes[row]) & (home[found] < here)), found > row)
            found = found[counted]
            links[row] += weight[found].sum()
            links[found] += weight[row]
    return root, links


def link_vectors(vectors: DataFrame, column: str = "embedding", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Links join vectors whose cosine, in double precision, is at least
    ``similarity``. Vectors that are missing, zero, or hold missing or
    non-finite components link with nothing and are components of their own. Equal
    vectors are one node with a weight. Missing ids take part, but never name a
    component that has another id. Repeated ids are separate vectors.
    """
    spark = vectors.sparkSession
    rows, nodes, width = distinct_vectors(vectors, column)
    total = nodes.count()
    words = int(min(MOST_WORDS, max(2, np.ceil(np.sqrt(total / CELL_VECTORS)))))
    size = max(SAMPLE, SAMPLE_WORD * words)
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(size).select("vec").collect()
    if len(sample) > 1:
        grid = fit_grid(_matrix(pa.array([bytes(r.vec) for r in sample]), width), words, similarity, recall)
        verified = _links(nodes, width, grid, similarity)
    else:
        verified = spark.createDataFrame([], "a binary, b binary, links long")

    parts = connected_components(verified.where("b IS NOT NULL").select("a", "b"), "components")
    links = verified.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies", "first_id").join(parts, "node", "left").join(links, "node", "left")
    known = hold(known.withColumn("component", F.coalesce("component", "node")), "known")
    names = hold(known.groupBy("component").agg(F.min("first_id").alias("name")), "names")
    known = known.join(names, "component").select("node", "name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(known, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("name")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(nodes: DataFrame, width: int, grid: Grid, similarity: float) -> DataFrame:
    first, second, margin = grid.first, grid.second, grid.margin

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Grid(first, second, margin)
        for batch in batches:
            if batch.num_rows:
                cells = near.visits(_matrix(batch.column("vec"), width))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("vec"), batch.column("copies"), pa.array([c[0] for c in cells], pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                    ["node", "vec", "copies", "home", "probes"],
                )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["cell", "left", "right"]):
            if group.num_rows < 2:
                continue
            names = group.column("node").to_pylist()
            left, right = (group.column(c)[0].as_py() for c in ("left", "right"))
            root, links = _compare(
                _matrix(group.column("vec").combine_chunks(), width),
                group.column("home").to_numpy(),
                group.column("cell")[0].as_py(),
                group.column("mine").to_numpy(),
                left != right,
                group.column("copies").to_numpy().astype(np.float64),
                group.column("probes").to_pylist(),
                similarity,
            )
            out = [(names[i], None, int(n)) for i, n in enumerate(links) if n]
            out += [(names[i], names[r], 0) for i, r in enumerate(root) if i != r]
            if out:
                kinds = (pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["a", "b", "links"])

    assigned = hold(nodes.select("node", "vec", "copies").mapInArrow(visit, "node binary, vec binary, copies long, home int, probes array<int>"), "visits")
    # Who visits a cell that is nobody's home meets no one there.
    cells = assigned.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.count("*").alias("members"))
    cells = cells.join(assigned.select(F.col("home").alias("cell")).distinct(), "cell", "left_semi").where("members > 1")
    met = assigned.withColumn("cell", F.explode("probes")).withColumn("probes", F.when(F.col("cell") == F.col("home"), F.col("probes")))
    met = in_block_pairs(met.join(cells, "cell"), F.col("members"), F.col("node"), BLOCK)
    met = sorted_groups(met.select("cell", "left", "right", "mine", "node", "vec", "copies", "home", "probes"), ["cell", "left", "right"])
    return hold(met.mapInArrow(compare, "a binary, b binary, links long"), "links")
