"""Hard negatives by an R-tree over vectors of whole numbers.

Rows are packed by sort-tile-recursive order: Spark deals them to tiles by cut
points of a few components, and a task packs its tile on into leaves. The minimum
bounding box of a node gives each component's interval and so an interval of
inner products with an anchor. A best-first queue opens the node of the highest possible
score next and leaves out boxes that lie outside of the wanted scores, or strictly
below the kth one found. Anchors first search their own tile, which
gives them a kth score to leave out whole tiles by.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.llm.stream import groups, sorted_groups
from tabsieve.plans.held import hold

#: Rows of a tile on average, of a leaf, and children of an inner node.
TILE_ROWS, LEAF, FANOUT = 8_192, 128, 16
#: Cut points come from this many rows, those with the smallest hashes, CUT_ROWS or more for a tile;
#: they decide on balance only, and a tile of more than twice TILE_ROWS is cut by a
#: hash. Components that tiles are cut by, at most.
SAMPLE, CUT_ROWS, CUT_COMPONENTS = 16_384, 4, 3
#: Anchors that meet a tile in one piece, and boxes of tiles that the driver
#: hands out at a time.
ANCHORS, BOXES = 2_048, 16_384
#: Scores are exact in doubles below this; above it Python's whole numbers count them.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's score.
LOW, HIGH = 30, 90


def whole_vectors(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> tuple[DataFrame, int]:
    """``(vec_id, label, vec)`` of the rows that take part, and the length of the vectors.

    ``vec`` holds floor(scale * x) of each component as doubles, which are whole numbers;
    shorter vectors end in zeros. Rows that miss the id, the label, the vector or a component, or have a
    component that is not finite, take no part. Equal rows count once.
    """
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.when(F.coalesce(good, F.lit(False)), x).alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    width = max(rows.agg(F.max(F.size("x"))).first()[0] or 0, 1)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for v in batch.column("x"):
                own = np.zeros(width)
                own[: len(v)] = v.values.to_numpy(zero_copy_only=False)
                # Beyond the doubles a component stays as far as they reach.
                packed.append((np.clip(np.floor(own * scale), -np.finfo(float).max, np.finfo(float).max) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary())], ["vec_id", "label", "vec"])

    return rows.mapInArrow(pack, "vec_id long, label long, vec binary").distinct(), width


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


class Cuts:
    """Sort-tile-recursive cut points: each stretch of a component is cut on by the next one.

    ``parts`` are the stretches for each component; a row's tile is
    the number of its stretches, read in that base.
    """

    def __init__(self, sample: np.ndarray, tiles: int):
        spread = sample.std(axis=0) if len(sample) else np.zeros(1)
        count = max(1, min(CUT_COMPONENTS, sample.shape[1], int(math.log2(tiles)) if tiles > 1 else 1))
        self.components = np.argsort(-spread, kind="stable")[:count].tolist()
        self.parts = max(1, math.ceil(tiles ** (1 / count) - 1e-9))
        self.points: dict[int, np.ndarray] = {}
        self._cut(sample, 0, 0)

    def _cut(self, rows: np.ndarray, depth: int, prefix: int) -> None:
        if depth == len(self.components):
            return
        own = np.sort(rows[:, self.components[depth]])
        points = own[[len(own) * k // self.parts for k in range(1, self.parts)]] if len(own) else np.zeros(self.parts - 1)
        self.points[depth << 32 | prefix] = points
        stretch = np.searchsorted(points, rows[:, self.components[depth]], side="right")
        for part in range(self.parts):
            self._cut(rows[stretch == part], depth + 1, prefix * self.parts + part)

    def tiles(self, x: np.ndarray) -> np.ndarray:
        prefix = np.zeros(len(x), np.int64)
        for depth, c in enumerate(self.components):
            at = np.zeros(len(x), np.int64)
            for p in np.unique(prefix):
                mine = prefix == p
                at[mine] = np.searchsorted(self.points[depth << 32 | int(p)], x[mine, c], side="right")
            prefix = prefix * self.parts + at
        return prefix


class BoxTree:
    """An R-tree packed by sort-tile-recursive order over the rows of a tile."""

    def __init__(self, x: np.ndarray):
        self.order = self._packed(x, np.arange(len(x)), 0)
        lows, highs, self.children = [], [], []
        level = []
        for begin in range(0, len(x), LEAF):
            rows = self.order[begin : begin + LEAF]
            level.append(len(lows))
            lows.append(x[rows].min(axis=0))
            highs.append(x[rows].max(axis=0))
            self.children.append(None)
        self.leaves = len(level)
        while len(level) > 1:
            above = []
            for begin in range(0, len(level), FANOUT):
                below = level[begin : begin + FANOUT]
                above.append(len(lows))
                lows.append(np.min([lows[b] for b in below], axis=0))
                highs.append(np.max([highs[b] for b in below], axis=0))
                self.children.append(below)
            level = above
        self.root, self.lows, self.highs = level[0], np.array(lows), np.array(highs)

    def _packed(self, x: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        """Slabs of one component after the other, those of the widest spread first."""
        leaves = math.ceil(len(rows) / LEAF)
        if leaves <= 1:
            return rows
        component = int(np.argmax(x[rows].max(axis=0) - x[rows].min(axis=0)))
        rows = rows[np.argsort(x[rows, component], kind="stable")]
        slabs = math.ceil(math.sqrt(leaves)) if depth == 0 else min(leaves, FANOUT)
        size = math.ceil(leaves / slabs) * LEAF
        return np.concatenate([self._packed(x, rows[b : b + size], depth + 1) for b in range(0, len(rows), size)])

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most inner products of each anchor with each node's box."""
        return _intervals(anchors, self.lows, self.highs)


def _intervals(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds from boxes, component by component; a little wider where doubles are not exact."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        most, least = up @ highs.T + down @ lows.T, up @ lows.T + down @ highs.T
        size = np.abs(anchors) @ np.maximum(np.abs(lows), np.abs(highs)).T
        slack = np.where(size < EXACT, 0.0, size * 1e-12)
        most, least = most + slack, least - slack
    return np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)


def _scores(x: np.ndarray, anchor: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products."""
    with np.errstate(over="ignore"):
        size = np.abs(x).max(initial=0.0) * np.abs(anchor).sum()
    if size < EXACT:
        return x @ anchor
    whole = [int(v) for v in anchor]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x] or [0], dtype=object)[: len(x)]


class Search:
    """Best-first searches of one anchor in one tree; leaves are scored once for all of them."""

    def __init__(self, tree: BoxTree, x: np.ndarray, ids: np.ndarray, anchor: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.tree, self.x, self.ids, self.anchor, self.least, self.most = tree, x, ids, anchor, least, most
        self.scored: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _leaf(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        if node not in self.scored:
            rows = self.tree.order[node * LEAF : (node + 1) * LEAF]
            self.scored[node] = (rows, _scores(self.x[rows], self.anchor))
        return self.scored[node]

    def top(self, k: int, wanted: np.ndarray, low: float, high: float, kth: float) -> list[tuple[int, int]]:
        """The first k of the wanted rows with scores in [low, high]: (score, place), higher scores
        first, then smaller ids. Nothing strictly below ``kth`` is needed."""
        least, most = self.least, self.most
        found: list[tuple] = []
        queue = [(-min(most[self.tree.root], high), self.tree.root)]
        while queue:
            bound, node = heapq.heappop(queue)
            floor = max(kth, found[0][0]) if len(found) == k else kth
            if -bound < floor:
                break
            below = self.tree.children[node]
            if below is not None:
                for child in below:
                    best = min(most[child], high)
                    if most[child] >= low and least[child] <= high and best >= floor:
                        heapq.heappush(queue, (-best, child))
                continue
            rows, scores = self._leaf(node)
            here = np.flatnonzero(wanted[rows] & (scores >= max(low, floor)) & (scores <= high))
            for i in here.tolist():
                item = (scores[i], -int(self.ids[rows[i]]), int(rows[i]))
                if len(found) < k:
                    heapq.heappush(found, item)
                elif item > found[0]:
                    heapq.heapreplace(found, item)
        return [(int(s), place) for s, _, place in sorted(found, reverse=True)]


class Index:
    """The tiled rows, held, and the boxes of the tiles."""

    def __init__(self, rows: DataFrame, width: int):
        self.width, spark = width, rows.sparkSession
        total = rows.count()
        tiles = min(max(1, math.ceil(total / TILE_ROWS)), SAMPLE // CUT_ROWS)
        sample = rows.orderBy(F.xxhash64("vec_id", "label", "vec"), "vec_id").limit(SAMPLE).select("vec").collect()
        cuts = Cuts(np.frombuffer(b"".join(bytes(r.vec) for r in sample), "<f8").reshape(-1, width), tiles)

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("vec"), width)
                    yield pa.RecordBatch.from_arrays([pa.array(cuts.tiles(x)), *batch.columns], ["tile", "vec_id", "label", "vec"])

        def box(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tile = batch.column("tile").to_numpy()
                x = _matrix(batch.column("vec"), width)
                for t in np.unique(tile):
                    own = x[tile == t]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(t)]), pa.array([len(own)]), pa.array([own.min(axis=0).tolist()]), pa.array([own.max(axis=0).tolist()])], ["tile", "n", "low", "high"]
                    )

        dealt = rows.mapInArrow(deal, "tile long, vec_id long, label long, vec binary")
        # Equal vectors share a tile. Of those with one label, the first ids are the only ones that
        # a list of this length can hold: the score is the same for all.
        first = Window.partitionBy("tile", "label", "vec").orderBy("vec_id")
        kept = dealt.withColumn("place", F.row_number().over(first)).where(F.col("place") <= max(NEGATIVES, POSITIVES + 1)).drop("place")
        kept = hold(kept, "tiles")
        # At most a row for each tile of the cuts.
        full = kept.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(2.0 * TILE_ROWS)).cast("int").alias("parts")).where("parts > 1").collect()
        self.parts = spark.createDataFrame([(r.tile, r.parts) for r in full], "tile long, parts int")
        self.cuts, self.spark = cuts, spark
        self.rows = self._split(kept)
        parts = self.rows.select("tile", "vec").mapInArrow(box, "tile long, n long, low array<double>, high array<double>")
        # Boxes of batches into boxes of tiles, component by component.
        flat = parts.select("tile", "n", F.posexplode(F.arrays_zip("low", "high")))
        flat = flat.groupBy("tile", "pos").agg(F.sum("n").alias("n"), F.min("col.low").alias("low"), F.max("col.high").alias("high"))
        side = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda p: p[c])
        self.boxes = hold(flat.groupBy("tile").agg(F.max("n").alias("n"), side("low").alias("low"), side("high").alias("high")), "boxes")
    def _split(self, rows: DataFrame) -> DataFrame:
        """The rows with the parts of full tiles as tiles of their own."""
        parts = F.coalesce("parts", F.lit(1))
        tile = F.col("tile") * (1 << 31) + F.pmod(F.xxhash64("vec"), parts)
        return rows.join(F.broadcast(self.parts), "tile", "left").withColumn("tile", tile).drop("parts")

    def home(self, anchors: DataFrame) -> DataFrame:
        """The anchors with their own tile as ``tile``."""
        cuts, width = self.cuts, self.width

        def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts.tiles(_matrix(batch.column("vec"), width)))], [*batch.schema.names, "tile"])

        return self._split(anchors.mapInArrow(place, f"{_shape(anchors)}, tile long"))

    def reached(self, asks: DataFrame) -> DataFrame:
        """Each ask ``(.., home, low, high, kth)`` with each other tile that can hold an answer, as
        ``tile``. The boxes go to the tasks a bounded number at a time."""
        width, names = self.width, self.boxes.select("tile").orderBy("tile")
        out, begin, last = None, 0, -1
        count = names.count()
        while begin < count:
            part = self.boxes.where(F.col("tile") > last).orderBy("tile").limit(BOXES).collect()
            tiles = np.array([r.tile for r in part])
            lows, highs = (np.array([r[c] for r in part], float).reshape(len(part), width) for c in ("low", "high"))

            def meet(batches: Iterable[pa.RecordBatch], tiles=tiles, lows=lows, highs=highs) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    least, most = _intervals(_matrix(batch.column("vec"), width), lows, highs)
                    low, high, kth, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "kth", "home"))
                    near = (most >= low[:, None]) & (least <= high[:, None]) & (np.minimum(most, high[:, None]) >= kth[:, None]) & (tiles[None, :] != home[:, None])
                    ask, tile = np.nonzero(near)
                    if len(ask):
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(ask)).columns, pa.array(tiles[tile])], [*batch.schema.names, "tile"])

            found = asks.mapInArrow(meet, f"{_shape(asks)}, tile long")
            out = found if out is None else out.unionAll(found)
            begin, last = begin + len(part), int(tiles[-1])
        return out

    def search(self, asks: DataFrame, k: int, same_label: bool) -> DataFrame:
        """``(ask, anchor_id, vec_id, score)``, the first k rows of each ask's tile with the anchor's
        label, or another one, and a score in the ask's interval.

        Tiles and the asks that came to them meet in pieces of up to
        ANCHORS asks, so that many asks of one tile are many pieces.
        """
        width = self.width
        counts = asks.groupBy("tile").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("pieces"))
        none = lambda kind: F.lit(None).cast(kind)
        rows = self.rows.join(counts, "tile").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        rows = rows.select("tile", "piece", "vec_id", "label", "vec", none("long").alias("ask"), none("double").alias("low"), none("double").alias("high"), none("double").alias("kth"))
        piece = F.pmod(F.xxhash64("ask"), F.col("pieces")).cast("int")
        asked = asks.join(counts, "tile").select("tile", piece.alias("piece"), F.col("anchor_id").alias("vec_id"), "label", "vec", "ask", "low", "high", "kth")

        def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups(batches, ["tile", "piece"]):
                asking = group.column("ask").is_valid().combine_chunks()
                members, ask = group.filter(pc.invert(asking)), group.filter(asking)
                if members.num_rows and ask.num_rows:
                    yield _answers(members, ask, width, k, same_label)

        met = sorted_groups(rows.unionByName(asked), ["tile", "piece"])
        return met.mapInArrow(answer, "ask long, anchor_id long, vec_id long, score long")


def _answers(members: pa.Table, asks: pa.Table, width: int, k: int, same_label: bool) -> pa.RecordBatch:
    x, anchors = (_matrix(t.column("vec").combine_chunks(), width) for t in (members, asks))
    ids, labels = (members.column(c).to_numpy() for c in ("vec_id", "label"))
    tree = BoxTree(x)
    out: list[tuple[int, int, int, int]] = []
    own = {c: asks.column(c).to_numpy() for c in ("vec_id", "label", "ask", "low", "high", "kth")}
    # Asks of one anchor share the scores of its leaves.
    order = np.lexsort((own["ask"], own["vec_id"]))
    search, last = None, None
    step = max(1, 4_000_000 // len(tree.lows))
    for begin in range(0, len(order), step):
        part = order[begin : begin + step]
        least, most = tree.intervals(anchors[part])
        for at, i in enumerate(part.tolist()):
            anchor, name, label = anchors[i], own["vec_id"][i], own["label"][i]
            if last is None or name != last[0] or not np.array_equal(anchor, last[1]):
                search, last = Search(tree, x, ids, anchor, least[at], most[at]), (name, anchor)
            wanted = labels == label if same_label else labels != label
            if same_label:
                itself = np.flatnonzero(ids == name)
                wanted[itself[(x[itself] == anchor).all(axis=1)]] = False
            for score, place in search.top(k, wanted, own["low"][i], own["high"][i], own["kth"][i]):
                out.append((int(own["ask"][i]), int(name), int(ids[place]), max(-LONG - 1, min(LONG, score))))
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["ask", "anchor_id", "vec_id", "score"])


def _shape(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def first_rows(index: Index, asks: DataFrame, k: int, same_label: bool, label: str) -> DataFrame:
    """``(ask, anchor_id, vec_id, score, rank)``, the first k rows over all tiles for each of
    ``asks(ask, anchor_id, label, vec, low, high)``."""
    homed = index.home(asks).withColumnRenamed("tile", "home")
    homed = hold(homed.withColumns({"kth": F.lit(float("-inf")), "tile": F.col("home")}), f"{label}-asks")
    near = hold(index.search(homed.select(*asks.columns, "kth", "tile"), k, same_label), f"{label}-home")
    # A full list of the own tile bounds the kth score; lists that are not full bound nothing.
    full = near.groupBy("ask").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") == k)
    known = homed.drop("kth", "tile").join(full.select("ask", "least"), "ask", "left").withColumn("kth", F.coalesce("least", F.lit(float("-inf")))).drop("least")
    far = index.reached(known.select(*asks.columns, "kth", "home"))
    both = near if far is None else near.unionByName(index.search(hold(far.drop("home"), f"{label}-far"), k, same_label))
    place = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id")
    return both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, width: int, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for each of
    ``anchors(vec_id, label, vec)``, rows of ``vectors``, as ``whole_vectors`` makes them.

    An anchor's positives are its first ``positives`` other rows of its label; the negatives of each are its first
    ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``. Higher scores come first, then
    smaller ids. Another row with the anchor's id but another vector is
    another row; anchors that share an id are separate. Scores beyond a long stay at its ends. No rows, no
    anchors or no partners give no rows.
    """
    if positives + 1 > max(NEGATIVES, POSITIVES + 1) or negatives > max(NEGATIVES, POSITIVES + 1):
        raise ValueError("lists this long need more than the first ids of equal vectors that the index keeps")
    index = Index(vectors, width)
    open_ended = {"low": F.lit(float("-inf")), "high": F.lit(float("inf"))}
    known = anchors.select(F.xxhash64("vec_id", "label", "vec").alias("ask"), F.col("vec_id").alias("anchor_id"), "label", "vec").withColumns(open_ended)
    known = hold(known, "anchors")
    found = first_rows(index, known, positives, True, "positives")
    pairs = hold(found.select(F.col("ask").alias("anchor"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "pairs")
    # Positives of equal score have the same negatives.
    score = F.col("positive_score").cast("decimal(38,0)")
    windows = pairs.where(score * low <= score * high).select("anchor", "positive_score").distinct()
    windows = windows.join(known.drop("low", "high").withColumnRenamed("ask", "anchor"), "anchor")
    windows = windows.select(
        F.xxhash64("anchor", "positive_score").alias("ask"),
        "anchor_id",
        "label",
        "vec",
        F.ceil(score * low / 100).cast("double").alias("low"),
        F.floor(score * high / 100).cast("double").alias("high"),
    )
    # The bounds as doubles let a little more in where they are not exact.
    answers = first_rows(index, hold(windows, "windows"), negatives, False, "negatives")
    answers = answers.select("ask", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    return pairs.withColumn("ask", F.xxhash64("anchor", "positive_score")).join(answers, "ask").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
