"""Hard negatives by exact search in a GNAT-style tree of multiway hyperplanes.

Rows are (id, label, vector of whole numbers), ids and labels whole numbers too; a row's score for an anchor is the inner product.
Vectors are lifted to one length by a further coordinate, so that a score is a distance: the anchor
(lifted by 0) is ``sqrt(|anchor|^2 + longest^2 - 2 * score)`` away. So bounds of scores are annuli.

* **Tree.** At most ``SAMPLE`` rows choose the split points: up to ``WAYS`` of them a node, far apart
  from each other; a row goes to the nearest (hyperplanes between them). Nodes end at ``LEAF_SAMPLE``
  rows of the sample, or where all are equal. All rows are then dealt to the leaves, and each split
  point gets the least and greatest distance to the rows of every sibling's subtree. So the tree's
  size is bounded, while it indexes each row.
* **Search.** An anchor first scans the leaf it lies in. The k-th score found there narrows its window.
  Then it walks the tree: a subtree is left out if for some split point its distance range and the
  window's annulus don't intersect. The leaves that stay are scanned exactly, so nothing is lost.
* **Leaves** are scanned in tiles of at most about ``ROWS`` rows and ``ANCHORS`` anchors, each one matrix
  product, whatever a leaf's size: a leaf of one vector repeated a million times is many tiles. Of a
  tile only the first k hits of each window leave.

An anchor's positives are the first rows of its label, its negatives of a positive the first rows of
other labels whose score is within the given percentages of the positive's. Higher scores come first,
then smaller ids, null ids last. Repeated rows are rows of their own, also as anchors. Shorter vectors
count as filled up with zeros. Rows with a null label or vector, a null or not finite component, or a
squared length of ``LONGEST`` or more, whose scores need not fit a long, take no part. Extra columns
aren't looked at. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.llm.common import pa_schema, store

SAMPLE, WAYS, LEAF_SAMPLE = 16_384, 8, 256
ROWS, ANCHORS = 32_768, 16_384
LONGEST = 2.0**55
#: Scores of a block of so many anchors are held at once.
BLOCK = 64
#: Doubles hold whole numbers exactly below this.
EXACT = 2.0**53
FAR = 1 << 60


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the squared length ``longest``."""
    rest = np.sqrt(np.maximum(longest - (vectors * vectors).sum(axis=1), 0))
    return np.column_stack((vectors, rest))


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Node:
    """Split points, the child of each (a node's number, or -1 - a leaf's), and the distance ranges.

    ``low[i, j]`` and ``high[i, j]`` bound the distances of point i to the rows below point j.
    """

    points: np.ndarray
    children: list[int]
    low: np.ndarray
    high: np.ndarray


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int
    longest: float

    def slack(self) -> float:
        """What rounding may move a distance by, generously."""
        return 1e-6 * (1 + self.longest**0.5)

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each node with rows of x: its number, the rows, their distances, their nearest points."""
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            number, rows = todo.pop()
            apart = distances(x[rows], self.nodes[number].points)
            nearest = apart.argmin(axis=1)
            yield number, rows, apart, nearest
            for j, child in enumerate(self.nodes[number].children):
                if child >= 0 and (below := rows[nearest == j]).size:
                    todo.append((child, below))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), np.int64)
        for number, rows, _, nearest in self.walk(x):
            child = np.array(self.nodes[number].children)[nearest]
            leaf[rows[child < 0]] = -1 - child[child < 0]
        return leaf

    def reached(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(anchors x leaves): may the leaf have a score within one of the windows (anchors x windows)?

        ``anchors`` are not lifted.
        """
        square = (anchors * anchors).sum(axis=1)[:, None]
        empty = low > high
        near = np.sqrt(np.maximum(square + self.longest - 2.0 * high, 0)) - self.slack()
        far = np.sqrt(np.maximum(square + self.longest - 2.0 * low, 0)) + self.slack()
        # No score is beyond the product of both lengths, so neither is a window's part that can hold rows.
        open_ = ~empty & (low <= np.sqrt(square * self.longest) + 1) & (high >= -np.sqrt(square * self.longest) - 1)
        x = np.column_stack((anchors, np.zeros(len(anchors))))
        out = np.zeros((len(anchors), self.leaves), bool)
        if not self.nodes:
            out[:, :1] = open_.any(axis=1)[:, None]
            return out
        todo = [(0, np.arange(len(x)), open_)]
        while todo:
            number, rows, alive = todo.pop()
            node = self.nodes[number]
            apart = distances(x[rows], node.points)[:, :, None]
            least = np.maximum(apart - far[rows][:, None], near[rows][:, None] - apart)
            most = apart + far[rows][:, None]
            for j, child in enumerate(node.children):
                meets = (least <= node.high[:, j, None]) & (most >= node.low[:, j, None])
                stays = alive & meets.all(axis=1)
                some = stays.any(axis=1)
                if child < 0:
                    out[rows[some], -1 - child] = True
                elif some.any():
                    todo.append((child, rows[some], stays[some]))
        return out


def grown(sample: np.ndarray, longest: float) -> Tree:
    """The tree that a sample of lifted vectors, in random order, chooses; ranges are still empty."""
    tree = Tree([], 0, longest)

    def grow(rows: np.ndarray) -> int:
        points = far_apart(sample[rows[: 3 * WAYS]]) if len(rows) > LEAF_SAMPLE else []
        if len(points) < 2:
            tree.leaves += 1
            return -tree.leaves
        empty = np.full((len(points), len(points)), np.inf)
        node = Node(points, [], empty, -empty)
        number = len(tree.nodes)
        tree.nodes.append(node)
        nearest = distances(sample[rows], points).argmin(axis=1)
        node.children.extend(grow(rows[nearest == j]) for j in range(len(points)))
        return number

    grow(np.arange(len(sample)))
    return tree


def far_apart(candidates: np.ndarray) -> np.ndarray:
    """Up to WAYS of the candidates, each the farthest from those before it; equal ones count once."""
    chosen = [0]
    apart = distances(candidates, candidates[:1])[:, 0]
    while len(chosen) < min(WAYS, len(candidates)) and apart.max() > 1e-6 * (1 + np.abs(candidates).max()):
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, distances(candidates, candidates[chosen[-1:]])[:, 0])
    return candidates[chosen]


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def through(df: DataFrame, schema: str, made: Callable[[pa.RecordBatch], Iterator[list]]) -> DataFrame:
    """``df`` through a function from a batch to lists of columns."""
    fields = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in made(batch) if batch.num_rows else ():
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(run, schema)


def usable(rows: DataFrame, anchor: Column) -> DataFrame:
    """(uid, id, label, vec, anchor) of the rows that take part, written once so that ``uid`` stays."""
    number = F.transform("vector", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    good = rows.select("id", F.col("label").cast("long").alias("label"), number.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    good = good.where("label is not null and v is not null").where(finite).withColumn("square", square)
    return store(good.where(F.col("square") < LONGEST).withColumn("uid", F.monotonically_increasing_id()), "vectors")


class Index:
    """The rows dealt to the leaves of a tree, ready for windows of scores."""

    def __init__(self, rows: DataFrame, dims: int, longest: float, sample: int = SAMPLE):
        self.spark, self.dims = rows.sparkSession, dims
        chosen = rows.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("vec").toArrow()  # at most ``sample`` rows
        tree = grown(lifted(matrix(chosen["vec"], dims), longest), longest)
        model = self.spark.sparkContext.broadcast(tree)

        def dealt(batch: pa.RecordBatch) -> Iterator[list]:
            leaf = model.value.leaf_of(lifted(matrix(batch.column(3), dims), longest))
            yield [*batch.columns, pa.array(leaf)]

        kind = rows.schema["id"].dataType.simpleString()
        placed = rows.select("uid", "id", "label", "vec", "anchor")
        schema = f"uid long, id {kind}, label long, vec array<double>, anchor boolean, leaf long"
        self.rows = store(through(placed, schema, dealt), "leaves")
        self._ranges(tree, model)
        self.tree = self.spark.sparkContext.broadcast(tree)
        self.sizes = {r.leaf: r.n for r in self.rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one a leaf

    def _ranges(self, tree: Tree, model) -> None:
        """Fills in the distance ranges: one row a pair of siblings comes back."""
        dims, longest = self.dims, tree.longest

        def ranges(batch: pa.RecordBatch) -> Iterator[list]:
            out: list[tuple] = []
            for number, _, apart, nearest in model.value.walk(lifted(matrix(batch.column(0), dims), longest)):
                for j in np.unique(nearest).tolist():
                    own = apart[nearest == j]
                    low, high = own.min(axis=0), own.max(axis=0)
                    out += [(number, i, j, float(low[i]), float(high[i])) for i in range(len(low))]
            if out:
                yield [list(c) for c in zip(*out, strict=True)]

        found = through(self.rows.select("vec"), "node int, i int, j int, low double, high double", ranges)
        for r in found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            node = tree.nodes[r.node]
            node.low[r.i, r.j], node.high[r.i, r.j] = r.low - tree.slack(), r.high + tree.slack()

    def top(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(uid, window, score, id, hit) of the first k rows in each window of each anchor.

        ``anchors`` has (uid, label, vec, leaf, low, high), the last two with a bound for each window.
        ``same`` asks for rows of the anchor's label but itself, otherwise for those of other labels.
        """
        own = store(self._scanned(anchors, k, same), "own-leaf")
        order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("hit")]
        place = F.row_number().over(Window.partitionBy("uid", "window").orderBy(*order))
        kth = own.withColumn("place", place).where(F.col("place") == k)
        bounds = kth.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))  # one entry a window
        narrow = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("kth", w + 1), x)))
        narrowed = anchors.join(bounds, "uid", "left").withColumn("low", narrow)
        rest = store(self._scanned(self._reached(narrowed), k, same), "other-leaves")
        return own.unionByName(rest).withColumn("place", place).where(F.col("place") <= k)

    def _reached(self, anchors: DataFrame) -> DataFrame:
        """A row for each leaf but its own that an anchor has to scan."""
        tree, dims = self.tree, self.dims

        def reached(batch: pa.RecordBatch) -> Iterator[list]:
            low, high = (c.to_pylist() for c in batch.columns[4:])
            most = max(map(len, low))
            low = np.array([x + [1] * (most - len(x)) for x in low], np.float64).reshape(batch.num_rows, most)
            high = np.array([x + [0] * (most - len(x)) for x in high], np.float64).reshape(batch.num_rows, most)
            found = tree.value.reached(matrix(batch.column(2), dims), low, high)
            found[np.arange(batch.num_rows), batch.column(3).to_numpy()] = False
            for start in range(0, batch.num_rows, BLOCK):
                at, leaf = np.nonzero(found[start : start + BLOCK])
                if len(at):
                    taken = batch.take(pa.array(at + start))
                    yield [*taken.columns[:3], pa.array(leaf.astype(np.int64)), *taken.columns[4:]]

        columns = ["uid", "label", "vec", "leaf", "low", "high"]
        schema = "uid long, label long, vec array<double>, leaf long, low array<long>, high array<long>"
        return through(anchors.select(*columns), schema, reached)

    def _scanned(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """The first k hits of each tile for each window of the anchors that come to its leaf."""
        dims, longest = self.dims, self.tree.value.longest
        asked = store(anchors.select("uid", "label", "vec", "leaf", "low", "high"), "asked")
        waiting = {r.leaf: r.n for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one a leaf
        row_parts = {leaf: -(-n // ROWS) for leaf, n in self.sizes.items()}
        anchor_parts = {leaf: -(-n // ANCHORS) for leaf, n in waiting.items()}
        parts = self.spark.createDataFrame(
            [(leaf, row_parts[leaf], n) for leaf, n in anchor_parts.items()], "leaf long, row_parts int, anchor_parts int"
        )

        def all_of(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        def one_of(n: str) -> Column:
            return F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")

        tile = ["leaf", "row_part", "anchor_part"]
        left = self.rows.join(F.broadcast(parts), "leaf").select(
            "leaf", one_of("row_parts").alias("row_part"), all_of("anchor_parts").alias("anchor_part"), "uid", "id", "label", "vec"
        )
        right = asked.join(F.broadcast(parts), "leaf").select(
            "leaf", all_of("row_parts").alias("row_part"), one_of("anchor_parts").alias("anchor_part"), "uid", "label", "vec", "low", "high"
        )
        id_type = self.rows.schema["id"].dataType.simpleString()
        schema = f"uid long, window int, score long, id {id_type}, hit long"
        fields = pa_schema(self.spark, schema)

        def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if rows.num_rows and queries.num_rows:
                out = list(hits(rows, queries, dims, longest, k, same))
            columns = [list(c) for c in zip(*out, strict=True)] or [[] for _ in fields]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(scan, schema)


def hits(rows: pa.Table, queries: pa.Table, dims: int, longest: float, k: int, same: bool) -> Iterator[tuple]:
    """(uid, window, score, id, hit): the first k rows of each query's windows, windows numbered from 1."""
    ids = rows["id"].to_pylist()
    last = np.array([i is None for i in ids])
    number = np.array([0 if i is None else i for i in ids], np.int64)
    uid, label, vec = rows["uid"].to_numpy(), rows["label"].to_numpy(), matrix(rows["vec"], dims)
    asked, wanted, other = queries["uid"].to_numpy(), queries["label"].to_numpy(), matrix(queries["vec"], dims)
    low, high = queries["low"].to_pylist(), queries["high"].to_pylist()
    whole = np.float64 if longest < EXACT else np.int64
    vec, other = vec.astype(whole), other.astype(whole)
    for start in range(0, len(asked), BLOCK):
        scores = (other[start : start + BLOCK] @ vec.T).astype(np.int64)
        for q, own in enumerate(scores, start=start):
            right = (label == wanted[q]) & (uid != asked[q]) if same else label != wanted[q]
            for window, (a, b) in enumerate(zip(low[q], high[q], strict=True), start=1):
                at = np.flatnonzero(right & (own >= a) & (own <= b))
                if len(at) > k:
                    border = np.partition(own[at], len(at) - k)[len(at) - k]
                    at = at[own[at] >= border]
                at = at[np.lexsort((uid[at], number[at], last[at], -own[at]))][:k]
                yield from ((int(asked[q]), window, int(own[x]), ids[x], int(uid[x])) for x in at)


RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), sample: int = SAMPLE
) -> DataFrame:
    """RESULT for rows (id, label, vector) and a condition that makes a row an anchor."""
    good = usable(rows, anchor)
    facts = good.agg(F.max(F.size("v")).alias("dims"), F.max("square").alias("longest")).first()
    dims, longest = facts.dims or 0, facts.longest or 0.0
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v")))
    index = Index(good.withColumn("vec", filled), dims, longest, sample)
    anchors = index.rows.where("anchor")
    bounds = [F.array(F.lit(x).cast("long")).alias(name) for name, x in (("low", -FAR), ("high", FAR))]
    found = index.top(anchors.select("uid", "label", "vec", "leaf", *bounds), positives, same=True)
    near = store(found.select("uid", F.col("place").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def share(of: int, up: bool) -> Column:
        """That percentage of the positive's score, rounded to a whole number inside the window."""
        times = F.col("positive_score") * of
        down = (times - F.pmod(times, F.lit(100))) / 100
        return (F.when(F.pmod(times, F.lit(100)) > 0, down + 1).otherwise(down) if up else down).cast("long")

    windows = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("window", share(percent[0], True).alias("low"), share(percent[1], False).alias("high")))).alias("w"))  # at most ``positives``
    asked = anchors.join(windows, "uid").select("uid", "label", "vec", "leaf", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    hard = index.top(asked, negatives, same=False)
    return (
        hard.select("uid", "window", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(near, ["uid", "window"])
        .join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
        .select(*RESULT)
    )
