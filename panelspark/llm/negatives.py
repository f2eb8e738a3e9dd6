"""Hard negatives by maximum inner products over cover trees.

A candidate gets one more coordinate that gives all candidates the same norm; an inner product then falls as the
distance grows. Candidates are routed to cells, cells are cut into blocks, and each block becomes a cover tree: level by
level a node is divided around centres until its covering radius has halved. Distance to a centre, less or plus its
radius, bounds all inner products below it. Anchors descend the trees of a shard together, the most promising node
first; an anchor leaves a node whose bounds lie outside all its windows or under what it has found, and the rows of the
leaves that remain are compared exactly.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.session import materialise

SAMPLE_ROWS = 2048  # rows from which the centres of the cells are taken; every row is routed and indexed
MOST_CELLS = 256
BLOCK_ROWS = 4096  # rows of a tree, on average at most
SHARD_ROWS = 16384  # rows of the trees that meet a block of anchors in one task, on average at most
BLOCK_ANCHORS = 2048  # on average at most
FANOUT = 16
LEAF_ROWS = 256
EXACT = 2.0**53  # inner products below are exact in doubles
NOTHING = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes last

_TREE = "dim int, shard int, points binary, ids binary, labels binary, centres binary, radii binary, spans binary, parts binary"


def prepared(df: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, id, label, vector, dim, anchor, norm2) of the rows that take part; vector holds floor(scale * component)."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    usable = df.where(F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    vector = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    rows = usable.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(label_col).cast("long").alias("label"),
        vector.alias("vector"), F.size(vector_col).alias("dim"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    largest = F.aggregate("vector", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x).cast("double")))
    norm2 = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return rows.where(F.col("dim") * largest * largest < EXACT).withColumns(
        {"norm2": norm2, "row": F.monotonically_increasing_id()})


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), np.float64).reshape(len(column), width)


def augmented(points: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.maximum(norm2 - np.einsum("ij,ij->i", points, points), 0.0)
    return np.column_stack([points, np.sqrt(rest)])


def net(points: np.ndarray, first: int, most: int, radius: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres, farthest first, until all points are within ``radius`` of one or there are ``most``; each point's centre
    and its distance."""
    centres, home = [first], np.zeros(len(points), np.int64)
    away = np.linalg.norm(points - points[first], axis=1)
    while len(centres) < most and away.max() > radius:
        far = int(away.argmax())
        reach = np.linalg.norm(points - points[far], axis=1)
        closer = reach < away
        home[closer], away[closer] = len(centres), reach[closer]
        centres.append(far)
    return centres, home, away


@dataclass
class Tree:
    points: np.ndarray  # rows, so that those of a node are together
    ids: np.ndarray
    labels: np.ndarray
    centres: np.ndarray  # of the nodes, without the further coordinate
    radii: np.ndarray
    spans: np.ndarray  # first and last row of each node
    parts: np.ndarray  # first and last child, equal for a leaf


def build(points: np.ndarray, ids: np.ndarray, labels: np.ndarray, norm2: float) -> Tree:
    """Cover tree of one block. Rows of a leaf are in order of their ids."""
    full, order = augmented(points, norm2), np.arange(len(points))
    centres, spans, parts, radii, at = [full[0]], [(0, len(points))], [], [], 0
    while at < len(centres):
        a, b = spans[at]
        inside = full[order[a:b]]
        away = np.linalg.norm(inside - centres[at], axis=1)
        radii.append(away.max())
        parts.append((len(centres), len(centres)))
        if b - a > LEAF_ROWS and radii[at] > 0:
            chosen, home, _ = net(inside, int(away.argmin()), FANOUT, radii[at] / 2)
            by_home = np.argsort(home, kind="stable")
            ends = a + np.concatenate([[0], np.cumsum(np.bincount(home, minlength=len(chosen)))])
            order[a:b] = order[a:b][by_home]
            centres += list(inside[chosen])
            spans += list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            parts[at] = (parts[at][0], len(centres))
        else:
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
        at += 1
    return Tree(points[order], ids[order], labels[order], np.array(centres)[:, :-1], np.array(radii),
                np.array(spans, np.int64), np.array(parts, np.int64))


class Search:
    """Best rows of each anchor within its windows: scores from ``low`` to ``high``, both (anchors, windows)."""

    def __init__(self, anchors, ids, labels, low, high, same_label: bool, norm2: float, most: int):
        self.anchors, self.ids, self.labels, self.low, self.high = anchors, ids, labels, low, high
        self.same, self.norm2, self.most = same_label, norm2, most
        self.anchor2 = np.einsum("ij,ij->i", anchors, anchors)
        self.slack = 1e-9 * (self.anchor2 + norm2) + 1e-6
        self.scores = np.full((*low.shape, most), NOTHING)
        self.found = np.full((*low.shape, most), NO_ID)

    def bounds(self, who: np.ndarray, tree: Tree, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that rows below the nodes can have: (nodes, anchors)."""
        total = self.anchor2[who] + self.norm2
        away = np.sqrt(np.maximum(total - 2 * (tree.centres[nodes] @ self.anchors[who].T), 0.0))
        radii, slack = tree.radii[nodes][:, None], self.slack[who]
        least = (total - (away + radii) ** 2) / 2 - slack
        largest = (total - np.maximum(away - radii, 0.0) ** 2) / 2 + slack
        return least, largest

    def open(self, who: np.ndarray, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
        wanted = np.maximum(self.low[who], self.scores[who, :, -1])
        return ((largest[:, None] >= wanted) & (least[:, None] <= self.high[who]) & (wanted <= self.high[who])).any(axis=1)

    def verify(self, who: np.ndarray, tree: Tree, a: int, b: int) -> None:
        for at in range(a, b, LEAF_ROWS):
            rows = slice(at, min(at + LEAF_ROWS, b))
            ids = tree.ids[rows]
            score = (self.anchors[who] @ tree.points[rows].T).astype(np.int64)
            fits = (self.labels[who][:, None] == tree.labels[rows]) == self.same
            fits &= (self.ids[who][:, None] != ids) | (ids == NO_ID)
            inside = fits[:, None] & (score[:, None] >= self.low[who][:, :, None]) & (score[:, None] <= self.high[who][:, :, None])
            inside &= score[:, None] >= self.scores[who, :, -1][:, :, None]
            hit = inside.any(axis=(1, 2))
            if not hit.any():
                continue
            own, inside, score = who[hit], inside[hit], score[hit]
            key = score * LEAF_ROWS + (LEAF_ROWS - 1 - np.arange(score.shape[1]))  # equal scores: the smaller id first
            key = np.where(inside, key[:, None], NOTHING)
            if key.shape[2] > self.most:
                key = np.partition(key, -self.most, axis=2)[:, :, -self.most:]
            real = key != NOTHING
            new_score = np.where(real, key // LEAF_ROWS, NOTHING)
            new_id = np.where(real, ids[np.where(real, LEAF_ROWS - 1 - key % LEAF_ROWS, 0)], NO_ID)
            scores = np.concatenate([self.scores[own], new_score], axis=2)
            found = np.concatenate([self.found[own], new_id], axis=2)
            best = np.lexsort((found, ~scores), axis=2)[:, :, : self.most]  # ~ turns the order without overflow
            self.scores[own] = np.take_along_axis(scores, best, axis=2)
            self.found[own] = np.take_along_axis(found, best, axis=2)

    def run(self, trees: list[Tree]) -> None:
        heap, ticket, everyone = [], count(), np.arange(len(self.anchors))

        def push(who, tree, nodes):
            least, largest = self.bounds(who, tree, nodes)
            for i, node in enumerate(range(nodes.start, nodes.stop)):
                stays = self.open(who, least[i], largest[i])
                if stays.any():
                    top = largest[i][stays]
                    heapq.heappush(heap, (-top.max(), next(ticket), tree, node, who[stays], least[i][stays], top))

        for tree in trees:
            push(everyone, tree, slice(0, 1))
        while heap:
            _, _, tree, node, who, least, largest = heapq.heappop(heap)
            who = who[self.open(who, least, largest)]
            if len(who):
                first, last = tree.parts[node]
                if first == last:
                    self.verify(who, tree, *tree.spans[node])
                else:
                    push(who, tree, slice(first, last))


def cover_trees(rows: DataFrame, norm2: float, total: int) -> DataFrame:
    """One row per tree. Cells are those of centres from a bounded sample; a cell of many rows is several trees."""
    n_cells = max(1, min(MOST_CELLS, -(-total // BLOCK_ROWS)))
    sample = rows.orderBy(F.xxhash64("vector", "id"), "row").limit(SAMPLE_ROWS).select("dim", "vector").toPandas()
    centres = {}
    for dim, part in sample.groupby("dim"):
        points = augmented(np.array(part["vector"].tolist(), np.float64).reshape(len(part), dim), norm2)
        centres[dim] = points[net(points, 0, n_cells, 0.0)[0]]

    def route(batches):
        for batch in batches:
            dims, cells = np.asarray(batch.column("dim")), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims):
                if dim in centres:
                    at = np.flatnonzero(dims == dim)
                    points = augmented(matrix(batch.column("vector").take(pa.array(at)), dim), norm2)
                    cells[at] = (points @ centres[dim].T).argmax(axis=1)  # norms are equal: the nearest one
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    routed = materialise(rows.select("row", "id", "label", "vector", "dim").mapInArrow(
        route, "row long, id long, label long, vector array<bigint>, dim int, cell int"), "routed")
    sizes = routed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    n_shards = max(1, -(-total // SHARD_ROWS))
    salted = routed.join(sizes, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))

    def plant(key, table):
        dim, cell, block = (k.as_py() for k in key)
        tree = build(matrix(table["vector"], dim), np.asarray(table["id"]), np.asarray(table["label"]), norm2)
        shard = hash((dim, cell, block)) % n_shards
        parts = [tree.points.astype(np.int64), tree.ids, tree.labels, tree.centres, tree.radii, tree.spans, tree.parts]
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()),
            **{n: pa.array([p.tobytes()], pa.binary()) for n, p in zip(Tree.__dataclass_fields__, parts)}})

    return salted.select("dim", "cell", "block", "id", "label", "vector").groupBy("dim", "cell", "block").applyInArrow(
        plant, _TREE)


def searched(
    anchors: DataFrame, trees: DataFrame, n_anchors: int, total: int, norm2: float, same_label: bool, most: int
) -> DataFrame:
    """(row, window, score, other): up to ``most`` rows per anchor, window and shard.

    ``anchors`` has (row, id, label, vector, dim, low, high), the last two arrays with the windows. Blocks of anchors meet
    shards of trees, one group each.
    """
    n_blocks, n_shards = max(1, -(-n_anchors // BLOCK_ANCHORS)), max(1, -(-total // SHARD_ROWS))
    left = anchors.withColumns({
        "anchors": F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"),
        "shard": F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))})
    right = trees.withColumn("anchors", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    key = ["dim", "anchors", "shard"]

    def descend(key, left, right):
        dim, n = key[0].as_py(), left.num_rows
        if n == 0 or right.num_rows == 0:
            return pa.table({c: pa.array([], pa.int64()) for c in ("row", "score", "other")}
                            | {"window": pa.array([], pa.int32())}).select(["row", "window", "score", "other"])
        low, high = (np.asarray(pc.list_flatten(left[c])).reshape(n, -1) for c in ("low", "high"))
        search = Search(matrix(left["vector"], dim), np.asarray(left["id"]), np.asarray(left["label"]), low, high,
                        same_label, norm2, most)
        kinds = [np.int64, np.int64, np.int64, np.float64, np.float64, np.int64, np.int64]
        trees = []
        for values in zip(*[right[c] for c in Tree.__dataclass_fields__]):
            tree = Tree(*[np.frombuffer(v.as_buffer(), t) for v, t in zip(values, kinds)])
            tree.points = tree.points.reshape(len(tree.ids), dim).astype(np.float64)
            tree.centres = tree.centres.reshape(len(tree.radii), dim)
            tree.spans, tree.parts = tree.spans.reshape(-1, 2), tree.parts.reshape(-1, 2)
            trees.append(tree)
        search.run(trees)
        who, window, slot = np.nonzero(search.scores != NOTHING)
        return pa.table({
            "row": np.asarray(left["row"])[who], "window": window.astype(np.int32),
            "score": search.scores[who, window, slot], "other": search.found[who, window, slot]})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        descend, "row long, window int, score long, other long")


def hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", *,
    scale: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which ``anchor`` holds.

    Components become floor(scale * component) and scores are integer inner products, higher first, equal ones by id. An
    anchor's positives are its first ``positives`` rows of its label with another id; for each of them come the first
    ``negatives`` rows of other labels whose score is at least ``percent`` per cent of the positive's and at most equal.

    Rows with a null label, a null vector, or a component that is null or not finite take no part, nor do vectors so long
    that their scores are not exact in doubles. Labels are integers. Vectors are compared with those of their own length only.
    A null id comes last among equal scores, and each row with one is another than the anchor. Equal rows count as
    often as they occur, anchors too; other columns are not read; an empty table gives an empty one.
    """
    rows = materialise(prepared(df, anchor, id_col, label_col, vector_col, scale), "vectors")
    total, n_anchors, norm2 = rows.agg(
        F.count("*"), F.count_if("anchor"), F.coalesce(F.max("norm2"), F.lit(0.0))).first()
    trees = materialise(cover_trees(rows, norm2, total), "trees")
    anchors = rows.where("anchor").select("row", "id", "label", "vector", "dim")

    def best(low: Column, high: Column, of: DataFrame, same_label: bool, most: int) -> DataFrame:
        found = searched(of.withColumns({"low": low, "high": high}), trees, n_anchors, total, norm2, same_label, most)
        order = W.partitionBy("row", "window").orderBy(F.desc("score"), "other")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)

    near = best(F.array(F.lit(int(NOTHING) + 1)), F.array(F.lit(int(NO_ID))), anchors, True, positives)
    own = near.groupBy("row").agg(F.sort_array(F.collect_list(  # as many as positives
        F.struct("place", F.col("other").alias("id"), "score"))).alias("own"))
    own = materialise(anchors.join(own, "row"), "positives")
    least = "transform(own, p -> if(p.score >= 0, ({0} * p.score + 99) div 100, {0} * p.score div 100))".format(int(percent))
    filler = F.array_repeat(F.lit(0).cast("long"), F.lit(positives) - F.size("own"))  # from 1 to 0: no score fits
    low = F.concat(F.expr(least), F.transform(filler, lambda z: z + 1))
    high = F.concat(F.transform("own", lambda p: p["score"]), filler)
    far = best(low, high, own.select("row", "id", "label", "vector", "dim", "own"), False, negatives)
    windows = own.select("row", F.col("id").alias("anchor"), F.posexplode("own").alias("window", "positive"))

    def named(c: Column) -> Column:
        return F.when(c != int(NO_ID), c)

    return far.join(windows, ["row", "window"]).select(
        named(F.col("anchor")).alias("anchor_id"), named(F.col("positive.id")).alias("positive_id"),
        F.col("place").alias("rank"), named(F.col("other")).alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
