"""Merkle manifest of a table: a digest tree per group, a tree over the groups, and a proof for every row.

Nodes keep the row of their first leaf. A level reads the digests of a node's siblings from the rows at fixed distances
by lag and lead, masked by the node's slot in its run and the run's length, and the row of a run's first child then
holds the parent's digest. The windows hold aligned chunks of leaves, so that all levels within a chunk share one
shuffle and no group, however large, meets in one task; the chunks' tops are the leaves of the next round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.operators.ordering import ordered_index
from panelspark.session import materialise

ARITY = 3
LEVELS = 7  # levels of a round; a window holds ARITY ** LEVELS rows at most
CHUNK = ARITY**LEVELS
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number within a partition in its low 33 bits

PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*[framed(v) for v in values])


def _up(nodes: DataFrame, with_path: bool) -> DataFrame:
    """One round over (tree, pos, n, h, ...): adds ``top`` in the first row of each chunk, and ``path`` to every row.

    ``n`` is the number of nodes of the tree and ``pos`` counts them from 0. A level of one node is the tree's end.
    """
    w = W.partitionBy("tree", "chunk").orderBy("pos")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = nodes.withColumns({"chunk": F.floor(F.col("pos") / CHUNK), "_h0": F.col("h")})
    steps = []
    for k in range(LEVELS):
        step, h = ARITY**k, f"_h{k}"
        at = F.floor(F.col("pos") / step)
        slot, size = at % ARITY, F.floor((F.col("n") + step - 1) / step)
        run = F.least(F.lit(ARITY), size - (at - slot))
        near = {f"_lag{i}": F.lag(h, i * step).over(w) for i in range(1, ARITY)}
        near |= {f"_lead{i}": F.lead(h, i * step).over(w) for i in range(1, ARITY)}
        before = [F.when(slot >= i, F.col(f"_lag{i}")).otherwise("") for i in range(ARITY - 1, 0, -1)]
        after = [F.when(slot + i < run, F.col(f"_lead{i}")).otherwise("") for i in range(1, ARITY)]
        node, live = F.col("pos") % step == 0, F.col("n") > step
        rows = rows.withColumns(near).withColumns({"_before": F.concat(*before), "_after": F.concat(*after)})
        parent = F.when(node & (slot == 0), digest(F.col(h), F.col("_after")))
        rows = rows.withColumn(f"_h{k + 1}", F.when(live, parent).otherwise(F.col(h)))
        if with_path:
            own = F.struct(F.col("_before").alias("before"), F.col("_after").alias("after"))
            rows = rows.withColumn(f"_s{k}", F.last(F.when(node & live, own), ignorenulls=True).over(so_far))
            steps.append(F.when(live, F.col(f"_s{k}")))
        rows = rows.drop("_before", "_after", *near)
    out = {"top": F.when(F.col("pos") % CHUNK == 0, F.col(f"_h{LEVELS}"))}
    if with_path:
        out["path"] = F.array_compact(F.array(*steps)).cast(PATH)
    return rows.withColumns(out).select(*nodes.columns, "chunk", *out)


@dataclass
class Trees:
    rounds: list[DataFrame]  # nodes of each round, the lowest first
    roots: DataFrame  # (tree, root)

    def paths(self) -> DataFrame:
        """(tree, chunk, root, rest): what the leaves of each chunk of the lowest round have above their chunk."""
        out = self.roots.select("tree", F.lit(0).cast("long").alias("chunk"), "root", F.array().cast(PATH).alias("rest"))
        for nodes in self.rounds[:0:-1]:
            own = _up(nodes, with_path=True).select("tree", "chunk", "pos", "path")
            out = own.join(out, ["tree", "chunk"]).select(
                "tree", F.col("pos").alias("chunk"), "root", F.concat("path", "rest").alias("rest"))
        return out


def grow(nodes: DataFrame, most: int) -> Trees:
    """Digest trees over (tree, pos, n, h), of which the largest has ``most`` leaves; written round by round."""
    rounds = [nodes]
    while True:
        tops = _up(rounds[-1].select("tree", "pos", "n", "h"), with_path=False).where("top is not null").select(
            "tree", F.col("chunk").alias("pos"), F.ceil(F.col("n") / CHUNK).alias("n"), F.col("top").alias("h"))
        tops = materialise(tops, "merkle")
        most = -(-most // CHUNK)
        if most <= 1:
            return Trees(rounds, tops.select("tree", F.col("h").alias("root")))
        rounds.append(tops)


def _placed(leaves: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves with their group's number ``tree``, their place ``pos`` in it and its size ``n``; and the groups.

    The leaves are written once in order; a group then starts in each part where its first row does, so that one small
    row per (part, group) places them all.
    """
    ordered = leaves.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    stored = materialise(ordered.withColumn("_slot", F.monotonically_increasing_id()), "ordered")
    stored = stored.withColumn("_part", F.shiftright("_slot", _ROW_BITS))
    pieces = materialise(
        stored.groupBy(group, "_part").agg(F.min("_slot").alias("_first"), F.count("*").alias("_size")), "pieces")
    groups = ordered_index(pieces.groupBy(group).agg(F.sum("_size").alias("n")), group, name="tree")
    groups = materialise(groups, "groups")
    earlier = W.partitionBy(group).orderBy("_part")  # one row per part at most
    starts = pieces.withColumn("_start", F.sum("_size").over(earlier) - F.col("_size"))
    named = groups.withColumnRenamed(group, "_group")
    starts = starts.join(named, starts[group].eqNullSafe(named["_group"])).select(
        F.col(group).alias("_group"), F.col("_part").alias("_of"), "_first", "_start", "tree", "n")
    same = (stored["_part"] == starts["_of"]) & stored[group].eqNullSafe(starts["_group"])
    placed = stored.join(starts, same).withColumn("pos", F.col("_start") + F.col("_slot") - F.col("_first"))
    return placed.drop("_slot", "_part", "_group", "_of", "_first", "_start"), groups


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, path, folded_root, verified) for every row of ``docs``.

    A leaf is the digest of the row's ``columns``, each framed by its length; other columns are not read. Leaves of a
    group ascend by id, null first, equal ids by digest; every three consecutive nodes become one until one is left, the
    group's subroot. Subroots, ordered by group, null first, become the root in the same way. ``path`` holds, level by
    level, the digests before and after the row's ancestor in its run. ``changed`` gives columns as they are found at
    verification; ``folded_root`` is the root that follows from the changed row and the stored path, and ``verified``
    says whether it is the root. Without ``changed`` every row verifies.

    Nulls are values of their own, an empty text differs from null, equal rows are leaves of their own with the same
    digest, an empty table gives an empty one.
    """
    found = {c: F.col(c) for c in columns}
    leaf = leaf_digest(*found.values())
    other = leaf_digest(*[(changed or {}).get(c, v) for c, v in found.items()])
    leaves = materialise(docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf.alias("h"), other.alias("found")), "leaves")
    placed, groups = _placed(leaves, "group", ["id", "h"])
    placed = materialise(placed.drop("group"), "placed")
    sizes = groups.agg(F.count("*"), F.max("n")).first()
    lower = grow(placed, sizes[1] or 0)
    upper = grow(lower.roots.join(groups, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(sizes[0]).alias("n"), F.col("root").alias("h")),
        sizes[0])

    def whole(trees: Trees) -> DataFrame:
        """Every leaf of the lowest round with its root and its whole path."""
        return _up(trees.rounds[0], with_path=True).join(trees.paths(), ["tree", "chunk"]).withColumn(
            "path", F.concat("path", "rest")).drop("rest", "chunk", "top")

    above = whole(upper).select(F.col("pos").alias("tree"), F.col("root").alias("_root"), F.col("path").alias("_above"))
    chunks = lower.paths().join(above, "tree").select(
        "tree", "chunk", F.col("root").alias("subroot"), F.col("_root").alias("root"), F.concat("rest", "_above").alias("rest"))
    rows = _up(placed, with_path=True).join(chunks, ["tree", "chunk"]).withColumn("path", F.concat("path", "rest"))
    folded = F.aggregate("path", F.col("found"), lambda h, s: digest(s["before"], h, s["after"]))
    rows = rows.withColumn("folded_root", folded)
    return rows.select(
        F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", "path", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def proof_digest(path: str = "path") -> Column:
    """Digest of all siblings on a path, from the leaf to the root and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)
