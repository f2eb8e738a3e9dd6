"""Near-duplicate documents by circulant MinHash, with every link confirmed on the whole shingle sets.

Two permutations of a hashed universe make all signature coordinates: the first scatters a set's shingles, the
second is read at the scattered places, shifted circularly by one more place for each coordinate. Bands of
coordinates give candidate documents; a candidate pair becomes a link only if its exact Jaccard similarity
reaches the threshold, and links are closed to components.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.scalars import quoted
from panelspark.llm.graph import components
from panelspark.llm.textkit import mix64, shingles, slices, text_bytes, word_hashes
from panelspark.session import materialise

UNIVERSE_BITS = 20
_WORDS = 8  # 64-bit words of a bitmap of the items by which a set differs from another
_GATHER = 1 << 13  # shingles whose shifted permutation values are held at once


class Circulant:
    """Signature maker; the same seed gives the same two permutations in every task."""

    def __init__(self, coordinates: int, rows: int, seed: int):
        size = 1 << UNIVERSE_BITS
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(size).astype(np.uint32)
        ring = rng.permutation(size).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(
            np.concatenate([ring, ring[: coordinates - 1]]), coordinates)
        self.rows = rows
        self.salt = mix64(np.arange(1, coordinates // rows + 1, dtype=np.uint64))

    def signature(self, items: np.ndarray) -> np.ndarray:
        places = self.scatter[(items >> np.uint64(64 - UNIVERSE_BITS)).astype(np.intp)]
        parts = [self.windows[places[i : i + _GATHER]].min(axis=0) for i in range(0, len(places), _GATHER)]
        return np.minimum.reduce(parts)

    def bands(self, items: np.ndarray) -> np.ndarray:
        table = self.signature(items).astype(np.uint64).reshape(-1, self.rows)
        key = self.salt.copy()
        for k in range(self.rows):
            key = mix64(key + table[:, k])
        return key.view(np.int64)


def set_id(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, text: str, words: int) -> Iterator[np.ndarray]:
    data, starts = text_bytes(batch.column(text))
    return shingles(*word_hashes(data, starts), words)


def signatures(
    docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, seed: int
) -> DataFrame:
    """Per document: a hash of its text, number of shingles, identifier of the set (null if empty), band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Circulant(bands * rows, rows, seed)
        for batch in slices(batches, "text"):
            sizes, ids, keys = [], [], []
            for items in _sets(batch, "text", words):
                sizes.append(len(items))
                ids.append(set_id(items) if len(items) else None)
                keys.append(maker.bands(items) if len(items) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("tag"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
            ], ["id", "tag", "n_shingles", "set_id", "bands"])

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("tag", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_id", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, schema)


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(set_id, items): the sorted shingles of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [i for i in _sets(batch, "text", words) if len(i)]
            yield pa.RecordBatch.from_arrays([
                pa.array([set_id(i) for i in found], pa.binary()), pa.array([i.tobytes() for i in found], pa.binary()),
            ], ["set_id", "items"])

    return texts.select("text").mapInArrow(run, "set_id binary, items binary")


def _bitmap(items: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * _WORDS, bool)
    bits[(items % np.uint64(64 * _WORDS)).astype(np.intp)] = True
    return np.packbits(bits).view(np.int64)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with linked: 100 * intersection >= percent * union of their whole sets.

    Besides, n is the size of b; plus counts a's items that b lacks, minus those of b that a lacks, and p0, p1, ...
    and m0, m1, ... are bitmaps of these.
    """
    names = ["n", "plus", "minus", *[f"{k}{i}" for k in "pm" for i in range(_WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, rows = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = y[at] == x
                more, less = x[~shared], np.delete(y, at[shared])
                linked.append(100 * (len(x) - len(more)) >= percent * (len(y) + len(more)))
                rows.append([len(y), len(more), len(less), *_bitmap(more), *_bitmap(less)])
            columns = np.array(rows, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), *map(pa.array, columns)],
                ["a", "b", "linked", *names])

    return (
        pairs.join(sets.select(F.col("set_id").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("set_id").alias("b"), F.col("items").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(run, "a binary, b binary, linked boolean, " + ", ".join(f"{n} long" for n in names))
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return _compared(pairs, sets, percent).where("linked").select("a", "b")


def _can_link(percent: int) -> Column:
    """False only if two nodes, u and v, both compared with the same hub, cannot be similar enough.

    Of the hub's items at most those are common that neither lacks, of the others those with common bits in both bitmaps
    and, where several items share a bit, these.
    """
    def common(kind: str) -> Column:
        bits = [F.bit_count(F.col(f"u.{kind}{i}").bitwiseAND(F.col(f"v.{kind}{i}"))).cast("long") for i in range(_WORDS)]
        return reduce(operator.add, bits, F.least(f"u.{kind}_spare", f"v.{kind}_spare"))

    least = percent * (F.col("u.size") + F.col("v.size"))
    inner = F.col("u.n") - F.col("u.minus") - F.col("v.minus") + common("m") + common("p")
    return (
        ((100 + percent) * F.least("u.size", "v.size") >= least)
        & ((F.col("u.hub") != F.col("v.hub")) | ((100 + percent) * inner >= least))
    )


def _described(hubs: DataFrame) -> DataFrame:
    """Compared pairs as (set_id, hub) with set_id's size and, per bitmap, the items that share a bit with another one."""
    def spare(kind: str, count: str) -> Column:
        return reduce(operator.sub, [F.bit_count(f"{kind}{i}").cast("long") for i in range(_WORDS)], F.col(count))

    return hubs.drop("linked").withColumns({
        "size": F.col("n") + F.col("plus") - F.col("minus"), "p_spare": spare("p", "plus"), "m_spare": spare("m", "minus"),
    }).withColumnsRenamed({"a": "set_id", "b": "hub"})


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 75,
    bands: int = 40, rows: int = 4, seed: int = 7,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    A set holds the distinct runs of ``words`` words (A-Z lowered); a shorter text is one shingle. Rows are
    linked where 100 * intersection >= percent * union; component_id is the smallest id reachable and kept says
    whether that is the row's own. Two sets at the threshold share no band with probability
    (1 - (percent / 100) ** rows) ** bands, 3e-7 by default.

    Equal sets are one node from the start, so copies cost nothing more. In each band bucket every node is compared
    with the bucket's leader. After these links are closed, nodes of one bucket that are still in different components
    are compared with each other, unless how both differ from a common leader rules a link out. A null id is never a component's name unless all its ids are null
    (component_id null, kept true); an empty or null text is alone; repeated rows share their component; other
    columns are not read; an empty table gives an empty one.
    """
    found = _components(docs, id_col, text_col, words, percent, bands, rows, seed)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", _kept().alias("kept"))


def _kept() -> Column:
    return F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row of ``docs`` per component of ``near_duplicates``, with all its columns: the one with the least id.

    Texts without words are each their own component. Where ids repeat, one of a component's rows with the least id stays;
    of rows equal in id and text one stays, and without any id one of each text. Other columns may have any name.
    """
    given = dict(words=5, percent=75, bands=40, rows=4, seed=7) | parameters
    alone = F.when((F.col("n_shingles") == 0) | F.col("component_id").isNull(), F.col("tag")).alias("alone")
    chosen = _components(docs, id_col, text_col, **given).where(_kept()).groupBy("id", "component_id", alone).agg(
        F.min("tag").alias("tag"), F.count("*").alias("n"))
    chosen = materialise(chosen.select("id", "tag", "n"), "kept")
    same = F.col(f"d.{quoted(id_col)}").eqNullSafe(F.col("c.id")) & (F.xxhash64(f"d.{quoted(text_col)}") == F.col("c.tag"))
    single = docs.alias("d").join(chosen.where("n = 1").alias("c"), same, "left_semi")
    several = docs.alias("d").join(chosen.where("n > 1").alias("c"), same, "left_semi")
    return single.union(several.dropDuplicates([id_col, text_col]))


def _components(
    docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bands: int, rows: int, seed: int
) -> DataFrame:
    """(id, tag, n_shingles, component_id) for every row of ``docs``."""
    found = materialise(signatures(docs, id_col, text_col, words, bands, rows, seed), "signatures")
    nodes = materialise(
        found.where("set_id is not null").groupBy("set_id")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.first("bands").alias("bands")), "nodes")
    member = nodes.select("set_id", F.explode("bands").alias("band"))
    sizes = member.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    member = materialise(member.join(sizes, "band"), "members")
    # A bucket's leader is its node with most company over all bands: likely the text that the others vary.
    company = member.groupBy("set_id").agg(F.sum("size").alias("company"))
    leaders = member.join(company, "set_id").groupBy("band").agg(
        F.max(F.struct("company", "set_id")).alias("top")).select("band", F.col("top.set_id").alias("leader"))
    buckets = materialise(member.select("band", "set_id").join(leaders, "band"), "buckets")

    involved = buckets.select("set_id").distinct()  # holds the leaders too
    wanted = found.join(involved, "set_id", "left_semi").select(F.col("id").alias(id_col)).distinct()
    by_id = F.col(f"d.{id_col}").eqNullSafe(F.col(f"w.{id_col}"))
    texts = docs.select(id_col, F.col(text_col).alias("text")).alias("d").join(wanted.alias("w"), by_id, "left_semi")
    sets = materialise(_shingle_sets(texts, words).dropDuplicates(["set_id"]), "sets")

    # Each node with the leader of most company in its buckets first: that settles most groups with one pair per node.
    stars = buckets.where("leader <> set_id")
    first = stars.join(company.toDF("leader", "company"), "leader").groupBy(F.col("set_id").alias("a")).agg(
        F.max(F.struct("company", "leader")).alias("top")).select("a", F.col("top.leader").alias("b"))
    hubs = materialise(_compared(first, sets, percent), "hubs")
    links = hubs.where("linked").select("a", "b")

    # Then with the other leaders, unless both already have the same linked hub.
    mine, other = links.toDF("a", "ra"), links.toDF("b", "rb")
    rest = stars.select(F.col("set_id").alias("a"), F.col("leader").alias("b")).distinct().join(mine, "a", "left").join(
        other, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b").join(first, ["a", "b"], "left_anti")
    links = materialise(links.union(_confirmed(rest, sets, percent)), "links")
    label = components(links)

    # Buckets that still hold several components: nodes other than the leader meet, if their hubs do not rule it out.
    named = stars.join(label.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "band", "set_id", F.coalesce("root", "set_id").alias("root"))
    mixed = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = materialise(named.join(mixed.select("band"), "band").join(_described(hubs), "set_id"), "open")
    apart = (F.col("u.band") == F.col("v.band")) & (F.col("u.root") < F.col("v.root")) & _can_link(percent)
    meeting = open_.alias("u").join(open_.alias("v"), apart).select(
        F.col("u.set_id").alias("a"), F.col("v.set_id").alias("b")).distinct()
    more = materialise(_confirmed(meeting, sets, percent), "more")
    if not more.isEmpty():  # only the components that these links connect are closed again
        def renamed(pairs: DataFrame, end: str) -> DataFrame:
            roots = label.toDF(end, "_root")
            return pairs.join(roots, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")

        joined = components(renamed(renamed(more, "a"), "b")).toDF("_old", "_new")
        ends = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
        alone = ends.join(label, "node", "left_anti").withColumn("root", F.col("node"))
        every = label.union(alone).join(joined, F.col("root") == F.col("_old"), "left")
        label = every.select("node", F.coalesce("_new", "root").alias("root"))

    named = nodes.select("set_id", "first_id", "n").join(label.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.withColumn("root", F.coalesce("root", "set_id"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("size"))
    grouped = named.join(lowest.where("size > 1"), "root").select("set_id", "component_id")
    return (
        found.drop("bands").join(grouped, "set_id", "left")
        .select("id", "tag", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    )
