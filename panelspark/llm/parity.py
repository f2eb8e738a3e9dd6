"""N-gram Jaccard join by parity sketches.

Every token of a set flips one bit of the set's sketch, so that two sketches differ in at most as many bits as the sets do
in tokens. Sets of one size band that are similar enough differ in at most d tokens; a sketch cut into more than d parts
then has an equal part in both, and sets meet on equal parts. Candidates are held against the distance of folded sketches
and confirmed on the whole sets.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.graph import components
from panelspark.llm.textkit import mix64, shingles, slices, text_bytes, word_hashes
from panelspark.session import materialise

FAMILIES = 4  # ways of cutting a sketch; a later one is for sets with too many empty parts in all earlier ones
_WIDTH = 140  # per cent from the least to the most of a band's smaller sets
_FOLD, _SHORT = 32, 8  # 64-bit words of a folded sketch; the sketch of fewer than _MANY tokens is folded further
_MANY = 512
_FILTER_BITS = 23  # a table of 2 ** 23 bits keeps most texts that are not wanted out of a shuffle
_SLICE = 512  # pairs with the same second set that share one copy of it
_SALT = mix64(np.arange(1, FAMILIES + 1, dtype=np.uint64) << np.uint64(32))


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> list[tuple[int, int, int, int]]:
    """(least size, most size, d, parts) of each band, up to one that holds ``largest``.

    A band is named by its smaller sets: they and all larger ones that can be similar to one of them are in it. Similar
    sets in it differ in at most d tokens. Bands in which only equal sets are similar are left out.
    """
    out, low = [], 1
    while low <= largest:
        after = max(low + 1, low * _WIDTH // 100)
        top = (after - 1) * 100 // percent
        d = (100 - percent) * (after - 1 + top) // (100 + percent)
        if d:
            out.append((low, top, d, d + 2 + d // 8))
        low = after
    return out


def part_keys(items: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the parts of a set's sketches, for each band it is in; ``items`` are sorted token hashes.

    The high half of a hash says which part a token belongs to, the low half which bit of it. A key names the band, the
    family, the part and the bits that are set. A set with at most parts - d - 1 empty parts has a token in one of the parts
    that a similar set has in common, so that it may leave out the empty ones. Otherwise it gives the parts of a
    further family as well, and in the last one its empty parts too: of two similar sets both come to the first family in
    which one of them has few empty parts, or both give all parts of the last.
    """
    keys = []
    for low, top, d, parts in bands(percent, 1 << max(4, int(len(items)).bit_length())):
        if not low <= len(items) <= top:
            continue
        for family in range(FAMILIES):
            tokens = items if family == 0 else np.sort(mix64(items + _SALT[family]))
            edges = ((np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts)
            ends = np.searchsorted(tokens, edges[:-1] << np.uint64(32))
            filled = np.flatnonzero(np.diff(np.append(ends, len(tokens))))
            bits = mix64(tokens & np.uint64(0xFFFFFFFF))
            sums = np.zeros(parts, np.uint64)
            sums[filled] = np.bitwise_xor.reduceat(bits, ends[filled])
            few = parts - len(filled) <= parts - d - 1
            given = filled if few or family < FAMILIES - 1 else np.arange(parts)
            name = np.uint64(low << 3 | family)
            keys.append(mix64(sums[given] + mix64(mix64(given.astype(np.uint64)) + name)))
            if few:
                break
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def folded(items: np.ndarray) -> np.ndarray:
    """Sketch of a few words: whether an odd number of tokens falls on a bit."""
    size = 64 * (_FOLD if len(items) >= _MANY else _SHORT)
    at = (items >> np.uint64(13)) % np.uint64(size)
    odd = np.bincount(at.astype(np.intp), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def long_sketch(items: np.ndarray) -> bytes:
    """The set's size and a sketch of 2 to 4 bits per token: near the limit it still tells how far two sets are apart."""
    size = 1 << max(9, (2 * len(items)).bit_length())
    odd = np.bincount(((items >> np.uint64(13)) % np.uint64(size)).astype(np.intp), minlength=size) & 1
    return np.int64(len(items)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def apart_at_least(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the tokens in which two sets differ, from long sketches, the longer one folded to the other's length."""
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_name(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    for batch in slices(batches, "text"):
        yield batch, shingles(*word_hashes(*text_bytes(batch.column("text"))), words)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))


def sketched(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(row, id, t1, t2, n_shingles, name, sketch, keys) of each row.

    t1 and t2 are hashes of the text; without words there is no name. The sketch is folded.
    """
    first = ["row", "id", "t1", "t2"]

    def run(batches):
        for batch, sets in _sets(batches, words):
            sizes, names, sketches, keys = [], [], [], []
            for items in sets:
                sizes.append(len(items))
                names.append(set_name(items) if len(items) else None)
                sketches.append(folded(items) if len(items) else np.zeros(0, np.int64))
                keys.append(part_keys(items, percent))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in first], pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                _lists(sketches), _lists(keys)], [*first, "n_shingles", "name", "sketch", "keys"])

    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType),
        T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("name", T.BinaryType()),
        T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType())),
    ])
    named = _named(docs, id_col, text_col)
    return named.select(F.monotonically_increasing_id().alias("row"), "*").mapInArrow(run, schema)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def _marked(rows: DataFrame, hash_col: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with whether ``wanted`` may hold their hash: so for all that it holds, and few others while it is not huge.

    The bits sent to every task are 2 ** (_FILTER_BITS - 6) words at most, whatever the size of the tables.
    """
    place = F.col(hash_col).bitwiseAND(F.lit((1 << _FILTER_BITS) - 1))
    word, bit = F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, int(({hash_col} & {(1 << _FILTER_BITS) - 1}) & 63))")
    bits = wanted.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    joined = rows.withColumns({"word": F.shiftright(place, 6), "bit": bit}).join(F.broadcast(bits), "word", "left")
    return joined.withColumn("marked", F.expr("coalesce(bits & bit <> 0, false)")).drop("word", "bit", "bits")


def possible(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of which ``wanted`` may hold the hash t1: all that it holds, and few others."""
    return _marked(texts, "t1", wanted).where("marked").drop("marked")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of (row, ...) whose row is not in ``gone`` (row). Only those that a table of bits marks are shuffled."""
    place = F.xxhash64("row")
    marked = _marked(rows.withColumn("place", place), "place", gone.select(place.alias("place"))).drop("place")
    left = marked.where("marked").join(gone, "row", "left_anti")
    return marked.where("not marked").union(left.select(*marked.columns)).drop("marked")


def whole_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, items, sketch) of each row of (node, text), with the long sketch."""

    def run(batches):
        for batch, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *_binaries(sets)], ["node", "items", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "node long, items binary, sketch binary")


def _binaries(sets: Iterator[np.ndarray]) -> list[pa.Array]:
    both = [(s.tobytes(), long_sketch(s)) for s in sets]
    return [pa.array([v[i] for v in both], pa.binary()) for i in (0, 1)]


def _sizes_fit(percent: int, a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def may_link(percent: int) -> Column:
    """False only if sizes or folded sketches rule out that two sets, u and v, are similar enough.

    Long sketches are compared whole, and folded to the length of short ones.
    """
    apart = reduce(operator.add, [F.bit_count(F.col(f"u.s{i}").bitwiseXOR(F.col(f"v.s{i}"))) for i in range(_SHORT)])
    words = F.zip_with("u.sketch", "v.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    wide = F.aggregate(words, F.lit(0), lambda total, n: total + n)  # null unless both sketches are long
    most = (100 - percent) * (F.col("u.size") + F.col("v.size"))
    return (_sizes_fit(percent, F.col("u.size"), F.col("v.size")) & ((100 + percent) * apart <= most)
            & F.coalesce((100 + percent) * wide <= most, F.lit(True)))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their whole sets.

    Long sketches rule pairs out first, which are sent at a small part of the sets' size. A set that is the second of many pairs
    is sent once for every ``_SLICE`` of them, so that its pairs are many tasks.
    """
    often = materialise(pairs.groupBy("b").agg(F.ceil(F.count("*") / _SLICE).alias("slices")), "often")
    many = often.where("slices > 1")
    cut = materialise(pairs.join(many, "b", "left").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.coalesce("slices", F.lit(1).cast("long"))).alias("slice")), "cut")

    def with_both(near: DataFrame, column: str) -> DataFrame:
        of_a, of_b = (sets.select(F.col("node").alias(c), F.col(column).alias(v)) for c, v in (("a", "x"), ("b", "y")))
        wanted = near.groupBy("b", "slice").count()
        seconds = of_b.join(wanted, "b").select("b", "slice", "y")
        return near.join(of_a, "a").join(seconds, ["b", "slice"]).select("a", "b", "slice", "x", "y")

    def run(batches, test):
        for batch in batches:
            kept = [test(*(v.as_buffer() for v in pair)) for pair in zip(batch.column("x"), batch.column("y"))]
            columns = [batch.column(c) for c in ("a", "b", "slice")]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "slice"]).filter(pa.array(kept, pa.bool_()))

    def possibly(x, y):
        total = sum(int(np.frombuffer(v, np.int64, 1)[0]) for v in (x, y))
        return (100 + percent) * apart_at_least(*(np.frombuffer(v, np.uint8, offset=8) for v in (x, y))) <= (100 - percent) * total

    def surely(x, y):
        x, y = (np.frombuffer(v, np.uint64) for v in (x, y))
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    schema = "a long, b long, slice long"
    near = materialise(with_both(cut, "sketch").mapInArrow(lambda batches: run(batches, possibly), schema), "possible")
    return with_both(near, "items").mapInArrow(lambda batches: run(batches, surely), schema).select("a", "b")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80,
) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    A set holds the distinct runs of ``words`` words (A-Z lowered); a shorter text is one shingle. Rows are linked
    where 100 * intersection >= percent * union, and component_id is the smallest id reachable. No link is missed: sets
    that are similar enough surely share a key, and a pair that shares one is left out only if it is already connected or if
    sizes or sketches rule it out.

    Equal sets are one node, and keys of the same nodes one key. A key's nodes are compared with the least of them first, where
    they are not yet connected with the one of most company, and where they still are not with each other. An empty or null text
    is alone. A null id names a component only if all its ids are null (component_id null). Repeated rows share their component;
    other columns are not read; an empty table gives an empty one.
    """
    found = materialise(sketched(docs, id_col, text_col, words, percent), "sketches")
    copies = found.where("name is not null").groupBy("name", "id", "t1", "t2").agg(
        F.min("row").alias("row"), F.count("*").alias("copies"))
    nodes = materialise(copies.groupBy("name").agg(
        F.min(F.struct("row", "id", "t1", "t2", "copies")).alias("of"), F.min("id").alias("first_id"), F.sum("copies").alias("n"),
    ).select("name", F.col("of.row").alias("node"), "first_id", "n", F.struct("of.id", "of.t1", "of.t2", "of.copies").alias("of")), "nodes")
    several = nodes.where("n > 1").select("name", "node")
    copied = materialise(found.select("name", "row").join(several, "name").where("row <> node").select("row"), "copied")
    keys = without(found.where("size(keys) > 0").select("row", "keys"), copied)
    keys = keys.select(F.explode("keys").alias("key"), F.col("row").alias("node"))
    of_key = W.partitionBy("key")
    met = keys.withColumns({"size": F.count("*").over(of_key), "leader": F.min("node").over(of_key)}).where("size > 1")
    met = met.withColumn("held", F.bit_xor(F.xxhash64("node")).over(of_key))
    # Keys with the same nodes are one: similar sets share many. Should other keys get the same hash, their nodes meet too.
    stars = materialise(met.groupBy(F.xxhash64("held", "size").alias("key"), "node").agg(
        F.min("leader").alias("leader"), F.max("size").alias("size"), F.count("*").alias("keys")), "stars")
    company = stars.groupBy("node").agg(F.sum(F.expr("size * keys")).alias("company"))
    involved = stars.select("node").distinct()  # holds the leaders too
    sketches = found.select(F.col("row").alias("node"), F.col("n_shingles").alias("size"), "sketch").join(
        involved, "node", "left_semi")
    short = [reduce(Column.bitwiseXOR, [F.coalesce(F.get("sketch", F.lit(j)), F.lit(0).cast("long")) for j in range(i, _FOLD, _SHORT)])
             .alias(f"s{i}") for i in range(_SHORT)]
    sketches = materialise(sketches.select(
        "node", "size", *short, F.when(F.size("sketch") == _FOLD, F.col("sketch")).alias("sketch")), "folded")
    members, stars = stars, stars.where("node <> leader")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = materialise(nodes.join(ends, "node").select("node", "of.*"), "wanted")
        texts = possible(_named(docs, id_col, text_col), wanted).alias("d")
        same = (F.col("d.t1") == F.col("w.t1")) & (F.col("d.t2") == F.col("w.t2")) & F.col("d.id").eqNullSafe(F.col("w.id"))
        single, several = (texts.join(wanted.where(c).alias("w"), same).select("node", "text") for c in ("copies = 1", "copies > 1"))
        return materialise(whole_sets(single.union(several.dropDuplicates(["node"])), words), "sets")

    def linkable(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b, ...) whose sketches allow a link, written."""
        of_a, of_b = sketches.alias("u"), sketches.alias("v")
        kept = pairs.alias("p").join(of_a, F.col("p.a") == F.col("u.node")).join(of_b, F.col("p.b") == F.col("v.node"))
        return materialise(kept.where(may_link(percent)).select("p.*"), label)

    def still_open(roots: DataFrame) -> DataFrame:
        """(key, node, root) of the keys whose nodes are in several components."""
        named = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        return named.withColumns({"low": F.min("root").over(of_key), "high": F.max("root").over(of_key)}).where(
            "low < high").select("key", "node", "root")

    # Each node with the leader it shares most keys with first: that settles most groups with one pair per node.
    near = linkable(stars.groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.sum("keys").alias("shared")), "near")
    sets = sets_of(near)
    top = near.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    links = materialise(confirmed(top, sets, percent), "links")
    rest = near.join(links.toDF("a", "hub"), "a", "left").join(links.toDF("b", "of"), "b", "left").where(
        "coalesce(hub, a) <> coalesce(of, b)").select("a", "b").join(top, ["a", "b"], "left_anti")
    links = materialise(links.union(confirmed(rest, sets, percent)), "links")
    roots = materialise(components(links), "roots")

    # Then each node of a key in several components with the one of most company: likely the text that the others vary.
    parted = still_open(roots).join(company, "node")
    second = parted.groupBy("key").agg(F.max(F.struct("company", "node", "root")).alias("top"))
    second = parted.join(second, "key").where("root <> top.root").select(
        F.col("node").alias("a"), F.col("top.node").alias("b")).distinct()
    second = linkable(second.join(near.select("a", "b"), ["a", "b"], "left_anti"), "second")
    if not second.isEmpty():
        links = materialise(links.union(confirmed(second, sets_of(second), percent)), "links")
        roots = materialise(components(links), "roots")

    # What is still apart meets within each key if the sketches allow it.
    open_ = materialise(still_open(roots).join(sketches, "node"), "open")
    apart = (F.col("u.key") == F.col("v.key")) & (F.col("u.root") < F.col("v.root")) & may_link(percent)
    pairs = materialise(open_.alias("u").join(open_.alias("v"), apart).select(
        F.col("u.node").alias("a"), F.col("v.node").alias("b")).distinct(), "pairs")
    if not pairs.isEmpty():
        more = materialise(confirmed(pairs, sets_of(pairs), percent), "more")
        roots = components(links.union(more))

    named = nodes.drop("of").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("of")).where("of > 1")
    grouped = named.join(least, "root").select("name", "component_id")
    return found.select("id", "n_shingles", "name").join(grouped, "name", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
