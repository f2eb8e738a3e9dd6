"""Nearest-site join on great-circle distance.

Only distinct coordinates take part. The sites are put into a tree of cells of the cube around the globe, so that neither
the poles nor the date line are special. All points go down the tree together, one equi-join per level, and keep of
each level only the cells whose box is no farther than the best site known by then; the few sites of the leaves
that remain are compared. No pair of far-apart places is ever formed, and one path serves any number of sites.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.scalars import haversine_km, synthetic_id, to_number
from panelspark.operators.dedupe import first_per_key
from panelspark.session import materialise, spread

LEAF_SITES = 32  # a cell with more sites is divided
_STEP = 2  # halvings per axis from level to level: up to 64 parts, of which the globe meets 16 or so
_DEEPEST = 20  # halvings of the last level, whose cells are some 12 metres wide
_SLACK = 1e-7  # radians, well above what rounding does to angles; it only adds candidates


def _unit(df: DataFrame) -> DataFrame:
    """Add x, y, z on the unit globe."""
    lat, lon = F.radians("lat"), F.radians("lon")
    return df.withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})


def _cell(depth: int) -> Column:
    """Number of the cube cell after ``depth`` halvings of every axis."""
    side = 1 << depth
    parts = [F.least(F.floor((F.col(c) + 1) / 2 * side), F.lit(side - 1)) for c in "xyz"]
    return F.shiftleft(parts[0], 2 * depth).bitwiseOR(F.shiftleft(parts[1], depth)).bitwiseOR(parts[2])


def _cells(sites: DataFrame, depth: int) -> DataFrame:
    """One row per cell that holds sites: its parent, their number, the box around them and one of them."""
    box = [f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))]
    parent = _cell(max(depth - _STEP, 0))
    return sites.groupBy(_cell(depth).alias("cell"), parent.alias("parent")).agg(
        F.count("*").alias("n"), *box, F.min(F.struct("x", "y", "z")).alias("one"))


def _reach(prefix: str) -> dict[str, Column]:
    """Angles from a point to a cell: at least ``near`` to any of its sites, ``best`` to its sample site.

    The box alone bounds well from nearby, the distance to the sample less the cell's extent from the other side of
    the globe, where chords hardly differ.
    """
    def norm(part) -> Column:
        return F.sqrt(sum((part(c) ** 2 for c in "xyz"), F.lit(0.0)))

    def angle(chord: Column) -> Column:
        return 2 * F.asin(F.least(chord / 2, F.lit(1.0)))

    low, high = ({c: F.col(f"{prefix}{end}_{c}") for c in "xyz"} for end in ("low", "high"))
    one = {c: F.col(f"{prefix}one")[c] for c in "xyz"}
    best = 2 * F.atan2(norm(lambda c: F.col(c) - one[c]), norm(lambda c: F.col(c) + one[c]))
    box = angle(norm(lambda c: F.greatest(low[c] - F.col(c), F.col(c) - high[c], F.lit(0.0))))
    extent = angle(norm(lambda c: F.greatest(one[c] - low[c], high[c] - one[c])))
    return {"near": F.greatest(box, best - extent), "best": best}


def _candidates(spots: DataFrame, sites: DataFrame) -> DataFrame:
    """(lat, lon, depth, cell) of the leaves that can hold the nearest site of each spot."""
    spot = W.partitionBy("lat", "lon")
    depth = 1
    level = materialise(_cells(sites, depth), "cells")
    roots = [r["cell"] for r in level.select("cell").orderBy("cell").collect()]  # 8 at most
    if not roots:
        raise ValueError("no site with region and coordinates")
    rows = spots.withColumn("cell", F.explode(F.array(*[F.lit(c) for c in roots])))
    rows = rows.join(level.drop("parent"), "cell").withColumns({"depth": F.lit(depth), **_reach("")})

    def pruned(df: DataFrame) -> DataFrame:
        narrow = df.select("lat", "lon", "x", "y", "z", "depth", "cell", "n", "near", "best")
        return narrow.withColumn("best", F.min("best").over(spot)).where(F.col("near") <= F.col("best") + _SLACK)

    rows = pruned(rows)
    while depth < _DEEPEST and level.where(F.col("n") > LEAF_SITES).count():
        depth = min(depth + _STEP, _DEEPEST)
        level = materialise(_cells(sites, depth), "cells")
        parts = level.toDF(*[f"part_{c}" for c in level.columns])
        inner = (F.col("n") > LEAF_SITES) & (F.col("cell") == F.col("part_parent"))
        down = rows.join(parts, inner, "left")
        leaf = F.col("part_cell").isNull()
        new = _reach("part_")
        rows = pruned(down.select(
            "lat", "lon", "x", "y", "z", F.when(leaf, F.col("depth")).otherwise(depth).alias("depth"),
            F.coalesce("part_cell", "cell").alias("cell"), F.coalesce("part_n", "n").alias("n"),
            F.when(leaf, F.col("near")).otherwise(new["near"]).alias("near"),
            F.least("best", new["best"]).alias("best"),
        ))
    return rows.select("lat", "lon", "depth", "cell")


def nearest_site(points: DataFrame, sites: DataFrame, threshold_km: float = 75.0) -> DataFrame:
    """Nearest site of every point, however far; site and region only within the threshold.

    ``points`` has (point_id, lat, lon), ``sites`` (ord, site_id, region, lat, lon) with ``ord`` the source
    order. Of sites equally near, to within a micrometre, the first in source order wins.
    """
    places = points.where("point_id is not null and lat is not null and lon is not null")
    spots = _unit(spread(places.select("lat", "lon").distinct(), F.xxhash64("lat", "lon")))
    usable = sites.where("region is not null and lat is not null and lon is not null")
    row = F.struct("ord", "site_id", "region")
    unique = usable.groupBy("lat", "lon").agg(F.min_by(row, "ord").alias("_s")).select("_s.*", "lat", "lon")
    unique = materialise(_unit(unique), "sites")
    leaves = materialise(_candidates(spots, unique), "leaves")

    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon")), 9)
    placed = unique.withColumnsRenamed({"lat": "site_lat", "lon": "site_lon"})
    depths = [r["depth"] for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # one per level
    near = None
    for depth in depths:
        at_depth = placed.select(_cell(depth).alias("cell"), "ord", "site_id", "region", "site_lat", "site_lon")
        part = leaves.where(F.col("depth") == depth).join(at_depth, "cell").select(
            "lat", "lon", F.struct(km.alias("km"), "ord", "site_id", "region").alias("_s"))
        near = part if near is None else near.union(part)
    if near is None:
        near = places.select("lat", "lon").limit(0).withColumn(
            "_s", F.struct(F.lit(0.0).alias("km"), *[F.lit(None).cast(sites.schema[c].dataType).alias(c) for c in ("ord", "site_id", "region")]))
    best = near.groupBy("lat", "lon").agg(F.min("_s").alias("_b"))
    within = F.col("_b")["km"] <= threshold_km
    return places.join(best, ["lat", "lon"]).select(
        "point_id", "lat", "lon",
        F.when(within, F.col("_b")["site_id"]).alias("nearest_site_id"),
        F.when(within, F.col("_b")["region"]).alias("assigned_region"),
        F.col("_b")["km"].alias("distance_km"),
        within.alias("within_threshold"),
    )


def assigned_totals(nearest: DataFrame) -> DataFrame:
    return nearest.agg(
        F.count("*").alias("n_points"),
        F.count_if("within_threshold").alias("n_assigned"),
        F.count_if(~F.col("within_threshold")).alias("n_unassigned"),
    )


def assigned_counts(nearest: DataFrame, n: int = 10) -> DataFrame:
    """Regions with the most assigned points."""
    assigned = nearest.where(F.col("within_threshold") & F.col("assigned_region").isNotNull())
    return (
        assigned.groupBy("assigned_region").agg(F.count("*").alias("n_points"))
        .orderBy(F.desc("n_points"), "assigned_region").limit(n)
    )


def farthest(nearest: DataFrame, n: int = 10) -> DataFrame:
    return nearest.orderBy(F.desc("distance_km"), "point_id").limit(n).select(
        "point_id", "assigned_region", "distance_km", "within_threshold"
    )


def station_coordinates(
    df: DataFrame, lat: str, lon: str, station: str | None, order: Sequence[Column | str]
) -> DataFrame:
    """The first coordinate pair per station in ``order``, the source's; without a station column, every pair with an
    id made from it."""
    placed = df.withColumns({"lat": to_number(lat), "lon": to_number(lon)}).dropna(subset=["lat", "lon"])
    if station is None:
        unique = placed.select("lat", "lon").distinct()
        return unique.select(synthetic_id("lat", "lon").alias("weather_station_id"), "lat", "lon")
    ranks = {f"_order{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(order)}
    ids = placed.select(F.col(station).alias("weather_station_id"), "lat", "lon", *[c.alias(n) for n, c in ranks.items()])
    return first_per_key(ids, ["weather_station_id"], list(ranks)).drop(*ranks)
