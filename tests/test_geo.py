import numpy as np
import pytest
from pyspark.sql import functions as F

from panel_helpers import rows
from panelspark.operators import geo

POINT, SITE = "point_id long, lat double, lon double", "ord long, site_id string, region string, lat double, lon double"


def brute(points, sites):
    out = {}
    for pid, lat, lon in points:
        best = None
        for o, sid, region, slat, slon in sites:
            a, b, c, d = map(np.radians, (lat, lon, slat, slon))
            h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
            km = round(float(2 * 6371.0 * np.arcsin(min(1.0, np.sqrt(h)))), 9)
            if best is None or (km, o) < best[:2]:
                best = (km, o, sid, region)
        out[pid] = best
    return out


@pytest.mark.parametrize("seed,spread", [(1, "globe"), (2, "clustered"), (3, "dateline")])
def test_cells_agree_with_brute_force(spark, seed, spread, monkeypatch):
    monkeypatch.setattr(geo, "LEAF_SITES", 4)
    rng = np.random.default_rng(seed)

    def place(n):
        if spread == "globe":
            return np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
        if spread == "clustered":  # a third of all places in one small town
            town = rng.random(n) < 0.34
            return np.where(town, rng.normal(43.7, 0.01, n), rng.uniform(40, 60, n)), np.where(
                town, rng.normal(-79.4, 0.01, n), rng.uniform(-95, -74, n))
        lon = 180 + rng.normal(0, 3, n)
        return rng.uniform(60, 90, n), (lon + 180) % 360 - 180

    sites = [(i, f"s{i}", f"r{i % 5}", *map(float, p)) for i, p in enumerate(zip(*place(150)))]
    points = [(i, *map(float, p)) for i, p in enumerate(zip(*place(120)))]
    points += [(200, 90.0, 0.0), (201, -90.0, 10.0), (202, 0.0, 180.0), (203, 0.0, -180.0), (204, -45.0, 90.0)]
    got = geo.nearest_site(spark.createDataFrame(points, POINT), spark.createDataFrame(sites, SITE), 75.0).collect()
    want = brute(points, sites)
    assert len(got) == len(points)
    for r in got:
        km, _, sid, region = want[r["point_id"]]
        assert r["distance_km"] == pytest.approx(km, abs=1e-6)
        assert r["within_threshold"] == (km <= 75)
        assert (r["nearest_site_id"], r["assigned_region"]) == ((sid, region) if km <= 75 else (None, None))


def test_ties_threshold_and_missing_coordinates(spark):
    sites = spark.createDataFrame(
        [(2, "east", "E", 0.0, 1.0), (1, "west", "W", 0.0, -1.0), (3, "same", "S", 0.0, -1.0), (4, "none", None, 0.0, 0.0)], SITE
    )
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 0.0, 0.0)], POINT)
    km = 6371.0 * np.pi / 180
    got = geo.nearest_site(points, sites, threshold_km=round(km, 9))
    assert [(r["point_id"], r["nearest_site_id"], r["within_threshold"]) for r in got.orderBy("point_id").collect()] == [
        (1, "west", True), (3, "west", True)
    ]
    assert geo.nearest_site(points, sites, threshold_km=km - 1e-3).where("within_threshold").count() == 0
    assert rows(geo.assigned_totals(got)) == [(2, 2, 0)]
    assert rows(geo.assigned_counts(got)) == [("W", 2)]
    assert [r["point_id"] for r in geo.farthest(got, 1).collect()] == [1]
    with pytest.raises(ValueError):
        geo.nearest_site(points, sites.where("ord = 4"))


def test_station_coordinates(spark):
    df = spark.createDataFrame([("7", "43.5", "-79"), ("7", "43.5", "-79"), ("8", "x", "-80")], "station_id string, lat string, lon string")
    got = geo.station_coordinates(df.withColumnsRenamed({"lat": "latitude_y", "lon": "longitude_x"}), "latitude_y", "longitude_x", "station_id", [])
    assert rows(got) == [("7", 43.5, -79.0)]
    made = geo.station_coordinates(df.select(F.col("lat").alias("a"), F.col("lon").alias("b")), "a", "b", None, [])
    assert rows(made) == [("lat43.5_lon-79.0", 43.5, -79.0)]


def test_station_coordinates_keep_the_first(spark):
    df = spark.createDataFrame([(2, "7", 44.0, -79.0), (1, "7", 50.0, -80.0)], "row long, station_id string, lat double, lon double")
    got = geo.station_coordinates(df, "lat", "lon", "station_id", ["row"])
    assert rows(got) == [("7", 50.0, -80.0)]


def test_far_points_visit_few_leaves(spark):
    rng = np.random.default_rng(5)
    sites = [(i, f"s{i}", "r", *map(float, p)) for i, p in enumerate(zip(rng.normal(47, 1, 4000), rng.normal(-85, 1, 4000)))]
    unique = geo._unit(spark.createDataFrame(sites, SITE))
    spots = [(47.0, -85.0), (10.0, -85.0), (0.0, 20.0), (-45.0, 90.0), (80.0, 100.0), (-47.0, 95.0)]
    spots = geo._unit(spark.createDataFrame(spots, "lat double, lon double"))
    leaves = geo._candidates(spots, unique).groupBy("lat", "lon").count().collect()
    assert len(leaves) == 6 and max(r["count"] for r in leaves) <= 12


def test_one_plan_for_few_sites(spark):
    sites = spark.createDataFrame([(1, "a", "A", 1.0, 2.0)], SITE)
    points = spark.createDataFrame([(1, 0.0, 0.0)], POINT)
    plan = geo.nearest_site(points, sites)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert geo.nearest_site(points.limit(0), sites).count() == 0
