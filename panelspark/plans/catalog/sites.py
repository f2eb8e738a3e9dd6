"""SQL shared by the nearest-site queries."""

# Coordinates are fixed arithmetic on keys, so that both sides are spread over the same area.
POINT_SQL = """points AS (
  SELECT c_custkey AS point_id, 42 + (c_custkey * 37 % 1000) / 100.0::DOUBLE AS lat,
         -95 + (c_custkey * 53 % 2000) / 100.0::DOUBLE AS lon FROM customer),
sites AS (
  SELECT s_suppkey AS ord, s_suppkey AS site_id, n_name AS region, 42 + (s_suppkey * 41 % 1000) / 100.0::DOUBLE AS lat,
         -95 + (s_suppkey * 59 % 2000) / 100.0::DOUBLE AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

HAVERSINE_SQL = """2 * 6371.0 * asin(sqrt(least(1.0,
  pow(sin((radians(s.lat) - radians(p.lat)) / 2), 2)
  + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(p.lon)) / 2), 2))))"""

NEAREST_SQL = f"""{POINT_SQL},
place AS (SELECT DISTINCT lat, lon FROM points),
pair AS (
  SELECT p.lat, p.lon, s.ord, s.site_id, s.region, ROUND({HAVERSINE_SQL}, 9) AS km FROM place p CROSS JOIN sites s),
best AS (
  SELECT lat, lon, km, site_id, region FROM pair
  QUALIFY ROW_NUMBER() OVER (PARTITION BY lat, lon ORDER BY km, ord) = 1),
nearest AS (
  SELECT p.point_id, p.lat, p.lon, CASE WHEN km <= 75 THEN site_id END AS nearest_site_id,
         CASE WHEN km <= 75 THEN region END AS assigned_region, ROUND(km, 6) AS distance_km,
         km <= 75 AS within_threshold
  FROM points p JOIN best b ON p.lat = b.lat AND p.lon = b.lon)"""
