"""Queries on places. The tables hold no coordinates: they come from integer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import geo
from siltstone.operators import merge, places
from siltstone.plans.base import registry
from siltstone.sources.tables import table

QUERIES, ORACLES, query = registry()
AT = (12.5, 100.25)


def _listings(spark, sf):
    lat = F.pmod(F.col("c_custkey") * 7919, F.lit(18000)) / 100.0 - 90
    lon = F.pmod(F.col("c_custkey") * 104729, F.lit(36000)) / 100.0 - 180
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_nationkey", "c_mktsegment", "c_acctbal", lat.alias("lat"), lon.alias("lon"))


def _towns(spark, sf):
    lat = F.pmod(F.col("s_suppkey") * 6151, F.lit(18000)) / 100.0 - 90
    lon = F.pmod(F.col("s_suppkey") * 86243, F.lit(36000)) / 100.0 - 180
    return table(spark, sf, "supplier").select(F.col("s_name").alias("town"), lat.alias("lat"), lon.alias("lon"), (F.floor(F.col("s_acctbal")) * 30).cast("long").alias("population"))


_L = "(SELECT c_custkey AS id, c_name, c_nationkey, c_mktsegment, c_acctbal, (c_custkey * 7919 % 18000) / 100.0 - 90 AS lat, (c_custkey * 104729 % 36000) / 100.0 - 180 AS lon FROM customer)"
_T = "(SELECT s_name AS town, (s_suppkey * 6151 % 18000) / 100.0 - 90 AS lat, (s_suppkey * 86243 % 36000) / 100.0 - 180 AS lon, floor(s_acctbal)::BIGINT * 30 AS population FROM supplier)"


def _km(a: str, b: str, c: str, d: str) -> str:
    return f"(12742.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - ({b})) / 2), 2)))))"


def _turn(a: str, b: str, c: str, d: str) -> str:
    return f"fmod(degrees(atan2(sin(radians({d} - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - ({b}))))) + 360, 360)"


_NEAR = _km(str(AT[0]), str(AT[1]), "lat", "lon")


@query(f"SELECT id, round({_NEAR}, 4) AS distance_km FROM {_L} WHERE {_NEAR} <= 2000")
def haversine_radius(spark, sf):
    return places.near(_listings(spark, sf), AT, 2000).select("id", F.round("distance_km", 4).alias("distance_km"))


@query(f"SELECT id, round(t, 4) AS bearing, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[floor((t + 22.5) / 45)::INT % 8 + 1] AS direction FROM (SELECT id, {_turn(str(AT[0]), str(AT[1]), 'lat', 'lon')} AS t FROM {_L})")
def bearing_compass(spark, sf):
    t = geo.bearing(F.lit(AT[0]), F.lit(AT[1]), F.col("lat"), F.col("lon"))
    return _listings(spark, sf).select("id", F.round(t, 4).alias("bearing"), geo.compass(t).alias("direction"))


_WRAP = _km("-17.0", "179.5", "lat", "lon")


@query(f"SELECT id, round({_WRAP}, 4) AS distance_km FROM {_L} WHERE {_WRAP} <= 1500")
def bbox_wrap(spark, sf):
    """A circle over the antimeridian."""
    return places.near(_listings(spark, sf), (-17.0, 179.5), 1500).select("id", F.round("distance_km", 4).alias("distance_km"))


@query(f"SELECT id, (km > 500)::INT + (km > 1000)::INT + (km > 3000)::INT AS band FROM (SELECT id, {_NEAR} AS km FROM {_L})")
def distance_bands(spark, sf):
    km = geo.haversine(F.lit(AT[0]), F.lit(AT[1]), F.col("lat"), F.col("lon"))
    return _listings(spark, sf).select("id", geo.band(km, (500, 1000, 3000)).alias("band"))


@query(f"""WITH p AS (SELECT l.id, t.town, t.population, {_km('l.lat', 'l.lon', 't.lat', 't.lon')} AS km FROM {_L} l, {_T} t),
r AS (SELECT *, CASE WHEN population >= 100000 AND km <= 300 THEN 1 WHEN km <= 20 THEN 2 END AS rule FROM p)
SELECT id, town, rule, round(km, 4) AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rule, CASE WHEN rule = 1 THEN -population END, km, town) AS n FROM r WHERE rule IS NOT NULL) WHERE n = 1""")
def nearest_settlement(spark, sf):
    return places.settle(_listings(spark, sf), _towns(spark, sf), reach=300).select("id", "town", "rule", F.round("distance_km", 4).alias("distance_km"))


@query(f"""WITH d AS (SELECT id, {_NEAR} AS km FROM {_L}), r AS (SELECT CASE WHEN (SELECT count(*) FROM d WHERE km <= 300) >= 6 THEN 300 WHEN (SELECT count(*) FROM d WHERE km <= 900) >= 6 THEN 900 ELSE 2500 END AS radius)
SELECT id, radius::DOUBLE AS radius, round(km, 4) AS distance_km FROM d, r WHERE km <= radius ORDER BY km, id LIMIT 200""")
def radius_expand(spark, sf):
    return places.widening(_listings(spark, sf), AT, (300, 900, 2500)).select("id", "radius", F.round("distance_km", 4).alias("distance_km"))


@query(f"SELECT id FROM (SELECT id, {_NEAR} AS km, c_acctbal, c_mktsegment FROM {_L}) ORDER BY (km > 1000)::INT + (km > 3000)::INT + (km > 10000)::INT, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, floor(c_acctbal / 1000) DESC, km, id LIMIT 50")
def best_rank(spark, sf):
    """Ordered by band, kind, value, then distance."""
    km = geo.haversine(F.lit(AT[0]), F.lit(AT[1]), F.col("lat"), F.col("lon"))
    ranked = _listings(spark, sf).withColumn("km", km)
    return ranked.orderBy(geo.band(F.col("km"), (1000, 3000, 10000)), F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1), F.desc(F.floor(F.col("c_acctbal") / 1000)), "km", "id").limit(50).select("id")


@query(f"WITH h AS (SELECT c_nationkey, {_NEAR} AS km FROM {_L} ORDER BY km LIMIT 15) SELECT c_nationkey, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, min(km) LIMIT 1")
def city_mode(spark, sf):
    km = geo.haversine(F.lit(AT[0]), F.lit(AT[1]), F.col("lat"), F.col("lon"))
    return places.commonest(_listings(spark, sf).withColumn("km", km), "c_nationkey", "km")


@query(f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY lat, id) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY lon, id) AS o FROM {_L}),
c AS (SELECT c_nationkey AS g, max(n) AS n, max(CASE WHEN a = n // 2 + 1 THEN lat END) AS y, max(CASE WHEN o = n // 2 + 1 THEN lon END) AS x FROM r GROUP BY 1)
SELECT l.id FROM {_L} l JOIN c ON l.c_nationkey = c.g WHERE c.n < 3 OR {_km('l.lat', 'l.lon', 'c.y', 'c.x')} <= 3000""")
def city_median_filter(spark, sf):
    return places.about_middle(_listings(spark, sf), "c_nationkey", 3000).select("id")


@query("SELECT s_nationkey AS brand, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) >= 3")
def chain_names(spark, sf):
    return places.chains(table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "brand"), "brand")


@query(f"SELECT id, c_nationkey FROM (SELECT id, c_nationkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, id) AS n FROM {_L}) WHERE n = 1")
def one_per_business(spark, sf):
    rows = _listings(spark, sf).withColumn("brand", F.concat_ws("|", "c_nationkey", "c_mktsegment"))
    return merge.one_each(rows, "brand", [F.desc("c_acctbal"), "id"]).select("id", "c_nationkey")
