"""Places: search about a point, settlements, brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.geo import bearing, box, compass, haversine


def near(places: DataFrame, at: tuple[float, float], km: float, limit: int | None = None, key: str = "id") -> DataFrame:
    """places within km of a point with distance, bearing and direction, the nearest first. The box prunes before any trigonometry."""
    lat, lon = F.lit(at[0]), F.lit(at[1])
    found = places.where(box(F.col("lat"), F.col("lon"), at, km)).withColumn("distance_km", haversine(lat, lon, F.col("lat"), F.col("lon"))).where(F.col("distance_km") <= km)
    found = found.withColumn("bearing", bearing(lat, lon, F.col("lat"), F.col("lon"))).withColumn("direction", compass(F.col("bearing")))
    return found.orderBy("distance_km", key).limit(limit) if limit else found


def widening(places: DataFrame, at: tuple[float, float], radii: tuple[float, ...] = (2, 5, 15), enough: int = 6, read: int = 200, key: str = "id") -> DataFrame:
    """Places within the smallest radius that holds `enough` of them, else within the largest; at most the `read` nearest. All radii are counted in one pass over the largest."""
    found = near(places, at, max(radii), key=key)
    counts = found.agg(*(F.count(F.when(F.col("distance_km") <= r, 1)).alias(f"r{i}") for i, r in enumerate(radii))).first()
    radius = next((r for i, r in enumerate(radii) if counts[i] >= enough), radii[-1])
    return found.where(F.col("distance_km") <= radius).withColumn("radius", F.lit(float(radius))).orderBy("distance_km", key).limit(read)


def settle(places: DataFrame, towns: DataFrame, reach: float = 30.0, key: str = "id") -> DataFrame:
    """(key, town, rule): for each place the most populous town of 100,000 within reach (rule 1), else the nearest town within 20 km (rule 2); places without are left out.

    Places and towns meet by grid cells: each place looks into its own degree cell and its neighbours (more along a parallel towards the poles), so the join is on equality and no pair beyond them is made. Places of one spot are answered once, and of the towns of one spot only those that can be an answer are met: the most populous and the first by name.
    """
    step = reach / 111.0
    cells_lat = F.sequence(F.floor((F.col("lat") - step) + 90).cast("int"), F.floor((F.col("lat") + step) + 90).cast("int"))
    wide = F.least(F.lit(180.0), step / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.9), F.abs("lat") + step)))))
    cells_lon = F.array_distinct(F.transform(F.sequence(F.floor(F.col("lon") - wide).cast("int"), F.floor(F.col("lon") + wide).cast("int")), lambda c: F.pmod(c + 180, F.lit(360))))
    looked = places.select("lat", "lon").distinct().withColumn("_y", F.explode(cells_lat)).withColumn("_x", F.explode(cells_lon))
    large = F.col("population") >= 100_000
    first = towns.groupBy("lat", "lon").agg(F.min(F.when(large, F.struct((-F.col("population")).alias("_less"), "town", "population"))).alias("_large"), F.min(F.struct("town", "population")).alias("_any"))
    told = lambda c: F.struct(F.col(c)["town"].alias("town"), F.col(c)["population"].alias("population"))
    first = first.withColumn("_t", F.explode(F.when(F.col("_large").isNull(), F.array(told("_any"))).otherwise(F.array(told("_large"), told("_any")))))
    held = first.select("_t.town", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "_t.population", F.floor(F.col("lat") + 90).cast("int").alias("_ty"), F.pmod(F.floor("lon").cast("int") + 180, F.lit(360)).alias("_tx"))
    spread = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many pairs, so cells are dealt by number, not by size
    pairs = looked.repartition(spread, "_y", "_x").join(held.repartition(spread, "_ty", "_tx"), (F.col("_y") == F.col("_ty")) & (F.col("_x") == F.col("_tx"))).withColumn("_km", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    rule = F.when((F.col("population") >= 100_000) & (F.col("_km") <= reach), 1).when(F.col("_km") <= 20, 2)
    pairs = pairs.withColumn("rule", rule).where("rule is not null")
    order = ["rule", F.when(F.col("rule") == 1, -F.col("population")).alias("_less"), "_km", "town"]
    spots = pairs.groupBy("lat", "lon").agg(F.min(F.struct(*order)).alias("_best")).select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "_best")
    found = places.select(key, "lat", "lon").join(spots, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")))
    best = found.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("_best"))).where("_n = 1")
    return best.select(key, "_best.town", "_best.rule", F.col("_best._km").alias("distance_km"))


def commonest(rows: DataFrame, value: str, order: str, first: int = 15) -> DataFrame:
    """(value, n): the commonest value of the first rows by order; of equals the one met first."""
    head = rows.orderBy(order).limit(first).select(value, order)
    return head.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").limit(1).select(value, "n")


def chains(places: DataFrame, brand: str, least: int = 3) -> DataFrame:
    """(brand, n) of brands with `least` places or more."""
    return places.where(F.col(brand).isNotNull()).groupBy(brand).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def about_middle(places: DataFrame, group: str, km: float = 25.0, key: str = "id") -> DataFrame:
    """places within km of their group's middle, the upper median of latitudes and of longitudes; groups of fewer than three located places stay whole, and so do places without a location.

    The median comes from ranks within a group and its count.
    """
    located = places.where("lat is not null and lon is not null")
    n = F.count("*").over(W.partitionBy(group))
    ranked = located.select(group, key, "lat", "lon", n.alias("_n"), F.row_number().over(W.partitionBy(group).orderBy("lat", key)).alias("_a"), F.row_number().over(W.partitionBy(group).orderBy("lon", key)).alias("_o"))
    middle = F.floor(F.col("_n") / 2) + 1
    centre = ranked.groupBy(group).agg(F.max("_n").alias("_n"), F.max(F.when(F.col("_a") == middle, F.col("lat"))).alias("_lat"), F.max(F.when(F.col("_o") == middle, F.col("lon"))).alias("_lon"))
    joined = places.join(centre.withColumnRenamed(group, "_g"), F.col(group) == F.col("_g"), "left")
    far = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return joined.where(F.col("_n").isNull() | (F.col("_n") < 3) | F.col("lat").isNull() | F.col("lon").isNull() | (far <= km)).select(*places.columns)
