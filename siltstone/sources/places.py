"""Map elements to places and their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ELEMENT = "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, lat, lon, tags) of tile files, each element once."""
    raw = spark.read.schema(ELEMENT).option("multiLine", "true").json(path)
    e = raw.select(F.explode("elements").alias("e")).select("e.*")
    return e.select("type", "id", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), "tags").dropDuplicates(["type", "id"])


def distinct(found: DataFrame) -> DataFrame:
    """Elements of one name and place once: nodes before ways before relations, then the smaller id."""
    rank = F.when(F.col("type") == "node", 0).when(F.col("type") == "way", 1).otherwise(2)
    w = W.partitionBy(F.col("tags")["name"], "lat", "lon").orderBy(rank, "id")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def category(tags: Column) -> Column:
    """The kind of a place by its tags, the first that is set."""
    return F.coalesce(*(tags[k] for k in ("amenity", "shop", "tourism", "healthcare", "emergency", "leisure", "natural")))


def address(tags: Column) -> Column:
    street = F.concat_ws(" ", tags["addr:street"], tags["addr:housenumber"])
    town = F.concat_ws(" ", tags["addr:postcode"], tags["addr:city"])
    return F.concat_ws(", ", F.nullif(street, F.lit("")), F.nullif(town, F.lit("")))


def place_documents(found: DataFrame) -> DataFrame:
    """(id, title, lat, lon, category, text): text in lines "Key: value", coordinates to six places; elements without a name, kind or place are left out."""
    t = F.col("tags")
    name = F.coalesce(t["name:en"], t["name"])
    rows = found.where(name.isNotNull() & category(t).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    line = lambda key, v: F.when(F.length(v) > 0, F.concat(F.lit(f"{key}: "), v))
    text = F.concat_ws(
        "\n", line("Place", name), line("Category", category(t)), line("Cuisine", F.replace(t["cuisine"], F.lit(";"), F.lit(", "))), line("Address", address(t)), line("Hours in source", t["opening_hours"]), line("Phone", F.coalesce(t["phone"], t["contact:phone"])),
        line("Latitude", F.format_string("%.6f", "lat")), line("Longitude", F.format_string("%.6f", "lon")),
    )
    return rows.select(F.concat("type", F.lit("-"), F.col("id").cast("string")).alias("id"), name.alias("title"), "lat", "lon", category(t).alias("category"), text.alias("text"))


def population(value: Column) -> Column:
    """A population tag as a number: separators off; null if it holds no plain number."""
    digits = F.regexp_replace(F.trim(value), r"[,.\s'_]", "")
    return F.when(digits.rlike(r"^\d{1,12}$"), digits.cast("long"))
