"""Tender relevance, region and refresh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.functions.numbers import haversine_km
from brickline.functions.session import materialised


def relevance(text: Column, strong: tuple[str, ...], weak: tuple[str, ...], against: tuple[str, ...]) -> Column:
    """15 for each strong word contained, 8 for a weak one, -10 for one against; 0 to 100."""
    points = F.lit(0)
    for words, worth in ((strong, 15), (weak, 8), (against, -10)):
        for w in words:
            points = points + F.when(F.contains(text, F.lit(w)), worth).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def in_region(lat: Column, lng: Column, city: Column, centre: tuple[float, float], radius_km: float, cities: tuple[str, ...]) -> Column:
    """Within the radius where coordinates are known, else by the city's name."""
    km = haversine_km(F.lit(centre[0]), F.lit(centre[1]), lat, lng)
    return F.when(lat.isNotNull() & lng.isNotNull(), km <= radius_km).otherwise(F.coalesce(F.lower(city).isin(*cities), F.lit(False)))


def geocoded(df: DataFrame, city: str, places: DataFrame) -> DataFrame:
    """Coordinates from a table (city, lat, lng) of known places."""
    return df.join(places.select(F.lower("city").alias("place"), "lat", "lng"), F.lower(F.col(city)) == F.col("place"), "left").drop("place")


def relevant(df: DataFrame, source: str = "source", score: str = "relevance", least: int = 10, floor: int = 15, floored: str = "nrw") -> DataFrame:
    """Notices of one source get at least the floor; those of the others below `least` go."""
    own = F.col(source).eqNullSafe(F.lit(floored))
    return df.where(own | (F.col(score) >= least)).withColumn(score, F.when(own, F.greatest(F.col(score), F.lit(floor))).otherwise(F.col(score)))


@dataclass
class Refresh:
    """What a refresh leaves: the tenders, the cache of places, and the counts by source."""

    tenders: DataFrame
    places: DataFrame
    counts: DataFrame


def located(notices: DataFrame, places: DataFrame, gazetteer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notices with lat and lng by their city, and the cache (place, lat, lng) grown by the
    cities that only the gazetteer knows; the cache goes first."""
    named = notices.withColumn("place", F.lower(F.trim("city")))
    asked = named.select("place").where("place <> ''").distinct().join(places.select("place"), "place", "left_anti")
    found = gazetteer.select(F.lower(F.trim("city")).alias("place"), "lat", "lng").where("lat is not null and lng is not null")
    grown = places.select("place", "lat", "lng").unionByName(asked.join(found.groupBy("place").agg(F.min(F.struct("lat", "lng")).alias("x")), "place").select("place", "x.lat", "x.lng"))
    return named.join(grown, "place", "left").drop("place"), grown


def saved(tenders: DataFrame, notices: DataFrame, order: str) -> DataFrame:
    """Notices put in by external_id in order: the first of an id makes the row, every later one
    changes its score only.  Adds is_new."""
    columns = [x for x in tenders.columns if x != "external_id"]
    got = notices.groupBy("external_id").agg(F.min_by(F.struct(*columns), order).alias("row"), F.max_by("relevance", order).alias("score"))
    old = tenders.select(F.col("external_id").alias("old_id"), F.struct(*columns).alias("old"))
    both = got.join(old, F.col("external_id") == F.col("old_id"), "full_outer")
    row = lambda x: F.when(F.col("old_id").isNotNull(), F.col(f"old.{x}")).otherwise(F.col(f"row.{x}"))
    kept = {x: F.coalesce("score", row(x)) if x == "relevance" else row(x) for x in columns}
    return both.select(F.coalesce("external_id", "old_id").alias("external_id"), *[v.alias(x) for x, v in kept.items()], F.col("old_id").isNull().alias("is_new"))


def refresh(
    tenders: DataFrame, notices: DataFrame, places: DataFrame, gazetteer: DataFrame, order: str, sources: tuple[str, ...],
    centre: tuple[float, float], radius_km: float, cities: tuple[str, ...],
) -> Refresh:
    """Stored tenders outside of the region go; each source's notices in the region, and
    relevant enough, are saved in turn.

    tenders: external_id, title, city, lat, lng, relevance, source; notices: the same but lat
    and lng, and order (unique).  Counts: source (null: all), fetched, new, total, removed.
    Nulls: a notice without a city is outside; empty tables give a count of zero."""
    inside = in_region(F.col("lat"), F.col("lng"), F.trim("city"), centre, radius_km, cities)
    now = materialised(tenders.where(inside))
    everywhere, grown = located(notices, places, gazetteer)
    near = materialised(relevant(everywhere.where(inside)))
    counts = []
    for name in sources:
        mine = near.where(F.col("source") == name)
        after = materialised(saved(now, mine, order))
        counts.append((name, mine.count(), after.where("is_new").count()))
        now = after.drop("is_new")
    counts.append((None, sum(x[1] for x in counts), sum(x[2] for x in counts)))
    total, removed = now.count(), tenders.where(~F.coalesce(inside, F.lit(False))).count()
    rows = [(*x, total, removed) for x in counts]
    spark = tenders.sparkSession
    return Refresh(now, materialised(grown), spark.createDataFrame(rows, "source string, fetched long, new long, total long, removed long"))
