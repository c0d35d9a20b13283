"""Fire detections to country-days, and points to boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.matching import small


def row_fate(fire_type: Column, confidence: Column) -> Column:
    """The first rule that a detection fails, or retained."""
    level = F.lower(F.trim(confidence))
    return F.when(fire_type != 0, "non_vegetation").when(level.isin("l", "low"), "low_confidence").otherwise("retained")


def retained(detections: DataFrame) -> DataFrame:
    """Vegetation fires of more than low confidence, with high and power (negative power counts as 0)."""
    kept = detections.where(row_fate(F.col("fire_type"), F.col("confidence")) == "retained")
    return kept.withColumns({"high": F.lower(F.trim("confidence")).isin("h", "high"), "power": F.greatest("frp", F.lit(0.0))})


def edges(ring: Column) -> Column:
    """The sides of a ring of [x, y] points, the closing one included."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(
        F.element_at(F.element_at(ring, F.when(i == 0, n).otherwise(i)), 1).alias("x1"), F.element_at(F.element_at(ring, F.when(i == 0, n).otherwise(i)), 2).alias("y1"),
        F.element_at(p, 1).alias("x2"), F.element_at(p, 2).alias("y2"),
    ))


def inside(sides: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring: on a side, or with an odd number of sides crossed to its right."""

    def touches(e: Column) -> Column:
        turn = (y - e["y1"]) * (e["x2"] - e["x1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])
        return (F.abs(turn) <= 1e-10) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    def crossed(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"])

    return F.exists(sides, touches) | (F.size(F.filter(sides, crossed)) % 2 == 1)


def cells(boundaries: DataFrame, size: float) -> DataFrame:
    """boundaries (west, east, south, north) with a row for each grid cell that the box meets."""
    along = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) + 180) / size).cast("int"), F.floor((F.col(high) + 180) / size).cast("int")))
    return boundaries.withColumn("cx", along("west", "east")).withColumn("cy", along("south", "north"))


def rectangle(west: Column, east: Column, south: Column, north: Column) -> Column:
    return F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north))


#: Sides that a band of a polygon is to hold, if they are spread evenly.
BAND_SIDES = 32


def shapes(boundaries: DataFrame) -> DataFrame:
    """place, area, box (the boundary's), polygon (its number), the box of its outer ring, rings (as sides) and rise, the height of a band.

    A band is the lower the more sides a polygon has, but not so low that its sides lie in over three bands each, on average.
    """
    box = F.struct("west", "east", "south", "north").alias("box")
    rows = boundaries.select("place", "area", box, F.posexplode(F.transform("polygons", lambda p: F.transform(p, edges))).alias("polygon", "rings"))
    outer = F.get("rings", 0)
    least = lambda c: F.array_min(F.transform(outer, lambda e: e[c]))
    most = lambda c: F.array_max(F.transform(outer, lambda e: e[c]))
    rows = rows.where(F.size(outer) > 0).withColumns({"west": least("x1"), "east": most("x1"), "south": least("y1"), "north": most("y1")})
    every = F.flatten("rings")
    climb = F.aggregate(every, F.lit(0.0), lambda sum_, e: sum_ + F.abs(e["y2"] - e["y1"]))
    return rows.withColumn("rise", F.greatest((F.col("north") - F.col("south")) * BAND_SIDES, climb / 2) / F.size(every))


def band(y: Column) -> Column:
    """The band of a polygon that a height lies in; it never falls as y grows, so that no side is missed that a point's ray can meet."""
    return F.coalesce(F.floor(F.try_divide(y - F.col("south"), F.col("rise"))), F.lit(0)).cast("long")


def banded_sides(polygons: DataFrame) -> DataFrame:
    """place, polygon and band with the sides of shapes that reach into the band: outer, and holes (an array for each)."""
    rows = polygons.select("place", "polygon", "south", "rise", F.posexplode("rings").alias("ring", "sides"))
    sides = rows.select("place", "polygon", "ring", "south", "rise", F.explode("sides").alias("side"))
    reach = F.sequence(band(F.least("side.y1", "side.y2")), band(F.greatest("side.y1", "side.y2")))
    per_ring = sides.withColumn("band", F.explode(reach)).groupBy("place", "polygon", "band", "ring").agg(F.collect_list("side").alias("sides"))
    outer = F.flatten(F.collect_list(F.when(F.col("ring") == 0, F.col("sides"))))
    return per_ring.groupBy("place", "polygon", "band").agg(outer.alias("outer"), F.collect_list(F.when(F.col("ring") > 0, F.col("sides"))).alias("holes"))


def locate(points: DataFrame, key: str, boundaries: DataFrame, size: float = 5.0) -> DataFrame:
    """points (longitude, latitude) with area: the first boundary (by place) that holds them, or null.

    boundaries: place, area, west, east, south, north, and polygons: for each polygon its rings, the outer first, holes after.
    Points meet the polygons' boxes of their own grid cell by equality, and then, of a polygon whose box holds them, the sides of
    their own band: those that a ray to the right can cross. What is crossed decides as if all sides were tried. Neither rows nor
    tables carry whole rings, and both tables are sent to all executors only if they are small. A row without a place on the map has
    no area.
    """
    polygons = shapes(boundaries)
    grid = cells(polygons.drop("rings"), size)
    cell = points.select(key, "longitude", "latitude", F.floor((F.col("longitude") + 180) / size).cast("int").alias("cx"), F.floor((F.col("latitude") + 180) / size).cast("int").alias("cy"))
    x, y = F.col("longitude"), F.col("latitude")
    boxed = cell.join(small(grid), ["cx", "cy"]).where(x.between(F.col("west"), F.col("east")) & y.between(F.col("south"), F.col("north")))
    boxed = boxed.where(x.between(F.col("box.west"), F.col("box.east")) & y.between(F.col("box.south"), F.col("box.north")))
    met = boxed.select(key, "longitude", "latitude", "place", "area", "polygon", band(y).alias("band")).join(small(banded_sides(polygons)), ["place", "polygon", "band"])
    hit = met.where(inside(F.col("outer"), x, y) & ~F.exists("holes", lambda hole: inside(hole, x, y))).groupBy(key).agg(F.min_by("area", "place").alias("area"))
    return points.join(hit, key, "left")


def country_days(located: DataFrame) -> DataFrame:
    """Per day and area: detections, sum, largest and mean power, and how many are of high confidence."""
    return located.where("area IS NOT NULL").groupBy("day", "area").agg(
        F.count("*").alias("detections"), F.sum("power").alias("power_sum"), F.max("power").alias("power_max"),
        (F.sum("power") / F.count("*")).alias("power_mean"), F.count_if("high").alias("high_confidence"),
    )


def hazard_panel(days: DataFrame, areas: DataFrame, counts: DataFrame) -> DataFrame:
    """Every day and area (supported or not): zeros where a supported area has no detection, nulls where it has no boundary."""
    out = days.crossJoin(small(areas)).join(counts, ["day", "area"], "left")
    return out.withColumns({c: F.when(F.col("supported"), F.coalesce(F.col(c), F.lit(0))) for c in counts.columns if c not in ("day", "area")})


def affected(events: DataFrame, codes: DataFrame) -> DataFrame:
    """record_id, geography_ids (sorted, of the known codes) and unmatched codes of each event's array codes."""
    each = events.select("record_id", F.explode_outer("codes").alias("code")).join(small(codes), "code", "left")
    ids = F.array_sort(F.collect_set("country"))
    return each.groupBy("record_id").agg(ids.alias("geography_ids"), F.array_sort(F.collect_set(F.when(F.col("country").isNull(), F.col("code")))).alias("unmatched"))


def clusters(events: DataFrame, size: float) -> DataFrame:
    """Events per square of so many degrees: count and first event."""
    cell = [F.floor(F.col(c) / size).cast("long").alias(f"cell_{c}") for c in ("lon", "lat")]
    return events.groupBy(*cell).agg(F.count("*").alias("events"), F.min("record_id").alias("anchor"))


