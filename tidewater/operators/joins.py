"""Joins that Spark has no operator for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.geo import EARTH_KM, arc_km
from tidewater.operators.ordered import with_last_before
from tidewater.sources.shared import written


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], ranges: int | None = None) -> DataFrame:
    """left with the values of right's last row (same by) at or before left_on, and matched_on, that row's time.

    Both sides become one stream in order of time, in which each row of left takes the last values before it. The stream is cut in ranges of key
    and time (see operators.ordered), so a key may be longer than a task holds. right has one row for each by and time; left may have any columns.
    Rows of left with a null key or time come back unmatched.
    """
    names = left.columns
    kind = _kind(right, [right_on, *values])
    a = left.select(*by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(kind).alias("_found"))
    b = right.where(_all_there([*by, right_on])).select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(_kind(left, names)).alias("_row"), F.struct(right_on, *values).alias("_found"))
    both = with_last_before(a.unionByName(b), by, ["_at", "_side"], "_found", "_last", ranges).where("_side = 1")
    last = F.when(_all_there([*by, "_at"]), F.col("_last"))
    return both.select("_row.*", last[right_on].alias("matched_on"), *(last[v].alias(v) for v in values))


def _all_there(names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in names))


def _kind(df: DataFrame, names: list[str]):
    return df.select(F.struct(*names).alias("s")).schema["s"].dataType


#: Points of a tile, on average at most.
TILE_POINTS = 256


def tiles(points: DataFrame, key: str, lat_reach: float, lon_reach: float, tile_points: int = TILE_POINTS, weight: Column | None = None) -> DataFrame:
    """points (key, latitude, longitude; those with a place) with y and x, their cell in a grid as wide as the reach, and tile, their part of it.

    A cell with many points is split by place into k x k parts, of about tile_points each where points are spread; a part that still
    has more, as many points stand at one place, is split by a hash of the key. A tile is a struct (y, x, part_y, part_x, salt). weight: how many points a row stands for.
    """
    p = points.select(key, "latitude", "longitude", (F.lit(1) if weight is None else weight).alias("_w")).where("latitude is not null and longitude is not null")
    p = p.withColumns({"y": F.floor(F.col("latitude") / lat_reach), "x": F.floor(F.col("longitude") / lon_reach)})
    cells = p.groupBy("y", "x").agg(F.ceil(F.sqrt(F.sum("_w") / tile_points)).alias("_k"))
    part = lambda at, cell, reach: F.least(F.floor((F.col(at) / reach - F.col(cell)) * F.col("_k")), F.col("_k") - 1)
    p = p.join(cells, ["y", "x"]).withColumns({"part_y": part("latitude", "y", lat_reach), "part_x": part("longitude", "x", lon_reach)}).drop("_k")
    crowds = p.groupBy("y", "x", "part_y", "part_x").agg(F.ceil(F.sum("_w") / tile_points).alias("_m")).where("_m > 1")
    p = p.join(crowds, ["y", "x", "part_y", "part_x"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(key), F.col("_m")), F.lit(0)))
    return p.select(key, "latitude", "longitude", "y", "x", F.struct("y", "x", "part_y", "part_x", "salt").alias("tile"))


def tile_pairs(tiled: DataFrame, radius_km: float, lat_reach: float, lon_reach: float) -> DataFrame:
    """(a, b), a <= b: tiles of neighbouring cells, or of one, whose points can be within reach and radius of each other."""
    edges = [F.min("latitude").alias("s"), F.max("latitude").alias("n"), F.min("longitude").alias("w"), F.max("longitude").alias("e")]
    boxes = tiled.groupBy("y", "x", "tile").agg(*edges)
    around = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    a = boxes.select(F.col("tile").alias("a"), *(F.col(c).alias(f"{c}1") for c in "snwe"), F.inline(around))
    b = boxes.select(F.col("tile").alias("b"), *(F.col(c).alias(f"{c}2") for c in "snwe"), "y", "x")
    lat_gap = F.greatest(F.col("s2") - F.col("n1"), F.col("s1") - F.col("n2"), F.lit(0.0))
    lon_gap = F.greatest(F.col("w2") - F.col("e1"), F.col("w1") - F.col("e2"), F.lit(0.0))
    # No way is shorter than that along a meridian, nor than the chord between two meridians where they are closest.
    narrow = F.least(*(F.cos(F.radians(c)) for c in ("s1", "n1", "s2", "n2")))
    least_km = F.greatest(F.radians(lat_gap) * EARTH_KM, 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.greatest(narrow, F.lit(0.0)) * F.sin(F.radians(F.least(lon_gap, F.lit(180.0))) / 2))))
    near = (F.col("a") <= F.col("b")) & (lat_gap <= lat_reach) & (lon_gap <= lon_reach) & (least_km <= radius_km + 1e-6)
    return a.join(b, ["y", "x"]).where(near).select("a", "b")


def spots(points: DataFrame, key: str, most: int = TILE_POINTS) -> DataFrame:
    """spot (a number), latitude, longitude, members (keys): points of one place together, about so many of them at most; points without a place are left out. A written table."""
    p = points.select(key, "latitude", "longitude").where("latitude is not null and longitude is not null")
    crowds = p.groupBy("latitude", "longitude").agg(F.ceil(F.count("*") / most).alias("_m")).where("_m > 1")
    p = p.join(crowds, ["latitude", "longitude"], "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(key), F.col("_m")), F.lit(0)))
    grouped = p.groupBy("latitude", "longitude", "_salt").agg(F.sort_array(F.collect_list(key)).alias("members"))
    return written(grouped.select(F.monotonically_increasing_id().alias("spot"), "latitude", "longitude", "members"), "spots")


def spot_pairs(found: DataFrame, radius_km: float, lat_reach: float = 0.06, lon_reach: float = 0.07, tile_points: int = TILE_POINTS) -> DataFrame:
    """(a, b, distance_km, a_members, b_members), a <= b, of spots within radius_km and a reach of each other; each spot with itself too.

    Spots are compared by pairs of tiles, an equi-join: tiles hold spots of about tile_points points at most, however points crowd, so that no task gets
    more than a small share of the pairs of points, and tiles too far apart aren't compared.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiled = written(tiles(found, "spot", lat_reach, lon_reach, tile_points, F.size("members")), "tiles")
    pairs = written(tile_pairs(tiled, radius_km, lat_reach, lon_reach), "tile-pairs")
    tiled = tiled.select("spot", "tile").join(found, "spot")
    one = tiled.select(F.col("spot").alias("_a"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("members").alias("_ma"), F.col("tile").alias("a"))
    two = tiled.select(F.col("spot").alias("_b"), F.col("latitude").alias("_lat2"), F.col("longitude").alias("_lon2"), F.col("members").alias("_mb"), F.col("tile").alias("b"))
    # Dealt in a fixed number of partitions: few bytes make much work here, and partitions that are small in bytes would be put together.
    met = one.join(pairs, "a").repartition(n, "a", "b").join(two.join(pairs, "b").repartition(n, "a", "b"), ["a", "b"])
    once = (F.col("a") != F.col("b")) | (F.col("_a") <= F.col("_b"))
    near = met.where(once & (F.abs(F.col("_lat") - F.col("_lat2")) <= lat_reach) & (F.abs(F.col("_lon") - F.col("_lon2")) <= lon_reach))
    near = near.withColumn("distance_km", arc_km(F.col("_lat"), F.col("_lon"), F.col("_lat2"), F.col("_lon2"))).where(F.col("distance_km") <= radius_km)
    first = F.col("_a") <= F.col("_b")
    return near.select(
        F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "distance_km",
        F.when(first, F.col("_ma")).otherwise(F.col("_mb")).alias("a_members"), F.when(first, F.col("_mb")).otherwise(F.col("_ma")).alias("b_members"),
    )


def grid_pairs(points: DataFrame, key: str, radius_km: float, lat_reach: float = 0.06, lon_reach: float = 0.07, tile_points: int = TILE_POINTS, places: int | None = None) -> DataFrame:
    """Pairs (key, other, distance_km) of points within radius_km, key < other. Points without a place, or apart by more than a reach, are in no pair.

    Places are compared (spot_pairs), once however many points stand there; pairs of points are unfolded from theirs where those are found, and not moved.
    places: decimal places that distances are rounded to, once a pair of places.
    """
    each = _unfolded(_rounded(spot_pairs(spots(points, key, tile_points), radius_km, lat_reach, lon_reach, tile_points), places))
    apart = F.when(F.col("a") == F.col("b"), F.col("_x") < F.col("_y")).otherwise(F.col("_x") != F.col("_y"))
    return each.where(apart).select(F.least("_x", "_y").alias(key), F.greatest("_x", "_y").alias("other"), "distance_km")


def grid_edges(points: DataFrame, key: str, radius_km: float, places: int | None = None) -> DataFrame:
    """grid_pairs in both directions: pairs of places are turned round, not those of points."""
    near = _rounded(spot_pairs(spots(points, key), radius_km), places)
    there, back = ("a", "b", "a_members", "b_members"), ("b", "a", "b_members", "a_members")
    ways = F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(way, there))) for way in (there, back)))
    both = near.select("distance_km", F.inline(F.filter(ways, lambda w, i: (i == 0) | (w["a"] != w["b"]))))
    return _unfolded(both).where("_x <> _y").select(F.col("_x").alias(key), F.col("_y").alias("other"), "distance_km")


def _rounded(near: DataFrame, places: int | None) -> DataFrame:
    return near if places is None else near.withColumn("distance_km", F.round("distance_km", places))


def _unfolded(near: DataFrame) -> DataFrame:
    """a, b, distance_km, _x, _y: a row for each member of a beside each of b."""
    return near.select("a", "b", "distance_km", "b_members", F.explode("a_members").alias("_x")).select("a", "b", "distance_km", "_x", F.explode("b_members").alias("_y"))


def symmetric(pairs: DataFrame, key: str, other: str = "other") -> DataFrame:
    """Each pair in both directions; the pairs are found once."""
    rest = [c for c in pairs.columns if c not in (key, other)]
    one, two = F.struct(F.col(key).alias(key), F.col(other).alias(other)), F.struct(F.col(other).alias(key), F.col(key).alias(other))
    return pairs.select(F.inline(F.array(one, two)), *rest).select(key, other, *rest)
