"""Column builders for distances, boxes and tiles on the globe, and for travel times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres.
EARTH_RADIUS_KM, KM_PER_DEGREE_LAT, KM_PER_DEGREE_LON = 6371.0, 110.574, 111.320


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bbox_area_km2(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    middle = F.cos(F.radians((min_lat + max_lat) / 2))
    return KM_PER_DEGREE_LAT * (max_lat - min_lat) * KM_PER_DEGREE_LON * middle * (max_lon - min_lon)


def bbox_center(low: Column, high: Column) -> Column:
    return (low + high) / 2


def bbox_aspect_ratio(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    return F.try_divide((max_lon - min_lon) * F.cos(F.radians((min_lat + max_lat) / 2)), max_lat - min_lat)


def suggest_zoom(min_lon: Column, max_lon: Column) -> Column:
    width = max_lon - min_lon
    zoom = F.floor(F.log2(360.0 / F.when(width > 0, width)))
    return F.when(width > 0, F.least(F.greatest(zoom, F.lit(0)), F.lit(22))).otherwise(22).cast("int")


def crosses_antimeridian(min_lon: Column, max_lon: Column) -> Column:
    return max_lon < min_lon


def validate_aoi(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, max_area_km2: float) -> Column:
    """First failing rule of a box, or 'ok'."""
    return (
        F.when(min_lon.isNull() | min_lat.isNull() | max_lon.isNull() | max_lat.isNull(), "missing")
        .when(~min_lon.between(-180, 180) | ~max_lon.between(-180, 180) | ~min_lat.between(-90, 90) | ~max_lat.between(-90, 90), "out of range")
        .when(max_lon < min_lon, "crosses antimeridian")
        .when((max_lon == min_lon) | (max_lat <= min_lat), "empty")
        .when(bbox_area_km2(min_lon, min_lat, max_lon, max_lat) > max_area_km2, "too large")
        .otherwise("ok")
    )


def travel_time_seconds(length_m: Column, speed_kph: Column) -> Column:
    """Null where the speed isn't positive."""
    return length_m / (F.when(speed_kph > 0, speed_kph) / 3.6)


def seconds_to_minutes(seconds: Column) -> Column:
    return F.when(~F.isnan(seconds) & (F.abs(seconds) < float("inf")), seconds / 60)


def distance_band(distance: Column, edges: list[float], unit: str = "km") -> Column:
    """Right-closed bands: up to the first edge, between edges, beyond the last; null beyond all of them stays null."""
    name = lambda x: f"{x:g}"
    out = F.when(distance <= edges[0], f"0-{name(edges[0])} {unit}")
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when(distance <= high, f"{name(low)}-{name(high)} {unit}")
    return out.when(distance.isNotNull(), f"{name(edges[-1])}+ {unit}")


def bbox_of_geojson(doc: Column) -> Column:
    """min_lon, min_lat, max_lon, max_lat over all coordinates of a GeoJSON text: geometry, collection, feature or features; null without any."""
    paths = [f"$.{at}{inner}coordinates" for at in ("", "geometry.", "features[*].geometry.") for inner in ("", "geometries[*].")]
    text = F.concat_ws(" ", *[F.get_json_object(doc, p) for p in paths])
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    axis = lambda k: F.transform(F.regexp_extract_all(text, F.lit(rf"\[\s*{number}\s*,\s*{number}"), F.lit(k)), lambda v: v.cast("double"))
    lon, lat = axis(1), axis(2)
    return F.when(F.size(lon) > 0, F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat")))
