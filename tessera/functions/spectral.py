"""Registry of spectral indices: each a Column of its bands; null where a denominator is 0 or a root has no real value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Index:
    name: str
    bands: tuple[str, ...]
    category: str
    formula: Callable[..., Column]


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def _root(x: Column) -> Column:
    return F.sqrt(F.when(x >= 0, x))


nd, div = normalized_difference, F.try_divide


def _savi(n, r, soil=0.5):
    return div((1 + soil) * (n - r), n + r + soil)


def _evi(n, r, b):
    return div(2.5 * (n - r), n + 6 * r - 7.5 * b + 1)


def _chlorophyll(e, r, g):
    return (e - r) - 0.2 * (e - g)


_ALL = [
    Index("ndvi", ("nir", "red"), "vegetation", nd),
    Index("savi", ("nir", "red"), "vegetation", _savi),
    Index("evi2", ("nir", "red"), "vegetation", lambda n, r: div(2.5 * (n - r), n + 2.4 * r + 1)),
    Index("evi", ("nir", "red", "blue"), "vegetation", _evi),
    Index("msavi", ("nir", "red"), "vegetation", lambda n, r: (2 * n + 1 - _root(F.pow(2 * n + 1, 2) - 8 * (n - r))) / 2),
    Index("gndvi", ("nir", "green"), "vegetation", nd),
    Index("arvi", ("nir", "red", "blue"), "vegetation", lambda n, r, b: nd(n, 2 * r - b)),
    Index("ndre", ("nir", "rededge"), "vegetation", nd),
    Index("vari", ("green", "red", "blue"), "vegetation", lambda g, r, b: div(g - r, g + r - b)),
    Index("rvi", ("nir", "red"), "vegetation", div),
    Index("dvi", ("nir", "red"), "vegetation", lambda n, r: n - r),
    Index("ci_green", ("nir", "green"), "vegetation", lambda n, g: div(n, g) - 1),
    Index("ci_rededge", ("nir", "rededge"), "vegetation", lambda n, e: div(n, e) - 1),
    Index("mcari", ("rededge", "red", "green"), "vegetation", lambda e, r, g: _chlorophyll(e, r, g) * div(e, r)),
    Index("tcari", ("rededge", "red", "green"), "vegetation", lambda e, r, g: 3 * ((e - r) - 0.2 * (e - g) * div(e, r))),
    Index("lai", ("nir", "red", "blue"), "vegetation", lambda n, r, b: 3.618 * _evi(n, r, b) - 0.118),
    Index("ndwi", ("green", "nir"), "water", nd),
    Index("ndmi", ("nir", "swir1"), "water", nd),
    Index("mndwi", ("green", "swir1"), "water", nd),
    Index("awei", ("green", "nir", "swir1", "swir2"), "water", lambda g, n, s, t: 4 * (g - s) - (0.25 * n + 2.75 * t)),
    Index("ndii", ("nir", "swir1"), "water", nd),
    Index("bsi", ("swir1", "red", "nir", "blue"), "soil", lambda s, r, n, b: nd(s + r, n + b)),
    Index("salinity_index", ("green", "red"), "soil", lambda g, r: _root(g * r)),
    Index("iron_oxide", ("red", "blue"), "geology", div),
    Index("clay_minerals", ("swir1", "swir2"), "geology", div),
    Index("ferrous_minerals", ("swir1", "nir"), "geology", div),
    Index("ndbi", ("swir1", "nir"), "urban", nd),
    Index("ui", ("swir2", "nir"), "urban", nd),
    Index("ibi", ("swir1", "nir", "red", "green"), "urban", lambda s, n, r, g: nd(nd(s, n), (_savi(n, r) + nd(g, s)) / 2)),
    Index("ndsi", ("green", "swir1"), "snow", nd),
    Index("ndgi", ("green", "red"), "snow", nd),
    Index("nbr", ("nir", "swir2"), "fire", nd),
    Index("nbr2", ("swir1", "swir2"), "fire", nd),
    Index("bai", ("red", "nir"), "fire", lambda r, n: div(F.lit(1.0), F.pow(0.1 - r, 2) + F.pow(0.06 - n, 2))),
]
INDICES = {i.name: i for i in _ALL}


def compute_index(name: str, bands: dict[str, Column]) -> Column:
    """The index ``name`` (in any case) of columns by band name."""
    if name.lower() not in INDICES:
        raise KeyError(f"unknown index {name}; known: {', '.join(INDICES)}")
    index = INDICES[name.lower()]
    if missing := [b for b in index.bands if b not in bands]:
        raise KeyError(f"{name} needs the bands {missing}")
    return index.formula(*[bands[b] for b in index.bands])


def required_bands(names: list[str]) -> list[str]:
    return sorted({b for n in names for b in INDICES[n.lower()].bands})


def list_indices() -> list[str]:
    return list(INDICES)


def list_indices_by_category() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for index in _ALL:
        out.setdefault(index.category, []).append(index.name)
    return out
