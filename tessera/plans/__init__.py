"""The query catalogue: every module registers its queries on import."""

from . import events, graph, layers, marts, metrics, models, quality, raster, series, spatial, streams, text  # noqa: F401
