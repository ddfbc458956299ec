"""Query plans over the given tables; importing this package registers them all."""

from rasterqa.plans import raster, pairs, events, text, streams  # noqa: F401
