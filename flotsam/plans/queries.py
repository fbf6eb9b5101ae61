"""Every query of the marine engine, and its SQL."""

from . import audit_queries, band_queries, drift_queries, more_queries, raster_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
