"""Every operator as a query over the test tables."""

from sunloom.workload import quality_and_gold, reads_and_dashboard, series_and_models, streams_and_models
from sunloom.workload.registry import QUERIES

__all__ = ["QUERIES", "quality_and_gold", "reads_and_dashboard", "series_and_models", "streams_and_models"]
