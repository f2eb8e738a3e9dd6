"""Example queries over the driver's tables; importing this package fills the registry."""

from panelspark.plans.catalog import cleaning, edges, features, forecasts, geo, panel, profiles, scans  # noqa: F401
from panelspark.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
