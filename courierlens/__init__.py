"""Batch analytics for a food-delivery marketplace, written for Spark.

``courierlens.plans`` holds the eight daily result tables; every one is a
function ``(catalog, params) -> DataFrame`` that only builds a plan.
"""

from courierlens.params import Params
from courierlens.sources.catalog import Catalog

__all__ = ["Catalog", "Params"]
