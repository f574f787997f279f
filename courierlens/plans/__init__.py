"""The eight daily result tables, each ``(catalog, params) -> DataFrame``."""

from courierlens.plans.active_vendors import daily_active_vendors
from courierlens.plans.order_economics import daily_orders
from courierlens.plans.offline_hours import daily_offline_hours
from courierlens.plans.rainfall import daily_rainfall
from courierlens.plans.restaurant_funnel import daily_restaurant_conversion_funnel
from courierlens.plans.shrink_conversion import daily_conversion_by_shrink
from courierlens.plans.surge_conversion import daily_conversion_by_surge
from courierlens.plans.vendor_lateness import daily_vendor_lateness

__all__ = [
    "daily_active_vendors",
    "daily_conversion_by_shrink",
    "daily_conversion_by_surge",
    "daily_offline_hours",
    "daily_orders",
    "daily_rainfall",
    "daily_restaurant_conversion_funnel",
    "daily_vendor_lateness",
]
