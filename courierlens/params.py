"""Everything a deployment may set: tenant, dates, clock offset and literals."""

from __future__ import annotations

import calendar
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone


def months_before(day: date, months: int) -> date:
    """The same day ``months`` earlier, clipped to the end of a shorter month."""
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return date(year, month + 1, min(day.day, last))


def _today_utc() -> date:
    return datetime.now(timezone.utc).date()


@dataclass(frozen=True)
class Params:
    """Inputs of the plans that are not tables.

    ``as_of`` stands for "today": results cover the days before it. Values that
    carry a company's own names (its tenant id, its quick-commerce store type,
    its in-house account names) have no default that means anything outside that
    company, so ``entity`` is required and the others are to be set per
    deployment through ``quick_store_type`` and ``house_name_patterns``.
    """

    entity: str
    as_of: date = field(default_factory=_today_utc)

    # Clock
    utc_offset_hours: int = 8
    lookback_months: int = 2

    #: Whether sums of amounts are the same bit for bit however rows are partitioned, at some cost.
    exact_sums: bool = False

    # First day each source is read from (fixed values)
    economics_from: date = date(2022, 6, 1)
    history_from: date = date(2022, 1, 1)
    valid_orders_created_from: date = date(2021, 12, 31)
    zone_stats_from: date = date(2022, 6, 30)
    surge_bands_from: date = date(2022, 7, 1)
    open_contract_end: date = date(2200, 1, 1)

    # Vendor names that are not real restaurants (fixed values)
    name_patterns: tuple[str, ...] = ("%islandwide%", "%restaurant delivery%", "%vendor delivery%")
    house_name_patterns: tuple[str, ...] = ()
    vendor_vertical: str = "Restaurant"

    # Order economics (fixed values)
    excluded_store_type: str = "dmart"
    quick_store_type: str = "quick_store"
    wide_area_minimum: float = 25.0
    low_fees: tuple[float, ...] = (0.93, 0.99)
    free_delivery: str = "free_delivery"
    restaurant_type: str = "restaurants"
    delivery: str = "delivery"

    # Zones and delivery-area events (fixed values)
    excluded_zone_pattern: str = "%dmart%"
    area_activation: str = "automatic"
    area_title_patterns: tuple[str, ...] = ("%shrink%", "%close%")
    shrink_labels: tuple[tuple[str, str], ...] = (
        ("%shrink_0%", "shrink_0"),
        ("%shrink_1%", "shrink_1"),
        ("%shrink_2%", "shrink_2"),
        ("%shrink_3%", "shrink_3"),
        ("%shrink_4%", "shrink_4"),
        ("%close%", "close"),
    )
    no_shrink: str = "no_shrink"
    closed: str = "close"
    no_surge: str = "no_surge"
    low_delay: float = -1.0

    # Funnel (fixed values)
    transaction: str = "transaction"
    source_priority: tuple[str, ...] = ("direct", "search engine")
    restaurant_order_types: tuple[str, ...] = ("restaurants", "caterers", "kitchens")
    session_actions: tuple[str, ...] = (
        "shop_list.loaded",
        "shop_list.updated",
        "shop_details.loaded",
        "cart.loaded",
        "checkout.loaded",
        "transaction",
    )
    session_vendor_types: tuple[str, ...] = ("restaurants", "street_food", "caterer", "web.city page")
    navigation: str = "navigation.clicked"
    order_screens: tuple[str, ...] = (
        "my_order",
        "myorders",
        "myorderscreen",
        "myorderdetails",
        "pastordersdetails",
        "pastordersdetailsscreen",
    )
    funnel_vendor_types: tuple[str, ...] = (
        "restaurants",
        "caterers",
        "street_food",
        "homescreen",
        "web.city page",
    )
    home_actions: tuple[str, ...] = ("home_screen.loaded",)
    list_actions: tuple[str, ...] = ("shop_list.loaded", "shop_list.updated")
    details_actions: tuple[str, ...] = ("shop_details.loaded",)
    checkout_actions: tuple[str, ...] = ("checkout.loaded",)

    @property
    def last_day(self) -> date:
        return self.as_of - timedelta(days=1)

    @property
    def lookback_start(self) -> date:
        return months_before(self.last_day, self.lookback_months)

    @property
    def blocked_names(self) -> tuple[str, ...]:
        return self.name_patterns + self.house_name_patterns
