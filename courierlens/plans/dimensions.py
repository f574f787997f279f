"""Dimensions shared by several results: vendors, their zones, the zone list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.functions.rules import name_allowed
from courierlens.operators.nested import explode_structs
from courierlens.params import Params
from courierlens.sources.catalog import Catalog


def real_vendors(catalog: Catalog, params: Params) -> DataFrame:
    """Non-test vendors of the tenant's restaurant vertical, stand-in names removed."""
    v = catalog["vendors"]
    return v.filter(
        (v.entity == params.entity)
        & ~v.is_test
        & (v.vertical == params.vendor_vertical)
        & name_allowed(v.name, params.blocked_names)
    )


def vendor_list(catalog: Catalog, params: Params) -> DataFrame:
    """vendor_code, chain_name, name of the active ones."""
    return real_vendors(catalog, params).filter("is_active").select("vendor_code", "chain_name", "name")


def vendor_zones(catalog: Catalog, params: Params) -> DataFrame:
    """Distinct (vendor_code, zone_name); a vendor may serve several zones, or none (NULL)."""
    z = catalog["vendor_zones"]
    tenant = z.filter(z.entity == params.entity)
    return explode_structs(tenant, "lg_zones", {"zone_name": "lg_zone_name"}, ["vendor_code"],
                           keep_empty=True).distinct()


def all_zones(catalog: Catalog, params: Params) -> DataFrame:
    """zone_name, id, lg_zone_uuid of live zones, out of country -> city -> zone nesting."""
    c = catalog["countries"]
    cities = explode_structs(c.filter(c.entity == params.entity), "cities", {"zones": "zones"})
    zones = explode_structs(cities, "zones", {
        "zone_name": "name",
        "id": "id",
        "lg_zone_uuid": "lg_zone_uuid",
        "is_active": "is_active",
        "has_settings": "has_default_delivery_area_settings",
    })
    return (zones.filter(F.col("is_active") & F.col("has_settings")
                         & name_allowed(F.col("zone_name"), [params.excluded_zone_pattern]))
            .select("zone_name", "id", "lg_zone_uuid"))
