"""Hand-made input tables: name the columns that matter, the rest is NULL or a default."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import SparkSession
from pyspark.sql.types import DoubleType, StructType

from courierlens.sources.catalog import Catalog
from courierlens.sources.schemas import SCHEMAS

HOME = "home"

DEFAULTS = {
    "area_events": {"entity": HOME, "activation_type": "automatic", "is_active": True, "is_shape_in_sync": True,
                    "created_date_utc": date(2024, 1, 10)},
    "zone_stats": {"entity": HOME, "created_date_utc": date(2024, 1, 10)},
    "shop_orders": {"entity": HOME, "expedition_type": "delivery", "created_date_utc": date(2024, 1, 10),
                    "ordered_at_date_local": date(2024, 1, 10), "is_test_order": False, "is_valid_order": True,
                    "is_gross_order": True, "expected_delivery_at_local": datetime(2024, 1, 10, 12, 30),
                    "minimum_delivery_value_local": 10.0, "delivery_fee_vat_rate": 0.0},
    "vendors": {"entity": HOME, "vertical": "Restaurant", "is_active": True, "is_test": False},
    "crm_accounts": {"entity": HOME},
    "crm_contracts": {"entity": HOME},
    "order_profit": {"vendor_business_type": "restaurants", "date_local": date(2024, 1, 10),
                     "expected_delivery_at_local": datetime(2024, 1, 10, 12, 30)},
    "vendor_offline": {"entity": HOME, "report_date": date(2024, 1, 10)},
    "session_verticals": {"entity": HOME, "partition_date": date(2024, 1, 10), "expedition_type": "delivery",
                          "has_restaurants_impression": True},
    "sessions": {"entity": HOME, "partition_date": date(2024, 1, 10)},
    "order_discounts": {"entity": HOME, "created_date_utc": date(2024, 1, 10)},
    "order_vouchers": {"entity": HOME, "created_date_utc": date(2024, 1, 10)},
    "vendor_types": {"entity": HOME, "business_type_apac": "restaurants", "is_kitchens": False},
    "vendor_zones": {"entity": HOME},
    "countries": {"entity": HOME},
    "logistics_orders": {"entity": HOME, "created_date_local": date(2024, 1, 10),
                         "created_date_utc": date(2024, 1, 10)},
    "web_events": {"date_local": date(2024, 1, 10), "hour_": 12, "platform": "ios", "zone_name": "north",
                   "traffic_source": "direct", "channel_grouping": "paid", "vendor_type": "restaurants"},
}


def _typed(value, kind):
    return float(value) if isinstance(value, int) and isinstance(kind, DoubleType) else value


def catalog(spark: SparkSession, **tables) -> Catalog:
    frames = {}
    for name, rows in tables.items():
        schema = StructType.fromDDL(SCHEMAS[name])
        base = DEFAULTS.get(name, {})
        data = [tuple(_typed({**base, **row}.get(f.name), f.dataType) for f in schema.fields) for row in rows]
        for row in rows:
            assert set(row) <= set(schema.fieldNames()), (name, set(row) - set(schema.fieldNames()))
        frames[name] = spark.createDataFrame(data, schema)
    return Catalog.from_frames(frames)


def zones(*names, **changes):
    """A countries row holding active zones with uuid 'u-<name>'."""
    items = []
    for i, name in enumerate(names):
        zone = {"name": name, "id": i, "lg_zone_uuid": f"u-{name}", "is_active": True,
                "has_default_delivery_area_settings": True, **changes}
        items.append((zone["name"], zone["id"], zone["lg_zone_uuid"], zone["is_active"],
                      zone["has_default_delivery_area_settings"]))
    return {"cities": [([*items],)]}


def result(df, *columns):
    """Rows as a sorted list of tuples."""
    rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))
