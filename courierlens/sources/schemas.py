"""The 19 input tables, as Spark DDL."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "rain": "zone string, ts timestamp_ntz, rainfall_mm double",
    "countries": (
        "entity string, cities array<struct<zones: array<struct<name: string, id: bigint, "
        "lg_zone_uuid: string, is_active: boolean, has_default_delivery_area_settings: boolean>>>>"
    ),
    "area_events": (
        "uuid string, lg_zone_uuid string, activation_threshold double, deactivation_threshold double, "
        "title string, start_at_local timestamp_ntz, end_at_local timestamp_ntz, created_date_utc date, "
        "entity string, activation_type string, is_active boolean, is_shape_in_sync boolean"
    ),
    "logistics_orders": (
        "entity string, vendor_code string, order_code string, created_date_local date, created_date_utc date, "
        "rider struct<promised_delivery_at_local: timestamp_ntz, rider_late_in_seconds: bigint, "
        "at_vendor_time_in_seconds: bigint, at_vendor_time_cleaned_in_seconds: bigint, "
        "original_scheduled_pickup_at_local: timestamp_ntz>, "
        "vendor struct<picked_up_at_local: timestamp_ntz>"
    ),
    "zone_stats": (
        "entity string, lg_zone_uuid string, created_at_utc timestamp_ntz, created_date_utc date, "
        "stats array<struct<mean_delay_in_minutes: double>>"
    ),
    "shop_orders": (
        "entity string, uuid string, code string, vendor_code string, expedition_type string, "
        "expected_delivery_at_local timestamp_ntz, created_date_utc date, ordered_at_date_local date, "
        "minimum_delivery_value_local double, total_value_local double, delivery_fee_original_local double, "
        "delivery_fee_vat_rate double, delivery_fee_local double, is_test_order boolean, "
        "is_valid_order boolean, is_gross_order boolean"
    ),
    "vendors": (
        "entity string, vendor_code string, chain_name string, name string, vertical string, "
        "is_active boolean, is_test boolean"
    ),
    "crm_accounts": "entity string, id string, vendor_code string",
    "crm_contracts": "entity string, sf_account_id string, start_date_local date, end_date_local date",
    "web_events": (
        "date_local date, hour_ int, platform string, zone_name string, traffic_source string, "
        "channel_grouping string, ga_session_id string, order_code string, event_action string, "
        "vendor_type string, screen_name string"
    ),
    "order_profit": (
        "order_code string, zone_name string, vendor_business_type string, date_local date, "
        "expected_delivery_at_local timestamp_ntz, gpo_excl_wastage double, gmv_local double, "
        "ad_rev_per_order double, sub_rev_per_order double, surge_event string"
    ),
    "surge_bands": (
        "date_updated date, zone_name string, surge_event string, mean_delay_start double, "
        "mean_delay_end double, surge_fee double"
    ),
    "vendor_offline": (
        "entity string, vendor_code string, report_date date, "
        "availabilities array<struct<total_open_seconds: bigint, total_unavailable_seconds: bigint>>"
    ),
    "session_verticals": (
        "entity string, ga_session_id string, partition_date date, expedition_type string, "
        "has_restaurants_impression boolean"
    ),
    "sessions": (
        "entity string, ga_session_id string, lg_zone_uuid string, lg_zone_name string, "
        "session_start_timestamp_utc timestamp_ntz, is_transaction boolean, partition_date date"
    ),
    "order_discounts": (
        "entity string, uuid string, discount_type string, platform_share_pct double, "
        "discount_amount_local double, created_date_utc date"
    ),
    "order_vouchers": (
        "entity string, uuid string, type string, platform_share_pct double, value_local double, "
        "created_date_utc date"
    ),
    "vendor_types": "entity string, vendor_code string, business_type_apac string, is_kitchens boolean",
    "vendor_zones": "entity string, vendor_code string, lg_zones array<struct<lg_zone_name: string>>",
}
