"""The eight results on hand-made rows, one case per rule that is easy to get wrong."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from courierlens import Params, plans
from rows import catalog, result, zones

P = Params(entity="home", as_of=date(2024, 2, 1))
DAY = date(2024, 1, 10)


def at(hour, minute=0, second=0, day=10):
    return datetime(2024, 1, day, hour, minute, second)


# Rainfall

def test_rainfall_hour_boundary_and_unknown_zone(spark):
    c = catalog(spark, rain=[
        {"zone": "a", "ts": at(9, 59, 59), "rainfall_mm": 1.0},
        {"zone": "a", "ts": at(10), "rainfall_mm": 2.0},
        {"zone": "a", "ts": at(10, 30), "rainfall_mm": None},
        {"zone": None, "ts": at(10), "rainfall_mm": 4.0},
        {"zone": None, "ts": at(10, 5), "rainfall_mm": 4.0},
    ])
    assert result(plans.daily_rainfall(c, P)) == [(None, DAY, 10, 8.0), ("a", DAY, 10, 2.0), ("a", DAY, 9, 1.0)]


# Order economics

def economics(spark, orders, vouchers, discounts, profit, types=None):
    c = catalog(spark, shop_orders=orders, order_vouchers=vouchers, order_discounts=discounts, order_profit=profit,
                vendor_types=types or [{"vendor_code": "v"}])
    return plans.daily_orders(c, P)


def order(code, **more):
    return {"uuid": f"u{code}", "code": code, "vendor_code": "v", "total_value_local": 20.0,
            "delivery_fee_original_local": 3.0, **more}


def voucher(code, share=0.0, amount=0.0, **more):
    return {"uuid": f"u{code}", "platform_share_pct": share, "value_local": amount, **more}


def discount(code, share=0.0, amount=0.0, **more):
    return {"uuid": f"u{code}", "platform_share_pct": share, "discount_amount_local": amount, **more}


def profit(code, zone="north", gp=1.0, gmv=20.0, **more):
    return {"order_code": code, "zone_name": zone, "gpo_excl_wastage": gp, "gmv_local": gmv, **more}


def test_orders_without_voucher_or_discount_row_drop(spark):
    df = economics(spark, [order("a"), order("b"), order("c")],
                   [voucher("a"), voucher("b")], [discount("a"), discount("c")],
                   [profit("a"), profit("b"), profit("c")])
    assert result(df, "zone_name", "hour", "number_of_orders") == [("north", 12, 1)]


def test_two_voucher_rows_double_sums_but_not_counts(spark):
    df = economics(spark, [order("a")], [voucher("a", 25, 8.0), voucher("a", 25, 8.0)], [discount("a", 50, 4.0)],
                   [profit("a", gp=3.0)])
    assert result(df, "number_of_orders", "number_of_incentive_orders", "total_gp", "gmv_local", "platform_voucher",
                  "vendor_voucher", "platform_discount", "vendor_discount", "avg_min_order_value",
                  "platform_vendor_voucher_ratio", "vendor_voucher_prop") == [
        (1, 2, 6.0, 40.0, 4.0, 12.0, 4.0, 4.0, 20.0, 4.0 / 12.0, 0.3)]


def test_ratios_over_zero_are_null(spark):
    df = economics(spark, [order("a")], [voucher("a", 100, 5.0)], [discount("a", 100, 5.0)], [profit("a", gmv=0.0)])
    assert result(df, "vendor_discount_prop", "platform_vendor_discount_ratio", "platform_vendor_voucher_ratio") == [
        (None, None, None)]


def test_fee_flags(spark):
    fees = {"a": 0.99, "b": 0.93, "c": 1.0, "d": None}
    df = economics(spark, [order(k, delivery_fee_original_local=v) for k, v in fees.items()],
                   [voucher(k, 0.0, 2.0 if k in "ac" else 0.0) for k in fees], [discount(k) for k in fees],
                   [profit(k) for k in fees])
    assert result(df, "number_of_orders", "number_of_incentive_orders", "number_of_low_fee_orders",
                  "number_incentivised_or_low_fee", "number_incentivised_and_low_fee") == [(4, 2, 2, 3, 1)]


def test_net_fee_is_never_negative(spark):
    df = economics(
        spark,
        [order("a", delivery_fee_original_local=2.14, delivery_fee_vat_rate=7.0), order("b")],
        [voucher("a", 50, 1.0, type="free_delivery"), voucher("b", 100, 9.0, type="free_delivery")],
        [discount("a", 50, 1.0, discount_type="amount"), discount("b")], [profit("a"), profit("b")])
    # (2.14 / 1.07 - 0.5) and max(3 - 9, 0) over two orders
    assert result(df, "avg_delivery_fee") == [(0.75,)]


def test_an_order_with_thousands_of_rows_on_both_sides(spark):
    # 9 million pairings, none of which is formed: sums follow from counts.
    n = 3000
    df = economics(
        spark, [order("a", delivery_fee_original_local=0.99)],
        [voucher("a", 50, 2.0 if i % 3 else 0.0, type="free_delivery" if i % 2 else None) for i in range(n)],
        [discount("a", 100, 1.0 if i % 4 == 0 else 0.0) for i in range(n)], [profit("a", gp=1.0), profit("a", gp=2.0)])
    rows = n * n * 2
    unpaid = (n // 3) * (n * 3 // 4) * 2
    # odd vouchers of a non-zero amount waive 1.00, more than the fee; all others leave 0.99
    free = n // 3 * n * 2
    assert result(df, "number_of_orders", "number_of_incentive_orders", "number_of_low_fee_orders",
                  "number_incentivised_or_low_fee", "number_incentivised_and_low_fee", "total_gp", "gmv_local",
                  "platform_voucher", "vendor_discount", "platform_discount", "avg_delivery_fee") == [
        (1, rows - unpaid, rows, rows, rows - unpaid, 3.0 * n * n, 20.0 * rows, 2.0 * (n * 2 // 3) / 2 * n * 2,
         0.0, n / 4 * n * 2, round((rows - free) * 0.99, 2))]


def test_vendor_and_profit_repeats(spark):
    # Two profit rows in two zones, and one order row listed twice under a code
    df = economics(spark, [order("a"), {**order("a"), "uuid": "other"}], [voucher("a", 50, 2.0), {**voucher("a"), "uuid": "other"}],
                   [discount("a"), {**discount("a"), "uuid": "other"}], [profit("a"), profit("a", zone="south", gp=4.0)])
    assert result(df, "zone_name", "number_of_orders", "number_of_incentive_orders", "total_gp", "total_order_value",
                  "platform_voucher") == [("north", 1, 1, 2.0, 40.0, 1.0), ("south", 1, 1, 8.0, 40.0, 1.0)]


@pytest.mark.parametrize("kind, kitchens, expected", [
    ("restaurants", False, 1.0), ("quick_store", False, 3.0), ("restaurants", True, 3.0), ("restaurants", None, 3.0)])
def test_waiver_only_for_partners(spark, kind, kitchens, expected):
    df = economics(spark, [order("a")], [voucher("a", 100, 2.0, type="free_delivery")], [discount("a")], [profit("a")],
                   [{"vendor_code": "v", "business_type_apac": kind, "is_kitchens": kitchens}])
    assert result(df, "avg_delivery_fee") == [(expected,)]


@pytest.mark.parametrize("change", [
    {"minimum_delivery_value_local": None}, {"minimum_delivery_value_local": 25.0}, {"expedition_type": "pickup"},
    {"is_test_order": True}, {"is_test_order": None}, {"is_valid_order": False}, {"entity": "other"},
    {"created_date_utc": date(2024, 2, 1)}, {"expected_delivery_at_local": datetime(2022, 5, 31, 23, 59)},
    {"vendor_code": "dark"}, {"code": None}, {"code": "unprofitable"}])
def test_order_filters(spark, change):
    df = economics(spark, [{**order("a"), **change}], [voucher("a")], [discount("a")],
                   [profit("a"), profit("unprofitable", vendor_business_type="shops")],
                   [{"vendor_code": "v"}, {"vendor_code": "dark", "business_type_apac": "dmart"}])
    assert result(df) == []


# Offline hours

def test_offline_hours(spark):
    c = catalog(
        spark,
        vendors=[{"vendor_code": "v", "name": "Good"}, {"vendor_code": "quiet", "name": "Quiet"},
                 {"vendor_code": "x", "name": "Pay IslandWide"}, {"vendor_code": "y", "name": None},
                 {"vendor_code": "z", "name": "Off", "is_active": False},
                 {"vendor_code": "twin", "name": "Twin", "chain_name": "a"},
                 {"vendor_code": "twin", "name": "Twin", "chain_name": "b"}],
        vendor_zones=[{"vendor_code": "v", "lg_zones": [("n",), ("s",), ("n",)]}, {"vendor_code": "quiet", "lg_zones": []}],
        vendor_offline=[
            # duplicate slots collapse, zero and unknown open time drop, unknown unavailable time is 0
            {"vendor_code": "v", "availabilities": [(17, 20), (17, 20), (0, 50), (None, 50), (19, None)]},
            {"vendor_code": "v", "availabilities": None},
            {"vendor_code": "v", "report_date": date(2021, 12, 31), "availabilities": [(3600, 0)]},
            {"vendor_code": "twin", "availabilities": [(3600, 1800)]},
        ])
    # 17 s and 19 s round to 0.00 and 0.01 hours before they are added
    assert result(plans.daily_offline_hours(c, P)) == [
        ("quiet", "Quiet", None, None, None, None),
        ("twin", "Twin", DAY, None, 1.0, 2.0),
        ("v", "Good", DAY, "n", 0.01, 0.01),
        ("v", "Good", DAY, "s", 0.01, 0.01),
    ]


# Vendor lateness

def test_vendor_lateness(spark):
    def late(code, seconds, **more):
        return {"vendor_code": "v", "order_code": code, "rider": (at(12), seconds, 301, 90, at(12)),
                "vendor": (at(12, 3),), **more}

    c = catalog(
        spark, vendors=[{"vendor_code": "v", "name": "Good", "chain_name": "c"}],
        vendor_zones=[{"vendor_code": "v", "lg_zones": [("n",), ("s",)]}],
        logistics_orders=[late("a", 30), late("a", 30), late("a", 599), late("b", 600), late("c", 0), late(None, 700),
                          late("d", 1, entity="other"), late("e", 1, created_date_utc=date(2024, 2, 1)),
                          late("f", 1, vendor_code="gone")])
    # a 1.5 (its repeats are one row), b nothing, c 3.0, no code: nothing and not counted
    assert result(plans.daily_vendor_lateness(c, P)) == [
        ("v", "Good", "n", DAY, 4.5, 3), ("v", "Good", "s", DAY, 4.5, 3)]


# Active vendors

def test_active_vendors(spark):
    p = Params(entity="home", as_of=date(2022, 1, 5))
    c = catalog(
        spark,
        vendors=[{"vendor_code": v, "name": "Good", "is_active": False} for v in ("open", "short", "two", "past", "nozone")],
        vendor_zones=[{"vendor_code": "open", "lg_zones": [("n",), ("s",)]}, {"vendor_code": "short", "lg_zones": [("n",)]},
                      {"vendor_code": "two", "lg_zones": [("n",)]}, {"vendor_code": "past", "lg_zones": [("w",)]}],
        crm_accounts=[{"id": f"a-{v}", "vendor_code": v} for v in ("open", "short", "two", "past", "nozone")],
        crm_contracts=[
            {"sf_account_id": "a-open", "start_date_local": date(2022, 1, 2)},
            {"sf_account_id": "a-short", "start_date_local": date(2021, 12, 1), "end_date_local": date(2022, 1, 1)},
            # latest start of one contract, latest end of the other
            {"sf_account_id": "a-two", "start_date_local": date(2022, 1, 3), "end_date_local": date(2022, 1, 3)},
            {"sf_account_id": "a-two", "start_date_local": date(2021, 6, 1), "end_date_local": date(2022, 1, 4)},
            {"sf_account_id": "a-past", "start_date_local": date(2020, 1, 1), "end_date_local": date(2020, 2, 1)},
            {"sf_account_id": "a-nozone", "start_date_local": date(2022, 1, 1)},
        ])
    days = [date(2022, 1, d) for d in (1, 2, 3, 4)]
    got = {(d, z): n for d, z, n in result(plans.daily_active_vendors(c, p))}
    assert [got[d, "n"] for d in days] == [1, 1, 2, 2]
    assert [got[d, "s"] for d in days] == [0, 1, 1, 1]
    assert [got[d, "w"] for d in days] == [0, 0, 0, 0]
    assert len(got) == 12


# Conversion by shrink level

def visit(session, utc, zone="north", uuid=None, bought=None):
    return {"ga_session_id": session, "session_start_timestamp_utc": utc, "lg_zone_name": zone,
            "lg_zone_uuid": uuid or f"u-{zone}", "is_transaction": bought}


def event(title, start, end, uuid="u-north", **more):
    return {"uuid": title, "lg_zone_uuid": uuid, "title": title, "start_at_local": start, "end_at_local": end, **more}


def shrink(spark, sessions, events, profits=(), orders=(), vouchers=(), discounts=(), verticals=None):
    c = catalog(
        spark, countries=[zones("north", "south")], sessions=sessions, area_events=events,
        session_verticals=verticals or [{"ga_session_id": s["ga_session_id"]} for s in sessions],
        order_profit=list(profits), shop_orders=list(orders), order_vouchers=list(vouchers),
        order_discounts=list(discounts))
    return plans.daily_conversion_by_shrink(c, P)


def test_shrink_minutes_are_trimmed_at_both_ends(spark):
    # In force from 12:01 to 12:09: the first and the last started minute do not count.
    sessions = [visit(f"s{m}", at(4, m, 30)) for m in (0, 1, 9, 10)]
    df = shrink(spark, sessions, [event("shrink_1", at(12, 0, 30), at(12, 10, 30))])
    assert result(df, "hour_", "shrink_event", "total_session") == [(12, "no_shrink", 2), (12, "shrink_1", 2)]


def test_short_events_and_unknown_ends_touch_nothing(spark):
    df = shrink(spark, [visit("a", at(4, 0))],
                [event("shrink_1", at(12, 0), at(12, 1, 30)), event("shrink_2", at(11, 0), None),
                 event(None, at(11, 0), at(13, 0)), event("rain", at(11, 0), at(13, 0)),
                 event("shrink_3", at(11), at(13), activation_type="manual"),
                 event("shrink_4", at(11), at(13), is_shape_in_sync=None)])
    assert result(df, "shrink_event", "total_session") == [("no_shrink", 1)]


def test_overlapping_events_count_sessions_per_label_and_sum_orders_per_event(spark):
    events = [event("shrink_1 x", at(11), at(13)), event("shrink_1 y", at(11), at(13)), event("shrink_2", at(11), at(13))]
    df = shrink(spark, [visit("a", at(4), bought=True), visit("a", at(4, 1))], events,
                [profit("p", gp=5.0, ad_rev_per_order=1.0)])
    assert result(df, "shrink_event", "total_transaction", "total_session", "total_orders", "total_gp",
                  "total_gp_wo_ad") == [("shrink_1", 1, 1, 1, 10.0, 8.0), ("shrink_2", 1, 1, 1, 5.0, 4.0)]


def test_event_across_midnight(spark):
    df = shrink(spark, [visit("a", at(15, 59)), visit("b", at(16, 1)), visit("c", at(18, 0))],
                [event("close", at(23, 0), at(1, 30, day=11))])
    assert result(df, "date_", "hour_", "shrink_event", "total_session") == [
        (DAY, 23, "close", 1), (date(2024, 1, 11), 0, "close", 1), (date(2024, 1, 11), 2, "no_shrink", 1)]


def test_closed_zone_shows_no_orders_but_keeps_profit(spark):
    df = shrink(spark, [visit("a", at(4, 30))], [event("Close", at(11), at(13))], [profit("p", gp=5.0)])
    assert result(df, "shrink_event", "total_orders", "total_gp") == [("close", 0, 5.0)]


def test_unknown_zone_id_labels_sessions_but_not_orders(spark):
    df = shrink(spark, [visit("a", at(4, 30), zone="lost", uuid="u-lost")], [event("shrink_0", at(11), at(13), uuid="u-lost")],
                [profit("p", zone="lost", gp=5.0)])
    assert result(df, "shrink_event", "total_orders", "total_gp") == [("shrink_0", 0, 0.0)]


def incentivised(spark, fee=0.99, share=100.0, kind=None, voucher_kind=None, code="p"):
    return {"orders": [order(code, delivery_fee_local=fee) | {"uuid": "up"}],
            "vouchers": [voucher("p", type=voucher_kind), voucher("p")],
            "discounts": [discount("p", share, discount_type=kind)]}


@pytest.mark.parametrize("change, removed", [
    ({}, True), ({"share": None}, True), ({"share": 50.0}, False), ({"fee": 2.0}, False), ({"fee": None}, False),
    ({"fee": 2.0, "kind": "x_FREE_delivery"}, True), ({"fee": None, "voucher_kind": "free_delivery"}, True),
    ({"code": None}, True)])
def test_fee_incentivised_orders_are_left_out(spark, change, removed):
    # A NULL code in the list empties it all, as NOT IN does.
    df = shrink(spark, [visit("a", at(4, 30))], [], [profit("p", gp=5.0)], **incentivised(spark, **change))
    assert result(df, "total_orders", "total_gp") == [(0, 0.0) if removed else (1, 5.0)]


def test_unknown_order_codes_leave_only_next_to_a_list(spark):
    sessions = [visit("a", at(4, 30))]
    rows = [profit(None, gp=5.0), profit("q", gp=2.0)]
    assert result(shrink(spark, sessions, [], rows), "total_orders", "total_gp") == [(1, 7.0)]
    assert result(shrink(spark, sessions, [], rows, **incentivised(spark)), "total_orders", "total_gp") == [(1, 2.0)]


def test_session_filters(spark):
    sessions = [visit("ok", at(4)), visit("pickup", at(4)), visit("blind", at(4)), visit("gone", at(4)),
                visit("zoneless", at(4), zone=None, uuid="u-north"), visit("late", datetime(2024, 1, 31, 16, 0))]
    verticals = [{"ga_session_id": "ok"}, {"ga_session_id": "ok"},
                 {"ga_session_id": "pickup", "expedition_type": "pickup"},
                 {"ga_session_id": "blind", "has_restaurants_impression": None},
                 {"ga_session_id": "zoneless"}, {"ga_session_id": "late"}]
    df = shrink(spark, sessions, [], verticals=verticals)
    assert result(df, "lg_zone_name", "total_session", "total_transaction") == [("north", 1, 0)]


# Conversion by surge level

def stat(utc, *delays, zone="u-north", **more):
    return {"lg_zone_uuid": zone, "created_at_utc": utc, "stats": [(d,) for d in delays], **more}


def band(low, high, label, fee, day=DAY, zone="north"):
    return {"date_updated": day, "zone_name": zone, "surge_event": label, "mean_delay_start": low,
            "mean_delay_end": high, "surge_fee": fee}


BANDS = [band(-1.0, 2.0, "none", 0.5), band(2.0, 4.0, "mild", 1.0), band(5.0, 8.0, "hard", 2.0),
         band(4.2, 4.3, "odd", 2.0)]


def surge(spark, sessions, stats, bands=BANDS, profits=()):
    c = catalog(
        spark, countries=[zones("north", "south")], sessions=sessions, zone_stats=stats, surge_bands=list(bands),
        session_verticals=[{"ga_session_id": s["ga_session_id"]} for s in sessions],
        order_profit=list(profits), shop_orders=[], order_vouchers=[], order_discounts=[])
    return plans.daily_conversion_by_surge(c, P)


def labels(df):
    return [r[0] for r in result(df, "surge_event")]


@pytest.mark.parametrize("delay, expected", [
    (1.0, ["none"]), (2.0, ["mild", "none"]), (4.5, [None]), (-1.0, ["none"]), (-1.01, ["none"]),
    (8.0, ["hard"]), (8.01, ["hard", "odd"]), (1.999, ["mild", "none"])])
def test_band_edges_holes_and_clamps(spark, delay, expected):
    assert labels(surge(spark, [visit("a", at(4, 0, 20))], [stat(at(4, 0, 40), delay)])) == expected


def test_delay_is_carried_forward_to_the_last_minute_of_the_zone(spark):
    stats = [stat(at(4, 0), 1.0), stat(at(4, 5), None), stat(at(4, 10), 6.0), stat(at(4, 20), None)]
    sessions = [visit(f"s{m}", at(4, m)) for m in (7, 10, 20, 21)] + [visit("early", at(3, 59))]
    df = surge(spark, sessions, stats)
    # 12:07 still 1.0; 12:10 and 12:20 6.0; behind the last row and before the first nothing
    assert result(df, "hour_", "surge_event", "total_session") == [
        (11, None, 1), (12, None, 1), (12, "hard", 2), (12, "none", 1)]


def test_observation_before_the_window_reaches_into_it(spark):
    p_first = P.lookback_start
    stats = [stat(datetime(2023, 11, 1, 0, 0), 6.0, created_date_utc=date(2023, 11, 1)),
             stat(datetime(2023, 11, 2, 0, 0), 3.0, created_date_utc=date(2023, 11, 2)),
             stat(datetime(2024, 1, 20), None)]
    first = datetime(p_first.year, p_first.month, p_first.day, 1)
    sessions = [{**visit("a", datetime(2023, 11, 30, 0, 30)), "partition_date": p_first}, visit("b", at(4))]
    bands = [*BANDS, band(2.0, 4.0, "first day", 1.0, day=p_first)]
    assert first > datetime(2023, 11, 2)
    assert result(surge(spark, sessions, stats, bands), "date_", "surge_event") == [(p_first, "first day"), (DAY, "mild")]


def test_peers_in_a_minute_take_the_larger_delay(spark):
    assert labels(surge(spark, [visit("a", at(4))], [stat(at(4, 0, 1), 1.0, 6.0), stat(at(4, 0, 50), 3.0)])) == ["hard"]


def test_bands_follow_the_local_date(spark):
    sessions = [visit("a", at(15, 30)), visit("b", at(16, 30))]
    bands = [*BANDS, band(0.0, 9.0, "next day", 1.0, day=date(2024, 1, 11))]
    df = surge(spark, sessions, [stat(at(15, 0), 1.0), stat(at(17, 0), 1.0)], bands)
    assert result(df, "date_", "hour_", "surge_event") == [(DAY, 23, "none"), (date(2024, 1, 11), 0, "next day")]


def test_cheapest_ties_give_one_row_per_label(spark):
    bands = [band(-1.0, 2.0, "a", 0.5), band(2.0, 4.0, "b", 0.5), band(4.0, 6.0, None, 0.5)]
    assert labels(surge(spark, [visit("s", at(4))], [stat(at(4), -3.0)], bands)) == [None, "a", "b"]


def test_profit_joins_by_its_own_label_and_stays_null_without_match(spark):
    sessions = [visit("a", at(4, 30)), visit("b", at(4, 31), zone="south")]
    bands = [band(0.0, 9.0, "no_surge", 1.0)]
    df = surge(spark, sessions, [stat(at(4), 1.0), stat(at(5), 1.0)], bands,
               [profit("p", gp=5.0), profit("q", gp=2.0, surge_event="no_surge", sub_rev_per_order=0.5), profit("r", zone="south")])
    # profit without a label and with 'no_surge' are one group; a session without a label matches nothing
    assert result(df, "lg_zone_name", "surge_event", "total_orders", "total_gp", "total_gp_wo_ad") == [
        ("north", "no_surge", 2, 7.0, 6.5), ("south", None, None, None, None)]


# Funnel

def click(action, session="s", **more):
    return {"event_action": action, "ga_session_id": session, **more}


def funnel(spark, events, orders=(), types=None):
    c = catalog(spark, web_events=events, shop_orders=list(orders), vendor_types=types or [{"vendor_code": "v"}])
    return plans.daily_restaurant_conversion_funnel(c, P)


COUNTS = ("mcvr2_denominator", "mcvr2_numerator", "mcvr3_denominator", "mcvr3_numerator", "mcvr4_denominator",
          "mcvr4_numerator", "cvr_denominator", "cvr_numerator", "mocvr_numerator")


def test_steps_of_a_full_session(spark):
    events = [click("shop_list.loaded"), click("shop_details.loaded"), click("checkout.loaded"),
              click("transaction", order_code="o"), click("shop_list.updated", "t"), click(None, "u"),
              click("home_screen.loaded", "h", vendor_type="homescreen")]
    df = funnel(spark, events, [order("o")])
    assert result(df, "vertical", *COUNTS) == [
        ("platform", 2, 1, 1, 1, 1, 1, 3, 1, 1), ("restaurants", 2, 1, 1, 1, 1, 1, 2, 1, 1)]


def test_an_order_seen_from_two_sources_counts_once_by_priority(spark):
    events = [click("transaction", "a", order_code="o", traffic_source="search engine"),
              click("transaction", "b", order_code="o", traffic_source="direct"),
              click("transaction", "c", order_code="o", traffic_source=None),
              click("transaction", "d", order_code=None, traffic_source="social"),
              click("transaction", "e", order_code=None, traffic_source="direct")]
    df = funnel(spark, events, [order("o")]).filter("vertical = 'platform'")
    assert result(df, "traffic_source", "cvr_denominator", "cvr_numerator", "mocvr_numerator") == [("direct", 2, 2, 1)]


def test_orders_of_other_verticals_and_unknown_orders(spark):
    events = [click("transaction", "a", order_code="shop"), click("transaction", "b", order_code="food"),
              click("transaction", "c", order_code="unknown"), click("transaction", "d", order_code="test")]
    orders = [order("shop", vendor_code="w"), order("food"), order("test", is_test_order=True)]
    df = funnel(spark, events, orders, [{"vendor_code": "v"}, {"vendor_code": "w", "business_type_apac": "shops"}])
    assert result(df, "vertical", "cvr_denominator", "cvr_numerator", "mocvr_numerator") == [
        ("platform", 4, 4, 2), ("restaurants", 4, 1, 1)]


def test_unmatched_restaurant_sessions_show_no_keys(spark):
    events = [click("navigation.clicked", "n", vendor_type=None, screen_name="my_order", zone_name="south"),
              click("shop_list.loaded", "m", vendor_type="caterers", zone_name="west"),
              click("shop_list.loaded", "k", vendor_type="restaurants", zone_name=None)]
    df = funnel(spark, events).filter("vertical = 'restaurants'")
    assert result(df, "platform", "zone_name", "mcvr2_denominator", "cvr_denominator") == [
        (None, None, None, 1),   # sessions only, zone south
        (None, None, None, 1),   # an unknown zone matches nothing: once without keys ...
        ("ios", None, 1, None),  # ... and once without session counts
        ("ios", "west", 1, None),
    ]


def test_platform_orders_need_all_keys(spark):
    events = [click("transaction", order_code="o", zone_name=None), click("transaction", "t", order_code="x", zone_name="west")]
    df = funnel(spark, events, [order("o")]).filter("vertical = 'platform'")
    assert result(df, "zone_name", "cvr_numerator", "mocvr_numerator") == [(None, 1, None), ("west", 1, None)]


def test_events_without_session_keep_their_key(spark):
    df = funnel(spark, [click("shop_list.loaded", None)])
    assert result(df, "vertical", "mcvr2_denominator", "cvr_denominator") == [("platform", 0, 0), ("restaurants", 0, 0)]
