"""The refreshed window: which partitions a refresh reads, and what late, corrected, moved and vanished rows lead to."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from courierlens import Params
from courierlens.plans import rolling
from courierlens.plans.shrink_conversion import daily_conversion_by_shrink, order_segments, shrink_spans
from courierlens.plans.surge_conversion import daily_conversion_by_surge
from courierlens.registry.refreshes import first_delivery, stored, write_days
from courierlens.sources.catalog import Catalog
from courierlens.sources.day_states import DAY, DayStates
from courierlens.sources.sample import TRAFFIC, sample_catalog
from rows import catalog, result, zones

SF_DIR = "/root/testdata/sf0.001"
P = Params(entity="home", as_of=date(2024, 2, 1))


def read_days(df, column):
    """The partition days of the files that a scan has rows from."""
    files = [r[0] for r in df.select(F.input_file_name()).distinct().collect()]
    return {f.split(f"{column}=")[1].split("/")[0] for f in files}


def partition_filters(df):
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [line for line in plan.splitlines() if line.startswith("PartitionFilters")]


def test_a_refresh_reads_the_changed_days_alone(spark, tmp_path):
    given, folder = sample_catalog(spark, SF_DIR, "traffic"), f"file://{tmp_path}/in"
    for table in rolling.STATES:
        write_days(first_delivery(given, table), folder, table)
    tables, days = stored(given, folder), {date(2024, 1, 10), date(2024, 1, 15)}
    for table, frame in rolling.partial_states(tables, TRAFFIC, days).items():
        column = rolling.STATES[table].day
        filters = partition_filters(frame)
        assert len(filters) == 1 and f"{column}" in filters[0] and "IN (2024-01-10,2024-01-15)" in filters[0]
        assert len(read_days(tables[table], column)) > 2

    states = DayStates.create(spark, f"file://{tmp_path}/states")
    rolling.refresh(states, tables, TRAFFIC, rolling.changed_days({t: tables[t] for t in rolling.STATES}))
    before = states.days("sessions")
    rolling.refresh(states, tables, TRAFFIC, days)
    after = states.days("sessions")
    assert {d for d in after if after[d] != before[d]} == days
    # A window reads its own days, each in one version.
    kind = rolling.partial_states(tables, TRAFFIC)["sessions"].schema
    held = states.read("sessions", kind, date(2024, 1, 9), date(2024, 1, 12))
    assert read_days(held, DAY) <= {f"2024-01-{d:02}" for d in range(9, 13)} and held.count() > 0
    assert "_version" in partition_filters(held)[0] and DAY in partition_filters(held)[0]


def window(spark, sessions, profit, discounts=()):
    orders = [{"uuid": f"u{c}", "code": c, "delivery_fee_local": 0.99} for c in ("a", "b", "c")]
    return catalog(spark, countries=[zones("north")], zone_stats=[], surge_bands=[], area_events=[],
                   sessions=sessions, session_verticals=[{"ga_session_id": s["ga_session_id"], "partition_date": date(2024, 1, d)} for s in sessions for d in (10, 12)],
                   shop_orders=orders, order_vouchers=[{"uuid": o["uuid"], "type": "plain"} for o in orders],
                   order_discounts=list(discounts), order_profit=profit)


def session(name, day, bought=False, zone="north", hour=4):
    return {"ga_session_id": name, "partition_date": date(2024, 1, day), "lg_zone_name": zone, "lg_zone_uuid": f"u-{zone}",
            "session_start_timestamp_utc": datetime(2024, 1, 10, hour), "is_transaction": bought}


def order(code, day, gp=1.0, ads=None):
    return {"order_code": code, "zone_name": "north", "gpo_excl_wastage": gp, "ad_rev_per_order": ads, "date_local": date(2024, 1, day),
            "expected_delivery_at_local": datetime(2024, 1, 10, 12, 5)}


@pytest.mark.parametrize("build", [daily_conversion_by_surge, daily_conversion_by_shrink])
def test_late_corrected_moved_and_vanished_rows(spark, tmp_path, build):
    """A session in two partitions counts once; a day that has lost its rows counts nothing; flags and amounts merge."""
    discount = {"uuid": "ua", "platform_share_pct": 100.0, "discount_type": "x"}
    first = window(spark, [session("s", 10), session("gone", 11), session("moved", 12)],
                   [order("a", 10, 2.0), order("b", 10, 3.0), order("b", 11, 9.0)], [discount])
    second = window(spark, [session("s", 10), session("s", 12, True), session("moved", 14, zone="south"), session("late", 10, True, hour=5)],
                    [order("a", 10, 2.0), order("b", 10, 4.0, 1.0), order("b", 10, None), order("c", 13, 5.0)],
                    [discount, {**discount, "uuid": "ub", "platform_share_pct": 0.0, "created_date_utc": date(2024, 1, 9)}])
    states = DayStates.create(spark, f"file://{tmp_path}/{build.__name__}")
    january = [date(2024, 1, d) for d in range(1, 32)]
    rolling.refresh(states, first, P, january)
    assert result(build(first, P, rolling.window_facts(states, first, P))) == result(build(first, P))
    rolling.refresh(states, second, P, [date(2024, 1, d) for d in range(9, 15)])
    want = result(build(second, P))
    assert want and result(build(second, P, rolling.window_facts(states, second, P))) == want
    # What is not listed does not count: a refresh that was broken off behind its writes.
    broken = rolling.partial_states(first, P, january)
    for table, state in broken.items():
        state.withColumn("_version", F.lit("broken")).write.partitionBy("_version", DAY).mode("append").parquet(f"{tmp_path}/{build.__name__}/{table}")
    assert result(build(second, P, rolling.window_facts(DayStates(spark, f"file://{tmp_path}/{build.__name__}"), second, P))) == want


def test_an_open_event_has_segments_on_the_days_of_orders_alone(spark):
    event = {"uuid": "e", "lg_zone_uuid": "u-north", "title": "shrink_1", "start_at_local": datetime(2024, 1, 10, 11), "end_at_local": datetime(2124, 1, 1)}
    c = catalog(spark, countries=[zones("north", "south")], area_events=[event], order_profit=[
        order("a", 10), {**order("b", 10), "expected_delivery_at_local": datetime(2024, 6, 3, 12, 5)}, {**order("c", 10), "zone_name": "south"}])
    from courierlens.plans.conversion import restaurant_profit
    segments = order_segments(shrink_spans(c, P), restaurant_profit(c, P))
    assert result(segments, "day", "first_minute") == [(date(2024, 1, 10), datetime(2024, 1, 10, 11, 1)), (date(2024, 6, 3), datetime(2024, 6, 3))]


def test_states_need_a_list(spark, tmp_path):
    states = DayStates.create(spark, f"file://{tmp_path}/s")
    assert states.days("sessions") == {}
    c = Catalog.from_frames({})
    with pytest.raises(KeyError):
        rolling.partial_states(c, P)
