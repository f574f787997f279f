"""How rows spread over tasks, and what open-ended spans cost."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courierlens import Params, plans
from courierlens.operators.intervals import cut_to_days
from courierlens.operators.spines import densify, fill_forward
from courierlens.plans.vendor_lateness import late_orders, lateness_rows
from courierlens.sources.sample import given_table
from rows import catalog, result, zones

P = Params(entity="home", as_of=date(2024, 2, 1))
TASKS = 8


def per_task(spark, build, merge=True):
    """Rows in each task of the last stage, with ``TASKS`` shuffle partitions, small ones merged or not."""
    settings = {"spark.sql.shuffle.partitions": str(TASKS), "spark.sql.adaptive.coalescePartitions.enabled": str(merge).lower()}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df = build()  # all its columns are used, else the optimizer leaves out what makes them
        rows = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*df.columns))).collect()
        return [r["n"] for r in rows]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_dense_minutes_of_many_keys_and_of_one_spread_over_tasks(spark):
    def ends(keys, days):
        hours = F.expr(f"timestamp_ntz'2020-01-01 12:00:00' + make_dt_interval(0, i * {days} * 24)")
        return spark.range(keys).select(F.concat(F.lit("k"), "id").alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("key", hours.alias("ts"))

    for keys, days in ((30, 5), (1, 800)):
        minutes = densify(ends(keys, days), "key", "ts")
        assert minutes.agg(F.count(F.lit(1)), F.count_distinct("key", "ts")).first() == ((days * 1440 + 1) * keys,) * 2
        tasks = per_task(spark, lambda df=minutes: densify(ends(keys, days), "key", "ts"))
        assert len(tasks) == TASKS and max(tasks) < 3 * sum(tasks) / TASKS


def test_a_hot_day_of_one_key_is_spread_over_its_hours(spark):
    hot = F.col("id") % 3 == 0
    key = F.when(hot, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    seconds = F.when(hot, F.pmod(F.xxhash64("id"), F.lit(86400))).otherwise(F.pmod(F.xxhash64("id"), F.lit(86400 * 30)))
    rows = spark.range(60000).select(
        "id", key.alias("key"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("ts"),
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("value"))
    tasks = per_task(spark, lambda: fill_forward(rows, "key", "ts", "value"), merge=False)
    assert len(tasks) == TASKS and max(tasks) < 3 * sum(tasks) / TASKS

    peers = F.max("value").over(W.partitionBy("key", "ts"))
    whole = W.partitionBy("key").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    literal = rows.withColumn("value", peers).withColumn("value", F.last("value", ignorenulls=True).over(whole))
    filled = fill_forward(rows, "key", "ts", "value")
    assert filled.exceptAll(literal).isEmpty() and filled.count() == literal.count()


def test_a_span_without_end_costs_the_days_there_are(spark):
    spans = spark.createDataFrame([("a", datetime(2024, 1, 2, 10), datetime(2200, 1, 1)), ("a", datetime(2024, 1, 1), None),
                                   (None, datetime(2024, 1, 1), datetime(2024, 1, 9)), ("b", datetime(2024, 1, 9), datetime(2024, 1, 1))],
                                  "k string, s timestamp_ntz, e timestamp_ntz")
    days = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 1, 2)), ("a", date(2150, 5, 5)), ("b", date(2024, 1, 5))], "z string, day date")
    assert result(cut_to_days(spans, days, {"k": "z"}, "s", "e"), "day", "s", "e") == [
        (date(2024, 1, 2), datetime(2024, 1, 2, 10), datetime(2024, 1, 2, 23, 59)),
        (date(2150, 5, 5), datetime(2150, 5, 5), datetime(2150, 5, 5, 23, 59))]


def test_open_events_label_orders_delivered_on_another_day(spark):
    """The event is open until 2200; one order is delivered far behind the window, on a day it is not booked on."""
    event = {"uuid": "e", "lg_zone_uuid": "u-north", "title": "shrink_1", "start_at_local": datetime(2024, 1, 10, 11),
             "end_at_local": datetime(2200, 1, 1)}
    order = {"zone_name": "north", "gpo_excl_wastage": 1.0, "date_local": date(2024, 1, 10)}
    c = catalog(
        spark, countries=[zones("north")], area_events=[event], shop_orders=[], order_vouchers=[], order_discounts=[],
        sessions=[{"ga_session_id": "s", "session_start_timestamp_utc": datetime(2024, 1, 10, 4), "lg_zone_name": "north",
                   "lg_zone_uuid": "u-north"}],
        session_verticals=[{"ga_session_id": "s"}],
        order_profit=[{**order, "order_code": "late", "expected_delivery_at_local": datetime(2024, 6, 3, 12, 5)},
                      {**order, "order_code": "soon", "expected_delivery_at_local": datetime(2024, 1, 10, 12, 5)},
                      {**order, "order_code": "before", "expected_delivery_at_local": datetime(2024, 1, 9, 12, 5)}])
    assert result(plans.daily_conversion_by_shrink(c, P), "hour_", "shrink_event", "total_session", "total_orders") == [
        (12, "shrink_1", 1, 2)]


def test_lateness_takes_memory_of_a_partition_alone(spark):
    """Nothing is held ahead of the shuffle, and small partitions are not merged into larger ones."""
    noon = datetime(2024, 1, 10, 12)
    def late(i, day=10):
        moment = noon.replace(day=day)
        return {"vendor_code": "hot" if i % 3 == 0 else f"v{i % 40}", "order_code": f"o{i}", "rider": (moment, 30, 301, 90, moment), "vendor": (moment,)}

    orders = [late(i) for i in range(2000)] + [late(i) for i in range(100)] + [late(i, 11) for i in range(40)] + [{**late(0), "vendor_code": None}]
    c = catalog(spark, logistics_orders=orders, vendor_zones=[{"vendor_code": "hot", "lg_zones": [("n",)]}],
                vendors=[{"vendor_code": "hot", "name": n, "chain_name": h} for n, h in (("A", "x"), ("A", "y"), ("A", None), ("A", "y"), ("B", "x"))])
    tasks = per_task(spark, lambda: late_orders(c, P))
    assert sum(tasks) == 2040 and len(tasks) == TASKS and max(tasks) < 3 * sum(tasks) / TASKS
    plan = late_orders(c, P)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.split("Exchange")[1]
    # 667 orders on the 10th, 14 on the 11th, 1.5 minutes each, once per chain of a name
    assert result(plans.daily_vendor_lateness(c, P)) == [
        ("hot", "A", "n", date(2024, 1, 10), 667 * 4.5, 667), ("hot", "A", "n", date(2024, 1, 11), 14 * 4.5, 14),
        ("hot", "B", "n", date(2024, 1, 10), 667 * 1.5, 667), ("hot", "B", "n", date(2024, 1, 11), 14 * 1.5, 14)]
    assert lateness_rows(c, P).count() == 681 * 4 == lateness_rows(c, P).distinct().count()


def test_a_rewritten_table_is_read_with_its_new_columns(spark, tmp_path):
    for columns in (["a"], ["a", "b"]):
        spark.range(3).select(*[F.col("id").alias(c) for c in columns]).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
        assert given_table(spark, str(tmp_path), "t").columns == columns
