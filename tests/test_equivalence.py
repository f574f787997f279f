"""Rewritten forms against the literal ones, on random rows with NULLs and duplicates."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from courierlens import Params
from courierlens.operators.intervals import active_count, attribute_minute, coverage_segments, validity_intervals
from courierlens.operators.joins import clamped_band_label, exists_flag, not_in, semi_in, stats_join
from courierlens.operators.nested import explode_structs
from courierlens.operators.spines import date_spine, densify, fill_forward, latest_before, minute_spine
from rows import result

SEEDS = [1, 2, 3, 4]
START = datetime(2024, 1, 1, 20, 0)


def minute(rng, spread):
    return START + timedelta(minutes=rng.randrange(spread))


def spans(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        start = minute(rng, 600)
        end = rng.choice([start + timedelta(minutes=rng.randrange(-5, 400)), start, None])
        rows.append((rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice(["x", "y"]), start, end))
    return spark.createDataFrame(rows, "key string, label string, a timestamp_ntz, b timestamp_ntz")


@pytest.mark.parametrize("seed", SEEDS)
def test_coverage_equals_expanded_minutes(spark, seed):
    df = spans(spark, seed)
    literal = (minute_spine(df, F.col("a"), F.col("b")).groupBy("key", "label", "minute")
               .agg(F.count(F.lit(1)).alias("n")))
    segments = coverage_segments(df, ["key", "label"], "a", "b", "n")
    again = minute_spine(segments, F.col("a"), F.col("b")).select("key", "label", "minute", "n")
    assert result(again) == result(literal, "key", "label", "minute", "n")


@pytest.mark.parametrize("seed", SEEDS)
def test_attribution_equals_minute_join(spark, seed):
    rng = random.Random(seed)
    facts = spark.createDataFrame(
        [(i, rng.choice(["a", "b", "hot", "hot", None]), minute(rng, 1100) + timedelta(seconds=rng.randrange(60)))
         for i in range(300)], "id int, zone string, ts timestamp_ntz")
    df = spans(spark, seed)
    minutes = minute_spine(df, F.col("a"), F.col("b")).withColumn("m", F.date_format("minute", "yyyyMMddHHmm"))
    literal = (facts.withColumn("f", F.date_format("ts", "yyyyMMddHHmm")).alias("f")
               .join(minutes.alias("m"), F.expr("f.zone = m.key AND f.f = m.m"), "left")
               .groupBy("id", "label").agg(F.count(F.col("key")).alias("n")))
    segments = coverage_segments(df, ["key", "label"], "a", "b", "n")
    fast = attribute_minute(facts, segments, {"zone": "key"}, F.col("ts"), "a", "b", ["label", "n"])
    assert result(fast.select("id", "label", F.coalesce("n", F.lit(0)))) == result(literal, "id", "label", "n")


def observations(spark, seed):
    rng = random.Random(seed)
    rows = {}
    for _ in range(80):
        rows[rng.choice(["a", "hot", "hot"]), minute(rng, 3600)] = rng.choice([None, round(rng.uniform(-3, 9), 2)])
    return spark.createDataFrame([(k, t, v) for (k, t), v in rows.items()], "zone string, minute timestamp_ntz, delay double")


@pytest.mark.parametrize("seed", SEEDS)
def test_fill_forward_equals_one_window_per_key(spark, seed):
    df = observations(spark, seed)
    dense = densify(df, "zone", "minute").join(df, ["zone", "minute"], "left")
    dense.createOrReplaceTempView("dense")
    literal = spark.sql("""SELECT zone, minute, last_value(delay) IGNORE NULLS OVER (PARTITION BY zone ORDER BY minute) AS delay
                           FROM dense""")
    assert result(fill_forward(dense, "zone", "minute", "delay"), "zone", "minute", "delay") == result(literal)


def test_fill_forward_with_peers_and_an_unknown_key(spark):
    rows = [("a", START, 1.0), ("a", START, 3.0), ("a", START, None), ("a", START + timedelta(days=3), None),
            (None, START, None), (None, START + timedelta(minutes=1), 5.0), (None, START + timedelta(days=1), None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    assert result(fill_forward(df, "k", "ts", "v"), "k", "v") == [
        (None, None), (None, 5.0), (None, 5.0), ("a", 3.0), ("a", 3.0), ("a", 3.0), ("a", 3.0)]


@pytest.mark.parametrize("seed", SEEDS)
def test_validity_equals_filled_spine(spark, seed):
    df = observations(spark, seed)
    dense = densify(df, "zone", "minute").join(df, ["zone", "minute"], "left")
    literal = fill_forward(dense, "zone", "minute", "delay").filter("delay IS NOT NULL")
    pieces = validity_intervals(df, "zone", "minute", "delay")
    assert pieces.filter("to_date(start_minute) != day OR to_date(end_minute) != day").count() == 0
    again = minute_spine(pieces, F.col("start_minute"), F.col("end_minute"), "m").select("zone", "m", "delay")
    assert result(again) == result(literal, "zone", "minute", "delay")


@pytest.mark.parametrize("seed", SEEDS)
def test_folded_history_gives_the_same_window(spark, seed):
    df = observations(spark, seed)
    first, last = START + timedelta(minutes=900), START + timedelta(minutes=2400)
    low, high = F.lit(str(first)).cast("timestamp_ntz"), F.lit(str(last)).cast("timestamp_ntz")

    def window(pieces):
        minutes = minute_spine(pieces, F.col("start_minute"), F.col("end_minute"), "m")
        return result(minutes.filter(F.col("m").between(low, high)), "zone", "m", "delay")

    folded = latest_before(df, ["zone"], "minute", "delay", low, high)
    assert folded.count() <= df.count()
    assert window(validity_intervals(folded, "zone", "minute", "delay")) == window(
        validity_intervals(df, "zone", "minute", "delay"))


@pytest.mark.parametrize("seed", SEEDS)
def test_clamped_labels_equal_the_rule(spark, seed):
    rng = random.Random(seed)
    day = [date(2024, 1, 1), date(2024, 1, 2)]
    bands = {(rng.choice(day), rng.choice(["a", "b"]), rng.choice(["l1", "l2", None]), float(low), float(low + rng.choice([1, 2])),
              rng.choice([0.5, 1.0, None])) for low in [rng.randrange(-2, 6) for _ in range(14)]}
    values = [(i, rng.choice(day), rng.choice(["a", "b", "c"]), rng.choice([None, float(rng.randrange(-4, 10))])) for i in range(80)]

    def labels(on, zone, delay):
        """Below the floor those of the lowest fee, beyond all ends those of the highest, else of the bands around it."""
        mine = [b for b in bands if b[:2] == (on, zone)]
        fees = [b[5] for b in mine if b[5] is not None]
        if delay is None or not mine:
            return {None}
        if delay < -1:
            held = [b for b in mine if fees and b[5] == min(fees)]
        elif delay > max(b[4] for b in mine):
            held = [b for b in mine if fees and b[5] == max(fees)]
        else:
            held = [b for b in mine if b[3] <= delay <= b[4]]
        return {b[2] for b in held} or {None}

    by_rule = spark.createDataFrame([(i, x) for i, on, zone, delay in values for x in labels(on, zone, delay)], "id int, label string")
    bands = spark.createDataFrame(list(bands), "day date, zone string, label string, low double, high double, fee double")
    values = spark.createDataFrame(values, "id int, day date, zone string, delay double")
    fast = clamped_band_label(values, bands, {"zone": "zone", "day": "day"}, "delay", "low", "high", "fee", "label", -1.0)
    assert result(fast, "id", "label") == result(by_rule, "id", "label")


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("members", ["none", "plain", "with null"])
def test_membership_equals_sql(spark, seed, members):
    rng = random.Random(seed)
    spark.createDataFrame([(i, rng.choice(["a", "b", "c", "d", None])) for i in range(50)], "id int, k string"
                          ).createOrReplaceTempView("facts")
    keys = {"none": [], "plain": ["a", "c", "a"], "with null": ["a", None]}[members]
    spark.createDataFrame([(k,) for k in keys], "m string").createOrReplaceTempView("members")
    facts, sub = spark.table("facts"), spark.table("members")
    assert result(not_in(facts, "k", sub, "m")) == result(spark.sql("SELECT * FROM facts WHERE k NOT IN (SELECT m FROM members)"))
    inside = spark.sql("SELECT * FROM facts WHERE k IN (SELECT m FROM members)")
    assert result(semi_in(facts, "k", sub, "m")) == result(inside)
    assert result(exists_flag(facts, "k", sub, "m", "hit").filter("hit"), "id", "k") == result(inside)
    assert exists_flag(facts, "k", sub, "m", "hit").count() == 50


@pytest.mark.parametrize("seed", SEEDS)
def test_active_count_equals_every_day_of_every_span(spark, seed):
    rng = random.Random(seed)
    base = date(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", "hot", "hot"]), base + timedelta(days=rng.randrange(-20, 40)),
             base + timedelta(days=rng.randrange(-20, 60))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, zone string, s date, e date")
    first, last = base, base + timedelta(days=30)
    literal = (date_spine(df, F.lit(first), F.lit(last), "day").groupBy("day", "zone")
               .agg(F.count_if(F.col("day").between(F.col("s"), F.col("e"))).alias("n")))
    assert result(active_count(df, "zone", "s", "e", first, last, "day", "n")) == result(literal, "day", "zone", "n")


def test_unnest_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [("x",), (None,)])], "id int, items array<struct<name: string>>")
    assert result(explode_structs(df, "items", {"n": "name"}, ["id"])) == [(3, None), (3, "x")]
    assert result(explode_structs(df, "items", {"n": "name"}, ["id"], keep_empty=True)) == [
        (1, None), (2, None), (3, None), (3, "x")]


def test_reversed_series_is_empty_not_an_error(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:02' AS a, TIMESTAMP_NTZ '2024-01-01 00:01' AS b")
    assert minute_spine(df, F.col("a"), F.col("b")).count() == 0
    assert result(minute_spine(df, F.col("a"), F.col("b"), keep_empty=True), "minute") == [(None,)]


def test_full_join_of_statistics_shows_left_keys_only(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 3), ("b", 4), (None, 5)], "k string, y int")
    assert result(stats_join(left, right, ["k"], "full")) == [(None, None, 4), (None, None, 5), (None, 2, None), ("a", 1, 3)]


def test_params_need_a_tenant():
    with pytest.raises(TypeError):
        Params()
