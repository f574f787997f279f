"""Values carried forward over ranges against the window over the whole key."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courierlens.operators import carry
from courierlens.operators.carry import fill_forward_scan
from rows import result

START = datetime(2024, 1, 1)


def literal(df):
    peers = F.max("value").over(W.partitionBy("key", "ts"))
    whole = W.partitionBy("key").orderBy(F.col("ts").asc_nulls_first()).rangeBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("known", peers).withColumn("known", F.last("known", ignorenulls=True).over(whole))


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield 12
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("batch", [2, 1000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranges_equal_the_window(spark, partitions, seed, batch):
    """Few keys over many ranges, peers that straddle them, keys without values, NULL keys and times."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "hot", "hot", "hot", "z", None]), rng.choice([None, *[START + timedelta(minutes=m) for m in range(12)]]),
             rng.choice([None, None, None, rng.randrange(50)])) for i in range(240)]
    rows += [(1000 + i, "empty", START + timedelta(seconds=i), None) for i in range(60)] + [(2000 + i, "late", START + timedelta(seconds=i), 5 if i == 59 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz, value int").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        got = fill_forward_scan(df, "key", "ts", "value", "known")
        assert result(got) == result(literal(df))
        assert result(fill_forward_scan(df, "key", "ts", "value"), "id", "value") == result(literal(df), "id", "known")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_hot_minute_is_spread_over_all_tasks(spark, partitions, monkeypatch):
    hot = F.col("id") % 3 == 0
    minutes = F.when(hot, 700).otherwise(F.col("id") % 1440).cast("int")
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)
    df = spark.range(30_000).select("id", F.when(F.col("id") % 5 == 0, "other").otherwise("hot").alias("key"), ts.alias("ts"),
                                    F.when(F.col("id") % 7 == 0, F.col("id") % 100).alias("value"))
    folders = []
    plain = carry.shared_folder
    monkeypatch.setattr(carry, "shared_folder", lambda *a: folders.append(plain(*a)) or folders[-1])
    got = fill_forward_scan(df, "key", "ts", "value", "known")
    assert got.exceptAll(literal(df)).isEmpty() and got.count() == 30_000
    sizes = [r["count"] for r in spark.read.parquet(folders[0]).groupBy("_part").count().collect()]
    assert len(sizes) == partitions and max(sizes) < 3 * 30_000 / partitions
    assert fill_forward_scan(df.limit(0), "key", "ts", "value").count() == 0


def test_a_range_is_one_pass_whatever_its_batches():
    rng = random.Random(4)
    rows = sorted([(rng.choice("ab"), rng.randrange(6), rng.choice([None, 1, 2, 3])) for _ in range(40)], key=lambda r: (r[0], r[1], -(r[2] or 0)))
    columns = [pa.array([r[i] for r in rows]) for i in range(3)]
    whole = carry._Range().carry(*columns)
    for size in (1, 3, 7):
        part = carry._Range()
        pieces = [part.carry(*[c[at:at + size] for c in columns]) for at in range(0, len(rows), size)]
        assert [bool(x) for _, o in pieces for x in o] == whole[1].tolist()
        settled = [(v, o) for f, op in pieces for v, o in zip(f.to_pylist(), op.tolist())]
        assert [v for v, o in settled if not o] == [v for v, o in zip(whole[0].to_pylist(), whole[1]) if not o]
