from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from courierlens.llm.shared import prepare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    """A session that is prepared for the operators, and the smallest given tables."""
    prepare(spark)
    return spark, SF_DIR


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls, empty and long texts, repeated rows and further columns with the operators' names."""
    prepare(spark)
    long = " ".join(f"word{i}" for i in range(60_000))
    texts = [None, "", " \n\t", "one", "One  two\tTHREE", "a b c d e f", "A b\nc D e f", "a b c d e g", long, long + " tail", "12 34!",
             "éèê ñandú Straße 語 🙂", "a b c d e f"]
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)] + [(None, "lost key", "fr"), (5, "a b c d e f", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = {name: F.lit(i) for i, name in enumerate(["key", "node", "n", "kept", "Score", "lang_pred", "_key", "shard", "slot", "bucket", "log_weight", "_part"])}
    return df.withColumns(extra)
