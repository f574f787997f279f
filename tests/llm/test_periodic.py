"""Periodic runs against a literal search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from compare import connect, differences
from courierlens.llm import periodic, suffixes
from courierlens.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def literal_runs(words, least_length=6, least_exponent=4):
    """All maximal stretches by trying every period, in which any two words are equal, at every word."""
    found, places = {}, {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    apart = {j - i for of in places.values() for i in of for j in of if i < j <= i + len(words) // least_exponent}
    for q in sorted(apart):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least_length, least_exponent * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def by_start(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def periodic_words(rng, letters, parts):
    words = []
    for _ in range(parts):
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 6))]
        words += (unit * rng.randrange(1, 9))[:rng.randrange(1, 40)]
    return words


@pytest.mark.parametrize("least", [(6, 4), (1, 2), (4, 3)])
def test_runs_of_random_words(least):
    rng = random.Random(least[0])
    texts = [periodic_words(rng, "ab", rng.randrange(12)) for _ in range(150)] + [periodic_words(rng, "abcdef", 30) for _ in range(20)]
    texts += [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, ["a", "b"] * 100 + ["b", "a"] * 100, list("abaababaabaab" * 8)]
    assert periodic.find_runs(texts, *least) == [by_start(literal_runs(t, *least)) for t in texts]
    for t in texts[::10]:
        assert periodic.find_runs([t], *least) == [by_start(literal_runs(t, *least))]


def test_suffixes_are_in_order_and_share_what_is_said():
    rng = random.Random(4)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(60))] for _ in range(30)] + [list("ab" * 50)]
    numbers, _ = suffixes.laid_out(texts)
    order, place, levels = suffixes.sort_suffixes(numbers, len(numbers))
    rows = numbers.tolist()
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: rows[i:]) and (place[order] == np.arange(len(rows))).all()
    shared = suffixes.common_prefixes(order, levels)
    for k in range(1, len(rows)):
        a, b = rows[order[k - 1]:], rows[order[k]:]
        assert shared[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_branching_tandems_in_small_chunks(monkeypatch):
    monkeypatch.setattr(suffixes, "PAIRS", 7)
    rng = random.Random(8)
    texts = [periodic_words(rng, "ab", 10) for _ in range(20)]
    assert periodic.find_runs(texts, 6, 4) == [by_start(literal_runs(t)) for t in texts]


def test_long_texts_take_time_in_proportion():
    rng = random.Random(2)
    words = ["x"] * 100_000 + [str(rng.randrange(5000)) for _ in range(100_000)] + ["y", "z"] * 50_000
    assert periodic.find_runs([words], 6, 4)[0][0] == (0, 100_000, 1)
    assert (200_000, 100_000, 2) in periodic.find_runs([words], 6, 4)[0]


def literal_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = by_start(literal_runs(words))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_rows_of_the_given_documents(small):
    spark, sf_dir = small
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len(r["text"] or "") < 20_000]
    found = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert all(found[r["doc_id"]] == literal_row(*r) for r in rows)
    assert any(r[1] for r in found.values()) and len(found) >= len(rows)


def test_rows_equal_sql(small):
    spark, sf_dir = small
    assert differences(QUERIES["op11_periodic_runs"](spark, sf_dir), connect(sf_dir), SQL["op11_periodic_runs"]) == []


def test_odd_documents(odd_documents, small, tmp_path):
    spark, _ = small
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    rows += [(100 + i, t) for i, t in enumerate(["a " * 40, "\x0ba\x0bb\x0c" * 9, "é é é é " * 5, "x y x y x y x y x", "\x1c \x1c \x1c \x1c \x1c \x1c", "\0 " * 7])]
    rows += [(i, "p q r s t u v w x y z " * 3) for i in range(200, 260)] + [(5, "a a a a a a"), (None, "b b b b b b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.join(odd_documents.select("doc_id", "kept", "n", "key").limit(0), "doc_id", "left").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert found == sorted((literal_row(*r) for r in rows if r is not None), key=str)
    assert periodic.periodic_runs(odd_documents.limit(0), "doc_id", "text").count() == 0
    kept = {r["doc_id"]: r for r in periodic.periodic_runs(df, "doc_id", "text", slice_words=3).collect() if r["doc_id"] is not None}
    assert kept[100]["collapsed"] == "a" and [tuple(r) for r in kept[100]["runs"]] == [(0, 40, 1)]
    assert kept[103]["collapsed"] == "x y" and kept[0]["collapsed"] == "" and kept[0]["n_words"] == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, "doc_id", "text", least_exponent=1)
