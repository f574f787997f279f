"""Near-duplicates, language, quality and the pipeline against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from courierlens.llm import language, minhash, packing, quality, stages
from courierlens.llm.queries import QUERIES, good_label
from courierlens.llm.sketch import sketch
from courierlens.llm.words import shingle_sets, sliced, word_hashes


def shingles(text, length):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + length]) for i in range(max(len(words) - length + 1, 1))} if words else set()


def groups(rows, length, percent=80):
    """doc_id -> (number of shingles, smallest id reachable), comparing all pairs."""
    sets = [(i, shingles(t, length)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def found(df, key="doc_id"):
    return {r[key]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_groups_of_the_given_documents(small):
    spark, sf_dir = small
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, c, i == c) for i, (n, c) in groups(rows, 4).items()}
    assert found(QUERIES["op1_minhash_dedup"](spark, sf_dir)) == want
    assert any(i != c for i, (_, c, _) in want.items())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_chains_and_a_hot_group_around_the_threshold(small):
    """Copies with so many edits that some pairs just reach and others just miss the threshold, in small blocks."""
    spark, _ = small
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 1, 2, 3]))) for i in range(150)]
    chain = [f"c{i}" for i in range(300)]
    rows += [(1000 + i, " ".join(chain[i * 8:i * 8 + 100])) for i in range(12)]
    rows += [(2000 + i, rows[3][1]) for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: (n, c, i == c) for i, (n, c) in groups(rows, 4).items()}
    assert len({c for _, c, _ in want.values()}) > 10
    assert found(minhash.similar_texts(df, "doc_id", "text", shingle=4, block_rows=16)) == want


def test_exactly_at_the_threshold(small):
    spark, _ = small
    a = [f"a{i}" for i in range(18)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1] + ["x"])), (3, " ".join([*a, "p", "q", "r"])), (4, " ".join([*a, "p", "q", "s", "t"]))]
    want = {i: (n, c, i == c) for i, (n, c) in groups(rows, 1).items()}
    assert found(minhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", shingle=1)) == want


def test_repeated_rows_beside_a_near_copy_are_one_node(small, monkeypatch):
    spark, _ = small
    rng = random.Random(8)
    base = [f"r{i}" for i in range(80)]
    rows = [(1, " ".join(base))] * 3000 + [(2, edited(rng, base, 1)), (3, edited(rng, base, 1)), (4, "nothing like the others at all")]
    # Rows that repeat a key and its set, but not its text.
    rows += [(1, "  ".join(base))] * 500
    saved, sizes = minhash.saved, Counter()

    def counted(df, name):
        out = saved(df, name)
        sizes[name] = max(sizes[name], out.count())
        if name != "sketches" and name != "sets":
            assert sizes[name] < 500, name
        return out

    monkeypatch.setattr(minhash, "saved", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = minhash.similar_texts(df, "doc_id", "text", shingle=4).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(tuple(r) for r in out) == [(1, 1, True, 3500), (2, 1, False, 1), (3, 1, False, 1), (4, 4, True, 1)]
    assert sizes["nodes"] == 4 and sizes["sets"] == 3502


def test_odd_documents_are_grouped(odd_documents):
    rows = minhash.similar_texts(odd_documents, "doc_id", "text", shingle=5).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 15 and by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert [by_id[i]["n_shingles"] for i in (0, 1, 2, 3, 4, 5, 8)] == [0, 0, 0, 1, 1, 2, 59_996]
    assert [by_id[i]["component_id"] for i in (0, 1, 2, 5, 6, 7, 8, 9, 12)] == [0, 1, 2, 5, 5, 7, 8, 8, 5]


def test_empty_tables(small):
    spark, _ = small
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert minhash.similar_texts(docs, "doc_id", "text").collect() == []
    assert language.identify(docs, "doc_id", "text", "lang").collect() == []
    assert quality.select_quality(docs, "doc_id", "text", labels, "doc_id", good_label()).collect() == []


def test_sketches_estimate_similarity_for_sets_of_any_size():
    rng = np.random.default_rng(1)
    for size, shared in ((1, 1), (3, 2), (50, 25), (2000, 1500)):
        agree = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            agree.append((sketch(pool[:size], 192) == sketch(np.concatenate([pool[:shared], pool[size:2 * size - shared]]), 192)).mean())
        assert abs(np.mean(agree) - shared / (2 * size - shared)) < 0.03


def test_words_are_split_at_ascii_white_space_only():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAbÉ \n\t\x0b\x1c\xa0c") for _ in range(rng.randrange(60))) for _ in range(400)] + ["", None, " "]
    sets = [s for _, _, some in sliced(texts) for s in shingle_sets(some, 3)]
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    assert len(word_hashes([])[0]) == 0


def test_languages_of_held_out_documents(small):
    spark, _ = small
    rows = QUERIES["op10_language_filters"](spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def literal_shares(rows, learned):
    """Per document the share of its n-grams that each language has, with sets in the place of Bloom filters. ``learned`` tells by its key whether a row is learned from."""
    def grams(text):
        spaced = " " + re.sub(r"[\W\d_]+", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")) + " "
        return [spaced[i - 1:i + 2] for i in range(1, len(spaced) - 1) if spaced[i] != " "]

    counts = {}
    for key, text, lang in rows:
        if lang is not None and learned(key):
            counts.setdefault(lang, Counter()).update(grams(text))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items() if n / sum(c.values()) >= language.LEAST_SHARE} for lang, c in counts.items()}
    top = {g: max(s.get(g, 0) for s in share.values()) for g in set().union(*share.values())}
    known = {lang: {g for g, v in s.items() if v * language.MOST_TIMES >= top[g]} for lang, s in share.items()}
    return {key: {lang: sum(g in has for g in own) / len(own) for lang, has in known.items()} if (own := grams(text)) else None for key, text, _ in rows}


def test_languages_equal_those_of_literal_sets(small):
    spark, sf_dir = small
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(9001, None, None), (9002, "12 !!", "en"), (9003, "the one and the other", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = literal_shares(rows, lambda key: zlib.crc32(str(key).encode()) % 4 != 2)
    for r in language.identify(df, "doc_id", "text", "lang").collect():
        shares = want[r["doc_id"]]
        if shares is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        # What false positives of the filters add on average is taken off again.
        best = max(shares.values())
        assert abs(r["score"] - best) < 0.05 and shares[r["lang_pred"]] > best - 0.05
    assert sum(s is not None for s in want.values()) > 150


def test_documents_in_a_known_language_stay(small):
    spark, sf_dir = small
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(9001, None, None), (9002, "12 !!", "en"), (9003, "щур вздых фэйл жъю", None), (9004, "wqxz kkvj zzxq jjqk " * 5, None), (9005, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in stages.keep_known_language(df, "doc_id", "text", "lang").collect()}
    best = {i: max(shares.values()) if shares else 0 for i, shares in literal_shares(rows, lambda key: True).items()}
    assert {i for i, b in best.items() if b > stages.LEAST_LANGUAGE_SCORE + 0.05} <= kept <= {i for i, b in best.items() if b > stages.LEAST_LANGUAGE_SCORE - 0.05}
    assert not kept & {9001, 9002, 9003, 9004, 9005} and len(kept) > 150
    assert stages.keep_known_language(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_languages_of_odd_documents(odd_documents):
    df = odd_documents.withColumn("lang", F.when(F.col("doc_id") == 11, "es").otherwise(F.col("lang")))
    rows = {r["doc_id"]: r for r in language.identify(df, "doc_id", "text", "lang").collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 10)] == ["und"] * 4
    assert rows[8]["lang_pred"] in {"en", "es", "fr"} and not rows[None]["held_out"]


def test_ngrams_stay_within_their_text():
    texts = ["ab c", "", None, "!!", "Déjà", "a"]
    grams, owner = language.ngrams(texts)
    by_hand = Counter()
    for i, text in enumerate(texts):
        spaced = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()) + " "
        by_hand[i] = sum(c != " " for c in spaced)
    assert Counter(owner.tolist()) == +by_hand and len(grams) == len(owner)
    alone = language.ngrams(["ab c"])[0]
    assert sorted(alone) == sorted(grams[owner == 0])


def test_filters_beyond_64_languages(small):
    spark, _ = small
    rng = random.Random(3)
    words = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(8)] for i in range(70)}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(sorted(words) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn_filters(df, "text", "lang", F.col("doc_id"))
    right = language.predict_language(df, "text", filters).filter("lang = lang_pred").count()
    assert len(filters.languages) == 70 and right > 0.95 * len(rows)


def test_junk_and_insults_weigh_less_than_clean_text(small):
    spark, _ = small
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op8_importance_resampling"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").collect()
    clean = [r["accepted"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["accepted"] for r in rows if r["quality"] == 0]
    toxic = [r["log_weight"] for r in rows if r["toxic"] == 1]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.1
    assert np.median(toxic) < np.median([r["log_weight"] for r in rows if r["quality"] == 1 and r["toxic"] == 0])
    # Gumbel top-k: the largest sample keys, as many as half the accepted rows.
    k = sum(r["accepted"] for r in rows) // 2
    drawn = sorted(rows, key=lambda r: (-r["sample_key"], r["doc_id"]))[:k]
    assert {r["doc_id"] for r in drawn} == {r["doc_id"] for r in rows if r["sampled"]}


def test_log_weights_are_the_literal_ratio_of_both_models(small):
    """Words, pairs of words and windows of six bytes, each kind a smoothed model of its own; evidence of either sign."""
    spark, _ = small
    rng = random.Random(4)
    good, bad = [f"fine{i}" for i in range(30)], [f"poor{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=40)) + " été 語語語語") for i in range(80)] + [(80, None), (81, "  \n      "), (82, "ab")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weight = {r["doc_id"]: r["log_weight"] for r in quality.select_quality(df, "doc_id", "text", labels, "doc_id", good_label()).collect()}

    def kinds(text):
        data = (text or "").encode()
        words = data.split()
        starts = [i for i in range(len(data) - 5) if data[i:i + 1].strip() and data[i] & 0xC0 != 0x80]
        return [words, list(zip(words, words[1:])), [data[i:i + 6] for i in starts]]

    raw, target = ([Counter(g for i, t in rows if drawn(i) for g in kinds(t)[k]) for k in range(3)] for drawn in (lambda i: True, lambda i: i < 40 and i % 2))
    want = {i: sum(np.log((target[k][g] + 1) / (raw[k][g] * sum(target[k].values()) / sum(raw[k].values()) + 1)) for k in range(3) for g in kinds(t)[k]) for i, t in rows}
    # Few of the 262,144 buckets of a kind are shared by two n-grams.
    assert all(abs(weight[i] - want[i]) < 0.5 + 0.02 * abs(want[i]) for i in want)
    assert weight[80] == weight[81] == 0 and min(weight[i] for i in range(1, 80, 2)) > 0 > max(weight[i] for i in range(0, 80, 2))


def literal_acceptance(rows, good):
    """doc_id -> (score, accepted), by sets of words and their beginnings, and counts of pairs of word shapes."""
    def held(text):
        words = (text or "").lower().split()
        return {("word", w) for w in words} | {(n, w[:n]) for w in words for n in (4, 6, 8)}

    def shapes(text):
        found, last = [63], None
        for w in (text or "").split():
            upper, digits = sum(c.isupper() for c in w), sum(c.isdigit() for c in w)
            other = sum(not c.isalnum() for c in w)
            loud = upper > 1 and 2 * upper > len(w) - digits - other
            found.append(w[0].isupper() + 2 * loud + 4 * (digits > 0) + 8 * min(other, 2) + 32 * (w.lower() == last))
            last = w.lower()
        return list(zip(found, found[1:]))

    target = [t for i, t in rows if good.get(i)]
    has, wanted = (Counter(x for t in texts for x in held(t)) for texts in ([t for _, t in rows], target))
    pairs, of_target = (Counter(x for t in texts for x in shapes(t)) for texts in ([t for _, t in rows], target))
    every, own = sum(pairs.values()), sum(of_target.values())
    score = {}
    for i, text in rows:
        words = sum(min(0, np.log((wanted[x] + 8 * wanted[x] ** 0.5 + 4) / (has[x] * len(target) / len(rows)))) for x in held(text))
        mine = shapes(text)
        mean = sum(np.log((of_target[x] + 1) / (pairs[x] * own / every + 1)) for x in mine) / max(len(mine), 1)
        score[i] = words + 10 * mean
    kept, gone = ([score[i] for i in good if bool(good[i]) == side] for side in (True, False))
    values = sorted({*kept, *gone})
    worth = [10 * sum(k >= v for k in kept) / len(kept) + sum(g < v for g in gone) / len(gone) for v in values]
    at = worth.index(max(worth))
    cut = values[0] - 1 if not at else (values[at] + values[at - 1]) / 2
    return {i: (v, v >= cut) for i, v in score.items()}


def test_acceptance_equals_the_literal_score(small):
    """Also where labels are repeated or contradict each other, and where a labelled document is repeated many times."""
    spark, _ = small
    rng = random.Random(11)
    fine, poor = [f"fine{i}word" for i in range(25)], [f"poor{i}thing" for i in range(6)]
    rows = []
    for i in range(400):
        words = rng.choices(fine, k=30)
        if i % 3 == 0:
            words[rng.randrange(30)] = rng.choice(poor)
        if i % 5 == 0:
            words = [rng.choice([w.upper(), w + "!!", w + "7"]) for w in words]
        rows.append((i, " ".join(words).capitalize()))
    good = {i: int(i % 3 != 0 and i % 5 != 0) for i in range(300)}
    labels = [(i, g, 0) for i, g in good.items()] * 2 + [(7, 0, 0), (None, 1, 0), (9999, 1, 0)]
    good[7] = 0
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = literal_acceptance(rows, good)
    got = {r["doc_id"]: r["accepted"] for r in quality.select_quality(df, "doc_id", "text", marks, "doc_id", good_label()).collect()}
    # Few n-grams share a bucket; those that do move a score by little.
    assert sum(got[i] != accepted for i, (_, accepted) in want.items()) <= 2 and 100 < sum(got.values()) < 300
    model = quality.fit(df, "doc_id", "text", marks, "doc_id", good_label())
    scores = {r["doc_id"]: r["score"] for r in quality.weigh(df, "text", model, "weight", "score").collect()}
    assert np.median([abs(scores[i] - v) for i, (v, _) in want.items()]) < 1e-4
    kept = {r["doc_id"] for r in stages.keep_good_quality(df, "doc_id", "text", marks, "doc_id", good_label()).collect()}
    assert kept == {i for i, a in got.items() if a}


def test_a_hot_labelled_document_counts_once(small):
    spark, _ = small
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id") % 50).alias("text"))
    labels = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit(df, "doc_id", "text", labels, "doc_id", good_label())
    # A row for the hot key and one for each odd id from 2001 on.
    joined = quality.labelled_texts(df.select(F.col("doc_id").alias("key"), "text"), labels, "doc_id", good_label(), 30_000)
    assert joined.count() == 501 and np.isfinite(model.ratios).all()


def test_what_stands_behind_the_eighth_byte_counts(small):
    spark, _ = small
    rng = random.Random(9)
    letters, cyrillic = [chr(c) for c in range(0x4E00, 0x4E60)], "абвгдежз"
    clean = ["".join(rng.choices(letters, k=60)) for _ in range(400)]
    rows = [(i, t if i % 4 else t[:30] + "罵罵罵" + t[30:]) for i, t in enumerate(clean)]
    rows += [(1000 + i, "".join(rng.choices(cyrillic, k=9)) + " прекрасн" + ("ый" if i % 4 else "уккк")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, 0 if i % 4 else 1) for i, _ in rows if i % 8 < 5], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.select_quality(df, "doc_id", "text", labels, "doc_id", good_label()).collect()
    assert all(r["accepted"] == (r["doc_id"] % 4 != 0) for r in out)


def test_resampling_follows_the_weights(small):
    spark, _ = small
    df = spark.range(20000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.log(F.lit(3.0))).otherwise(0.0).alias("w"))
    drawn = quality.resample(df, "k", "w", 200).filter("sampled")
    assert drawn.count() == 200 and 0.66 < drawn.filter("k % 2 = 0").count() / 200 < 0.84


def test_quality_of_odd_documents_and_without_labels(odd_documents):
    spark = odd_documents.sparkSession
    labels = spark.createDataFrame([(3, 1, 0), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.select_quality(odd_documents, "doc_id", "text", labels, "doc_id", good_label()).collect()
    assert len(rows) == 15 and all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    rows = quality.select_quality(odd_documents, "doc_id", "text", labels.limit(0), "doc_id", good_label()).collect()
    assert len(rows) == 15 and all(r["accepted"] and r["log_weight"] == 0 for r in rows)


def test_pipeline_stages_keep_columns_and_take_effect(small):
    spark, sf_dir = small
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(2).select(F.lit(9000).cast("long").alias("doc_id"), F.lit("1234 !!").alias("text"), "lang", "source", "n_chars").limit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    assert 9000 not in {r["doc_id"] for r in kept["language"]} and len(kept["language"]) == 200
    near = groups([(r["doc_id"], r["text"]) for r in kept["quality"]], 5)
    assert {r["doc_id"] for r in kept["near_duplicates"]} == {i for i, (_, c) in near.items() if i == c}
    encode = packing.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).encode_ordinary
    tokens = {r["doc_id"]: len(encode(r["text"])) + 1 for r in kept["near_duplicates"]}
    packed = Counter()
    for r in kept["packing"]:
        packed[r["doc_id"]] += r["size"]
    assert dict(packed) == tokens


def test_one_row_of_each_group_stays_whatever_keys_and_rows_are_repeated(small):
    """Keys with several texts, near copies under one key, rows equal but for another column, hot repeated rows."""
    spark, _ = small
    rng = random.Random(6)
    bases = [[f"w{b}_{i}" for i in range(40)] for b in range(12)]
    rows = [(1, " ".join(bases[0]), "x"), (2, edited(rng, bases[0], 1), "x"), (2, "only here and nowhere else at all", "x"),
            (3, " ".join(bases[1]), "x"), (3, edited(rng, bases[1], 1), "x")]
    rows += [(rng.randrange(4, 30), edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 2])), rng.choice("xy")) for _ in range(160)]
    rows += [(7, " ".join(bases[2]), "x")] * 300 + [(7, edited(rng, bases[2], 1), "y")]
    rows += [(8, None, "x"), (8, None, "x"), (8, "", "x"), (None, " ".join(bases[0]), "x"), (None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string").repartition(4)
    left = [tuple(r) for r in stages.keep_one_of_similar(df, "doc_id", "text").collect()]
    assert set(left) <= set(rows)
    assert Counter(r for r in left if r[0] is None or not shingles(r[1], 5)) == Counter([(8, None, "x"), (8, "", "x"), (None, " ".join(bases[0]), "x"), (None, None, "y")])
    # All pairs of distinct texts, named by their smallest key.
    texts = {}
    for key, text, _ in rows:
        if key is not None and shingles(text, 5):
            texts[text] = min(key, texts.get(text, key))
    named = sorted(texts, key=lambda t: texts[t])
    component = {named[i]: named[c] for i, (_, c) in groups(list(enumerate(named)), 5).items()}
    stayed = Counter(component[t] for k, t, _ in left if k is not None and shingles(t, 5))
    assert set(stayed) == set(component.values()) and set(stayed.values()) == {1}
    assert all(k == texts[component[t]] for k, t, _ in left if k is not None and shingles(t, 5))
    empty = stages.keep_one_of_similar(df.limit(0), "doc_id", "text")
    assert empty.count() == 0 and empty.columns == df.columns


def test_stages_on_odd_documents(odd_documents):
    spark = odd_documents.sparkSession
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in stages.keep_known_language(odd_documents, "doc_id", "text", "lang").collect()} >= {5, 6, 7, 8, 9, 12}
    assert stages.keep_good_quality(odd_documents, "doc_id", "text", labels, "doc_id", good_label()).count() == 15
    left = stages.keep_one_of_similar(odd_documents, "doc_id", "text").collect()
    assert sorted((r["doc_id"] for r in left if r["doc_id"] is not None)) == [0, 1, 2, 3, 4, 5, 7, 8, 10, 11]
    assert sum(r["doc_id"] is None for r in left) == 1
    with pytest.raises(ValueError):
        language.predict_language(odd_documents, "text", language.Filters((), 0, np.zeros((4, 1), np.uint64), 3))
