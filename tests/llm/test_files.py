"""Token files, BPE, packing, sharding and archives: round trips and brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import connect, differences
from courierlens.llm import bpe, packing, queries, sharding, token_files, warc
from courierlens.llm.pieces import ENTRY_BYTES, PATTERN, LazyMemory, Memory, pieces, slices
from courierlens.llm.queries import END_ID, QUERIES, SEQUENCE_COSTS, SQL
from courierlens.llm.shared import global_rank, new_folder

MULTI, LIBRARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def library():
    tokenizer = Tokenizer.from_file(LIBRARY)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def ranked():
    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    rng = random.Random(1)
    letters = [chr(c) for c in [*range(0x180), *range(0x2000, 0x2040), 0x3B1, 0x4E2D, 0x1F600, 0x1C5, 0xB2, 0x2167, 0x661, 0x3000, 0x180E, 0x200B]]
    words = ["the", "of", " and", "aaa", "'s", "'RE", "  ", "\n", "<|endoftext|>", "12", "!!"]
    return ["".join(rng.choice(letters if rng.random() < 0.4 else words) for _ in range(rng.randrange(25))) for _ in range(n)]


# Token files

def check_tokens(rows, texts):
    encode, start = library(), 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = np.array([*encode(texts[r["doc_id"]]), END_ID], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_hold_what_the_library_encodes(small):
    spark, sf_dir = small
    check_tokens(QUERIES["op3_token_files"](spark, sf_dir).collect(), documents(spark, sf_dir))


def test_sequences_are_read_by_number(small):
    spark, _ = small
    texts = dict(enumerate(odd_texts(700)))
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(7)
    folder = new_folder(spark, "tokens")
    files = token_files.write_token_files(df, "doc_id", "text", lambda: token_files.library_encoder(LIBRARY), END_ID, folder, length=16).collect()
    check_tokens(token_files.token_files(df, "doc_id", "text", LIBRARY, END_ID, length=16).collect(), texts)
    encode = library()
    stream = [x for i in sorted(texts) for x in [*encode(texts[i]), END_ID]]
    held = []
    for f in sorted(files, key=lambda f: f["start"]):
        reader = token_files.open_token_file(folder, f["file"])
        assert reader.schema.field("ids").type == pa.list_(pa.uint16(), 16) and f["start"] == len(held)
        for number in range(f["sequences"]):
            ids, mask = token_files.sequence(reader, number)
            held += [int(x) for x, real in zip(ids, mask.to_pylist()) if real]
    assert held == stream


def test_token_files_of_odd_and_no_documents(odd_documents):
    rows = token_files.token_files(odd_documents, "doc_id", "text", LIBRARY, END_ID, length=64).collect()
    assert len(rows) == 15 and [r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)] == [1, 1]
    assert [r["start"] for r in rows if r["doc_id"] is None] == [0]
    assert token_files.token_files(odd_documents.limit(0), "doc_id", "text", LIBRARY, END_ID).collect() == []


def test_added_tokens_get_the_ids_of_the_unmodified_library(small, monkeypatch):
    spark, _ = small
    texts = dict(enumerate([*odd_texts(200), "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "plain"]))
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    tokenizer = Tokenizer.from_file(LIBRARY)
    monkeypatch.setitem(globals(), "library", lambda: lambda text: tokenizer.encode(text, add_special_tokens=False).ids)
    check_tokens(QUERIES["op3_token_files"](spark, "").collect(), texts)
    assert 50256 in tokenizer.encode(texts[200], add_special_tokens=False).ids


# Byte-level BPE

def test_ids_and_bytes_of_the_given_documents(small):
    spark, sf_dir = small
    encoding, texts = ranked(), documents(spark, sf_dir)
    rows = QUERIES["op4_prefix_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(encoding.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_prefix_encoding_equals_the_library_on_odd_texts():
    encoding, own = ranked(), bpe.encoder(MULTI)
    assert PATTERN == public_tokenizers.PATTERN
    texts = odd_texts(3000)
    for text, data in zip(texts, own.ids(texts)):
        assert np.frombuffer(data, "<u4").tolist() == encoding.encode_ordinary(text)
        assert "".join(pieces(text)) == text


def test_appending_and_editing_equal_encoding_anew():
    vocabulary, rng = bpe.encoder(MULTI).vocabulary, random.Random(6)
    for _ in range(300):
        data = "".join(rng.choice("aehinorst é") for _ in range(rng.randrange(1, 30))).encode()
        cut, end = sorted(rng.randrange(len(data) + 1) for _ in range(2))
        table = bpe.Prefixes(vocabulary, data[:cut]).append(data[cut:])
        assert table.ids() == bpe.Prefixes(vocabulary, data).ids() and vocabulary.decode(np.array(table.ids(), int)) == data
        table.edit(cut, end, b"xyz")
        assert table.ids() == bpe.Prefixes(vocabulary, data[:cut] + b"xyz" + data[end:]).ids()


def test_a_small_edit_in_a_long_piece_fills_few_entries():
    vocabulary, rng = bpe.encoder(MULTI).vocabulary, random.Random(2)
    data = "".join(rng.choice("aeinorst") for _ in range(60_000)).encode()
    table = bpe.Prefixes(vocabulary, data)
    for start, end, new in [(10, 11, b"x"), (30_000, 30_004, b""), (59_980, 59_990, b"qq"), (0, 0, b"start "), (500, 500, b"\xff\xfe"), (7, 9_000, b"short"), (0, 5, b"")]:
        data = data[:start] + new + data[end:]
        table.edit(start, end, new)
        assert table.data == data and table.filled <= len(new) + 8 * vocabulary.longest
        assert table.ids() == bpe.Prefixes(vocabulary, data).ids()
    assert table.append(b"more").ids() == bpe.Prefixes(vocabulary, data + b"more").ids() and table.filled == 4


def test_bpe_of_odd_documents_returns_ids_and_bytes(odd_documents):
    rows = {r["doc_id"]: r for r in bpe.encode_texts(odd_documents.filter("doc_id is not null"), "doc_id", "text", MULTI).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert [(rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) for i in (0, 1)] == [(0, empty, empty)] * 2
    assert bytes(rows[11]["decoded"]).decode() == "éèê ñandú Straße 語 🙂" and len(rows[11]["ids"]) == rows[11]["n_tokens"]
    assert rows[8]["n_tokens"] >= 60_000
    assert bpe.encode_texts(odd_documents.limit(0), "doc_id", "text", MULTI).collect() == []


@pytest.mark.parametrize("kind", [Memory, LazyMemory])
def test_a_small_memory_forgets_but_stays_right(kind):
    def encode(p):
        return [x.encode() for x in p] if kind is Memory else p.encode()

    memory = kind(encode, limit=3 * ENTRY_BYTES)
    ids = (lambda t: memory.ids([t])[0]) if kind is Memory else memory.ids
    for text in ["a b c d e", "a b", "x y z", "a b c"] * 5:
        assert ids(text) == text.encode()
    held = memory if kind is LazyMemory else memory._known
    assert len(held) <= 8 and list(slices([5, 1, 9, 0, 0], 6)) == [(0, 2), (2, 3), (3, 5)]


@pytest.mark.parametrize("kind", [Memory, LazyMemory])
def test_long_pieces_are_not_remembered(kind):
    memory = kind(lambda p: [x.encode() for x in p] if kind is Memory else p.encode())
    texts = [chr(0x4E00 + i) * 10_000 for i in range(50)] + ["short one"]
    for _ in range(2):
        assert (memory.ids(texts) if kind is Memory else [memory.ids(t) for t in texts]) == [t.encode() for t in texts]
    held = memory if kind is LazyMemory else memory._known
    assert sum(map(len, held)) < 100


# Packing

def literal_best_fit(sizes, costs):
    """The rule, with a look at every open bin for every piece."""
    bins, where, left = [], {}, sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        rooms = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= sizes[i]]
        if rooms:
            least = min(rooms)[0]
            where[i] = least
            k = next(k for room, k in rooms if room == least)
        else:
            capacity = min((c for c in costs if c >= sizes[i]), key=lambda c: (costs[c] / max(min(c, left), 1), c))
            bins.append({"room": capacity, "used": 0})
            k = len(bins) - 1
        bins[k]["room"] -= sizes[i]
        bins[k]["used"] += sizes[i]
        left -= sizes[i]
    return sorted(b["used"] for b in bins)


@pytest.mark.parametrize("seed", range(20))
def test_packing_equals_the_literal_rule(seed):
    rng = random.Random(seed)
    costs = {c: packing.attention_cost(c, 64) for c in rng.sample([8, 16, 32, 48, 64], 3)}
    sizes = [rng.randrange(max(costs) + 1) for _ in range(rng.randrange(1, 200))]
    bins, capacities = packing.pack(sizes, costs)
    used = Counter()
    for b, s in zip(bins, sizes):
        used[b] += s
    assert all(used[b] <= c and c == min((x for x in costs if x >= used[b]), key=lambda x: (costs[x], x)) for b, c in enumerate(capacities))
    # Bins with equal room may be chosen in another order; the contents' sizes do not depend on it.
    assert sorted(used[b] for b in range(len(capacities))) == literal_best_fit(sizes, costs)


def check_packed(rows, words):
    bins, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["pack_group"], r["bin"]].append(r)
        parts[r["doc_id"]].append((r["start"], r["size"]))
    for members in bins.values():
        members.sort(key=lambda r: (r["offset"], r["size"]))
        at = 0
        for r in members:
            assert r["offset"] == at and r["used"] == sum(m["size"] for m in members) <= r["capacity"]
            at += r["size"]
    for doc, n in words.items():
        at = 0
        for start, size in sorted(parts[doc]):
            assert start == at
            at += size
        assert at == n


def test_rows_that_repeat_a_key_are_dealt_to_many_groups(small):
    spark, _ = small
    rows = [(7, 30)] * 6000 + [(i, i % 90) for i in range(100, 400)] + [(8, 150)] * 2000
    df = spark.createDataFrame(rows, "doc_id long, n long").repartition(5)
    packed = packing.pack_documents(df, "doc_id", F.col("n"), {c: packing.attention_cost(c) for c in (32, 64)}, group_pieces=512).collect()
    assert Counter(r["doc_id"] for r in packed) == Counter({7: 6000, 8: 6000}) + Counter(i + 0 for i, n in rows[6000:6300] for _ in range(max(1, -(-n // 64))))
    assert sum(r["size"] for r in packed) == sum(n for _, n in rows)
    assert max(Counter(r["pack_group"] for r in packed).values()) < 3 * 512
    filled = Counter()
    for r in packed:
        filled[r["pack_group"], r["bin"]] += r["size"]
    assert all(filled[r["pack_group"], r["bin"]] == r["used"] <= r["capacity"] for r in packed)


def check_sequences(sequences, want, costs):
    """Every document's ids, ended, lie in the pieces of the sequences, once; padding is masked; the length is the cheapest."""
    found = Counter()
    parts = defaultdict(list)
    for r in sequences:
        used = sum(p["size"] for p in r["pieces"])
        assert used == r["used"] <= r["capacity"] == len(r["ids"]) == len(r["mask"])
        assert r["capacity"] == min((c for c in costs if c >= used), key=lambda c: (costs[c], c))
        assert r["mask"] == [True] * used + [False] * (r["capacity"] - used) and not any(r["ids"][used:])
        at = 0
        for p in r["pieces"]:
            assert p["offset"] == at and p["start"] == p["piece"] * max(costs)
            at += p["size"]
            parts[p["key"], p["piece"]].append(tuple(r["ids"][p["offset"]:at]))
            found[p["key"]] += p["piece"] == 0
    assert found == Counter(k for k, _ in want)
    for key, ids in {k: v for k, v in want}.items():
        own = [v for k, v in want if k == key]
        for piece in range(-(-len(ids) // max(costs))):
            cut = slice(piece * max(costs), (piece + 1) * max(costs))
            assert {p for p in parts[key, piece]} >= {tuple(ids[cut])}
        assert sum(map(len, own)) == sum(len(p) for (k, _), pieces in parts.items() if k == key for p in pieces)
    assert len({(r["pack_group"], r["bin"]) for r in sequences}) == len(sequences)


def test_sequences_hold_the_ids_of_the_given_documents(small):
    spark, sf_dir = small
    encode, texts = ranked(), documents(spark, sf_dir)
    want = [(i, [*encode.encode_ordinary(t), encode.n_vocab]) for i, t in texts.items()]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_sequences(packing.pack_texts(df, "doc_id", "text", MULTI, SEQUENCE_COSTS).collect(), want, SEQUENCE_COSTS)
    rows = QUERIES["op5_best_fit_packing"](spark, sf_dir).collect()
    check_packed(rows, {i: len(x) for i, x in want})
    assert {r["capacity"] for r in rows} <= set(SEQUENCE_COSTS) and len({r["ids_hash"] for r in rows}) > 100


def test_sequences_of_odd_documents_and_many_groups(odd_documents):
    encode, costs = ranked(), {8: 8.0, 64: 60.0}
    rows = [(r["doc_id"], [*encode.encode_ordinary(r["text"] or ""), 9]) for r in odd_documents.collect()]
    sequences = packing.pack_texts(odd_documents, "doc_id", "text", MULTI, costs, end_id=9, group_pieces=100).collect()
    check_sequences(sequences, rows, costs)
    assert packing.pack_texts(odd_documents.limit(0), "doc_id", "text", MULTI, costs).collect() == []
    same = odd_documents.sparkSession.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    sequences = packing.pack_texts(same, "doc_id", "text", MULTI, costs, group_pieces=100).collect()
    sizes = Counter()
    for r in sequences:
        sizes[r["pack_group"]] += len(r["pieces"])
    assert sum(sizes.values()) == 3000 and max(sizes.values()) <= 100


def test_packing_of_odd_documents_in_small_groups(odd_documents):
    costs = {4: 4.0, 16: 15.0}
    df = odd_documents.filter("doc_id is not null")
    rows = packing.pack_documents(df.dropDuplicates(["doc_id"]), "doc_id", packing.word_count(F.col("text")), costs, group_pieces=500).collect()
    check_packed(rows, {0: 0, 1: 0, 2: 0, 3: 1, 4: 3, 8: 60_000, 9: 60_001})
    assert 5 <= len({r["pack_group"] for r in rows}) <= 20
    assert packing.pack_documents(df.limit(0), "doc_id", F.lit(1), costs).collect() == []
    same = df.sparkSession.range(3000).select(F.lit(None).cast("long").alias("doc_id"))
    groups = packing.pack_documents(same, "doc_id", F.lit(3), costs, group_pieces=100).groupBy("pack_group").count().collect()
    assert sum(r["count"] for r in groups) == 3000 and max(r["count"] for r in groups) < 400


# Sharding

def literal_shard(key, weights):
    def at(shard):
        u = (int(hashlib.md5(f"{key}/{shard}".encode()).hexdigest()[:sharding.DIGITS], 16) + 0.5) / 16**sharding.DIGITS
        return -np.log(u) / weights[shard]
    return min((s for s in range(len(weights)) if weights[s]), key=lambda s: (at(s), s))


def test_shards_of_the_given_documents(small):
    spark, sf_dir = small
    texts = documents(spark, sf_dir)
    rows = QUERIES["op6_rendezvous_shards"](spark, sf_dir).collect()
    slots = defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r["shard"], r["grown_shard"]) == (literal_shard(r["doc_id"], [1] * 8), literal_shard(r["doc_id"], [1] * 9))
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_hot_document_is_numbered_by_many_tasks(small, monkeypatch):
    """A third of the rows without an id and with different texts, a third the same row."""
    spark, _ = small
    monkeypatch.setattr(sharding, "SLOT_ROWS", 500)
    kind = F.col("id") % 3
    df = spark.range(0, 30_000, 1, 16).select(F.when(kind == 2, F.col("id")).when(kind == 1, 5).alias("doc_id"), F.when(kind == 0, F.repeat(F.lit("x"), (F.col("id") % 700).cast("int"))).otherwise("same").alias("text"))
    rows = sharding.assign_shards(df, "doc_id", "text", [1.0] * 4, [1.0] * 5)
    slots = defaultdict(list)
    for r in rows.collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 30_000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = F.floor(sharding.unit(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), (F.octet_length("text") + 1).cast("long"), F.crc32(F.col("text").cast("binary")), F.spark_partition_id())) * 60)
    ranges = df.groupBy(place.alias("r"), sharding.rendezvous(F.col("doc_id"), [1.0] * 4).alias("s")).count().collect()
    assert max(r["count"] for r in ranges) < 30_000 / 8


def test_a_hot_document_goes_to_many_token_files(small):
    spark, _ = small
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, 7).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"))
        folder = new_folder(spark, "tokens")
        files = token_files.write_token_files(hot, "doc_id", "text", lambda: token_files.library_encoder(LIBRARY), END_ID, folder, length=16).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(files) == 8 and max(f["documents"] for f in files) < 3 * 4000 / 8
    ordered = sorted(files, key=lambda f: f["part"])
    assert [f["start"] for f in ordered] == list(np.cumsum([0] + [f["tokens"] for f in ordered])[:-1])
    keys = []
    for f in ordered:
        index = token_files.open_token_file(folder, f"{f['file']}-index")
        keys += [k for i in range(index.num_record_batches) for k in index.get_batch(i).column(0).to_pylist()]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(keys) == 4000


def test_weights_ranges_and_repeated_rows(small, monkeypatch):
    spark, _ = small
    monkeypatch.setattr(sharding, "SLOT_ROWS", 500)
    df = spark.range(9000).select((F.col("id") % 6000).alias("doc_id"), F.lit("t").alias("text"), F.lit(0).alias("shard"))
    df = df.unionByName(spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("shard")))
    rows = sharding.assign_shards(df, "doc_id", "text", [1.0, 3.0, 0.0], [1.0, 3.0, 0.0, 2.0]).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 12000 and set(slots) == {0, 1} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = {s: len({r["doc_id"] for r in rows if r["shard"] == s and r["doc_id"] is not None}) / 6000 for s in (0, 1)}
    assert abs(share[0] - 0.25) < 0.03
    assert abs(len({r["doc_id"] for r in rows if r["grown_shard"] == 3 and r["doc_id"] is not None}) / 6000 - 1 / 3) < 0.03
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is None} == {(1, 0)}
    assert sharding.assign_shards(df.limit(0), "doc_id", "text", [1.0], [1.0, 1.0]).collect() == []


def test_no_python_on_the_way(small):
    spark, sf_dir = small
    plan = QUERIES["op6_rendezvous_shards"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ranks_over_the_whole_table(small):
    spark, _ = small
    df = spark.range(5000, numPartitions=9).select("id", (F.xxhash64("id") % 50).alias("v"))
    rows = global_rank(df, [F.col("v").desc(), F.col("id")], "place").collect()
    assert [r["place"] for r in sorted(rows, key=lambda r: (-r["v"], r["id"]))] == list(range(1, 5001))


# Archives

@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(small, name):
    spark, sf_dir = small
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []


def test_records_are_found_by_the_index(small):
    spark, _ = small
    rng = random.Random(4)
    html = {i: "".join(rng.choice("<p>é \n") for _ in range(rng.randrange(900))) for i in range(120)}
    html |= {200: html[5], 201: "", 202: None, 203: "\r\n\r\nWARC/1.1\r\n", 204: "x" * 9000}
    df = spark.createDataFrame([(i, f"http://a/{i}?é\r\n", t) for i, t in html.items()], "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    marked = warc.mark_revisits(df, "page_id", "url", "html")
    index = warc.write_bundles(marked.repartition(3), folder, "2024-01-01T00:00:00Z", frame_bytes=2000)
    places = index.collect()
    assert len(places) == len(html) and len({(p["file"], p["frame"]) for p in places}) > 10
    for p in places:
        reader = warc.BundleReader(folder, p["file"])
        fields, block, end = warc.parse(reader.record(p["frame"], p["offset"], p["length"]))
        page, payload = int(p["page_id"]), (html[int(p["page_id"])] or "").encode()
        assert fields["WARC-Record-ID"] == f"<urn:page:{page}>" and end == p["length"] and "\r" not in fields["WARC-Target-URI"]
        head, _, body = block.partition(b"\r\n\r\n")
        assert body == (payload if fields["WARC-Type"] == "response" else b"") and f"Content-Length: {len(payload)}".encode() in head
        reader.close()
    # A plain reader sees all frames and skips the seek table.
    for name in {p["file"] for p in places}:
        reader = warc.BundleReader(folder, name)
        with open(f"{folder.removeprefix('file://')}/{name}", "rb") as plain:
            data = zstandard.ZstdDecompressor().stream_reader(plain, read_across_frames=True).read()
        assert data == b"".join(reader.frame(i) for i in range(len(reader.frames)))
        reader.close()


def test_revisits_of_odd_pages(small):
    spark, _ = small
    rows = [(3, "u", "same"), (1, "u", "same"), (None, "u", "same"), (2, None, None), (4, "", ""), (None, None, "alone"), (None, None, "alone"), (1, "u", "same"), (7, "u", "ab")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "sha": F.lit("x"), "payload": F.lit(2)})
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.warc_archive(df, "page_id", "url", "html").collect()), key=str)
    assert got == sorted([(3, 4, "revisit", 1), (1, 4, "response", None), (None, 4, "revisit", 1), (2, 0, "response", None), (4, 0, "revisit", 2),
                          (None, 5, "response", None), (None, 5, "response", None), (1, 4, "response", None), (7, 2, "response", None)], key=str)
    least = {(r["page_id"], r["record_type"]) for r in warc.warc_archive(df, "page_id", "url", "html", least_bytes=3).collect()}
    assert (4, "response") in least and (3, "revisit") in least
    assert warc.warc_archive(df.limit(0), "page_id", "url", "html").collect() == []
