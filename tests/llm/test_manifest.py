"""Exact duplicates, Merkle manifests and periodic runs against literal versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from courierlens.llm import exact, merkle
from courierlens.llm.queries import QUERIES, SQL
from courierlens.llm.trie import Trie


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# Exact duplicates

def owners(rows, largest):
    """Per text: the id that stays, and the number of rows."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    best = max if largest else min
    return {t: (best((k for k in keys if k is not None), default=None), len(keys)) for t, keys in groups.items()}


def check_owners(rows, df, keep="smallest", **sizes):
    found = exact.exact_owners(df, "doc_id", "text", keep=keep, **sizes).collect()
    want = owners(rows, keep == "largest")
    names = {sha(t): v for t, v in want.items()}
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_sha256"]) for r in found) == sorted((k is not None, k or 0, sha(t or "")) for k, t in rows)
    kept = defaultdict(int)
    for r in found:
        assert (r["keep_id"], r["group_size"]) == names[r["text_sha256"]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) <= {1} and len(kept) == len(want)


def test_owners_of_the_given_documents(small):
    spark, sf_dir = small
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    check_owners(rows, df, "largest")
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in QUERIES["op12_patricia_owners"](spark, sf_dir).collect()}
    want = owners(rows, True)
    assert found == {k: (want[t or ""][0], want[t or ""][0] == k) for k, t in rows}


def test_owners_of_odd_documents(odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    for keep in ("smallest", "largest"):
        check_owners(rows, odd_documents, keep)
    assert exact.exact_owners(odd_documents.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        exact.exact_owners(odd_documents, "doc_id", "text", keep="any")


def nested_texts(rng, n):
    """Texts that are prefixes of each other, share long beginnings or are repeated, a third of them the same."""
    base = "".join(rng.choice("ab") for _ in range(400))
    texts = [base[:rng.randrange(1, 400)] + rng.choice(["", "x", "y" * 90, "\0", "é🙂"]) for _ in range(n // 2)]
    texts += [base] * (n // 3)
    return texts + [None, "", "", "b", "a" * 20_000, "a" * 20_001]


@pytest.mark.parametrize("budget", [1 << 20, 30_000, 1])
def test_subtrees_that_are_given_away(small, budget):
    spark, _ = small
    rng = random.Random(3)
    rows = list(enumerate(nested_texts(rng, 600)))
    rows += [(None, "b"), (7, "b"), (7, "b"), (None, "only without key"), (None, "only without key")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_owners(rows, df, "largest", trie_bytes=budget, part_bytes=1 << 14 if budget > 1 else 1 << 20)


def test_a_trie_holds_or_refuses_all_copies_of_a_string():
    rng = random.Random(9)
    texts = [t.encode() for t in nested_texts(rng, 300) if t is not None]
    trie, refused, taken = Trie(), defaultdict(int), defaultdict(int)
    for at, text in enumerate(texts * 2):
        if not trie.insert(text, (at,), 1, None):
            refused[text] += 1
        while trie.held > 12_000 and (away := trie.take_largest()) is not None:
            for t, (_, copies, _) in away:
                taken[t] += copies
    held = {t: entry for t, entry in trie.terminals()}
    assert held and taken and refused and not set(held) & (set(taken) | set(refused))
    want = defaultdict(int)
    for text in texts * 2:
        want[text] += 1
    assert want == {t: held[t][1] if t in held else taken[t] + refused[t] for t in want}
    assert all(entry[0] == (texts.index(t),) for t, entry in held.items())
    assert len(list(trie.entries())) == len(held)


# Manifest

def tree_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + 3])) for i in range(0, len(below), 3)])
    return levels


def siblings(levels, i):
    path = []
    for level in levels[:-1]:
        run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(level)))
        path.append(([level[j] for j in run if j < i], [level[j] for j in run if j > i]))
        i //= 3
    return path


def literal_manifest(rows):
    """(doc_id, leaf) -> subroot, root, proof and the root that the altered row leads to."""
    def leaf(fields):
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = tree_levels([x[1] for x in groups[name]])
    top = tree_levels([trees[name][-1][0] for name in names])
    found = []
    for g, name in enumerate(names):
        for i, (key, digest, r) in enumerate(groups[name]):
            path = siblings(trees[name], i) + siblings(top, g)
            altered = key is not None and zlib.crc32(str(key).encode()) % 2 == 0 and r[4] is not None
            folded = leaf((*r[:4], r[4].replace("\n", ""))) if altered else digest
            for left, right in path:
                folded = sha("".join([*left, folded, *right]))
            proof = sha("".join("".join(a + b) for a, b in path))
            found.append((key, digest, trees[name][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(found, key=str)


def test_manifest_of_the_given_documents(small):
    spark, sf_dir = small
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, sf_dir).collect()), key=str)
    assert found == literal_manifest(rows)
    assert 0 < sum(r[6] for r in found) < len(found)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_over_several_tiers(small, tmp_path, levels):
    """Null sources and ids, repeated rows, a hot source, many sources of one row, builders of few leaves."""
    spark, _ = small
    rng = random.Random(levels)
    rows = [(i, rng.choice([None, "", "é", "a", "hot", "hot", "hot", f"s{i % 40}"]), rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", "a\nb", "x"]))
            for i in range(260)]
    rows += [(None, "hot", None, None, "y"), (None, "hot", None, None, "y"), (5, "hot", "en", 1, "z\n"), (5, "hot", "en", 1, "z\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns(
        {c: F.lit(1) for c in ("tree", "n", "index", "digest", "_part", "block")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    held = merkle.manifest(df.select("doc_id", "source", merkle.leaf_digest(fields).alias("leaf")), "source", "doc_id", "leaf", levels)
    shown = held.leaves.select("doc_id", "tree", "index", F.lower(F.hex("digest")).alias("shown"))
    found = merkle.proofs(held, shown).collect()
    want = literal_manifest(rows)
    assert sorted((r["doc_id"], r["shown"], r["subroot"], r["root"], r["proof_sha256"]) for r in found if r["doc_id"] is not None) == sorted(w[:5] for w in want if w[0] is not None)
    assert all(r["folded_root"] == r["root"] for r in found) and len(found) == len(want)
    # Every log lists its nodes in the order in which they are complete, without gaps.
    for logs in (held.logs, held.top):
        places = defaultdict(list)
        for log in logs:
            for r in log.collect():
                places[r["tree"], r["n"]].append(r["place"])
        for (_, n), of_tree in places.items():
            size, nodes = n, n
            while size > 1:
                size = -(-size // 3)
                nodes += size
            assert sorted(of_tree) == list(range(nodes))
    assert sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()), key=str) == want


def test_places_follow_the_order_of_completion():
    for n in [*range(1, 100), 243, 244, 729]:
        nodes = list(merkle.append([sha(str(i)) for i in range(n)], 0, merkle.height(n), 0))
        level, index = np.array([x[0] for x in nodes]), np.array([x[1] for x in nodes])
        assert merkle.place(level, index, n).tolist() == list(range(len(nodes)))


def test_manifest_of_an_empty_table(small, tmp_path):
    spark, sf_dir = small
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op12_patricia_owners", "op13_merkle_manifest"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op12_patricia_owners", "op13_merkle_manifest"])
def test_same_rows_as_sql(small, name):
    spark, sf_dir = small
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []
