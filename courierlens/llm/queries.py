"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlens.llm import bpe, exact, language, lattice, merkle, minhash, multi_index, packing, periodic, quality, sharding, token_files, warc
from courierlens.llm.shared import prepare, table

#: Id that ends each document in the token files.
END_ID = 2
#: Tokens of a sequence in the token files.
SEQUENCE_LENGTH = 2048
SHARDS = 8
#: Sequence lengths, in tokens, that documents are packed into, and what a sequence costs.
SEQUENCE_COSTS = {n: packing.attention_cost(n) for n in (512, 1024, 2048, 4096)}
#: One vector in so many is a query.
QUERY_STEP = 100


def good_label() -> Column:
    """Labels of the target: good quality and not toxic."""
    return (F.col("quality") == 1) & (F.col("toxic") == 0)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with a similarity of 0.8 or more on shingles of four words."""
    return minhash.similar_texts(table(prepare(spark), sf_dir, "documents"), "doc_id", "text", shingle=4, percent=80)


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of every hundredth vector among all."""
    embeddings = table(prepare(spark), sf_dir, "embeddings")
    return multi_index.nearest(embeddings, "vec_id", "embedding", F.col("vec_id") % QUERY_STEP == 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Arrow files of equal-length id sequences, read back."""
    documents = table(prepare(spark), sf_dir, "documents")
    return token_files.token_files(documents, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE_LENGTH, added=True)


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded by prefix dynamic programming."""
    documents = table(prepare(spark), sf_dir, "documents")
    return bpe.encode_texts(documents, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of token ids of four permitted lengths, read back: where each piece lies, with a hash of its ids."""
    documents = table(prepare(spark), sf_dir, "documents")
    sequences = packing.pack_texts(documents, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), SEQUENCE_COSTS)
    return packing.packed_pieces(sequences, "doc_id")


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to eight shards, and to nine."""
    documents = table(prepare(spark), sf_dir, "documents")
    return sharding.assign_shards(documents, "doc_id", "text", [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records in seekable Zstandard bundles, read back."""
    return warc.warc_archive(table(prepare(spark), sf_dir, "pages"), "page_id", "url", "html", least_bytes=0)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents for clean text of good quality, and a sample of half as many as are accepted."""
    prepare(spark)
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.select_quality(documents, "doc_id", "text", labels, "doc_id", good_label(), share=0.5)


def op9_lattice_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between vectors with a cosine of 0.95 or more, and their components."""
    return lattice.similar_vectors(table(prepare(spark), sf_dir, "embeddings"), "vec_id", "embedding", threshold=0.95)


def op10_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.identify(table(prepare(spark), sf_dir, "documents"), "doc_id", "text", "lang")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """Documents chosen by the checksum of their id repeat a stretch of their words up to the end."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    chosen = documents.withColumns({"_h": F.when(checksum % 10 == 0, F.expr("crc32(cast(doc_id as string)) div 10")),
                                    "_words": F.when(checksum % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))})
    first = chosen.withColumn("_n", F.size("_words")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_h") % F.col("_n")).cast("int"))
    period = first.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _h % 8) as int)"))
    copies = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.expr("cast((_n - _a) div _p + 1 as int)")))
    repeated = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(copies, F.lit(1), F.col("_n") - F.col("_a")))
    return period.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of four periods or more in all documents, some of them planted, and digests of what is left without them."""
    documents = table(prepare(spark), sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    found = periodic.periodic_runs(with_planted_runs(documents), "doc_id", "text")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"), F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several equal documents stays: the one with the largest id."""
    found = exact.exact_owners(table(prepare(spark), sf_dir, "documents"), "doc_id", "text", keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the documents, a tree per source, and every document held against it, half of them altered."""
    documents = table(prepare(spark), sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    altered = merkle.leaf_digest([*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    leaf, chosen = merkle.leaf_digest(fields), F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = documents.select("doc_id", "source", leaf.alias("leaf"), F.when(chosen, altered).otherwise(leaf).alias("shown"))
    held = merkle.manifest(rows, "source", "doc_id", "leaf")
    shown = held.leaves.select("doc_id", "tree", "index", "shown", F.lower(F.hex("digest")).alias("leaf"))
    return merkle.proofs(held, shown).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                                             (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_multi_index": op2_multi_index,
    "op3_token_files": op3_token_files,
    "op4_prefix_bpe": op4_prefix_bpe,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_rendezvous_shards": op6_rendezvous_shards,
    "op7_warc_bundles": op7_warc_bundles,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_lattice_vectors": op9_lattice_vectors,
    "op10_language_filters": op10_language_filters,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_patricia_owners": op12_patricia_owners,
    "op13_merkle_manifest": op13_merkle_manifest,
}


#: Five hexadecimal digits of the SHA-1 are four digits to the base 32, whose fixed alphabet this is.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGIT = f"substr('{_BASE32}', ((('0x' || substr(sha, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)"
_DIGEST = f"array_to_string(list_transform(range(32), lambda i: {_DIGIT}), '')"

_REACH = """
     sides AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
     reach AS (SELECT DISTINCT i AS id, i AS other FROM sides UNION SELECT reach.id, sides.j FROM reach JOIN sides ON sides.i = reach.other),
     named AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""

#: A leaf: every field as ``-`` or its number of bytes, a colon and the value.
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + ", " + _FIELD.replace("{0}", "{text}") + "))"
_SIDES = """coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
                      coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS behind"""


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII string: bit by bit, by the fixed reflected polynomial 0xEDB88320."""
    byte = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT))"
    step = "CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END"
    of_byte = f"list_reduce(list_prepend(xor(x, b), range(8)::UBIGINT[]), lambda y, _: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {byte}), lambda x, b: {of_byte}), 4294967295::UBIGINT)"


_CRC = _crc32("CAST(doc_id AS VARCHAR)")
_EVEN_CRC = f"{_CRC} % 2 = 0"

#: Queries that SQL can express, over whole tables. Both compare all documents that share a shingle, or all vectors.
SQL: dict[str, str] = {
    "op1_minhash_dedup": f"""
WITH RECURSIVE
     words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     sets AS (SELECT doc_id, CASE WHEN len(w) BETWEEN 1 AND 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(
                     list_transform(range(greatest(len(w) - 3, 0)), lambda i: array_to_string(w[i + 1:i + 4], ' '))) END AS s FROM words),
     elements AS (SELECT doc_id, unnest(s) AS x FROM sets),
     shared AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS n FROM elements a JOIN elements b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
     links AS (SELECT i, j FROM shared JOIN sets a ON a.doc_id = i JOIN sets b ON b.doc_id = j WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)),
{_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN named ON id = doc_id""",
    "op9_lattice_vectors": f"""
WITH RECURSIVE
     vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
     usable AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS size FROM vectors
                WHERE len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_inner_product(x, x) > 0),
     links AS (SELECT a.vec_id AS i, b.vec_id AS j FROM usable a JOIN usable b
               ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) AND list_inner_product(a.x, b.x) / a.size / b.size >= 0.95),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM sides WHERE i = vec_id) AS n_links, coalesce(component, vec_id) AS component_id,
       coalesce(component, vec_id) = vec_id AS kept FROM vectors LEFT JOIN named ON id = vec_id""",
    "op7_warc_bundles": f"""
        WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
             named AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM hashed)
        SELECT page_id, payload_bytes, {_DIGEST} AS payload_digest,
               CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM named""",
    "op11_periodic_runs": f"""
WITH found AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC} AS h FROM documents),
     sized AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM found),
     dealt AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized),
     words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE
                      list_transform(range(n), lambda i: w[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT)]) END) AS word FROM dealt),
     equal AS (SELECT doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y USING (doc_id, word) WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
     stretches AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
     long AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM stretches GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
     runs AS (SELECT doc_id, start, length, min(q) AS period FROM long GROUP BY doc_id, start, length),
     listed AS (SELECT doc_id, count(*) AS n_runs, arg_max(struct_pack(start, length, period), row(length, -start, -period)) AS best,
                       string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
     dropped AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM found LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_patricia_owners": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             owners AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN owners USING (text)""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE
     d AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="replace(text, chr(10), '')")} AS altered FROM documents),
     leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
                       count(*) OVER (PARTITION BY source) AS n FROM d),
     nodes AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM leaves
               UNION ALL
               SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 3, n),
     subroots AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1),
     above AS (SELECT 0 AS level, tree - 1 AS i, count(*) OVER () AS n, subroot AS h FROM subroots
               UNION ALL
               SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY level, i // 3, n),
     steps AS (SELECT a.tree, a.level, a.i, {_SIDES} FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3
               WHERE a.n > 1 GROUP BY ALL),
     above_steps AS (SELECT a.level, a.i, {_SIDES} FROM above a JOIN above b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
     tall AS (SELECT tree, max(level) AS levels FROM nodes GROUP BY tree),
     path AS (SELECT l.doc_id, s.level, s.before, s.behind FROM leaves l JOIN steps s ON s.tree = l.tree AND s.i = l.i // CAST(pow(3, s.level) AS BIGINT)
              UNION ALL
              SELECT l.doc_id, t.levels + s.level, s.before, s.behind FROM leaves l JOIN tall t ON t.tree = l.tree
              JOIN above_steps s ON s.i = (l.tree - 1) // CAST(pow(3, s.level) AS BIGINT)),
     proofs AS (SELECT doc_id, sha256(string_agg(before || behind, '' ORDER BY level)) AS proof_sha256 FROM path GROUP BY doc_id),
     folded AS (SELECT doc_id, 0 AS level, CASE WHEN {_EVEN_CRC} THEN altered ELSE leaf END AS h FROM leaves
                UNION ALL
                SELECT f.doc_id, f.level + 1, sha256(p.before || f.h || p.behind) FROM folded f JOIN path p ON p.doc_id = f.doc_id AND p.level = f.level),
     ends AS (SELECT doc_id, arg_max(h, level) AS folded_root FROM folded GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), (SELECT h AS root FROM above WHERE n = 1)""",
}
