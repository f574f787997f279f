"""The pipeline's steps as filters: what comes back has the columns of what came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.llm import language, minhash, packing, quality
from courierlens.llm.shared import fresh, saved

#: A document whose best language has a smaller share of its n-grams is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def keep_known_language(docs: DataFrame, key: str, text: str, lang: str, least: float = LEAST_LANGUAGE_SCORE) -> DataFrame:
    """Documents whose text is in one of the languages of ``lang``, by the Bloom filters of these.

    Filters are learned from all documents with a language. Rejected are texts that are null or have
    no letter, and those with less than ``least`` of their n-grams in any language's filter. If no
    document has a language, those with letters stay.
    """
    filters = language.learn_filters(docs, text, lang, F.coalesce(F.col(key).cast("string"), F.lit("")))
    if not filters.languages:
        return docs.filter(F.col(text).cast("string").rlike(r"\p{L}"))
    names = [fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")]
    found = language.predict_language(docs, text, filters, *names)
    return found.filter((F.col(names[0]) != language.UNDETERMINED) & (F.col(names[1]) >= least)).select(*docs.columns)


def keep_good_quality(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, good: Column) -> DataFrame:
    """Documents whose score reaches the threshold fitted on the labelled ones among them.

    A null text, and one without words, has the score 0 like any other text without evidence. Labels without
    key, or of other documents, count nothing; without good ones all documents stay. Repeated rows are
    judged alike, and all of them stay or go. An empty table gives none.
    """
    model = quality.fit(docs, key, text, labels, label_key, good)
    names = [fresh(docs.columns, "log_weight"), fresh(docs.columns, "score")]
    return quality.weigh(docs, text, model, *names).filter(F.col(names[1]) >= model.threshold).select(*docs.columns)


def keep_one_of_similar(docs: DataFrame, key: str, text: str, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest key.

    A document is a key with a text, so texts that share a key are judged one by one: of a group's
    texts under its smallest key the one with the smallest digest stays. Of rows that repeat a key and
    its shingles one stays, chosen by a hash of all columns. Documents without key stay, and so
    do those without words, but of rows equal in all columns with a key one stays. An empty table gives none.
    """
    judged = minhash.judged(docs.select(docs[key].alias("k"), docs[text].alias("t")), "k", "t", shingle, percent)
    found = saved(judged.filter("k is not null").select("k", "set_key", "first"), "similar")
    keys = found.groupBy("k").agg(F.min("first").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    keys = saved(keys.filter("not _kept or _rows > 1"), "similar-keys")
    name, digest, row = (fresh(docs.columns, c) for c in ("_key", "_digest", "_row"))
    left = _without(docs, key, keys.withColumnRenamed("k", name), name)

    # Keys of several rows are looked at by key and shingles: few, unless rows are repeated.
    again = keys.filter("_rows > 1").select(F.col("k").alias(name))
    stay = found.filter("first").join(again, F.col("k") == F.col(name), "left_semi").distinct().select(F.col("k").alias(name), F.col("set_key").alias("_of"))
    repeated = minhash.with_set_keys(docs.join(again, docs[key] == F.col(name), "left_semi"), text, shingle, digest)
    repeated = repeated.join(stay, (repeated[key] == F.col(name)) & repeated[digest].eqNullSafe(F.col("_of")), "left_semi")
    whole = F.xxhash64(*[F.col(c) for c in docs.columns])
    one = repeated.groupBy(key, digest, F.when(F.col(digest).isNull(), whole).alias(name)).agg(
        F.min_by(F.struct(*[F.col(c) for c in docs.columns]), whole).alias(row))
    return left.unionByName(one.select(f"{row}.*"))


def _without(docs: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    few = keys.count() <= minhash.MOST_BROADCAST
    return docs.join(F.broadcast(keys) if few else keys, docs[key] == F.col(name), "left_anti")


def pack_tokens(docs: DataFrame, key: str, text: str, vocabulary: str, costs: dict[int, float]) -> DataFrame:
    """Where each piece of each document lies in which sequence of token ids, read back from the sequences.

    A null or empty text is its end id. Null keys and repeated rows are documents of their own. An empty table
    gives no rows.
    """
    return packing.packed_pieces(packing.pack_texts(docs, key, text, vocabulary, costs), key)


def pack_words(docs: DataFrame, key: str, text: str, costs: dict[int, float]) -> DataFrame:
    """Documents in sequences of the permitted lengths, by their number of words. Nulls and empty texts have
    size 0, repeated rows are documents of their own, an empty table gives no rows."""
    return packing.pack_documents(docs, key, packing.word_count(F.col(text)), costs)
