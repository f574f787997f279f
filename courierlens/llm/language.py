"""Language identification with bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of its frequent n-grams. The filters are stored bit-sliced:
one row per filter position, one bit per language, so one look-up per hash gives all languages
at once, and the rows of an n-gram's hashes, ANDed, are the languages that contain it. Per
language the hits of a text are counted and corrected for its filter's false positives.

An n-gram is three letters or borders of words, lower-cased; anything that is not a letter is a
border.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierlens.llm.pieces import slices

#: Filter positions (a power of two) and hashes per n-gram.
POSITION_BITS, HASHES = 18, 3
#: Documents per language that the filters are learned from; a larger training set is sampled by hash.
SAMPLE_DOCUMENTS = 3000
#: An n-gram belongs to a language if it makes up this share of the language's n-grams at least, and
#: if no other language has it more than so many times as often.
LEAST_SHARE, MOST_TIMES = 1e-5, 5.0
#: Characters handled at once in a task.
SLICE_CHARS = 1_000_000
#: What a text without letters gets.
UNDETERMINED = "und"

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each character its lower-case letter, or 0 for what is not a letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _letters.append(table)
    return _letters[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of some texts as 64-bit numbers, and the text that each belongs to."""
    sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
    joined = "\n" + "\n".join(t or "" for t in texts)
    codes = _letter_table()[np.frombuffer((joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.append(np.repeat(np.arange(len(texts), dtype=np.int64), sizes), len(texts))
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, owner = codes[kept].astype(np.uint64), owner[kept]
    # A border in front of a text is its own; of two in a row at an empty text the first is kept, so
    # n-grams that start at a border go to the owner of the letter behind it.
    owner[:-1] = np.where(codes[:-1] == 0, owner[1:], owner[:-1])
    grams = codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)
    inside = codes[1:-1] != 0
    return grams[inside], owner[:-2][inside]


def positions(grams: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    mixed = grams * _FACTORS[0]
    mixed ^= mixed >> np.uint64(32)
    for factor in _FACTORS[1:hashes + 1]:
        yield ((mixed * factor) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Filters:
    """``rows[position]`` holds one bit per language, in words of 64. Its size is fixed by the parameters."""

    languages: tuple[str, ...]
    fallback: int
    rows: np.ndarray
    hashes: int

    @property
    def false_positive(self) -> np.ndarray:
        filled = [((self.rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(filled) ** self.hashes

    def shares(self, texts: list[str | None], wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the corrected share of n-grams found, and per text their number."""
        grams, owner = ngrams(texts)
        total = np.bincount(owner, minlength=len(texts))
        bits = int(np.log2(len(self.rows)))
        found = None
        for at in positions(grams, bits, self.hashes):
            found = self.rows[at] if found is None else found & self.rows[at]
        hits = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            has = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] = np.bincount(owner, weights=has, minlength=len(texts))
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1), total


def learn_filters(df: DataFrame, text: str, lang: str, key: Column, documents: int = SAMPLE_DOCUMENTS) -> Filters:
    """Filters from labelled rows: about ``documents`` rows per language, drawn by a hash of ``key``.

    Rows without language are left out. What comes to the driver is one row per language, of which there
    are as many as a label set has, and one per filter position and word of 64 languages, a number fixed by
    the parameters. Without rows there are no languages.
    """
    rows = df.filter(df[lang].isNotNull()).select(df[lang].cast("string").alias("lang"), df[text].cast("string").alias("text"),
                                                  F.pmod(F.xxhash64(key), F.lit(1_000_000)).alias("draw"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(counts))
    words = max(1, -(-len(languages) // 64))
    table = np.zeros((1 << POSITION_BITS, words), np.uint64)
    if not languages:
        return Filters((), 0, table, HASHES)
    numbers = {lang: i for i, lang in enumerate(languages)}
    most = {lang: documents / n * 1_000_000 for lang, n in counts.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.array([numbers[x] for x in batch.column(0).to_pylist()], np.int64)
            texts = batch.column(1).to_pylist()
            for first, behind in slices((len(t or "") for t in texts), SLICE_CHARS):
                grams, owner = ngrams(texts[first:behind])
                of = mine[first:behind][owner]
                for language in np.unique(of):
                    found, n = np.unique(grams[of == language], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), language)), pa.array(found.view(np.int64)), pa.array(n)], ["language", "gram", "n"])

    # One row per language, all of which the driver has just counted.
    draws = F.broadcast(df.sparkSession.createDataFrame(list(most.items()), "lang string, most double"))
    drawn = rows.join(draws, "lang").filter("draw < most").select("lang", "text")
    counted = drawn.mapInArrow(count, "language long, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    share = counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("language")))
    frequent = share.filter(F.col("share") >= LEAST_SHARE).withColumn("top", F.max("share").over(Window.partitionBy("gram")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, grams = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            bit = (np.uint64(1) << (language % 64).astype(np.uint64)).view(np.int64)
            for at in positions(grams, POSITION_BITS, HASHES):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(language // 64), pa.array(bit)], ["position", "word", "bits"])

    chosen = frequent.filter(F.col("share") * MOST_TIMES >= F.col("top")).select("language", "gram")
    filled = chosen.mapInArrow(place, "position long, word long, bits long").groupBy("position", "word").agg(F.bit_or("bits").alias("bits"))
    for batch in filled.toArrow().to_batches():
        at, word, bits = (batch.column(i).to_numpy() for i in range(3))
        table[at, word] = bits.view(np.uint64)
    return Filters(languages, numbers[max(languages, key=lambda x: (counts[x], x))], table, HASHES)


def predict_language(df: DataFrame, text: str, filters: Filters, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of ``df``, with the language and the share of n-grams that its filter contains.

    The language is the one with the largest corrected share, on a tie the first by name; if no
    n-gram is known, the language with most training rows. ``und`` and 0 for a null text or one
    without letters, and if no language was learned. Long texts are read whole. No shuffle.
    """
    if lang_name in df.columns or score_name in df.columns:
        raise ValueError("name the new columns otherwise")
    schema = df.select("*", F.lit("").alias(lang_name), F.lit(0.0).alias(score_name)).schema
    at_text = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong = filters.false_positive
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            for first, behind in slices((len(t or "") for t in texts), SLICE_CHARS):
                some = texts[first:behind]
                if filters.languages:
                    shares, total = filters.shares(some, wrong)
                    best = shares.argmax(axis=1)
                    scores = shares[np.arange(len(some)), best]
                    best[scores == 0] = filters.fallback
                else:
                    best, scores, total = np.zeros(len(some), int), np.zeros(len(some)), np.zeros(len(some), int)
                names = [filters.languages[b] if n else UNDETERMINED for b, n in zip(best, total)]
                part = batch.slice(first, behind - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(np.where(total > 0, scores, 0.0))], schema.names)

    return df.mapInArrow(run, schema)


def fold(key: Column) -> Column:
    """Remainder by which documents are held out: crc32 of the key as text, modulo 4. A null key is the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def identify(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key``, held_out, lang_pred and score of every row, with filters learned from the rows not held out.

    A null text, and one without letters, is ``und`` with score 0; so is every text if no row that is not held
    out has a language. A null key is held out or not as the empty text. Repeated rows are answered alike, each.
    Other columns are not read. An empty table gives none.
    """
    rows = df.select(df[key].alias("key"), df[text].cast("string").alias("text"), df[lang].alias("lang"))
    filters = learn_filters(rows.filter(fold(F.col("key")) != 2), "text", "lang", F.coalesce(F.col("key").cast("string"), F.lit("")))
    found = predict_language(rows.select("key", (fold(F.col("key")) == 2).alias("held_out"), "text"), "text", filters)
    return found.select(F.col("key").alias(key), "held_out", "lang_pred", "score")
