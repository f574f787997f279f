"""Quality filter by hashed n-grams, and importance resampling.

Generative models are counted over hashed n-grams: of the target (documents labelled good) and of
all raw documents. N-grams are words, pairs of words, and windows of six bytes at every character
(six letters of Latin script, three of Cyrillic, two of Chinese). A document's log weight is
log p(target) - log p(raw): over all its n-grams, each as often as it occurs, the sum of the log
ratios of their smoothed probabilities, which may have either sign. Each kind of n-grams is a
model of its own, and the three ratios are multiplied.

Whether a document is accepted is told by another number, its score. It has two parts, both
independent of length:

- of words, of their first four, six and eight bytes, and of windows that begin beyond ASCII,
  presence per document. One of them counts against a document if the target has it less often
  than raw text does, even at the upper bound of what the target's count may be by chance. Those
  too rare to tell count nothing.
- of pairs of word shapes (case, digits, punctuation, repetition of the word before), the mean
  log ratio over the document, times a factor.

A document is accepted if its score reaches the threshold that separates labelled documents best.
Importance resampling draws documents without replacement in proportion to their weights: the k
with the largest log weight plus Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierlens.llm.shared import global_rank, saved
from courierlens.llm.sharding import unit
from courierlens.llm.words import runs, sliced, word_forms

#: Lengths of the n-grams at the start of words, bytes of a window, buckets of each kind of n-grams (a power of two) and shapes of words.
HEADS = (4, 6, 8)
WINDOW = 6
GRAM_BITS = 18
SHAPES = 64
#: Labelled rows that the target model and the threshold are fitted on, drawn by a hash of their id.
LABELLED_ROWS = 30_000
#: Counting tasks per core, and bytes of texts that are looked at together.
TASKS, SLICE_BYTES = 4, 1 << 19
#: Weight of the mean over shapes against a single word n-gram.
SHAPE_FACTOR = 10.0
#: How much keeping good documents counts against finding bad ones when the threshold is chosen.
KEEP = 10.0

#: Kinds that are counted as often as they occur, and kinds of which presence in a text counts.
_KINDS, _HELD = 3, 2 + len(HEADS)
_HELD_FROM = _KINDS << GRAM_BITS
_SHAPES_FROM = (_KINDS + _HELD) << GRAM_BITS
_BUCKETS = _SHAPES_FROM + SHAPES * SHAPES


def _once(buckets: np.ndarray, firsts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """True for one occurrence of each bucket in each text. ``place`` is room for a number per bucket."""
    found = np.empty(len(buckets), bool)
    numbers = np.arange(len(buckets), dtype=np.int32)
    for first, behind in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        some, own = buckets[first:behind], numbers[first:behind]
        place[some] = own
        found[first:behind] = place[some] == own
    return found


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and the text of each: of n-grams, all that occur; of what counts once per text; of pairs of shapes."""
    (words, *heads), shapes, firsts, windows, window_firsts, wide = word_forms(texts, HEADS, WINDOW)
    numbers = np.arange(len(texts))
    owner, of_window = np.repeat(numbers, np.diff(firsts)), np.repeat(numbers, np.diff(window_firsts))
    within = owner[1:] == owner[:-1]
    shift, place = np.uint64(64 - GRAM_BITS), np.zeros(1 << GRAM_BITS, np.int32)
    small = [(h >> shift).astype(np.int64) for h in (words, runs(words, 2)[within], windows, *heads)]
    grams = np.concatenate([b + (i << GRAM_BITS) for i, b in enumerate(small[:_KINDS])])
    wide_firsts = np.concatenate([[0], np.cumsum(np.bincount(of_window[wide], minlength=len(texts)))])
    held = [(small[0], owner, firsts), (small[2][wide], of_window[wide], wide_firsts), *[(b, owner, firsts) for b in small[_KINDS:]]]
    once = [_once(b, f, place) for b, _, f in held]
    holding = np.concatenate([b[o] + ((_KINDS + i) << GRAM_BITS) for i, ((b, _, _), o) in enumerate(zip(held, once))])
    of_holding = np.concatenate([t[o] for (_, t, _), o in zip(held, once)])
    before = np.full(len(shapes), SHAPES - 1)
    before[1:] = np.where(within, shapes[:-1], SHAPES - 1)
    return [(grams, np.concatenate([owner, owner[1:][within], of_window])), (holding, of_holding), (_SHAPES_FROM + before * SHAPES + shapes, owner)]


def counts(df: DataFrame) -> DataFrame:
    """(bucket, n) over rows of (text), with the number of texts as bucket -1.

    A task gives out a row for nearly every bucket, however little it reads, so small input partitions are
    read together: there are no more than TASKS tasks for each core.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(_BUCKETS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, texts in sliced(batch.column(0).to_pylist(), SLICE_BYTES):
                total += np.bincount(np.concatenate([b for b, _ in features(texts)]), minlength=_BUCKETS)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 50_000):
            part = some[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["bucket", "n"])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([rows])], ["bucket", "n"])

    tasks = TASKS * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(tasks).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class WeightModel:
    """Log ratios of the buckets of n-grams, penalties of those behind them (of shapes: their part of the score), and the least score accepted.

    Of fixed size, in single precision, since every task gets them.
    """

    ratios: np.ndarray
    penalties: np.ndarray
    threshold: float

    def weights(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log weights and scores."""
        (grams, of_grams), (held, of_held), (pairs, of_pairs) = features(texts)
        weight = np.bincount(of_grams, self.ratios[grams], len(texts))
        words = np.bincount(of_held, self.penalties[held - _HELD_FROM], len(texts))
        shapes = np.bincount(of_pairs, self.penalties[pairs - _HELD_FROM], len(texts)) / np.maximum(np.bincount(of_pairs, minlength=len(texts)), 1)
        return weight, words + SHAPE_FACTOR * shapes


@dataclass(frozen=True)
class Counted:
    """The count of each bucket, and the number of texts."""

    n: np.ndarray
    rows: int


def _dense(counted: DataFrame) -> Counted:
    table, rows = np.zeros(_BUCKETS), 0
    for batch in counted.select("bucket", "n").toArrow().to_batches():
        bucket, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        table[bucket[bucket >= 0]] = n[bucket >= 0]
        rows += int(n[bucket < 0].sum())
    return Counted(table, rows)


def log_ratios(target: Counted, raw: Counted) -> np.ndarray:
    """Per bucket log p(target) - log p(raw), each kind of n-grams by itself.

    Both are smoothed by the same number per bucket: one occurrence in a text as long as the target.
    """
    found = np.zeros(_HELD_FROM, np.float32)
    for kind in range(_KINDS):
        own = slice(kind << GRAM_BITS, (kind + 1) << GRAM_BITS)
        expected = raw.n[own] * (target.n[own].sum() / max(raw.n[own].sum(), 1))
        found[own] = np.log((target.n[own] + 1) / (expected + 1))
    return found


def penalties(target: Counted, raw: Counted) -> np.ndarray:
    """Per bucket from _HELD_FROM on its part of the score; see the module's text for the two parts."""
    held, shapes = slice(_HELD_FROM, _SHAPES_FROM), slice(_SHAPES_FROM, None)
    words = _SHAPES_FROM - _HELD_FROM
    found = np.zeros(_BUCKETS - _HELD_FROM, np.float32)
    expected = raw.n[held] * (target.rows / max(raw.rows, 1))
    at_most = target.n[held] + 8 * np.sqrt(target.n[held]) + 4
    found[:words] = np.minimum(0, np.log(at_most / np.maximum(expected, 1e-9)))
    expected = raw.n[shapes] * (target.n[shapes].sum() / max(raw.n[shapes].sum(), 1))
    found[words:] = np.log((target.n[shapes] + 1) / (expected + 1))
    return found


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut, in the middle of its gap, with the best shares of good rows kept (which count KEEP times) and bad rows not kept."""
    if not len(good) or not len(bad):
        return float("-inf")
    values = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), values, "left") / len(good)
    gone = np.searchsorted(np.sort(bad), values, "left") / len(bad)
    at = int((KEEP * kept + gone).argmax())
    return float(values[0] - 1) if not at else float((values[at] + values[at - 1]) / 2)


def labelled_texts(texts: DataFrame, labels: DataFrame, label_key: str, good: Column, labelled_rows: int) -> DataFrame:
    """(good, text), a row for each labelled key that is drawn and found among (key, text); see ``fit``."""
    each = labels.select(labels[label_key].alias("of"), F.coalesce(good, F.lit(False)).cast("long").alias("good")).filter(F.col("of").isNotNull())
    keys = saved(each.groupBy("of").agg(F.min("good").alias("good")), "labels")
    share = min(1.0, labelled_rows / max(keys.count(), 1))
    drawn = keys.filter(F.pmod(F.xxhash64("of"), F.lit(1_000_000)) < share * 1_000_000)
    # A row of two numbers per drawn key, so every task can have them.
    joined = texts.join(F.broadcast(drawn), F.col("key") == F.col("of"))
    one = joined.groupBy("of").agg(F.min("good").alias("good"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return saved(one, "labelled").select("good", "text")


def fit(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, good: Column, labelled_rows: int = LABELLED_ROWS) -> WeightModel:
    """Counts the raw model over all documents, and target model and threshold over labelled ones.

    About ``labelled_rows`` labelled keys are drawn by a hash if there are more. A key counts once: it is good
    if all of its labels say so (one whose ``good`` is null does not), and where several rows have it,
    the text with the smallest hash stands for them. So the rows fitted on, and the scores of these
    that reach the driver, are as many as the keys drawn. Without good documents all weights are 0
    and all are accepted. Counts per bucket, of fixed size, reach the driver too.
    """
    texts = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    labelled = labelled_texts(texts, labels, label_key, good, labelled_rows)
    target = _dense(counts(labelled.filter("good = 1").select("text")))
    if not target.rows:
        return WeightModel(np.zeros(_HELD_FROM, np.float32), np.zeros(_BUCKETS - _HELD_FROM, np.float32), float("-inf"))
    raw = _dense(counts(texts.select("text")))
    model = WeightModel(log_ratios(target, raw), penalties(target, raw), float("-inf"))
    scored = weigh(labelled, "text", model, "weight", "score").select("good", "score").toArrow()
    is_good, score = scored.column("good").to_numpy() == 1, scored.column("score").to_numpy()
    return replace(model, threshold=best_threshold(score[is_good], score[~is_good]))


def weigh(df: DataFrame, text: str, model: WeightModel, weight: str, score: str) -> DataFrame:
    """All columns of ``df`` and each row's log weight and score. A null text or one without words has 0 in both. No shuffle."""
    schema = df.select("*", F.lit(0.0).alias(weight), F.lit(0.0).alias(score)).schema
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, behind, texts in sliced(batch.column(at).cast(pa.string()).to_pylist(), SLICE_BYTES):
                part = batch.slice(first, behind - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, model.weights(texts))], schema.names)

    return df.mapInArrow(run, schema)


def gumbel(key: Column, seed: int = 0) -> Column:
    """Standard Gumbel noise that depends on a key and a seed alone."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/gumbel/{seed}"))
    return -F.ln(-F.ln(unit(name)))


def resample(weighed: DataFrame, key: str, weight: str, k: int, seed: int = 0) -> DataFrame:
    """All rows of (key, weight, ...) with sample_key and sampled: whether they are among the ``k`` drawn.

    Rows are ranked over the whole table by range partitions; ties go to the smaller key.
    """
    keyed = weighed.withColumn("sample_key", F.col(weight) + gumbel(F.col(key), seed))
    ranked = global_rank(keyed, [F.col("sample_key").desc(), F.col(key).asc_nulls_last()], "_rank")
    return ranked.withColumn("sampled", F.col("_rank") <= k).drop("_rank")


def select_quality(df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, good: Column, share: float = 0.5) -> DataFrame:
    """One row per row of ``df``: ``key``, log_weight, accepted, sample_key, sampled.

    ``share`` of the number of accepted rows are sampled, out of all. Null keys are rows like any
    others and share their noise; repeated rows have equal weights.
    """
    model = fit(df, key, text, labels, label_key, good)
    rows = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    accepted = (F.col("score") >= model.threshold).alias("accepted")
    weighed = saved(weigh(rows, "text", model, "log_weight", "score").select("key", "log_weight", accepted), "weights")
    k = int(share * weighed.filter("accepted").count())
    drawn = resample(weighed, "key", "log_weight", k)
    return drawn.select(F.col("key").alias(key), "log_weight", "accepted", "sample_key", "sampled")
