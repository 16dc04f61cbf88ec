"""Quality selection by importance resampling with hashed n-gram models.

Two bag-of-n-gram models over the same hashed slots are counted: one of target texts
(labelled as good), one of all raw texts.  A document's log weight adds its n-grams' log
ratios of target to raw.  A text's n-grams are far from independent, so they count as
at most ``EVIDENCE`` independent ones, in the models as in the weights: no long text
leads a model.  Documents are selected by Gumbel top-k: in proportion to the weights,
without replacement.  By default k comes from labelled rows that the models did not
learn from: with the least key that keeps target rows and loses others best, where
losing a target row weighs ``DOUBT`` times as much, k rows are expected.  A hot source,
which moves all weights alike, so moves the cut with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import masked, top_k_threshold, unmasked, written
from .features import bounded_counts, ngram_slots
from .textbytes import emit

SLOTS, EVIDENCE, PRIOR, DOUBT = 10_000, 50, 0.25, 20
UNIT = 1 << 26
"""What one n-gram counts: whole numbers add up to the same in any order."""
MAX_LABELS = 20_000
"""Labelled rows that the model learns from (those of least hashed id): a bound on what is broadcast."""
HELD_OUT = 5
"""One labelled row in so many is kept from the models, to find the cut."""


@dataclass(frozen=True)
class RatioModel:
    """Log ratio of target to raw by slot, and the labelled rows (key, value, held) of the fit."""

    log_ratio: np.ndarray
    labelled: DataFrame


def bounded_labels(labels: DataFrame, key: str, value: str, most: int = MAX_LABELS) -> DataFrame:
    """At most ``most`` labelled rows (key, value), the same at every run: least hashes of the key first."""
    named = labels.select(F.col(key).alias("key"), F.col(value).alias("value")).dropna().dropDuplicates(["key"])
    return named.orderBy(F.xxhash64("key"), "key").limit(most)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", slots: int = SLOTS, most: int = MAX_LABELS) -> RatioModel:
    """Counts both models in one pass over the whole texts of ``docs``.

    Labels (doc_id, ``label`` 1 for target) reach the pass as a bounded broadcast; raw
    counts cover every row.  Without any target label every ratio is one.
    """
    held = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(HELD_OUT)) == 0
    sample = written(bounded_labels(labels, "doc_id", label, most).withColumn("held", held), "labels")
    if sample.where((F.col("value") == 1) & ~F.col("held")).isEmpty():
        sample = sample.withColumn("held", F.lit(False))
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("key"), "left")
    marked = marked.select("text", F.coalesce((F.col("value") == 1) & ~F.col("held"), F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        for batch in batches:
            wanted = batch.column("target").to_numpy(zero_copy_only=False)
            for row, slot, doc, weight in bounded_counts(batch.column("text"), slots, EVIDENCE, UNIT):
                # Sums of whole numbers, exact in doubles.
                raw += np.bincount(slot, weight, slots).astype(np.int64)
                target += np.bincount(slot, weight * wanted[row + doc], slots).astype(np.int64)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["slot", "raw", "target"])

    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    counted = marked.mapInArrow(count, "slot long, raw long, target long").groupBy("slot").agg(total("raw"), total("target")).collect()
    raw, target = np.ones(slots), np.zeros(slots)
    for slot, r, t in counted:
        raw[slot] += int(r) / UNIT
        target[slot] += int(t) / UNIT
    if not target.any():
        return RatioModel(np.zeros(slots), sample)
    # Few counts say little: the target model is drawn to the raw one by PRIOR counts a slot.
    expected = raw / raw.sum()
    target = (target + PRIOR * slots * expected) / (target.sum() + PRIOR * slots)
    return RatioModel(np.log(target) - np.log(expected), sample)


def weigh(docs: DataFrame, model: RatioModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (default all) of ``docs`` with ``log_weight``; null where a text (null, empty, blank) has no token.

    A text of any length is weighed whole.  A column of that name (in any case) is replaced.
    """
    slots, ratio = len(model.log_ratio), docs.sparkSession.sparkContext.broadcast(model.log_ratio)
    keep = [c for c in keep or docs.columns if c.lower() != "log_weight"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("log_weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, tokens, grams = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, slot, doc, n in ngram_slots(batch.column(text), slots):
                total[row : row + len(n)] += np.bincount(doc, ratio.value[slot], len(n))
                tokens[row : row + len(n)] += n
                grams[row : row + len(n)] += np.bincount(doc, minlength=len(n))
            weight = pa.array(total * np.minimum(1, EVIDENCE / np.maximum(grams, 1)), mask=tokens == 0)
            yield from emit(batch, keep, {"log_weight": weight})

    return docs.mapInArrow(run, schema)


def with_key(weighed: DataFrame, seed: int, doc_id: str = "doc_id") -> DataFrame:
    """``gumbel_key``: log weight plus Gumbel noise that is a function of doc_id and seed."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def cut_between(weights: np.ndarray, target: np.ndarray, doubt: float = DOUBT, step: float = 0.25) -> float:
    """The least Gumbel key by which labelled weights are told apart at the least cost; minus infinity for one class alone.

    A row of weight w has a key of at least c with chance 1 - exp(-exp(w - c)).  The cost is
    the expected share of other rows kept, and ``doubt`` times that of target rows lost.
    Among cuts of nearly the least cost it is the middle one of the longest stretch.
    """
    if target.all() or not target.any():
        return float("-inf")
    cuts = np.arange(weights.min() - 10, weights.max() + 10, step)
    cost = np.array([doubt * lost[target].mean() + (1 - lost[~target]).mean() for lost in (np.exp(-np.exp(np.minimum(weights - c, 30))) for c in cuts)])
    good = np.flatnonzero(cost <= cost.min() + 0.002)
    stretch = max(np.split(good, np.flatnonzero(np.diff(good) > 1) + 1), key=len)
    return float(cuts[stretch[len(stretch) // 2]])


def labelled_weights(scores: DataFrame, model: RatioModel) -> tuple[np.ndarray, np.ndarray]:
    """Log weights and whether they are targets' of the held-out labelled rows; of all labelled rows if those are of one class."""
    named = scores.where("log_weight IS NOT NULL").join(F.broadcast(model.labelled), F.col("doc_id") == F.col("key"))
    # At most as many values as there are labels, of one row a label.
    rows = sorted(named.groupBy("key").agg(F.min("log_weight"), F.first("value") == 1, F.first("held")).select("min(log_weight)", "(first(value) = 1)", "first(held)").collect())
    for chosen in ([r for r in rows if r[2]], rows):
        weights, target = np.array([r[0] for r in chosen]), np.array([r[1] for r in chosen], bool)
        if target.any() and not target.all():
            break
    return weights, target


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, label: str = "quality") -> tuple[RatioModel, float, DataFrame]:
    """The model, the least selected key and (doc_id, log_weight, gumbel_key, selected) of every row.

    ``k`` rows are selected, by default as many as the labelled rows suggest.  Texts without a
    token (null, empty, blank) have no weight and are never selected; equal keys (repeated rows) are selected together; with fewer than ``k`` weighed rows all of these are.  Other
    columns of ``docs`` are not read; an empty table gives an empty one.
    """
    model = fit(docs, labels, label)
    scores = written(with_key(weigh(docs.select("doc_id", "text"), model, ["doc_id"]), seed), "weights")
    if k is None:
        cut = cut_between(*labelled_weights(scores, model))
        k = round(scores.where("log_weight IS NOT NULL").agg(F.sum(1 - F.exp(-F.exp(F.least(F.col("log_weight") - cut, F.lit(700.0)))))).first()[0] or 0)
    least = top_k_threshold(scores, "gumbel_key", k)
    least = float("-inf") if least is None and k > 0 else float("inf") if least is None else least
    return model, least, scores.withColumn("selected", F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False)))


def select_documents(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that importance resampling selects; columns and values stay as they are.

    Null, empty and blank texts go; repeated rows stay or go together; an empty table stays
    empty; without labels of both kinds all texts with a token stay.
    """
    model, least, _ = importance_resample(docs, labels, seed=seed)
    inner, names = masked(docs)
    keyed = with_key(weigh(inner, model, text=names["text"]), seed, names["doc_id"])
    return unmasked(keyed.where(F.col("gumbel_key") >= F.lit(least)), names)
