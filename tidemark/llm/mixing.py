"""Mixing documents to target domain weights with soft membership.

A multinomial model over hashed n-grams, learned from a labelled table, gives every
document a posterior over domains.  Each document gets a nonnegative rate (its expected
number of copies) such that the rates' expected domain token totals match targets:

    minimise  1/2 |A r - b|^2   over r >= 0

with A_di a document's share w_i of all tokens times its posterior of domain d, and b the
target totals in the same unit.  A step goes against the gradient ``posterior . (A r - b)``,
each domain's part of it divided by the tokens that the domain has in documents of positive
rate (a bound on its curvature there; a step that leads too far is taken back and made with more
of the domain's whole share, which is always safe), and projects on r >= 0.  Projections are
lazy: gradients add up in one multiplier a domain, and the rate is the projection
``max(0, 1 + posterior . m)`` of the start moved by their sum.  So no rate is ever stored or moved, a
step is one Spark aggregation of two numbers a domain, and of all rates that meet the
targets those nearest to one are found.  Steps carry on from one another (Nesterov, begun
anew when a step turns back) until the totals are within CLOSE of every target.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import masked, unmasked, written
from .features import bounded_counts, ngram_slots
from .quality import UNIT, bounded_labels
from .textbytes import emit

SLOTS, EVIDENCE, PRIOR, CLOSE = 4096, 30, 1.0, 1e-4
PATIENCE, GAIN = 200, 0.99
"""Targets are out of reach if PATIENCE steps bring the farthest one not even to GAIN of its distance."""
MAX_DOMAINS = 1_000
MAX_LABELS = 20_000
"""Labelled rows that the classifier learns from (those of least hashed id)."""


@dataclass
class Mixture:
    """Domains, their n-gram models, the targets (shares of today's tokens), what the fit reaches and its multipliers."""

    domains: list[str]
    log_likelihood: np.ndarray
    target: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reached: np.ndarray = field(default_factory=lambda: np.zeros(0))
    multiplier: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def posteriors(self, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Soft membership from summed log likelihoods; n-grams count as at most EVIDENCE independent ones."""
        z = sums * np.minimum(1, EVIDENCE / np.maximum(grams, 1))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def distance(self) -> float:
        """The largest distance to a target, in targets (in all tokens where that is 0)."""
        return float((np.abs(self.reached - self.target) / np.where(self.target > 0, self.target, 1)).max())

    def unmet(self) -> dict[str, tuple[float, float]]:
        """(target, reached) of the domains that are not within CLOSE of their target (of all tokens where that is 0)."""
        off = np.abs(self.reached - self.target) > CLOSE * np.where(self.target > 0, self.target, 1)
        return {d: (float(b), float(a)) for d, b, a, x in zip(self.domains, self.target, self.reached, off) if x}

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        """Rates by the multipliers; one each before the fit."""
        return np.maximum(0, 1 + posterior @ self.multiplier) if len(self.multiplier) else np.ones(len(posterior))


def fit_domains(docs: DataFrame, labelled: DataFrame, most: int = MAX_LABELS, slots: int = SLOTS) -> Mixture:
    """The classifier: n-gram counts by domain over a bounded sample of ``labelled`` (doc_id, domain).

    A text's n-grams count as at most EVIDENCE ones, so that no long text leads a domain.
    """
    sample = written(bounded_labels(labelled.withColumn("domain", F.col("domain").cast("string")), "doc_id", "domain", most), "domains")
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("key")).select("text", "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names, which = np.unique(np.array(batch.column("value").to_pylist(), str), return_inverse=True)
            for row, slot, doc, weight in bounded_counts(batch.column("text"), slots, EVIDENCE, UNIT):
                table = np.bincount(which[row + doc] * slots + slot, weight, len(names) * slots).astype(np.int64)
                for name, c in zip(names.tolist(), table.reshape(len(names), slots)):
                    counts[name] = counts.get(name, 0) + c
        for name, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(c[some])], names=["domain", "slot", "n"])

    if sample.select("value").distinct().count() > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    found = marked.mapInArrow(count, "domain string, slot long, n long").groupBy("domain", "slot").agg(F.sum("n").alias("n")).collect()
    domains = sorted({r["domain"] for r in found}) or ["all"]
    counts = np.zeros((len(domains), slots))
    for r in found:
        counts[domains.index(r["domain"]), r["slot"]] = r["n"] / UNIT
    common = (counts.sum(axis=0) + PRIOR) / (counts.sum() + PRIOR * slots)
    model = (counts + PRIOR * slots * common) / (counts.sum(axis=1, keepdims=True) + PRIOR * slots)
    return Mixture(domains, np.log(model) - np.log(common))


def membership(docs: DataFrame, mixture: Mixture, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (default all) of ``docs`` with n_tokens and posterior (one probability a domain); a text without tokens is spread evenly.

    Columns of these two names (in any case) are replaced.
    """
    keep = [c for c in keep or docs.columns if c.lower() not in ("n_tokens", "posterior")]
    shared = docs.sparkSession.sparkContext.broadcast(mixture.log_likelihood)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sums, tokens, grams = np.zeros((batch.num_rows, len(table))), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, slot, doc, n in ngram_slots(batch.column(text), table.shape[1]):
                for d, weights in enumerate(table):
                    sums[row : row + len(n), d] += np.bincount(doc, weights[slot], len(n))
                tokens[row : row + len(n)] += n
                grams[row : row + len(n)] += np.bincount(doc, minlength=len(n))
            p = mixture.posteriors(sums, grams)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * p.shape[1])
            yield from emit(batch, keep, {"n_tokens": pa.array(tokens), "posterior": pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))})

    return docs.mapInArrow(run, schema)


def _posteriors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit_rates(members: DataFrame, mixture: Mixture, targets: dict[str, float] | None, temper: float) -> Mixture:
    """Finds the multipliers over (n_tokens, posterior) by projected gradient until totals are within CLOSE of every target.

    ``targets`` are domain weights (scaled to today's number of tokens; a domain left
    out gets none); by default today's shares to the power ``temper``.  Targets out of
    reach are logged and in ``unmet``.
    """
    k = len(mixture.domains)

    def pass_over(m: np.ndarray) -> np.ndarray:
        """Half the squared rates over tokens, the domains' tokens under these rates, and those of rows with a positive rate."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, k))
            square = 0.0
            for batch in batches:
                if batch.num_rows:
                    p, n = _posteriors(batch), np.asarray(batch.column("n_tokens"))
                    r = np.maximum(0, 1 + p @ m)
                    square += n @ (r * r) / 2
                    out += np.stack((n * r, n * (r > 0))) @ p
            x = np.append(square, out.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array(x)], names=["at", "x"])

        got = np.zeros(1 + 2 * k)
        for row in members.select("n_tokens", "posterior").mapInArrow(part, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            got[row["at"]] = row["x"]
        return got

    m = np.zeros(k)
    got = pass_over(m)
    all_tokens = got[1 : k + 1].sum()
    if not all_tokens:
        return mixture
    got /= all_tokens
    now = got[1 : k + 1]
    share = np.array([targets.get(d, 0.0) for d in mixture.domains]) if targets is not None else now**temper
    if share.sum() <= 0:
        raise ValueError("targets give no domain a positive weight")
    b = mixture.target = share / share.sum()
    safe = np.where(now > 0, now, 1)
    mixture.multiplier, mixture.reached = m, now
    ahead, pace, caution = m, 1.0, 0.0  # ahead: where gradients are taken
    top = (-got[0], m, got)  # the best of these so far: dual value, multipliers, sums
    least, best, since = mixture.distance(), (m, now), 0
    while mixture.unmet() and since < PATIENCE:
        curve = np.maximum(got[k + 1 :], max(caution, 1e-9) * safe)
        step = (b - got[1 : k + 1]) / curve
        new = ahead + step
        if (curve * step) @ (new - m) < 0:
            pace = 1.0
        quick = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, m, pace = new + (pace - 1) / quick * (new - m), new, quick
        got = pass_over(ahead) / all_tokens
        mixture.multiplier, mixture.reached = ahead, got[1 : k + 1]
        value = b @ ahead - got[0]
        since += 1
        if mixture.distance() < GAIN * least:
            least, best, since = mixture.distance(), (ahead, got[1 : k + 1]), 0
        if value >= top[0] - 1e-13:
            top, caution = (value, ahead, got), caution / 2
        elif mixture.unmet():  # too far: back to the best place, with more care
            caution, pace = min(1.0, max(4 * caution, 1 / 64)), 1.0
            _, ahead, got = top
            m = ahead
    if mixture.unmet():
        mixture.multiplier, mixture.reached = best
    for d, (wanted, got) in mixture.unmet().items():
        logging.getLogger(__name__).warning("domain %s: target %.6f of the tokens, reached %.6f", d, wanted, got)
    return mixture


def with_rates(docs: DataFrame, mixture: Mixture, seed: int = 11, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` (with posterior) and domain (the likeliest), rate and copies.

    copies is the rate rounded up or down at random, as a function of doc_id and seed,
    so that its expectation is the rate.
    """
    docs = docs.drop("domain", "rate")
    schema = T.StructType([*docs.schema.fields, T.StructField("domain", T.StringType()), T.StructField("rate", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _posteriors(batch)
                domain = pa.array([mixture.domains[k] for k in p.argmax(axis=1)], pa.string())
                yield from emit(batch, batch.schema.names, {"domain": domain, "rate": pa.array(mixture.rates(p))})

    uniform = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / float(1 << 53)
    return docs.mapInArrow(run, schema).withColumn("copies", F.floor(F.col("rate") + uniform))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, temper: float = 0.7) -> tuple[Mixture, DataFrame]:
    """The fitted mixture and (doc_id, n_tokens, posterior, domain, rate, copies, domain_target, domain_reached) of every row of ``docs``.

    The last two are shares of today's tokens: what the likeliest domain was to get, and gets.

    Null labels are left out; without any label there is one domain and every rate is
    one.  Null and empty texts have no tokens and a rate by an even posterior; texts of any
    length count whole; repeated rows get the same rate and copies each; other columns
    are not read; an empty table gives an empty one.
    """
    mixture = fit_domains(docs, labelled)
    members = written(membership(docs.select("doc_id", "text"), mixture, ["doc_id"]), "members")
    fit_rates(members, mixture, targets, temper)
    at = F.array_position(F.array(*map(F.lit, mixture.domains)), F.col("domain")).cast("int")
    shares = {"domain_target": mixture.target, "domain_reached": mixture.reached}
    found = {c: F.get(F.array(*map(F.lit, x.tolist())).cast("array<double>"), at - 1) for c, x in shares.items()}
    return mixture, with_rates(members, mixture).withColumns(found)


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, temper: float = 0.7) -> DataFrame:
    """Every row of ``docs`` as many times as its copies; columns and values stay as they are.

    Null and empty texts, repeated rows and empty tables are as ``mix`` states.
    """
    mixture, _ = mix(docs, labelled, targets, temper)
    inner, names = masked(docs)
    rated = with_rates(membership(inner, mixture, text=names["text"]), mixture, doc_id=names["doc_id"]).where("copies > 0")
    return unmasked(rated.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), names)
