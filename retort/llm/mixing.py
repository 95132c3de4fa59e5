"""Soft-membership mixing of documents to target weights.

A naive Bayes classifier over hashed byte trigrams, fitted on labelled rows and tempered on others, gives each
document a posterior over domains. Nonnegative rates then make the expected tokens of each domain meet its share of a
total: projected gradient descent on least squares, whose residuals are whitened by the Gram matrix of the posteriors.
The rates stay on the cluster: a step's gradient is one number per domain, and a document's rate is its fold over the
steps so far, so that a step is one pass over (tokens, posterior) and moves a few sums.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .shared import hidden, labelled, staged

LABELLED = 6_000  #: labelled rows that the classifier is fitted on at most: those of least doc_id hash
BUCKETS_LOG = 14  #: of trigram hashes
STEPS, CLOSE = 40, 1e-9  #: gradient steps at most; relative residual at which they end
LOOKS = 80  #: passes of Newton's method at most
PART = 1 << 20  #: bytes of a text looked at together

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Hashed trigrams of the text with a blank at either end, in parts."""
    a = np.frombuffer(b" " + text + b" ", np.uint8)
    for at in range(0, max(1, len(a) - 2), PART):
        p = a[at : at + PART + 2].astype(np.uint32)
        if len(p) >= 3:
            yield ((p[:-2] << np.uint32(16) | p[1:-1] << np.uint32(8) | p[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS_LOG)


def n_tokens(text: bytes) -> int:
    """Words: maximal runs without ASCII white space."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    return int((~space[1:] & space[:-1]).sum()) + int(len(space) > 0 and not space[0])


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray  #: log probability by bucket and domain
    sharpness: float
    learnt: tuple[int, ...]  #: texts that each domain's table is made of

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        found = np.zeros((len(texts), len(self.domains)))
        for i, t in enumerate(texts):
            n = 0
            for h in _trigrams(t):
                found[i] += self.table[h].sum(0, dtype=np.float64)
                n += len(h)
            found[i] /= max(1, n) ** 0.5
        return found

    def posterior(self, evidence: np.ndarray, sharpness: float | None = None) -> np.ndarray:
        x = np.log(self.prior) + (self.sharpness if sharpness is None else sharpness) * evidence
        x = np.exp(x - x.max(1, keepdims=True, initial=-np.inf))
        return x / x.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, domains: list[str]) -> Classifier:
    """labels: doc_id, domain. At most LABELLED labelled documents are learnt from, each once, whatever repeats; rows of
    other domains are left out. Their texts are counted on the cluster; tables of counts, and the evidence that half of
    them have, come to the driver."""
    rows = labelled(docs, labels.where(F.col("domain").isin(domains)), "domain", LABELLED)
    all_ = sorted((r.h, domains.index(r.y)) for r in rows.select("h", "y").collect())
    middle = all_[len(all_) // 2][0] if all_ else 0
    k = len(domains)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 << BUCKETS_LOG, k), np.int64)
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for h in _trigrams(t):
                    counts[:, domains.index(y)] += np.bincount(h, minlength=1 << BUCKETS_LOG)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    counts = np.full((1 << BUCKETS_LOG, k), 0.1)
    some = rows.where(F.col("h") < middle).select("y", "t").coalesce(8)
    for r in some.mapInArrow(count, "counts binary").toLocalIterator():
        counts += np.frombuffer(r.counts, np.int64).reshape(counts.shape)
    every, learnt = np.bincount([y for _, y in all_], minlength=k), np.bincount([y for h, y in all_ if h < middle], minlength=k)
    prior = every + 1.0
    fitted = Classifier(tuple(domains), prior / prior.sum(), np.log(counts / counts.sum(0)).astype(np.float32), 1.0, tuple(learnt.tolist()))
    if not learnt.any():
        return fitted

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _listed(fitted.evidence(b.column(2).to_pylist()))], names=["h", "y", "e"])

    judged = rows.where(F.col("h") >= middle).select("h", "y", "t").mapInArrow(judge, "h long, y string, e array<double>")
    got = sorted((r.h, domains.index(r.y), r.e) for r in judged.collect())
    seen, truth = np.array([r[2] for r in got]), np.array([r[1] for r in got])
    loss = lambda s: -np.log(fitted.posterior(seen, s)[np.arange(len(truth)), truth] + 1e-12).mean()
    return replace(fitted, sharpness=min(np.geomspace(0.01, 10, 25).tolist(), key=loss))


def _listed(x: np.ndarray) -> pa.ListArray:
    """Rows as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, __p): __p has a probability for each domain."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            p = model.posterior(model.evidence(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n_tokens(t) for t in texts], pa.int64()), _listed(p)], names=["doc_id", "n_tokens", "__p"])

    return docs.select("doc_id", docs["text"].cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, __p array<double>")


def _rate(start: float, steps: list[np.ndarray], k: int) -> Column:
    """A document's rate after the steps: each subtracts posterior . gradient and cuts at zero."""
    if not steps:
        return F.lit(float(start))
    gradients = F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in steps])

    def step(r: Column, g: Column) -> Column:
        return F.greatest(F.lit(0.0), r - sum((F.col("__p")[i] * g[i] for i in range(k)), F.lit(0.0)))

    return F.aggregate(gradients, F.lit(float(start)), step)


def rates(base: DataFrame, targets: dict[str, float], domains: tuple[str, ...], total: float | None = None) -> Column:
    """The rate of each row of base (n_tokens, __p) as a column.

    total: expected tokens of the mixture; by default the least with which no domain need shrink."""
    k = len(domains)
    tokens = F.col("n_tokens").cast("double")
    share = np.array([targets[d] for d in domains], float)
    share /= share.sum()
    p = [F.col("__p")[i] for i in range(k)]
    first = base.agg(
        *[F.sum(tokens * p[i]).alias(f"t{i}") for i in range(k)],
        *[F.sum(tokens * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)],
    ).first()
    now = np.array([first[f"t{i}"] or 0.0 for i in range(k)])
    if not now.sum():
        return F.lit(1.0)
    gram = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    if total is None:
        total = float(max(now[i] / share[i] for i in range(k) if share[i]))
    goal, start = total * share, total / now.sum()
    whiten = np.linalg.pinv(gram, rcond=1e-12)
    steps: list[np.ndarray] = []
    reached = now * start
    for _ in range(STEPS):
        rest = reached - goal
        if np.abs(rest).max() <= CLOSE * total:
            break
        steps.append(whiten @ rest)
        rate = _rate(start, steps, k)
        got = base.agg(*[F.sum(rate * tokens * p[i]).alias(f"t{i}") for i in range(k)]).first()
        last, reached = reached, np.array([got[f"t{i}"] for i in range(k)])
        if np.abs(reached - last).max() <= CLOSE * total:  # as near as nonnegative rates get
            break
    return _rate(start, steps, k)


def _meet(base: DataFrame, start: Column, lower: float, rows: np.ndarray, goal: np.ndarray, scale: float) -> tuple[Column, float]:
    """Rates nearest to start (squares weighted by tokens), none under lower, for which the sum of tokens * rate *
    (rows @ p) is goal; and what is missing at most, relative to scale.

    Newton's method on the dual: a rate is start less one number per domain times the posterior, cut at lower. A pass
    sums over the rows; it ends early where the numbers prove that no rates can meet the goal."""
    k = rows.shape[1]
    tokens, p = F.col("n_tokens").cast("double"), [F.col("__p")[i] for i in range(k)]

    def shift(x: np.ndarray) -> Column:
        return sum((p[i] * float(v) for i, v in enumerate(x @ rows)), F.lit(0.0))

    def look(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, bool]:
        moved = start - shift(x)
        rate = F.greatest(F.lit(lower), moved)
        free = F.when(moved >= lower, tokens).otherwise(0.0)
        got = base.agg(
            F.sum(tokens * (rate - start) * (rate - start)).alias("d"), F.min(F.when(tokens > 0, shift(x))).alias("m"),
            *[F.sum(rate * tokens * p[i]).alias(f"t{i}") for i in range(k)],
            *[F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)],
            *[F.sum(tokens * p[i]).alias(f"n{i}") for i in range(k)],
        ).first()
        rest = rows @ np.array([got[f"t{i}"] for i in range(k)]) - goal
        gram = rows @ np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) @ rows.T
        # Every row can only be moved away from what is missing.
        hopeless = got.m >= 0 and x @ (goal - lower * rows @ np.array([got[f"n{i}"] for i in range(k)])) < 0
        return got.d / 2 + x @ rest, rest, gram, hopeless

    x = np.zeros(len(rows))
    value, rest, gram, hopeless = look(x)
    whole, looks, part = gram, 1, 1.0
    while np.abs(rest).max() > CLOSE * scale and looks < LOOKS and not hopeless and part > 1e-9:
        # A little of the first matrix, so that a set of few free rows still gives a direction.
        matrix = gram + 1e-7 * whole
        size = np.sqrt(np.maximum(np.diag(matrix), 1e-300))
        way = np.linalg.pinv(matrix / size / size[:, None], rcond=1e-12, hermitian=True) @ (rest / size) / size
        slope, part = way @ rest, 1.0
        if slope <= 0:
            break
        while looks < LOOKS and part > 1e-9:
            looks += 1
            then = look(x + part * way)
            if then[0] >= value + 1e-4 * part * slope or np.abs(then[1]).max() <= np.abs(rest).max() / 2:
                x = x + part * way
                value, rest, gram, hopeless = then
                break
            part /= 4
    return F.greatest(F.lit(lower), start - shift(x)), float(np.abs(rest).max() / scale)


def whole_rates(base: DataFrame, targets: dict[str, float], model: Classifier) -> Column:
    """Rates of 1 and more, nearest to 1, for which the expected tokens of the domains are in the ratio of the targets.

    Left out of the targets, with a warning: domains that no text was learnt from (while others were) or that no
    document is most likely of, domains of weight zero, and where no rates meet the targets, the domain whose share is
    furthest out of reach of the likeliest document, until they do. Documents of such domains stay, too."""
    k = len(model.domains)
    tokens, p = F.col("n_tokens").cast("double"), [F.col("__p")[i] for i in range(k)]
    first = base.where("n_tokens > 0").agg(
        F.sum(tokens).alias("n"), *[F.max(p[i]).alias(f"m{i}") for i in range(k)],
        *[F.max(p[i] >= F.array_max("__p")).alias(f"l{i}") for i in range(k)],
    ).first()
    if not first.n:
        return F.lit(1.0)
    weight = np.array([targets[d] for d in model.domains], float)
    kept = [i for i in range(k) if weight[i] > 0 and first[f"l{i}"] and (model.learnt[i] or not any(model.learnt))]
    rate = F.lit(1.0)
    while len(kept) > 1:
        share = weight[kept] / weight[kept].sum()
        rows = np.zeros((len(kept), k))
        rows[:, kept] = np.eye(len(kept)) - share[:, None]
        rate, missing = _meet(base, F.lit(1.0), 1.0, rows, np.zeros(len(kept)), float(first.n))
        if missing <= 1e-6:
            break
        rate = F.lit(1.0)
        kept.remove(min(kept, key=lambda i: first[f"m{i}"] / weight[i]))
    if len(kept) < k:
        warnings.warn("mixing: left out of the targets: " + ", ".join(d for i, d in enumerate(model.domains) if i not in kept), stacklevel=2)
    return rate


def copies(rate: Column, doc_id: Column) -> Column:
    """How often a document is taken: its rate rounded up or down by a hash of its doc_id, so that the mean is the rate."""
    luck = F.pmod(F.xxhash64(doc_id, F.lit("mixing")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (F.floor(rate) + (luck < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain> for each domain, rate, copies.

    A null or empty text has no tokens and the posterior of a text without evidence; it doesn't bear on the totals.
    Repeated rows count each and get equal rates. Without labelled rows posteriors are equal shares; domains that no
    document is likely to have stay short of their target. An empty table gives an empty result; other columns are
    ignored."""
    base, model = prepared(docs, labels, targets)
    rate = rates(base, targets, model.domains, total)
    return base.withColumn("rate", rate).select(
        "doc_id", "n_tokens", *[F.col("__p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)],
        "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"),
    )


def prepared(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> tuple[DataFrame, Classifier]:
    model = fit(docs, labels, sorted(targets))
    return staged(posteriors(docs, model), "posteriors"), model


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The mixture itself: rows of docs, all columns, each as often as its copies say.

    No document leaves: no rate is under 1. See whole_rates() for domains that the documents lack. A null or empty text
    has the posterior of a text without evidence, as in mix(); repeated rows are repeated each, alike; a null doc_id is a
    value like any other; an empty table gives an empty result. Columns may have any names but those that begin with two
    underscores."""
    hidden(docs)
    base, model = prepared(docs, labels, targets)
    rate = whole_rates(base, targets, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("__p", _listed(model.posterior(model.evidence([(t or "").encode() for t in b.column(at).to_pylist()]))))

    schema = StructType([*docs.schema.fields]).add("__p", ArrayType(DoubleType()))
    n = copies(rate, F.col("doc_id")).cast("int")
    return docs.mapInArrow(run, schema).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), n))).drop("__p", "__copy")
