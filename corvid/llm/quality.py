"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled web text train a logistic scorer over hashed byte bigrams and a
few text statistics: ``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``. The class prior
is the share of positives among labelled training rows; where none of these is negative, it is
estimated from the scores of positives and unlabelled rows, so negatives are never needed. The scorer is fitted on a bounded sample of rows
(``PuSettings.positives`` and ``PuSettings.unlabelled``, those of smallest hashed id); every row is
scored over its whole text.

Defined results: a null or empty text has all-zero features and gets the score that these have;
equal texts get equal scores, whatever rows share their block; a document whose labels disagree counts
as not positive; without positives the score is the default prior everywhere; rows with null ids are
scored and not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import Shipped, free_column, returns_memory, small_batches
from .text_arrays import WordHasher, space_separated, text_blocks, word_spans

BUCKETS = 1024
STATISTICS = 15
#: Bytes of text and rows of a block of features.
BLOCK_BYTES = 1 << 19
BLOCK_ROWS = 256


@dataclass(frozen=True)
class PuSettings:
    """Bounds of the training sample and the optimiser's settings."""

    positives: int = 3000
    unlabelled: int = 6000
    epochs: int = 60
    prior_epochs: int = 20
    batch: int = 512
    rate: float = 0.01
    decay: float = 2e-2
    default_prior: float = 0.5
    seed: int = 17


class Featurizer:
    """Fixed-length float features of whole texts."""

    size = BUCKETS + STATISTICS

    def __init__(self) -> None:
        self.hasher, self.is_word = WordHasher(), space_separated()
        self.is_line = np.ones(256, dtype=bool)
        self.is_line[0x0A] = False
        first, second = np.arange(256, dtype=np.uint64)[:, None], np.arange(256, dtype=np.uint64)[None, :]
        mixed = (first * np.uint64(0x9E3779B1) ^ second * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
        self.bucket = ((mixed * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)) >> np.uint64(22)
        self.bucket = self.bucket.astype(np.int64).ravel()
        kinds = np.zeros(256, dtype=np.int64)
        kinds[[9, 10, 11, 12, 13, 32]] = 1
        kinds[48:58] = 2
        kinds[65:91] = 3
        kinds[97:123] = 4
        kinds[128:] = 5
        kinds[[33, 35, 36, 37, 38, 42, 64, 94, 95, 126]] = 6
        kinds[[44, 46, 59, 58, 63, 39, 34, 45, 40, 41]] = 7
        kinds[124] = 8
        self.kinds = kinds

    def __call__(self, texts: pa.Array):
        """Yield blocks of at most ``BLOCK_ROWS`` rows: a float32 matrix each."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        for start in range(0, len(texts), BLOCK_ROWS):
            yield from self._blocks(texts.slice(start, BLOCK_ROWS))

    def _blocks(self, texts: pa.Array):
        for first, last, data, offsets in text_blocks(texts, BLOCK_BYTES):
            out = np.zeros((last - first, self.size), dtype=np.float32)
            starts, ends, bounds = word_spans(data, offsets, self.is_word)
            words = self.hasher(data, starts, ends)
            line_starts, line_ends, line_bounds = word_spans(data, offsets, self.is_line)
            lines = self.hasher(data, line_starts, line_ends)
            kinds = self.kinds[data]
            pairs = np.zeros(len(data), dtype=np.int64)
            if len(data) > 1:
                pairs[1:] = self.bucket[(data[:-1].astype(np.int64) << 8) | data[1:]]
            for row in range(last - first):
                a, b = int(offsets[row]), int(offsets[row + 1])
                n = b - a
                if not n:
                    continue
                counts = np.bincount(pairs[a + 1 : b], minlength=BUCKETS)
                out[row, :BUCKETS] = np.sqrt(counts / max(n - 1, 1))
                w, ln = words[bounds[row] : bounds[row + 1]], lines[line_bounds[row] : line_bounds[row + 1]]
                sizes = ends[bounds[row] : bounds[row + 1]] - starts[bounds[row] : bounds[row + 1]]
                out[row, BUCKETS : BUCKETS + 9] = np.bincount(kinds[a:b], minlength=9) / n
                out[row, BUCKETS + 9 :] = (
                    np.log1p(n),
                    np.log1p(len(w)),
                    sizes.mean() if len(w) else 0,
                    sizes.std() if len(w) else 0,
                    len(np.unique(w)) / max(len(w), 1),
                    len(np.unique(ln)) / max(len(ln), 1),
                )
            yield out


@dataclass
class PuModel:
    """A linear scorer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def __post_init__(self) -> None:
        # mean and scale folded into the weights, in double precision
        self.slope = self.weights.astype(np.float64) / self.scale.astype(np.float64)
        self.shift = float(self.bias) - float((self.mean.astype(np.float64) * self.slope).sum())

    def score(self, features: np.ndarray) -> np.ndarray:
        """Each row is summed on its own, in one order, so a score does not depend on the other rows of a block."""
        z = np.array([(row * self.slope).sum() for row in features], np.float64) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def pu_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """Both parts of the risk under the logistic loss, from the margins of positives and of unlabelled rows: that of the
    positives, and that of the negatives, which is held at zero or more."""
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()


def pu_gradient(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the risk; where the negatives' part is below zero, the step that raises it again."""
    gp, gu = xp @ w, xu @ w
    push = (sigmoid(gu) @ xu) / len(xu) - prior * (sigmoid(gp) @ xp) / len(xp)
    pull = -prior * ((1 - sigmoid(gp)) @ xp) / len(xp)
    return pull + push if pu_risk(gp, gu, prior)[1] >= 0 else -push


def plain_gradient(w: np.ndarray, xp: np.ndarray, xu: np.ndarray) -> np.ndarray:
    """Gradient of the logistic loss of positives against unlabelled rows, both sides weighing the same."""
    return ((sigmoid(xu @ w) @ xu) / len(xu) - ((1 - sigmoid(xp @ w)) @ xp) / len(xp)) / 2


def _adam(gradient, p: np.ndarray, u: np.ndarray, settings: PuSettings, epochs: int) -> np.ndarray:
    """Weights after ``epochs`` over the unlabelled rows; one thread, fixed seed, so repeatable."""
    rng = np.random.default_rng(settings.seed)
    w = np.zeros(p.shape[1], np.float32)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(epochs):
        rate = settings.rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
        order = rng.permutation(len(u))
        for k in range(0, len(u), settings.batch):
            grad = gradient(w, p[rng.integers(0, len(p), settings.batch)], u[order[k : k + settings.batch]])
            grad[:-1] += settings.decay * w[:-1]
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, settings: PuSettings = PuSettings()) -> float:
    """Share of positives among unlabelled rows, from positives and unlabelled rows alone.

    Half of the rows train a scorer of positives against unlabelled rows. On the other half, the share of
    unlabelled rows above a threshold over that of positives is at least the prior, and near it where the top
    rows are nearly all positive: the threshold with the least upper confidence bound of this ratio is taken.
    """
    if len(p) < 4 or len(u) < 4:
        return settings.default_prior
    w = _adam(plain_gradient, p[::2], u[::2], settings, settings.prior_epochs)
    sp, su = np.sort(p[1::2] @ w)[::-1], np.sort(u[1::2] @ w)[::-1]
    share_p = np.arange(1, len(sp) + 1) / len(sp)
    share_u = np.searchsorted(-su, -sp, side="right") / len(su)
    slack = np.sqrt(np.log(40) / (2 * len(su))) + np.sqrt(np.log(40) / (2 * len(sp)))
    best = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, settings: PuSettings = PuSettings()) -> PuModel:
    """Minimise the non-negative unbiased risk with Adam; a prior that is not given is estimated."""
    size = Featurizer.size
    pool = unlabelled if len(unlabelled) else np.zeros((1, size), np.float32)
    mean, scale = pool.mean(axis=0), pool.std(axis=0) + 1e-3
    if not len(positive):
        prior = settings.default_prior if prior is None else prior
        return PuModel(mean, scale, np.zeros(size, np.float32), float(np.log(prior / (1 - prior))), prior)
    p, u = ((x - mean) / scale for x in (positive, pool))
    p, u = (np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32) for x in (p, u))
    prior = estimate_prior(p, u, settings) if prior is None else prior
    w = _adam(lambda w, xp, xu: pu_gradient(w, xp, xu, prior), p, u, settings, settings.epochs)
    return PuModel(mean, scale, w[:-1], float(w[-1]), prior)


def fold(key: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string")) % folds


def _features_of(docs: DataFrame, text: str, key: str) -> np.ndarray:
    """Features of the rows, in the order of their ids."""

    def run(batches):
        featurize = Featurizer()
        for batch in batches:
            rows = [r.tobytes() for block in featurize(batch.column("text")) for r in block]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], names=["id", "f"])

    picked = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession, BLOCK_ROWS):
        rows = picked.mapInArrow(returns_memory(run), "id string, f binary").toArrow().sort_by("id").column("f").to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, Featurizer.size) if rows else np.zeros((0, Featurizer.size), np.float32)


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", settings: PuSettings = PuSettings()) -> PuModel:
    """Fit on bounded samples; ``docs`` and ``labels`` hold training rows only.

    Only ids are ordered and joined; at most ``positives + unlabelled`` ids are broadcast to fetch texts, and of
    rows that repeat an id the least text is taken, so that a sample has one row an id at most.
    """
    judged = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("y"))
    n, good = judged.agg(F.count("*"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    prior = min(max(good / n, 0.01), 0.99) if n and good < n else None
    first = F.xxhash64(F.col(key).cast("string"))
    positive = judged.where("y = 1").select(key).orderBy(first, key).limit(settings.positives)
    unlabelled = docs.select(key).where(F.col(key).isNotNull()).distinct().orderBy(first, key).limit(settings.unlabelled)
    rows = lambda ids: docs.select(key, text).join(F.broadcast(ids), key, "left_semi").groupBy(key).agg(F.min(text).alias(text))
    return fit_pu(*(_features_of(rows(ids), text, key) for ids in (positive, unlabelled)), prior, settings)


def score(docs: DataFrame, model: PuModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the double column ``out`` (0 to 1, higher is better), in place of one that has the name."""
    holder = Shipped(docs.sparkSession, model)
    docs = docs.drop(out) if out in docs.columns else docs
    place = docs.columns.index(text)

    def run(batches):
        featurize = Featurizer()
        for batch in batches:
            values = [holder.value.score(block) for block in featurize(batch.column(place))]
            column = pa.array(np.concatenate(values) if values else [], pa.float64())
            yield from pa.Table.from_batches([batch]).append_column(out, column).to_batches()

    return docs.mapInArrow(returns_memory(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", held_out: Column | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """Drop the documents that score below ``threshold``; all columns of ``docs`` are returned."""
    train_rows, train_labels = (docs, labels) if held_out is None else (docs.where(~held_out), labels.where(~held_out))
    model = train(train_rows, train_labels, text=text, key=key, **options)
    out = free_column(docs, "score")
    return score(docs, model, text=text, out=out).where(F.col(out) >= threshold).select(*docs.columns)


def quality_report(docs: DataFrame, labels: DataFrame, *, settings: PuSettings = PuSettings()) -> DataFrame:
    """Score and verdict of every document; rows with crc32(doc_id) mod 3 = 1 are held out of training."""
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = train(docs.where(~held_out), labels.where(~held_out), settings=settings)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
