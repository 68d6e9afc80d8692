"""Quality classifier by positive-unlabelled learning.

A small network is trained in numpy to minimise the non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

with the logistic loss l, trusted positives p and web text u, which is drawn
from all training rows, labels ignored. Where
the second term of a batch is negative, the step goes against it. Labelled
negatives serve for nothing.

The class prior is estimated from positives and unlabelled rows alone. A network
of the same form learns to tell half of the positives from half of the
unlabelled; on the other halves, the share of the unlabelled above any threshold
is at least the prior times the share of the positives above it, so the least
ratio of the two, over thresholds that enough positives pass, bounds the prior
from above and meets it where the best positives are unlike any negative.

A text is described by shares and counts over all of it: kinds of characters,
repeated words and lines, lengths. Features of all documents are computed once
and kept; training takes about ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows of
them at most, those whose hash of the id lies below a limit that is set from
their numbers, so no task sends more than its share; scoring takes all.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace, spread

MAX_POSITIVE, MAX_UNLABELLED = 20_000, 40_000
HIDDEN, EPOCHS, BATCH, RATE = 16, 60, 1024, 5e-3
#: Share of the positives that must pass a threshold for it to count in the estimate of the prior.
LEAST_PASSING = 0.2
FOLDS = 5
THRESHOLD = 0.3
_KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "high": range(128, 256),
    "space": [32, *range(9, 14)],
    "symbol": list(b"#*$%&|<>"),
    "pipe": list(b"|"),
    "bang": list(b"!?"),
    "stop": list(b"."),
    "comma": list(b",;:"),
    "other": list(b"@_=/\\{}[]()~^`+-\"'"),
}
_TABLE = np.zeros((256, len(_KINDS)))
for _i, _codes in enumerate(_KINDS.values()):
    _TABLE[list(_codes), _i] = 1
FEATURES = len(_KINDS) + 10


def features(text: str | None) -> np.ndarray:
    """What the model sees of a text; zeros for null and for the empty text."""
    data = (text or "").encode()
    out = np.zeros(FEATURES)
    if not data:
        return out
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TABLE / len(data)
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    n = max(len(words), 1)
    pairs = set(zip(words, words[1:]))
    capitals = sum(map(bytes.isupper, words))
    out[: len(shares)] = shares
    out[len(shares) :] = (
        np.log1p(len(data)),
        np.log1p(len(words)),
        (len(data) / n) ** 0.5,
        len(set(words)) / n,
        len(pairs) / max(n - 1, 1),
        sum(map(operator.eq, words, words[1:])) / n,
        capitals / n,
        len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
        max(map(len, words), default=0) ** 0.5,
    )
    return out


class PuNetwork:
    """One hidden layer of tanh; ``fit`` minimises the non-negative risk by Adam."""

    def __init__(self, n_features: int, prior: float, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.prior, self.rng = prior, rng
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)
        self.p = [rng.normal(0, n_features**-0.5, (n_features, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.log([prior / (1 - prior)])]

    def _norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.p
        return np.tanh(self._norm(x) @ w + b) @ v + c[0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))

    def _gradient(self, x: np.ndarray, by_logit: np.ndarray) -> list[np.ndarray]:
        w, b, v, _ = self.p
        h = np.tanh(x @ w + b)
        back = by_logit[:, None] * v * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ by_logit, np.array([by_logit.sum()])]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, contrast: bool = False) -> PuNetwork:
        """``contrast``: tells positives from unlabelled rows, as if these were negatives, instead."""
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        p, u = self._norm(positive), self._norm(unlabelled)
        first, second, t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0
        steps = max(1, -(-max(len(p), len(u)) // BATCH))
        for _ in range(EPOCHS):
            ps, us = np.array_split(self.rng.permutation(len(p)), steps), np.array_split(self.rng.permutation(len(u)), steps)
            for i, j in zip(ps, us):
                if not len(i) or not len(j):
                    continue
                x = np.concatenate([p[i], u[j]])
                w, b, v, c = self.p
                g = np.tanh(x @ w + b) @ v + c[0]
                sig = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
                gp, gu, sp, su = g[: len(i)], g[len(i) :], sig[: len(i)], sig[len(i) :]
                less = 0.0 if contrast else self.prior  # of the positives among the unlabelled, what is taken off
                negative = np.logaddexp(0, gu).mean() - less * np.logaddexp(0, gp).mean()
                d_negative = np.concatenate([-less * sp / len(i), su / len(j)])
                d_positive = np.concatenate([(1.0 if contrast else self.prior) * (sp - 1) / len(i), np.zeros(len(j))])
                grads = self._gradient(x, d_positive + d_negative if negative >= 0 else -d_negative)
                t += 1
                for k, grad in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return self


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from these two samples."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    model = PuNetwork(positive.shape[1], 0.5, seed=1).fit(positive[::2], unlabelled[::2], contrast=True)
    p, u = np.sort(model.logit(positive[1::2])), np.sort(model.logit(unlabelled[1::2]))
    shares = np.linspace(max(LEAST_PASSING, 4 / len(p)), 1, 100)
    limits = p[np.minimum(np.floor((1 - shares) * len(p)).astype(int), len(p) - 1)]
    above = lambda x: 1 - np.searchsorted(x, limits, "left") / len(x)
    slack = (above(u) * (1 - above(u)) / len(u)) ** 0.5 + above(u) * ((1 - above(p)) / np.maximum(above(p) * len(p), 1)) ** 0.5
    return float(np.clip(((above(u) + slack / 2) / above(p)).min(), 0.02, 0.98))


def held_out(doc_id: Column) -> Column:
    """Of the folds by crc32 of the id as text, the first; null ids are as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<float>) of each row of ``docs`` (doc_id, text); whole texts, and nothing but the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([features(t.as_py()) for t in batch.column(1)], np.float32).reshape(-1, FEATURES)
            ends = np.arange(len(found) + 1, dtype=np.int32) * FEATURES
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<float>")


def train_quality(described: DataFrame, labels: DataFrame, most: tuple[int, int] = (MAX_POSITIVE, MAX_UNLABELLED)) -> PuNetwork | None:
    """The network, or None where there is no positive row to learn from.

    A document labelled both ways counts as negative; null labels don't count.
    """
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.where(~held_out(F.col("doc_id")))
    pool = described.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", "x"))
    positive = pool.join(own.where("quality = 1").select("doc_id"), "doc_id", "left_semi")

    def take(df: DataFrame, most: int) -> np.ndarray:
        """About ``most`` rows at most, in the order of their hash."""
        n = df.count()
        limit = -(1 << 63) + int((1 << 64) * min(1.0, most / max(n, 1)) * (1 - 1e-12))
        rows = df.where(F.col("h") <= limit).select("h", F.col("x").cast("array<double>").alias("x")).toArrow()
        x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
        return x[np.lexsort((*x.T, rows["h"].to_numpy()))]

    p, u = take(positive, most[0]), take(pool, most[1])
    if not len(p) or not len(u):
        return None
    return PuNetwork(FEATURES, estimate_prior(p, u)).fit(p, u)


def score_quality(docs: DataFrame, labels: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text; other columns are ignored), repeated ones and those with null ids too.

    Null texts are as empty ones, which have a score as well. 0.5 for all where
    nothing can be learned; an empty table gives an empty result.
    """
    ws = ws or Workspace(docs.sparkSession, "quality")
    described = ws.save(text_features(docs), "features")
    model = train_quality(described, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(np.float64)
            score = model.predict(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return described.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold, score and prediction of each row of ``documents``; what ``score_quality`` says of nulls, repeats and empty tables holds."""
    docs, labels = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
