"""Language-model scoring: unigram base counts and a log-bilinear model trained by noise-contrastive estimation.

Tokens are the words of the lower-cased text and one end for each text.

Base. Counts of all training tokens: each task counts its own rows, the counts
are added up by word. The ``head_size`` most frequent words, a table of bounded
size, go to all tasks; a document's other words are joined with their counts
by word, once for each document and not for each occurrence.

Model. Two log-bilinear levels over the words of the head, each word with a
vector of its own. A word's class is its own if it is one of the most frequent,
else one of ``GROUPS`` groups of nearly equal mass; the end of text is a class,
and so are the words beyond the head, "rare". The first level predicts a class
from the two classes before it, s(c | a, b) = b_c + (C1 r_a + C2 r_b) . q_c; the
second a word of a group from the class before it, p(w | c, b) ~ share(w | c)
exp(v_w . u_b). Both are trained in numpy by noise-contrastive estimation, the
first against the classes' frequencies, the second against those of the words
within the group. Scoring normalises exactly: batched matrix products give the
sums over all classes for all pairs of classes, and over all words of each group
for each class before. A rare word has its class's probability times its share
of the smoothed unigram mass of rare words, one unseen word included.

Every training token is used. Rows are dealt into shards of ``SHARD_TOKENS``
tokens by a hash of the row and sorted by it; each shard trains one pass from
common initial values, and the parameters of all shards are averaged, weighted by
tokens, in a tree. What is learned depends on the rows, not on how the input is
partitioned.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from ..workspace import Workspace, spread

#: Classes of the model, how many of them are groups of words, and the dimensions of classes' and of words' vectors.
CLASSES, GROUPS, DIM, WORD_DIM = 512, 256, 16, 8
#: Tokens of a shard, at least, and the most shards there are.
SHARD_TOKENS, MAX_SHARDS = 2_000_000, 10_000
#: Words whose counts are sent to all tasks.
HEAD_SIZE = 150_000
#: Noise classes drawn for each batch, and tokens in a batch.
NOISE, BATCH = 32, 2048
RATE, WORD_RATE = 0.05, 0.1
#: Tokens of a step of the second level.
WORD_BATCH = 8192
#: Bytes of text in a block of documents.
BLOCK_BYTES = 8 << 20
#: Stands for the end of a text; no word is empty.
END = b""
END_CLASS, RARE_CLASS = 0, 1
FOLDS, HELD_OUT = 7, 2
#: Parameters averaged at once.
FAN_IN = 8


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def is_held_out(doc_id) -> bool:
    """Null ids are as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def blocks_of(batches: Iterator[pa.RecordBatch], n_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """ids and texts of some rows at a time, as read, of about ``n_bytes``."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= n_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c): how often each token stands in the training rows of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for ids, texts in blocks_of(batches):
            for doc_id, text in zip(ids, texts):
                if not is_held_out(doc_id):
                    counts.update(tokens_of(text))
            if len(counts) > 400_000:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words of ``counts`` (word, c) from some count on, about ``most`` at most.

    The count is found from a histogram of at most a few thousand bins, so no
    task has to send its own most frequent words to the driver. Of the bin that
    would be too many, the words with the least hashes are taken.
    """
    step = F.floor(F.log2("c") * 32)
    bins = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total = 0
    for at, n in bins:
        if total + n > most:
            limit = -(1 << 63) + int((1 << 64) * (most - total) / n) - 1
            return counts.where((step > at) | ((step == at) & (F.xxhash64("word") <= max(limit, -(1 << 63)))))
        total += n
    return counts


class Vocabulary:
    """Classes of the head's words, and the words' shares of their class."""

    def __init__(self, head: list[tuple[bytes, int]], rare: int, classes: int) -> None:
        """``head``: words and counts, the most frequent first, without the end; ``rare``: the smoothed mass beyond it."""
        groups = min(GROUPS, max(1, classes // 2))
        singles = max(0, classes - 2 - groups)
        self.words = [w for w, _ in head]
        mass = np.array([c + 1 for _, c in head], np.float64)
        kind = np.arange(len(head)) + 2
        rest = mass[singles:]
        middle = np.cumsum(rest) - rest / 2
        kind[singles:] = 2 + singles + np.minimum(groups * middle / max(rest.sum(), 1), groups - 1).astype(np.int64)
        self.kind, self.first = kind, min(singles, len(head))  # words from ``first`` on are in groups
        self.mass = np.concatenate([[1.0, rare], np.bincount(kind, mass, classes)[2:]])
        self.share = mass / self.mass[kind]
        self.ends = np.cumsum(mass)  # of the words' masses laid end to end; those of a group are neighbours
        self.starts = self.ends - mass
        self.count = np.array([c for _, c in head], np.int64)

    def log_class_share(self, ends: int) -> np.ndarray:
        mass = self.mass.copy()
        mass[END_CLASS] += ends
        mass[mass == 0] = 0.5  # a class without words
        return np.log(mass / mass.sum())


class WordModel:
    """Second level: vectors v of the head's words and u of the classes before them."""

    def __init__(self, vocabulary: Vocabulary, classes: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        self.v = np.zeros((len(vocabulary.words), WORD_DIM), np.float32)
        self.u = rng.normal(0, 0.5, (classes, WORD_DIM)).astype(np.float32)
        self.squares = np.full_like(self.v, 1e-2), np.full_like(self.u, 1e-2)

    def train(self, before: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> None:
        """One step on words of groups and the classes before them, each against one word drawn from its group."""
        vocabulary = self.vocabulary
        kind = vocabulary.kind[words]
        low = np.searchsorted(vocabulary.kind, kind, "left")
        draws = vocabulary.starts[low] + rng.random(len(words)) * vocabulary.mass[kind]
        noise = np.minimum(np.searchsorted(vocabulary.ends, draws, "right"), len(vocabulary.words) - 1)
        u = self.u[before]
        true, false = self.v[words], self.v[noise]
        d_true = -1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", true, u), -30, 30)))
        d_false = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", false, u), -30, 30)))
        ids = np.concatenate([words, noise])
        grad = np.concatenate([d_true, d_false]).astype(np.float32)[:, None] * np.concatenate([u, u])
        order = np.argsort(ids, kind="stable")
        at = np.nonzero(np.diff(ids[order], prepend=-1))[0]
        rows, grad = ids[order][at], np.add.reduceat(grad[order], at, axis=0)
        sq = self.squares[0][rows] + grad * grad
        self.squares[0][rows] = sq
        self.v[rows] -= WORD_RATE * grad / np.sqrt(sq)
        g_u = LogBilinear._scatter(before, d_true[:, None] * true + d_false[:, None] * false, len(self.u))
        self.squares[1][...] += g_u * g_u
        self.u -= WORD_RATE * g_u / np.sqrt(self.squares[1])

    def log_sums(self) -> np.ndarray:
        """log of the sum over the words of a class of share(w | c) exp(v_w . u_b), by class and class before."""
        vocabulary, out = self.vocabulary, np.zeros((len(self.u), len(self.u)), np.float32)
        edges = np.searchsorted(vocabulary.kind, np.arange(len(self.u) + 1))
        for k in np.unique(vocabulary.kind[vocabulary.first :]):
            own = slice(edges[k], edges[k + 1])
            out[k] = np.log(vocabulary.share[own] @ np.exp(self.v[own] @ self.u.T))
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([self.v.ravel(), self.u.ravel()])

    def load(self, flat: np.ndarray) -> WordModel:
        cut = self.v.size
        self.v, self.u = flat[:cut].reshape(self.v.shape).astype(np.float32), flat[cut:].reshape(self.u.shape).astype(np.float32)
        return self


class LogBilinear:
    """Parameters r, q (classes x dim), c1, c2 (dim x dim) and b (classes)."""

    def __init__(self, log_share: np.ndarray, dim: int = DIM, seed: int = 0) -> None:
        rng, n = np.random.default_rng(seed), len(log_share)
        self.r = rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        self.c = np.stack([np.eye(dim), np.eye(dim)]).astype(np.float32)
        self.b = log_share.astype(np.float32)
        self.log_noise = log_share.astype(np.float32)
        self.noise = np.exp(log_share.astype(np.float64))
        self.noise /= self.noise.sum()
        self.squares = {k: np.full_like(getattr(self, k), 1e-6) for k in "rqcb"}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.r.ravel(), self.q.ravel(), self.c.ravel(), self.b])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for k in "rqcb":
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def _update(self, name: str, grad: np.ndarray) -> None:
        sq = self.squares[name]
        sq += grad * grad
        getattr(self, name)[...] -= RATE * grad / np.sqrt(sq)

    @staticmethod
    def _scatter(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(ids, weights=rows[:, j], minlength=n) for j in range(rows.shape[1])], axis=1).astype(np.float32)

    def train(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation on a batch of (two classes before, class)."""
        n, size = len(self.b), len(w)
        ctx = self.r[a] @ self.c[0] + self.r[b] @ self.c[1]
        noise = rng.choice(n, NOISE, p=self.noise)
        log_k = np.float32(np.log(NOISE))
        true = np.einsum("ij,ij->i", ctx, self.q[w]) + self.b[w] - self.log_noise[w] - log_k
        false = ctx @ self.q[noise].T + (self.b[noise] - self.log_noise[noise] - log_k)
        d_true = -1 / (1 + np.exp(np.clip(true, -30, 30))) / size
        d_false = 1 / (1 + np.exp(-np.clip(false, -30, 30))) / size
        d_ctx = d_true[:, None] * self.q[w] + d_false @ self.q[noise]
        g_q = self._scatter(w, d_true[:, None] * ctx, n)
        np.add.at(g_q, noise, d_false.T @ ctx)
        g_b = np.bincount(w, weights=d_true, minlength=n).astype(np.float32)
        np.add.at(g_b, noise, d_false.sum(axis=0))
        g_c = np.stack([self.r[a].T @ d_ctx, self.r[b].T @ d_ctx])
        g_r = self._scatter(a, d_ctx @ self.c[0].T, n) + self._scatter(b, d_ctx @ self.c[1].T, n)
        for name, grad in zip("rqcb", (g_r, g_q, g_c, g_b)):
            self._update(name, grad)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(s1, s2, z): log p(w | a, b) = s1[a, w] + s2[b, w] - z[a, b]; s2 holds the bias."""
        s1 = self.r @ self.c[0] @ self.q.T
        s2 = self.r @ self.c[1] @ self.q.T + self.b
        top = s2.max(axis=1)
        e1, e2 = np.exp(s1 - s1.max(axis=1, keepdims=True)), np.exp(s2 - top[:, None])
        z = np.log(np.maximum(e1 @ e2.T, 1e-30)) + s1.max(axis=1)[:, None] + top[None, :]
        return s1.astype(np.float32), s2.astype(np.float32), z.astype(np.float32)


def context_of(classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token; before a text stand ends. ``ends``: where texts end, exclusive."""
    a, b = np.empty_like(classes), np.empty_like(classes)
    b[1:], b[:1] = classes[:-1], END_CLASS
    a[2:], a[:2] = classes[:-2], END_CLASS
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    starts = starts[starts < len(classes)]
    b[starts] = END_CLASS
    a[starts] = END_CLASS
    second = starts[starts + 1 < len(classes)] + 1
    a[second] = END_CLASS
    return a, b


def train_model(docs: DataFrame, vocabulary: Vocabulary, log_share: np.ndarray, n_tokens: int) -> np.ndarray:
    """Averaged parameters, of both levels one after the other, of one pass over all training rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, log_share))
    n = max(1, -(-n_tokens // max(SHARD_TOKENS, n_tokens // MAX_SHARDS)))
    in_training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS != HELD_OUT
    rows = docs.where(in_training).select("doc_id", "text").withColumn("h", F.xxhash64(F.lit(7), "doc_id", "text"))
    rows = rows.withColumn("shard", F.pmod("h", F.lit(n)).cast("int")).repartition(n, "shard").sortWithinPartitions("shard", "h")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, log_share = shared.value
        index = {w: i for i, w in enumerate(vocabulary.words)} | {END: -1}
        kinds = np.concatenate([vocabulary.kind, [RARE_CLASS, END_CLASS]])  # of words -2 and -1

        def trained(texts: Iterator[str | None]) -> tuple[np.ndarray, int]:
            model, words, rng, seen = LogBilinear(log_share), WordModel(vocabulary, len(log_share)), np.random.default_rng(1), 0
            for some in _lots(texts, BLOCK_BYTES // 4):
                flat, ends = [], []
                for text in some:
                    flat += [index.get(w, -2) for w in tokens_of(text)]
                    ends.append(len(flat))
                ids = np.array(flat, np.int64)
                classes = kinds[ids]
                a, b = context_of(classes, np.array(ends))
                order = rng.permutation(len(ids))
                for i in range(0, len(order), BATCH):
                    at = order[i : i + BATCH]
                    model.train(a[at], b[at], classes[at], rng)
                grouped = order[ids[order] >= vocabulary.first]
                for i in range(0, len(grouped), WORD_BATCH):
                    at = grouped[i : i + WORD_BATCH]
                    words.train(b[at], ids[at], rng)
                seen += len(ids)
            return np.concatenate([model.flat(), words.flat()]), seen

        for shard, texts in _by_shard(batches):
            flat, seen = trained(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([flat.astype("<f4").tobytes()], pa.binary()), pa.array([float(seen)]), pa.array([shard], pa.int32())], ["flat", "weight", "part"]
            )

    def average(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total, flat = float(pdf["weight"].sum()), 0.0
        for f, w in zip(pdf["flat"], pdf["weight"]):
            flat = flat + np.frombuffer(f, "<f4") * np.float64(w / total)
        return pd.DataFrame({"flat": [flat.astype("<f4").tobytes()], "weight": [total], "part": [key[0]]})

    parts = rows.select("shard", "text").mapInArrow(local, "flat binary, weight double, part int")
    while True:  # each level averages FAN_IN of them
        n = -(-n // FAN_IN)
        parts = parts.groupBy((F.col("part") % n).cast("int").alias("into")).applyInPandas(average, "flat binary, weight double, part int")
        if n == 1:
            break
    row = parts.first()
    return np.frombuffer(row["flat"], "<f4") if row else np.concatenate([LogBilinear(log_share).flat(), WordModel(vocabulary, len(log_share)).flat()])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[str | None]]]:
    """Shard and texts of rows that come sorted by shard, without holding them."""
    rows = ((shard, text.as_py()) for batch in batches for shard, text in zip(batch.column(0).to_pylist(), batch.column(1)))
    for shard, own in groupby(rows, key=itemgetter(0)):
        yield shard, map(itemgetter(1), own)


def _lots(texts: Iterator[str | None], n_bytes: int) -> Iterator[list[str | None]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= n_bytes:
            yield some
            some, size = [], 0
    if some:
        yield some


def score_texts(docs: DataFrame, ws: Workspace | None = None, classes: int = CLASSES, head_size: int = HEAD_SIZE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    Null and empty texts are the end alone. Rows come back one for one,
    repeated ones too; a null doc_id counts as the empty text for the folds. Ids
    may be of any type. Without training rows all counts are zero; an empty table
    gives an empty result. Scores are log10.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "lm")
    docs = docs.select("doc_id", "text")
    counts = ws.save(count_words(docs), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    head = [(bytes(r.word), r.c) for r in frequent_words(counts.where(F.octet_length("word") > 0), head_size).collect()]
    ends = counts.where(F.octet_length("word") == 0).first()
    n_ends = ends.c if ends else 0
    unseen_end = 0 if ends else 1  # without training rows even the end is unknown
    head.sort(key=lambda x: (-x[1], x[0]))
    rare = n - n_ends - sum(c for _, c in head) + (v + 1 - (1 if ends else 0) - len(head))  # smoothed, with one unseen word
    vocabulary = Vocabulary(head, rare, max(classes, 4))
    log_share = vocabulary.log_class_share(n_ends)
    flat = train_model(docs, vocabulary, log_share, n)
    model = LogBilinear(log_share)
    cut = model.flat().size
    words = WordModel(vocabulary, len(log_share)).load(flat[cut:])
    shared = spark.sparkContext.broadcast((vocabulary, n_ends, model.load(flat[:cut]).table(), words.v, words.u, words.log_sums()))
    log_all, log_rare = float(np.log10(n + v + 1)), float(np.log10(max(rare, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the head gives, and its other words."""
        vocabulary, n_ends, (s1, s2, z), v, u, log_sums = shared.value
        index = {w: i for i, w in enumerate(vocabulary.words)} | {END: -1}
        kinds = np.concatenate([vocabulary.kind, [RARE_CLASS, END_CLASS]])  # of words -2 and -1
        logs_of = np.log10(np.concatenate([vocabulary.count + 1.0, [1.0, n_ends + 1.0]]))
        share = np.log(vocabulary.share)
        tail_kind = pa.map_(pa.binary(), pa.int64())
        for ids, texts in blocks_of(batches, BLOCK_BYTES // 4):
            flat, ends, tail_n, tails = [], [], [], []
            for text in texts:
                own = tokens_of(text)
                at = [index.get(w, -2) for w in own]
                flat += at
                ends.append(len(flat))
                tail = Counter(w for w, i in zip(own, at) if i == -2)
                tail_n.append(tail.total())
                tails.append(list(tail.items()))
            found = np.array(flat, np.int64)
            kind, logs = kinds[found], logs_of[found]
            cut, ends = np.concatenate([[0], ends[:-1]]).astype(np.int64), np.array(ends)
            a, b = context_of(kind, ends)
            bits = (s1[a, kind] + s2[b, kind] - z[a, b]).astype(np.float64)
            grouped = np.nonzero(found >= vocabulary.first)[0]
            w, c, before = found[grouped], kind[grouped], b[grouped]
            bits[grouped] += np.einsum("ij,ij->i", v[w], u[before]) + share[w] - log_sums[c, before]
            bits = bits / np.log(10) - np.where(kind == RARE_CLASS, log_rare, 0.0)  # the counts of rare words come with the join
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch_kind),
                    pa.array([is_held_out(i) for i in ids]),
                    pa.array(ends - cut),
                    pa.array(ends - cut - np.array(tail_n) - unseen_end),
                    pa.array(np.add.reduceat(logs, cut) - (ends - cut) * log_all),
                    pa.array(np.add.reduceat(bits, cut)),
                    pa.array(tails, tail_kind),
                ],
                ["doc_id", "held_out", "n_tokens", "n_head", "base", "model", "tail"],
            )

    doc_kind = dict(docs.dtypes)["doc_id"]
    batch_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {doc_kind}, held_out boolean, n_tokens long, n_head long, base double, model double, tail map<binary,bigint>"
    rows = docs.mapInArrow(run, schema)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = ws.save(rows, "rows")  # from here on the row numbers are fixed
    return _add_tail(rows, counts, n)


def _add_tail(rows: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """Adds what words outside the head give: log10 (c + 1) for base and model alike, and whether they are known."""
    tail = rows.select("row", F.explode("tail").alias("word", "times"))
    hit = tail.join(counts, "word").select("row", "times", "c")
    sums = hit.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("gain"))
    out = rows.drop("tail").join(sums, "row", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("model") + gain).alias("score"),
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of each row of ``documents``; what ``score_texts`` says of nulls, repeats and empty tables holds."""
    return score_texts(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
