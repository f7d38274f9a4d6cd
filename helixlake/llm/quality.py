"""Quality classifier by positive-unlabelled learning.

A document is described by style statistics of its whole text (shares of
character classes, token repetition, sentence and line shape).  Each statistic is
cut at quantiles of the training sample into one-hot bins, and a linear model
over the bins is fitted by minimising the non-negative unbiased PU risk
(Kiryo et al., 2017) with the logistic loss: trusted positives on one side,
unlabelled documents on the other, and the class prior between them estimated
from the same two samples by the best-bin rule (Garg et al., 2021).

Training reads a bounded sample (``max_positive`` and ``max_unlabelled`` rows);
scoring reads everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import kernels
from helixlake.llm.common import crc_bucket, seeded_sample, sliced, table

#: Names of the statistics, in the order of the columns of ``features``.
FEATURES = (
    "log_tokens", "token_bytes", "upper", "digit", "bang", "symbol", "pipe", "stop", "comma", "newline",
    "repeat_next", "distinct", "distinct_shingles", "capital_tokens", "tokens_per_stop", "odd_end", "non_ascii", "max_token",
)


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; a null or empty text gives zeros."""
    out = [np.zeros((0, len(FEATURES)))]
    for _, data, ends in kernels.chunks(column):
        n = len(ends) - 1
        x = np.zeros((n, len(FEATURES)))
        size = np.diff(ends).astype(np.float64)
        row = np.repeat(np.arange(n), np.diff(ends))
        h, start, stop, rows = kernels.tokenize(data, ends)
        tokens = np.bincount(rows, minlength=n).astype(np.float64)
        per_byte, per_token = np.maximum(size, 1), np.maximum(tokens, 1)

        table = np.zeros(256, np.int64)
        for value, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "*#$%&@^~", "|", ".?", ",;", "\n"), 1):
            table[[ord(c) for c in chars]] = value
        table[128:] = 9
        kinds = np.bincount(row * 10 + table[data], minlength=10 * n).reshape(n, 10) / per_byte[:, None]
        x[:, 0] = np.log1p(tokens)
        x[:, 1] = np.bincount(rows, stop - start, minlength=n) / per_token
        x[:, 2:10] = kinds[:, 1:9]
        if len(h):
            again = np.zeros(len(h))
            again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
            x[:, 10] = np.bincount(rows, again, minlength=n) / per_token
            _, r, _ = kernels.counted(h, rows)
            x[:, 11] = np.bincount(r, minlength=n) / per_token
            s, sr, _ = kernels.shingle(h, rows)
            _, r, _ = kernels.counted(s, sr)
            x[:, 12] = np.bincount(r, minlength=n) / np.maximum(np.bincount(sr, minlength=n), 1)
            first, last = data[start], data[stop - 1]
            x[:, 13] = np.bincount(rows, (first >= 65) & (first <= 90), minlength=n) / per_token
            ended = (last == 46) | (last == 63)
            x[:, 14] = np.log1p(tokens / np.maximum(np.bincount(rows, ended, minlength=n), 1))
            letter = ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | (last >= 128) | (last == 46) | (last == 44)
            x[:, 15] = np.bincount(rows, ~letter, minlength=n) / per_token
            longest = np.zeros(n)
            np.maximum.at(longest, rows, (stop - start).astype(np.float64))
            x[:, 17] = np.log1p(longest)
        x[:, 16] = kinds[:, 9]
        out.append(x)
    return np.concatenate(out)


@dataclass
class Model:
    """Bin edges, weights and the class prior of a fitted classifier."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts, base = [], 0
        for j, edge in enumerate(self.edges):
            parts.append(base + np.searchsorted(edge, x[:, j], side="right"))
            base += len(edge) + 1
        return np.stack(parts, axis=1) if parts else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1), from 0 to 1."""
        if not self.edges:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.weights[self.encode(x)].sum(axis=1), -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from held-out scores of both.

    Over thresholds, the ratio of the two tail probabilities bounds the share
    from above; the bound whose confidence term is smallest is taken.
    """
    if not len(positive) or not len(unlabelled):
        return 1.0
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)[::-1]
    cut = np.unique(np.quantile(p, np.linspace(0, 1, 201)))
    tail_p = np.searchsorted(-p, -cut, side="right") / len(p)
    tail_u = np.searchsorted(-u, -cut, side="right") / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    at = np.argmin(tail_u / np.maximum(tail_p, 1e-9) + slack / np.maximum(tail_p, 1e-9))
    return float(np.clip(tail_u[at] / max(tail_p[at], 1e-9), 0.02, 0.98))


def _fit_weights(model: Model, p: np.ndarray, u: np.ndarray, prior: float, steps: int, rate: float, decay: float, pu: bool) -> None:
    """Adam on the non-negative PU risk (or, without ``pu``, on the logistic risk of p against u).

    ``p`` and ``u`` hold, for each row, the indices of its one-hot bins.
    """
    size = len(model.weights)
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = w[p].sum(axis=1) + b, w[u].sum(axis=1) + b
        sp, su = sigmoid(zp), sigmoid(zu)
        if pu:
            # logistic loss: log(1 + exp(-z)) as a positive, of slope s - 1; log(1 + exp(z)) as a negative, of slope s
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                gp, gu = prior * (sp - 1 - sp) / len(zp), su / len(zu)
            else:  # the estimate has gone below what any risk can be: step back along it
                gp, gu = prior * sp / len(zp), -su / len(zu)
        else:
            gp, gu = (sp - 1) / len(zp) / 2, su / len(zu) / 2
        slope = sum(np.bincount(code[:, j], g, minlength=size) for code, g in ((p, gp), (u, gu)) for j in range(code.shape[1]))
        g = np.append(slope + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model.weights, model.bias = w, float(b)


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1500, rate: float = 0.1, seed: int = 7) -> Model:
    """Fit on two feature matrices; with either empty, every score is 1.

    Small samples get fewer bins and more decay.
    """
    if not len(positive) or not len(unlabelled):
        return Model([], np.zeros(0), 0.0, 1.0)
    both = np.concatenate([positive, unlabelled])
    bins, decay = int(np.clip(len(positive) // 20, 2, 12)), 0.08 / len(both)
    edges = [np.unique(np.quantile(both[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(both.shape[1])]
    model = Model(edges, np.zeros(sum(len(e) + 1 for e in edges)), 0.0, 1.0)
    p, u = model.encode(positive), model.encode(unlabelled)
    draw = np.random.default_rng(seed)
    half_p, half_u = draw.permutation(len(p)) < len(p) // 2, draw.permutation(len(u)) < len(u) // 2
    scores: list[tuple[np.ndarray, np.ndarray]] = []
    for side in (True, False):  # scores of either half by a model of the other
        fp, fu = (half_p, half_u) if side else (~half_p, ~half_u)
        if fp.any() and fu.any() and (~fp).any() and (~fu).any():
            _fit_weights(model, p[fp], u[fu], 0.5, steps // 4, rate, decay, pu=False)
            scores.append((model.weights[p[~fp]].sum(axis=1) + model.bias, model.weights[u[~fu]].sum(axis=1) + model.bias))
    if scores:
        model.prior = class_prior(np.concatenate([s[0] for s in scores]), np.concatenate([s[1] for s in scores]))
    _fit_weights(model, p, u, model.prior, steps, rate, decay, pu=True)
    return model


def learn(docs: DataFrame, positive_ids: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", max_positive: int = 4000, max_unlabelled: int = 8000) -> Model:
    """Fit on the documents named in ``positive_ids`` and on unlabelled ones where ``train`` holds.

    Both samples are the distinct rows with the smallest hashes of id and text, at
    most ``max_positive`` and ``max_unlabelled`` of them; only their statistics
    reach the driver.  With no positives or no documents
    the model accepts everything.
    """
    key = F.xxhash64(F.lit("quality"), F.col("_id").cast("string"), F.col("_hash"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"), F.coalesce(train, F.lit(False)).alias("_train"))
    names = rows.select("_id", "_hash", "_train")
    named = names.join(positive_ids.select(F.col(doc_id).alias("_id")), "_id", "left_semi").select("_id", "_hash")
    trusted = seeded_sample(named, key, None, max_positive).withColumn("_role", F.lit(1))
    web = seeded_sample(names.where("_train").select("_id", "_hash"), key, None, max_unlabelled).withColumn("_role", F.lit(0))
    chosen = trusted.unionByName(web).select(F.col("_id").alias("_of"), F.col("_hash").alias("_which"), "_role")
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_which"))
    rows = rows.join(F.broadcast(chosen), same).select("_id", "_hash", "_role", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = features(batch.column(3))
            flat = pa.array(x.astype(np.float64).ravel())
            offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, flat)], names=["_id", "_hash", "_role", "x"])

    out = T.StructType([*rows.schema.fields[:3], T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = rows.mapInArrow(run, out).dropDuplicates(["_id", "_hash", "_role"]).orderBy("_id", "_hash").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    role = got["_role"].to_numpy()
    return fit(x[role == 1], x[role == 0])


def score_documents(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(``doc_id``, score): one row for each row, scored on its whole text.

    A null text counts as empty; an empty text has a score too.
    """
    rows = docs.select(doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))))], names=[doc_id, "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema[doc_id], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows whose score is ``least`` or more, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)


def train_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``op4_quality`` and of the pipeline: positives are labelled 1, ids with crc32 mod 5 of 0 held out."""
    positive = labels.where((F.col("quality") == 1) & (crc_bucket("doc_id", 5) != 0))
    return learn(docs, positive, crc_bucket("doc_id", 5) != 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document: doc_id, held_out, score, predicted."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(docs, train_on_labels(docs, labels))
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
