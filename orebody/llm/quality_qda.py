"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text is turned into a few statistics (shares of letters, capitals and symbols, repetition, length of words and so on),
transformed towards normality and standardised. Each class has its own mean and a covariance shrunk towards the pooled
covariance and towards the identity; a score is the logistic of the log prior odds plus the difference of log densities, with
Mahalanobis distances taken from Cholesky factors computed once.

Shares over a few words say little. So a text of n words counts n / (n + PRIOR_WORDS) of its own statistics and the rest of those that the
training rows of label 1 have on average, and n / (n + 1) of the difference of densities; a text without words scores the prior share.

Fitting may use a bounded sample of the labelled rows (`max_labels`, chosen by a hash of the id); class sums are made in
Spark, so only sums reach the driver. Every other row is scored whole.

Edge cases: null and empty texts score the share of label 1; labels that are null or neither 0 nor 1 are left out, as
are ids with contradicting labels and null ids; repeated rows are scored alike; classes without any spread keep the spread of the identity;
with only one class labelled, every score is that class's
prior (1.0 or 0.0), with none 0.5; an empty table gives no rows; columns other than id, text and label are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import text_chunks, texts_of

MAX_LABELS = 20_000
SHRINK_POOLED = 0.3
SHRINK_IDENTITY = 0.1
CLIP = 5.0

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_SMALL = b"abcdefghijklmnopqrstuvwxyz"
_SPACE = b" \t\n\x0b\x0c\r"
_PLAIN = b".,;:'\"()-?"
_HIGH = bytes(range(128, 256))
_RUN = re.compile(rb"([!-/:-@\[-`{-~])\1+")
PRIOR_WORDS = 12
FLOOR = 1e-3  # of the variance towards which covariances are shrunk, in units of the standardised statistics
STATISTICS = ["capitals", "digits", "symbols", "word_length", "different_words", "repeated_next", "short_words", "sentence_ends", "bare_symbol_words", "repeated_lines", "symbol_runs", "different_symbols"]


def statistics(text: bytes) -> list[float]:
    """The words of a text, and its transformed statistics (zeros if it has no words)."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (1 + len(STATISTICS))
    size = len(text) - sum(map(text.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    without = lambda chars: size - (len(text.translate(None, chars + _SPACE)))
    capitals, digits = without(_CAPITALS), without(_DIGITS)
    symbols = text.translate(None, _CAPITALS + _DIGITS + _SMALL + _SPACE + _PLAIN + _HIGH)
    odd = len(symbols)
    letters = max(1, size - digits - odd)
    repeats = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    lengths = np.fromiter(map(len, words), np.int64, n)
    bare = sum(1 for w in words if len(w) == 1 and not (w.isalnum() or w >= b"\x80"))
    runs = sum(len(m[0]) for m in _RUN.finditer(text))
    root = lambda p: float(np.arcsin(min(1.0, max(0.0, p)) ** 0.5))
    return [
        float(n),
        root(capitals / letters),
        root(digits / size),
        root(odd / size),
        float(np.log1p(lengths.mean())),
        float(np.log(len(set(words)) + 1) / np.log(n + 1)),
        root(repeats / n),
        root(float((lengths <= 3).mean())),
        root(ends / n),
        root(bare / n),
        root(1 - len(set(lines)) / len(lines)) if len(lines) > 3 else 0.0,
        root(runs / size),
        root(len(set(symbols)) / 32),
    ]


def table_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of texts, a row each, and their words."""
    x = np.array([statistics(t) for t in texts]).reshape(-1, 1 + len(STATISTICS))
    return x[:, 1:], x[:, 0]


@dataclass
class Model:
    """Location and scale of the statistics; per class: log prior, mean, Cholesky factor's inverse, log determinant."""

    mean: np.ndarray
    scale: np.ndarray
    prior: float
    usual: np.ndarray | None = None  # the statistics towards which short texts are drawn
    means: np.ndarray | None = None
    inverses: np.ndarray | None = None
    log_dets: np.ndarray | None = None

    def scores(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics of n words."""
        if self.means is None:
            return np.full(len(x), self.prior)
        w = (n / (n + PRIOR_WORDS))[:, None]
        z = np.clip((w * x + (1 - w) * self.usual - self.mean) / self.scale, -CLIP, CLIP)
        logs = []
        for k in (0, 1):
            y = (z - self.means[k]) @ self.inverses[k].T
            logs.append(-0.5 * (self.log_dets[k] + (y * y).sum(axis=1)))
        odds = np.log(self.prior / (1 - self.prior)) + n / (n + 1) * (logs[1] - logs[0])
        return 1 / (1 + np.exp(np.clip(-odds, -700, 700)))


def held_out(key: str = "doc_id") -> Column:
    """Rows that may not be learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_labels(labels: DataFrame, key: str = "doc_id", label: str = "quality", max_labels: int = MAX_LABELS) -> DataFrame:
    """At most `max_labels` ids outside the held-out part, by a hash of the id, with their label as `_y`."""
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.min(label).alias("_y"), F.max(label).alias("_y2"))
    return one.filter("_y = _y2").select(F.col(key), F.col("_y").cast("int")).orderBy(F.xxhash64(key), key).limit(max_labels)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labels: int = MAX_LABELS, pooled: float = SHRINK_POOLED, identity: float = SHRINK_IDENTITY) -> Model:
    """Class means and shrunk covariances from the labelled documents."""
    sample = bounded_labels(labels, key, label, max_labels)
    known = docs.select(key, text).join(F.broadcast(sample), key)  # `max_labels` small rows at most
    d = len(STATISTICS)
    side = d + 1  # the weighted statistics w x, and the rest 1 - w of the weight

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + side + side * side))
        for batch in batches:
            for part in text_chunks(batch, text):
                x, words = table_of(texts_of(part, text))
                y = part.column("_y").to_numpy(zero_copy_only=False)
                w = (words / (words + PRIOR_WORDS))[:, None]
                parts = np.hstack([w * x, 1 - w])
                for k in (0, 1):
                    own = parts[y == k]
                    total[k] += np.concatenate([[len(own)], x[y == k].sum(axis=0), own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["y", "s"])

    rows = known.mapInArrow(sums, "y int, s array<double>").select("y", F.posexplode("s").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()  # 2 * 195 numbers
    total = np.zeros((2, 1 + d + side + side * side))
    for r in rows:
        total[r.y, r.i] = r.v
    n = total[:, 0]
    if n.min() < 2:
        return Model(np.zeros(d), np.ones(d), 0.5 if not n.sum() else float(n[1] / n.sum()))
    usual = total[1, 1 : 1 + d] / n[1]
    drawn = np.vstack([np.eye(d), usual])  # w x + (1 - w) usual is (w x, 1 - w) times this
    first = total[:, 1 + d : 1 + d + side] @ drawn
    second = drawn.T @ total[:, 1 + d + side :].reshape(2, side, side) @ drawn
    mean = first.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(second.sum(axis=0)) / n.sum() - mean**2, 1e-6))
    means = (first / n[:, None] - mean) / scale
    inside = [(second[k] / n[k] - np.outer(m := first[k] / n[k], m)) / np.outer(scale, scale) for k in (0, 1)]
    common = (n[0] * inside[0] + n[1] * inside[1]) / n.sum()
    inverses, log_dets = [], []
    for k in (0, 1):
        s = (1 - pooled) * inside[k] + pooled * common
        s = (1 - identity) * s + identity * max(np.trace(s) / d, FLOOR) * np.eye(d)
        factor = np.linalg.cholesky(s)
        inverses.append(np.linalg.inv(factor))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Model(mean, scale, float(n[1] / n.sum()), usual, means, np.array(inverses), np.array(log_dets))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of `docs` plus `out`."""
    names = [c for c in docs.columns if c != out]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = type(kept.schema)(list(kept.schema.fields)).add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(*table_of(texts_of(part, text))))], [*names, out])

    return kept.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, out="__quality").filter("__quality >= 0.5").select(*docs.columns)
