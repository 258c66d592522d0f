"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

One pass turns every whole text into a vector of statistics. The moments of both classes are sums
over all labelled training rows. Each class covariance is shrunk towards the pooled one
and towards a multiple of the identity; its Cholesky factor is computed once and cached in the
model, and a score is the logistic of the difference of the two Mahalanobis log densities.

Defined results: null and empty texts have the statistics of no words and are scored like any
other text. Rows without an id count as training rows. Without labels of both classes the score is
the share of label 1 (0.5 without any label). Other columns are not looked at.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.llm.common import RollingHash, runs_of_rows, utf8_batch, written
from mailspark.llm.language import held_out

STATISTICS = (
    "words", "word_length", "upper", "digits", "symbols", "marks", "stops", "commas", "new_lines", "high",
    "distinct_words", "distinct_pairs", "repeated_words", "symbol_ends", "short_words", "length_spread",
)
#: Shrinkage of a class covariance towards the pooled one, and towards a multiple of the identity.
TO_POOLED, TO_IDENTITY = 0.3, 0.05
#: Log-density differences are divided by this before the logistic, against overconfidence.
TEMPERATURE = 4.0
THRESHOLD = 0.7
CHUNK = 1_000_000
UPPER, DIGIT, STOP, COMMA, MARK, SYMBOL, SPACE, NEWLINE, HIGH = range(1, 10)


def _byte_kinds():
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = SYMBOL
    kinds[ord("a") : ord("z") + 1] = 0
    kinds[ord("A") : ord("Z") + 1] = UPPER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[[ord("."), ord("?"), ord(";"), ord(":")]] = STOP
    kinds[ord(",")] = COMMA
    kinds[ord("!")] = MARK
    kinds[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    kinds[0x0A] = NEWLINE
    kinds[0x80:] = HIGH
    return kinds


KINDS = _byte_kinds()


def statistics(data, starts, ends):
    """Transformed statistics of texts that lie in one byte array, as a matrix."""
    kind = KINDS[data]
    n = np.maximum(ends - starts, 1).astype(float)

    def share(mask):
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[ends] - sums[starts]) / n

    blank = (kind == SPACE) | (kind == NEWLINE)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    edge[ends] = True
    begins = np.flatnonzero(~blank & (np.concatenate(([True], blank[:-1])) | edge[:-1]))
    last = ~blank & (np.concatenate((blank[1:], [True])) | edge[1:])
    stops = np.flatnonzero(last) + 1
    live = (begins >= starts[0]) & (begins < ends[-1])
    begins, stops = begins[live], stops[live]
    owner = np.searchsorted(starts, begins, side="right") - 1
    words = RollingHash(data).of(begins, stops)
    lengths = stops - begins
    count = np.bincount(owner, minlength=len(starts)).astype(float)
    some = np.maximum(count, 1)

    def mean(values):
        return np.bincount(owner, weights=values, minlength=len(starts)) / some

    same_doc, repeated = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    same_doc[1:] = owner[1:] == owner[:-1]
    repeated[1:] = same_doc[1:] & (words[1:] == words[:-1])
    pairs = words + np.roll(words, 1) * np.uint64(0x9E3779B97F4A7C15)

    def distinct(values, rows):
        order = np.lexsort((values, rows))
        v, r = values[order], rows[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=len(starts)), np.bincount(r, minlength=len(starts))

    kinds_of_words, _ = distinct(words, owner)
    kinds_of_pairs, all_pairs = distinct(pairs[same_doc], owner[same_doc])
    end_kind = kind[stops - 1]
    length = mean(lengths)
    ratio = (kinds_of_words + 1) / (count + 1)
    pair_ratio = (kinds_of_pairs + 1) / (all_pairs + 1)
    shares = [share(kind == k) for k in (UPPER, DIGIT, SYMBOL, MARK, STOP, COMMA, NEWLINE, HIGH)]
    columns = [
        np.log1p(count), np.log1p(length), *(np.sqrt(s) for s in shares),
        ratio * np.log1p(count), pair_ratio, np.sqrt(mean(repeated)), np.sqrt(mean((end_kind == SYMBOL) | (end_kind == MARK))),
        np.sqrt(mean(lengths <= 3)), np.log1p(np.sqrt(np.maximum(mean(lengths * lengths) - length**2, 0))),
    ]
    return np.stack(columns, axis=1)


def describe(docs):
    """(doc_id, held_out, features) of every document."""

    def run(batches):
        for batch in batches:
            data, starts, ends = utf8_batch(batch.column(2))
            rows = []
            for a, b in runs_of_rows((ends - starts).tolist(), CHUNK):
                low, high = int(starts[a]), int(ends[b - 1])
                rows.append(statistics(data[low:high], starts[a:b] - low, ends[a:b] - low) if high > low else None)
                if rows[-1] is None:
                    rows[-1] = statistics(np.zeros(1, np.uint8) + 32, np.zeros(b - a, np.int64), np.zeros(b - a, np.int64))
            flat = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
            features = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), features], ["doc_id", "held_out", "features"]
            )

    schema = T.StructType().add("doc_id", "long").add("held_out", "boolean").add("features", T.ArrayType(T.DoubleType()))
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)


class Model:
    """Means, cached Cholesky factors and log determinants of both classes."""

    def __init__(self, counts, sums, squares):
        self.prior = counts[1] / sum(counts) if sum(counts) else 0.5
        self.ready = min(counts) > 1
        if not self.ready:
            return
        means = [s / c for s, c in zip(sums, counts, strict=True)]
        spreads = [q / c - np.outer(m, m) for q, c, m in zip(squares, counts, means, strict=True)]
        pooled = sum(c * s for c, s in zip(counts, spreads, strict=True)) / sum(counts)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        unit = np.outer(self.scale, self.scale)
        self.means = [m / self.scale for m in means]
        self.factors, self.log_sizes = [], []
        for spread in spreads:
            own = (1 - TO_POOLED) * spread / unit + TO_POOLED * pooled / unit
            d = len(own)
            own = (1 - TO_IDENTITY) * own + TO_IDENTITY * np.trace(own) / d * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.factors.append(np.linalg.inv(factor))
            self.log_sizes.append(2 * np.log(np.diag(factor)).sum())

    def score(self, features):
        if not self.ready:
            return np.full(len(features), self.prior)
        logs = []
        for mean, factor, size in zip(self.means, self.factors, self.log_sizes, strict=True):
            away = (features / self.scale - mean) @ factor.T
            logs.append(-0.5 * ((away**2).sum(axis=1) + size))
        gap = (logs[1] - logs[0]) / TEMPERATURE + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fit(described, labels):
    """The model from all labelled rows that aren't held out."""
    d = len(STATISTICS)
    upper = np.triu_indices(d)

    def moments(batches):
        totals = np.zeros((2, 1 + d + len(upper[0])))
        for batch in batches:
            label = batch.column(1).to_numpy()
            rows = batch.column(0).flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                own = rows[label == k]
                totals[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own)[upper]))
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * totals.shape[1], pa.int32()), pa.array(range(totals.shape[1]), pa.int32()), pa.array(totals[k])],
                ["label", "k", "value"],
            )

    known = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").alias("label")).distinct()
    rows = described.filter(~F.col("held_out")).join(known, "doc_id").select("features", "label")
    sums = rows.mapInArrow(moments, "label int, k int, value double").groupBy("label", "k").agg(F.sum("value").alias("value"))
    table = np.zeros((2, 1 + d + len(upper[0])))
    for row in sums.collect():  # two classes times the number of moments
        table[row["label"], row["k"]] = row["value"]
    squares = np.zeros((2, d, d))
    for k in (0, 1):
        squares[k][upper] = table[k, 1 + d :]
        squares[k] = squares[k] + squares[k].T - np.diag(np.diag(squares[k]))
    return Model(table[:, 0], table[:, 1 : 1 + d], squares)


def apply(described, model):
    def run(batches):
        for batch in batches:
            rows = batch.column(2).flatten().to_numpy().reshape(-1, len(STATISTICS))
            score = model.score(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return described.select("doc_id", "held_out", "features").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def classify(docs, labels):
    """(doc_id, held_out, score, predicted) of every document."""
    described = written(describe(docs), "statistics")
    return apply(described, fit(described, labels))
