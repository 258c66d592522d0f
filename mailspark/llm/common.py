"""What several operators share: reading, writing, hashing and numbering rows."""

import os
import sys
import types

import numpy as np
from pyspark.sql import functions as F

from mailspark.session import shared_dir

MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def table(spark, sf_dir, name):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(frame, purpose):
    """The frame as a Parquet table in the shared folder, read back with a short lineage."""
    spark = frame.sparkSession
    path = shared_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def per_process(name, make):
    """What ``make()`` gave first in this Python worker, for as long as the worker lives.

    Functions are shipped by value, so a module's own globals are new in every task.
    """
    held = sys.modules.setdefault("mailspark_worker_state", types.ModuleType("mailspark_worker_state")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def rows_by_id(docs, ids, how):
    """The rows of ``docs`` whose doc_id is ("left_semi") or isn't ("left_anti") among ``ids``; null equals null.

    The joined column gets a name that no column of ``docs`` has.
    """
    taken, name = {c.lower() for c in docs.columns}, "_id"
    while name in taken:
        name += "_"
    found = ids.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), how)


def partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(frame, key, order, name, buckets):
    """Number the rows of each key from 0 without gaps, in no task more than a bucket's rows.

    Rows are hashed by ``order`` (column names) into buckets; a rank is the number of rows
    in earlier buckets of the key plus the place inside the bucket.
    """
    from pyspark.sql import Window

    put = frame.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = put.groupBy(key, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(key).alias("_key"), F.col("_bucket").alias("_of"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (
        put.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_of")))
        .withColumn(name, (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_bucket", "_place", "_key", "_of", "_start")
    )


def powers(n):
    """MULTIPLIER ** 0..n and their inverses, modulo 2 ** 64."""
    held = per_process("powers", lambda: [np.ones(1, np.uint64)] * 2)
    if len(held[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        ahead, back = np.full(size, MULTIPLIER, np.uint64), np.full(size, inverse, np.uint64)
        ahead[0] = back[0] = 1
        held[:] = np.cumprod(ahead), np.cumprod(back)
    return held


def mixed(values):
    """A bijective scramble of 64-bit words."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """64-bit polynomial hashes of any slices of one sequence of small integers."""

    def __init__(self, symbols):
        table_of = mixed(np.arange(1, 257, dtype=np.uint64))
        weights = table_of[symbols] if symbols.dtype == np.uint8 else mixed(symbols.astype(np.uint64) + np.uint64(1))
        self.ahead, self.back = powers(len(symbols))
        weights *= self.ahead[: len(symbols)]
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(weights, out=self.sums[1:])

    def of(self, starts, ends):
        hashes = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mixed(hashes + (np.asarray(ends) - starts).astype(np.uint64) * np.uint64(MULTIPLIER))


def utf8_batch(column):
    """The bytes of an Arrow string column in one array, and each row's start and end; null is empty."""
    import pyarrow as pa

    filled = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, offsets[:-1], offsets[1:]


def runs_of_rows(sizes, most):
    """Slices of rows whose sizes add up to about ``most``; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
