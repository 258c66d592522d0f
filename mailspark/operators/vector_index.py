"""Approximate search by meaning: vectors stored under the signs of their projections.

Planes have coefficients of plus and minus one that follow from a formula, so any engine can name the bucket
of a vector. A table gives each vector as many sign bits as it has planes; several tables give several chances
to meet. The index is a Parquet table with one folder for each table and bucket. A search looks into the
query's bucket of each table and into those that differ in the bits nearest to their planes; the folders are
chosen by a filter on partition columns, so nothing else is read. Distances are exact; neighbours may be missed.
"""

import os
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailspark.functions.vectors import cosine_distance

#: Tables, bits that are turned in each when a query is asked, and vectors that a bucket should hold.
TABLES, TURNED, BUCKET = 8, 3, 4096
#: A bucket is written in files of about so many vectors.
FILE = 100_000
#: Fixed values of the formula for planes.
PRIME, STEP_PLANE, STEP_PLACE, FACTOR = 2_147_483_647, 7919, 104_729, 48_271


def planes(tables, bits, width):
    """Coefficients, plus or minus one, by table, plane and place."""
    plane, place = np.arange(tables * bits, dtype=np.int64)[:, None], np.arange(width, dtype=np.int64)[None, :]
    x = (plane * STEP_PLANE + place * STEP_PLACE + 1) % PRIME
    y = (x * x % PRIME * FACTOR + x) % PRIME
    return np.where(y % 2 == 0, 1.0, -1.0).reshape(tables, bits, width)


def bits_for(rows, bucket=BUCKET):
    """Planes in a table so that a bucket holds about so many of all vectors."""
    return max(1, (max(1, rows) // bucket).bit_length())


class VectorIndex:
    """An index at a path: ``frame`` (table_no, bucket, message_id, vec)."""

    def __init__(self, spark, path):
        settings = spark.read.parquet(os.path.join(path, "settings")).first()
        schema = f"message_id string, vec {settings['kind']}, table_no int, bucket int"
        self.frame = spark.read.schema(schema).parquet(os.path.join(path, "buckets"))
        self.tables, self.bits, self.width = settings["tables"], settings["bits"], settings["width"]

    def probes(self, query, turned=TURNED):
        """For each table the buckets to look into: all ways to turn the bits nearest to their planes."""
        found = []
        for table in planes(self.tables, self.bits, self.width):
            sums = table @ np.asarray(query, float)
            bucket = int(((sums >= 0) << np.arange(self.bits)).sum())
            masks = [0]
            for bit in np.argsort(np.abs(sums), kind="stable")[:turned].tolist():
                masks += [mask ^ (1 << bit) for mask in masks]
            found.append([bucket ^ mask for mask in masks])
        return found

    def candidates(self, query, turned=TURNED):
        """The vectors in the probed buckets; one may come from several tables."""
        probed = [
            (F.col("table_no") == t) & F.col("bucket").isin(buckets) for t, buckets in enumerate(self.probes(query, turned))
        ]
        return self.frame.filter(reduce(lambda a, b: a | b, probed))

    def nearest(self, query, n, turned=TURNED):
        """(message_id, dist) of the n nearest among the candidates, an id once with its least distance."""
        scored = self.candidates(query, turned).select("message_id", cosine_distance(F.col("vec"), query).alias("dist"))
        once = scored.filter("dist is not null").groupBy("message_id").agg(F.min("dist").alias("dist"))
        return once.orderBy("dist", "message_id").limit(n)


def build_index(vectors, path, tables=TABLES, bits=None):
    """Write an index of all vectors (message_id, vec); null vectors are left out, zero vectors are never near."""
    spark = vectors.sparkSession
    present = vectors.filter(F.col("vec").isNotNull()).select("message_id", "vec")
    rows, least, width = present.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if least != width:
        raise ValueError(f"vectors have between {least} and {width} numbers")
    bits, width = bits or bits_for(rows), width or 1
    signs = planes(tables, bits, width).reshape(tables * bits, width)

    def run(batches):
        for batch in batches:
            matrix = np.array(batch.column("vec").to_pylist(), float).reshape(batch.num_rows, width)
            on = (matrix @ signs.T >= 0).reshape(-1, tables, bits)
            buckets = (on << np.arange(bits)).sum(axis=2)
            lists = pa.ListArray.from_arrays(
                np.arange(batch.num_rows + 1, dtype=np.int32) * tables, pa.array(buckets.ravel().astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "buckets"])

    schema = ", ".join(f"{name} {kind}" for name, kind in present.dtypes)
    placed = present.mapInArrow(run, f"{schema}, buckets array<int>").select(
        "message_id", "vec", F.posexplode("buckets").alias("table_no", "bucket")
    )
    salt = F.pmod(F.xxhash64("message_id"), F.lit(1 + rows // FILE))
    (
        placed.repartition("table_no", "bucket", salt)
        .write.mode("overwrite").partitionBy("table_no", "bucket").parquet(os.path.join(path, "buckets"))
    )
    kind = present.schema["vec"].dataType.simpleString()
    settings = spark.createDataFrame([(tables, bits, width, kind)], "tables int, bits int, width int, kind string")
    settings.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "settings"))
    return VectorIndex(spark, path)
