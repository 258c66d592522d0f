"""Deep pages without sorting what lies before them: rows in ranges of their order, and a directory of the ranges.

The rows are written in the order of a list, in blocks of bounded size, one folder each, and every row carries its place
in its block. The directory holds for each block how many rows come before it. A page at any offset looks
up the blocks that it overlaps, at most two if a block is longer than a page; their numbers reach the scan
as a dynamic partition filter, so page 10,000 reads as much as page 1.
"""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

#: Rows in a block at most.
BLOCK = 65_536
#: Newest first, as lists of mail are; ties by id, then by place.
ORDER = ("-date", "message_id", "mbox_file_id", "email_start")
TASK_BITS, BLOCKS_OF_A_TASK = 33, 1 << 20


def _sorting(order):
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order]


class PageIndex:
    """An index at a path: ``rows`` by block and place, ``directory`` (page_block, rows_before, n)."""

    def __init__(self, spark, path, order=ORDER):
        schema = spark.read.parquet(os.path.join(path, "schema")).schema
        self.rows = spark.read.schema(schema).parquet(os.path.join(path, "rows"))
        self.directory = spark.read.schema("page_block long, rows_before long, n long").parquet(os.path.join(path, "directory"))
        self.order = order

    def page(self, limit, offset=0):
        """The rows at places offset to offset + limit of the order; none beyond the end."""
        low, high = F.lit(offset), F.lit(offset + limit)
        met = self.directory.filter((F.col("rows_before") < high) & (F.col("rows_before") + F.col("n") > low))
        # as many blocks as a page overlaps
        found = self.rows.join(F.broadcast(met.select("page_block", "rows_before")), "page_block")
        place = F.col("rows_before") + F.col("page_place")
        found = found.filter((place >= low) & (place < high)).withColumn("page_place", place)
        return found.orderBy("page_place").drop("page_block", "rows_before", "page_place")

    def count(self):
        """The number of all rows, as one row, from the directory alone."""
        return self.directory.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"))


def build_page_index(rows, path, order=ORDER, block=BLOCK):
    """Write rows in the order of a list; a name with a minus is descending, nulls come last.

    The range partitioner samples the order, so tasks get even shares even if one date holds most rows. Running totals are
    over blocks, never over rows.
    """
    spark = rows.sparkSession
    sorting = _sorting(order)
    placed = rows.repartitionByRange(*sorting).sortWithinPartitions(*sorting).withColumn("_id", F.monotonically_increasing_id())
    inside = F.col("_id").bitwiseAND((1 << TASK_BITS) - 1)
    number = F.shiftright("_id", TASK_BITS) * BLOCKS_OF_A_TASK + F.floor(inside / block).cast("long")
    placed = placed.withColumn("page_block", number).withColumn("page_place", (inside % block).cast("long")).drop("_id")
    placed.write.mode("overwrite").partitionBy("page_block").parquet(os.path.join(path, "rows"))
    # an empty table whose schema serves to open the rows, even if there are none
    spark.createDataFrame([], placed.schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "schema"))
    held = spark.read.schema(placed.schema).parquet(os.path.join(path, "rows"))
    counts = held.groupBy("page_block").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    earlier = Window.partitionBy("all").orderBy("page_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before")
    counts.select("page_block", before, "n").write.mode("overwrite").parquet(os.path.join(path, "directory"))
    return PageIndex(spark, path, order)


def page_after(rows, last, limit, order=ORDER):
    """The page that follows a row whose values of the order are given: (name without minus -> value).

    Nothing is skipped over by counting, so the list may grow between two pages.
    """
    later, equal = F.lit(False), F.lit(True)
    for name in order:
        column, descending = name.lstrip("-"), name.startswith("-")
        value = last[column]
        if value is None:  # nulls come last, nothing but ties follows
            beyond, same = F.lit(False), F.col(column).isNull()
        else:
            typed = F.lit(value).cast(rows.schema[column].dataType)
            beyond = F.col(column).isNull() | ((F.col(column) < typed) if descending else (F.col(column) > typed))
            same = F.col(column).eqNullSafe(typed)
        later |= equal & beyond
        equal &= same
    return rows.filter(later).orderBy(*_sorting(order)).limit(limit)
