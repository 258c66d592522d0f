"""Connected components of an edge table by alternating large and small stars."""

from pyspark.sql import functions as F

from mailspark.llm.common import written


def _fingerprint(edges):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges):
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    )


def _small_star(edges):
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select("v", "m").union(least).toDF("u", "v").filter("u <> v").distinct()


def components(edges):
    """(id, component) of all ids in edges (u, v); the component is its smallest id."""
    edges = edges.toDF("u", "v").filter("u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (now := _fingerprint(edges)) != before:
        before = now
        edges = written(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
