"""Semantic search over message vectors.

``vectors`` is a table (message_id, vec). Query vectors are plain lists of
numbers: user input, one or a few, so they travel inside the plan.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailspark.functions.text import token_overlap, tokens
from mailspark.functions.vectors import cosine_distance, unit_rows

# Prompts put before what is embedded, defaults of the search.
QUERY_PREFIX = "task: search result | query: "
DOCUMENT_PREFIX = "title: none | text: "
VECTOR_WIDTH = 768
RESULTS = 50
MAX_DISTANCE = 0.5

# Hit lists up to this many rows are sent to all tasks of a join.
HITS_TO_BROADCAST = 10_000

# Queries that one matrix product answers.
QUERIES_AT_ONCE = 256


# -- embedding ----------------------------------------------------------------


def hashed_terms(frame, text_column, width=VECTOR_WIDTH):
    """Add ``vec``: unit-length hashed word counts, computed in the JVM."""
    words = F.filter(F.split(F.lower(text_column), r"[ \t\n\r\f]+"), lambda w: w != "")
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=width).transform(
        frame.withColumn("_words", words)
    )
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counted)
    vec = vector_to_array("_unit", "float32")
    return unit.withColumn("vec", vec).drop("_words", "_counts", "_unit")


def model_embedder(load_model):
    """An embedder from ``load_model() -> (list[str] -> list of vectors)``.

    The model is loaded once per Python worker and fed whole batches.
    """

    def embed(frame, text_column):
        @F.pandas_udf("array<float>")
        def vec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load_model()
            for texts in batches:
                yield pd.Series(list(model(texts.tolist())))

        return frame.withColumn("vec", vec(F.col(text_column)))

    return embed


def embed_documents(documents, embedder=hashed_terms):
    """Vectors of documents (message_id, text, ...), prompt put in front."""
    prompted = documents.withColumn(
        "_prompted", F.concat(F.lit(DOCUMENT_PREFIX), F.coalesce("text", F.lit("")))
    )
    return embedder(prompted, "_prompted").drop("_prompted", "text")


def embed_query(spark, text, embedder=hashed_terms):
    """The vector of one query text; None when there is nothing to search for."""
    if not text:
        return None
    prompted = spark.createDataFrame([(QUERY_PREFIX + text,)], "query string")
    return list(embedder(prompted, "query").first()["vec"])


# -- exact search -------------------------------------------------------------


def nearest(vectors, query, n=RESULTS):
    """The n messages nearest to a query vector: (message_id, dist)."""
    scored = vectors.select("message_id", cosine_distance(F.col("vec"), query).alias("dist"))
    return scored.orderBy(F.asc_nulls_last("dist"), "message_id").limit(n)


def _small(hits, n):
    return F.broadcast(hits) if n <= HITS_TO_BROADCAST else hits


def near_ids(vectors, query, n=RESULTS, max_distance=MAX_DISTANCE):
    """(message_id, dist) of the ids among the n nearest that are also near enough, each once."""
    if query is None:
        return vectors.limit(0).select("message_id", F.lit(None).cast("double").alias("dist"))
    hits = nearest(vectors, query, n).filter(F.col("dist") < max_distance)
    return hits.groupBy("message_id").agg(F.min("dist").alias("dist"))


def semantic_search(emails, vectors, query, n=RESULTS, max_distance=MAX_DISTANCE):
    """Messages among the n nearest that are also near enough, nearest first.

    The distance bound is applied to the n nearest, so fewer may come out.
    """
    if query is None:
        return emails.limit(0).select("message_id", "subject").withColumn(
            "dist", F.lit(None).cast("double")
        )
    hits = nearest(vectors, query, n).filter(F.col("dist") < max_distance)
    return (
        emails.join(_small(hits, n), "message_id")
        .select("message_id", "subject", "dist")
        .orderBy("dist", "message_id")
    )


def nearest_to_each(vectors, queries, n=RESULTS):
    """The n nearest messages for each of several queries (name -> vector), with their ranks.

    Every task keeps its n best of each query while batches go by, a block of queries at a time, so that at
    most tasks times queries times n rows are shuffled. Equal distances go by message id, vectors without a
    direction come last.
    """
    names, units = list(queries), unit_rows(list(queries.values()))

    def run(batches):
        best = [(np.zeros(0), np.zeros(0, object)) for _ in names]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            matrix = unit_rows(np.stack(batch.column(1).to_numpy(zero_copy_only=False)))
            for at in range(0, len(names), QUERIES_AT_ONCE):
                dists = 1.0 - matrix @ units[at : at + QUERIES_AT_ONCE].T
                for k, own in enumerate(dists.T, at):
                    best[k] = _least(np.append(best[k][0], own), np.append(best[k][1], ids), n)
        for name, (dist, ids) in zip(names, best, strict=True):
            found = [pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(dist, pa.float64(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(found, ["query", "message_id", "dist"])

    present = vectors.filter(F.col("vec").isNotNull()).select("message_id", "vec")
    partial = present.mapInArrow(run, "query string, message_id string, dist double")
    order = Window.partitionBy("query").orderBy(F.asc_nulls_last("dist"), "message_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _least(dists, ids, n):
    """The n least distances with their ids; NaN is larger than all numbers, equal distances go by id."""
    keys = np.where(np.isnan(dists), np.inf, dists)
    if len(keys) > n:
        live = np.flatnonzero(keys <= np.partition(keys, n - 1)[n - 1])
        dists, ids, keys = dists[live], ids[live], keys[live]
    order = sorted(range(len(keys)), key=lambda i: (keys[i], ids[i] is not None, ids[i] or ""))[:n]
    return dists[order], ids[order]


# -- reranking ----------------------------------------------------------------


def overlap_scorer(query, text_column):
    """Share of words in common: the default (query, text) scorer."""
    return token_overlap(tokens(F.lit(query)), tokens(F.col(text_column)))


def rerank(documents, hits, query, n, scorer=overlap_scorer):
    """Score the texts of retrieved messages against the query text."""
    found = documents.select("message_id", "text").join(_small(hits, n), "message_id")
    return found.withColumn("score", scorer(query, "text"))


def rerank_best(documents, hits, query, n, scorer=overlap_scorer):
    """The single best-scored retrieved document."""
    scored = rerank(documents, hits, query, n, scorer)
    return scored.orderBy(F.desc("score"), "message_id").limit(1)
