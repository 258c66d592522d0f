"""Nearest neighbours by a hierarchical k-means tree and best-bin-first traversal.

The tree is fitted on a bounded sample; every row is then dealt to its leaf. A query keeps a
priority queue of nodes by their centroids' cosine, opens the best one, and so meets leaves in an
order of promise. How many leaves are visited is calibrated: for some queries the true neighbours
are found by brute force over all rows, and visits widen until the wanted share of them is
reached. In a leaf, cosines are matrix products; what may belong to the answer is scored again row by
row in double precision, so equal vectors tie exactly. Large leaves are split into blocks of rows, and the queries that
visit a leaf into parts; each block meets each part in a task of its own, so a hot leaf is spread on both sides.

Defined results: vectors that are null, zero, of another width than most, or hold null or non-finite
components take no part. Ties go to the smaller id. With fewer rows than asked for all are given.
Rows that repeat an id are candidates for others but never for their own id; blocks and parts are dealt by rows, not ids.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.llm.common import mixed, written

#: The tree is fitted on at most so many rows (those of the least id hashes).
SAMPLE = 40_000
BRANCHES, LEVELS, LEAST_LEAF, FIT_ROUNDS = 16, 2, 100, 8
#: Calibration: number of queries, and the share of their true neighbours to be reached.
CALIBRATION, WANTED = 200, 0.97
BLOCK, PART, TIE, QUERIES_AT_ONCE = 20_000, 20_000, 1e-9, 512


def usable(vectors):
    """(vec_id, embedding as doubles) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    rows = vectors.filter(x.isNotNull() & finite & F.exists(x, lambda v: v != 0)).filter("vec_id is not null")
    rows = rows.select("vec_id", x.cast("array<double>").alias("embedding"))
    width = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.filter(F.size("embedding") == (width["w"] if width else 0))


def _matrix(column):
    """An Arrow column of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(rows):
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


class Tree:
    """Nodes 0 (root), 1, ...; ``children`` of each, and the leaf number of those without any."""

    def __init__(self, sample):
        self.centroids, self.children, self.leaf = [np.zeros(sample.shape[1])], [[]], [0]
        random = np.random.default_rng(1)
        todo = [(0, _unit(sample) if len(sample) else sample, 0)]
        for node, rows, level in todo:  # grows while it is read
            if level == LEVELS or len(rows) < 2 * LEAST_LEAF:
                continue
            means, label = self._split(rows, random)
            for i, mean in enumerate(means):
                self.centroids.append(mean)
                self.children.append([])
                self.children[node].append(len(self.centroids) - 1)
                todo.append((len(self.centroids) - 1, rows[label == i], level + 1))
        self.centroids = np.array(self.centroids)
        leaves = [n for n, c in enumerate(self.children) if not c]
        self.leaf = np.full(len(self.children), -1)
        self.leaf[leaves] = np.arange(len(leaves))
        self.leaves = len(leaves)

    @staticmethod
    def _split(rows, random):
        k = min(BRANCHES, max(2, len(rows) // LEAST_LEAF))
        means = rows[random.choice(len(rows), k, replace=False)]
        for _ in range(FIT_ROUNDS):
            label = (rows @ means.T).argmax(axis=1)
            sums = np.zeros_like(means)
            np.add.at(sums, label, rows)
            size = np.sqrt((sums * sums).sum(axis=1))
            means = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], means)
        return means, (rows @ means.T).argmax(axis=1)

    def assign(self, rows):
        """The leaf of each row, by the best child at each node."""
        out, units = np.zeros(len(rows), np.int64), _unit(rows)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if not self.children[node]:
                out[own] = self.leaf[node]
                continue
            label = (units[own] @ self.centroids[self.children[node]].T).argmax(axis=1)
            todo += [(child, own[label == i]) for i, child in enumerate(self.children[node]) if (label == i).any()]
        return out

    def visits(self, near):
        """The leaves by best bin first; ``near``: cosine of the query with every centroid."""
        heap = [(-1.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                yield int(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(heap, (-near[child], child))


def best_of(queries, query_ids, rows, row_ids, k):
    """(query row, row, score) of the k nearest rows of each query, ties to the smaller id."""
    units, norms = _unit(rows), np.sqrt((rows * rows).sum(axis=1))
    for start in range(0, len(queries), QUERIES_AT_ONCE):
        part = queries[start : start + QUERIES_AT_ONCE]
        near = _unit(part) @ units.T
        near[query_ids[start : start + len(part), None] == row_ids[None, :]] = -np.inf
        least = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)]
        for i, row in enumerate(part):
            hits = np.flatnonzero((near[i] >= least[i] - TIE) & np.isfinite(near[i]))
            score = (rows[hits] * row).sum(axis=1) / (np.sqrt((row * row).sum()) * norms[hits])
            order = np.lexsort((row_ids[hits], -score))[:k]
            for j in order:
                yield start + i, hits[j], score[j]


#: What a task holds: a block of a leaf's rows and a part of the queries that visit it.
GROUP = ("leaf", "block", "part")
RESULT = T.StructType().add("query_id", "long").add("vec_id", "long").add("score", "double")


def _result(found, query_ids, row_ids):
    rows = list(found)
    q = np.array([r[0] for r in rows], np.int64)
    v = np.array([r[1] for r in rows], np.int64)
    return {"query_id": query_ids[q], "vec_id": row_ids[v], "score": np.array([r[2] for r in rows], np.float64)}


def merged(found, k):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(rows, queries, query_ids, k):
    """The exact answer for a bounded set of queries that the driver holds."""
    held = rows.sparkSession.sparkContext.broadcast((queries, query_ids))

    def run(batches):
        for batch in batches:
            asked, ids = held.value
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_pydict(_result(best_of(asked, ids, _matrix(batch.column(1)), own, k), ids, own))

    return merged(rows.select("vec_id", "embedding").mapInArrow(run, RESULT), k)


def _sample(rows, n):
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).toArrow()
    return picked["vec_id"].to_numpy(), _matrix(picked["embedding"])


def calibrated_visits(tree, rows, queries, k, wanted=WANTED):
    """The number of leaf visits that reach the wanted share of true neighbours."""
    ids, vectors = _sample(queries, CALIBRATION)
    if not len(ids) or tree.leaves == 1:
        return 1
    true = brute_force(rows, vectors, ids, k).join(rows, "vec_id").select("query_id", "embedding").toArrow()
    if not true.num_rows:
        return 1
    leaves = tree.assign(_matrix(true["embedding"]))
    near = _unit(vectors) @ tree.centroids.T
    place = {}
    for i, q in enumerate(ids.tolist()):
        place[q] = {leaf: n for n, leaf in enumerate(tree.visits(near[i]))}
    needed = sorted(place[q][leaf] + 1 for q, leaf in zip(true["query_id"].to_pylist(), leaves.tolist(), strict=True))
    return needed[min(len(needed) - 1, math.ceil(wanted * len(needed)) - 1)]


def search(vectors, is_query, k=5):
    """(query_id, rank, vec_id, score): the k nearest rows found for every query row."""
    rows = written(usable(vectors), "vectors")
    _, sample = _sample(rows, SAMPLE)
    tree = Tree(sample)
    visits = calibrated_visits(tree, rows, rows.filter(is_query), k)

    def lots(start, n):
        """Even random numbers for the rows of a task, the same at every attempt."""
        return (mixed(np.arange(start, start + n, dtype=np.uint64)) >> np.uint64(2)).astype(np.int64)

    def deal(batches):
        start = 0
        for batch in batches:
            n = batch.num_rows
            leaf = tree.assign(_matrix(batch.column(1))) if n else np.zeros(0, np.int64)
            arrays = [*batch.columns, pa.array(leaf), pa.array(lots(start, n))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "embedding", "leaf", "lot"])
            start += n

    fields = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.DoubleType())).add("leaf", "long")
    dealt = written(rows.select("vec_id", "embedding").mapInArrow(deal, fields.add("lot", "long")), "leaves")
    # a number for each leaf of the tree
    sizes = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    def visited(batch):
        """(row, leaf) of all visits of the queries of a batch."""
        near = _unit(_matrix(batch.column(1))) @ tree.centroids.T if batch.num_rows else []
        for i, row in enumerate(near):
            seen = 0
            for n, leaf in enumerate(tree.visits(row)):
                if n >= visits and seen > k:
                    break
                if leaf in sizes:
                    seen += sizes[leaf]
                    yield i, leaf

    def visits_by_leaf(batches):
        for batch in batches:
            leaves, counts = np.unique(np.array([leaf for _, leaf in visited(batch)], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(counts.astype(np.int64))], ["leaf", "n"])

    queries = rows.filter(is_query).select("vec_id", "embedding")
    met = queries.mapInArrow(visits_by_leaf, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    parts = {r["leaf"]: -(-r["n"] // PART) for r in met.collect()}

    def probe(batches):
        start = 0
        for batch in batches:
            own = lots(start, batch.num_rows)
            start += batch.num_rows
            asked = [
                (i, leaf, block, own[i] % parts[leaf]) for i, leaf in visited(batch) for block in range(-(-sizes[leaf] // BLOCK))
            ]
            at, *places = np.array(asked, np.int64).reshape(-1, 4).T
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, places)], ["vec_id", "embedding", *GROUP])

    grouped = T.StructType(fields.fields[:2] + [T.StructField(name, T.LongType()) for name in GROUP])
    asked = queries.mapInArrow(probe, grouped)
    # how each leaf that is visited is split: a row for each leaf, so it is small enough to send
    split = pa.table(
        {
            "leaf": pa.array(list(parts), pa.int64()),
            "blocks": pa.array([-(-sizes[leaf] // BLOCK) for leaf in parts], pa.int64()),
            "parts": pa.array(list(parts.values()), pa.int64()),
        }
    )
    split = rows.sparkSession.createDataFrame(split)
    spread = dealt.join(F.broadcast(split), "leaf").select(
        "vec_id",
        "embedding",
        "leaf",
        F.pmod("lot", "blocks").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
    )

    def compare(queries, candidates):
        if not queries.num_rows or not candidates.num_rows:
            return pa.table(_result([], np.zeros(0, np.int64), np.zeros(0, np.int64)))
        ids, own = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        found = best_of(_matrix(queries["embedding"]), ids, _matrix(candidates["embedding"]), own, k)
        return pa.table(_result(found, ids, own))

    pairs = asked.groupBy(*GROUP).cogroup(spread.groupBy(*GROUP))
    return merged(pairs.applyInArrow(compare, RESULT), k)
