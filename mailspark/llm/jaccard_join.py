"""Near copies: an exact Jaccard join of shingle sets by signature trees.

Two linked sets share a shingle among the first few of each in any common order (the prefix). The
order here is by hash, with very frequent shingles last; it only decides how much work there
is. Documents that share a prefix shingle, in order of their sizes, form runs without a gap too wide
for a link; the first of a run names the bucket where they meet, once. Within a bucket a signature tree is built: every node holds the OR of its documents' token bitmaps and the
range of their sizes. Traversing the tree against itself drops a pair of nodes when the
largest possible overlap is too small, or when all their documents are connected already. This runs
first on stored bitmaps, so that texts move only where a link is possible, and again with the texts,
where what is left is compared set by set. Large buckets are split into blocks with the bucket's smallest
document in each: documents linked to it are connected, and only the others are then compared
with all blocks.

Defined results: null, empty and white texts have an empty set and are linked with nothing. A text
with fewer words than a shingle has its whole sequence of words as the only element. Equal sets are
joined before any comparison. Shingles are compared by 64-bit hashes. Rows without an id have no
component; rows that share an id count as one document. Other columns are not looked at.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailspark.llm.common import MULTIPLIER, RollingHash, mixed, rows_by_id, runs_of_rows, utf8_batch, written
from mailspark.llm.components import components

CHUNK = 1_000_000
#: Shingles in at least REPEATED documents of a batch are counted, and the MOST_FREQUENT come last.
REPEATED, MOST_FREQUENT = 3, 200_000
#: A block holds about so many shingles.
BLOCK = 2_000_000
#: Bits of the bitmaps that decide which texts are compared at all.
BITS = 2048
LEAF = 32
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(data, starts, ends, words):
    """The sorted hashes of each text's distinct shingles; texts lie in one byte array."""
    out = []
    for a, b in runs_of_rows((ends - starts).tolist(), CHUNK):
        low = int(starts[a])
        own = LOWER[data[low : int(ends[b - 1])]]
        blank = WHITE[own]
        edge = np.zeros(len(own) + 1, bool)
        edge[starts[a:b] - low] = True
        edge[ends[a:b] - low] = True
        dark = ~blank
        first = np.flatnonzero(dark & (np.concatenate(([True], blank[:-1])) | edge[:-1]))
        last = np.flatnonzero(dark & (np.concatenate((blank[1:], [True])) | edge[1:])) + 1
        hashes = RollingHash(own).of(first, last)
        bounds = np.searchsorted(first, np.append(starts[a:b], ends[b - 1]) - low)
        counts = np.diff(bounds)
        n = len(hashes)
        rolled = hashes.copy()
        for k in range(1, min(words, n)):
            rolled[: n - k] = rolled[: n - k] * np.uint64(MULTIPLIER) + hashes[k:]
        rolled = mixed(rolled)
        for i, count in enumerate(counts.tolist()):
            at = int(bounds[i])
            if count >= words:
                out.append(np.unique(rolled[at : at + count - words + 1]))
            elif count:
                whole = np.uint64(count)
                for h in hashes[at : at + count]:
                    whole = whole * np.uint64(MULTIPLIER) + h
                out.append(mixed(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def batch_sets(column, words):
    with np.errstate(over="ignore"):
        return shingle_sets(*utf8_batch(column), words)


def prefix_length(n, percent):
    return n - -(-percent * n // 100) + 1


def linked(a, b, percent):
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def bitmaps(sets, bits):
    """Bitmaps of the elements' low bits as rows of 64-bit words, and the elements beyond one for each bit."""
    maps = np.zeros((len(sets), bits), bool)
    for i, s in enumerate(sets):
        maps[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
    excess = np.array([len(s) for s in sets], np.int64) - maps.sum(axis=1)
    return np.packbits(maps, axis=1).view(np.uint64), excess


class SignatureTree:
    """A binary tree over documents of which sizes and bitmaps are known, joined with itself.

    ``component`` labels are merged by the pairs that pass ``test(i, j)``, or without a test by all
    pairs that their bitmaps and sizes allow.
    """

    def __init__(self, sizes, maps, excess, component, percent, test=None):
        self.order = order = np.lexsort((component, sizes))
        self.sizes, self.maps, self.excess = np.asarray(sizes)[order], maps[order], np.asarray(excess)[order]
        self.component = np.asarray(component)[order].copy()
        self.percent, self.test, self.nodes = percent, test, {}

    def node(self, low, high):
        """(OR of bitmaps, least size, largest size, largest excess)."""
        key = (low, high)
        if key not in self.nodes:
            if high - low <= LEAF:
                bits = np.bitwise_or.reduce(self.maps[low:high], axis=0)
            else:
                middle = (low + high) // 2
                bits = self.node(low, middle)[0] | self.node(middle, high)[0]
            sizes = self.sizes[low:high]
            self.nodes[key] = bits, int(sizes[0]), int(sizes[-1]), int(self.excess[low:high].max())
        return self.nodes[key]

    def possible(self, a, b):
        """Whether documents of two nodes can be linked, by size ranges and the largest overlap."""
        bits_a, low_a, high_a, excess_a = a
        bits_b, low_b, high_b, excess_b = b
        if 100 * high_a < self.percent * low_b or 100 * high_b < self.percent * low_a:
            return False
        # common elements lie on common bits: one for each, and at most the excess more
        overlap = int(np.bitwise_count(bits_a & bits_b).sum()) + min(excess_a, excess_b)
        return (100 + self.percent) * overlap >= self.percent * (low_a + low_b)

    def connected(self, a, b, c, d):
        first = self.component[a]
        return bool((self.component[a:b] == first).all() and (self.component[c:d] == first).all())

    def join(self):
        """Component label of each set, in the given order."""
        stack = [(0, len(self.sizes), 0, len(self.sizes))]
        while stack:
            a, b, c, d = stack.pop()
            if self.connected(a, b, c, d) or not self.possible(self.node(a, b), self.node(c, d)):
                continue
            if b - a <= LEAF and d - c <= LEAF:
                self.compare(a, b, c, d)
            elif (a, b) == (c, d):
                middle = (a + b) // 2  # the halves come first, so their cross pair is often connected
                stack += [(a, middle, middle, b), (middle, b, middle, b), (a, middle, a, middle)]
            elif b - a >= d - c:
                middle = (a + b) // 2
                stack += [(a, middle, c, d), (middle, b, c, d)]
            else:
                middle = (c + d) // 2
                stack += [(a, b, c, middle), (a, b, middle, d)]
        out = np.empty_like(self.component)
        out[self.order] = self.component
        return out

    def compare(self, a, b, c, d):
        """Test the pairs of two leaves whose own bitmaps and sizes allow a link."""
        common = np.bitwise_count(self.maps[a:b, None, :] & self.maps[None, c:d, :]).sum(axis=2, dtype=np.int64)
        common += np.minimum(self.excess[a:b, None], self.excess[None, c:d])
        total = self.sizes[a:b, None] + self.sizes[None, c:d]
        able = (100 + self.percent) * common >= self.percent * total
        able &= self.component[a:b, None] != self.component[None, c:d]
        for i, j in zip(*(at.tolist() for at in np.nonzero(able)), strict=True):
            x, y = self.component[a + i], self.component[c + j]
            if x != y and (self.test is None or self.test(self.order[a + i], self.order[c + j])):
                self.component[self.component == max(x, y)] = min(x, y)


def described(docs, words, percent):
    """(doc_id, n_shingles, digest, prefix, bits): the last two are null for all but one copy in a batch."""
    source = docs.select("doc_id", "text")

    def count(batches):
        for batch in batches:
            sets = batch_sets(batch.column(1), words)
            parts = [s[: 2 * prefix_length(len(s), percent)] for s in sets if len(s)]
            tokens, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64),) * 2
            often = n >= REPEATED
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"]
            )

    counted = source.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequent = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    last = np.sort(frequent["token"].to_numpy().view(np.uint64)) if frequent.num_rows else np.zeros(0, np.uint64)

    def prefix(own):
        late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own if len(last) else np.zeros(len(own), bool)
        return np.concatenate((own[~late], own[late]))[: prefix_length(len(own), percent)]

    def describe(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes, digests, bearer, prefixes, maps = [], [], {}, [None] * len(ids), [None] * len(ids)
            for i, own in enumerate(batch_sets(batch.column(1), words)):
                sizes.append(len(own))
                if not len(own) or ids[i] is None:
                    digests.append(None)
                    continue
                # two independent sums of scrambled elements tell sets apart
                with np.errstate(over="ignore"):
                    both = np.array([mixed(own).sum(), mixed(own ^ np.uint64(MULTIPLIER)).sum(), len(own)], np.uint64)
                digests.append(both.tobytes())
                held = bearer.get(digests[i])
                if held is None or ids[i] < ids[held]:
                    if held is not None:
                        prefixes[held] = maps[held] = None
                    bearer[digests[i]] = i
                    prefixes[i] = prefix(own).tobytes()
                    maps[i] = bitmaps([own], BITS)[0].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, prefixes, maps))],
                ["doc_id", "n_shingles", "digest", "prefix", "bits"],
            )

    return source.mapInArrow(describe, "doc_id long, n_shingles long, digest binary, prefix binary, bits binary")


def _tokens(batches):
    for batch in batches:
        ids, sizes, blobs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        counts = np.array([len(b) // 8 for b in blobs], np.int64)
        token = np.frombuffer(b"".join(blobs), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(token), pa.array(np.repeat(sizes, counts)), pa.array(np.repeat(ids, counts))], ["token", "n", "doc"]
        )


def meetings(percent):
    """(pivot, doc) for the documents of a run after its first, from rows ordered by token, size and document."""

    def run(batches):
        token, size, pivot = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, sizes, docs = (batch.column(i).to_numpy() for i in range(3))
            new = np.ones(len(docs), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])
            new[0] = token is None or tokens[0] != token or 100 * size < percent * sizes[0]
            first = np.maximum.accumulate(np.where(new, np.arange(len(docs)), -1))
            pivots = np.where(first >= 0, docs[np.maximum(first, 0)], docs[0] if pivot is None else pivot)
            token, size, pivot = tokens[-1], sizes[-1], pivots[-1]
            live = pivots != docs
            yield pa.RecordBatch.from_arrays([pa.array(pivots[live]), pa.array(docs[live])], ["pivot", "doc"])

    return run


def grouped_rows(batches, keys):
    """Tables of the rows with equal first ``keys`` columns, from rows in order of them."""
    waiting, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if waiting and key != current:
                yield pa.Table.from_batches(waiting)
                waiting = []
            current = key
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def joined_sets(sets, component, percent):
    """The component labels after an exact join of the sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    maps, excess = bitmaps(sets, 1 << max(8, min(16, int(2 * max(1, sizes.max())).bit_length())))
    test = lambda i, j: linked(sets[i], sets[j], percent)
    return SignatureTree(sizes, maps, excess, component, percent, test).join()


def possible_links(rows, percent):
    """(pivot, doc) for the documents that a bitmap allows to be linked, in parts of a bucket; from
    rows (pivot, doc, n_shingles, bits) of whole buckets."""

    def run(batches):
        for table in grouped_rows(batches, 1):
            docs, sizes = table["doc"].to_numpy(), table["n_shingles"].to_numpy()
            maps = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(docs), -1)
            excess = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
            label = SignatureTree(sizes, maps, excess, docs, percent).join()
            _, at, many = np.unique(label, return_inverse=True, return_counts=True)
            live = many[at] > 1
            yield pa.RecordBatch.from_arrays([pa.array(label[live]), pa.array(docs[live])], ["pivot", "doc"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("pivot", "doc", "n_shingles", "bits").repartition(n, "pivot").sortWithinPartitions("pivot", "doc")
    return dealt.mapInArrow(run, "pivot long, doc long").distinct()


def join_buckets(rows, texts, words, percent):
    """(pivot, doc, root) for rows (pivot, block, doc, root), all rows of a block compared.

    ``root`` comes in as a label that connected documents share and goes out merged.
    """

    def run(batches):
        for table in grouped_rows(batches, 2):
            docs = table["doc"].to_numpy()
            text = table["text"].combine_chunks()
            text = text if isinstance(text, pa.Array) else text.chunk(0)
            roots = joined_sets(batch_sets(text, words), table["root"].to_numpy(), percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table["pivot"].to_numpy()), pa.array(docs), pa.array(roots)], ["pivot", "doc", "root"]
            )

    # the hint keeps the plan the same at every size
    held = rows.join(texts.hint("merge"), "doc").select("pivot", "block", "doc", "root", "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.repartition(n, "pivot", "block").sortWithinPartitions("pivot", "block", "doc")
    return dealt.mapInArrow(run, "pivot long, doc long, root long")


def links(docs, words, percent):
    """(doc_id, n_shingles, digest, component_id) of every document."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = written(described(docs, words, percent), "sets")
    bearers = sets.filter("prefix is not null")
    tokens = bearers.select("doc_id", "n_shingles", "prefix").mapInArrow(_tokens, "token long, n long, doc long")
    ordered = tokens.repartition(n, "token").sortWithinPartitions("token", "n", "doc")
    met = written(ordered.mapInArrow(meetings(percent), "pivot long, doc long").distinct(), "met")
    both = met.union(met.select("pivot", F.col("pivot").alias("doc")).distinct())
    sizes = bearers.select(F.col("doc_id").alias("doc"), "n_shingles").dropDuplicates(["doc"])
    weights = met.join(sizes, "doc").groupBy("pivot").agg(F.sum("n_shingles").alias("weight"))
    blocks = written(weights.select("pivot", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks")), "blocks")
    texts = docs.filter("text is not null").select(F.col("doc_id").alias("doc"), "text")

    # whole buckets lose the documents that no bitmap allows a link; the pivot is in every block of a split one
    small = both.join(blocks.filter("blocks = 1"), "pivot")
    bits = bearers.select(F.col("doc_id").alias("doc"), "n_shingles", "bits")
    able = written(possible_links(small.join(bits.hint("merge"), "doc"), percent), "able")
    pivots = blocks.filter("blocks > 1").select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    others = met.join(blocks.filter("blocks > 1"), "pivot").select(
        "pivot", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), "doc"
    )
    rows = others.union(pivots.select("pivot", "block", F.col("pivot").alias("doc")))
    rows = rows.union(able.select("pivot", F.lit(-1).alias("block"), "doc"))
    first = written(join_buckets(rows.withColumn("root", F.col("doc")), texts, words, percent), "joined")
    edges = first.select("doc", "root")

    # in split buckets, those that aren't connected with the pivot meet the other blocks
    split = blocks.filter("blocks > 1")
    if not split.isEmpty():
        inside = first.join(split, "pivot").select("pivot", "blocks", "doc", "root").distinct()
        of_pivot = inside.filter("doc = pivot").select("pivot", F.col("root").alias("own")).distinct()
        apart = inside.join(of_pivot, "pivot").groupBy("pivot", "blocks", "doc").agg(
            F.min("root").alias("root"), F.max(F.col("root") == F.col("own")).alias("with_pivot")
        )
        apart = written(apart, "apart")
        loose = apart.filter("not with_pivot and doc <> pivot").join(sizes, "doc")
        chunks = loose.groupBy("pivot").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("chunks"))
        loose = loose.join(chunks, "pivot").withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit(1)), "chunks").cast("int"))
        each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        each_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        key = F.col("block").cast("long") * F.lit(1 << 31) + F.col("chunk")
        one = loose.withColumn("block", each_block).select("pivot", key.alias("block"), "doc", "root")
        other = apart.join(chunks, "pivot").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        other = other.withColumn("chunk", each_chunk).select("pivot", key.alias("block"), "doc", "root")
        again = written(join_buckets(one.union(other).distinct(), texts, words, percent), "rejoined")
        edges = edges.union(again.select("doc", "root"))

    classes = written(sets.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least")), "classes")
    equal = bearers.join(classes, "digest").select("doc_id", "least")
    found = components(edges.union(equal))
    labelled = sets.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    return labelled.join(found, F.col("least") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "least", "doc_id").alias("component_id")
    )


def representatives(docs, words, percent):
    """The documents that are the smallest of their component, with all their columns; rows without an id stay."""
    return rows_by_id(docs, links(docs, words, percent).filter("component_id <> doc_id"), "left_anti")
