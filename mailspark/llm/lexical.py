"""Ranked lexical search: the highest-scoring documents of each item, by Block-Max MaxScore over shards.

Documents are indexed shard by shard: a shard is a bounded run of texts of one task, one row of a written
table, with a posting list for every term that some item asks for. Lists are cut into blocks of gaps and
counts packed in bits; in the open lie a block's last document and, for each class of counts, its shortest
document, from which the largest possible score of the block follows once the corpus is counted.

A task searches its shards one after the other and keeps a heap for each item. An item's lists are taken
in order of their global bounds. They are essential, and read in full, as long as the bounds from there on
add up to the heap's lowest score, for a document with none of the earlier terms could still get in. Beyond
that only documents already seen are looked up: one whose score, with the block's bound and the bounds of
the later lists, stays below the lowest score is rejected before the block is unpacked. The tasks' heaps are
merged in two steps, by item and salt and then by item.

Defined results: a null text has no terms, and so has one of separators only; neither counts in N. Rows that
share a doc_id are documents of their own; equal scores are ordered by doc_id, null last. Rows that share an
item_id are one item with the terms of all; an item without terms, or with terms that no document has, gives
no rows, and so does an empty table. Terms are compared by 64-bit hashes. Other columns are not looked at.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailspark.llm.common import RollingHash, runs_of_rows, utf8_batch, written

BEST = 50
#: Bytes of text handled at once, bytes of text in a shard, postings in a block.
CHUNK, SHARD, BLOCK = 1_000_000, 32_000_000, 128
#: Items are searched in turns of about so many (item, term) pairs, the most that is sent to all tasks.
PAIRS = 200_000
#: Counts of a term in a document fall into classes up to these; the last class is open.
CLASSES = (1, 2, 4)
NONE = np.iinfo(np.int64).max
#: Heaps are merged in this many parts of an item first.
SALTS = 32

#: The characters of terms are digits, letters and all beyond ASCII.
TERM = np.zeros(256, bool)
TERM[ord("0") : ord("9") + 1] = TERM[ord("A") : ord("Z") + 1] = TERM[ord("a") : ord("z") + 1] = True
TERM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def segments(data, starts, ends, most):
    """(starts, ends, rows) of stretches of texts that hold about ``most`` bytes and never cut a term."""
    if not len(starts) or (ends - starts).max() <= most:
        return starts, ends, np.arange(len(starts))
    out = []
    for row, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        while end - start > most:
            cut = start + most
            while cut < end and TERM[data[cut]]:
                cut += 1
            out.append((start, cut, row))
            start = cut
        out.append((start, end, row))
    return (np.array(c, np.int64) for c in zip(*out, strict=True))


def terms(column):
    """(hash of each term, row) of an Arrow string column, in stretches of bounded size."""
    data, starts, ends = utf8_batch(column)
    starts, ends, rows = segments(data, starts, ends, CHUNK)
    for a, b in runs_of_rows((ends - starts).tolist(), CHUNK):
        low = int(starts[a])
        own = LOWER[data[low : int(ends[b - 1])]]
        if not len(own):
            continue
        inside = TERM[own]
        edge = np.zeros(len(own) + 1, bool)
        edge[starts[a:b] - low] = True
        edge[ends[a:b] - low] = True
        first = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
        last = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
        with np.errstate(over="ignore"):
            hashes = RollingHash(own).of(first, last)
        yield hashes, rows[a:b][np.searchsorted(starts[a:b] - low, first, side="right") - 1]


def item_terms(items):
    """Distinct (item_id, term) of the items."""

    def run(batches):
        for batch in batches:
            for hashes, rows in terms(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(hashes.view(np.int64))], ["item_id", "term"]
                )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long").distinct()


# -- posting lists ----------------------------------------------------------------


def _packed(values):
    """Non-negative integers in as many bits each as the largest needs, after a byte with that number."""
    width = int(values.max()).bit_length()
    bits = (values[:, None] >> np.arange(width)) & 1
    return bytes([width]) + np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def _unpacked(data, at, n):
    """(the n integers packed at a place, the place after them)."""
    width, end = int(data[at]), at + 1 + -(-int(data[at]) * n // 8)
    bits = np.unpackbits(data[at + 1 : end], count=width * n).reshape(n, width)
    return bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)), end


def _class_of(counts):
    return np.searchsorted(CLASSES, counts)


def shard_row(ids, words, doc, term, count):
    """One shard as Arrow arrays of one row: document columns and the posting lists of (doc, term, count),
    sorted by term and doc."""
    term, doc, count = (np.asarray(c, np.int64) for c in (term, doc, count))
    lists, begin = np.unique(term, return_index=True)
    length = np.diff(np.append(begin, len(term)))
    blocks_of = -(-length // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks_of)))
    start = np.repeat(begin, blocks_of) + (np.arange(first[-1]) - np.repeat(first[:-1], blocks_of)) * BLOCK
    end = np.minimum(start + BLOCK, np.repeat(begin + length, blocks_of))
    kind, size = _class_of(count), words[doc]
    fewest = np.full((len(start), len(CLASSES) + 1), NONE)
    most = np.zeros(len(start), np.int64)
    if len(start):
        most = np.maximum.reduceat(count, start)
        for k in range(fewest.shape[1]):
            fewest[:, k] = np.minimum.reduceat(np.where(kind == k, size, NONE), start)
    peak, least = np.zeros(0, np.int64), np.full((len(CLASSES) + 1, 0), NONE)
    if len(begin):  # the same facts of whole lists
        peak = np.maximum.reduceat(count, begin)
        least = np.stack([np.minimum.reduceat(np.where(kind == k, size, NONE), begin) for k in range(len(CLASSES) + 1)])
    heads = set(begin.tolist())
    parts, at = [], [0]
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        before = -1 if a in heads else doc[a - 1]
        gaps = np.diff(doc[a:b], prepend=before) - 1
        parts.append(_packed(gaps) + _packed(count[a:b] - 1))
        at.append(at[-1] + len(parts[-1]))
    columns = {
        "doc_id": ids, "words": words, "term": lists, "length": length, "first": first, "last": doc[end - 1],
        "most": most, "fewest": fewest.ravel(), "at": at, "peak": peak,
        **{f"least{k}": own for k, own in enumerate(least)},
    }
    rows = {c: pa.ListArray.from_arrays([0, len(own)], pa.array(own, pa.int64())) for c, own in columns.items()}
    return rows | {"packed": pa.array([b"".join(parts)], pa.binary())}


_LISTS = ("words", "term", "length", "first", "last", "most", "fewest", "at")
_FACTS = ("peak", *(f"least{k}" for k in range(len(CLASSES) + 1)))
INDEX = ", ".join(
    ["n_docs long", "n_words long", *(f"{c} array<long>" for c in ("doc_id", *_LISTS, *_FACTS)), "packed binary"]
)


def index(docs, wanted):
    """The shards of all documents, with lists for the terms ``wanted`` (sorted hashes)."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        asked = held.value
        ids, words, found, n_docs, n_words, size = [], [], [], 0, 0, 0
        names = [c.split()[0] for c in INDEX.split(", ")]

        def shard():
            doc, term, count = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            # stretches of one text give counts of their own; a document without lists is not kept
            both, at = np.unique(term * len(ids) + doc, return_inverse=True)
            count = np.bincount(at, weights=count, minlength=len(both)).astype(np.int64)
            term, doc = np.divmod(both, len(ids))
            live = np.unique(doc)
            own = shard_row([ids[i] for i in live.tolist()], np.concatenate(words)[live], np.searchsorted(live, doc), term, count)
            own |= {"n_docs": pa.array([n_docs], pa.int64()), "n_words": pa.array([n_words], pa.int64())}
            return pa.RecordBatch.from_arrays([own[c] for c in names], names)

        for batch in batches:
            column, own_ids = batch.column(1), batch.column(0).to_pylist()
            n = np.zeros(len(own_ids), np.int64)
            for hashes, rows in terms(column):
                n += np.bincount(rows, minlength=len(own_ids))
                place = np.minimum(np.searchsorted(asked, hashes), len(asked) - 1)
                hit = asked[place] == hashes
                both, many = np.unique(rows[hit] * len(asked) + place[hit], return_counts=True)
                found.append((both // len(asked) + len(ids), both % len(asked), many))
            ids += own_ids
            words.append(n)
            n_docs, n_words, size = n_docs + int((n > 0).sum()), n_words + int(n.sum()), size + column.nbytes
            if size > SHARD:
                yield shard()
                ids, words, found, n_docs, n_words, size = [], [], [], 0, 0, 0
        if ids:
            yield shard()

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


# -- scores -----------------------------------------------------------------------


def weight(n_docs, df):
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(count, words, n_docs, n_words):
    """What a term found ``count`` times in a document of ``words`` terms scores for each point of its weight."""
    measure = 50 + (50 * words * n_docs) // max(1, n_words)
    return (1_000_000_000 * count) // (1000 * count + 20 * measure)


def bounds(most, fewest, n_docs, n_words):
    """The largest impact in each block, from its largest count and the shortest document of each class."""
    top = np.zeros(len(most), np.int64)
    for k in range(fewest.shape[1]):
        held = fewest[:, k] < NONE
        count = np.minimum(most, CLASSES[k]) if k < len(CLASSES) else most
        top[held] = np.maximum(top[held], impact(count[held], fewest[held, k], n_docs, n_words))
    return top


class Shard:
    """The lists of one shard, unpacked block by block where a query needs them."""

    def __init__(self, row, n_docs, n_words):
        """``row`` holds one row of the index as Arrow scalars."""
        self.ids = row["doc_id"].values
        (self.words, self.terms, self.length, self.first, self.last, self.most, fewest, self.at) = (
            row[c].values.to_numpy() for c in _LISTS
        )
        self.packed = np.frombuffer(row["packed"].as_buffer(), np.uint8)
        self.place = {t: i for i, t in enumerate(self.terms.tolist())}
        self.n_docs, self.n_words = n_docs, n_words
        self.bound = bounds(self.most, fewest.reshape(len(self.most), -1), n_docs, n_words)
        self.blocks, self.lists, self.unpacked = {}, {}, 0

    def block(self, i, b):
        """(documents, impacts) of block b, which belongs to list i."""
        if b not in self.blocks:
            before = -1 if b == self.first[i] else self.last[b - 1]
            n = int(min(BLOCK, self.length[i] - (b - self.first[i]) * BLOCK))
            gaps, at = _unpacked(self.packed, int(self.at[b]), n)
            counts, _ = _unpacked(self.packed, at, n)
            docs = np.cumsum(gaps + 1) + before
            self.blocks[b] = docs, impact(counts + 1, self.words[docs], self.n_docs, self.n_words)
            self.unpacked += 1
        return self.blocks[b]

    def whole(self, i):
        """(documents, impacts) of list i."""
        if i not in self.lists:
            parts = [self.block(i, b) for b in range(int(self.first[i]), int(self.first[i + 1]))]
            self.lists[i] = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
        return self.lists[i]

    def search(self, asked, lowest, best=BEST):
        """(documents, scores) that may be among an item's best.

        ``asked`` holds (term, weight, global bound) by falling bound, ``lowest`` is the score to reach.
        """
        score = np.zeros(len(self.ids), np.int64)
        after = np.append(np.cumsum([bound for _, _, bound in asked][::-1])[::-1], 0)
        lowest, k = max(lowest, 1), 0
        while k < len(asked) and after[k] >= lowest:  # essential lists
            term, points, _ = asked[k]
            if (i := self.place.get(term)) is not None:
                docs, impacts = self.whole(i)
                score[docs] += points * impacts
                lowest = max(lowest, _nth(score, best))
            k += 1
        docs = np.flatnonzero(score)
        for j in range(k, len(asked)):
            docs = docs[score[docs] + after[j] >= lowest]
            term, points, _ = asked[j]
            if (i := self.place.get(term)) is None or not len(docs):
                continue
            low, high = int(self.first[i]), int(self.first[i + 1])
            at = low + np.searchsorted(self.last[low:high], docs)
            there = at < high
            block = np.where(there, at, low)
            limit = score[docs] + np.where(there, points * self.bound[block], 0) + after[j + 1]
            able = limit >= lowest
            docs, there, block = docs[able], there[able], block[able]
            for b in np.unique(block[there]).tolist():
                mine = docs[there & (block == b)]
                held, impacts = self.block(i, b)
                place = np.minimum(np.searchsorted(held, mine), len(held) - 1)
                hit = held[place] == mine
                score[mine[hit]] += points * impacts[place[hit]]
            lowest = max(lowest, _nth(score[docs], best))
        docs = docs[score[docs] >= lowest]
        return docs, score[docs]


def _nth(scores, n):
    """The n-th largest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - n)[len(scores) - n]) if len(scores) >= n else 0


class Heap:
    """The best (score, document) of one item so far; equal scores by document, null last."""

    def __init__(self, best=BEST):
        self.best, self.rows = best, []

    def lowest(self):
        return self.rows[-1][0] if len(self.rows) == self.best else 0

    def add(self, scores, ids):
        new = [*self.rows, *zip(scores, ids, strict=True)]
        new.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        self.rows = new[: self.best]


def heaps(shards, asked, n_docs, n_words, best=BEST):
    """(item, doc_id, score): the best documents of every item in each task's shards."""
    held = shards.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        found = {item: Heap(best) for item in held.value}
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[r] for c in batch.schema.names}, n_docs, n_words)
                for item, lists in held.value.items():
                    docs, scores = shard.search(lists, found[item].lowest(), best)
                    if len(docs):
                        found[item].add(scores.tolist(), shard.ids.take(pa.array(docs)).to_pylist())
        rows = [(item, i, s) for item, heap in found.items() for s, i in heap.rows]
        columns = list(zip(*rows, strict=True)) if rows else ([],) * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return shards.drop("n_docs", "n_words", *_FACTS).mapInArrow(run, "item long, doc_id long, score long")


def _ranked(rows, best, *keys):
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def _turn(docs, pairs, kind, best):
    """The ranked documents of the items in ``pairs``, a bounded list of rows (item_id, term)."""
    spark = docs.sparkSession
    names = list(dict.fromkeys(r["item_id"] for r in pairs))
    wanted = np.unique(np.array([r["term"] for r in pairs], np.int64).view(np.uint64))
    shards = written(index(docs, wanted), "shards")
    n_docs, n_words = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_words")).first())
    lists = shards.select(F.inline(F.arrays_zip("term", "length", *_FACTS)))
    facts = lists.groupBy("term").agg(
        F.sum("length").alias("df"), F.max("peak").alias("peak"), *[F.min(c).alias(c) for c in _FACTS[1:]]
    ).collect()  # one row for each term asked for
    known = {}
    for r in facts:
        points = weight(n_docs, r["df"])
        top = bounds(np.array([r["peak"]]), np.array([[r[c] for c in _FACTS[1:]]]), n_docs, n_words)
        known[r["term"]] = points, points * int(top[0])
    number = {name: i for i, name in enumerate(names)}
    asked = {i: [] for i in range(len(names))}
    for r in pairs:
        term = int(np.searchsorted(wanted, np.array([r["term"]], np.int64).view(np.uint64))[0])
        if term in known:
            asked[number[r["item_id"]]].append((term, *known[term]))
    asked = {i: sorted(own, key=lambda t: (-t[2], t[0])) for i, own in asked.items() if own}
    found = heaps(shards, asked, n_docs, n_words, best).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    rows = _ranked(_ranked(found, best, "item", "salt").drop("rank"), best, "item")
    numbers = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {kind}")
    return rows.join(F.broadcast(numbers), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs, items, best=BEST, most_pairs=PAIRS):
    """(item_id, rank, doc_id, score): the ``best`` documents of every item with a score above 0."""
    spark = docs.sparkSession
    pairs = written(item_terms(items), "items")
    turns = 1 + pairs.count() // most_pairs
    turn = F.pmod(F.xxhash64("item_id"), F.lit(turns))
    kind = items.schema["item_id"].dataType.simpleString()
    rows = None
    for t in range(turns):
        own = pairs.filter(turn == t).collect()
        if own:
            found = _turn(docs, own, kind, best)
            rows = found if rows is None else rows.union(found)
    if rows is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return rows
