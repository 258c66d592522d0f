"""Exact copies by a minimal perfect hash over the digests of the documents seen before.

The different digests of the history are dealt into buckets, and each bucket gets a minimal
perfect hash: levels of bit arrays in which a digest owns a bit that no other digest of the level
hit. Counting the bits before it gives its slot, and the slot holds the full digest and the winner
(the document that stays). New digests are grouped first, so however often one occurs a bucket
sees it once; a lookup compares all bytes of the digest in the slot. Members belong to the
winner's group, the others form groups of their own.

Defined results: a null text is the empty text. Texts are equal when identical after each run of
white space has become one space. Of a group the smallest id stays; rows without an id come last
and stay only where no row of the group has one. A repeated row with the same id gets the same
answer as the first. An empty table gives no rows. Other columns are not looked at.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailspark.llm.common import mixed, rows_by_id, written

WHITE_SPACE = r"[\x20\x09-\x0D]+"
BUCKET = 50_000
#: Bits of a level for each digest that is still without a slot.
ROOM = 2.0
INDEX = "bucket int, level_bits array<long>, bits binary, digests binary, winners array<long>, sizes array<long>"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def digest_rows(docs):
    """(doc_id, digest) of every document."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


def _words(digests):
    """Two 64-bit words of each digest, the input of all levels."""
    words = digests.view("<u8").reshape(len(digests), -1)
    return words[:, 0], words[:, 1]


def _places(first, second, level, bits):
    return (mixed(first + second * np.uint64(2 * level + 1)) % np.uint64(bits)).astype(np.int64)


def perfect_hash(digests):
    """(sizes of the levels, all their bits) for different digests (n x 32 bytes)."""
    first, second = _words(digests)
    sizes, levels = [], []
    while len(first):
        bits = max(8, math.ceil(len(first) * ROOM))
        at = _places(first, second, len(sizes), bits)
        owned = np.bincount(at, minlength=bits) == 1
        sizes.append(bits)
        levels.append(owned)
        left = ~owned[at]
        first, second = first[left], second[left]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots(digests, sizes, bits):
    """The slot of each digest; of one that isn't a member any slot, or -1."""
    first, second = _words(digests)
    found = np.full(len(digests), -1, np.int64)
    ranks = np.cumsum(bits) - bits
    open_ = np.arange(len(digests))
    base = 0
    for level, size in enumerate(sizes):
        at = base + _places(first[open_], second[open_], level, size)
        hit = bits[at]
        found[open_[hit]] = ranks[at[hit]]
        open_ = open_[~hit]
        base += size
    return found


def _matrix(column):
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _bucket(buckets):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def grouped(rows):
    """(digest, winner, size): equal digests counted before they are shuffled."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("size"))


def build_index(history, buckets):
    """The index over a history of (digest, winner, size), one row for each bucket."""

    def build(table):
        digests = _matrix(table["digest"])
        sizes, bits = perfect_hash(digests)
        order = np.argsort(slots(digests, sizes, bits))
        return pa.table(
            {
                "bucket": table["bucket"][:1],
                "level_bits": pa.array([sizes], pa.list_(pa.int64())),
                "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
                "digests": pa.array([digests[order].tobytes()], pa.binary()),
                "winners": pa.array([table["winner"].take(order).to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([table["size"].take(order).to_pylist()], pa.list_(pa.int64())),
            }
        )

    return history.select(_bucket(buckets), "*").groupBy("bucket").applyInArrow(build, INDEX)


def look_up(index, incoming, buckets):
    """(digest, winner, size, member) of all groups: of the history, and of incoming non-members."""

    def join(index_part, new_part):
        columns = {"digest": [], "winner": [], "size": [], "member": []}
        if index_part.num_rows:
            row = index_part.slice(0, 1).to_pylist()[0]
            total = sum(row["level_bits"])
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=total).astype(bool)
            stored = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            sizes = np.array(row["sizes"], np.int64)
        else:
            stored = np.zeros((0, 32), np.uint8)
        new = _matrix(new_part["digest"]) if new_part.num_rows else np.zeros((0, 32), np.uint8)
        member = np.zeros(len(new), bool)
        if len(stored):
            slot = slots(new, row["level_bits"], bits)
            member = (slot >= 0) & (stored[slot] == new).all(axis=1)
            np.add.at(sizes, slot[member], new_part["size"].to_numpy()[member] if len(new) else [])
            columns["digest"] += [d.tobytes() for d in stored]
            columns["winner"] += row["winners"]
            columns["size"] += sizes.tolist()
            columns["member"] += [True] * len(stored)
        rest = np.flatnonzero(~member)
        if len(rest):
            taken = new_part.take(rest)
            columns["digest"] += taken["digest"].to_pylist()
            columns["winner"] += taken["winner"].to_pylist()
            columns["size"] += taken["size"].to_pylist()
            columns["member"] += [False] * len(rest)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), kinds, strict=True)})

    new = incoming.select(_bucket(buckets), "*")
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(
        join, "digest binary, winner long, size long, member boolean"
    )


def exact_groups(history_rows, new_rows):
    """Groups of equal digests over a history and new rows of (doc_id, digest); the history wins."""
    history, incoming = written(grouped(history_rows), "history"), written(grouped(new_rows), "incoming")
    # a bucket holds at most about BUCKET digests of either side, however the ids are spread
    buckets = max(1, math.ceil(max(history.count(), incoming.count()) / BUCKET))
    index = written(build_index(history, buckets), "index")
    return look_up(index, incoming, buckets)


def dedup(docs):
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document.

    The lower half of the id range is the history, the upper half is looked up in it, so the
    history's winner has the smaller id.
    """
    rows = written(digest_rows(docs), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = (low + high) // 2 if low is not None else 0
    groups = exact_groups(
        rows.filter(F.col("doc_id") <= middle), rows.filter(F.col("doc_id").isNull() | (F.col("doc_id") > middle))
    )
    return rows.join(groups, "digest").select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
    )


def distinct_documents(docs):
    """The documents that stay, with all their columns; rows without an id can't be told apart, so all stay if one does."""
    return rows_by_id(docs, dedup(docs).filter("kept"), "left_semi")
