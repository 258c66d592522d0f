"""Shards by balanced label propagation: linked documents move to their neighbours' shards.

The law is `rows`: the rows are numbered, and the number deals them evenly, so counts are at most one
apart. From then on every round moves as many rows into a shard as out of it, which keeps the law.
A hub stands for a set of linked rows (a link between two documents is a hub of two), so no pair
within a group is ever made. Each round every hub takes the shard that most of its rows are in, ties by a
hash that changes with the round, and its other rows ask for that shard. How many ask from which shard for
which is a small matrix; from it follow quotas that balance over chains and cycles of any length, rows
without links making up the difference where there are some. The rows granted are those of the largest gain
by number within (from, to, lane); lanes hold a bounded number of rows, so no shard is gathered in
one task. Rounds end when nothing can be granted, or less than one row in FEWEST.

A group of equal texts is split only if it is larger than most of a shard. Every move brings a row to a shard
with at least as many of its hub as the one it leaves, so the share of cut links only falls.

Defined results: a null text has no bytes (size 8) and equals the empty text. Repeated rows count as
rows of their own. With fewer rows than shards some shards are empty; an empty table gives no
rows. Other columns are not looked at.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailspark.llm.common import gapless_rank, written

SHARDS = 24
#: A round that grants less than one move for so many rows is the last.
FEWEST = 20_000
#: A hub fills at most this part of a shard; a lane has at most so many rows.
PART_OF_QUOTA, LANE, BUCKET = 0.9, 200_000, 100_000
#: A group of equal texts is looked up in at least so many parts.
SALTS = 64
LAW = "rows"


def numbered(docs):
    """(doc_id, size, text_crc32, digest, row): row numbers without gaps, in no order that matters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    ).withColumn("_all", F.lit(0))
    rows = written(rows, "rows")
    total = rows.count()
    put = gapless_rank(rows, "_all", ["doc_id", "digest"], "row", 1 + total // BUCKET)
    return written(put.drop("_all"), "numbered"), total


def equal_text_links(rows, total, shards):
    """(row, hub) for rows whose text occurs again.

    Rows meet the size of their group by digest and salt, so a large group lies in as many tasks as salts.
    """
    most = max(2, int(total / shards * PART_OF_QUOTA))
    salted = rows.select("row", "digest", F.pmod(F.xxhash64("row"), F.lit(SALTS + total // LANE)).alias("salt"))
    held = salted.groupBy("digest", "salt").agg(F.count("*").alias("here"))
    groups = held.groupBy("digest").agg(F.sum("here").alias("n")).filter("n > 1")
    sizes = held.join(groups, "digest").select("digest", "salt", "n")
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.ceil(F.col("n") / most).cast("int"))
    return salted.join(sizes, ["digest", "salt"]).select("row", F.xxhash64("digest", part).alias("hub"))


def quotas(asked, free):
    """(moves granted, moves of rows without links), both by (from, to), that leave every shard's size as it is.

    ``asked`` counts requests by (from, to), ``free`` the rows without links of each shard. All requests are
    granted at first; a shard that would get more than it gives, beyond its free rows, gets less, until none is left.
    """
    granted = asked.copy()
    while True:
        net = granted.sum(axis=0) - granted.sum(axis=1)
        over = net - free
        to = int(over.argmax())
        if over[to] <= 0:
            break
        for among in (np.maximum(-net, 0), granted[:, to]):  # first from those that would give too much
            cut = np.minimum(granted[:, to], among)
            room = np.minimum(np.cumsum(cut), over[to])
            granted[:, to] -= np.diff(room, prepend=0)
            over[to] -= room[-1]
    net = granted.sum(axis=0) - granted.sum(axis=1)
    filled = np.zeros_like(granted)
    for a in np.flatnonzero(net > 0):
        for b in np.flatnonzero(net < 0):
            n = min(net[a], -net[b])
            filled[a, b] += n
            net[a] -= n
            net[b] += n
    return granted, filled


def _matrix(counts, shards):
    out = np.zeros((shards, shards), np.int64)
    for row in counts.collect():  # shards times shards at most
        out[row["shard"], row["to"]] = row["n"]
    return out


def _first(rows, keys, quota):
    """The rows of each key whose number is under the key's ``quota``, with that number as ``k``.

    Lanes are numbered one after the other, and only lanes that can hold such rows are sorted.
    """
    lanes = rows.groupBy(*keys, "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = lanes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    open_lanes = starts.join(F.broadcast(quota), keys).filter("start < quota")
    order = Window.partitionBy(*keys, "lane").orderBy(F.desc("gain"), "row")
    numbered_rows = rows.join(open_lanes, [*keys, "lane"]).withColumn("k", F.col("start") + F.row_number().over(order) - 1)
    return numbered_rows.filter("k < quota")


def propagate(state, links, total, shards, fewest=FEWEST):
    """(row, shard, linked) after the rounds; ``state`` (row, shard), ``links`` (row, hub)."""
    spark = state.sparkSession
    lanes = 1 + total // LANE
    linked = links.select("row").distinct().withColumn("linked", F.lit(True))
    state = state.join(linked, "row", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    state = written(state.withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int")), "shards")
    free = np.zeros(shards, np.int64)
    for row in state.filter("not linked").groupBy("shard").count().collect():
        free[row["shard"]] = row["count"]
    turn = 0
    while True:
        turn += 1
        held = links.join(state.filter("linked"), "row").groupBy("hub", "shard").agg(F.count("*").alias("n"))
        by_hash = F.xxhash64("hub", "shard", F.lit(turn)).alias("by_hash")
        best = held.groupBy("hub").agg(F.max(F.struct("n", by_hash, "shard")).alias("best"))
        wishes = (
            links.join(best, "hub")
            .groupBy("row", F.col("best.shard").alias("to"))
            .agg(F.sum("best.n").alias("gain"))
            .groupBy("row")
            .agg(F.max(F.struct("gain", "to")).alias("wish"))
            .select("row", "wish.gain", "wish.to")
        )
        asked = written(state.join(wishes, "row").filter("shard <> to").select("row", "lane", "shard", "to", "gain"), "asked")
        granted, filled = quotas(_matrix(asked.groupBy("shard", "to").agg(F.count("*").alias("n")), shards), free)
        if granted.sum() <= total // fewest:
            return state
        grants = [(int(a), int(b), int(granted[a, b])) for a, b in np.argwhere(granted)]
        moves = _first(asked, ["shard", "to"], spark.createDataFrame(grants, "shard int, to int, quota long")).select("row", "to")
        if filled.any():
            ends = np.cumsum(filled, axis=1)
            ranges = [(int(a), int(b), int(ends[a, b] - filled[a, b]), int(ends[a, b])) for a, b in np.argwhere(filled)]
            ranges = spark.createDataFrame(ranges, "shard int, to int, low long, high long")
            give = spark.createDataFrame([(int(a), int(ends[a, -1])) for a in np.flatnonzero(ends[:, -1])], "shard int, quota long")
            idle = state.filter("not linked").select("row", "lane", "shard", F.lit(0).alias("gain"))
            out = _first(idle, ["shard"], give).join(F.broadcast(ranges), "shard").filter("k >= low and k < high")
            moves = moves.union(out.select("row", "to"))
        state = written(
            state.join(moves, "row", "left").select("row", F.coalesce("to", "shard").alias("shard"), "linked", "lane"),
            "shards",
        )
        free += filled.sum(axis=0) - filled.sum(axis=1)


def kept_together(state, links):
    """(hubs, whole, rows, cut): how many hubs there are and lie in one shard, how many rows they have, and
    how many of these aren't where most of their hub is."""
    held = links.join(state, "row").groupBy("hub", "shard").agg(F.count("*").alias("n"))
    hubs = held.groupBy("hub").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return hubs.agg(
        F.count("*").alias("hubs"), F.count_if(F.col("n") == F.col("most")).alias("whole"),
        F.sum("n").alias("rows"), F.sum(F.col("n") - F.col("most")).alias("cut"),
    )


def shard(docs, shards=SHARDS):
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    rows, total = numbered(docs)
    links = written(equal_text_links(rows, total, shards), "links")
    start = rows.select("row", F.pmod("row", F.lit(shards)).cast("int").alias("shard"))
    ended = propagate(start, links, total, shards).select("row", "shard")
    placed = gapless_rank(ended, "shard", ["row"], "slot", 1 + total // (shards * BUCKET))
    return rows.join(placed.select("row", "shard", "slot"), "row").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
