"""Mixture-controlled packing: deficit round-robin over one queue of tokens for each source.

Every queue is served in slots of ``SLOT`` tokens. In a round each queue gets as credit its target
share of a window; it is served the whole slots of its credit, and the rest stays as deficit for
the next round. After r rounds queue j has been served floor(r * share_j * slots) slots, so the
place of every slot follows from its number alone. Tasks therefore agree without talking to
each other, and deficits carry over windows and partitions alike. When a queue runs dry the
shares of the others grow (a new phase), and nothing is dropped. What doesn't fill a slot lies
behind the last round, queue by queue.

Defined results: a null text is the empty text and still has its end mark; a null source is the
queue ''. Documents of any length are cut freely. Repeated rows are packed as often as they occur.
An empty table gives no pieces. Other columns are not looked at.
"""

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailspark.llm.bpe import encoded_batches
from mailspark.llm.common import written

WINDOW, SLOT, END = 4096, 256, 2
MOST_ROUNDS = 1 << 31


class Schedule:
    """Where the slots of all queues lie. ``sizes``: tokens by queue; ``shares``: targets by queue."""

    def __init__(self, sizes, shares=None):
        self.queues = sorted(sizes)
        self.number = {q: j for j, q in enumerate(self.queues)}
        slots = [sizes[q] // SLOT for q in self.queues]
        weights = [Fraction((shares or {}).get(q, sizes[q] if shares is None else 0)) for q in self.queues]
        self.slots = np.array(slots, np.int64)
        self.phases = []  # (first slot of each queue, slots of each queue, rounds, first slot of the phase)
        left, done, base = list(slots), [0] * len(slots), 0
        while any(left):
            active = [j for j, n in enumerate(left) if n]
            if not any(weights[j] for j in active):  # sources without a target come last, as they are
                weights = [Fraction(n) for n in left]
            fed = [j for j in active if weights[j]]
            most = min(left[j] / weights[j] for j in fed)
            if shares is None:
                take = list(left)
            else:
                take = [int(most * weights[j]) if j in fed else 0 for j in range(len(left))]
            total = sum(take)
            rounds = min(MOST_ROUNDS, max(1, -(-total * SLOT // WINDOW)))
            self.phases.append((np.array(done), np.array(take), rounds, base))
            left = [a - b for a, b in zip(left, take, strict=True)]
            done = [a + b for a, b in zip(done, take, strict=True)]
            base += total
        tails = [sizes[q] % SLOT for q in self.queues]
        self.tail_starts = base * SLOT + np.concatenate(([0], np.cumsum(tails)))[:-1].astype(np.int64)

    @staticmethod
    def _served(rounds_done, slots, rounds):
        """floor(rounds_done * slots / rounds) without overflow."""
        return rounds_done * (slots // rounds) + rounds_done * (slots % rounds) // rounds

    def token_starts(self, queue, slot):
        """The place of the first token of each slot, by arrays of queue numbers and slot numbers."""
        starts = self.tail_starts[queue] if len(queue) else np.zeros(0, np.int64)
        for first, take, rounds, base in self.phases:
            here = np.flatnonzero((slot >= first[queue]) & (slot < (first + take)[queue]))
            j, m = queue[here], slot[here] - first[queue[here]]
            n = take[j]
            r = np.maximum(((m + 1) / n * rounds).astype(np.int64) - 2, 0)
            for _ in range(4):  # the estimate is at most a few rounds low
                r += self._served(r + 1, n, rounds) <= m
            place = base + m
            for i, slots in enumerate(take.tolist()):
                place += np.where(i == j, 0, self._served(r + (i < j), slots, rounds))
            starts[here] = place * SLOT
        return starts


def _pieces(schedule, queue, start, length):
    """(row, start in the row, length, place) of the pieces of rows at ``start`` in their queues."""
    first, last = start // SLOT, (start + length - 1) // SLOT
    count = last - first + 1
    row = np.repeat(np.arange(len(start)), count)
    slot = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(start[row], slot * SLOT)
    size = np.minimum((start + length)[row], (slot + 1) * SLOT) - begin
    place = schedule.token_starts(queue[row], slot) + begin - slot * SLOT
    begin -= start[row]
    over = np.maximum(place % WINDOW + size - WINDOW, 0)  # only pieces without a slot cross windows
    cut = np.flatnonzero(over)
    row, begin = np.append(row, row[cut]), np.append(begin, (begin + size - over)[cut])
    place, size = np.append(place, (place + size - over)[cut]), np.append(size - over, over[cut])
    order = np.lexsort((begin, row))
    row, begin, size, place = row[order], begin[order], size[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + size[:-1]) | (place[1:] % WINDOW == 0)
    heads = np.flatnonzero(new)
    return row[heads], begin[heads], np.add.reduceat(size, heads) if len(heads) else size, place[heads]


def tokens(docs, path):
    """(doc_id, queue, part, start, n, ids): ids as bytes, start in the task's share of the queue."""

    def run(batches):
        part, filled = TaskContext.get().partitionId(), {}
        for batch, ids in encoded_batches(batches, path):
            queues = batch.column(2).fill_null("").to_pylist()
            starts, sizes = [], []
            for queue, own in zip(queues, ids, strict=True):
                starts.append(filled.get(queue, 0))
                sizes.append(len(own) + 1)
                filled[queue] = starts[-1] + sizes[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(queues, pa.string()), pa.array([part] * len(ids), pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([own.tobytes() for own in ids], pa.binary()),
                ],
                ["doc_id", "queue", "part", "start", "n", "ids"],
            )

    schema = "doc_id long, queue string, part int, start long, n long, ids binary"
    return docs.select("doc_id", "text", "source").mapInArrow(run, schema)


def pack(docs, path, shares=None, id_type="<u2"):
    """The pieces of all documents. ``shares``: target proportion by source, as in the corpus if None.

    ``id_type``: how ids are kept between the two passes; "<u4" for vocabularies above 65,536.
    """
    stored = written(tokens(docs, path), "tokens")
    by_part = stored.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(
        by_part.select("queue", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("queue_start")),
        "offsets",
    )
    sizes = {r["queue"]: r["n"] for r in offsets.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    schedule = Schedule(sizes, shares)

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            start, n = (batch.column(i).to_numpy() for i in (2, 3))
            queue = np.array([schedule.number[q] for q in batch.column(1).to_pylist()], np.int64)
            row, begin, size, place = _pieces(schedule, queue, start, n)
            sums, at, data = [], -1, b""
            for r, b, k in zip(row.tolist(), begin.tolist(), size.tolist(), strict=True):
                if r != at:
                    at = r
                    own = np.frombuffer(batch.column(4)[r].as_py(), id_type)
                    data = memoryview(np.append(own, own.dtype.type(END)).astype("<u4").tobytes())
                sums.append(zlib.crc32(data[4 * b : 4 * (b + k)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)), pa.array(begin), pa.array(size),
                    pa.array(sums, pa.int64()), pa.array(n[row]), pa.array(place // WINDOW), pa.array(place % WINDOW),
                    batch.column(1).take(pa.array(row)),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    placed = stored.join(offsets.drop("n"), ["queue", "part"])
    return placed.select("doc_id", "queue", (F.col("start") + F.col("queue_start")).alias("start"), "n", "ids").mapInArrow(
        cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string",
    )
