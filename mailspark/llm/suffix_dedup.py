"""Repeated passages by a partitioned suffix array over sampled suffixes.

A window of 50 bytes always contains the start of an anchor: the 20 bytes with the least hash in it. Equal
windows have the same anchor at the same place, so only suffixes at anchors need sorting. Anchors
that lie in one document only can't be part of a repeat; they are found first by hash and drop out.
The others are range-partitioned by the leading bytes of their suffixes with sampled splitters.
A bucket holds the stretch of text around each anchor that covers all windows with that anchor.
Equal stretches are one entry with the smallest document and all places it has there. Where an anchor has several different
stretches their windows are sorted by multikey sort: word by word, going on only with those that are
still tied. Neighbours in that order with a smaller document give the repeats. An anchor's windows never
leave its bucket, so no match is split by a boundary, and runs that cross anchors meet again in
the document. Equal stretches are merged in each task before they are shuffled, so a passage
that is in very many documents arrives once for each batch.

Defined results: null is the empty text. Texts of less than 50 bytes lose nothing. Whole copies of a
document with a smaller id are decided by digest and don't enter the suffixes. Rows without an
id neither remove nor lose anything; rows that repeat an id must repeat its text. Other columns are
not looked at.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailspark.llm.common import RollingHash, runs_of_rows, utf8_batch, written
from mailspark.llm.jaccard_join import grouped_rows

WINDOW, ANCHOR = 50, 20
#: Bytes that are laid out at a time; longer texts are cut into pieces of so many windows.
CHUNK = 2_000_000
#: Documents from which the splitters are taken, and buckets for each shuffle partition.
SPLITTER_DOCUMENTS, BUCKETS = 500, 2


def _least(values, width):
    """Index of the leftmost least value of each stretch of ``width`` values."""
    at = np.arange(len(values), dtype=np.int64)
    reach = 1
    while reach * 2 <= width:
        n = len(at) - reach
        left, right = at[:n], at[reach:]
        at = np.where(values[left] <= values[right], left, right)
        reach *= 2
    if reach < width:
        shift = width - reach
        left, right = at[: len(at) - shift], at[shift:]
        at = np.where(values[left] <= values[right], left, right)
    return at


def pieces(starts, ends):
    """(row, start, end) of the parts of texts with at least one window, which together hold all windows."""
    for row, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        while b - a >= WINDOW:
            stop = min(b, a + CHUNK)
            yield row, a, stop
            a = stop - WINDOW + 1


def anchors(data, starts, ends):
    """(row, first window, last window, anchor, key) of the stretches of all texts in a byte array."""
    parts = list(pieces(starts, ends))
    found = []
    for i, j in runs_of_rows([b - a for _, a, b in parts], CHUNK):
        own = parts[i:j]
        row = np.array([r for r, _, _ in own], np.int64)
        low = np.array([a for _, a, _ in own], np.int64)
        high = np.array([b for _, _, b in own], np.int64)
        base = int(low.min())
        text = data[base : int(high.max())]
        hashes = RollingHash(text)
        place = np.arange(len(text) - ANCHOR + 1)
        keys = hashes.of(place, place + ANCHOR)
        least = _least(keys, WINDOW - ANCHOR + 1)
        windows = high - low - WINDOW + 1
        owner = np.repeat(np.arange(len(own)), windows)
        start = np.repeat(low - base - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        anchor = least[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        at = anchor[first]
        found.append((row[owner[first]], start[first] + base, start[last] + base, at + base, keys[at]))
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _leading(data, at):
    """The eight bytes from each place on as a number that sorts like them; anchors are longer."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + k]
    return out


def _by_bucket(bucket):
    """(bucket, rows) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(bucket[rows[0]]), rows


def candidates(docs, partitions):
    """(doc, key): the keys of the anchors of each document that another document has too."""
    buckets = partitions * BUCKETS

    def emit(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, starts, ends = utf8_batch(batch.column(1))
            row, _, _, _, key = anchors(data, starts, ends)
            if not len(row):
                continue
            order = np.lexsort((ids[row], key))
            key, doc = key[order], ids[row[order]]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            many = np.diff(np.append(heads, len(key)))
            place = np.arange(len(key)) - np.repeat(heads, many)
            sure = np.repeat(many > 1, many)  # in two documents of this batch already
            sent = place < 2  # enough to tell the others
            bucket = (key >> np.uint64(33)).astype(np.int64) % buckets
            names, number = np.unique(doc, return_inverse=True)
            kind = np.uint16 if len(names) <= 1 << 16 else np.uint32
            out = []
            for b, rows in _by_bucket(bucket):
                asked, known = rows[sent[rows]], rows[sure[rows]]
                out.append(
                    (b, key[asked].tobytes(), number[asked].astype(kind).tobytes(), key[known].tobytes(),
                     number[known].astype(kind).tobytes(), names.astype(np.int64), kind().itemsize)
                )
            for b, *blobs, names, size in out:
                # only the names that occur, with their numbers renumbered
                one, two = (np.frombuffer(blobs[i], kind) for i in (1, 3))
                used, back = np.unique(np.concatenate((one, two)), return_inverse=True)
                back = back.astype(kind)
                columns = [[b], [blobs[0]], [back[: len(one)].tobytes()], [blobs[2]], [back[len(one) :].tobytes()], [names[used].tobytes()], [size]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 5, pa.int32()], strict=True)],
                    ["bucket", "keys", "docs", "known", "known_docs", "names", "width"],
                )

    def meet(batches):
        for table in grouped_rows(batches, 1):
            keys, docs, sure_keys, sure_docs = [], [], [], []
            for r in table.to_pylist():
                kind = np.uint16 if r["width"] == 2 else np.uint32
                names = np.frombuffer(r["names"], np.int64)
                keys.append(np.frombuffer(r["keys"], np.uint64))
                docs.append(names[np.frombuffer(r["docs"], kind)])
                sure_keys.append(np.frombuffer(r["known"], np.uint64))
                sure_docs.append(names[np.frombuffer(r["known_docs"], kind)])
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            if len(key):
                many = np.diff(np.append(heads, len(key)))
                several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
                live = np.repeat(several, many)
                key, doc = key[live], doc[live]
            key, doc = np.concatenate([key, *sure_keys]), np.concatenate([doc, *sure_docs])
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
            if not len(key):
                continue
            heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            blobs = [own.tobytes() for own in np.split(key, heads[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(doc[heads]), pa.array(blobs, pa.binary())], ["doc", "keys"])

    schema = "bucket int, keys binary, docs binary, known binary, known_docs binary, names binary, width int"
    sent = docs.mapInArrow(emit, schema).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(meet, "doc long, keys binary")


def splitters(docs, buckets):
    """Leading bytes that divide the suffixes of a sample of documents evenly."""
    sample = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SPLITTER_DOCUMENTS).select("text").toArrow()
    column = sample["text"].combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.array([], pa.string())
    data, starts, ends = utf8_batch(column)
    leading = np.sort(_leading(data, anchors(data, starts, ends)[3]))
    if not len(leading):
        return leading
    return np.unique(leading[np.arange(1, buckets) * len(leading) // buckets])


def _window_repeats(text, start, doc):
    """Which windows (starts in a byte array) also occur in a smaller document, by multikey sort."""
    repeated = np.zeros(len(start), bool)
    tied, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for k in (0, 8, 16, 24, 32, 40, WINDOW - 8):
        word = _leading(text, start[tied] + k)
        order = np.lexsort((word, group))
        tied, group, word = tied[order], group[order], word[order]
        new = np.ones(len(tied), bool)
        new[1:] = (word[1:] != word[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1
        tied, group = tied[many], group[many]
        if not len(tied):
            return repeated
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.repeat(np.minimum.reduceat(doc[tied], heads), np.diff(np.append(heads, len(tied))))
    repeated[tied] = doc[tied] > least
    return repeated


def _spans_table(doc, start, end):
    """(doc, spans): per document the spans as pairs of 64-bit numbers."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    both = np.stack((start, end), axis=1).astype(np.int64)
    blobs = [own.tobytes() for own in np.split(both, heads[1:])] if len(doc) else []
    return pa.RecordBatch.from_arrays([pa.array(doc[heads], pa.int64()), pa.array(blobs, pa.binary())], ["doc", "spans"])


STRETCHES = "bucket int, texts binary, sizes binary, offsets binary, docs binary, starts binary, again binary, known binary"


def repeats(marked, cuts, partitions):
    """(doc, spans) of repeated bytes, for rows (doc_id, text, keys) with the keys shared with others."""

    def emit(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, starts, ends = utf8_batch(batch.column(1))
            row, first, last, at, key = anchors(data, starts, ends)
            live = np.zeros(len(row), bool)
            bounds = np.searchsorted(row, np.arange(len(ids) + 1))
            for i, blobs in enumerate(batch.column(2).to_pylist()):
                shared = np.frombuffer(b"".join(blobs), np.uint64)
                live[bounds[i] : bounds[i + 1]] = np.isin(key[bounds[i] : bounds[i + 1]], shared)
            row, first, last, at = row[live], first[live], last[live], at[live]
            order = np.argsort(ids[row], kind="stable")
            kept, known, again = {}, [], {}
            for i in order.tolist():
                own = data[first[i] : last[i] + WINDOW].tobytes()
                doc = int(ids[row[i]])
                held = kept.get(own)
                if held is None:
                    kept[own] = (doc, i)
                elif doc > held[0]:
                    known.append(i)
                else:
                    again.setdefault(held[1], []).append(i)
            leaders = np.array([i for _, i in kept.values()], np.int64)
            texts = list(kept)
            bucket = np.searchsorted(cuts, _leading(data, at[leaders]), side="right") if len(leaders) else leaders
            sure = _spans_table(
                ids[row[known]], first[known] - starts[row[known]], last[known] + WINDOW - starts[row[known]]
            )
            rows = []
            for b, own in _by_bucket(np.asarray(bucket, np.int64)):
                i = leaders[own]
                more = [(place, first[k] - starts[row[k]]) for place, lead in enumerate(i.tolist()) for k in again.get(lead, ())]
                rows.append(
                    (b, b"".join(texts[k] for k in own.tolist()), (last[i] - first[i] + WINDOW).astype(np.uint32).tobytes(),
                     (at[i] - first[i]).astype(np.uint8).tobytes(), ids[row[i]].astype(np.int64).tobytes(),
                     (first[i] - starts[row[i]]).astype(np.int64).tobytes(), np.array(more, np.int64).tobytes() if more else None, None)
                )
            # what is known already travels along, dealt over the buckets
            for k, (doc, spans) in enumerate(zip(*(c.to_pylist() for c in sure.columns), strict=True)):
                rows.append((k % (len(cuts) + 1), None, None, None, np.int64(doc).tobytes(), None, None, spans))
            if rows:
                kinds = [pa.int32(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["bucket", "texts", "sizes", "offsets", "docs", "starts", "again", "known"],
                )

    def sort(batches):
        for table in grouped_rows(batches, 1):
            passed, texts, sizes, offsets, docs, starts, again, n = [], [], [], [], [], [], [], 0
            for r in table.to_pylist():
                if r["texts"] is None:
                    passed.append((np.frombuffer(r["docs"], np.int64)[0], r["known"]))
                    continue
                texts.append(r["texts"])
                sizes.append(np.frombuffer(r["sizes"], np.uint32))
                offsets.append(np.frombuffer(r["offsets"], np.uint8))
                docs.append(np.frombuffer(r["docs"], np.int64))
                starts.append(np.frombuffer(r["starts"], np.int64))
                again.append(np.frombuffer(r["again"] or b"", np.int64).reshape(-1, 2) + (n, 0))
                n += len(sizes[-1])
            if passed:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in passed], pa.int64()), pa.array([s for _, s in passed], pa.binary())], ["doc", "spans"]
                )
            if texts:
                yield _sorted_bucket(b"".join(texts), *(np.concatenate(c) for c in (sizes, offsets, docs, starts, again)))

    sent = marked.mapInArrow(emit, STRETCHES).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(sort, "doc long, spans binary")


def _sorted_bucket(text, size, offset, doc, start, again):
    """(doc, spans) of a bucket of stretches; ``again`` has (stretch, start) of further places in its document."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    leader, of_anchor = {}, {}
    whole = np.zeros(len(size), bool)
    for i in np.argsort(doc, kind="stable").tolist():
        own = text[begins[i] : ends[i]]
        if own in leader:
            whole[i] = doc[i] > doc[leader[own]]
        else:
            leader[own] = i
            of_anchor.setdefault(own[offset[i] : offset[i] + ANCHOR], []).append(i)
    # windows only differ in what they repeat where an anchor has several stretches
    mixed_ones = np.array([i for rows in of_anchor.values() if len(rows) > 1 for i in rows], np.int64)
    # every place of each stretch, the places of one side by side
    of = np.concatenate((np.arange(len(size)), again[:, 0]))
    order = np.argsort(of, kind="stable")
    of, place = of[order], np.concatenate((start, again[:, 1]))[order]
    lies = whole[of]
    spans = [(doc[of[lies]], place[lies], place[lies] + size[of[lies]])]
    if len(mixed_ones):
        count = size[mixed_ones] - WINDOW + 1
        owner = np.repeat(mixed_ones, count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        again = _window_repeats(np.frombuffer(text, np.uint8), begins[owner] + step, doc[owner])
        owner, step = owner[again], step[again]
        if len(owner):
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (step[1:] != step[:-1] + 1)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(owner)) - 1
            low, many = np.searchsorted(of, owner[heads]), np.bincount(of)[owner[heads]]
            at = place[np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
            begin, end = np.repeat(step[heads], many), np.repeat(step[tails] + WINDOW, many)
            spans.append((np.repeat(doc[owner[heads]], many), at + begin, at + end))
            # copies of a leader repeat it whole, so their own spans need nothing from here
    return _spans_table(*(np.concatenate(c) for c in zip(*spans, strict=True)))


def merged_spans(blobs):
    """Sorted, disjoint (start, end) that cover the same bytes."""
    pairs = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    heads = np.flatnonzero(new)
    return np.stack((pairs[heads, 0], np.maximum.reduceat(pairs[:, 1], heads)), axis=1)


def _result(batches):
    for batch in batches:
        copy = batch.column(3).to_pylist()
        sizes, removed, counts, sums = [], [], [], []
        for i, (text, blobs) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            data = (text or "").encode("utf-8", "surrogatepass")
            spans = merged_spans(blobs or [])
            if copy[i] and len(data) >= WINDOW:
                spans = np.array([[0, len(data)]])
            kept, at = [], 0
            for a, b in spans.tolist():
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            sizes.append(len(data))
            counts.append(len(spans))
            removed.append(int((spans[:, 1] - spans[:, 0]).sum()) if len(spans) else 0)
            sums.append(hashlib.sha256(b"".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)), pa.array(sums, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(docs):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digests = written(
        docs.filter("doc_id is not null").select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")),
        "digests",
    )
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    copies = written(
        digests.join(least, "digest").filter("doc_id > least").select(F.col("doc_id").alias("doc"), F.lit(True).alias("copy")).distinct(),
        "copies",
    )
    cuts = splitters(docs.filter("doc_id is not null").select("doc_id", "text"), n * BUCKETS)
    # one exchange, read three times; rows without an id stay out of it
    held = docs.filter("doc_id is not null").select("doc_id", "text").repartition(n, "doc_id")
    # an anti join would be moved below the exchange, which then couldn't be used again
    single = held.join(copies, F.col("doc_id") == F.col("doc"), "left").filter("copy is null").select("doc_id", "text")
    keys = candidates(single, n).groupBy("doc").agg(F.collect_list("keys").alias("keys"))
    marked = held.join(keys, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "keys")
    spans = repeats(marked, cuts, n).groupBy("doc").agg(F.collect_list("spans").alias("spans"))
    found = held.join(spans, F.col("doc_id") == F.col("doc"), "left").drop("doc")
    found = found.join(copies, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans", "copy")
    nameless = docs.filter("doc_id is null").select(
        "doc_id", "text", F.lit(None).cast("array<binary>").alias("spans"), F.lit(None).cast("boolean").alias("copy")
    )
    return found.union(nameless).mapInArrow(
        _result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
