"""Messages read from their byte ranges in mail files.

Ranges are dealt to tasks by file and place, so a task's ranges lie close together and a file with many of
them is shared by several tasks. Each task merges neighbours into spans: ranges with only a small gap between
them come with one read, as long as the span stays small. Nothing is looked up, counted or collected while
the plan is made, and no copy of the messages is needed.

Files are opened in the tasks by pyarrow, which knows local and common remote file systems; ``opener`` can
bring another. Ranges count bytes of the uncompressed content; compressed files are read forward.
"""

from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

#: Ranges with at most GAP bytes between them are read at once, up to SPAN bytes; a longer range is read alone.
GAP, SPAN = 1 << 16, 1 << 23
#: Messages leave a task in batches of about so many bytes.
BATCH = 1 << 24
CODECS = {"gz": "gzip", "bz2": "bz2", "zst": "zstd", "lz4": "lz4"}
KEYS = ["mbox_file_id", "email_start", "email_end"]


def open_file(path):
    """(file, whether it can be read at any place) for a path or address."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        system, name = fs.LocalFileSystem(), unquote(parts.path)
    else:
        system, name = fs.FileSystem.from_uri(path)
    codec = CODECS.get(name.rsplit(".", 1)[-1])
    if codec:
        return system.open_input_stream(name, compression=codec), False
    return system.open_input_file(name), True


class Reader:
    """Reads ranges of one file after another; those of a file come in order of their starts."""

    def __init__(self, opener):
        self.opener, self.path, self.file, self.at = opener, None, None, 0

    def read(self, path, start, end):
        if path != self.path or (not self.any_place and start < self.at):
            self.close()
            self.file, self.any_place = self.opener(path)
            self.path, self.at = path, 0
        if self.any_place:
            return self.file.read_at(end - start, start)
        while self.at < start and (skipped := self.file.read(min(SPAN, start - self.at))):
            self.at += len(skipped)
        data = self.file.read(end - start)
        self.at += len(data)
        return data

    def close(self):
        if self.file is not None:
            self.file.close()


def spans(paths, starts, ends, gap=GAP, most=SPAN):
    """(first, last + 1, start, end) of runs of ranges, in order of file and start, that are read at once."""
    first, start, end = 0, None, None
    for i, (path, a, b) in enumerate(zip(paths, starts, ends, strict=True)):
        if i and (path != paths[i - 1] or a > end + gap or max(b, end) - start > most):
            yield first, i, start, end
            first, start = i, None
        start, end = (a, b) if start is None else (start, max(end, b))
    if start is not None:
        yield first, len(starts), start, end


def read_ranges(regions, opener=open_file, gap=GAP, most=SPAN):
    """Add ``raw``, the bytes at each range, to rows (path, email_start, email_end, ...).

    A range that reaches beyond the end of its file gives what is there, so do empty and backward ranges
    (nothing). Rows with a null among the three give null. Equal ranges are read once a task.
    """
    names = regions.columns
    schema = ", ".join(f"`{name}` {kind}" for name, kind in regions.dtypes)

    def run(batches):
        reader = Reader(opener)
        for batch in batches:
            paths, starts, ends = (batch.column(c).to_pylist() for c in ("path", "email_start", "email_end"))
            known = [i for i in range(len(paths)) if None not in (paths[i], starts[i], ends[i])]
            out, size, sent = [None] * len(paths), 0, 0
            plan = spans([paths[i] for i in known], [starts[i] for i in known], [max(starts[i], ends[i]) for i in known], gap, most)
            for a, b, start, end in plan:
                data = reader.read(paths[known[a]], start, end)
                for i in known[a:b]:
                    out[i] = bytes(data[starts[i] - start : max(starts[i], ends[i]) - start])
                    size += len(out[i])
                if size > BATCH:
                    upto = known[b - 1] + 1
                    yield _with_raw(batch.slice(sent, upto - sent), out[sent:upto])
                    out[sent:upto] = [None] * (upto - sent)
                    size, sent = 0, upto
            yield _with_raw(batch.slice(sent), out[sent:])
        reader.close()

    dealt = regions.repartitionByRange("path", "email_start").sortWithinPartitions("path", "email_start", "email_end")
    return dealt.select(*names).mapInArrow(run, f"{schema}, raw binary")


def _with_raw(batch, raw):
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "raw"])


def find_raw_batch(files, regions, opener=open_file):
    """The messages at many byte ranges (mbox_file_id, email_start, email_end), each once.

    ``files`` says which path has which id; of several paths with one id the first is read.
    """
    places = files.groupBy("mbox_file_id").agg(F.min("path").alias("path"))
    located = regions.select(*KEYS).distinct().join(places, "mbox_file_id")
    return read_ranges(located, opener).select("mbox_file_id", "path", "email_start", "email_end", "raw")


def find_raw(files, mbox_file_id, email_start, email_end, opener=open_file):
    """One message by its byte range."""
    one = files.filter(F.col("mbox_file_id") == mbox_file_id).select(
        "mbox_file_id", F.lit(email_start).cast("bigint").alias("email_start"), F.lit(email_end).cast("bigint").alias("email_end")
    )
    return find_raw_batch(files, one, opener)
