import gzip
import hashlib
import os
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from mailspark.plans.ingest import indexed_archive, read_archive
from mailspark.sources import mbox


def line_scan(content):
    """Extents by going through the lines one after the other."""
    starts, at = [0], 0
    for number, line in enumerate(content.splitlines(keepends=True)):
        if number and line.startswith(b"From "):
            starts.append(at)
        at += len(line)
    return [(s, e, content[s:e]) for s, e in zip(starts, starts[1:] + [at])]


def expected_id(content):
    """The file id, computed message by message."""
    messages, sums = line_scan(content), [0, 0, 0]
    for start, end, message in messages:
        value = message[5 if start else 0 : -1 if end < len(content) else None]
        mark = hashlib.sha256(f"{start}:{hashlib.sha256(value).hexdigest()}".encode()).hexdigest()
        sums = [total + int(mark[at : at + 15], 16) for total, at in zip(sums, (0, 15, 30))]
    return hashlib.sha256(":".join(map(str, (len(content), len(messages), *sums))).encode()).hexdigest()


def save(folder, name, content):
    path = folder / name
    path.write_bytes(content)
    return str(path)


def random_archive(seed, messages, newline_at_end):
    rng = random.Random(seed)
    lines = []
    for number in range(messages):
        lines.append(b"From someone@example.com Mon Jan 01 00:00:00 2024")
        lines.append(b"Subject: %d" % number)
        lines.append(b"")
        for _ in range(rng.randint(0, 12)):
            lines.append(rng.choice([b"", b">From here", b"text From there", b"\xff\xfe\x00", b"x" * 300]))
    content = b"\n".join(lines)
    return content + (b"\n" if newline_at_end else b"")


def extents(spark, path):
    rows = read_archive(spark, path).select("email_start", "email_end", "raw").collect()
    return sorted((r["email_start"], r["email_end"], bytes(r["raw"])) for r in rows)


@pytest.mark.parametrize("newline_at_end", [True, False])
@pytest.mark.parametrize("size", [512, 4096, 128 * 1024 * 1024])
def test_extents_equal_a_line_scan_at_any_split_size(spark, splits_of, tmp_path, size, newline_at_end):
    splits_of(size)
    content = random_archive(size, 60, newline_at_end)
    path = save(tmp_path, "a.mbox", content)
    assert extents(spark, path) == line_scan(content)


def test_message_longer_than_several_splits(spark, splits_of, tmp_path):
    splits_of(256)
    content = b"From a\n" + b"y" * 5000 + b"\nFrom b\nlast\n"
    assert extents(spark, save(tmp_path, "a.mbox", content)) == line_scan(content)


def test_several_files_are_kept_apart(spark, tmp_path):
    contents = [random_archive(n, 5 + n, n % 2 == 0) for n in range(4)]
    for n, content in enumerate(contents):
        save(tmp_path, f"{n}.mbox", content)
    rows = read_archive(spark, str(tmp_path)).collect()
    for n, content in enumerate(contents):
        own = [r for r in rows if r["path"].endswith(f"/{n}.mbox")]
        assert sorted((r["email_start"], r["email_end"], bytes(r["raw"])) for r in own) == line_scan(content)
        assert {r["mbox_file_id"] for r in own} == {expected_id(content)}


def test_mark_inside_a_body_starts_a_message(spark, tmp_path):
    content = b"From a\nSubject: s\n\nhello\nFrom the start\nmore\n"
    assert [e[:2] for e in extents(spark, save(tmp_path, "a", content))] == [(0, 25), (25, 45)]


def test_gzip_archive_counts_uncompressed_bytes(spark, tmp_path):
    import gzip

    content = random_archive(3, 20, True)
    path = save(tmp_path, "a.mbox.gz", gzip.compress(content))
    assert extents(spark, path) == line_scan(content)


def test_files_that_are_not_mbox_are_reported_and_left_out(spark, tmp_path):
    save(tmp_path, "good", b"From a\n\nx\n")
    save(tmp_path, "bad", b"Subject: a\n\nx\nFrom b\n\ny\n")
    save(tmp_path, "empty", b"")
    index = mbox.split_index(mbox.scan(spark, str(tmp_path)))
    reported = mbox.invalid_files(spark, str(tmp_path), index).collect()
    assert sorted(os.path.basename(r["path"]) for r in reported) == ["bad"]
    assert {os.path.basename(r["path"]) for r in read_archive(spark, str(tmp_path)).collect()} == {"good"}


def test_archive_without_messages(spark, tmp_path):
    save(tmp_path, "empty", b"")
    assert read_archive(spark, str(tmp_path)).count() == 0


def test_a_split_missing_from_the_index_is_an_error(spark, splits_of, tmp_path):
    splits_of(512)
    path = save(tmp_path, "a.mbox", random_archive(1, 40, True))
    records, index, count = indexed_archive(spark, path)
    partial = index.filter(F.col("split_start") == 0)
    with pytest.raises(SparkRuntimeException, match="split differently"):
        mbox.raw_messages(records, partial, count).collect()


def test_join_beyond_the_broadcast_bound_gives_the_same(spark, splits_of, tmp_path):
    splits_of(512)
    path = save(tmp_path, "a.mbox", random_archive(2, 40, True))
    records, index, count = indexed_archive(spark, path)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beyond = mbox.raw_messages(records, index, mbox.SPLITS_TO_BROADCAST + 1)
        plan = beyond._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        small = mbox.raw_messages(records, index, count)
        assert sorted(map(str, beyond.collect())) == sorted(map(str, small.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_file_id_depends_on_content_only(spark, splits_of, tmp_path):
    content = random_archive(5, 30, True)
    path = save(tmp_path, "a.mbox", content)
    packed = save(tmp_path, "c.mbox.gz", gzip.compress(content))
    changed = save(tmp_path, "b.mbox", content.replace(b"Subject: 7\n", b"Subject: 8\n"))

    def file_id(p):
        return [r["mbox_file_id"] for r in mbox.fingerprints(mbox.scan(spark, p)).collect()]

    splits_of(512)
    first = file_id(path)
    assert len(first) == 1 and len(first[0]) == 64
    assert file_id(packed) == first
    splits_of(128 * 1024 * 1024)
    assert file_id(path) == first
    assert file_id(changed) != first


def test_equal_files_are_both_read(spark, tmp_path):
    content = random_archive(6, 8, True)
    save(tmp_path, "a", content), save(tmp_path, "b", content)
    raw = read_archive(spark, str(tmp_path))
    assert raw.count() == 16 and raw.select("mbox_file_id").distinct().count() == 1
