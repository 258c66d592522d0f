"""Messages read from byte ranges of mail files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from mailspark.plans.ingest import indexed_archive
from mailspark.sources import mbox, ranges


def content_of(seed, size):
    return bytes(random.Random(seed).randbytes(size))


def read(spark, rows, **options):
    frame = spark.createDataFrame(rows, "path string, email_start long, email_end long, mark int")
    found = ranges.read_ranges(frame, **options)
    assert found.columns == [*frame.columns, "raw"]
    return sorted((r["mark"], None if r["raw"] is None else bytes(r["raw"])) for r in found.collect())


@pytest.mark.parametrize("gap, most", [(0, 1), (7, 100), (1 << 16, 1 << 23)])
@pytest.mark.parametrize("packed", [False, True])
def test_any_ranges_are_read_back(spark, tmp_path, gap, most, packed):
    rng, contents, rows = random.Random(gap), {}, []
    for n in range(3):
        path = str(tmp_path / (f"mail {n}%.mbox" + ".gz" * packed))
        contents[path] = content_of(n, 2000)
        with (gzip.open if packed else open)(path, "wb") as file:
            file.write(contents[path])
    for mark in range(120):
        path = rng.choice(list(contents))
        start = rng.randrange(2000)
        rows.append((path, start, start + rng.choice([0, 1, 30, 700]), mark))
    rows += [(*rows[0][:3], 500), (rows[1][0], 1990, 5000, 501), (rows[1][0], 9000, 9001, 502), (rows[1][0], 50, 20, 503)]
    wanted = [(mark, contents[path][start:end]) for path, start, end, mark in rows]
    assert read(spark, rows, gap=gap, most=most) == sorted(wanted)


def test_rows_without_a_range_and_no_rows(spark, tmp_path):
    (tmp_path / "mail").write_bytes(b"From a")
    path = f"file://{tmp_path}/mail"
    assert read(spark, [(None, 0, 1, 1), (path, None, 1, 2), (path, 0, None, 3), (path, 1, 4, 4)]) == [
        (1, None), (2, None), (3, None), (4, b"rom"),
    ]
    assert read(spark, []) == []


def test_neighbours_are_read_at_once():
    paths = ["a", "a", "a", "a", "b"]
    starts, ends = [0, 10, 100, 180, 0], [10, 90, 110, 300, 5]
    assert list(ranges.spans(paths, starts, ends, 10, 150)) == [(0, 3, 0, 110), (3, 4, 180, 300), (4, 5, 0, 5)]
    assert list(ranges.spans(paths, starts, ends, 0, 50)) == [
        (0, 1, 0, 10), (1, 2, 10, 90), (2, 3, 100, 110), (3, 4, 180, 300), (4, 5, 0, 5),
    ]
    assert list(ranges.spans([], [], [])) == []


def test_few_reads_for_many_neighbours(spark, tmp_path):
    (tmp_path / "mail").write_bytes(content_of(1, 50_000))
    log = tmp_path / "log"

    def counting(path):
        file, any_place = ranges.open_file(path)

        class Counted:
            def read_at(self, size, start):
                with open(log, "a") as out:
                    out.write(f"{start} {size}\n")
                return file.read_at(size, start)

            def close(self):
                file.close()

        return Counted(), any_place

    rows = [(str(tmp_path / "mail"), i * 100, i * 100 + 90, i) for i in range(500)]
    found = read(spark, rows, opener=counting)
    assert len(found) == 500 and all(len(raw) == 90 for _, raw in found)
    assert len(log.read_text().splitlines()) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_messages_by_the_extents_of_a_scan(spark, tmp_path):
    content = b"".join(b"From x\nMessage-ID: <%d>\n\nbody %d\n" % (n, n) for n in range(40))
    (tmp_path / "mail").mkdir()
    for name in ("a", "b"):
        (tmp_path / "mail" / name).write_bytes(content)  # equal files have one id
    records, index, count = indexed_archive(spark, str(tmp_path / "mail"))
    raw = mbox.raw_messages(records, index, count)
    regions = raw.filter(F.col("email_start") > 300).select("mbox_file_id", "email_start", "email_end")
    found = ranges.find_raw_batch(index, regions.union(regions))
    wanted = {(r["email_start"], r["email_end"], bytes(r["raw"])) for r in raw.filter("email_start > 300").collect()}
    rows = [(r["email_start"], r["email_end"], bytes(r["raw"])) for r in found.collect()]
    assert sorted(rows) == sorted(wanted)
    start, end, message = sorted(wanted)[3]
    file_id = index.first()["mbox_file_id"]
    assert bytes(ranges.find_raw(index, file_id, start, end).first()["raw"]) == message
    assert ranges.find_raw(index, "other", start, end).count() == 0
    assert ranges.find_raw_batch(index, regions.limit(0)).count() == 0


def test_planning_starts_no_job(spark, tmp_path):
    (tmp_path / "mail").write_bytes(b"From x\n\nhello\n")
    files = spark.createDataFrame([("f", str(tmp_path / "mail"))], "mbox_file_id string, path string")
    regions = spark.createDataFrame([("f", 0, 14)], "mbox_file_id string, email_start long, email_end long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    found = ranges.find_raw_batch(files, regions)
    assert len(tracker.getJobIdsForGroup("planning")) == 0
    assert bytes(found.first()["raw"]) == b"From x\n\nhello\n"
    spark.sparkContext.setJobGroup("rest", "rest")
