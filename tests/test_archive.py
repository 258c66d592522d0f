"""Threads, statistics, dates and message views on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mail_rows import ids
from mailspark import schemas
from mailspark.functions.dates import header_timestamp
from mailspark.functions.text import sender_domain
from mailspark.operators import stats, threads
from mailspark.plans import message_view, reports


def test_thread_members_oldest_first(emails_of):
    emails = emails_of(
        {"message_id": "new", "date": dt.datetime(2024, 5, 1)},
        {"message_id": "undated", "date": None},
        {"message_id": "old", "date": dt.datetime(2023, 5, 1)},
        {"message_id": "other", "thread_id": "tour"},
    )
    assert ids(threads.thread_members(emails, "rehearsal")) == ["old", "new", "undated"]
    assert ids(threads.thread_members(emails, "missing")) == []


def test_no_thread_id_is_no_thread(emails_of):
    emails = emails_of(
        {"message_id": "a", "thread_id": ""}, {"message_id": "b", "thread_id": ""},
        {"message_id": "c", "thread_id": None}, {"message_id": "d"},
    )
    assert ids(threads.thread_of_message(emails, "a")) == []
    assert ids(threads.thread_of_message(emails, "c")) == []
    assert ids(threads.thread_members(emails, "")) == []
    assert [tuple(r) for r in threads.thread_sizes(emails).collect()] == [("rehearsal", 1)]


def test_members_of_a_big_thread_come_once(spark, emails_of):
    emails = emails_of(*[{"message_id": f"m{n}", "thread_id": "t"} for n in range(30)], {"message_id": "x"})
    asked = spark.createDataFrame([(f"m{n}",) for n in range(20)], "message_id string")
    assert sorted(ids(threads.threads_of_messages(emails, asked))) == sorted(f"m{n}" for n in range(30))
    assert threads.thread_of_message(emails, "m3").count() == 30


def test_summary(sample):
    row = stats.summary(sample).first()
    assert (row["all_emails"], row["avg_size"]) == (3, 100.0)
    assert (row["first_seen"], row["last_seen"]) == (dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 2, 3, 14))
    assert row["days_timespan"] == 33 / 365
    empty = stats.summary(sample.limit(0)).first()
    assert (empty["all_emails"], empty["avg_size"], empty["days_timespan"]) == (0, None, 0.0)
    assert stats.summary(sample, approximate=True).first()["all_emails"] == 3


def test_span_counts_whole_days(emails_of):
    emails = emails_of({"date": dt.datetime(2024, 1, 1, 23)}, {"date": dt.datetime(2024, 1, 3, 1)})
    assert stats.summary(emails).first()["days_timespan"] == 1 / 365


def test_monthly_sizes_add_up_with_undated_last(emails_of):
    emails = emails_of(
        {"date": dt.datetime(2024, 2, 1), "email_end": 10},
        {"date": None, "email_end": 5},
        {"date": dt.datetime(2024, 1, 31), "email_end": 1},
        {"date": dt.datetime(2024, 2, 29), "email_end": 2},
    )
    rows = {r["date"]: r["count"] for r in stats.monthly_cumulative(emails).collect()}
    assert rows == {dt.datetime(2024, 1, 1): 1, dt.datetime(2024, 2, 1): 13, None: 18}


def test_domains(emails_of):
    emails = emails_of(
        {"from_email": "A <a@x.org>"}, {"from_email": "b@x.org"}, {"from_email": "nobody"},
        {"from_email": None},
    )
    assert [tuple(r) for r in stats.top_domains(emails).collect()] == [("@x.org", 2), ("", 1)]
    bare = emails.select(sender_domain(F.col("from_email"), keep_at=False).alias("d")).distinct()
    assert {r["d"] for r in bare.collect()} == {"x.org", "", None}


def test_top_subjects(emails_of):
    emails = emails_of(
        {"subject": "a", "has_attachment": 2}, {"subject": "a"}, {"subject": None}, {"subject": "b"}
    )
    rows = [tuple(r) for r in stats.top_subjects(emails).collect()]
    assert rows == [("a", 1, 2), ("b", 0, 1), (None, 0, 1)]


def test_reports(sample):
    sizes = reports.time_series(sample, "dates_size").collect()
    assert [(r["dummy"], r["date"], r["count"]) for r in sizes] == [(1, "2024-01-01", 264), (1, "2024-02-01", 300)]
    assert reports.time_series(sample, "domains_count").count() == 2
    unknown = reports.time_series(sample, "nothing")
    assert unknown.columns == ["date", "count"] and unknown.count() == 0


DATES = {
    "Mon, 01 Jan 2024 12:00:00 +0000": dt.datetime(2024, 1, 1, 12),
    "1 Jan 2024 12:00:00 +0200 (EET)": dt.datetime(2024, 1, 1, 10),
    "Mon, 1 Jan 2024 12:00 -0130": dt.datetime(2024, 1, 1, 13, 30),
    "Mon, 1 Jan 2024 12:00:00 GMT": dt.datetime(2024, 1, 1, 12),
    "Mon, 1 Jan 2024 12:00:00 EST": dt.datetime(2024, 1, 1, 17),
    "Mon Jan  1 12:00:00 2024": dt.datetime(2024, 1, 1, 12),
    "31 Feb 2024 12:00:00 +0000": None,
    "some day": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_header_dates_whatever_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(d,) for d in DATES], "d string")
        rows = frame.select("d", header_timestamp(F.col("d")).alias("t")).collect()
        assert {r["d"]: r["t"] for r in rows} == DATES
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture
def files(spark, tmp_path):
    """A mail file with the first two messages of the sample at their places."""
    places = [(b"<1@x>", 0, 64), (b"<2@x>", 64, 264)]
    content = b""
    for name, start, end in places:
        message = b"From x\nMessage-ID: %s\n\nbody of %s" % (name, name)
        content += message + b"." * (end - start - len(message) - 1) + b"\n"
    (tmp_path / "mail").write_bytes(content)
    return spark.createDataFrame([("f", str(tmp_path / "mail"))], "mbox_file_id string, path string")


def body_of(row):
    return row["parsed_body"].rstrip(".\n")


def test_message_detail(sample, files):
    seen = message_view.message_detail(sample.filter("message_id <> '<3@x>'"), files, "<2@x>")
    row = seen.message.first()
    assert body_of(row) == "body of <2@x>" and row["attachments"] == []
    assert seen.attachments.count() == 0 and ids(seen.thread) == ["<2@x>"]
    assert message_view.message_detail(sample, files, "missing").message.count() == 0


def test_thread_keeps_rows_without_content(sample, files):
    elsewhere = sample.withColumn("mbox_file_id", F.when(F.col("message_id") == "<3@x>", "gone").otherwise("f"))
    (row,) = message_view.thread_with_content(elsewhere, files, "scores").collect()
    assert (row["message_id"], row["parsed_body"]) == ("<3@x>", None)
    (row,) = message_view.thread_with_content(elsewhere, files, "rehearsal").collect()
    assert body_of(row) == "body of <1@x>"
    assert message_view.thread_with_content(sample, files, "missing").count() == 0
