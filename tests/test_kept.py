"""Deep pages, kept statistics and free-form dates on small tables of their own."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mailspark.functions.dates import header_timestamp
from mailspark.operators import kept_stats, page_index, search, stats
from mailspark.sources import tables

COLUMNS = "message_id string, date timestamp_ntz, mbox_file_id string, email_start long, email_end long"


@pytest.fixture(scope="module")
def mail(spark):
    """500 messages: a third from one day, some without date, ids that occur twice."""
    random.seed(5)
    rows = []
    for n in range(500):
        day = dt.datetime(2022, 3, 1) + dt.timedelta(days=0 if n % 3 == 0 else random.randrange(400))
        rows.append((f"<{n // 2}@x>", None if n % 11 == 0 else day, f"f{n % 4}", n * 10, None if n % 50 == 1 else n * 10 + 7))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_pages_of_the_index_are_those_of_the_list(spark, mail, tmp_path, block):
    index = page_index.build_page_index(mail, str(tmp_path), block=block)
    wanted = [tuple(r) for r in search.list_page(mail, 1000).collect()]
    for offset in (0, 3, 250, 486, 499, 500, 9_000):
        page = index.page(14, offset).select(*mail.columns).collect()
        assert [tuple(r) for r in page] == wanted[offset : offset + 14]
    assert index.count().first()[0] == 500


def test_only_the_blocks_of_a_page_are_read(spark, mail, tmp_path):
    index = page_index.build_page_index(mail, str(tmp_path), block=50)
    plan = index.page(10, 300)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert index.directory.agg(F.max("n")).first()[0] <= 50


def test_index_of_no_rows(spark, mail, tmp_path):
    index = page_index.build_page_index(mail.limit(0), str(tmp_path))
    assert index.page(10).count() == 0 and index.count().first()[0] == 0


def test_a_page_follows_the_last_row_of_another(mail):
    wanted = search.list_page(mail, 1000).collect()
    for at in (0, 17, 455, 470, 498, 499):
        following = page_index.page_after(mail, wanted[at].asDict(), 9).collect()
        assert following == wanted[at + 1 : at + 10]


def test_kept_statistics_equal_those_of_all_mail(spark, mail, tmp_path):
    root = str(tmp_path)
    assert kept_stats.summary(tables.open_stats(spark, root)).first()["messages"] == 0
    first, second = mail.filter("mbox_file_id < 'f2'"), mail.filter("mbox_file_id >= 'f2'")
    for batch in (first, second, second.unionByName(second)):
        tables.write_stats(batch, batch.select("mbox_file_id").distinct(), root)
    kept = tables.open_stats(spark, root)
    found, exact = kept_stats.summary(kept).first(), stats.summary(mail).first()
    assert found["messages"] == 500 and abs(found["all_emails"] - 250) <= 12
    for name in ("avg_size", "first_seen", "last_seen", "days_timespan"):
        assert found[name] == pytest.approx(exact[name]) if name == "avg_size" else found[name] == exact[name]
    key = lambda r: str(r[0])
    assert sorted(kept_stats.monthly_sizes(kept).collect(), key=key) == sorted(stats.monthly_sizes(mail).collect(), key=key)


DATES = {
    "2024-05-01": "2024-05-01 00:00:00",
    "2024-05-01T10:20:30Z": "2024-05-01 10:20:30",
    "2024-05-01 10:20:30.25 +0200": "2024-05-01 08:20:30.25",
    "2024-05-01T10:20:30-05:30": "2024-05-01 15:50:30",
    "5/1/2024": "2024-05-01 00:00:00",
    "13/5/2024 7:05 PM": "2024-05-13 19:05:00",
    "3.4.2024 10:00": "2024-04-03 10:00:00",
    "Wed, May 1st, 2024 10:20": "2024-05-01 10:20:00",
    "1-May-24 10:20:30": "2024-05-01 10:20:30",
    "1-May-69": "1969-05-01 00:00:00",
    "Wed May  1 10:20:30 2024": "2024-05-01 10:20:30",
    "Wednesday, 1 May 2024 12:00 AM": "2024-05-01 00:00:00",
    "1 May 2024 10:20:30 GMT": "2024-05-01 10:20:30",
    "31/31/2024": None,
    "2024-13-01": None,
    "2024-02-30": None,
    "1 Foo 2024": None,
    "5/1/24 25:00": None,
    "5/1/24 13:00 PM": None,
    "12:00": None,
    "": None,
}


@pytest.mark.parametrize("lenient", [True, False])
def test_dates_as_people_write_them(spark, lenient):
    rows = spark.createDataFrame([(text,) for text in [*DATES, None]], "text string")
    found = rows.select("text", header_timestamp(F.col("text"), lenient).cast("string").alias("at")).collect()
    assert {r["text"]: r["at"] for r in found} == DATES | {None: None}
