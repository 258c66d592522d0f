import datetime as dt

import pytest
from pyspark.sql import functions as F

from mail_rows import ids
from mailspark.plans.ingest import ingest
from mailspark.sources import tables

PLAIN = b"""From harbour 1
Message-ID: <tide-table@harbour.example>
To: pilots@harbour.example
Subject: Tide table for the quay

High water comes at six, so the ferry leaves early.

"""
MARKUP = b"""From kitchen 2
X-Gmail-Labels: Recipes,Soup
X-GM-THRID: 4711
Message-ID: <leek-soup@kitchen.example>
Date: Sat, 9 Mar 2019 08:15:00 -0300
Content-Type: text/html

<div>Slice the <b>leeks</b> thinly.</div>

"""
NAMELESS = b"""From loft 3
Subject: a note without a name

the key is under the flowerpot

"""
ATTACHED = b"""From workshop 4
Message-ID: <lathe-plan@workshop.example>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=SAWDUST

--SAWDUST
Content-Disposition: attachment; filename="lathe.csv"
Content-Type: text/csv

part,mm
spindle,40
--SAWDUST
Content-Type: text/plain

The measures are in the list.
--SAWDUST--
"""
MORE = b"From depot\nMessage-ID: <parcel@depot.example>\nDate: never\n\nit is on its way\n"
NAMED = ["<lathe-plan@workshop.example>", "<leek-soup@kitchen.example>", "<tide-table@harbour.example>"]
ONCE = {"emails": 3, "embeddings": 3, "documents": 3, "raw_messages": 4, "contents": 4}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "a.mbox").write_bytes(PLAIN + MARKUP + NAMELESS + ATTACHED)
    return tmp_path


def test_ingest(spark, folder):
    root = str(folder / "tables")
    loaded = ingest(spark, str(folder / "mail"), root)
    rows = {r["message_id"]: r for r in loaded["emails"].collect()}
    assert sorted(rows) == NAMED
    attached, markup, plain = (rows[name] for name in NAMED)
    assert plain["email_start"] == 0 and plain["excerpt"] == "High water comes at six, so th"
    assert (plain["labels"], plain["thread_id"]) == ([""], "")
    assert markup["date"] == dt.datetime(2019, 3, 9, 11, 15) and markup["excerpt"] == "Slice the leeks thinly."
    assert (markup["labels"], markup["thread_id"]) == (["Recipes", "Soup"], "4711")
    assert (attached["date"], attached["has_attachment"]) == (None, 1)
    assert loaded["raw_messages"].count() == 4
    assert loaded["embeddings"].count() == loaded["documents"].count() == 3
    parts = loaded["contents"].filter(F.col("message_id") == NAMED[0]).first()["attachments"]
    assert [p["filename"] for p in parts] == ["lathe.csv"]


def test_ingest_again_adds_only_what_is_new(spark, folder):
    root, mail = str(folder / "tables"), str(folder / "mail")
    ingest(spark, mail, root)
    before = {n: f.count() for n, f in ingest(spark, mail, root).items()}
    assert before == ONCE
    (folder / "mail" / "b.mbox").write_bytes(MORE)
    after = {n: f.count() for n, f in ingest(spark, mail, root).items()}
    assert after == {n: c + 1 for n, c in before.items()}


def test_drop_previous(spark, folder):
    root, mail = str(folder / "tables"), str(folder / "mail")
    ingest(spark, mail, root)
    (folder / "other").mkdir()
    (folder / "other" / "b.mbox").write_bytes(MORE)
    loaded = ingest(spark, str(folder / "other"), root, drop_previous=True)
    assert {n: f.count() for n, f in loaded.items()} == dict.fromkeys(loaded, 1)


def test_a_file_without_message_ids_is_loaded_once(spark, tmp_path):
    mail, root = tmp_path / "mail", str(tmp_path / "tables")
    mail.mkdir()
    (mail / "a.mbox").write_bytes(NAMELESS)
    (mail / "copy.mbox").write_bytes(NAMELESS)
    (mail / "b.mbox").write_bytes(PLAIN)
    for _ in range(2):
        counts = {n: f.count() for n, f in ingest(spark, str(mail), root).items()}
        assert counts == {"emails": 1, "embeddings": 1, "documents": 1, "raw_messages": 2, "contents": 2}


@pytest.mark.parametrize("added", [b"", MORE])
def test_a_run_that_stopped_early_is_finished_by_the_next(spark, folder, monkeypatch, added):
    root, mail = str(folder / "tables"), str(folder / "mail")

    def lost(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "write_emails", lost)
        with pytest.raises(RuntimeError):
            ingest(spark, mail, root)
    if added:
        (folder / "mail" / "b.mbox").write_bytes(added)
    counts = {n: f.count() for n, f in ingest(spark, mail, root).items()}
    assert counts == {n: c + bool(added) for n, c in ONCE.items()}


def test_copies_of_a_message_are_embedded_once(spark, folder):
    (folder / "mail" / "a.mbox").write_bytes(PLAIN + PLAIN)
    loaded = ingest(spark, str(folder / "mail"), str(folder / "tables"))
    assert {n: f.count() for n, f in loaded.items()} == {
        "emails": 2, "embeddings": 1, "documents": 1, "raw_messages": 2, "contents": 2,
    }


def test_emails_sink_is_idempotent_and_prunes(spark, sample, tmp_path):
    root = str(tmp_path)
    tables.write_emails(sample.unionByName(sample), root)
    tables.write_emails(sample, root)
    emails = tables.open_archive(spark, root, views=True)["emails"]
    assert sorted(ids(emails)) == ["<1@x>", "<2@x>", "<3@x>"]
    assert spark.sql("select count(*) from emails").first()[0] == 3
    found = emails.filter(F.col("from_email").like("%ann%") & (F.col("date") >= F.lit("2024-01-01").cast("timestamp_ntz")))
    plan = found.select("message_id")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(from_email,ann)" in plan and "GreaterThanOrEqual(date" in plan
    assert "ReadSchema: struct<message_id:string,from_email:string,date:timestamp_ntz>" in plan


def test_documents_keep_the_first_copy(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "late", 2), ("a", "early", 1), ("b", "x", 3)], "message_id string, text string, n int"
    )
    tables.write_documents(rows, str(tmp_path), order=["n"])
    tables.write_documents(rows.withColumn("text", F.lit("again")), str(tmp_path), order=["n"])
    saved = tables.open_archive(spark, str(tmp_path))["documents"]
    assert sorted(map(tuple, saved.collect())) == [("a", "early"), ("b", "x")]


def test_append_new_keeps_existing_rows(sample, emails_of):
    batch = emails_of(
        {"message_id": "changed", "email_start": 0}, {"message_id": "<4@x>", "email_start": 300},
        {"message_id": "<4@x>", "email_start": 300},
    )
    assert sorted(ids(tables.append_new(sample, batch))) == ["<1@x>", "<2@x>", "<3@x>", "<4@x>"]


def test_dates_are_read_from_headers_once(spark, folder, monkeypatch):
    plans, write = [], tables.write_stats

    def noted(emails, *rest):
        plans.append(emails._jdf.queryExecution().executedPlan().toString())
        write(emails, *rest)

    monkeypatch.setattr(tables, "write_stats", noted)
    ingest(spark, str(folder / "mail"), str(folder / "tables"))
    assert len(plans) == 1 and "Python" not in plans[0]
    assert tables.open_stats(spark, str(folder / "tables")).agg(F.sum("n")).first()[0] == 3
