import datetime as dt

import pytest

from mailspark import schemas
from mailspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.maxMetadataStringLength": "10000",
    })
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def splits_of(spark):
    """Set the split size for one test and put the settings back afterwards."""
    keys = [
        "spark.sql.files.maxPartitionBytes",
        "spark.sql.files.openCostInBytes",
        "spark.sql.files.minPartitionNum",
    ]
    before = {key: spark.conf.get(key, None) for key in keys}

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")

    yield use
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def email_row(**values):
    row = {
        "message_id": "<a@x>",
        "subject": "Minutes of the choir",
        "excerpt": "We sang four new pieces and",
        "from_email": "Tomke <tomke@choir.example>",
        "to_email": "",
        "date": dt.datetime(2024, 1, 1, 12),
        "has_attachment": 0,
        "labels": ["inbox"],
        "content_type": None,
        "mbox_file_id": "f",
        "email_start": 0,
        "email_end": 64,
        "thread_id": "rehearsal",
    }
    row.update(values)
    return tuple(row[name] for name in schemas.EMAILS.fieldNames())


@pytest.fixture
def emails_of(spark):
    return lambda *rows: spark.createDataFrame([email_row(**r) for r in rows], schemas.EMAILS)


@pytest.fixture
def sample(emails_of):
    """A choir's mail: three messages in three threads, of 64, 200 and 36 bytes."""
    return emails_of(
        {"message_id": "<1@x>"},
        {
            "message_id": "<2@x>", "email_start": 64, "email_end": 264, "thread_id": "tour",
            "subject": "Bus to the concert", "from_email": "bob@y.org", "date": dt.datetime(2024, 1, 2, 13),
        },
        {
            "message_id": "<3@x>", "email_start": 264, "email_end": 300, "thread_id": "scores",
            "subject": "Scores, second voice", "labels": ["archive", "work"], "has_attachment": 1,
            "date": dt.datetime(2024, 2, 3, 14), "from_email": None,
        },
    )
