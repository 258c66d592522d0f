"""Threads: messages that share a non-empty thread id.

Mail without a thread header has an empty id; treating that as a thread would
make one group of most of an archive, so it never is.
"""

from pyspark.sql import functions as F

from mailspark.operators.search import point_lookup


def _in_thread():
    return F.coalesce(F.col("thread_id"), F.lit("")) != ""


def thread_members(emails, thread_id):
    """All messages of one thread, oldest first."""
    members = emails.filter(_in_thread() & (F.col("thread_id") == thread_id))
    return members.orderBy(F.asc_nulls_last("date"), "message_id")


def threads_of_messages(emails, ids):
    """All members of every thread that contains one of the given message ids.

    Each member comes out once, however many of the ids its thread contains.
    """
    asked = emails.join(ids.select("message_id").distinct(), "message_id", "left_semi")
    wanted = asked.filter(_in_thread()).select("thread_id").distinct()
    return emails.join(wanted, "thread_id", "left_semi")


def thread_of_message(emails, message_id):
    """All members of the thread one message belongs to; empty if it has none.

    The thread id is a scalar subquery: found first, then filtered on like a
    constant, so the table is neither shuffled nor joined.
    """
    thread_id = point_lookup(emails, message_id).select("thread_id").scalar()
    return emails.filter(_in_thread() & (F.col("thread_id") == thread_id))


def thread_sizes(emails):
    """Messages per thread."""
    return emails.filter(_in_thread()).groupBy("thread_id").agg(F.count("*").alias("thread_count"))


def enrich(emails, content):
    """Message rows with body and attachments; rows without content stay bare."""
    parsed = content.select(
        "mbox_file_id",
        "email_start",
        F.col("body.content").alias("parsed_body"),
        "attachments",
    )
    return emails.join(parsed, ["mbox_file_id", "email_start"], "left")
