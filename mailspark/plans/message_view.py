"""One message, or one thread, with parsed content."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.operators import content, search, threads
from mailspark.sources.ranges import find_raw_batch


class MessageDetail(NamedTuple):
    """The message row with its content, its attachments, and its thread's rows."""

    message: DataFrame
    attachments: DataFrame
    thread: DataFrame


def content_of(emails, files):
    """Parsed content of some messages, whose byte ranges are read from their files (mbox_file_id, path)."""
    return content.contents(content.parse_messages(find_raw_batch(files, emails)))


def message_detail(emails, files, message_id):
    """Everything shown for one message; empty frames if it does not exist."""
    found = search.point_lookup(emails, message_id)
    enriched = threads.enrich(found, content_of(found, files))
    thread = threads.thread_of_message(emails, message_id)
    attached = enriched.select(
        "message_id", F.posexplode("attachments").alias("ordinal", "attachment")
    ).select("message_id", "ordinal", "attachment.*")
    return MessageDetail(enriched, attached, thread)


def thread_with_content(emails, files, thread_id):
    """All messages of a thread with body and attachments, oldest first."""
    members = threads.thread_members(emails, thread_id)
    enriched = threads.enrich(members, content_of(members, files))
    return enriched.orderBy(F.asc_nulls_last("date"), "message_id")


def attachment(emails, files, message_id, filename):
    """One attachment of one message by exact file name."""
    found = search.point_lookup(emails, message_id)
    return content.find_attachment(content_of(found, files), message_id, filename)
