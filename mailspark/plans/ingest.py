"""From mbox files to the archive tables.

Stages are cut where a table is written, so a lost executor costs at most one
stage: splits are indexed, raw messages written once, parsed once, and all other
tables come from narrow reads of the parsed one.
"""

import os

from pyspark.sql import functions as F

from mailspark import schemas
from mailspark.functions.dates import header_timestamp
from mailspark.operators.content import contents, excerpt, parse_messages
from mailspark.operators.semantic import embed_documents, hashed_terms
from mailspark.session import shared_dir
from mailspark.sources import mbox, tables


def _written(frame, path):
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.parquet(path)


def indexed_archive(spark, paths):
    """(records, index with file ids, number of splits) of some mbox files.

    The index is a small written table: it is used more than once.
    """
    records = mbox.scan(spark, paths)
    folder = shared_dir(spark, "index")
    index = _written(mbox.split_index(records), os.path.join(folder, "splits"))
    count = index.count()
    index = index.join(mbox.fingerprints(records, index, count), "path", "left")
    return records, _written(index, os.path.join(folder, "files")), count


def _to_load(index, loaded):
    """The index with only those files valid that aren't loaded; of files with equal content the first."""
    first = index.filter("is_valid").groupBy("mbox_file_id").agg(F.min("path").alias("first_path"))
    if loaded is not None:
        first = first.join(loaded.select("mbox_file_id").distinct(), "mbox_file_id", "left_anti")
    fresh = first.select(F.col("first_path").alias("path"), F.lit(True).alias("fresh"))
    index = index.join(fresh, "path", "left")
    return index.withColumn("is_valid", F.col("is_valid") & F.col("fresh").isNotNull()).drop("fresh")


def read_archive(spark, paths):
    """Raw messages of mbox files, with file ids and extents."""
    return mbox.raw_messages(*indexed_archive(spark, paths))


def email_rows(content):
    """The emails table from parsed messages; mail without Message-ID is left out."""
    identified = content.filter(F.coalesce("message_id", F.lit("")) != "")
    return identified.select(
        "message_id",
        "subject",
        excerpt().alias("excerpt"),
        "from_email",
        "to_email",
        header_timestamp("date_text").alias("date"),
        "has_attachment",
        F.split(F.coalesce("labels_text", F.lit("")), ",").alias("labels"),
        "content_type",
        "mbox_file_id",
        "email_start",
        "email_end",
        F.coalesce("thread_text", F.lit("")).alias("thread_id"),
    ).select(*schemas.EMAILS.fieldNames())


def ingest(
    spark, paths, root, embedder=hashed_terms, direct_parts=False, drop_previous=False
):
    """Load mbox files into the tables under ``root`` and return these.

    Files already loaded are skipped; which these are stands in a table of its own,
    written last. A file of a run that stopped early is therefore loaded again, by
    whatever set of files comes next, and replaces its own earlier attempt.
    """
    records, index, count = indexed_archive(spark, paths)
    loaded = None if drop_previous else tables.loaded_files(spark, root)
    index = _written(_to_load(index, loaded), shared_dir(spark, "to-load"))
    batch = index.filter("is_valid").groupBy("mbox_file_id").agg(F.min("path").alias("path"))
    if not batch.isEmpty():
        raw = mbox.raw_messages(records, index, count)
        raw = tables.write_by_file(raw, batch, root, "raw_messages", drop_previous)
        content = contents(parse_messages(raw), direct_parts)
        content = tables.write_by_file(content, batch, root, "contents", drop_previous)
        texts = content.filter(F.coalesce("message_id", F.lit("")) != "").select(
            "message_id", "mbox_file_id", "email_start", "text"
        )
        tables.write_documents(texts, root, drop_previous)
        once = tables.first_seen(texts, ["mbox_file_id", "message_id"], ["email_start"])
        tables.write_embeddings(embed_documents(once, embedder), root, drop_previous, unique=True)
        tables.write_emails(email_rows(content), root, drop_previous)
        # of the table just written, so that dates are read from the headers once
        emails = tables.open_archive(spark, root)["emails"].join(batch, "mbox_file_id", "left_semi")
        tables.write_stats(emails, batch, root, drop_previous)
        tables.write_loaded(batch, root, drop_previous)
    return tables.open_archive(spark, root)
