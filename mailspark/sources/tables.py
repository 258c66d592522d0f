"""The archive as Parquet tables: emails, embeddings, documents, messages."""

import os

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mailspark import schemas
from mailspark.operators import kept_stats

TABLES = {
    "emails": schemas.EMAILS,
    "embeddings": schemas.EMBEDDINGS,
    "documents": schemas.DOCUMENTS,
}


def exists(spark, path):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def first_seen(rows, keys, order):
    """One row per key, the first by ``order``.

    An aggregate, not a window: copies of a key are reduced before the shuffle,
    so a key that holds a large share of the rows does no harm.
    """
    rest = [c for c in rows.columns if c not in keys]
    kept = F.min_by(F.struct(*rest), F.struct(*order)).alias("kept")
    return rows.groupBy(*keys).agg(kept).select(*keys, "kept.*").select(*rows.columns)


def append_new(existing, batch, keys=("mbox_file_id", "email_start"), order=("message_id",)):
    """Existing rows plus those of the batch that are not there yet.

    Of the existing rows only the keys are compared; their payload stays put.
    """
    keys = list(keys)
    fresh = first_seen(batch, keys, list(order)).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def _missing(rows, path, keys, drop_previous):
    """The rows whose keys are not in the table at ``path`` yet."""
    spark = rows.sparkSession
    if drop_previous or not exists(spark, path):
        return rows
    return rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")


def _mode(drop_previous):
    return "overwrite" if drop_previous else "append"


def write_emails(emails, root, drop_previous=False):
    """Append (or rewrite) the emails table, one folder per month.

    A message is identified by its file and byte position; copies in the batch
    and messages already there are not written again. Ranges over (month, id)
    give files of even size even if one month holds most of the mail, and narrow
    id ranges per file for lookups.
    """
    columns, keys = schemas.EMAILS.fieldNames(), ["mbox_file_id", "email_start"]
    path = os.path.join(root, "emails")
    batch = first_seen(emails.select(*columns), keys, ["message_id"])
    batch = _missing(batch, path, keys, drop_previous)
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("undated"))
    (
        batch.withColumn("year_month", month)
        .repartitionByRange("year_month", "message_id")
        .sortWithinPartitions("year_month", "message_id")
        .write.mode(_mode(drop_previous))
        .partitionBy("year_month")
        .parquet(path)
    )


def write_embeddings(embeddings, root, drop_previous=False, unique=False):
    """Append (or rewrite) message vectors: one per file and message id.

    ``unique`` says that the rows are one per file and id already; vectors then aren't sorted and compared.
    """
    path, keys = os.path.join(root, "embeddings"), ["mbox_file_id", "message_id"]
    rows = embeddings.select(*schemas.EMBEDDINGS.fieldNames())
    rows = rows if unique else first_seen(rows, keys, ["vec"])
    rows = _missing(rows, path, keys, drop_previous)
    rows.write.mode(_mode(drop_previous)).parquet(path)


def write_documents(
    documents, root, drop_previous=False, order=("mbox_file_id", "email_start")
):
    """Append (or rewrite) the text collection: one document per id, the first seen."""
    path = os.path.join(root, "documents")
    rows = documents.select("message_id", "text", *order)
    rows = first_seen(rows, ["message_id"], order).select(*schemas.DOCUMENTS.fieldNames())
    rows = _missing(rows, path, ["message_id"], drop_previous)
    rows.write.mode(_mode(drop_previous)).parquet(path)


def write_by_file(rows, batch, root, name, drop_previous=False):
    """Write a table with one folder per mail file and read back the files of ``batch``.

    Files that are there already are replaced, all others stay; with
    ``drop_previous`` they go as well.
    """
    path = os.path.join(root, name)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if drop_previous else "dynamic")
        .partitionBy("mbox_file_id")
        .parquet(path)
    )
    return _by_file(rows.sparkSession, path).join(batch, "mbox_file_id", "left_semi").select(*rows.columns)


def _by_file(spark, path):
    """A table with one folder per mail file; the id is text, even if it looks like a number."""
    found = spark.read.parquet(path).schema
    fields = [StructField(f.name, StringType()) if f.name == "mbox_file_id" else f for f in found.fields]
    return spark.read.schema(StructType(fields)).parquet(path)


def write_stats(emails, batch, root, drop_previous=False):
    """Replace the partial statistics of the files of ``batch`` by those of their messages."""
    rows = first_seen(emails, ["mbox_file_id", "email_start"], ["message_id"])
    write_by_file(kept_stats.partial_stats(rows), batch, root, "stats", drop_previous)


def open_stats(spark, root):
    """The partial statistics of all files; none before the first load."""
    path = os.path.join(root, "stats")
    if not exists(spark, path):
        return spark.createDataFrame([], kept_stats.SCHEMA)
    return spark.read.schema(kept_stats.SCHEMA).parquet(path)


def loaded_files(spark, root):
    """(mbox_file_id, path) of the files that are loaded in full, or None before the first."""
    path = os.path.join(root, "loaded_files")
    return spark.read.schema("mbox_file_id string, path string").parquet(path) if exists(spark, path) else None


def write_loaded(batch, root, drop_previous=False):
    """Note that the files of ``batch`` are loaded in full, and where they lie."""
    batch.select("mbox_file_id", "path").write.mode(_mode(drop_previous)).parquet(os.path.join(root, "loaded_files"))


def open_archive(spark, root, views=False):
    """The tables under ``root`` by name, with fixed schemas; optionally as SQL views."""
    opened = {
        name: spark.read.schema(schema).parquet(os.path.join(root, name))
        for name, schema in TABLES.items()
        if exists(spark, os.path.join(root, name))
    }
    for name in ("raw_messages", "contents"):
        if exists(spark, os.path.join(root, name)):
            opened[name] = _by_file(spark, os.path.join(root, name))
    if views:
        for name, frame in opened.items():
            frame.createOrReplaceTempView(name)
    return opened
