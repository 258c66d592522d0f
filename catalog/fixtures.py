"""Mail made from the given tables: whole tables, derived by Spark.

``documents`` joined with ``orders`` gives one message per document;
``conversations`` gives one MIME message per turn; ``embeddings`` gives vectors.
"""

import os

from pyspark.sql import functions as F

from mailspark.plans.ingest import indexed_archive
from mailspark.session import shared_dir
from mailspark.sources import mbox

# Documents per archive file, and the room left for each in the table's extents.
ARCHIVE_DOCS = 500
FILE_DOCS = 50
SLOT = 10_000_000


def table(spark, sf_dir, name):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _message_id():
    return F.concat(
        F.lit("<"), F.col("doc_id").cast("string"), F.lit("@"), F.col("source"), F.lit(".example.com>")
    )


def _sender():
    customer = F.col("o_custkey").cast("string")
    address = F.concat(
        F.lit("User "), customer, F.lit(" <u"), customer, F.lit("@"), F.col("source"),
        F.lit(".example.com>"),
    )
    return F.when(F.col("doc_id") % 17 != 0, address)


def _labels():
    folder = F.when(F.col("doc_id") % 4 == 0, "Sent").otherwise("Inbox")
    named = F.array("lang", F.coalesce("o_orderpriority", F.lit("5-LOW")), folder)
    return F.when(F.col("doc_id") % 19 == 0, F.array(F.lit(""))).otherwise(named)


def _archive_number():
    return F.expr(f"doc_id div {ARCHIVE_DOCS}")


def _start():
    return F.col("doc_id") % ARCHIVE_DOCS * SLOT


def _mail(spark, sf_dir, **document_columns):
    """Documents with mail columns; texts are cut down before the join."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", *[c.alias(name) for name, c in document_columns.items()]
    )
    return documents.join(orders, F.col("o_orderkey") == F.col("doc_id"), "left").select(
        "doc_id",
        *document_columns,
        _message_id().alias("message_id"),
        _sender().alias("from_email"),
        F.concat(F.lit("list@"), F.col("lang"), F.lit(".example.com")).alias("to_email"),
        F.when(F.col("doc_id") % 23 != 0, F.col("o_orderdate")).alias("date"),
        (F.col("doc_id") % 4).cast("int").alias("has_attachment"),
        _labels().alias("labels"),
        F.coalesce(F.concat(F.lit("t"), (F.col("o_custkey") % 50).cast("string")), F.lit("")).alias("thread_id"),
        _archive_number().alias("archive"),
        F.concat(F.lit("archive-"), _archive_number().cast("string")).alias("mbox_file_id"),
        F.col("o_custkey").alias("customer"),
    )


def emails(spark, sf_dir):
    """The emails table: one message per document, a fixed slot of its archive each."""
    return _mail(
        spark,
        sf_dir,
        n_chars=F.col("n_chars"),
        subject=F.substring_index("text", "\n", 1),
        excerpt=F.substring("text", 1, 30),
    ).select(
        "message_id",
        "subject",
        "excerpt",
        "from_email",
        "to_email",
        "date",
        "has_attachment",
        "labels",
        F.lit("text/plain; charset=utf-8").alias("content_type"),
        "mbox_file_id",
        _start().alias("email_start"),
        (_start() + F.col("n_chars")).alias("email_end"),
        "thread_id",
    )


def saved_searches(spark, sf_dir):
    """A table of searches, one made of each message: by sender, part of the subject, label and sender, a
    stretch of time, free text."""
    mail = emails(spark, sf_dir)
    kind = F.expr("cast(substring_index(substring(message_id, 2), '@', 1) as bigint) % 5")
    day = F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("1997-01-31"))
    text = (
        F.when(kind == 0, F.concat(F.lit('from:"'), F.substring_index("from_email", "@", 1), F.lit('@"')))
        .when(kind == 1, F.concat(F.lit('subject:"'), F.substring("subject", 5, 12), F.lit('"')))
        .when(kind == 2, F.concat(F.lit("from:src3. label:"), F.element_at("labels", 1)))
        .when(kind == 3, F.concat(F.lit("from_date:1998-06-15 to_date:"), day))
        .otherwise(F.concat(F.substring("excerpt", 3, 10), F.lit(" to_date:"), day))
    )
    return mail.select(F.col("message_id").alias("search_id"), F.coalesce(text, F.lit("from:nobody")).alias("search"))


def documents(spark, sf_dir):
    """The text collection (message_id, text)."""
    return table(spark, sf_dir, "documents").select(_message_id().alias("message_id"), "text")


def vectors(spark, sf_dir):
    """Message vectors: those of documents by the same id, and all others under an id of their own."""
    found = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    ids = table(spark, sf_dir, "documents").select("doc_id", _message_id().alias("message_id"))
    own = F.concat(F.lit("<v"), F.col("vec_id").cast("string"), F.lit("@vectors.example.com>"))
    joined = found.join(ids, F.col("vec_id") == F.col("doc_id"), "left")
    return joined.select(F.coalesce("message_id", own).alias("message_id"), "vec")


def query_vector(spark, sf_dir, vec_id=0):
    """One stored vector, used as the user's query."""
    found = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id)
    return list(found.select("embedding").first()["embedding"])


# -- message texts --------------------------------------------------------------


def _encoded(column):
    """Base64 on one line (Spark may break it into lines)."""
    return F.regexp_replace(F.base64(F.encode(column, "UTF-8")), r"[\r\n]+", "")


def _line(name, value):
    """A header line; nothing where the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\n")), F.lit(""))


def plain_messages(spark, sf_dir):
    """Text mail with 8-bit bodies, as in a mail file, keyed like the emails table.

    Body lines beginning with the message mark are left as they are.
    """
    mail = _mail(spark, sf_dir, text=F.col("text"), n_chars=F.col("n_chars"))
    subject = F.substring_index("text", "\n", 1)
    local = F.date_format(F.col("date") + F.expr("interval 2 hours"), "EEE, dd MMM yyyy HH:mm:ss")
    utc = F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss")
    odd = F.col("customer") % 2 == 1
    date = F.when(odd, F.concat(local, F.lit(" +0200"))).otherwise(F.concat(utc, F.lit(" +0000")))
    labels = F.when(F.col("doc_id") % 19 != 0, F.array_join("labels", ","))
    message = F.concat(
        F.lit("From sender@example.com Thu Jan 01 00:00:00 1970\n"),
        _line("From", F.col("from_email")),
        _line("To", F.col("to_email")),
        F.lit("Subject: =?utf-8?B?"), _encoded(subject), F.lit("?=\n"),
        _line("Date", date),
        _line("Message-ID", F.col("message_id")),
        _line("X-Gmail-Labels", labels),
        _line("X-GM-THRID", F.col("thread_id")),
        F.lit("MIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\n"),
        F.lit("Content-Transfer-Encoding: 8bit\n\n"),
        F.col("text"),
    )
    return mail.select(
        "archive",
        "doc_id",
        "mbox_file_id",
        _start().alias("email_start"),
        (_start() + F.col("n_chars")).alias("email_end"),
        message.alias("message"),
    )


def archive_files(spark, sf_dir):
    """Write all plain messages as mbox files, one per archive; return the folder."""
    folder = shared_dir(spark, "archive")
    rows = plain_messages(spark, sf_dir)
    (
        rows.repartition("archive")
        .sortWithinPartitions("archive", "doc_id")
        .select("message", "archive")
        .write.partitionBy("archive")
        .text(folder)
    )
    return folder


def archive_of(path):
    """Archive number in the path of a file written by ``archive_files``."""
    return F.regexp_extract(path, "archive=([0-9]+)", 1).cast("bigint")


def conversation_messages(spark, sf_dir):
    """Raw messages, one per conversation turn, with a MIME layout per role.

    user: alternative (plain, HTML) nested in mixed, with an attachment;
    assistant: plain text and an attachment; others: a single HTML part.
    """
    turns = table(spark, sf_dir, "conversations")
    turn, text = F.col("turn").cast("string"), F.col("text")
    encoded = F.concat(F.lit("Content-Transfer-Encoding: base64\n\n"), _encoded(text), F.lit("\n"))
    markup = F.concat(F.lit("<p>"), text, F.lit("</p>"))
    encoded_markup = F.concat(
        F.lit("Content-Transfer-Encoding: base64\n\n"), _encoded(markup), F.lit("\n")
    )
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\n"), encoded)
    html = F.concat(F.lit("Content-Type: text/html; charset=utf-8\n"), encoded_markup)
    attached = F.concat(
        F.lit('Content-Type: text/plain; charset=utf-8\nContent-Disposition: attachment; filename="turn'),
        turn, F.lit('.txt"\n'), encoded,
    )
    alternative = F.concat(
        F.lit('Content-Type: multipart/alternative; boundary="inner"\n\n--inner\n'),
        plain, F.lit("--inner\n"), html, F.lit("--inner--\n"),
    )

    def mixed(first):
        return F.concat(
            F.lit('Content-Type: multipart/mixed; boundary="outer"\n\n--outer\n'),
            first, F.lit("--outer\n"), attached, F.lit("--outer--\n"),
        )

    layout = (
        F.when(F.col("role") == "user", mixed(alternative))
        .when(F.col("role") == "assistant", mixed(plain))
        .otherwise(html)
    )
    message_id = F.concat(
        F.lit("<c"), F.col("conv_id").cast("string"), F.lit("."), turn, F.lit("@chat.example.com>")
    )
    raw = F.concat(
        _line("From", F.concat(F.col("role"), F.lit(" <"), F.col("role"), F.lit("@chat.example.com>"))),
        _line("Message-ID", message_id),
        _line("X-GM-THRID", F.concat(F.lit("c"), F.col("conv_id").cast("string"))),
        F.lit("MIME-Version: 1.0\n"),
        layout,
    )
    return turns.select(
        F.lit("conversations").alias("mbox_file_id"),
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("email_start"),
        (F.col("conv_id") * 1_000_000 + F.col("turn") + 1).alias("email_end"),
        raw.cast("binary").alias("raw"),
    )


def conversation_files(spark, sf_dir):
    """Write the conversation messages as mbox files, one for each few conversations; return the folder."""
    folder = shared_dir(spark, "conversations")
    raw = conversation_messages(spark, sf_dir)
    message = F.concat(F.lit("From chat@example.com Thu Jan 01 00:00:00 1970\n"), F.col("raw").cast("string"))
    archive = F.expr(f"email_start div {1_000_000 * ARCHIVE_DOCS}")
    rows = raw.select(message.alias("message"), archive.alias("archive"), "email_start")
    (
        rows.repartition("archive")
        .sortWithinPartitions("archive", "email_start")
        .select("message", "archive")
        .write.partitionBy("archive")
        .text(folder)
    )
    return folder


def located(spark, folder):
    """(message_id, mbox_file_id, email_start, email_end) of all messages of some mail files, by a scan of
    their headers, and (mbox_file_id, path) of the files."""
    records, index, count = indexed_archive(spark, folder)
    header = F.regexp_extract(F.col("value").cast("string"), r"(?m)^Message-ID: ([^\n]*)$", 1)
    narrow = records.select(
        "path", "split_start", F.octet_length("value").cast("bigint").alias("n"), header.alias("message_id")
    )
    places = mbox.with_extents(narrow, index, count).filter("message_id <> ''")
    files = index.filter("is_valid").select("mbox_file_id", "path").distinct()
    return places.select("message_id", "mbox_file_id", "path", "email_start", "email_end"), files


def located_emails(spark, sf_dir):
    """The emails table with the ids and extents that a scan of its mail files gives, and the files."""
    places, files = located(spark, archive_files(spark, sf_dir))
    rest = emails(spark, sf_dir).drop("mbox_file_id", "email_start", "email_end")
    return rest.join(places, "message_id"), files


def text_files(spark, sf_dir):
    """Write documents as files: mail files and files of bare texts by turns, and an empty one; return the folder."""
    folder = shared_dir(spark, "texts")
    number = F.expr(f"1 + doc_id div {FILE_DOCS}")
    marked = F.concat(F.lit("From sender@example.com Thu Jan 01 00:00:00 1970\n\n"), F.col("text"))
    rows = table(spark, sf_dir, "documents").select(
        number.alias("archive"), "doc_id", F.when(number % 2 == 0, marked).otherwise(F.col("text")).alias("text")
    )
    (
        rows.repartition("archive")
        .sortWithinPartitions("archive", "doc_id")
        .select("text", "archive")
        .write.partitionBy("archive")
        .text(folder)
    )
    rows.select("text").limit(0).coalesce(1).write.text(os.path.join(folder, "archive=0"))
    return folder


def dated_orders(spark, sf_dir):
    """Order dates as mail headers in five layouts, with the order key."""
    date = F.col("o_orderdate")
    ahead = date + F.expr("interval 2 hours")
    behind = date - F.expr("interval 5 hours")

    def written(moment, layout, zone):
        return F.concat(F.date_format(moment, layout), F.lit(zone))

    layout = F.col("o_custkey") % 5
    header = (
        F.when(layout == 0, written(ahead, "EEE, d MMM yyyy HH:mm:ss", " +0200 (EET)"))
        .when(layout == 1, written(date, "EEE, dd MMM yyyy HH:mm:ss", " GMT"))
        .when(layout == 2, written(behind, "d MMM yyyy HH:mm", " -0500"))
        .when(layout == 3, written(behind, "EEE, d MMM yyyy HH:mm:ss", " EST"))
        .otherwise(F.lit("sometime in autumn"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", header.alias("header"))


def freely_dated_orders(spark, sf_dir):
    """Order dates, each with a time of day, as people and programs write them, with the order key."""
    moment = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86_400).cast("decimal(18,6)"))
    ahead = moment + F.expr("interval 2 hours")
    number = F.col("o_orderkey") % 10
    header = (
        F.when(number == 0, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(number == 1, F.date_format(ahead, "yyyy-MM-dd HH:mm:ss'+02:00'"))
        .when(number == 2, F.date_format(moment, "M/d/yyyy HH:mm"))
        .when(number == 3, F.date_format(moment, "dd/MM/yyyy HH:mm:ss"))
        .when(number == 4, F.date_format(moment, "d.M.yyyy"))
        .when(number == 5, F.date_format(moment, "MMMM d, yyyy h:mm a"))
        .when(number == 6, F.date_format(moment, "EEE MMM d HH:mm:ss yyyy"))
        .when(number == 7, F.date_format(moment, "dd-MMM-yy HH:mm:ss"))
        .when(number == 8, F.date_format(moment, "yyyy'-13-'dd"))
        .otherwise(F.date_format(moment, "yyyyMMdd"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", header.alias("header"))
