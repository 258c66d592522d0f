"""Bodies, attachments and index text of raw messages."""

from pyspark.sql import functions as F

from mailspark import schemas
from mailspark.functions import mime
from mailspark.functions.text import ascii_text, html_to_text

UNNAMED = "Untitled"  # fixed value
PREVIEW_BYTES = 50
EXCERPT_CHARS = 30


def parse_messages(raw):
    """Parse each raw message once: decoded headers and its MIME parts."""
    keys = ["mbox_file_id", "email_start", "email_end", "raw"]
    return raw.select(*keys).mapInArrow(mime.parts_of, schemas.PARSED)


def _is_detached(part):
    """Parts with a file name or marked as attachment."""
    named = F.coalesce(part["filename"], F.lit("")) != ""
    return ~part["is_container"] & (
        named | F.coalesce(part["disposition"].startswith("attachment"), F.lit(False))
    )


def body(parts="parts", problem="problem"):
    """STRUCT(body_type, content): last HTML part, else first plain part."""

    def texts(kind):
        chosen = F.filter(
            F.col(parts),
            lambda p: ~p["is_container"] & ~_is_detached(p) & (p["content_type"] == kind),
        )
        return F.transform(chosen, lambda p: p["content"])

    html = F.try_element_at(texts("text/html"), F.lit(-1))
    plain = F.try_element_at(texts("text/plain"), F.lit(1))

    def result(kind, content):
        return F.struct(F.lit(kind).alias("body_type"), content.alias("content"))

    return (
        F.when(F.col(problem).isNotNull(), result("Error", F.col(problem)))
        .when(F.coalesce(html, F.lit("")) != "", result("HTML", html))
        .when(F.coalesce(plain, F.lit("")) != "", result("Plain Text", plain))
        .otherwise(result("None", F.lit(None).cast("string")))
    )


def attachments(parts="parts"):
    """ARRAY of attachments with name, type, size, bytes and a short preview."""
    return F.transform(
        F.filter(F.col(parts), _is_detached),
        lambda p: F.struct(
            F.coalesce(F.nullif(p["filename"], F.lit("")), F.lit(UNNAMED)).alias("filename"),
            p["content_type"].alias("content_type"),
            F.octet_length(p["payload"]).cast("bigint").alias("size_bytes"),
            p["payload"].alias("content"),
            F.substring(p["payload"], 1, PREVIEW_BYTES).alias("content_preview"),
        ),
    )


def _direct_source(parts="parts"):
    """Top-level parts glued together, binary ones as ASCII.

    A container among them, or text that cannot be decoded, empties the result.
    """
    column = F.col(parts)
    level = F.when(F.exists(column, lambda p: p["depth"] == 1), 1).otherwise(0)
    direct = F.filter(column, lambda p: p["depth"] == level)
    glued = F.array_join(
        F.transform(direct, lambda p: F.coalesce(p["content"], ascii_text(p["payload"]))), ""
    )
    unusable = F.exists(direct, lambda p: p["is_container"] | p["problem"].isNotNull())
    return F.when(unusable, "").otherwise(glued)


def contents(parsed, direct_parts=False):
    """Parsed messages with body, attachments and text in place of the parts.

    ``text`` is what to index and to excerpt: by default the text of the chosen
    body, with ``direct_parts`` that of all top-level parts together.
    """
    headers = [c for c in parsed.columns if c not in ("parts", "problem")]
    chosen = F.coalesce("body.content", F.lit(""))
    return (
        parsed.withColumn("body", body())
        .withColumn("attachments", attachments())
        .withColumn("_source", _direct_source() if direct_parts else chosen)
        .withColumn("text", html_to_text(F.col("_source")))
        .select(*headers, "body", "attachments", "text")
    )


def attachment_rows(content):
    """One row per attachment, with its ordinal within the message."""
    return content.select(
        "mbox_file_id", "email_start", "message_id",
        F.posexplode("attachments").alias("ordinal", "attachment"),
    ).select("mbox_file_id", "email_start", "message_id", "ordinal", "attachment.*")


def find_attachment(content, message_id, filename):
    """The first attachment with exactly this name in one message."""
    return (
        attachment_rows(content.filter(F.col("message_id") == message_id))
        .filter(F.col("filename") == filename)
        .orderBy("mbox_file_id", "email_start", "ordinal")
        .limit(1)
    )


def excerpt(text="text"):
    return F.substring(text, 1, EXCERPT_CHARS)
