"""Archive statistics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailspark.functions.text import day_text, megabytes, sender_domain

MICROS_PER_DAY = 86_400_000_000
DAYS_PER_YEAR = 365


def _size():
    return F.col("email_end") - F.col("email_start")


def _micros(column):
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, column)


def summary(emails, approximate=False):
    """Message count, mean size and covered time span: one row from one scan."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    facts = emails.agg(
        distinct("message_id").alias("all_emails"),
        F.avg(_size()).alias("avg_size"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
    )
    # Whole elapsed days, not midnights passed.
    elapsed = _micros(F.col("last_seen")) - _micros(F.col("first_seen"))
    days = F.floor(elapsed / F.lit(MICROS_PER_DAY))
    return facts.withColumn("days_timespan", F.coalesce(days / DAYS_PER_YEAR, F.lit(0.0)))


def display_summary(summary_row):
    """The summary as shown: megabytes and years with two decimals."""
    return summary_row.select(
        "all_emails",
        F.round("days_timespan", 2).alias("years"),
        megabytes(F.col("avg_size")).alias("avg_size_mb"),
    )


def monthly_sizes(emails):
    """Bytes per calendar month; messages without date form a NULL month."""
    month = F.date_trunc("month", "date").cast("timestamp_ntz")
    return emails.groupBy(month.alias("mmonth")).agg(F.sum(_size()).alias("sizes"))


def monthly_cumulative(emails):
    """Archive size at the end of each month; the NULL month comes last.

    The running sum sees months (a few hundred rows), never messages.
    """
    order = (
        Window.partitionBy("dummy")
        .orderBy(F.asc_nulls_last("mmonth"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        monthly_sizes(emails)
        .withColumn("dummy", F.lit(1))
        .select("dummy", F.col("mmonth").alias("date"), F.sum("sizes").over(order).alias("count"))
    )


def display_cumulative(cumulative):
    """The series as shown: day text and megabytes."""
    return cumulative.select(
        day_text("date").alias("date"), megabytes(F.col("count")).alias("size_mb")
    )


def top_domains(emails, n=10):
    """Most frequent sender domains, ``@`` kept; '' is a sender without domain."""
    return (
        emails.filter(F.col("from_email").isNotNull())
        .groupBy(sender_domain(F.col("from_email")).alias("domain"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "domain")
        .limit(n)
    )


def top_subjects(emails, n=3):
    """Most frequent subjects and how many of their messages have attachments."""
    return (
        emails.groupBy("subject")
        .agg(
            F.count_if(F.col("has_attachment") > 0).alias("with_attachment"),
            F.count("*").alias("cnt"),
        )
        .orderBy(F.desc("cnt"), F.asc_nulls_last("subject"))
        .limit(n)
    )
