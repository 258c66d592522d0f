"""Statistics that are kept up to date: what a load adds is summed once, reports merge the sums.

For each mail file and month there is one row: messages, messages with a size, their bytes, the first and last
date and a sketch of the message ids. Sums, counts and bounds merge exactly. The sketch gives the number of
different ids with a standard error of about 1.6 % (``SKETCH_BITS``). A report reads files x months rows,
however many messages there are.
"""

from pyspark.sql import functions as F

from mailspark.operators.stats import MICROS_PER_DAY, DAYS_PER_YEAR, _micros, _size

#: Base-2 logarithm of the sketch's registers; the standard error is about 1.04 / sqrt(2 ** 12).
SKETCH_BITS = 12
SCHEMA = (
    "mbox_file_id string, mmonth timestamp_ntz, n long, sized long, sizes long, "
    "first_seen timestamp_ntz, last_seen timestamp_ntz, ids binary"
)


def partial_stats(emails):
    """One row for each file and month; messages without date form a NULL month."""
    month = F.date_trunc("month", "date").cast("timestamp_ntz")
    return emails.groupBy("mbox_file_id", month.alias("mmonth")).agg(
        F.count("*").alias("n"),
        F.count(_size()).alias("sized"),
        F.sum(_size()).alias("sizes"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
        F.hll_sketch_agg("message_id", F.lit(SKETCH_BITS)).alias("ids"),
    )


def summary(partials):
    """The summary of an archive from its partial statistics: one row."""
    facts = partials.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("ids")), F.lit(0)).alias("all_emails"),
        (F.sum("sizes") / F.sum("sized")).alias("avg_size"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    elapsed = _micros(F.col("last_seen")) - _micros(F.col("first_seen"))
    days = F.floor(elapsed / F.lit(MICROS_PER_DAY))
    return facts.withColumn("days_timespan", F.coalesce(days / DAYS_PER_YEAR, F.lit(0.0)))


def monthly_sizes(partials):
    """Bytes per calendar month."""
    return partials.groupBy("mmonth").agg(F.sum("sizes").alias("sizes"))
