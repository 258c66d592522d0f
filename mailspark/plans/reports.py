"""Named report series."""

from mailspark.functions.text import day_text
from mailspark.operators import stats

EMPTY_SCHEMA = "date string, count bigint"


def _dates_size(emails):
    series = stats.monthly_cumulative(emails)
    return series.withColumn("date", day_text("date"))


REPORTS = {"dates_size": _dates_size, "domains_count": stats.top_domains}


def time_series(emails, name):
    """The rows of a named report; none for an unknown name."""
    if name not in REPORTS:
        return emails.sparkSession.createDataFrame([], EMPTY_SCHEMA)
    return REPORTS[name](emails)
