"""Lookup, filters, paging and the search language."""

import re
from functools import reduce

from pyspark.sql import functions as F

from mailspark.schemas import EMAILS

# The filters of the search language and how one is written.
FILTER_KEYS = ["from", "subject", "rag", "from_date", "to_date", "label"]
FILTER_PATTERN = r'(from|subject|rag|from_date|to_date|label):("([^\n]*)"|([^ \n]+))'
SENT_LABEL = "Sent"
RECENT_ROWS = 30


def _newest_first(emails):
    order = [F.desc_nulls_last("date"), F.asc_nulls_last("message_id")]
    return emails.orderBy(*order, "mbox_file_id", "email_start")  # the place tells equal ids apart


# -- the search language ------------------------------------------------------


def parse_search(text):
    """Criteria of one search string; empty values count as no criterion."""
    pattern = re.compile(FILTER_PATTERN)
    found = {m[1]: m[3] or m[4] for m in pattern.finditer(text or "")}
    found["excerpt"] = pattern.sub("", text or "").strip()
    return {key: value for key, value in found.items() if value}


def parse_searches(searches, column):
    """Criteria of a column of search strings, one string column per filter."""
    text, pattern = F.col(column), F.lit(FILTER_PATTERN)
    hits = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("key"),
        F.regexp_extract_all(text, pattern, F.lit(3)).alias("quoted"),
        F.regexp_extract_all(text, pattern, F.lit(4)).alias("bare"),
    )
    hits = F.transform(
        hits,
        lambda h: F.struct(
            h["key"].alias("key"),
            F.when(h["quoted"] != "", h["quoted"]).otherwise(h["bare"]).alias("value"),
        ),
    )
    found = searches.withColumn("_hits", hits)

    def last(key):
        own = F.filter(F.col("_hits"), lambda h: h["key"] == key)
        return F.nullif(F.try_element_at(own, F.lit(-1))["value"], F.lit(""))

    rest = F.regexp_replace(text, FILTER_PATTERN, "")
    rest = F.regexp_replace(rest, r"^\s+|\s+$", "")
    return found.select(
        *searches.columns,
        *[last(key).alias(f"{key}_filter") for key in FILTER_KEYS],
        rest.alias("excerpt_filter"),
    )


# -- predicates ---------------------------------------------------------------


def contains(column, value):
    """SQL LIKE '%value%': case-sensitive; % and _ in the value are wildcards."""
    return F.col(column).like("%" + value.replace("\\", "\\\\") + "%")


def has_label(label):
    return F.array_contains("labels", F.lit(label))


def _moment(text):
    return F.lit(text).cast("timestamp_ntz")


def criteria_predicates(criteria, text_column="excerpt"):
    """The active predicates of a criteria dict.

    Free text is only looked for when no label is asked for. An upper date bound
    without a time means midnight at the start of that day.
    """
    active = []
    if criteria.get("from"):
        active.append(contains("from_email", criteria["from"]))
    if criteria.get("subject"):
        active.append(contains("subject", criteria["subject"]))
    if criteria.get("label"):
        active.append(has_label(criteria["label"]))
    elif criteria.get("excerpt"):
        active.append(contains(text_column, criteria["excerpt"]))
    if criteria.get("from_date"):
        active.append(F.col("date") >= _moment(criteria["from_date"]))
    if criteria.get("to_date"):
        active.append(F.col("date") <= _moment(criteria["to_date"]))
    return active


def matches(criteria=None, sent=False, text_column="excerpt"):
    """One Column that is true for the messages a search asks for."""
    active = criteria_predicates(criteria or {}, text_column)
    if sent:
        active.append(has_label(SENT_LABEL))
    return reduce(lambda a, b: a & b, active, F.lit(True))


def select_matching(emails, criteria=None, sent=False, text_column="excerpt"):
    return emails.filter(matches(criteria, sent, text_column))


def restrict_to_ids(emails, ids):
    """Messages whose id is in ``ids``; the ids stay a DataFrame."""
    return emails.join(ids.select("message_id").distinct(), "message_id", "left_semi")


def search_many(emails, searches, text_column="excerpt"):
    """Matches of many saved searches (name -> search string) in one pass.

    Every row is tested against all predicates where it is read; only matching
    (search, message) pairs are produced, without a join.
    """
    hits = F.array(
        *[
            F.when(matches(parse_search(text), text_column=text_column), F.lit(name))
            for name, text in searches.items()
        ]
    )
    return emails.withColumn("search", F.explode(F.array_compact(hits)))


# -- listing ------------------------------------------------------------------


def point_lookup(emails, message_id):
    """The first message with this id."""
    same = emails.filter(F.col("message_id") == message_id)
    return same.orderBy("mbox_file_id", "email_start").limit(1)


def list_recent(emails):
    return _newest_first(emails).limit(RECENT_ROWS)


def list_page(emails, limit, offset=0):
    return _newest_first(emails).offset(offset).limit(limit)


def list_latest(emails):
    return _newest_first(emails).limit(1)


def list_emails(emails, page=None, criteria=None, sent=False, ids=None):
    """Newest messages: a default list, one page, or one row for a partial page."""
    if not page:
        return list_recent(emails)
    if "limit" not in page or "offset" not in page:
        return list_latest(emails)
    chosen = select_matching(emails, criteria, sent)
    if ids is not None:
        chosen = restrict_to_ids(chosen, ids)
    return list_page(chosen, page["limit"], page["offset"])


def count_matching(emails, criteria=None, sent=False):
    """Distinct messages that match, as one row."""
    chosen = select_matching(emails, criteria, sent)
    return chosen.agg(F.count_distinct("message_id").alias("email_count"))


def page_meta(total, page, page_size, column="total_count"):
    """Paging facts from a one-row count."""
    start = (page - 1) * page_size
    end = start + page_size
    count = F.col(column)
    return total.select(
        F.lit(start).alias("start_index"),
        F.lit(end).alias("end_index"),
        count.alias("total_count"),
        (count > end).alias("has_more"),
        F.when(count > end, page + 1).otherwise(-1).alias("next_page"),
    )


MANDATORY = ["message_id", "date", "email_start", "email_end"]
DEFAULTS = {
    "subject": "",
    "from_email": "",
    "to_email": "",
    "excerpt": "",
    "has_attachment": 0,
    "thread_id": "",
    "labels": [],
    "content_type": None,
    "mbox_file_id": None,
}


def normalised(emails):
    """Message records of full width, with defaults for what is missing.

    Id, date and extent columns must be there; any other column may be absent.
    """
    absent = [c for c in MANDATORY if c not in emails.columns]
    if absent:
        raise KeyError(f"message records need {', '.join(absent)}")

    def field(spec):
        if spec.name in MANDATORY:
            return F.col(spec.name)
        default = DEFAULTS[spec.name]
        default = F.array() if default == [] else F.lit(default)
        default = default.cast(spec.dataType)
        value = F.coalesce(spec.name, default) if spec.name in emails.columns else default
        return value.alias(spec.name)

    return emails.select(*[field(spec) for spec in EMAILS.fields])
