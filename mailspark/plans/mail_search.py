"""A whole search: string in, one page of messages and its paging facts out."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.operators import search, semantic

SENT_FOLDER = "Sent"
CANDIDATES = 100  # nearest messages considered by a search with rag:


class SearchResult(NamedTuple):
    page: DataFrame
    meta: DataFrame


def search_mail(
    emails,
    text,
    page=1,
    page_size=5,
    folder=None,
    vectors=None,
    embed=None,
    n_results=CANDIDATES,
    max_distance=semantic.MAX_DISTANCE,
    mode="filter_first",
):
    """Search messages.

    ``rag:`` in the text asks for semantic search: ``embed`` turns its value into
    a vector and the hits in ``vectors`` are combined with the other filters.
    ``filter_first`` filters all hits and then cuts the page; ``slice_first`` cuts
    the page out of the hits first, so that pages may come out short.

    Pages list rows, and the total counts rows, so every row is on some page even where several
    messages have one id; with ``slice_first`` pages and total are of ids.
    """
    criteria = search.parse_search(text)
    question = criteria.pop("rag", None)
    sent = folder == SENT_FOLDER
    start = (page - 1) * page_size
    chosen = search.select_matching(emails, criteria, sent)

    if question is None:
        rows = search.list_page(chosen, page_size, start)
        total = chosen.agg(F.count("*").alias("total_count"))
        return SearchResult(rows, search.page_meta(total, page, page_size))

    # one row for each id near enough; joining with the mail once lists every message with that id
    hits = semantic.near_ids(vectors, embed(question), n_results, max_distance)
    small = F.broadcast if n_results <= semantic.HITS_TO_BROADCAST else (lambda frame: frame)
    by_distance = [F.col("dist"), F.col("message_id")]
    if mode == "slice_first":
        # vectors without mail take no place on a page
        listed = emails.select("message_id").join(small(hits), "message_id").distinct()
        cut = listed.orderBy(*by_distance).offset(start).limit(page_size)
        rows = chosen.join(small(cut), "message_id").orderBy(*by_distance)
        total = listed.agg(F.count("*").alias("total_count"))
    else:
        found = chosen.join(small(hits), "message_id")
        rows = found.orderBy(*by_distance, "mbox_file_id", "email_start").offset(start).limit(page_size)
        total = found.agg(F.count("*").alias("total_count"))
    return SearchResult(rows, search.page_meta(total, page, page_size))
