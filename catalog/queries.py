"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import fixtures as fx
from mailspark.functions.dates import header_timestamp
from mailspark.functions.text import html_to_text
from mailspark.operators import (
    content, kept_stats, page_index, saved_searches, search, semantic, stats, text_index, threads, vector_index,
)
from mailspark.plans import ingest as loading
from mailspark.plans import message_view, reports
from mailspark.plans.mail_search import search_mail
from mailspark.session import shared_dir
from mailspark.sources import mbox, ranges, tables

# Inputs a user would type; the SQL in oracles.py uses the same.
LOOKUP_ID = "<1@src1.example.com>"
THREAD = "t7"
ATTACHMENT = ("<c0.1@chat.example.com>", "turn1.txt")
CRITERIA = {
    "from": "src",
    "subject": "an",
    "label": "en",
    "excerpt": "ignored because of the label",
    "from_date": "1996-02-01",
    "to_date": "2000-06-30",
}
SEARCH = "label:Sent from_date:1996-01-01 to_date:2000-12-31"
SAVED_SEARCHES = {
    "sender": "from:u1",
    "sent": "label:Sent",
    "dated": "subject:the from_date:1998-01-01",
    "free": "from_date:1996-01-01 to_date:2000-12-31 an",
}
NEAREST = 100
MAX_DISTANCE = 0.8
BATCH_QUERIES = 5
BATCH_NEAREST = 10
INDEX_BLOCK = 256
INDEXED = {"from_email": "u1_%@src1", "subject": "tion%ing"}
INDEX_TABLES, INDEX_BITS, INDEX_TURNED = 6, 4, 2
RERANK_QUERY = "the of and que de la"
ADDED_SINCE = "1998-01-01"
DEEP_PAGE, PAGE_SIZE, PAGE_BLOCK = 20, 7, 64

_REGISTERED = {}


def registered(query):
    _REGISTERED[query.__name__] = query
    return query


def _shown(emails, *extra):
    """Message rows with the label list as text."""
    return emails.select(
        "message_id", "subject", "excerpt", "from_email", "date", "has_attachment",
        F.array_join("labels", "|").alias("labels_text"), "email_start", "email_end", "thread_id",
        *extra,
    )


# -- mbox files and the archive tables ------------------------------------------


@registered
def mbox_scan(spark, sf_dir):
    records = mbox.scan(spark, fx.archive_files(spark, sf_dir))
    return records.select(
        fx.archive_of("path").alias("archive"),
        F.md5("value").alias("value_md5"),
        F.octet_length("value").alias("value_bytes"),
    )


@registered
def mbox_offsets(spark, sf_dir):
    raw = loading.read_archive(spark, fx.archive_files(spark, sf_dir))
    return raw.select(
        fx.archive_of("path").alias("archive"), "email_start", "email_end", F.md5("raw").alias("raw_md5")
    )


@registered
def mbox_invalid_files(spark, sf_dir):
    folder = fx.text_files(spark, sf_dir)
    index = mbox.split_index(mbox.scan(spark, folder))
    return mbox.invalid_files(spark, folder, index).select(fx.archive_of("path").alias("archive"))


@registered
def archive_fingerprint(spark, sf_dir):
    folder = fx.archive_files(spark, sf_dir)
    records = mbox.scan(spark, folder)
    ids = mbox.fingerprints(records)
    return ids.select(fx.archive_of("path").alias("archive"), "mbox_file_id")


@registered
def ingest_emails(spark, sf_dir):
    raw = loading.read_archive(spark, fx.archive_files(spark, sf_dir))
    emails = loading.email_rows(content.contents(content.parse_messages(raw)))
    return _shown(emails, "to_email", "content_type")


@registered
def ingest_archive(spark, sf_dir):
    root = shared_dir(spark, "tables")
    loaded = loading.ingest(spark, fx.archive_files(spark, sf_dir), root)
    emails, documents = loaded["emails"], loaded["documents"]
    vectors = loaded["embeddings"].select("message_id", F.size("vec").alias("width"))
    return (
        emails.select("message_id", "excerpt")
        .join(documents.select("message_id", F.md5("text").alias("text_md5")), "message_id")
        .join(vectors, "message_id")
    )


@registered
def ingest_twice(spark, sf_dir):
    """The rows of every table after the same files were loaded two times."""
    root, folder = shared_dir(spark, "tables"), fx.archive_files(spark, sf_dir)
    loading.ingest(spark, folder, root)
    loaded = loading.ingest(spark, folder, root)
    counts = [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, f in loaded.items()]
    return reduce(DataFrame.unionByName, counts)


@registered
def emails_sink(spark, sf_dir):
    root = shared_dir(spark, "tables")
    tables.write_emails(fx.emails(spark, sf_dir), root)
    return _shown(tables.open_archive(spark, root)["emails"])


@registered
def embeddings_sink(spark, sf_dir):
    root = shared_dir(spark, "tables")
    rows = fx.vectors(spark, sf_dir).withColumn("mbox_file_id", F.lit("fixture"))
    tables.write_embeddings(rows, root)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return tables.open_archive(spark, root)["embeddings"].select(
        "message_id", "mbox_file_id", F.size("vec").alias("width"), F.round(total, 4).alias("total")
    )


@registered
def documents_sink(spark, sf_dir):
    root = shared_dir(spark, "tables")
    rows = fx.documents(spark, sf_dir)
    copies = rows.withColumn("text", F.lit("a later copy")).withColumn("position", F.lit(1))
    both = rows.withColumn("position", F.lit(0)).unionByName(copies)
    tables.write_documents(both, root, order=["position"])
    saved = tables.open_archive(spark, root)["documents"]
    return saved.select("message_id", F.md5("text").alias("text_md5"))


@registered
def raw_message(spark, sf_dir):
    emails, files = fx.located_emails(spark, sf_dir)
    found = ranges.find_raw_batch(files, search.point_lookup(emails, LOOKUP_ID))
    return found.select("email_start", "email_end", F.md5("raw").alias("raw_md5"))


@registered
def raw_message_batch(spark, sf_dir):
    emails, files = fx.located_emails(spark, sf_dir)
    found = ranges.find_raw_batch(files, search.select_matching(emails, sent=True))
    return found.select(
        fx.archive_of("path").alias("archive"), "email_start", "email_end", F.md5("raw").alias("raw_md5")
    )


@registered
def ingest_append_dedup(spark, sf_dir):
    emails = fx.emails(spark, sf_dir)
    existing = emails.filter(F.col("date") < F.lit(ADDED_SINCE).cast("timestamp_ntz"))
    existing = existing.withColumn("excerpt", F.lit("as first loaded"))
    return _shown(tables.append_new(existing, emails))


# -- lookup, filters, listing ----------------------------------------------------


@registered
def point_lookup(spark, sf_dir):
    return _shown(search.point_lookup(fx.emails(spark, sf_dir), LOOKUP_ID))


def _filter_query(name, criteria=None, sent=False):
    def query(spark, sf_dir):
        return _shown(search.select_matching(fx.emails(spark, sf_dir), criteria, sent))

    _REGISTERED[name] = query


_filter_query("filter_from", {"from": "u1_@src"})
_filter_query("filter_subject", {"subject": "the%of"})
_filter_query("filter_label", {"label": "2-HIGH"})
_filter_query("filter_excerpt", {"excerpt": "an"})
_filter_query("filter_date_range", {"from_date": "1996-02-01", "to_date": "1996-12-31"})
_filter_query("filter_sent", sent=True)
_filter_query("filter_combined", CRITERIA, sent=True)


@registered
def filter_ids(spark, sf_dir):
    emails = fx.emails(spark, sf_dir)
    return _shown(search.restrict_to_ids(emails, fx.vectors(spark, sf_dir)))


@registered
def list_recent(spark, sf_dir):
    return _shown(search.list_recent(fx.emails(spark, sf_dir)))


@registered
def list_page(spark, sf_dir):
    page = {"limit": 5, "offset": 10}
    return _shown(search.list_emails(fx.emails(spark, sf_dir), page, {"label": "en"}))


def _page_index(spark, sf_dir):
    return page_index.build_page_index(fx.emails(spark, sf_dir), shared_dir(spark, "pages"), block=PAGE_BLOCK)


@registered
def list_deep_page(spark, sf_dir):
    """A page far down the list and the one after it, the second by the last row of the first."""
    index = _page_index(spark, sf_dir)
    page = index.page(PAGE_SIZE, (DEEP_PAGE - 1) * PAGE_SIZE)
    order = [name.lstrip("-") for name in page_index.ORDER]
    last = page.select(*order).tail(1)
    after = page_index.page_after(fx.emails(spark, sf_dir), last[0].asDict(), PAGE_SIZE) if last else page.limit(0)
    return _shown(page.unionByName(after))


@registered
def list_directory(spark, sf_dir):
    """Rows counted by the directory, and whether its blocks follow each other without gaps or overlaps."""
    blocks = _page_index(spark, sf_dir).directory
    return blocks.agg(
        F.sum("n").alias("total_count"),
        (F.max(F.col("rows_before") + F.col("n")) == F.sum("n")).alias("gapless"),
        (F.max("n") <= PAGE_BLOCK).alias("bounded"),
    )


@registered
def list_latest(spark, sf_dir):
    return _shown(search.list_emails(fx.emails(spark, sf_dir), {"limit": 5}))


@registered
def emails_normalised(spark, sf_dir):
    narrow = fx.emails(spark, sf_dir).drop("to_email", "content_type")
    records = search.normalised(narrow)
    return _shown(records, "to_email", "content_type")


# -- search language and searches ------------------------------------------------


@registered
def search_parse(spark, sf_dir):
    text = F.concat(
        F.lit("from:"), F.coalesce("from_email", F.lit("nobody")),
        F.lit(" xlabel:"), F.array_join("labels", " label:"),
        F.lit(' subject:"'), F.col("excerpt"), F.lit('" '), F.col("subject"),
        F.lit(' rag:"" to_date:'), F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("never")),
    )
    searches = fx.emails(spark, sf_dir).select("message_id", text.alias("search"))
    return search.parse_searches(searches, "search").drop("search")


@registered
def search_page(spark, sf_dir):
    emails = fx.emails(spark, sf_dir)
    return _shown(search_mail(emails, SEARCH, page=2, page_size=5).page)


@registered
def page_meta(spark, sf_dir):
    emails = fx.emails(spark, sf_dir)
    return search_mail(emails, SEARCH, page=2, page_size=5, folder="Sent").meta


@registered
def search_count(spark, sf_dir):
    return search.count_matching(fx.emails(spark, sf_dir), search.parse_search(SEARCH))


@registered
def search_batch(spark, sf_dir):
    hits = search.search_many(fx.emails(spark, sf_dir), SAVED_SEARCHES)
    return hits.select("search", "message_id", "date")


@registered
def search_batch_table(spark, sf_dir):
    emails = fx.emails(spark, sf_dir)
    hits = saved_searches.search_table(emails, fx.saved_searches(spark, sf_dir))
    return hits.select("search_id", "message_id", "date")


@registered
def filter_indexed(spark, sf_dir):
    path = shared_dir(spark, "text-index")
    index = text_index.build_text_index(fx.emails(spark, sf_dir), path, block=INDEX_BLOCK)
    return _shown(index.search(INDEXED))


def _hybrid(mode):
    def query(spark, sf_dir):
        result = search_mail(
            fx.emails(spark, sf_dir),
            "rag:question label:en",
            page=1,
            page_size=20,
            vectors=fx.vectors(spark, sf_dir),
            embed=lambda text: fx.query_vector(spark, sf_dir),
            n_results=NEAREST,
            max_distance=MAX_DISTANCE,
            mode=mode,
        )
        return _shown(result.page, F.round("dist", 4).alias("dist"))

    return query


_REGISTERED["hybrid_search"] = _hybrid("filter_first")
_REGISTERED["hybrid_search_slice_first"] = _hybrid("slice_first")


# -- threads and message views ---------------------------------------------------


@registered
def thread_members(spark, sf_dir):
    return _shown(threads.thread_members(fx.emails(spark, sf_dir), THREAD))


@registered
def thread_of_message(spark, sf_dir):
    return _shown(threads.thread_of_message(fx.emails(spark, sf_dir), LOOKUP_ID))


@registered
def threads_of_messages(spark, sf_dir):
    emails = fx.emails(spark, sf_dir)
    asked = search.select_matching(emails, {"from": "u1_@src"})
    return _shown(threads.threads_of_messages(emails, asked))


@registered
def thread_sizes(spark, sf_dir):
    return threads.thread_sizes(fx.emails(spark, sf_dir))


@registered
def thread_enriched(spark, sf_dir):
    emails, files = fx.located_emails(spark, sf_dir)
    rows = message_view.thread_with_content(emails, files, THREAD)
    return rows.select(
        "message_id", "date", F.md5("parsed_body").alias("body_md5"),
        F.size("attachments").alias("n_attachments"),
    )


@registered
def message_detail(spark, sf_dir):
    emails, files = fx.located_emails(spark, sf_dir)
    detail = message_view.message_detail(emails, files, LOOKUP_ID)
    shown = detail.message.select(
        "message_id", "subject", "from_email", "date", "has_attachment", "thread_id",
        F.col("parsed_body").alias("email_content"), F.size("attachments").alias("n_attachments"),
    )
    return shown.join(threads.thread_sizes(detail.thread), "thread_id", "left")


@registered
def parse_messages(spark, sf_dir):
    parsed = content.parse_messages(fx.conversation_messages(spark, sf_dir))
    return parsed.select(
        "message_id", "from_email", "thread_text",
        F.size("parts").alias("n_parts"),
        F.size(F.filter("parts", lambda p: p["is_container"])).alias("n_containers"),
        F.array_max(F.transform("parts", lambda p: p["depth"])).alias("max_depth"),
    )


def _contents(spark, sf_dir, **options):
    parsed = content.parse_messages(fx.conversation_messages(spark, sf_dir))
    return content.contents(parsed, **options)


@registered
def extract_body(spark, sf_dir):
    return _contents(spark, sf_dir).select(
        "message_id", "body.body_type", F.md5("body.content").alias("content_md5")
    )


@registered
def extract_attachments(spark, sf_dir):
    return content.attachment_rows(_contents(spark, sf_dir)).select(
        "message_id", "ordinal", "filename", "content_type", "size_bytes",
        F.md5("content").alias("content_md5"), F.hex("content_preview").alias("preview_hex"),
    )


@registered
def attachment_counts(spark, sf_dir):
    return _contents(spark, sf_dir).select(
        "message_id", "has_attachment", F.size("attachments").alias("n_attachments")
    )


@registered
def attachment_lookup(spark, sf_dir):
    places, files = fx.located(spark, fx.conversation_files(spark, sf_dir))
    found = message_view.attachment(places, files, *ATTACHMENT)
    return found.select(
        "message_id", "filename", "content_type", "size_bytes", F.md5("content").alias("content_md5")
    )


@registered
def ingest_text(spark, sf_dir):
    return _contents(spark, sf_dir).select("message_id", F.md5("text").alias("text_md5"))


@registered
def ingest_text_direct(spark, sf_dir):
    texts = _contents(spark, sf_dir, direct_parts=True)
    return texts.select("message_id", F.md5("text").alias("text_md5"))


# -- statistics ------------------------------------------------------------------


@registered
def stats_summary(spark, sf_dir):
    return stats.summary(fx.emails(spark, sf_dir))


@registered
def stats_display(spark, sf_dir):
    return stats.display_summary(stats.summary(fx.emails(spark, sf_dir)))


@registered
def monthly_sizes(spark, sf_dir):
    return stats.monthly_sizes(fx.emails(spark, sf_dir))


@registered
def monthly_cumulative(spark, sf_dir):
    return stats.monthly_cumulative(fx.emails(spark, sf_dir))


@registered
def monthly_display(spark, sf_dir):
    return stats.display_cumulative(stats.monthly_cumulative(fx.emails(spark, sf_dir)))


@registered
def report_dates_size(spark, sf_dir):
    return reports.time_series(fx.emails(spark, sf_dir), "dates_size")


@registered
def top_domains(spark, sf_dir):
    return reports.time_series(fx.emails(spark, sf_dir), "domains_count")


@registered
def top_subjects(spark, sf_dir):
    return stats.top_subjects(fx.emails(spark, sf_dir))


def _kept_stats(spark, sf_dir):
    """Statistics after two loads, the second of which was done twice."""
    root, mail = shared_dir(spark, "tables"), fx.emails(spark, sf_dir)
    odd = F.regexp_extract("mbox_file_id", "[0-9]+", 0).cast("long") % 2 == 1
    for batch in (mail.filter(~odd), mail.filter(odd), mail.filter(odd)):
        tables.write_stats(batch, batch.select("mbox_file_id").distinct(), root)
    return tables.open_stats(spark, root)


@registered
def stats_incremental(spark, sf_dir):
    """The summary from kept statistics; different ids are estimated, so they are compared with the exact number."""
    found = kept_stats.summary(_kept_stats(spark, sf_dir))
    exact = stats.summary(fx.emails(spark, sf_dir)).select("first_seen", F.col("all_emails").alias("exact"))
    near = F.abs(F.col("all_emails") - F.col("exact")) <= 0.05 * F.col("exact")
    return found.join(exact, "first_seen").withColumn("near", near).drop("all_emails", "exact")


@registered
def monthly_incremental(spark, sf_dir):
    return kept_stats.monthly_sizes(_kept_stats(spark, sf_dir))


# -- functions -------------------------------------------------------------------


@registered
def html_text(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


@registered
def header_date(spark, sf_dir):
    dated = fx.dated_orders(spark, sf_dir)
    return dated.select("o_orderkey", header_timestamp(F.col("header")).alias("date"))


@registered
def free_dates(spark, sf_dir):
    dated = fx.freely_dated_orders(spark, sf_dir)
    return dated.select("o_orderkey", header_timestamp(F.col("header")).alias("date"))


# -- semantic search -------------------------------------------------------------


@registered
def embed_documents(spark, sf_dir):
    embedded = semantic.embed_documents(fx.documents(spark, sf_dir))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return embedded.select("message_id", F.size("vec").alias("width"), F.round(norm, 4).alias("norm"))


@registered
def semantic_topk(spark, sf_dir):
    query = fx.query_vector(spark, sf_dir)
    hits = semantic.nearest(fx.vectors(spark, sf_dir), query, NEAREST)
    return hits.select("message_id", F.round("dist", 4).alias("dist"))


@registered
def semantic_join(spark, sf_dir):
    found = semantic.semantic_search(
        fx.emails(spark, sf_dir), fx.vectors(spark, sf_dir), fx.query_vector(spark, sf_dir),
        NEAREST, MAX_DISTANCE,
    )
    return found.withColumn("dist", F.round("dist", 4))


@registered
def semantic_batch(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(BATCH_QUERIES)
    queries = {f"q{row['vec_id']}": list(row["embedding"]) for row in wanted.collect()}
    hits = semantic.nearest_to_each(fx.vectors(spark, sf_dir), queries, BATCH_NEAREST)
    return hits.withColumn("dist", F.round("dist", 4))


@registered
def semantic_lsh(spark, sf_dir):
    path = shared_dir(spark, "vector-index")
    index = vector_index.build_index(fx.vectors(spark, sf_dir), path, INDEX_TABLES, INDEX_BITS)
    hits = index.nearest(fx.query_vector(spark, sf_dir), BATCH_NEAREST, INDEX_TURNED)
    return hits.withColumn("dist", F.round("dist", 4))


@registered
def rerank_best(spark, sf_dir):
    hits = semantic.nearest(fx.vectors(spark, sf_dir), fx.query_vector(spark, sf_dir), NEAREST)
    best = semantic.rerank_best(fx.documents(spark, sf_dir), hits, RERANK_QUERY, NEAREST)
    return best.select("message_id", F.md5("text").alias("text_md5"), F.round("score", 6).alias("score"))


def all_queries():
    return dict(_REGISTERED)
