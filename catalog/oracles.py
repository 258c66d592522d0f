"""The same queries as SQL for DuckDB, written against the given tables."""

from catalog import queries as q
from catalog.fixtures import ARCHIVE_DOCS, FILE_DOCS, SLOT
from mailspark.functions import text as t
from mailspark.operators import search as s
from mailspark.operators import vector_index as v

ID = "concat('<', cast(d.doc_id as varchar), '@', d.source, '.example.com>')"

# The message id of a vector, with or without a document of its number.
VECTOR_ID = f"""case when d.doc_id is null then concat('<v', e.vec_id, '@vectors.example.com>') else {ID} end"""
VECTORS = "embeddings e left join documents d on d.doc_id = e.vec_id"

MAIL = f"""mail as (
  select d.doc_id, d.doc_id // {ARCHIVE_DOCS} as archive, d.text, d.n_chars,
    {ID} as message_id,
    split_part(d.text, chr(10), 1) as subject,
    substr(d.text, 1, 30) as excerpt,
    case when d.doc_id % 17 = 0 or o.o_custkey is null then null
      else concat('User ', o.o_custkey, ' <u', o.o_custkey, '@', d.source, '.example.com>')
    end as from_email,
    concat('list@', d.lang, '.example.com') as to_email,
    case when d.doc_id % 23 = 0 then null else o.o_orderdate end as date,
    cast(d.doc_id % 4 as integer) as has_attachment,
    case when d.doc_id % 19 = 0 then ['']
      else [d.lang, coalesce(o.o_orderpriority, '5-LOW'), case when d.doc_id % 4 = 0 then 'Sent' else 'Inbox' end]
    end as labels,
    coalesce('t' || (o.o_custkey % 50), '') as thread_id,
    o.o_custkey as customer
  from documents d left join orders o on o.o_orderkey = d.doc_id
)"""

EMAILS = f"""{MAIL},
emails as (
  select message_id, subject, excerpt, from_email, to_email, date, has_attachment, labels,
    'text/plain; charset=utf-8' as content_type,
    concat('archive-', archive) as mbox_file_id,
    doc_id % {ARCHIVE_DOCS} * {SLOT} as email_start,
    doc_id % {ARCHIVE_DOCS} * {SLOT} + n_chars as email_end,
    thread_id
  from mail
)"""

# The text of each message as it stands in its mail file.
MESSAGES = f"""{MAIL},
messages as (
  select *, concat(
    'From sender@example.com Thu Jan 01 00:00:00 1970', chr(10),
    coalesce('From: ' || from_email || chr(10), ''),
    'To: ', to_email, chr(10),
    'Subject: =?utf-8?B?', base64(encode(split_part(text, chr(10), 1))), '?=', chr(10),
    coalesce('Date: ' || case when customer % 2 = 1
      then strftime(date + interval 2 hour, '%a, %d %b %Y %H:%M:%S +0200')
      else strftime(date, '%a, %d %b %Y %H:%M:%S +0000') end || chr(10), ''),
    'Message-ID: ', message_id, chr(10),
    case when doc_id % 19 = 0 then ''
      else 'X-Gmail-Labels: ' || array_to_string(labels, ',') || chr(10) end,
    'X-GM-THRID: ', thread_id, chr(10),
    'MIME-Version: 1.0', chr(10), 'Content-Type: text/plain; charset=utf-8', chr(10),
    'Content-Transfer-Encoding: 8bit', chr(10), chr(10), text) as message
  from mail
)"""

# Whole files, cut at every line that begins with the mark.
RECORDS = f"""{MESSAGES},
files as (
  select archive, string_agg(message || chr(10), '' order by doc_id) as content
  from messages group by archive
),
cut as (
  select archive, content, string_split(content, chr(10) || 'From ') as pieces from files
),
numbered as (
  select archive, octet_length(encode(content)) as size,
    unnest(pieces) as value, generate_subscripts(pieces, 1) as i
  from cut
),
records as (
  select *, octet_length(encode(value)) as n,
    sum(octet_length(encode(value)) + 6) over (
      partition by archive order by i) - octet_length(encode(value)) - 6 as pos
  from numbered
)"""

# What loading each document's message gives: its text ends at the first marked line.
LOADED = f"""{MESSAGES},
pieces as (
  select *, string_split(message, chr(10) || 'From ')[1] as piece,
    substr(string_split(chr(10) || text, chr(10) || 'From ')[1], 2) || chr(10) as kept,
    sum(octet_length(encode(message)) + 1) over (partition by archive order by doc_id)
      - octet_length(encode(message)) - 1 as email_start
  from messages
)"""

SHOWN = """message_id, subject, excerpt, from_email, date, has_attachment,
  array_to_string(labels, '|') as labels_text, email_start, email_end, thread_id"""

HITS = f"""hits as (
  select {VECTOR_ID} as message_id,
    list_cosine_distance(e.embedding::double[],
      (select embedding::double[] from embeddings where vec_id = 0)) as dist
  from {VECTORS}
  order by dist, message_id limit {q.NEAREST}
)"""

TURNS = """turns as (
  select *, concat('<c', conv_id, '.', turn, '@chat.example.com>') as message_id,
    '<p>' || text || '</p>' as markup,
    role in ('user', 'assistant') as has_file
  from conversations
)"""


def _quoted(value):
    return "'" + value.replace("'", "''") + "'"


def _replaced(expression, pattern, replacement):
    return f"regexp_replace({expression}, {_quoted(pattern)}, {_quoted(replacement)}, 'g')"


def readable(expression):
    """SQL for the readable text of an HTML column (no numeric references)."""
    for pattern, replacement in [
        (t.SILENT, ""), (r"[\t\n\r\f]", " "), (t.BLOCK_TAG, "\n"), (t.ANY_TAG, ""),
    ]:
        expression = _replaced(expression, pattern, replacement)
    for name, character in t.NAMED_ENTITIES.items():
        expression = f"replace({expression}, '&{name};', {_quoted(character)})"
    for pattern, replacement in [
        (" +", " "), (" *\n[ \n]*", "\n"), ("^[ \n]+", ""), ("[ \n]+$", ""),
    ]:
        expression = _replaced(expression, pattern, replacement)
    return expression


def _emails(where="true", tail=""):
    return f"with {EMAILS} select {SHOWN} from emails where {where} {tail}"


NEWEST = "order by date desc nulls last, message_id"
CRITERIA_SQL = (
    "from_email like '%src%' and subject like '%an%' and list_contains(labels, 'en') "
    "and date >= timestamp '1996-02-01' and date <= timestamp '2000-06-30'"
)
SEARCH_SQL = (
    "list_contains(labels, 'Sent') and date >= timestamp '1996-01-01' "
    "and date <= timestamp '2000-12-31'"
)
SUMMARY = """select count(distinct message_id) as all_emails,
  avg(email_end - email_start) as avg_size, min(date) as first_seen, max(date) as last_seen,
  coalesce(date_sub('day', min(date), max(date)) / 365, 0.0) as days_timespan
  from emails"""
MONTHLY = """monthly as (
  select date_trunc('month', date) as mmonth, cast(sum(email_end - email_start) as bigint) as sizes
  from emails group by 1
),
cumulative as (
  select 1 as dummy, mmonth as date,
    cast(sum(sizes) over (order by mmonth nulls last) as bigint) as count
  from monthly
)"""
FOUND = f"""found as (
  select emails.*, hits.dist from emails join hits using (message_id)
  where dist < {q.MAX_DISTANCE}
)"""


def _search_parse():
    text = (
        "concat('from:', coalesce(from_email, 'nobody'), ' xlabel:', "
        "array_to_string(labels, ' label:'), ' subject:\"', excerpt, '\" ', subject, "
        "' rag:\"\" to_date:', coalesce(strftime(date, '%Y-%m-%d'), 'never'))"
    )
    pattern = _quoted(s.FILTER_PATTERN)
    keys = ", ".join(
        f"nullif(list_filter(hits, lambda h: h.key = '{k}')[-1].value, '') as {k}_filter"
        for k in s.FILTER_KEYS
    )
    return f"""with {EMAILS},
searches as (select message_id, {text} as search from emails),
groups as (
  select message_id, search, regexp_extract_all(search, {pattern}, 1) as keys,
    regexp_extract_all(search, {pattern}, 3) as quoted,
    regexp_extract_all(search, {pattern}, 4) as bare
  from searches
),
parsed as (
  select message_id, search,
    list_transform(range(1, len(keys) + 1), lambda i: {{'key': keys[i],
      'value': coalesce(nullif(quoted[i], ''), bare[i], '')}}) as hits
  from groups
)
select message_id, {keys},
  regexp_replace(regexp_replace(search, {pattern}, '', 'g'), '^\\s+|\\s+$', '', 'g')
    as excerpt_filter
from parsed"""


def _saved(name, where):
    return f"select '{name}' as search, message_id, date from emails where {where}"


def all_oracles():
    out = {
        "mbox_scan": f"""with {RECORDS}
select archive, md5(value) as value_md5, n as value_bytes from records""",
        "mbox_offsets": f"""with {RECORDS}
select archive,
  cast(case when pos = 0 then 0 else pos - 5 end as bigint) as email_start,
  cast(case when pos + n = size then pos + n else pos + n + 1 end as bigint) as email_end,
  md5(concat(case when pos = 0 then '' else 'From ' end, value,
    case when pos + n = size then '' else chr(10) end)) as raw_md5
from records""",
        "mbox_invalid_files": f"""select 0 as archive union all
select archive from (
  select 1 + doc_id // {FILE_DOCS} as archive, arg_min(text, doc_id) as head from documents group by 1)
where archive % 2 = 1 and not starts_with(head, 'From ')""",
        "archive_fingerprint": f"""with {RECORDS},
placed as (
  select archive, size, case when pos = 0 then 0 else pos - 5 end as email_start, sha256(value) as digest
  from records),
marked as (
  select archive, size, sha256(concat_ws(':', cast(cast(email_start as bigint) as varchar), digest)) as mark from placed)
select archive, sha256(concat_ws(':', cast(max(size) as varchar), cast(count(*) as varchar),
  {", ".join(f"cast(sum(cast('0x' || substr(mark, {at}, 15) as bigint)) as varchar)" for at in (1, 16, 31))})) as mbox_file_id
from marked group by archive""",
        "ingest_twice": f"""with {RECORDS}
select name, case when name in ('raw_messages', 'contents') then (select count(*) from records)
  else (select count(*) from messages) end as n
from (select unnest(['emails', 'documents', 'embeddings', 'raw_messages', 'contents']) as name)""",
        "ingest_emails": f"""with {LOADED}
select message_id, split_part(text, chr(10), 1) as subject,
  substr({readable("kept")}, 1, 30) as excerpt, from_email, date, 0 as has_attachment,
  array_to_string(labels, '|') as labels_text, cast(email_start as bigint) as email_start,
  cast(email_start + octet_length(encode(piece)) + 1 as bigint) as email_end, thread_id,
  to_email, 'text/plain; charset="utf-8"' as content_type
from pieces""",
        "ingest_archive": f"""with {LOADED}, texts as (
  select message_id, {readable("kept")} as body from pieces)
select message_id, substr(body, 1, 30) as excerpt, md5(body) as text_md5, 768 as width
from texts""",
        "emails_sink": _emails(),
        "embeddings_sink": f"""select {VECTOR_ID} as message_id, 'fixture' as mbox_file_id,
  cast(len(embedding) as integer) as width,
  round(list_sum(embedding::double[]), 4) as total
from {VECTORS}""",
        "documents_sink": f"select {ID} as message_id, md5(d.text) as text_md5 from documents d",
        "raw_message": f"""with {LOADED}
select cast(email_start as bigint) as email_start, cast(email_start + octet_length(encode(piece)) + 1 as bigint) as email_end,
  md5(piece || chr(10)) as raw_md5 from pieces where message_id = '{q.LOOKUP_ID}'""",
        "raw_message_batch": f"""with {LOADED}
select archive, cast(email_start as bigint) as email_start,
  cast(email_start + octet_length(encode(piece)) + 1 as bigint) as email_end, md5(piece || chr(10)) as raw_md5
from pieces where list_contains(labels, 'Sent')""",
        "ingest_append_dedup": f"""with {EMAILS} select * replace (
  case when date < timestamp '{q.ADDED_SINCE}' then 'as first loaded' else excerpt end as excerpt)
from (select {SHOWN} from emails)""",
        "point_lookup": _emails(f"message_id = '{q.LOOKUP_ID}'"),
        "filter_from": _emails("from_email like '%u1_@src%'"),
        "filter_subject": _emails("subject like '%the%of%'"),
        "filter_label": _emails("list_contains(labels, '2-HIGH')"),
        "filter_excerpt": _emails("excerpt like '%an%'"),
        "filter_date_range": _emails(
            "date >= timestamp '1996-02-01' and date <= timestamp '1996-12-31'"
        ),
        "filter_sent": _emails("list_contains(labels, 'Sent')"),
        "filter_combined": _emails(CRITERIA_SQL + " and list_contains(labels, 'Sent')"),
        "filter_ids": _emails(
            f"message_id in (select {VECTOR_ID} from {VECTORS})"
        ),
        "list_recent": _emails(tail=f"{NEWEST} limit 30"),
        "list_deep_page": _emails(
            tail=f"{NEWEST}, mbox_file_id, email_start limit {2 * q.PAGE_SIZE} offset {(q.DEEP_PAGE - 1) * q.PAGE_SIZE}"
        ),
        "list_directory": f"with {EMAILS} select count(*) as total_count, true as gapless, true as bounded from emails",
        "list_page": _emails("list_contains(labels, 'en')", f"{NEWEST} limit 5 offset 10"),
        "list_latest": _emails(tail=f"{NEWEST} limit 1"),
        "emails_normalised": f"""with {EMAILS}, records as (
  select * replace (coalesce(from_email, '') as from_email, '' as to_email,
    cast(null as varchar) as content_type) from emails)
select {SHOWN}, to_email, content_type from records""",
        "search_parse": _search_parse(),
        "search_page": _emails(SEARCH_SQL, f"{NEWEST} limit 5 offset 5"),
        "page_meta": f"""with {EMAILS}, total as (
  select count(*) as n from emails where {SEARCH_SQL})
select 5 as start_index, 10 as end_index, n as total_count, n > 10 as has_more,
  case when n > 10 then 3 else -1 end as next_page from total""",
        "search_count": f"""with {EMAILS}
select count(distinct message_id) as email_count from emails where {SEARCH_SQL}""",
        "search_batch": f"with {EMAILS} "
        + " union all ".join(
            [
                _saved("sender", "from_email like '%u1%'"),
                _saved("sent", "list_contains(labels, 'Sent')"),
                _saved("dated", "subject like '%the%' and date >= timestamp '1998-01-01'"),
                _saved(
                    "free",
                    "excerpt like '%an%' and date >= timestamp '1996-01-01' "
                    "and date <= timestamp '2000-12-31'",
                ),
            ]
        ),
        "filter_indexed": _emails(" and ".join(f"{c} like '%{x}%'" for c, x in q.INDEXED.items())),
        "search_batch_table": f"""with {EMAILS},
searches as (
  select message_id as search_id, doc % 5 as kind, coalesce(strftime(date, '%Y-%m-%d'), '1997-01-31') as day,
    split_part(from_email, '@', 1) || '@' as sender, nullif(substr(subject, 5, 12), '') as part,
    nullif(labels[1], '') as label, nullif(regexp_replace(substr(excerpt, 3, 10), '^\\s+|\\s+$', '', 'g'), '') as free
  from (select *, cast(split_part(substr(message_id, 2), '@', 1) as bigint) as doc from emails)),
asked as (
  select search_id,
    case kind when 0 then coalesce(sender, 'nobody') when 2 then 'src3.' end as sender,
    case kind when 1 then part end as part,
    case kind when 2 then label end as label,
    case when kind = 4 then free when kind = 2 and label is null then 'label:' end as free,
    case when kind = 3 then timestamp '1998-06-15' end as low,
    case when kind >= 3 then cast(day as timestamp) end as high
  from searches)
select search_id, message_id, date from asked join emails on
  (sender is null or from_email like '%' || sender || '%')
  and (part is null or subject like '%' || part || '%')
  and (label is null or list_contains(labels, label))
  and (free is null or excerpt like '%' || free || '%')
  and (low is null or date >= low) and (high is null or date <= high)""",
        "hybrid_search": f"""with {EMAILS}, {HITS}, {FOUND}
select {SHOWN}, round(dist, 4) as dist from found where list_contains(labels, 'en')
order by dist, message_id limit 20""",
        "hybrid_search_slice_first": f"""with {EMAILS}, {HITS}, {FOUND},
cut as (select * from found order by dist, message_id limit 20)
select {SHOWN}, round(dist, 4) as dist from cut where list_contains(labels, 'en')""",
        "thread_members": _emails(f"thread_id = '{q.THREAD}'"),
        "thread_of_message": _emails(
            f"thread_id in (select thread_id from emails where message_id = '{q.LOOKUP_ID}')"
        ),
        "threads_of_messages": _emails(
            "thread_id in (select thread_id from emails where from_email like '%u1_@src%')"
        ),
        "thread_sizes": f"""with {EMAILS}
select thread_id, count(*) as thread_count from emails where thread_id <> '' group by thread_id""",
        "thread_enriched": f"""with {LOADED}
select message_id, date, md5(kept) as body_md5, 0 as n_attachments
from pieces where thread_id = '{q.THREAD}'""",
        "message_detail": f"""with {LOADED}
select message_id, subject, from_email, date, has_attachment, thread_id, kept as email_content,
  0 as n_attachments,
  (select count(*) from mail o where o.thread_id = pieces.thread_id) as thread_count
from pieces where message_id = '{q.LOOKUP_ID}'""",
        "parse_messages": f"""with {TURNS}
select message_id, concat(role, ' <', role, '@chat.example.com>') as from_email,
  concat('c', conv_id) as thread_text,
  case role when 'user' then 5 when 'assistant' then 3 else 1 end as n_parts,
  case role when 'user' then 2 when 'assistant' then 1 else 0 end as n_containers,
  case role when 'user' then 2 when 'assistant' then 1 else 0 end as max_depth
from turns""",
        "extract_body": f"""with {TURNS}
select message_id, case role when 'assistant' then 'Plain Text' else 'HTML' end as body_type,
  md5(case role when 'assistant' then text else markup end) as content_md5
from turns""",
        "extract_attachments": f"""with {TURNS}
select message_id, 0 as ordinal, concat('turn', turn, '.txt') as filename,
  'text/plain' as content_type, cast(octet_length(encode(text)) as bigint) as size_bytes,
  md5(text) as content_md5, substr(hex(text), 1, 100) as preview_hex
from turns where has_file""",
        "attachment_counts": f"""with {TURNS}
select message_id, cast(has_file as integer) as has_attachment,
  cast(has_file as integer) as n_attachments from turns""",
        "attachment_lookup": f"""with {TURNS}
select message_id, concat('turn', turn, '.txt') as filename, 'text/plain' as content_type,
  cast(octet_length(encode(text)) as bigint) as size_bytes, md5(text) as content_md5
from turns where has_file and message_id = '{q.ATTACHMENT[0]}'
  and concat('turn', turn, '.txt') = '{q.ATTACHMENT[1]}'""",
        "ingest_text": f"""with {TURNS}, texts as (
  select message_id, case role when 'assistant' then text else markup end as body from turns)
select message_id, md5({readable("body")}) as text_md5 from texts""",
        "ingest_text_direct": f"""with {TURNS}, texts as (
  select message_id, case role when 'user' then '' when 'assistant' then text || text
    else markup end as body from turns)
select message_id, md5({readable("body")}) as text_md5 from texts""",
        "stats_summary": f"with {EMAILS} {SUMMARY}",
        "stats_display": f"""with {EMAILS}, summary as ({SUMMARY})
select all_emails, round(days_timespan, 2) as years,
  round(avg_size / (1024 * 1024), 2) as avg_size_mb from summary""",
        "stats_incremental": f"""with {EMAILS}, summary as ({SUMMARY})
select (select count(*) from emails) as messages, avg_size, first_seen, last_seen, days_timespan, true as near
from summary""",
        "monthly_incremental": f"with {EMAILS}, {MONTHLY} select mmonth, sizes from monthly",
        "monthly_sizes": f"with {EMAILS}, {MONTHLY} select mmonth, sizes from monthly",
        "monthly_cumulative": f"with {EMAILS}, {MONTHLY} select dummy, date, count from cumulative",
        "monthly_display": f"""with {EMAILS}, {MONTHLY}
select strftime(date, '%Y-%m-%d') as date, round(count / (1024 * 1024), 2) as size_mb
from cumulative""",
        "report_dates_size": f"""with {EMAILS}, {MONTHLY}
select dummy, strftime(date, '%Y-%m-%d') as date, count from cumulative""",
        "top_domains": f"""with {EMAILS}
select regexp_extract(from_email, '@([^>]+)') as domain, count(*) as count
from emails where from_email is not null group by 1 order by count desc, domain limit 10""",
        "top_subjects": f"""with {EMAILS}
select subject, count(*) filter (has_attachment > 0) as with_attachment, count(*) as cnt
from emails group by subject order by cnt desc, subject nulls last limit 3""",
        "html_text": f"select page_id, {readable('html')} as text from pages",
        "header_date": """select o_orderkey,
  case when o_custkey % 5 = 4 then null else o_orderdate end as date from orders""",
        "free_dates": """with dated as (
  select o_orderkey, o_orderkey % 10 as kind, o_orderdate + to_seconds(o_orderkey % 86400) as moment from orders)
select o_orderkey, case
  when kind = 8 then null
  when kind in (2, 5) then date_trunc('minute', moment)
  when kind in (4, 9) then cast(date_trunc('day', moment) as timestamp)
  when kind = 3 and day(moment) <= 12 then make_timestamp(year(moment), day(moment), month(moment), hour(moment), minute(moment), second(moment))
  else moment end as date from dated""",
        "embed_documents": f"""select {ID} as message_id, 768 as width, cast(1.0 as double) as norm
from documents d""",
        "semantic_topk": f"with {HITS} select message_id, round(dist, 4) as dist from hits",
        "semantic_join": f"""with {EMAILS}, {HITS}, {FOUND}
select message_id, subject, round(dist, 4) as dist from found""",
        "semantic_batch": f"""with asked as (
  select vec_id, embedding from embeddings order by vec_id limit {q.BATCH_QUERIES}),
scored as (
  select concat('q', a.vec_id) as query, {VECTOR_ID} as message_id,
    list_cosine_distance(e.embedding::double[], a.embedding::double[]) as dist
  from {VECTORS} cross join asked a),
ranked as (
  select *, row_number() over (partition by query order by dist, message_id) as rank from scored)
select query, message_id, round(dist, 4) as dist, cast(rank as integer) as rank
from ranked where rank <= {q.BATCH_NEAREST}""",
        "semantic_lsh": f"""with vectors as (
  select {VECTOR_ID} as message_id, e.vec_id, e.embedding::double[] as v from {VECTORS}),
places as (select unnest(range((select max(len(v)) from vectors))) as i),
slots as (
  select t, b, (t * {q.INDEX_BITS} + b) * {v.STEP_PLANE} as plane
  from range({q.INDEX_TABLES}) x(t) cross join range({q.INDEX_BITS}) y(b)),
signs as (select t, b, i, (plane + i * {v.STEP_PLACE} + 1) % {v.PRIME} as x from slots cross join places),
planes as (
  select t, b, list(case when (x * x % {v.PRIME} * {v.FACTOR} + x) % {v.PRIME} % 2 = 0 then 1.0 else -1.0 end order by i)::double[] as w
  from signs group by t, b),
sums as (select vec_id, message_id, t, b, list_dot_product(v, w) as s from vectors cross join planes),
buckets as (
  select vec_id, message_id, t, cast(sum(case when s >= 0 then 1 << b else 0 end) as bigint) as bucket
  from sums group by all),
nearest_bits as (
  select t, b, row_number() over (partition by t order by abs(s), b) - 1 as r from sums where vec_id = 0),
masks as (
  select t, m, cast(coalesce(sum(1 << b) filter ((m >> r) % 2 = 1), 0) as bigint) as mask
  from nearest_bits cross join range({1 << q.INDEX_TURNED}) x(m) where r < {q.INDEX_TURNED} group by t, m),
probes as (
  select t, xor(bucket, mask) as bucket from buckets join masks using (t) where vec_id = 0),
scored as (
  select message_id, list_cosine_distance(v, (select v from vectors where vec_id = 0)) as dist
  from vectors where vec_id in (select vec_id from buckets join probes using (t, bucket)))
select message_id, round(min(dist), 4) as dist from scored
group by message_id order by min(dist), message_id limit {q.BATCH_NEAREST}""",
        "rerank_best": f"""with {HITS},
words as (
  select message_id, d.text,
    list_distinct(list_filter(regexp_split_to_array(lower(d.text), '[ \\t\\n\\r\\f]+'),
      lambda w: w <> '')) as w,
    list_distinct(string_split({_quoted(q.RERANK_QUERY)}, ' ')) as asked
  from hits join documents d on {ID} = message_id)
select message_id, md5(text) as text_md5,
  round(len(list_intersect(w, asked)) / len(list_distinct(list_concat(w, asked))), 6) as score
from words order by score desc, message_id limit 1""",
    }
    return out
