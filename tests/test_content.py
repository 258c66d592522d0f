import base64
import email
import email.policy
import gc
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailspark import schemas
from mailspark.functions import mime
from mailspark.functions.text import ascii_text, html_to_text
from mailspark.operators import content

HEAD = b"From: a@x.org\nTo: b@x.org\nSubject: S\nMessage-ID: <m@x>\n"
PLAIN = HEAD + b"Content-Type: text/plain\n\nHello,\n\nThis is plain.\n"
HTML = HEAD + b"Content-Type: text/html\n\n<html><body><h1>Hello World</h1><p>Hi</p></body></html>\n"


def multipart(kind, *parts):
    body = b"".join(b"--b\n" + part + b"\n" for part in parts)
    return HEAD + b'MIME-Version: 1.0\nContent-Type: multipart/%s; boundary="b"\n\n' % kind + body + b"--b--\n"


def inner(kind, *parts):
    body = b"".join(b"--i\n" + part + b"\n" for part in parts)
    return b'Content-Type: multipart/%s; boundary="i"\n\n' % kind + body + b"--i--\n"


def text_part(kind, text, extra=b""):
    return b"Content-Type: text/" + kind + b"\n" + extra + b"\n" + text


def file_part(data, disposition=b'attachment; filename="test.pdf"', kind=b"application/pdf"):
    return (
        b"Content-Type: " + kind + b"\nContent-Disposition: " + disposition
        + b"\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(data)
    )


@pytest.fixture
def parse(spark):
    def run(raw, **options):
        frame = spark.createDataFrame([("f", "p", 0, len(raw), bytearray(raw))], schemas.RAW_MESSAGES)
        return content.contents(content.parse_messages(frame), **options).first()

    return run


def test_plain_body(parse):
    row = parse(PLAIN)
    assert tuple(row["body"]) == ("Plain Text", "Hello,\n\nThis is plain.\n")
    assert row["attachments"] == [] and row["has_attachment"] == 0
    assert row["text"] == "Hello, This is plain."
    assert (row["message_id"], row["from_email"], row["to_email"]) == ("<m@x>", "a@x.org", "b@x.org")


def test_html_body(parse):
    row = parse(HTML)
    assert row["body"]["body_type"] == "HTML" and "<h1>Hello World</h1>" in row["body"]["content"]
    assert row["text"] == "Hello World\nHi"


def test_html_wins_over_plain(parse):
    row = parse(multipart(b"alternative", text_part(b"plain", b"as text"), text_part(b"html", b"<p>as html</p>")))
    assert tuple(row["body"]) == ("HTML", "<p>as html</p>")
    assert row["has_attachment"] == 0


def test_last_html_and_first_plain_part_count(parse):
    two_html = multipart(b"mixed", text_part(b"html", b"one"), text_part(b"html", b"two"))
    two_plain = multipart(b"mixed", text_part(b"plain", b"one"), text_part(b"plain", b"two"))
    assert parse(two_html)["body"]["content"] == "two"
    assert parse(two_plain)["body"]["content"] == "one"


def test_empty_html_falls_back_to_plain_and_nothing_to_none(parse):
    mixed = multipart(b"mixed", text_part(b"html", b""), text_part(b"plain", b"words"))
    assert tuple(parse(mixed)["body"]) == ("Plain Text", "words")
    only_file = multipart(b"mixed", file_part(b"%PDF"))
    assert tuple(parse(only_file)["body"]) == ("None", None)


def test_attachment(parse):
    data = b"%PDF-1.4" + bytes(range(256))
    row = parse(multipart(b"mixed", text_part(b"plain", b"see file"), file_part(data)))
    (found,) = row["attachments"]
    assert found["filename"] == "test.pdf" and found["content_type"] == "application/pdf"
    assert found["size_bytes"] == len(data) and bytes(found["content"]) == data
    assert bytes(found["content_preview"]) == data[:50]
    assert row["has_attachment"] == 1 and row["body"]["content"] == "see file"


def test_attachment_without_name_or_content(parse):
    row = parse(multipart(b"mixed", text_part(b"plain", b"x"), file_part(b"", b"attachment")))
    (found,) = row["attachments"]
    assert found["filename"] == "Untitled" and found["size_bytes"] == 0


def test_inline_part_with_a_name_is_an_attachment_and_no_body(parse):
    named = text_part(b"plain", b"notes", b'Content-Disposition: inline; filename="n.txt"\n')
    row = parse(multipart(b"mixed", named, text_part(b"plain", b"the body")))
    assert row["body"]["content"] == "the body"
    assert [a["filename"] for a in row["attachments"]] == ["n.txt"]


def test_nested_layout(parse):
    alternative = inner(b"alternative", text_part(b"plain", b"as text"), text_part(b"html", b"<p>deep</p>"))
    raw = multipart(b"mixed", alternative, file_part(b"data"))
    row = parse(raw)
    assert tuple(row["body"]) == ("HTML", "<p>deep</p>") and row["text"] == "deep"
    assert parse(raw, direct_parts=True)["text"] == ""


def test_direct_parts_are_glued_with_binary_ones_as_ascii(parse):
    raw = multipart(b"mixed", text_part(b"plain", b"see "), file_part(b"a\xffb"))
    assert parse(raw, direct_parts=True)["text"] == "see ab"
    assert parse(raw)["text"] == "see"


def test_junk_and_empty_bytes_do_not_fail(parse):
    assert parse(b"\x00\x01 not a message")["body"]["body_type"] in ("Plain Text", "None")
    assert tuple(parse(b"")["body"]) == ("None", None)


def test_unknown_charset_is_told_in_the_body(parse):
    row = parse(HEAD + b"Content-Type: text/plain; charset=no-such\n\nabc\n")
    assert row["body"]["content"].startswith("[Error decoding body content:")
    direct = parse(HEAD + b"Content-Type: text/plain; charset=no-such\n\nabc\n", direct_parts=True)
    assert direct["text"] == ""


def test_invalid_utf8_body_and_headers(parse):
    row = parse(b"Subject: caf\xe9\nContent-Type: text/plain; charset=utf-8\n\nab\xffcd\n")
    assert row["body"]["content"] == "ab�cd\n"
    assert row["subject"].startswith("caf") and row["message_id"] is None


def test_encoded_words_and_folded_headers(parse):
    row = parse(b"Subject: =?utf-8?B?w6ljb2xl?=\n and more\nX-Gmail-Labels: a,\n b\n\nx\n")
    assert row["subject"] == "école and more"
    assert row["labels_text"].replace(" ", "") == "a,b"


def test_find_attachment_takes_the_first_of_a_name(spark):
    raw = multipart(b"mixed", file_part(b"one"), file_part(b"two"))
    frame = spark.createDataFrame([("f", "p", 0, 1, bytearray(raw))], schemas.RAW_MESSAGES)
    parsed = content.contents(content.parse_messages(frame))
    assert bytes(content.find_attachment(parsed, "<m@x>", "test.pdf").first()["content"]) == b"one"
    assert content.find_attachment(parsed, "<m@x>", "other").count() == 0
    assert content.find_attachment(parsed, "<n@x>", "test.pdf").count() == 0


@pytest.mark.parametrize(
    "html, text",
    [
        ("a<br>b", "a\nb"),
        ("<p> x  y </p>\n<p>z</p>", "x y\nz"),
        ("<head><title>t</title></head><body>b</body>", "b"),
        ("<header>h</header>c", "h\nc"),
        ("a<!-- <p>x</p> -->b", "ab"),
        ("<SCRIPT>if (a < b) {}</SCRIPT >c", "c"),
        ("1 < 2 &amp;&lt;&#233;&#xE9;&#128512;", "1 < 2 &<éé😀"),
        ("&amp;lt; &unknown; &#55296; &#; &", "&lt; &unknown; &#55296; &#; &"),
        ("plain\ntext", "plain text"),
        ("", ""),
    ],
)
def test_html_to_text(spark, html, text):
    frame = spark.createDataFrame([(html,)], "h string")
    assert frame.select(html_to_text(F.col("h")).alias("t")).first()["t"] == text


def test_ascii_text(spark):
    frame = spark.createDataFrame([(bytearray("héllo".encode()),)], "b binary")
    assert frame.select(ascii_text(F.col("b")).alias("t")).first()["t"] == "hllo"


@pytest.mark.parametrize("column", sorted(set(mime.AS_WRITTEN) - {"date_text"}))
def test_plain_header_values_are_what_the_structured_parser_gives(column):
    name = mime.HEADERS[column]

    @settings(max_examples=60, deadline=None)
    @given(st.from_regex(mime.AS_WRITTEN[column], fullmatch=True))
    def check(value):
        message = email.message_from_string(f"{name}: {value}\n\n", policy=email.policy.default)
        assert str(message[name]) == value

    check()


def test_dates_out_of_the_nanosecond_range(spark):
    from pyspark.sql import functions as F

    from mailspark.functions.dates import header_timestamp

    texts = ["Mon, 1 Jan 1500 12:00:00 EST", "Fri, 31 Dec 9999 23:59:59 EST", "no date", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", header_timestamp(F.col("text")).cast("string").alias("at")
    )
    found = {r["text"]: r["at"] for r in rows.collect()}
    assert found["Mon, 1 Jan 1500 12:00:00 EST"] == "1500-01-01 17:00:00"
    assert found["no date"] is None and found[None] is None


def test_messages_are_parsed_in_portions_of_bounded_size():
    raws = [b"Message-ID: <%d@x>\nSubject: s\n\n" % n + b"line of text\n" * size for n, size in enumerate([800] * 1500 + [900_000, 0, 800])]
    raws[3] = None
    columns = [["f"] * len(raws), list(range(len(raws))), list(range(1, len(raws) + 1)), raws]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()))],
        ["mbox_file_id", "email_start", "email_end", "raw"],
    )
    found = list(mime.parts_of([batch, batch.slice(0, 0)]))
    assert len(found) > 3 and max(len(b) * 10_000 for b in found) < 2 * mime.PORTION
    rows = [r for b in found for r in b.to_pylist()]
    assert [r["email_start"] for r in rows] == columns[1]
    assert [r["message_id"] for r in rows] == [None if n == 3 else f"<{n}@x>" for n in range(len(raws))]
    assert [len(r["parts"][0]["content"]) for r in rows[-3:]] == [13 * 900_000, 0, 13 * 800]
    assert list(mime._portions(batch.slice(0, 0))) == []


def test_long_headers_are_not_remembered():
    gc.collect()
    tracemalloc.start()
    policy = mime._policy()
    for n in range(600):
        subject = base64.b64encode(f"{n} of a line of words ".encode() * 40)
        row = mime._message(b"Subject: =?utf-8?B?" + subject + b"?=\n\nx\n", policy)
        assert row["subject"].startswith(f"{n} of a line")
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 4 << 20
