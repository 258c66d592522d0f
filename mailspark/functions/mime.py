"""The one step that needs a MIME library: message bytes to a list of parts.

Nothing is decided here. Which part is the body, what counts as an attachment,
how text is derived: those rules are column expressions over the parts.
"""

import email
import email.message
import email.policy
import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts that stand in for what cannot be decoded.
EMPTY_PAYLOAD = b"[Empty attachment content]"
BAD_PAYLOAD = "[Error decoding attachment content: {}]"
BAD_BODY = "[Error decoding body content: {}]"
BAD_MESSAGE = "Parsing failed: {}"

# Parsed header lines remembered per task, and their longest: each comes with its tree of tokens, which for a long
# subject takes over a hundred times its size.
HEADERS_KEPT, HEADER_CHARS = 512, 256
#: Messages are parsed and handed on in portions of at most so many bytes, or one longer message.
PORTION = 1 << 22

HEADERS = {
    "message_id": "Message-ID",
    "from_email": "From",
    "to_email": "To",
    "subject": "Subject",
    "date_text": "Date",
    "labels_text": "X-Gmail-Labels",
    "content_type": "Content-Type",
    "thread_text": "X-GM-THRID",
}

# Header values of these shapes mean what is written: the structured parser would
# hand them back unchanged, at most of the cost of a whole parse. Dates are read
# by ``header_timestamp`` in any case.
_ATOM = r"[A-Za-z0-9!#$%&'*+/?^_`{|}~-]+"
_ADDRESS = rf"{_ATOM}(?:\.{_ATOM})*@{_ATOM}(?:\.{_ATOM})*"
_MAILBOX = rf"{_ADDRESS}|(?:{_ATOM} )+<{_ADDRESS}>"
_WORDS = r"[!-<>-~]+(?: [!-<>-~]+)*"
AS_WRITTEN = {
    "message_id": re.compile(rf"<{_ADDRESS}>"),
    "from_email": re.compile(_MAILBOX),
    "to_email": re.compile(_MAILBOX),
    "subject": re.compile(_WORDS),
    "date_text": re.compile(r"[ -~]+"),
    "labels_text": re.compile(_WORDS),
    "thread_text": re.compile(_WORDS),
}

PART_TYPE = pa.struct(
    [
        ("depth", pa.int32()),
        ("content_type", pa.string()),
        ("filename", pa.string()),
        ("disposition", pa.string()),
        ("is_container", pa.bool_()),
        ("content", pa.string()),
        ("payload", pa.binary()),
        ("problem", pa.string()),
    ]
)
OUTPUT = pa.schema(
    [("mbox_file_id", pa.string()), ("email_start", pa.int64()), ("email_end", pa.int64())]
    + [(name, pa.string()) for name in HEADERS]
    + [
        ("has_attachment", pa.int32()),
        ("parts", pa.list_(PART_TYPE)),
        ("problem", pa.string()),
    ]
)


def _clean(text):
    """A string that can be encoded: stray surrogates become '?'."""
    return None if text is None else str(text).encode("utf-8", "replace").decode("utf-8")


def _header(message, name):
    try:
        return _clean(message[name])
    except Exception:  # a header the structured parser chokes on: take it as written
        return _clean(next((v for k, v in message.raw_items() if k.lower() == name.lower()), None))


def _headers(message):
    written = {}
    for name, value in message.raw_items():
        written.setdefault(name.lower(), value)
    row = {}
    for column, name in HEADERS.items():
        value, plain = written.get(name.lower()), AS_WRITTEN.get(column)
        if value is not None and not (plain and plain.fullmatch(value)):
            value = _header(message, name)
        row[column] = value
    return row


def _attempt(step, failure):
    try:
        return step()
    except Exception as problem:
        return failure(problem)


def _payload(part):
    value = part.get_payload(decode=True)
    return EMPTY_PAYLOAD if value is None else value


def _part(part, depth):
    container = part.is_multipart()
    text = part.get_content_maintype() == "text"
    filename = _attempt(lambda: _clean(part.get_filename()), lambda _: None)
    disposition = _header(part, "Content-Disposition")
    detached = bool(filename) or (disposition or "").startswith("attachment")
    entry = {
        "depth": depth,
        "content_type": part.get_content_type(),
        "filename": filename,
        "disposition": disposition,
        "is_container": container,
    }
    if text and not container:
        try:
            entry["content"] = _clean(part.get_content())
        except Exception as problem:
            entry["problem"] = _clean(problem)
            entry["content"] = BAD_BODY.format(entry["problem"])
    if not container and (detached or not text):
        entry["payload"] = _attempt(
            lambda: _payload(part), lambda e: BAD_PAYLOAD.format(e).encode("utf-8", "replace")
        )
    return entry


def _walk(part, depth=0):
    yield _part(part, depth)
    if part.is_multipart():
        for child in part.get_payload():
            yield from _walk(child, depth + 1)


class _Message(email.message.EmailMessage):
    """A message that looks up each header and its type once; the library goes through all lines each time."""

    def __init__(self, policy=None):
        super().__init__(policy)
        self._found, self._type = {}, None

    def set_raw(self, name, value):  # how the parser adds a header
        self._found, self._type = {}, None
        super().set_raw(name, value)

    def set_default_type(self, ctype):
        self._type = None
        super().set_default_type(ctype)

    def get(self, name, failobj=None):
        name = name.lower()
        if name not in self._found:
            self._found[name] = super().get(name, _Message)
        value = self._found[name]
        return failobj if value is _Message else value

    def get_content_type(self):
        if self._type is None:
            self._type = super().get_content_type()
        return self._type


def _policy():
    """The default policy, but equal header lines are parsed once.

    The library parses a header each time it is looked at, and most of the time
    of a parse goes there; content types and senders repeat all the time.
    """
    parse = email.policy.default.header_fetch_parse
    parsed = functools.lru_cache(HEADERS_KEPT)(parse)

    class Remembering(email.policy.EmailPolicy):
        def header_fetch_parse(self, name, value):
            return parsed(name, value) if len(value) <= HEADER_CHARS else parse(name, value)

    return Remembering(message_factory=_Message)


def _message(raw, policy):
    try:
        message = email.message_from_bytes(raw, policy=policy)
        row = _headers(message)
        row["has_attachment"] = _attempt(lambda: len(list(message.iter_attachments())), lambda _: 0)
        row["parts"] = list(_walk(message))
        return row
    except Exception as problem:
        return {"has_attachment": 0, "parts": [], "problem": _clean(BAD_MESSAGE.format(problem))}


def _portions(batch):
    """A batch in runs of messages of at most PORTION bytes together, longer messages alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column("raw")), 0).to_numpy(zero_copy_only=False).astype("int64")
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = int(ends[first] - sizes[first])
        after = max(first + 1, int(np.searchsorted(ends, before + PORTION, "right")))
        yield batch.slice(first, after - first)
        first = after


def parts_of(batches):
    """Arrow batches of (file id, extent, raw) to batches of headers and parts; memory is bounded by a portion's."""
    policy = _policy()
    for batch in batches:
        for portion in _portions(batch):
            rows = []
            for source in portion.to_pylist():
                row = _message(source.pop("raw") or b"", policy)
                row.update(source)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=OUTPUT)
